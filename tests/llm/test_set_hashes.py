"""Words are hashed many at once as well as one by one."""

import random

import numpy as np

from tessera.llm import substring_dedup, words
from tests.llm.conftest import prose


def test_equal_words_and_no_others_get_equal_hashes(monkeypatch):
    r = random.Random(2)
    lists = [[bytes(r.choice(b"ab\x80\xff") for _ in range(n)) for n in (1, 2, 3, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200) for _ in range(9)] for _ in range(4)]
    lists += [[], [b"a", b"a\0", b"a\0\0", b"\0" * 8, b"\0" * 9, b"\0" * 64, b"\0" * 65, b"x" * 100_000], [], lists[0][::-1]]
    flat = [w for ws in lists for w in ws]
    monkeypatch.setattr(words.WordHashes, "__missing__", None)  # no look at each word
    got = words.set_hashes(lists, len(flat)).tolist()
    assert len(set(zip(flat, got))) == len(set(flat)) == len(set(got))
    assert words.set_hashes([], 0).tolist() == [] and words.set_hashes([[b"ab"], []], 2 - 1).tolist() == words.set_hashes([[b"ab"]], 1).tolist()
    assert got == [int(words.set_hashes([[w]], 1)[0]) for w in flat]


def test_paragraphs_are_sketched_without_a_look_at_each_word(spark, monkeypatch):
    called = []
    monkeypatch.setattr(substring_dedup, "list_hashes", lambda *a: called.append(a))
    counts = np.array([3])
    assert len(words.shingle_hashes(words.set_hashes([[b"a", b"b", b"c"]], 3), counts)[0]) == 1 and not called
    source = substring_dedup._paragraphs.__code__.co_consts
    names = {n for c in source if hasattr(c, "co_names") for n in c.co_names}
    assert "set_hashes" in names and "list_hashes" not in names and prose(1, 3)
