import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import prose
from tessera.llm import codec, packing, token_output
from tessera.llm.tokens import Encoder
from tessera.llm.workspace import Workspace

vocab = pytest.importorskip("public_tokenizers")
FILES = {"byte_bpe_50k.json": False, "word_bpe_49k.json": True}
ENCODERS = {f: Encoder(vocab.path(f), words) for f, words in FILES.items()}


@given(st.lists(st.text(alphabet="abÄß漢é́ .,'!1\n\t Σİ\0", max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_memo_gives_the_librarys_ids(texts):
    for e in ENCODERS.values():
        assert e.encode(texts) == e.whole(texts)


@given(st.lists(st.text(alphabet="abRSstÑøªµ²½×_$%(\"#&'~.|< \n\u00a0\u0307漢", max_size=30), max_size=8))
@settings(max_examples=300, deadline=None)
def test_runs_give_the_librarys_ids(texts):
    for e in ENCODERS.values():
        assert e.encode(texts) == e.whole(texts)


def test_memo_survives_new_generations(monkeypatch):
    from tessera.llm import tokens

    monkeypatch.setattr(tokens, "MEMO", 50)
    e = Encoder(vocab.path("byte_bpe_50k.json"), False)
    texts = [prose(k, 100) for k in range(20)]
    assert e.encode(texts) == e.whole(texts) and e.encode(texts[::-1]) == e.whole(texts[::-1])


@given(st.lists(st.lists(st.integers(0, 65535), max_size=50), max_size=6))
@settings(max_examples=50, deadline=None)
def test_codec_round_trip(documents):
    blobs = [np.array(d, "<u4").tobytes() for d in documents]
    assert codec.decode(codec.encode(blobs)) == blobs


def test_codec_compresses_checks_and_resets():
    r = np.random.default_rng(1)
    ids = np.tile(r.integers(0, 50000, 300), 40).astype("<u4")
    blob = codec.encode([ids.tobytes(), ids[:100].tobytes()])
    assert codec.decode(blob) == [ids.tobytes(), ids[:100].tobytes()] and len(blob) < len(ids)
    broken = bytearray(blob)
    broken[-40] ^= 255
    for bad in (bytes(broken), blob[:-3], b"x" * 40):
        with pytest.raises(ValueError):
            codec.decode(bad)
    with pytest.raises(ValueError):
        codec.encode([np.array([70000], "<u4").tobytes()])


def test_token_files(spark, odd, empty, tmp_path):
    path = vocab.path("byte_bpe_50k.json")
    token_output.write_tokens(odd, path, f"{tmp_path}/a")
    rows = sorted(token_output.read_tokens(spark, f"{tmp_path}/a").collect(), key=lambda x: x.start)
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "", r.doc_id) for r in odd.collect()))
    at = 0
    for x, (*_, text, doc_id) in zip(rows, want, strict=True):
        ids = ENCODERS["byte_bpe_50k.json"].whole([text])[0] + b"\0\0\0\0"
        assert (x.doc_id, x.start, x.n_tokens, bytes(x.ids)) == (doc_id, at, len(ids) // 4, ids)
        at += x.n_tokens
    token_output.write_tokens(empty, path, f"{tmp_path}/b")
    assert token_output.read_tokens(spark, f"{tmp_path}/b").count() == 0


def check_packing(rows, window=2048):
    places = defaultdict(list)
    for x in rows:
        places[x.sequence_id].append(x)
    assert sorted(places) == list(range(len(places)))
    for pieces in places.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= window
    return sum(x.length for x in rows) / (window * max(1, len(places)))


def test_packing_of_odd_rows(spark, odd, empty):
    path = vocab.path("word_bpe_49k.json")
    rows = packing.pack_documents(odd, path).collect()
    check_packing(rows)
    by = defaultdict(list)
    for x in rows:
        by[x.doc_id].append(x)
    for r in odd.where("doc_id in (1, 4, 5, 6, 8)").collect():
        ids = ENCODERS["word_bpe_49k.json"].whole([r.text or ""])[0] + np.array([1], "<u4").tobytes()
        assert b"".join(bytes(x.ids) for x in sorted(by[r.doc_id], key=lambda x: x.start)) == ids
        assert {x.doc_tokens for x in by[r.doc_id]} == {len(ids) // 4}
    digests = packing.piece_digests(odd, path).collect()
    check_packing(digests)
    for r in odd.where("doc_id in (1, 4, 5, 6, 8, 10)").collect():
        ids = ENCODERS["word_bpe_49k.json"].whole([r.text or ""])[0] + np.array([1], "<u4").tobytes()
        some = sorted((x for x in digests if x.doc_id == r.doc_id), key=lambda x: x.start)
        assert [x.ids_crc32 for x in some] == [zlib.crc32(ids[4 * x.start : 4 * (x.start + x.length)]) for x in some] and sum(x.length for x in some) == len(ids) // 4
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("kind", ["mixed", "one", "tiny", "long", "skewed"])
def test_packing_has_little_padding(spark, kind):
    r = np.random.default_rng(2)
    lengths = {"mixed": r.integers(1, 2049, 4000), "one": np.full(3000, 500), "tiny": r.integers(1, 20, 50_000), "long": np.full(900, 1200), "skewed": np.minimum(2048, r.lognormal(5, 1.5, 6000).astype(int) + 1)}[kind]
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "piece long, length long")
    rows = [packing_row(x) for x in packing.place(pieces, Workspace(spark, "t")).collect()]
    assert check_packing(rows) > 0.98
    parts = defaultdict(list)
    for x in rows:
        parts[x.piece].append((x.start, x.length))
    for i, n in enumerate(lengths):  # each token in exactly one part
        at = 0
        for start, size in sorted(parts[i]):
            assert start == at
            at += size
        assert at == n


def packing_row(x):
    return SimpleNamespace(piece=x.piece, start=x.cut_from, length=x.cut_len, sequence_id=x.sequence_id, offset=x.offset)


def test_nnls_finds_a_non_negative_fit():
    r = np.random.default_rng(0)
    a, x = r.random((30, 80)), np.where(r.random(80) < 0.2, r.random(80), 0)
    y = packing.nnls(a, a @ x)
    assert (y >= 0).all() and np.abs(a @ y - a @ x).max() < 1e-6
    plan = packing.plan({2048: 3, 1024: 5, 800: 7, 448: 2}, 2048)
    assert sum((x.hi - x.lo) * x.cut_len for x in plan) == 3 * 2048 + 5 * 1024 + 7 * 800 + 2 * 448
    assert packing.plan({}, 2048) == []


def test_special_strings_are_the_librarys():
    """A plain library call, without this package, decides."""
    from tokenizers import Tokenizer

    texts = ["hello <|endoftext|> world", "<|startoftext|>a<|endoftext|>", "x<|ENDOFTEXT|>y", "<|endoftext|", "two\n<|endoftext|>\n\nlines"]
    for name, words in FILES.items():
        plain = Tokenizer.from_file(vocab.path(name))
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(vocab.path(name), words).encode(texts)] == want
