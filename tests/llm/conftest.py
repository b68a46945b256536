import random

import pytest

WORDS = ("tora minel vasu kreto palin doge frant wilo sume hark bruno elta quin zeft rovil nash gromo pitel usta cavor "
         "lemdi yarn oskel fitru bame jolt kiver ansh dulo perga").split()


def prose(seed: int, n: int, line: int = 12) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) + r.choice(["", "n", "s", "ta", "el", "or"]) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + line]) + "." for k in range(0, n, line))


#: Nulls, empty and blank texts, ties, repeated rows, a long text, and columns whose names clash with the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `row` string, word long, passed string, node string, comp string"


@pytest.fixture(scope="session")
def odd(spark):
    base = prose(1, 120)
    near = base.replace("\n", " ", 3) + " extra tail words"
    texts = [(1, base), (2, base), (2, base), (3, near), (4, None), (5, ""), (6, " \t\n "), (None, base), (None, None), (7, prose(2, 3)), (8, prose(3, 6000)), (9, "1234 !! ##"), (10, prose(4, 200))]
    rows = [(i, t, None if i in (4, 7) else "xx", "s" if i != 5 else None, len(t or ""), 0.5, "r", 1, "p", None, "c") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
