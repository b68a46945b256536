from hashlib import md5

from tests.llm.conftest import prose
from tessera.llm import line_dedup


def ends(a: str, b: str) -> bool:
    """Whether the rolling hash over two lines ends a chunk behind the second."""
    h = [int(md5(x.encode()).hexdigest()[:7], 16) for x in (a, b)]
    return (31 * h[0] + h[1]) % line_dedup.MEAN_LINES == 0


def test_the_stage_removes_chunks_and_what_their_cuts_miss(spark):
    """The blank line at the end of a repeated chunk goes with it, and so do the lines before it, which no chunk has whole."""
    made = (prose(k, 48).split("\n") + [" " * (1 + k % 7)] for k in range(2000))
    passage = next(p for p in made if [ends(a, b) for a, b in zip(p, p[1:])] == [True, False, False, True])
    first, second = prose(5001, 24), prose(5002, 24)
    docs = spark.createDataFrame([(i, "\n".join([t, *passage, f"end {i}"])) for i, t in enumerate((first, second))], "doc_id long, text string")
    texts = dict(map(tuple, line_dedup.deduped(docs).collect()))
    assert texts == {0: "\n".join([first, *passage, "end 0"]), 1: f"{second}\nend 1"}
    chunks = {x.doc_id: x.text for x in line_dedup.dedup(docs).collect()}
    assert chunks == {0: texts[0], 1: "\n".join([second, *passage[:2], "end 1"])}
