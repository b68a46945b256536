from tests.llm.conftest import prose
from tessera.llm import substring_dedup


def test_passages_that_begin_and_end_inside_paragraphs(spark):
    """One whole paragraph of 12 words, and 20 words of the passage on each side of it that belong to paragraphs of other words."""
    words = prose(41, 52).replace(".", "").split()
    passage = " ".join(words[:20]) + ". " + " ".join(words[20:32]) + ". " + " ".join(words[32:])
    line = " ".join(prose(43, 12).replace(".", "").split()) + ". "  # occurs again too, but nothing around it does
    texts = [(k, prose(600 + k, 60).replace(".", "") + " " + passage + " " + prose(700 + k, 60).replace(".", "") + ". " + line + prose(800 + k, 30)) for k in range(4)]
    rows = substring_dedup.passages(spark.createDataFrame([*texts, texts[0]], "doc_id long, text string"), around=True).collect()
    assert sorted(x.doc_id for x in rows) == [0, 1, 2, 3]
    assert {dict(texts)[x.doc_id][x.start : x.end] for x in rows} == {" ".join(passage.split()[7:45])}
    assert all(x.n_words == 38 and x.n_paragraphs == 1 for x in rows)
    assert sorted(x.n_removed for x in rows) == [0, 1, 1, 1] and {x.first_doc_id for x in rows} == {0}
