import re
import unicodedata

from pyspark.sql import functions as F

from tessera.functions import numbers as M
from tessera.functions import text as X
from tessera.plans import text_queries


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


def test_clean_text_normalizes_lines_and_blanks(spark):
    assert one(spark, "  ﬁrst\t line \r\n\r\n second\0x ", X.clean_text(F.col("x")))[0] == "first line\n\nsecond x"


def test_title_prefers_the_named_line(spark):
    both = spark.createDataFrame([("1", "x\nTitle:  A  b \n"), ("2", "---\n## Head\n"), ("3", "")], "id string, x string")
    assert [r.t for r in both.orderBy("id").select(X.title(F.col("x"), F.col("id")).alias("t")).collect()] == ["A b", "Head", "Document 3"]


def test_domain(spark):
    rows = spark.createDataFrame([("https://User@Sub.Example.org:8080/a",), ("no url",), (None,)], "x string")
    assert [r[0] for r in rows.select(X.domain(F.col("x"))).collect()] == ["sub.example.org", "unknown-domain", "unknown-domain"]


def test_tokens_keep_inner_marks(spark):
    assert one(spark, "Don't stop—the well-known Größe_2 don't", X.tokens(F.col("x")))[0] == ["don't", "stop", "the", "well-known", "größe", "2"]


def test_usable_sentences_dedup_ignores_case_and_falls_back(spark):
    s = "This is a sentence of words. Short. THIS IS A SENTENCE OF WORDS. Another one, long enough!"
    assert one(spark, s, X.usable_sentences(F.col("x")))[0] == ["This is a sentence of words.", "Another one, long enough!"]
    assert one(spark, "tiny", X.usable_sentences(F.col("x")))[0] == ["tiny"]
    assert one(spark, "", X.usable_sentences(F.col("x")))[0] == []


def test_view_scores_agree_with_python(spark):
    text = "Marie Curie of Paris was born in 1867 and married Pierre Curie; Élan Vital won 2.5% in the 1990s war, a city of Ärzte"
    entity, year, number = (re.compile(p.replace("(?U)", "").replace("(?iU)", "(?i)")) for p in (X.ENTITY, X.YEAR, X.NUMBER))
    terms = set(t.lower() for t in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", text))
    e, y, n, i = len(entity.findall(text)), len(year.findall(text)), len(number.findall(text)), min(len(terms), 45)
    event, ident, time, rel = (len(terms & set(w)) for w in (X.EVENT_TERMS, X.IDENTITY_TERMS, X.TIME_TERMS, X.RELATION_TERMS))
    got = one(spark, text, *(c.alias(v) for v, c in X.view_scores(F.col("x")).items()))
    want = (0.25 * i + e + event, 4 * e + 1.5 * ident + 0.1 * i, 4 * y + 2 * time + 1.5 * event + 0.35 * n, 3 * rel + 1.25 * e + 0.75 * n)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_view_scores_cover_every_sentence(spark, sf, tmp_path):
    entity, year, number = (re.compile(p.replace("(?U)", "").replace("(?iU)", "(?i)")) for p in (X.ENTITY, X.YEAR, X.NUMBER))
    late = "Plain words come here again and again. " * 99 + "At last Marie Curie married in 1895. " + "w" * 900 + " Marie Curie of Paris"
    extra = spark.createDataFrame([(-1, late), (-2, "tiny"), (-3, ""), (-4, None)], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for doc_id, text in docs.collect():
        text = unicodedata.normalize("NFKC", text or "")
        found = {}
        for s in re.split(r"(?<=[.!?。！？])\s+|\n+", text):
            s = " ".join(s.split())[:720]
            if len(s) >= 18:
                found.setdefault(s.lower(), s)
        for k, s in enumerate(found.values() or [" ".join(text.split())[:720] or f"Document {doc_id}"]):
            terms = set(t.lower() for t in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", s))
            e, y, n, i = len(entity.findall(s)), len(year.findall(s)), len(number.findall(s)), min(len(terms), 45)
            event, ident, time, rel = (len(terms & set(w)) for w in (X.EVENT_TERMS, X.IDENTITY_TERMS, X.TIME_TERMS, X.RELATION_TERMS))
            want[doc_id, k] = (0.25 * i + e + event, 4 * e + 1.5 * ident + 0.1 * i, 4 * y + 2 * time + 1.5 * event + 0.35 * n, 3 * rel + 1.25 * e + 0.75 * n)
    rows = text_queries.view_scores(spark, str(tmp_path)).collect()
    got = {(r.doc_id, r.position): tuple(r[2:]) for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and got[-1, 1][1] > 4
    assert [k for k in want if max(abs(a - b) for a, b in zip(got[k], want[k])) > 1e-5] == []


def test_visible_handles_final(spark):
    assert one(spark, "12: “Hi” there\n== D5: A – b", X.visible(F.col("x")))[0] == '"hi" there a - b'
    assert one(spark, "see D12. and xD9, D7|D12", X.handles(F.col("x")))[0] == ["12", "7"]
    assert one(spark, "a <final> b </FINAL> c", X.final_text(F.col("x")))[0] == "b"
    assert one(spark, " plain ", X.final_text(F.col("x")))[0] == "plain"


def test_query_features_are_bounded(spark):
    got = one(spark, 'Who was born in 1867, "x y" and 3 more?', *(c.alias(k) for k, c in X.query_features(F.col("x")).items())).asDict()
    assert got["years"] == 0.25 and got["questions"] == 0.25 and got["quotes"] == 0.25 and abs(got["relations"] - 1 / 6) < 1e-9


def test_numbers(spark):
    low, high = M.wilson(F.lit(8), F.lit(10))
    a, b, none = spark.range(1).select(low, high, M.wilson(F.lit(0), F.lit(0))[0]).first()
    assert 0 < a < 0.8 < b < 1 and none is None
    r = spark.range(1).select(M.unit(F.array(F.lit(3.0), F.lit(4.0))), M.unit(F.array(F.lit(0.0))), M.sigmoid(F.lit(-800.0)), M.leaf_target(F.lit(23)), M.leaf_target(F.lit(250))).first()
    assert r[0] == [0.6, 0.8] and r[1] is None and r[2] == 0.0 and r[3] == 1 and r[4] == 5
