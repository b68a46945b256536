"""Queries over text columns, with their oracles."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import lexical, similar
from tessera.operators.sampling import occurrence
from tessera.sources.readers import scan_secrets

TOK = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+(?:[''’-][\p{{L}}\p{{N}}]+)*')"


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def canonical_corpus(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("docid"), X.clean_text(F.col("text")).alias("text"), F.lit("").alias("url"))


def titles(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", X.title(X.clean_lines(F.col("text")), F.col("doc_id")).alias("title"))


def domain_counts(spark, d):
    return _t(spark, d, "pages").select(X.domain(F.col("url")).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


def token_sets(spark, d):
    t = X.tokens(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.array_join(F.slice(t, 1, 5), " ").alias("first_tokens"))


def sentence_stats(spark, d):
    s = X.usable_sentences(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.aggregate(s, F.lit(0), lambda a, x: a + F.length(x)).alias("chars"))


def view_scores(spark, d):
    """Every usable sentence of the whole text, from position 0; the title of a text without one."""
    docs = _t(spark, d, "documents").select("doc_id", X.clean_text(F.coalesce("text", F.lit(""))).alias("text"))
    title = F.array(X.clean_field(X.title(F.col("text"), F.col("doc_id")), X.MOST_SENTENCE))
    docs = docs.withColumn("sentences", X.usable_sentences(F.col("text")))
    docs = docs.select("doc_id", F.posexplode_outer(F.when(F.size("sentences") > 0, F.col("sentences")).otherwise(title)).alias("position", "sentence"))
    return docs.select("doc_id", "position", *(F.round(c, 6).alias(v) for v, c in X.view_scores(F.col("sentence")).items()))


def clean_fields(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.clean_field(F.col("text"), 400).alias("preview"))


def visible_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.visible(F.col("text")).alias("visible"))


def query_features(spark, d):
    b = _t(spark, d, "benchmark")
    return b.select("item_id", *(F.round(c, 6).alias(k) for k, c in X.query_features(F.col("text")).items()))


def handle_mentions(spark, d):
    c = _t(spark, d, "conversations")
    made = F.concat(F.col("role"), F.lit(" D"), F.col("conv_id"), F.lit(". and D"), F.col("turn"), F.lit("|"), F.col("text"))
    return c.select("conv_id", "turn", F.array_join(X.handles(made), ",").alias("handles"))


def final_texts(spark, d):
    c = _t(spark, d, "conversations")
    made = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("x <FINAL> "), F.substring("text", 1, 40), F.lit(" </FINAL> y"))).otherwise(F.substring("text", 1, 40))
    return c.select("conv_id", "turn", X.final_text(made).alias("final_text"))


def final_texts_whole(spark, d):
    """Whole turns, every second one inside a <FINAL> element."""
    made = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("x <FINAL> "), F.col("text"), F.lit(" </FINAL> y"))).otherwise(F.col("text"))
    return _t(spark, d, "conversations").select("conv_id", "turn", X.final_text(made).alias("final_text"))


def content_hash_ids(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.concat(F.lit("W2"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 24)).alias("docid"))


def secret_scan(spark, d):
    return scan_secrets(_t(spark, d, "documents").select("doc_id", "text"))


def duplicate_texts(spark, d):
    docs = _t(spark, d, "documents").withColumn("raw", F.md5(F.col("text").cast("binary")))
    return occurrence(docs, "raw", "doc_id").select("doc_id", "occurrence", "unique_id")


def postings_stats(spark, d):
    index = lexical.build_index(_t(spark, d, "documents"))
    return index.terms.where("df >= 2")


def document_lengths(spark, d):
    return lexical.build_index(_t(spark, d, "documents")).documents


def _bm25(spark, d):
    b = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), lexical.query_terms(F.col("text")).alias("terms"))
    return lexical.bm25(_t(spark, d, "documents"), b)


def bm25_top10(spark, d):
    return lexical.ranked(_bm25(spark, d), 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def phrase_search(spark, d):
    return lexical.matching(_t(spark, d, "documents"), ["of", "the"], "phrase")


def all_terms_search(spark, d):
    return lexical.matching(_t(spark, d, "documents"), ["the", "and", "with"], "all")


def region_scoped_search(spark, d):
    docs = _t(spark, d, "documents")
    best = lexical.ranked(_bm25(spark, d).join(docs.where("source = 'src1'").select("doc_id"), "doc_id", "left_semi"), 3)
    return best.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def term_filter(spark, d):
    docs = _t(spark, d, "documents")
    found = docs.select("doc_id", F.explode(X.tokens(F.col("text"))).alias("term"))
    return found.groupBy(F.length("term").alias("length")).agg(F.count("*").alias("n"), F.count_distinct("term").alias("n_terms"))


def near_token_pairs(spark, d):
    """Documents with a token Jaccard of at least 0.68; pairs meet by a shared rare token and are told apart by sketches.

    Documents with equal token sets are one class: the least of them meets other classes, and pairs of members are
    made at the end, from ids alone. Tokens are 64-bit hashes, and a class is told by 128 bits of its sorted hashes.
    Sets, prefixes and candidates are written to the shared folder, so texts are cut once; sets are shuffled for candidates only.
    """
    folder = (spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/tessera-shared").rstrip("/") + f"/pairs-{uuid.uuid4().hex}"

    def kept(df, name):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    docs = _t(spark, d, "documents").select("doc_id", F.array_sort(F.transform(X.tokens(F.col("text")), lambda x: F.xxhash64(x))).alias("t"))
    docs = kept(docs.where(F.size("t") > 0).select("doc_id", "t", F.struct(F.xxhash64("t"), F.xxhash64(F.lit(1), "t")).alias("kind")), "sets")
    members = docs.join(docs.groupBy("kind").agg(F.min("doc_id").alias("id")), "kind").where("doc_id is not null").select("id", "doc_id")
    members = kept(members, "members")
    copies = members.where("id <> doc_id").select("doc_id").distinct()
    own = docs.where("doc_id is not null").join(similar.spread(copies, copies.count()), "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "t")
    pairs = kept(similar.candidates(kept(similar.prefixes(own, 68), "prefixes"), kept(similar.sketches(own), "sketches"), 68), "candidates")
    # what is done needn't stand beside the last joins: Spark removes shuffle files once their objects are collected
    for name in ("prefixes", "sketches"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark._jvm.System.gc()

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = docs.join(similar.spread(wanted, wanted.count()), "doc_id", "left_semi").groupBy("kind").agg(F.min("doc_id").alias("id"), F.first("t").alias("t"))
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("t").alias("s")), "a").join(sets.select(F.col("id").alias("b"), "t"), "b")
    both = F.size(F.array_intersect("s", "t"))
    linked = full.withColumn("j", both / (F.size("s") + F.size("t") - both)).where("j >= 0.68").select("a", "b", "j")
    of = lambda e: members.select(F.col("id").alias(e), F.col("doc_id").alias(f"doc_{e}"))
    linked = linked.join(of("a"), "a").join(of("b"), "b").select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"), F.round("j", 6).alias("jaccard"))
    same = of("a").join(of("b"), F.col("a") == F.col("b")).where("doc_a < doc_b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), F.lit(1.0).alias("jaccard"))
    return linked.unionByName(same)


_clean = r"regexp_replace(regexp_replace(regexp_replace(replace({}, chr(0), ' '), '\r\n?|[\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?m)^ | $', '', 'g')"
_field = r"substr(trim(regexp_replace(coalesce({}, ''), '[\s\x00]+', ' ', 'g')), 1, {})"
_tok = TOK.format("text")
_lower = f"list_transform({_tok}, lambda x: lower(x))"
_index = f"""tok AS (SELECT doc_id, unnest({_lower}) AS term FROM documents),
tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT d.doc_id, len({TOK.format('d.text')}) AS dl FROM documents d),
tot AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id AS query_id, unnest(list_filter(list_distinct_ordered, lambda x: length(x) >= 2)[1:10]) AS term FROM (
  SELECT item_id, list_reduce(list_transform({_lower}, lambda x: [x]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_ordered FROM benchmark)),
s AS (SELECT query_id, doc_id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), tot GROUP BY ALL)"""
_ordered = "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, score FROM s"
QUERIES = {
    "canonical_corpus": (canonical_corpus, f"SELECT doc_id::VARCHAR AS docid, regexp_replace({_clean.format('nfkc_text')}, '^\\s+|\\s+$', '', 'g') AS text, '' AS url FROM (SELECT doc_id, text AS nfkc_text FROM documents)"),
    "titles": (titles, f"""WITH c AS (SELECT doc_id, regexp_replace({_clean.format('text')}, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
p AS (SELECT doc_id, {_field.format("regexp_extract(substr(t, 1, 4096), '(?im)^title:[[:space:]]*(.+?)[[:space:]]*$', 1)", 512)} AS named,
list_filter(list_transform(string_split(t, chr(10))[1:20], lambda x: {_field.format("regexp_replace(x, '^[#\\- ]+', '')", 512)}), lambda x: x <> '' AND NOT starts_with(x, '---')) AS l FROM c)
SELECT doc_id, coalesce(nullif(named, ''), l[1], 'Document ' || doc_id) AS title FROM p"""),
    "domain_counts": (domain_counts, r"SELECT lower(coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), ''), 'unknown-domain')) AS domain, count(*) AS n FROM pages GROUP BY 1"),
    "token_sets": (token_sets, f"""WITH o AS (SELECT doc_id, unnest({_lower}) AS t, generate_subscripts({_lower}, 1) AS i FROM documents),
f AS (SELECT doc_id, t, min(i) AS i FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f)
SELECT d.doc_id, count(r.t)::INT AS n_tokens, coalesce(string_agg(r.t, ' ' ORDER BY r.k) FILTER (r.k <= 5), '') AS first_tokens FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id"""),
    "sentence_stats": (sentence_stats, r"""WITH l AS (SELECT doc_id, text, regexp_split_to_array(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(10), 'g'), '\n+') AS a FROM documents),
s AS (SELECT doc_id, substr(trim(regexp_replace(unnest(a), '[\s\x00]+', ' ', 'g')), 1, 720) AS s, generate_subscripts(a, 1) AS i FROM l),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id, lower(s) ORDER BY i) AS n FROM s WHERE length(s) >= 18),
c AS (SELECT doc_id, count(*) AS n, sum(length(s)) AS chars FROM k WHERE n = 1 GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE 1 END)::INT AS n_sentences,
coalesce(c.chars, length(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 720)))::INT AS chars FROM documents d LEFT JOIN c USING (doc_id)"""),
    "view_scores": (view_scores, None),
    "clean_fields": (clean_fields, f"SELECT doc_id, {_field.format('text', 400)} AS preview FROM documents"),
    "visible_text": (visible_text, r"""SELECT doc_id, trim(regexp_replace(translate(lower(regexp_replace(regexp_replace(text, '(?m)^[ \t]*\d{1,8}[ \t]*[\t|:][ \t]*', '', 'g'), '(?m)^[ \t]*=+[ \t]*D[^:\n]+:[ \t]*', '', 'g')), '“”‘’–—', '""''''--'), '\s+', ' ', 'g')) AS visible FROM documents"""),
    "query_features": (query_features, None),
    "handle_mentions": (handle_mentions, r"""WITH m AS (SELECT conv_id, turn, role || ' D' || conv_id || '. and D' || turn || '|' || text AS x FROM conversations),
e AS (SELECT conv_id, turn, regexp_extract_all(x, '(?:^|[^A-Za-z0-9_])D([^\s\t|:;,\]\[()]+)', 1) AS h FROM m),
u AS (SELECT conv_id, turn, regexp_replace(unnest(h), '\.+$', '') AS h, generate_subscripts(h, 1) AS i FROM e),
f AS (SELECT conv_id, turn, h, min(i) AS i FROM u GROUP BY ALL) SELECT conv_id, turn, string_agg(h, ',' ORDER BY i) AS handles FROM f GROUP BY ALL"""),
    "final_texts": (final_texts, r"SELECT conv_id, turn, trim(substr(text, 1, 40)) AS final_text FROM conversations"),
    "final_texts_whole": (final_texts_whole, r"WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'x <FINAL> ' || text || ' </FINAL> y' ELSE text END AS t FROM conversations) SELECT conv_id, turn, trim(CASE WHEN regexp_matches(t, '(?is)<FINAL>.*?</FINAL>') THEN regexp_extract(t, '(?is)<FINAL>(.*?)</FINAL>', 1) ELSE t END) AS final_text FROM m"),
    "content_hash_ids": (content_hash_ids, "SELECT doc_id, 'W2' || substr(sha256(text), 1, 24) AS docid FROM documents"),
    "secret_scan": (secret_scan, r"""SELECT * FROM (
SELECT doc_id, 'underscore_api_key' AS pattern, len(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])sk_[A-Za-z0-9]{32,}\b'))::INT AS hits FROM documents UNION ALL
SELECT doc_id, 'dash_api_key', len(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])sk-[A-Za-z0-9][A-Za-z0-9._-]{31,}\b'))::INT FROM documents UNION ALL
SELECT doc_id, 'github_token', len(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])ghp_[A-Za-z0-9]{32,}\b'))::INT FROM documents) WHERE hits > 0"""),
    "duplicate_texts": (duplicate_texts, "SELECT doc_id, n::INT AS occurrence, md5(text) || CASE WHEN n = 1 THEN '' ELSE '__dup' || n END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents)"),
    "postings_stats": (postings_stats, f"WITH {_index.split('dl AS')[0].rstrip().rstrip(',')} SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2"),
    "document_lengths": (document_lengths, f"SELECT doc_id, len({_tok})::BIGINT AS dl FROM documents"),
    "bm25_top10": (bm25_top10, f"WITH {_index} SELECT query_id, doc_id, rank::INT AS rank, round(score, 6) AS score FROM ({_ordered}) WHERE rank <= 10"),
    "phrase_search": (phrase_search, f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_lower}, ' ') || ' ', ' of the ')"),
    "all_terms_search": (all_terms_search, f"SELECT doc_id FROM documents WHERE list_has_all({_lower}, ['the', 'and', 'with'])"),
    "region_scoped_search": (region_scoped_search, f"WITH {_index}, r AS (SELECT s.* FROM s JOIN documents USING (doc_id) WHERE source = 'src1') SELECT query_id, doc_id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r) WHERE rank <= 3"),
    "term_filter": (term_filter, f"WITH t AS (SELECT doc_id, unnest(list_distinct({_lower})) AS term FROM documents) SELECT length(term)::INT AS length, count(*) AS n, count(DISTINCT term) AS n_terms FROM t GROUP BY 1"),
    "near_token_pairs": (near_token_pairs, f"""WITH t AS (SELECT doc_id, unnest(list_distinct({_lower})) AS term FROM documents), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM t x JOIN t y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, round(c / (na.n + nb.n - c), 6) AS jaccard FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c / (na.n + nb.n - c) >= 0.68"""),
}
