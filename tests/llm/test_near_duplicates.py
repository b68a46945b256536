import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tessera.llm import minhash_dedup, neardup, substring_dedup
from tessera.llm.components import components
from tessera.llm.words import distinct_sets, shingle_hashes, word_hashes
from tessera.llm.workspace import METHOD_SETTING, Workspace


def sets(texts):
    out = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(texts):
    s, up = sets(texts), {i: i for i, _ in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(s)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= 75 * (len(s[i]) + len(s[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s[i]), root(i)) for i in ids}


def test_dedup_equals_brute_force_on_chains_of_edits(spark):
    r, texts = random.Random(5), []
    for group in range(6):
        words = prose(group, 90).split(" ")
        for k in range(25):
            if k % 3 == 0:
                words = words[:]
                for _ in range(2):
                    words[r.randrange(len(words))] = r.choice(["zulu", "yankee", "xray"]) + str(r.randrange(99))
            texts.append((group * 100 + k, " ".join(words)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute(texts)


def test_dedup_of_odd_rows(spark, odd, empty):
    rows = minhash_dedup.dedup(odd).collect()
    assert len(rows) == odd.count()
    assert {x.component_id for x in rows if x.doc_id in (1, 2, 3)} == {1}
    assert all(x.component_id == x.doc_id and x.kept and x.n_shingles == 0 for x in rows if x.doc_id in (4, 5, 6))
    assert sorted(x.component_id for x in rows if x.doc_id is None and x.n_shingles) == [1]
    assert minhash_dedup.dedup(empty).count() == 0
    kept = minhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns and {x.doc_id for x in kept.collect()} >= {1, 4, 5, 6, 7, 8, 9, 10} and 2 not in {x.doc_id for x in kept.collect()}


def test_registers_estimate_and_parity_bound():
    r = np.random.default_rng(3)
    common, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (300, 50, 50))
    x, y = np.sort(np.concatenate([common, a])), np.sort(np.concatenate([common, b]))
    n = np.array([350, 350])
    regs = neardup.registers(np.concatenate([x, y]), n, 128)
    assert abs((regs[0] == regs[1]).mean() - 300 / 400) < 0.16
    p = neardup.parities(np.concatenate([x, y]), n, 2048)
    assert sum(bin(int(v) & (2**64 - 1)).count("1") for v in p[0] ^ p[1]) <= 100
    assert regs.max() < 2**15


@given(st.lists(st.text(alphabet="ab \n\tcD", max_size=60), max_size=6))
@settings(max_examples=60, deadline=None)
def test_shingle_sets_equal_python_sets(texts):
    flat, n = distinct_sets(*shingle_hashes(*word_hashes(texts)))
    assert [len(s) for s in sets(enumerate(texts)).values()] == n.tolist()


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t")).collect()))
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 160)} == {100}
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def test_passages_wherever_they_stand(spark, odd, empty):
    passage = " ".join(prose(77, 72).split("\n"))
    texts = [(k, prose(200 + k, 150) + (" " if k % 2 else "\n") + passage + (" " + prose(300 + k, 30) if k % 3 else "")) for k in range(8)]
    clean = [(100 + k, prose(500 + k, 200)) for k in range(8)]
    rows = substring_dedup.passages(spark.createDataFrame(texts + clean, "doc_id long, text string")).collect()
    assert {x.doc_id for x in rows} == set(range(8))
    whole = dict(texts)
    for x in rows:
        found = whole[x.doc_id][x.start : x.end]
        assert len(set(found.split()) & set(passage.split())) > 20 and x.first_doc_id == 0
    assert Counter(x.n_removed > 0 for x in rows) == {True: 7, False: 1}
    ids = {x.doc_id for x in substring_dedup.passages(odd).collect()}
    assert {1, 2, 3} <= ids and not ids & {4, 5, 6, 7, 9, 10}
    assert substring_dedup.passages(empty).count() == 0


def test_paragraphs_cover_the_text():
    for text in ("", "a", "One. Two.\n\nThree! ", prose(9, 300), "x" * 5000, "...", "Ünïcödé wörds. " * 9):
        raw = text.encode()
        spans, words = substring_dedup.cut(raw)
        assert b"".join(raw[a:b] for a, b in spans) == raw
        assert [w for ws in words for w in ws] == raw.lower().split()
        at = substring_dedup._characters(raw, np.array(spans, np.int64).reshape(-1, 2))
        assert "".join(text[a:b] for a, b in at.tolist()) == text


def brute_passages(texts, percent=75):
    """Clusters of paragraphs by comparing all of them, then runs of those that have a partner."""
    rows = [(d, k, len(w), {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}) for d, t in texts for k, w in enumerate(substring_dedup.cut((t or "").encode())[1]) if w]
    shared = {}
    for i, row in enumerate(rows):
        for s in row[3]:
            shared.setdefault(s, []).append(i)
    both = Counter((i, j) for at in shared.values() for i in at for j in at if i < j)
    paired = {x for (i, j), n in both.items() if 100 * n >= percent * (len(rows[i][3]) + len(rows[j][3]) - n) for x in (i, j)}
    out, run = [], []
    for i in sorted(paired):
        if run and (rows[run[-1]][0] != rows[i][0] or rows[run[-1]][1] + 1 != rows[i][1]):
            out.append(run)
            run = []
        run.append(i)
    return Counter((rows[r[0]][0], sum(rows[i][2] for i in r), len(r)) for r in [*out, run] if r and sum(rows[i][2] for i in r) >= 25)


def test_passages_equal_brute_force(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    texts = [(x.doc_id, x.text) for x in spark.read.parquet(path).select("doc_id", "text").collect()]
    want = brute_passages(texts)
    got = Counter((x.doc_id, x.n_words, x.n_paragraphs) for x in substring_dedup.passages(spark.read.parquet(path)).collect())
    assert (got & want).total() >= 0.98 * want.total() and (got - want).total() <= 0.02 * want.total()


def test_large_buckets_are_refined(spark, monkeypatch):
    """Nodes that share one band by chance, in groups that link only inside, get the same groups as all pairs."""
    monkeypatch.setattr(neardup, "FEW", 1)
    monkeypatch.setattr(neardup, "DEAL", 3)
    monkeypatch.setattr("tessera.llm.joins.LEAST_HOT", 3)
    r, texts = random.Random(8), []
    common = prose(99, 60).replace("\n", " ")
    for group in range(5):
        own = prose(group, 80).split(" ")
        for k in range(8):
            words = own[:]
            words[r.randrange(len(words))] = f"zulu{k}"
            texts.append((group * 100 + k, common + " " + " ".join(words)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute(texts)


def test_one_row_of_each_group_stays(spark):
    """Rows are told apart by doc_id and text."""
    t, other = prose(11, 80), prose(12, 80)
    rows = [(5, t), (5, t), (6, other), (6, t), (7, None), (7, None), (None, other)]
    kept = minhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.text == t) for x in kept if x.text) == [(5, True), (6, False)] and len(kept) == 4


def test_more_keys_than_a_filter_holds_give_the_same_rows(spark):
    from tessera.llm.joins import marked

    rows = spark.range(1000)
    keys = spark.range(0, 1000, 7).select(F.xxhash64("id").alias("h"))
    few = {x.id for x in marked(rows, F.col("id"), keys).where("passed").collect()}
    assert set(range(0, 1000, 7)) <= few and len(few) < 200
    assert marked(rows, F.col("id"), keys, most=10).where("passed").count() == 1000


def test_few_links_are_followed_in_one_step_and_many_in_rounds_alike(spark, monkeypatch):
    saved, write = [], Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name: saved.append((name, self.spark.conf.get(METHOD_SETTING))) or write(self, df, name))
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 999 + k) for k in range(1, 60)]
    table = spark.createDataFrame(links, "a long, b long")
    got = {tuple(x) for x in components(table, Workspace(spark, "t")).collect()}
    assert [name for name, _ in saved] == ["links", "labels"]
    monkeypatch.setattr("tessera.llm.components.FEW_LINKS", 0)
    assert got == {tuple(x) for x in components(table, Workspace(spark, "t")).collect()} and len(got) > 250


def test_sketches_are_compared_in_methods_that_get_compiled(spark, monkeypatch):
    limits, write, before = [], Workspace.write, spark.conf.get(METHOD_SETTING)

    def noted(self, df, name):
        put = type(spark.conf).set
        with monkeypatch.context() as m:
            m.setattr(type(spark.conf), "set", lambda conf, k, v: (limits.append((name, v)) if k == METHOD_SETTING and v != before else None, put(conf, k, v))[1])
            return write(self, df, name)

    monkeypatch.setattr(Workspace, "write", noted)
    texts = [(k, prose(k // 2, 60) + " more" * (k % 2)) for k in range(12)]
    rows = minhash_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in rows} == {k: k - k % 2 for k in range(12)}
    assert ("screened", "8000") in limits and spark.conf.get(METHOD_SETTING) == before
