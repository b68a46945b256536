import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import neardup
from tessera.llm.substring_dedup import PARAGRAPH
from tessera.llm.workspace import Workspace


def test_pairs_of_a_large_bucket_that_share_no_other_band(spark, monkeypatch):
    """All nodes have one band in common and half of their shingles; only neighbours reach the threshold, and no other band tells."""
    monkeypatch.setattr(neardup, "FEW", 3)
    monkeypatch.setattr(neardup, "DEAL", 5)
    r = np.random.default_rng(4)
    draw = lambda n: r.integers(0, 2**63, n).astype(np.uint64)
    common, sets = draw(20), []
    for k in range(12):
        own = draw(14)
        sets += [np.sort(np.concatenate([common, own, draw(k % 6)])) for _ in range(2)]
    n = np.array([len(s) for s in sets])
    parity = neardup.parities(np.concatenate(sets), n, PARAGRAPH.parity)
    rows = [(k, xxhash.xxh128_digest(s.tobytes()), k, k, 1, len(s), [7, *(100 * k + j for j in range(5))], parity[k].tolist()) for k, s in enumerate(sets)]
    space = Workspace(spark, "t")
    nodes = space.save(spark.createDataFrame(rows, "id long, node binary, key long, last long, size long, n int, sketch array<long>, parity array<long>"), "nodes")
    held = spark.createDataFrame([(k, s.view(np.int64).tolist()) for k, s in enumerate(sets)], "id long, shingles array<long>")
    linker = neardup.Linker(nodes, lambda wanted: held.join(wanted.select("id"), "id"), space, 75, PARAGRAPH)
    got = dict(map(tuple, linker.run().collect()))
    likely = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    want = {x: k for k in range(0, 24, 2) for x in (k, k + 1) if likely(sets[k], sets[k + 1])}
    assert len(want) > 12 and not any(likely(sets[a], sets[b]) for a in range(24) for b in range(a) if a // 2 != b // 2)
    assert got == want
