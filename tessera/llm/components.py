"""Connected components of a link table; at most a bounded number of links is brought to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.workspace import Workspace

#: Labels are spread this many times, so that a node with a third of all links is no one task's work.
SALT = 8
#: Links of long ends up to this number are followed on the driver, in one step; more of them in rounds, with the same result.
FEW_LINKS = 200_000


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), and for each the least node that can be reached."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, before = np.minimum(label[a], label[b]), label.copy()
        # a node's label takes it along, so that a chain's halves meet by their labels
        for end in (a, b, before[a], before[b]):
            np.minimum.at(label, end, low)
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def components(links: DataFrame, space: Workspace) -> DataFrame:
    """(node, comp) of every node in links (a, b): comp is the least node that can be reached.

    Each round takes the least label among a node's neighbours, then follows the label's own
    label (pointer jumping), so that long chains need a logarithmic number of rounds. Null ends
    are ignored; no links give an empty table.
    """
    once = links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    once = space.save(once, "links")
    if once.dtypes == [("a", "bigint"), ("b", "bigint")] and once.count() <= FEW_LINKS:
        few = once.toArrow()
        found = labels(few["a"].to_numpy(), few["b"].to_numpy())
        found = space.spark.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in found], ["node", "comp"]))
        return space.save(found, "labels")
    once = space.save(once.distinct(), "distinct-links")
    both = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = space.save(both.withColumn("salt", F.abs(F.xxhash64("a") % SALT).cast("int")), "edges")
    label = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    label = space.save(label.withColumn("old", F.col("comp")), "labels")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    while True:
        spread = label.select(F.col("node").alias("b"), "comp").withColumn("salt", salts)
        least = edges.join(spread, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = label.join(least, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = step.select(F.col("node").alias("comp"), F.col("comp").alias("far")).where("comp <> far").withColumn("salt", salts)
        step = step.withColumn("salt", F.abs(F.xxhash64("node") % SALT).cast("int"))
        step = step.join(up, ["comp", "salt"], "left").select("node", F.coalesce("far", "comp").alias("comp"), "old")
        new = space.save(step, "labels")
        changed = not new.where("comp <> old").isEmpty()
        space.drop(label)
        label = new
        if not changed:
            return label.select("node", "comp")
