"""Joins that no hot key holds up, and filters of hashed keys that are sized by the keys they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group is hot if it has more than this part of all rows; so there are never more hot groups than this, and they are broadcast.
HOT_GROUPS = 10_000
#: Smaller groups are never hot.
LEAST_HOT = 1_000
#: Up to so many groups are all broadcast.
FEW_GROUPS = 1 << 16
#: Bits of a filter for each key, and the most keys that a filter holds: at most 512 Ki words of 64 bits are broadcast.
BITS_A_KEY, MOST_KEYS = 16, 1 << 21


def by_size(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with groups, which has one row for each key and size, the number of rows with it; size is left out.

    Where groups are few, they are broadcast and all rows stay where they are. Of more groups this holds for the
    hot ones only; no other key has more than a ten-thousandth of all rows, or a thousand. how is inner or left; a null key has no group.
    groups is read several times and should be a saved table.
    """
    found = groups.agg(F.sum("size").alias("total"), F.max("size").alias("most"), F.count("*").alias("groups")).first()
    if found["groups"] <= FEW_GROUPS:
        return rows.join(F.broadcast(groups.drop("size")), key, how)
    limit = max(LEAST_HOT, (found["total"] or 0) // HOT_GROUPS)
    if (found["most"] or 0) <= limit and how == "inner":
        return rows.join(groups.drop("size").hint("merge"), key)
    hot = groups.where(F.col("size") > limit)
    cold = groups.where(F.col("size") <= limit).drop("size")
    known = rows.where(F.col(key).isNotNull())
    few = known.join(F.broadcast(hot.drop("size")), key)
    # a filter by the few hot keys themselves: no second broadcast, and no join that every row goes through
    keys = [row[0] for row in hot.select(key).collect()]
    rest = known.where(~F.col(key).isin(keys)) if keys else known
    out = few.unionByName(rest.join(cold.hint("merge"), key, how))
    if how == "left":
        added = [F.lit(None).cast(f.dataType).alias(f.name) for f in groups.schema if f.name not in (key, "size")]
        out = out.unionByName(rows.where(F.col(key).isNull()).select("*", *added))
    return out


def marked(rows: DataFrame, key: Column, keys: DataFrame, most: int = MOST_KEYS, repeats: bool = False) -> DataFrame:
    """rows with passed: false only where xxhash64(key) isn't one of the hashes in keys, a saved table (h); repeats tells that it has some of them often.

    A filter of 16 bits for each key is broadcast. Where there are more keys than a filter holds,
    every row passes, and the join that follows deals out all of them.
    """
    n = (keys.distinct() if repeats else keys).count()
    if n > most:
        return rows.withColumn("passed", F.lit(True))
    bits = max(1 << 16, 1 << (BITS_A_KEY * n - 1).bit_length())
    words = keys.select(F.pmod("h", F.lit(bits)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("_bits")
    )
    rows = rows.withColumn("_bit", F.pmod(F.xxhash64(key), F.lit(bits))).withColumn("_word", F.shiftright("_bit", 6))
    passed = F.coalesce(F.expr("getbit(_bits, cast(_bit & 63 as int)) = 1"), F.lit(False))
    return rows.join(F.broadcast(words), "_word", "left").withColumn("passed", passed).drop("_word", "_bits", "_bit")
