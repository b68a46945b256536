"""Sharding by a permutation-filled lookup table (operator 9).

Every shard prefers the slots of a prime-sized table in an order of its own, (offset + k * skip)
modulo the prime. Shards take turns, each claiming its first free slot, until the table is full.
A row's key is hashed to a slot, and the table, whose size is fixed, is broadcast.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARDS = 64
SLOTS = 65_537


def _number(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's place in the list for each slot. slots must be a prime of at least the number of shards."""
    if not shards or slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("there must be shards, and a prime number of slots, no fewer than shards")
    offset = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, at, free = [-1] * slots, offset[:], slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key's text; a null key is hashed as an empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def shard(rows: DataFrame, key: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """rows with slot and shard; all rows of one key are in one shard, and a hot source is spread by its keys.

    Columns of rows that have one of these names are replaced.
    """
    table = lookup_table([f"shard-{i}" for i in range(shards)], slots)
    places = rows.sparkSession.createDataFrame(list(enumerate(table)), "slot int, shard int").coalesce(1)
    rows = rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return rows.join(F.broadcast(places), "slot").select(*[c for c in rows.columns if c != "slot"], "slot", "shard")


def write_shards(rows: DataFrame, key: str, folder: str, shards: int = SHARDS, slots: int = SLOTS) -> None:
    """Write rows with their slots into one folder for each shard.

    Rows meet by shard, and shards that are large are split again into files of the session's
    advisory size, so no task writes more than that, however many rows there are.
    """
    placed = shard(rows, key, shards, slots)
    dealt = rows.sparkSession.sql("SELECT /*+ REBALANCE(shard) */ * FROM {placed}", placed=placed)
    dealt.write.partitionBy("shard").parquet(folder)


def read_shards(rows: DataFrame, folder: str) -> DataFrame:
    """What write_shards wrote of rows: their columns, slot and shard. One shard's folder is read by filtering on shard."""
    schema = T.StructType([f for f in rows.schema if f.name not in ("slot", "shard")])
    schema = schema.add("slot", T.IntegerType()).add("shard", T.IntegerType())
    return rows.sparkSession.read.schema(schema).parquet(folder)


def oracle(rows: str, key: str, shards: int = SHARDS, slots: int = SLOTS) -> str:
    """The same placement in SQL, with the lookup table as a list."""
    table = ", ".join(map(str, lookup_table([f"shard-{i}" for i in range(shards)], slots)))
    return f"""
WITH t AS MATERIALIZED (SELECT unnest([{table}]) AS shard, unnest(range({slots})) AS slot),
r AS (SELECT *, (('0x' || substr(md5(coalesce({key}::VARCHAR, '')), 1, 15))::BIGINT % {slots})::INT AS slot FROM ({rows}))
SELECT r.*, t.shard::INT AS shard FROM r JOIN t ON r.slot = t.slot
"""
