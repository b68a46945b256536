"""Token-id files by an adaptive context-mixing range coder (operator 10).

A file set is a Parquet table of segments. A segment is a run of documents in ascending doc_id
order, with its documents' ids, and a blob of codec.py whose blocks are coded, reset and checked
independently. Blobs are made and read in the JVM by TokenCoder.java, which gives codec.py's bytes. Segments are written by Spark's committer, so a lost executor's part is written
again, and any folder that Spark reaches will do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import codec, compiled
from tessera.llm.tokens import encoder
from tessera.llm.words import parts

#: Bytes of text that are looked up at once.
PART = 16 << 20
#: Ids of a segment, about.
SEGMENT_IDS = 3072 * codec.BLOCK


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> None:
    """Write the ids of docs (doc_id, text), each with its end id, by the vocabulary file path.

    Documents are in ascending doc_id order, null ids first, equal ids by their texts; a null or
    empty text has its end id alone. Other columns are ignored; an empty table gives no segments.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        column = encoder(path, words=False).column
        task = TaskContext.get().partitionId()
        ids, counts, owners, held, number = [], [], [], 0, 0

        def segment():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([task], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()),
                    pa.array([sum(owners, [])], pa.list_(batch.schema.field("doc_id").type)),
                    pa.array([np.concatenate(counts).astype("<u4").tobytes()], pa.binary()), pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                ],
                names=["part", "segment", "n_ids", "doc_ids", "counts", "ids"],
            )

        for batch in batches:
            for some in parts(batch, PART):
                new, n = column(pc.cast(some.column("text"), pa.string()))
                if max(end_id, int(new.max(initial=0))) >= 1 << 16:
                    raise ValueError("ids must be below 65536")
                ids.append(np.insert(new.astype("<u2"), np.cumsum(n), end_id))
                counts.append(n + 1)
                owners.append(some.column("doc_id").to_pylist())
                held += len(ids[-1])
                if held >= SEGMENT_IDS:
                    yield segment()
                    ids, counts, owners, held, number = [], [], [], 0, number + 1
        if ids:
            yield segment()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = ordered.mapInArrow(run, f"part int, segment int, n_ids long, doc_ids array<{kind}>, counts binary, ids binary")
    data = compiled.call(docs.sparkSession, "tessera_encode_ids", "counts", "ids")
    found.select("part", "segment", "n_ids", "doc_ids", data.alias("data")).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document of a file set; start: ids of all documents before it."""
    segments = spark.read.parquet(folder)
    # one row per part, then the segments of one part: neither grows with a task's input
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    totals = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    places = segments.select("part", "segment", "n_ids").withColumn("within", within).join(F.broadcast(totals), "part")
    places = places.select("part", "segment", (F.col("before") + F.col("within")).alias("base"))

    # a row per segment, which holds millions of ids
    found = segments.join(F.broadcast(places), ["part", "segment"])
    found = found.select("base", "doc_ids", compiled.call(spark, "tessera_decode_ids", "data").alias("documents"))
    found = found.select("base", F.explode(F.arrays_zip("doc_ids", "documents")).alias("x"))
    ids = F.col("x.documents.ids")
    return found.select(F.col("x.doc_ids").alias("doc_id"), (F.col("base") + F.col("x.documents.within")).alias("start"), F.expr("octet_length(x.documents.ids) div 4").alias("n_tokens"), ids)
