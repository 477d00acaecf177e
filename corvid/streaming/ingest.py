"""Incremental ingest: a stream of documents becomes chunks and vectors, upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import Chunker
from ..operators.dense import upsert
from ..operators.hashing import HashingEmbedder
from ..sources import files


def merge_batch(batch: DataFrame, path: str, chunker: Chunker, embedder: HashingEmbedder) -> None:
    """Lays a batch's chunks over the table at path: chunks of its documents that
    were there before go, so a changed document leaves no stale ones. The new
    table is a version of its own, and a pointer file names the current one, so
    a batch that runs twice gives the same table."""
    spark = batch.sparkSession
    chunks = chunker.split(batch)
    rows = chunks.join(embedder.encode(chunks), "chunk_id")
    old = current(spark, path)
    if old is not None:
        rows = upsert(old.join(batch.select("doc_id").distinct(), "doc_id", "left_anti"), rows.select(old.columns))
    at = int(files.read_text(spark, f"{path}/CURRENT") or -1) + 1
    rows.write.mode("overwrite").parquet(f"{path}/v{at}")
    files.write_text(spark, f"{path}/CURRENT", str(at))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    at = files.read_text(spark, f"{path}/CURRENT")
    return None if at is None else spark.read.parquet(f"{path}/v{at}")


def start_ingest(docs: DataFrame, path: str, checkpoint: str, chunker: Chunker, embedder: HashingEmbedder) -> StreamingQuery:
    """docs: a streaming DataFrame (doc_id, text, optionally metadata)."""
    files.make_dir(docs.sparkSession, path)
    writer = docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda b, _: merge_batch(b.where(F.col("doc_id").isNotNull()), path, chunker, embedder)).start()
