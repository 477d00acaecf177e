"""Ranked lists: rows (query_id, chunk_id, doc_id, score, rank, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


RULE = "---".join(("\n\n", "\n\n"))  # a line between texts


def top_k(scored: DataFrame, k: int, *ties: Column | str, by: str = "query_id") -> DataFrame:
    """The k best rows per query, ranked from 1. Scores equal to 9 digits are
    ties, settled by `ties` ascending, so results don't hang on float noise.
    The filter on a row number lets Spark cut to k rows per query before the
    shuffle and after."""
    w = Window.partitionBy(by).orderBy(F.round("score", 9).desc(), *(ties or ("chunk_id",)))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_and_tag(scored: DataFrame, source: str, k: int) -> DataFrame:
    return top_k(scored, k).withColumn("source", F.lit(source))


def as_context(hits: DataFrame, k=None, separator=RULE) -> DataFrame:
    """Per query the texts of its best hits, in order, as one string."""
    best = hits if k is None else hits.where(F.col("rank") <= k)
    rows = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return best.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), separator).alias("context"))
