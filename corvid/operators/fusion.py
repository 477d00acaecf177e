"""Fusion of ranked lists, and diversity re-ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .batches import bounded_batches, give_back
from .dense import _matrix, normalized
from .ranking import top_k


def _stacked(lists: Sequence[DataFrame], weights: Sequence[float] | None) -> DataFrame:
    if not lists:
        raise ValueError("fusion needs a list at least")
    weights = list(weights or [1.0] * len(lists))
    if len(weights) != len(lists):
        raise ValueError(f"{len(weights)} weights for {len(lists)} lists")
    cols = ["query_id", "chunk_id", "score", "rank", "source"]
    rows = [d.select(*cols).withColumn("list", F.lit(i)).withColumn("weight", F.lit(float(w))) for i, (d, w) in enumerate(zip(lists, weights))]
    return reduce(DataFrame.unionByName, rows)


def _fuse(rows: DataFrame, part: Column, k: int, source: str) -> DataFrame:
    """Sums the parts per chunk. components holds each list's own score; ties go
    to the list named first, then to the rank there."""
    one = rows.groupBy("query_id", "chunk_id").agg(
        F.sum(part).alias("score"),
        F.min(F.struct("list", "rank")).alias("first"),
        F.array_sort(F.collect_list(F.struct("list", "source", F.col("score").alias("own")))).alias("parts"),
    )
    last_wins = F.aggregate(
        "parts", F.create_map().cast("map<string,double>"),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k_, v: k_ != p["source"]), F.create_map(p["source"], p["own"])),
    )
    one = one.withColumn("components", last_wins).drop("parts")
    ranked = top_k(one, k, F.col("first.list"), F.col("first.rank"), F.col("chunk_id"))
    return ranked.select("query_id", "chunk_id", "score", "rank", F.lit(source).alias("source"), "components")


def rrf(lists: Sequence[DataFrame], k: int, weights: Sequence[float] | None = None, smoothing: float = 60) -> DataFrame:
    """Reciprocal-rank fusion: sum of weight / (smoothing + rank)."""
    rows = _stacked(lists, weights)
    return _fuse(rows, F.col("weight") / (smoothing + F.greatest("rank", F.lit(1))), k, "rrf")


def min_max(rows: DataFrame, *by: str) -> DataFrame:
    """Adds "scaled": scores of each list from 0 to 1; 1 if they don't differ."""
    w = Window.partitionBy(*by)
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    return rows.withColumn("scaled", F.when(span < 1e-12, 1.0).otherwise((F.col("score") - low) / F.when(span < 1e-12, 1.0).otherwise(span)))


def weighted(lists: Sequence[DataFrame], k: int, weights: Sequence[float] | None = None) -> DataFrame:
    """Sum of weight times min-max scaled score."""
    rows = min_max(_stacked(lists, weights), "query_id", "list")
    return _fuse(rows, F.col("weight") * F.col("scaled"), k, "weighted")


def contributions(fused: DataFrame) -> DataFrame:
    """Per query and chunk, which sources found it, sorted."""
    return fused.select("query_id", "chunk_id", F.array_join(F.array_sort(F.map_keys("components")), ",").alias("sources"))


def mmr(candidates: DataFrame, k: int, trade: float = 0.7) -> DataFrame:
    """Maximal marginal relevance within each query's candidates.

    candidates: query_id, chunk_id, rank, score, vec, qvec (unit vectors). The
    first pick is the most relevant, each next one has the greatest trade *
    relevance - (1 - trade) * similarity to the picks. Relevance is the cosine
    to the query and is the score given back. Ties go to the better rank. A
    query holds as many candidates as were fetched for it, a multiple of k.
    """
    if not 0 <= trade <= 1:
        raise ValueError(f"the trade-off must be from 0 to 1, not {trade}")
    q, c = (candidates.schema[n].dataType.simpleString() for n in ("query_id", "chunk_id"))
    bounded_batches(candidates.sparkSession)
    rows = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "vec"))).alias("rows")
    pools = candidates.groupBy("query_id").agg(rows, F.first("qvec").alias("qvec"))
    return pools.mapInArrow(lambda it: _diverse(it, k, trade), f"query_id {q}, chunk_id {c}, score double, rank int").withColumn("source", F.lit("mmr"))


def _diverse(rows: Iterator[pa.RecordBatch], k: int, trade: float) -> Iterator[pa.RecordBatch]:
    """mmr of many queries at once: those with as many candidates share the steps."""
    for batch in rows:
        size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for n in np.unique(size).tolist():
            own = pa.array(np.flatnonzero(size == n))
            ids, pool = batch.column(0).take(own), batch.column(1).take(own).flatten()
            if n <= 1:
                picks, score = np.zeros((len(ids), min(n, k)), np.int64), pool.field("score").to_numpy(zero_copy_only=False)[:, None][:, : min(n, k)]
            else:
                m = normalized(_matrix(pool.field("vec"))).reshape(len(ids), n, -1)
                rel = np.einsum("gnd,gd->gn", m, normalized(_matrix(batch.column(2).take(own))))
                alike = m @ m.transpose(0, 2, 1)
                each = np.arange(len(ids))
                near, free, picks = np.full(rel.shape, -np.inf), np.ones(rel.shape, bool), np.zeros((len(ids), min(k, n)), np.int64)
                for step in range(min(k, n)):
                    value = trade * rel - (1 - trade) * near if step else rel
                    picks[:, step] = best = np.argmax(np.where(free, np.round(value, 9), -np.inf), axis=1)
                    free[each, best] = False
                    near = np.maximum(near, alike[each, best])
                score = np.take_along_axis(rel, picks, 1)
            flat = pa.array((picks + np.arange(len(ids))[:, None] * n).ravel())
            steps = np.tile(np.arange(1, picks.shape[1] + 1, dtype=np.int32), len(ids))
            yield pa.record_batch({
                "query_id": ids.take(pa.array(np.repeat(np.arange(len(ids)), picks.shape[1]))), "chunk_id": pool.field("chunk_id").take(flat),
                "score": pa.array(score.ravel().astype(np.float64)), "rank": pa.array(steps),
            })
    give_back()


def rescore(candidates: DataFrame, k: int, scorer, batch: int = 32) -> DataFrame:
    """Re-ranks (query_id, query, chunk_id, text, score) by scorer(list of
    (query, text) pairs) -> numbers, such as a cross-encoder's predict; the
    first score is kept in components as first_stage."""

    @pandas_udf("double")
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        pairs = list(zip(query, text))
        return pd.Series([float(x) for i in range(0, len(pairs), batch) for x in scorer(pairs[i : i + batch])])

    scored = candidates.withColumn("components", F.create_map(F.lit("first_stage"), F.col("score"))).withColumn("score", run("query", "text"))
    return top_k(scored, k).select("query_id", "chunk_id", "score", "rank", F.lit("cross-encoder").alias("source"), "components")
