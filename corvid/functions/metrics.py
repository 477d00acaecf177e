"""Retrieval metrics over ranked lists, for all queries and cut-offs at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def judgements(queries: DataFrame) -> DataFrame:
    """(query_id, item_id, grade, relevant) from relevant_doc_ids and grades.

    An item is relevant if listed or graded above 0; its grade is the given one,
    be it 0, else 1 if listed."""
    listed = F.coalesce("relevant_doc_ids", F.array().cast("array<string>"))
    graded = F.coalesce("grades", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    items = F.array_union(listed, F.map_keys(graded))
    rows = queries.select("query_id", F.explode(items).alias("item_id"), listed.alias("l"), graded.alias("g"))
    own = F.try_element_at("g", F.col("item_id"))
    inside = F.array_contains("l", F.col("item_id"))
    grade = F.coalesce(own, F.when(inside, 1.0).otherwise(0.0))
    return rows.select("query_id", "item_id", grade.alias("grade"), (inside | F.coalesce(own > 0, F.lit(False))).alias("relevant"))


def ranked_items(hits: DataFrame, item: str = "doc_id") -> DataFrame:
    """(query_id, item_id, rank, pos): a list's items, each where it stands first
    (rank among the hits), and its position among distinct items."""
    first = hits.groupBy("query_id", F.col(item).alias("item_id")).agg(F.min("rank").alias("rank"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item_id")))


def query_scores(queries: DataFrame, hits: DataFrame, judged: DataFrame, ks: Sequence[int] = KS, item: str = "doc_id", graded: bool = True) -> DataFrame:
    """One row per query: recall, precision, hit and ndcg at each k, mrr, map.

    k cuts the hits before items are deduplicated. Queries without hits or
    without relevant items score 0. graded: the ideal order for ndcg comes from
    all judged grades; else from the gains of what was retrieved.
    """
    ks = sorted({int(k) for k in ks})
    depth = ks[-1]
    j = judged.groupBy("query_id", "item_id").agg(F.max("grade").alias("grade"), F.max("relevant").alias("relevant"))
    rel = F.coalesce("relevant", F.lit(False))
    by_pos = Window.partitionBy("query_id").orderBy("pos")
    r = ranked_items(hits, item).join(j, ["query_id", "item_id"], "left").select(
        "query_id", "rank", "pos", rel.cast("int").alias("rel"), F.coalesce("grade", F.lit(0.0)).alias("grade")
    )
    r = r.withColumn("found", F.sum("rel").over(by_pos))
    discount = lambda p: F.log2(p + 1)
    # positions stay right under a cut at k: an item ahead of another has the better rank
    aggs = [
        F.coalesce(F.max(F.when(F.col("rel") == 1, 1 / F.col("pos"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when((F.col("rel") == 1) & (F.col("pos") <= depth), F.col("found") / F.col("pos")).otherwise(0.0)).alias("ap"),
    ]
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [F.sum(F.when(inside, F.col("rel")).otherwise(0)).alias(f"n{k}"), F.sum(F.when(inside, F.col("grade") / discount(F.col("pos"))).otherwise(0.0)).alias(f"dcg{k}")]
    if not graded:
        for k in ks:
            r = r.withColumn(f"i{k}", F.row_number().over(Window.partitionBy("query_id", F.col("rank") <= k).orderBy(F.col("grade").desc(), "pos")))
            aggs.append(F.sum(F.when(F.col("rank") <= k, F.col("grade") / discount(F.col(f"i{k}"))).otherwise(0.0)).alias(f"idcg{k}"))
    got = r.groupBy("query_id").agg(*aggs)
    ideal_pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "item_id"))
    positive = j.withColumn("i", F.when(F.col("grade") > 0, ideal_pos))
    ideals = [F.sum(F.when(F.col("i") <= k, F.col("grade") / discount(F.col("i"))).otherwise(0.0)).alias(f"idcg{k}") for k in ks] if graded else []
    need = positive.groupBy("query_id").agg(F.sum(F.col("relevant").cast("int")).alias("n_rel"), *ideals)
    both = queries.select("query_id").distinct().join(got, "query_id", "left").join(need, "query_id", "left").fillna(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = ["query_id"]
    for k in ks:
        n, dcg, idcg = F.col(f"n{k}"), F.col(f"dcg{k}"), F.col(f"idcg{k}")
        out += [ratio(n, F.col("n_rel")).alias(f"recall@{k}"), (n / k).alias(f"precision@{k}"), (n > 0).cast("double").alias(f"hit@{k}"), ratio(dcg, idcg).alias(f"ndcg@{k}")]
    out += ["mrr", ratio(F.col("ap"), F.least("n_rel", F.lit(depth))).alias("map")]
    return both.select(*out)


def long_form(scores: DataFrame) -> DataFrame:
    """(query_id, metric, value)."""
    names = [c for c in scores.columns if c != "query_id"]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in names)))
    return scores.select("query_id", pairs.alias("p")).select("query_id", "p.metric", "p.value")


def interval(value: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Aggregates: the mean's normal interval within [0, 1]; (0, 0) for fewer than two."""
    margin = z * F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))
    few = F.count(value) < 2
    return (
        F.when(few, 0.0).otherwise(F.greatest(F.lit(0.0), F.avg(value) - margin)),
        F.when(few, 0.0).otherwise(F.least(F.lit(1.0), F.avg(value) + margin)),
    )


def summarize(long: DataFrame) -> DataFrame:
    """(metric, mean, low, high, n) over queries."""
    low, high = interval(F.col("value"))
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), low.alias("low"), high.alias("high"), F.count("*").alias("n"))


def percentiles(values: DataFrame, column: str, points: Sequence[float]) -> DataFrame:
    """Exact, linearly interpolated; 0 for an empty table."""
    return values.agg(*(F.coalesce(F.percentile(column, p / 100), F.lit(0.0)).alias(f"p{p:g}") for p in points))


def failures(long: DataFrame, metric="mrr", threshold=0.0) -> DataFrame:
    return long.where((F.col("metric") == metric) & (F.col("value") <= threshold))


def compare(baseline: DataFrame, candidate: DataFrame, metric: str) -> DataFrame:
    """One row from two long forms: means over all queries of each, and over the
    queries that both have: improved and regressed ids, and how many stayed."""
    pick = lambda d, n: d.where(F.col("metric") == metric).select("query_id", F.col("value").alias(n))
    a, b = pick(baseline, "before"), pick(candidate, "after")
    means = a.agg(F.coalesce(F.avg("before"), F.lit(0.0)).alias("baseline")).crossJoin(F.broadcast(b.agg(F.coalesce(F.avg("after"), F.lit(0.0)).alias("candidate"))))
    moved = a.join(b, "query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("after") > F.col("before"), F.col("query_id")))).alias("improved"),
        F.array_sort(F.collect_list(F.when(F.col("after") < F.col("before"), F.col("query_id")))).alias("regressed"),
        F.count_if(F.col("after") == F.col("before")).alias("unchanged"),
    )
    delta = F.col("candidate") - F.col("baseline")
    return means.crossJoin(F.broadcast(moved)).select(
        F.lit(metric).alias("metric"), "baseline", "candidate", delta.alias("delta"),
        F.when(F.col("baseline") != 0, delta / F.col("baseline") * 100).alias("delta_pct"), "improved", "regressed", "unchanged",
    )
