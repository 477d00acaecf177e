"""Evaluation of a stack over judged queries, and sweeps over many stacks."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators.bm25 import BM25Index
from .config import PipelineConfig
from .pipeline import RetrievalPipeline

#: Told the number of a configuration, how many there are, and its label.
Progress = Callable[[int, int, str], None]


@dataclass
class EvalResult:
    label: str
    metrics: dict[str, float]
    per_query: list[dict[str, Any]]
    latency_ms: dict[str, float] = field(default_factory=dict)
    n_queries: int = 0
    n_chunks: int = 0
    index_seconds: float = 0.0
    config: dict[str, Any] | None = None

    def primary(self, metric="recall@5"):
        return self.metrics.get(metric, 0.0)

    def values(self, metric: str) -> list[float]:
        return [q["metrics"].get(metric, 0.0) for q in self.per_query]

    def failures(self, metric="mrr", threshold=0.0) -> list[dict[str, Any]]:
        return [q for q, v in zip(self.per_query, self.values(metric)) if v <= threshold]

    def confidence_interval(self, metric="recall@5", z=1.96) -> tuple[float, float]:
        from statistics import fmean, stdev

        values = self.values(metric)
        if len(values) < 2:
            return 0.0, 0.0
        half = z * stdev(values) / len(values) ** 0.5
        return max(0.0, fmean(values) - half), min(1.0, fmean(values) + half)

    def to_dict(self) -> dict:
        return dict(vars(self))

    def save(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(self.to_dict(), indent=2, ensure_ascii=False), "utf-8")

    @staticmethod
    def read(path: str) -> EvalResult:
        d = json.loads(Path(path).read_text("utf-8"))
        return EvalResult(d.get("label", Path(path).name), d.get("metrics", {}), d.get("per_query", []), d.get("latency_ms", {}), n_queries=d.get("n_queries", 0), n_chunks=d.get("n_chunks", 0))


def time_queries(pipeline: RetrievalPipeline, queries: DataFrame, k: int, most: int) -> dict[Any, float]:
    """Milliseconds that single queries take, each asked on its own: `most` of
    them, evenly from all in the order of their ids."""
    ids = sorted((r.query_id for r in queries.select("query_id").collect()), key=str) if most > 0 else []  # judged queries
    step = max(1, -(-len(ids) // most)) if ids else 1
    took = {}
    for i in ids[::step]:
        one = queries.where(F.col("query_id") == i)
        began = time.perf_counter()
        pipeline.retrieve(one, k).select("query_id", "rank", "doc_id", "chunk_id").collect()
        took[i] = (time.perf_counter() - began) * 1000
    return took


def latencies(each: Sequence[float]) -> dict[str, float]:
    """mean, p50, p95 and max, percentiles between the nearest ranks."""
    if not each:
        return {}
    from statistics import fmean

    ordered = sorted(each)

    def percentile(q: float) -> float:
        at = q * (len(ordered) - 1)
        low = int(at)
        return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (at - low)

    return {"mean": fmean(ordered), "p50": percentile(0.5), "p95": percentile(0.95), "max": ordered[-1]}


def evaluate(
    pipeline: RetrievalPipeline, queries: DataFrame, ks: Sequence[int] = M.KS, granularity="doc", label=None, index_seconds=0.0, timed: int = 10
) -> EvalResult:
    """Every query in one job for the quality. Latency is that of `timed` queries
    asked one at a time; with none, latency_ms holds the batch's time per query
    as mean alone. latency_ms of a query is its own if it was timed, else that mean."""
    if queries.isEmpty():
        raise ValueError("no queries to evaluate")
    ks = sorted({int(k) for k in ks})
    began = time.perf_counter()
    hits = pipeline.retrieve(queries, ks[-1]).select("query_id", "rank", "doc_id", "chunk_id").persist()
    hits.count()
    took = (time.perf_counter() - began) * 1000
    item = "doc_id" if granularity == "doc" else "chunk_id"
    scores = M.query_scores(queries, hits, M.judgements(queries), ks, item)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "item_id"))), lambda r: r["item_id"])
    found = M.ranked_items(hits, item).groupBy("query_id").agg(listed.alias("retrieved"))
    rows = queries.join(scores, "query_id").join(found, "query_id", "left").orderBy("query_id").collect()  # one row per judged query
    hits.unpersist()
    names = [c for c in scores.columns if c != "query_id"]
    each = took / max(1, len(rows))
    alone = time_queries(pipeline, queries, ks[-1], timed)
    latency = latencies(list(alone.values())) or {"mean": each}
    per_query = [
        {"query_id": r.query_id, "query": r.text, "metrics": {n: float(r[n]) for n in names}, "latency_ms": alone.get(r.query_id, latency["mean"]), "retrieved": r.retrieved or [], "relevant": r.relevant_doc_ids}
        for r in rows
    ]
    means = {n: sum(q["metrics"][n] for q in per_query) / len(per_query) for n in names}
    return EvalResult(label or pipeline.config.label, means, per_query, latency, len(rows), pipeline.chunks.count(), index_seconds, pipeline.config.to_dict())


def free(made: Any) -> None:
    """Unpersists all tables in what stacks shared."""
    for x in made.values() if isinstance(made, dict) else made if isinstance(made, tuple) else [made]:
        if isinstance(x, DataFrame):
            x.unpersist()
        elif isinstance(x, BM25Index):
            free((x.postings, x.term_stats, x.stats))
        elif isinstance(x, (dict, tuple)):
            free(x)


@dataclass
class SweepReport:
    """Rows of (label, metrics, latency, index_seconds, n_chunks, config, error)."""

    rows: list[dict[str, Any]]
    primary: str
    n_queries: int

    def ranked(self) -> list[dict[str, Any]]:
        """Healthy ones by the primary metric, then the broken ones, each in the order run."""
        return sorted(self.rows, key=lambda r: (r["error"] is not None, -r["metrics"].get(self.primary, 0.0)))

    @property
    def best(self) -> dict[str, Any] | None:
        top = self.ranked()
        return top[0] if top and top[0]["error"] is None else None

    @property
    def spread(self) -> float:
        values = [r["metrics"].get(self.primary, 0.0) for r in self.rows if r["error"] is None]
        return max(values) - min(values) if values else 0.0

    def to_dict(self) -> dict:
        return {"rows": self.ranked(), "primary": self.primary, "n_queries": self.n_queries}


def run_sweep(
    configs: Sequence[PipelineConfig], docs: DataFrame, queries: DataFrame, ks: Sequence[int] = M.KS, primary="recall@5", granularity="doc",
    on_progress: Progress | None = None, timed: int = 3,
) -> SweepReport:
    """Each configuration indexed and evaluated; one that fails is a row with its
    error. Chunks, vectors and postings are worked out once for all that share
    their settings, and freed after the last configuration with their chunker."""
    rows, shared = [], {}
    chunkers = [(c.chunker, json.dumps(c.chunker_args, sort_keys=True)) for c in configs]
    for i, config in enumerate(configs, 1):
        if on_progress:
            on_progress(i, len(configs), config.label)
        row = {"label": config.label, "metrics": {}, "latency_ms": {}, "index_seconds": 0.0, "n_chunks": 0, "config": config.to_dict(), "error": None}
        try:
            began = time.perf_counter()
            p = RetrievalPipeline(config).index(docs, shared.setdefault(chunkers[i - 1], {}))
            row["index_seconds"] = time.perf_counter() - began
            r = evaluate(p, queries, ks, granularity, timed=timed)
            row |= {"metrics": r.metrics, "latency_ms": r.latency_ms, "n_chunks": r.n_chunks}
        except Exception as e:  # a broken stack mustn't end the sweep
            row["error"] = f"{type(e).__name__}: {e}"
        rows.append(row)
        if chunkers[i - 1] not in chunkers[i:]:
            for made in shared.pop(chunkers[i - 1], {}).values():
                free(made)
    return SweepReport(rows, primary, queries.count())
