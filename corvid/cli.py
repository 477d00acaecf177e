"""Command line: index, query, eval, sweep, compare, serve.

Exit codes: 0 done, 1 below the recall asked for, 2 wrong use, 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path
from typing import Any

from .functions import metrics as M
from .plans import report as R
from .plans.config import RETRIEVERS, PipelineConfig, ablation_grid, expand_grid, load_grid
from .plans.evaluate import EvalResult, evaluate, run_sweep
from .plans.pipeline import RetrievalPipeline
from .session import local_session
from .sources.corpus import load_documents, load_queries, unknown_items

DONE, BELOW, USAGE, INTERRUPTED = 0, 1, 2, 130
INDEX = ".corvid"


def parse_ks(text: str) -> list[int]:
    try:
        ks = sorted({int(x) for x in text.split(",") if x.strip()})
    except ValueError:
        raise argparse.ArgumentTypeError(f"{text!r} is no list of whole numbers") from None
    if not ks:
        raise argparse.ArgumentTypeError("no cut-off given")
    return ks


def parse_where(text: str | None) -> dict[str, Any] | None:
    try:
        return json.loads(text) if text else None
    except json.JSONDecodeError as e:
        raise ValueError(f"--where is not JSON: {e}") from None


def _config(a: argparse.Namespace) -> PipelineConfig:
    base = PipelineConfig.from_file(a.config) if a.config else PipelineConfig()
    given = {n: getattr(a, n) for n in ("chunker", "embedder", "store", "retriever") if getattr(a, n, None)}
    return base.merged(**given)


def _indexed(spark, a: argparse.Namespace, docs) -> tuple[RetrievalPipeline, float]:
    began = time.perf_counter()
    return RetrievalPipeline(_config(a)).index(docs), time.perf_counter() - began


def _unknown(queries, docs) -> bool:
    bad = unknown_items(M.judgements(queries), docs).orderBy("query_id", "item_id").limit(10).collect()
    for r in bad:
        print(f"query {r.query_id} expects {r.item_id}, which the corpus lacks", file=sys.stderr)
    return bool(bad)


def index(spark, a) -> int:
    p, took = _indexed(spark, a, load_documents(spark, a.corpus))
    p.save(a.out)
    print(R.table(["", ""], [[k, str(v)] for k, v in p.stats().items()], [1]))
    print(f"\n{took:.2f} s, saved in {a.out}")
    return DONE


def query(spark, a) -> int:
    p = RetrievalPipeline.load(spark, a.index)
    began = time.perf_counter()
    hits = [h.asDict() for h in p.search(a.query, a.k, parse_where(a.where)).collect()]
    took = (time.perf_counter() - began) * 1000
    if a.json:
        keys = ("rank", "score", "chunk_id", "doc_id", "text", "metadata")
        print(json.dumps({"query": a.query, "latency_ms": round(took, 3), "hits": [{k: h[k] for k in keys} for h in hits]}, indent=2, ensure_ascii=False))
    else:
        print(R.hits_text(a.query, hits))
        print(f"\n{len(hits)} hits in {took:.1f} ms")
    return DONE


def eval_(spark, a) -> int:
    queries = load_queries(spark, a.queries)
    if a.corpus:
        docs = load_documents(spark, a.corpus)
        if _unknown(queries, docs):
            return USAGE
        p, took = _indexed(spark, a, docs)
    else:
        p, took = RetrievalPipeline.load(spark, a.index), 0.0
    r = evaluate(p, queries, a.ks, a.granularity, index_seconds=took)
    print(R.eval_text(r, a.ks))
    if a.html:
        R.eval_html(r, a.html, a.ks)
    if a.json:
        r.save(a.json)
    if a.min_recall is not None:
        metric = f"recall@{a.gate_k}"
        got = r.metrics.get(metric, 0.0)
        passed = got + 1e-9 >= a.min_recall
        print(f"\n{metric} is {got:.3f}, {'enough' if passed else 'not enough'} for {a.min_recall:.3f}", file=sys.stdout if passed else sys.stderr)
        return DONE if passed else BELOW
    return DONE


def sweep(spark, a) -> int:
    docs, queries = load_documents(spark, a.corpus), load_queries(spark, a.queries)
    if _unknown(queries, docs):
        return USAGE
    configs = load_grid(a.grid) if a.grid else expand_grid(PipelineConfig(), ablation_grid())
    tell = None if a.quiet else lambda i, n, label: print(f"{i} of {n}: {label}", file=sys.stderr)
    r = run_sweep(configs, docs, queries, a.ks, a.primary, a.granularity, tell)
    print(R.sweep_text(r))
    if a.html:
        R.sweep_html(r, a.html)
    if a.json:
        Path(a.json).parent.mkdir(parents=True, exist_ok=True)
        Path(a.json).write_text(json.dumps(r.to_dict(), indent=2, ensure_ascii=False), "utf-8")
    if a.save_best and r.best:
        PipelineConfig.from_dict(r.best["config"]).to_json(a.save_best)
    return DONE


def compare(spark, a) -> int:
    old, new = EvalResult.read(a.baseline), EvalResult.read(a.candidate)
    value = lambda r: {q["query_id"]: q["metrics"].get(a.metric, 0.0) for q in r.per_query}
    x, y = value(old), value(new)
    shared = sorted(x.keys() & y.keys())
    better, worse = [q for q in shared if y[q] > x[q]], [q for q in shared if y[q] < x[q]]
    delta = new.primary(a.metric) - old.primary(a.metric)
    print(R.table(["", "run", a.metric], [["baseline", old.label, f"{old.primary(a.metric):.4f}"], ["candidate", new.label, f"{new.primary(a.metric):.4f}"]], [2]))
    share = f" ({delta / old.primary(a.metric):+.1%})" if old.primary(a.metric) else ""
    print(f"\n{delta:+.4f}{share}; {len(better)} better, {len(worse)} worse, {len(shared) - len(better) - len(worse)} the same")
    for q in worse[:10]:
        print(f"  worse: {q}")
    return DONE


def serve(spark, a) -> int:
    from .plans.service import serve as make

    make(RetrievalPipeline.load(spark, a.index), a.port, a.host).serve_forever()
    return DONE


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("corvid", description="Hybrid retrieval on Spark, and its evaluation.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, **flags: dict) -> None:
        s = sub.add_parser(name)
        for flag, how in flags.items():
            s.add_argument(flag if flag in positional else ("-" if len(flag) == 1 else "--") + flag.replace("_", "-"), **how)
        s.set_defaults(run=run)

    positional = {"text", "baseline", "candidate"}
    need, stack = {"required": True}, {"config": {}, "chunker": {}, "retriever": {"choices": RETRIEVERS}}
    scored = {"ks": {"type": parse_ks, "default": list(M.KS)}, "granularity": {"choices": ["doc", "chunk"], "default": "doc"}, "html": {}, "json": {}}
    at = {"index": {"default": INDEX}}
    command("index", index, corpus=need, out={"default": INDEX}, embedder={}, store={}, **stack)
    command("query", query, text={}, k={"type": int, "default": 5}, where={}, json={"action": "store_true"}, **at)
    command("eval", eval_, queries=need, corpus={}, min_recall={"type": float}, gate_k={"type": int, "default": 5}, **at, **stack, **scored)
    command("sweep", sweep, corpus=need, queries=need, grid={}, primary={"default": "recall@5"}, save_best={}, quiet={"action": "store_true"}, **scored)
    command("compare", compare, baseline={}, candidate={}, metric={"default": "recall@5"})
    command("serve", serve, host={"default": "127.0.0.1"}, port={"type": int, "default": 8000}, **at)
    return p


def main(argv: list[str] | None = None) -> int:
    R.use_utf8()
    a = parser().parse_args(argv)
    if a.command == "query":
        a.query = a.text
    try:
        return a.run(None if a.command == "compare" else local_session("*"), a)
    except (FileNotFoundError, ValueError, KeyError, ImportError) as e:
        print(f"error: {e}", file=sys.stderr)
        return USAGE
    except KeyboardInterrupt:
        return INTERRUPTED


if __name__ == "__main__":
    sys.exit(main())
