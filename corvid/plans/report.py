"""Small results as text for a terminal and as self-contained HTML."""

from __future__ import annotations

import html
import os
import re
import sys
from collections.abc import Sequence
from datetime import datetime
from pathlib import Path
from typing import Any

from .evaluate import EvalResult, SweepReport

_ANSI = re.compile(r"\x1b\[[0-9;]*m")


def use_utf8() -> None:
    for s in (sys.stdout, sys.stderr):
        if hasattr(s, "reconfigure"):
            s.reconfigure(errors="replace", encoding="utf-8")


def colours() -> bool:
    if os.environ.get("NO_COLOR"):
        return False
    return bool(os.environ.get("FORCE_COLOR")) or sys.stdout.isatty()


def band(value: float) -> str:
    """Three digits, green from 0.8, yellow from 0.5, else red."""
    code = 32 if value >= 0.8 else 33 if value >= 0.5 else 31
    return f"\x1b[{code}m{value:.3f}\x1b[0m" if colours() else format(value, ".3f")


def table(head, rows, right=()) -> str:
    if not rows:
        return "(no rows)"
    seen = lambda s: len(_ANSI.sub("", s))
    width = [max(seen(r[i]) for r in [head, *rows]) for i in range(len(head))]
    def line(r):
        cells = [" " * (w - seen(c)) + c if i in right else c + " " * (w - seen(c)) for i, (c, w) in enumerate(zip(r, width))]
        return "  ".join(cells).rstrip()
    return "\n".join([line(head), "  ".join("-" * w for w in width), *map(line, rows)])


def eval_text(result: EvalResult, ks: Sequence[int]) -> str:
    kinds = ("recall", "precision", "hit", "ndcg")
    rows = [[kind, *(band(result.metrics.get(f"{kind}@{k}", 0.0)) for k in ks)] for kind in kinds]
    low, high = result.confidence_interval(f"recall@{ks[-1]}")
    took = f", indexed in {result.index_seconds:.2f} s" if result.index_seconds else ""
    out = [f"{result.label}: {result.n_queries} queries, {result.n_chunks} chunks{took}", "", table(["", *(f"@{k}" for k in ks)], rows, range(1, len(ks) + 1)), ""]
    out.append(f"mrr {band(result.metrics.get('mrr', 0.0))}  map {band(result.metrics.get('map', 0.0))}  recall@{ks[-1]} between {low:.3f} and {high:.3f}")
    if result.latency_ms:
        out.append("latency in ms: " + "  ".join(f"{k} {v:.1f}" for k, v in result.latency_ms.items()))
    if missed := result.failures():
        out += ["", f"{len(missed)} queries found nothing:", *(f"  {q['query_id']}: {q['query']}" for q in missed[:5])]
    return "\n".join(out)


def sweep_text(report: SweepReport) -> str:
    rows = []
    for i, r in enumerate(report.ranked(), 1):
        m, ms = r["metrics"], r["latency_ms"]
        values = [r["error"]] + [""] * 5
        if not r["error"]:
            values = [*(band(m.get(n, 0.0)) for n in (report.primary, "mrr", _ndcg(m))), _ms(ms), f"{r['index_seconds']:.2f}", str(r["n_chunks"])]
        rows.append([str(i), r["label"], *values])
    return table(["", "configuration", report.primary, "mrr", "ndcg", "p95 ms", "index s", "chunks"], rows, (0, 2, 3, 4, 5, 6, 7))


def _ndcg(metrics: dict[str, float]) -> str:
    """nDCG at the greatest cut-off there is."""
    return max((n for n in metrics if n.startswith("ndcg@")), key=lambda n: int(n[5:]), default="ndcg@10")


def _ms(latency: dict[str, float]) -> str:
    value = latency.get("p95", latency.get("mean"))
    return "" if value is None else f"{value:.1f}"


def hits_text(query: str, hits: Sequence[dict[str, Any]], width: int = 240) -> str:
    out = [f"query: {query}"]
    for h in hits:
        flat = " ".join(h["text"].split())
        flat = flat if len(flat) <= width else flat[: width - 1].rstrip() + "…"
        out += ["", f"{h['rank']}. {h['score']:.4f}  {h['doc_id']}  ({h['source']})", f"   {flat}"]
    return "\n".join(out if hits else [*out, "(no hits)"])


_STYLE = (
    ":root{color-scheme:light dark}body{font:15px/1.5 system-ui,sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem}"
    "table{border-collapse:collapse;width:100%}td,th{padding:.3rem .6rem;text-align:right;border-bottom:1px solid #8884}"
    "td:first-child,th:first-child{text-align:left}.cards{display:flex;gap:1rem;flex-wrap:wrap}"
    ".card{border:1px solid #8886;border-radius:.5rem;padding:.6rem 1rem}.card b{display:block;font-size:1.4rem}"
    ".best{background:#2a82}.bar{background:#47c8;height:.7rem;border-radius:.2rem}"
)


def _page(title: str, body: str) -> str:
    made = datetime.now().isoformat(" ", "minutes")
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{html.escape(title)}</title><style>{_STYLE}</style><h1>{html.escape(title)}</h1>{body}<footer><p><small>{made}</small></p></footer></html>'


def _cards(pairs: Sequence[tuple[str, str]]) -> str:
    return '<div class="cards">' + "".join(f'<div class="card">{html.escape(k)}<b>{html.escape(v)}</b></div>' for k, v in pairs) + "</div>"


def _rows(head: Sequence[str], rows: Sequence[tuple[str, Sequence[str]]]) -> str:
    top = "".join(f"<th>{html.escape(h)}</th>" for h in head)
    return f"<table><tr>{top}</tr>" + "".join(f"<tr{kind}>{''.join(f'<td>{c}</td>' for c in cells)}</tr>" for kind, cells in rows) + "</table>"


def eval_html(result: EvalResult, path: str, ks: Sequence[int]) -> None:
    m = result.metrics
    shown = [(n, format(m.get(n, 0.0), ".3f")) for n in (f"recall@{ks[-1]}", "mrr", _ndcg(m))]
    shown += [("p95 ms", _ms(result.latency_ms) or "-"), ("index s", f"{result.index_seconds:.2f}")]
    cards = _cards([*shown, *((n, str(getattr(result, f"n_{n}"))) for n in ("chunks", "queries"))])
    grid = _rows(["metric", *(f"@{k}" for k in ks)], [("", [kind, *(f"{m.get(f'{kind}@{k}', 0):.3f}" for k in ks)]) for kind in ("recall", "precision", "hit", "ndcg")])
    missed = result.failures()[:15]
    rest = "<h2>Nothing found</h2>" + _rows(["query", "text", "expected"], [("", [html.escape(str(q["query_id"])), html.escape(q["query"]), html.escape(", ".join(q["relevant"]))]) for q in missed]) if missed else ""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(_page(result.label, cards + grid + rest), "utf-8")


def sweep_html(report: SweepReport, path: str) -> None:
    ranked, best = report.ranked(), report.best
    top = (best["metrics"].get(report.primary, 0.0) if best else 0.0) or 1.0
    cards = _cards([("best", best["label"] if best else "none"), ("spread", f"{report.spread:.3f}"), ("configurations", str(len(ranked))), ("queries", str(report.n_queries))])
    rows = []
    for i, r in enumerate(ranked, 1):
        v = r["metrics"].get(report.primary, 0.0)
        cell = html.escape(r["error"]) if r["error"] else f'<div class="bar" style="width:{100 * v / top:.1f}%"></div>'
        m = r["metrics"]
        figures = ["", "", "", ""] if r["error"] else [f"{m.get('mrr', 0):.3f}", f"{m.get(_ndcg(m), 0):.3f}", _ms(r["latency_ms"]), f"{r['index_seconds']:.2f}"]
        rows.append((' class="best"' if r is best else "", [html.escape(f"{i}. {r['label']}"), f"{v:.3f}", cell, *figures, str(r["n_chunks"])]))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(_page(f"Sweep by {report.primary}", cards + _rows(["configuration", report.primary, "", "mrr", "ndcg", "p95 ms", "index s", "chunks"], rows)), "utf-8")
