"""Quality rules by gradient-boosted trees over document statistics.

Statistics come from vectorised passes over the bytes. Trees of a fixed depth
are grown on binned features by second-order boosting of the log loss; on
features with a constraint a split whose sides would be ordered against it is
refused and the sides' values are kept apart by bounds, so the score can only
fall as, say, the share of symbols grows. A fitted model is four numpy arrays
(feature, threshold, leaf value, bias) that score all rows level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashstore import batches
from .labelled import labelled_sample
from .shared import bounded_batches
from .textops import (
    NOT_SPACE, U, buffer_of, line_spans, mix, owners, per_text, prefix_sums, range_hashes, slices, spans, windows,
)

WINDOW = 8
_b = np.arange(256)
CODE_POINT = (_b & 0xC0) != 0x80
SYMBOL = np.isin(_b, [ord(c) for c in "#*$%&|<>"])
UPPER = (_b >= 65) & (_b <= 90)
DIGIT = (_b >= 48) & (_b <= 57)
SHOUT = np.isin(_b, [ord(c) for c in "!?"])

#: Features and how the score may move with each: -1 never up, 0 either way.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "digit_share": -1, "shout_share": -1, "same_next_share": -1, "distinct_share": 0, "words_per_line": 0,
}


def statistics(buf: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts of each text, and its feature row."""
    starts, ends, ptr = spans(buf, offs, NOT_SPACE)
    total = prefix_sums(buf)
    h = range_hashes(total, starts, ends)
    n, texts = np.diff(ptr), len(offs) - 1
    doc = owners(ptr)
    words = n.astype(np.int64)
    word_chars = per_text(CODE_POINT[buf] & NOT_SPACE[buf], offs)
    symbols = per_text(SYMBOL[buf], offs)

    line_s, line_e, line_doc = line_spans(buf, offs)
    held = np.searchsorted(starts, line_e) > np.searchsorted(starts, line_s)  # lines with a word
    line_h = range_hashes(total, line_s[held], line_e[held])
    line_doc = line_doc[held]
    _, one = np.unique(line_h ^ mix(line_doc.astype(np.uint64) + U(1)), return_index=True)
    lines = np.bincount(line_doc, minlength=texts)
    dup_lines = lines - np.bincount(line_doc[one], minlength=texts)

    at, g = windows(h, ptr, WINDOW)
    key = g ^ mix(doc[at].astype(np.uint64) + U(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    repeat_words = per_text(np.cumsum(cover[:-1]) > 0, ptr)

    next_same = np.zeros(len(h), bool)
    next_same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    kinds = np.bincount(doc[np.unique(h ^ mix(doc.astype(np.uint64) + U(1)), return_index=True)[1]], minlength=texts)
    w, c = np.maximum(words, 1), np.maximum(word_chars, 1)
    rows = np.stack(
        [
            np.log1p(words), word_chars / w, symbols / c, dup_lines / np.maximum(lines, 1), repeat_words / w,
            per_text(UPPER[buf], offs) / c, per_text(DIGIT[buf], offs) / c, per_text(SHOUT[buf], offs) / c,
            per_text(next_same, ptr) / w, kinds / w, words / np.maximum(lines, 1),
        ], axis=1,
    )
    base = {"n_words": words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words}
    return base, rows


@dataclass
class TreeModel:
    """Complete trees: node k has children 2k+1 and 2k+2; a row goes right where
    its feature is above the threshold (nan goes left)."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        inner, row = self.feature.shape[1], np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while inner and at[0] < inner if len(x) else False:
                at = 2 * at + 1 + (x[row, f[at]] > t[at])
            out += v[at - inner]
        return 1 / (1 + np.exp(-out))


def fit(
    x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.25, bins: int = 32, ridge: float = 2.0
) -> TreeModel:
    """signs: -1, 0 or 1 for each feature. With no row or one label only, the
    model is a constant: the labels' mean, drawn towards 0.5."""
    n, inner = len(y), 2**depth - 1
    prior = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(prior / (1 - prior)))
    shape = (trees if 0 < y.sum() < n else 0, inner)
    feature, threshold = np.zeros(shape, np.int64), np.full(shape, np.inf)
    value = np.zeros((shape[0], inner + 1))
    model = TreeModel(feature, threshold, value, bias)
    if not shape[0]:
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    logit = np.full(n, bias)
    for t in range(shape[0]):
        p = 1 / (1 + np.exp(-logit))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            g_all, h_all = grad[rows].sum(), hess[rows].sum()
            best, pick = 1e-6, None
            for f, e in enumerate(edges):
                if not len(e) or not len(rows):
                    continue
                gl = np.cumsum(np.bincount(code[rows, f], grad[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(code[rows, f], hess[rows], len(e) + 1))[:-1]
                gr, hr = g_all - gl, h_all - hl
                vl = np.clip(-gl / (hl + ridge), low[k], high[k])
                vr = np.clip(-gr / (hr + ridge), low[k], high[k])
                whole = np.clip(-g_all / (h_all + ridge), low[k], high[k])
                cost = lambda v, g, h: g * v + 0.5 * (h + ridge) * v * v
                gain = cost(whole, g_all, h_all) - cost(vl, gl, hl) - cost(vr, gr, hr)
                gain[(hl < 1) | (hr < 1) | (signs[f] * (vr - vl) < 0)] = 0
                if gain.max() > best:
                    j = int(gain.argmax())
                    best, pick = gain[j], (f, e[j], (vl[j] + vr[j]) / 2)
            low[[2 * k + 1, 2 * k + 2]], high[[2 * k + 1, 2 * k + 2]] = low[k], high[k]
            if pick:
                f, cut, mid = pick
                feature[t, k], threshold[t, k] = f, cut
                if signs[f]:
                    up = 2 if signs[f] > 0 else 1  # the side that must not be lower
                    low[2 * k + up], high[2 * k + 3 - up] = mid, mid
            node[rows] = 2 * k + 1 + (x[rows, feature[t, k]] > threshold[t, k])
        g_leaf = np.bincount(node - inner, grad, inner + 1)
        h_leaf = np.bincount(node - inner, hess, inner + 1)
        value[t] = rate * np.clip(-g_leaf / (h_leaf + ridge), low[inner:], high[inner:])
        logit += value[t][node - inner]
    return model


def _sample_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        buf, offs = buffer_of(batch.column(0))
        for a, z, b, o in slices(buf, offs):
            x = statistics(b, o)[1]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch({"y": batch.column(1).slice(a, z - a), "x": flat})


def train(sample: DataFrame, **how) -> TreeModel:
    """From (text, y) rows, as labelled_sample gives them."""
    table = sample.select("text", "y").mapInArrow(_sample_rows, "y int, x array<double>").toArrow()
    y = table["y"].to_numpy().astype(np.float64)
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # sums, and so the model, don't depend on the order of rows
    return fit(x[order], y[order], np.array(list(FEATURES.values())), **how)


def _judge(rows: Iterator[pa.RecordBatch], model: TreeModel, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        buf, offs = buffer_of(batch.column(1))
        for a, z, b, o in slices(buf, offs):
            base, x = statistics(b, o)
            n, rep = base["n_words"], base["n_repeat_words"]
            failed = (n < 20) | (100 * rep > 30 * n)
            score = model.score(x)
            yield pa.record_batch(
                {"id": batch.column(0).slice(a, z - a)}
                | {k: pa.array(v.astype(np.int64)) for k, v in base.items()}
                | {"base_failed": pa.array(failed), "kept": pa.array(~failed & (score >= threshold)), "quality": pa.array(score)}
            )


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.5,
    sample: int = 20_000,
    **how,
) -> DataFrame:
    """Per row of docs: the id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept and quality (the trees' score).

    Words end at ASCII white space, and case counts. A text fails the base rules
    with under 20 words, or if more than 30 % of its words lie in 8-word windows
    found twice or more in it; kept is false for those, else score >= threshold.
    The trees learn from at most `sample` labelled rows. Null and empty texts
    have no words and fail. Rows that repeat an id, or have none, get a row
    each. Without labels of both kinds, the score is the same for all rows. An
    empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    model = train(labelled_sample(docs, labels, id_col, text_col, label_col, sample), **how)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"
    return rows.mapInArrow(lambda it: _judge(it, model, threshold), schema).withColumnRenamed("id", id_col)
