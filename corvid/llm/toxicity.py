"""Toxicity by a factorization machine over hashed terms.

Terms are words (runs of letters, digits and what lies beyond ASCII, A-Z
folded) and their prefixes, hashed into 2^20 buckets each; a text counts each
bucket once. A bucket takes part if the label depends on it (chi-square, either
sign), or on its standing beside another one more than on either alone; how
many pass is not limited. Each has a linear weight and a vector of `factors`;
the products of two terms' vectors score the pair, so that an insult beside a
group's name weighs more than both alone, even where each alone is harmless.
Fitted by Adam on the log loss on the driver, from a sample bounded by `sample`
rows; scoring is one scan without shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashstore import batches
from .labelled import id_remainder, labelled_sample
from .shared import bounded_batches
from .textops import ALNUM_ANY_CASE, buffer_of, mix, prefix_sums, range_hashes, slices, spans

BITS = 20
PREFIXES = (4, 5)
WORDS = 1 << BITS  # buckets below are words', those from here on prefixes'
CHI = 10.8  # chi-square under which a term is taken as noise: one in a thousand by chance
PAIR_CHI = 40.0  # the same for pairs, of which there are far more
PAIR_ROWS = 8  # rows of a label in which a pair has to stand


def term_buckets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every term, with repeats."""
    starts, ends, ptr = spans(buf, offs, ALNUM_ANY_CASE)
    total = prefix_sums(buf, lower=True)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(ptr))
    found, owner = [(range_hashes(total, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)], [doc]
    for k in PREFIXES:
        long = ends - starts > k
        h = range_hashes(total, starts[long], starts[long] + k) ^ np.uint64((k + 1) << 44)  # lengths apart
        found.append((h >> np.uint64(64 - BITS)).astype(np.int64) + WORDS)
        owner.append(doc[long])
    return np.concatenate(owner), np.concatenate(found)


@dataclass
class FactorizationMachine:
    """Kept buckets with a weight and a factor vector each, and a bias."""

    buckets: np.ndarray
    weight: np.ndarray
    factors: np.ndarray
    bias: float

    def logits(self, doc: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """doc and slot: distinct pairs, sorted by doc."""
        out = np.full(n, self.bias) + np.bincount(doc, self.weight[slot], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[slot, f]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out

    def slots(self) -> np.ndarray:
        """From bucket to position in the arrays, -1 where not kept."""
        at = np.full(2 * WORDS, -1, np.int32)
        at[self.buckets] = np.arange(len(self.buckets))
        return at


def _pairs(doc: np.ndarray, item: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc * width + item)
    return both // width, both % width


def _marginal(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Buckets on which the label depends, either way."""
    rate = y.mean()
    df = np.bincount(bucket, minlength=2 * WORDS)
    dp = np.bincount(bucket[y[doc] == 1], minlength=2 * WORDS)
    expect = df * rate
    chi = (dp - expect) ** 2 / np.maximum(expect * (1 - rate) * (1 - df / (len(y) + 1)), 1e-9)
    return np.flatnonzero((df >= 3) & (chi > CHI))


def _joint(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, cells: int = 1 << 20) -> np.ndarray:
    """Words on whose standing side by side the label depends more than on either.

    All rows of the rarer label are counted, and of the other one those whose
    words hash to 0 modulo how often it is commoner, weighted by that. Counts
    are exact, by blocks of words; a block and its pairs take bounded room.
    """
    n, positive = len(y), int(y.sum())
    step = max(1, max(positive, n - positive) // min(positive, n - positive))
    mark = np.zeros(n, np.uint64)
    np.add.at(mark, doc, mix(bucket.astype(np.uint64)))
    use = (y == (positive <= n - positive)) | (mix(mark) % np.uint64(step) == 0)
    weight = np.array([1, 1]) * np.where(np.arange(2) == (positive <= n - positive), 1, step)
    pick = use[doc] & (bucket < WORDS)
    doc, bucket = doc[pick], bucket[pick]
    df = [np.bincount(bucket[y[doc] == k], minlength=WORDS) * weight[k] for k in (0, 1)]
    rate, base = df[1] / np.maximum(df[0] + df[1], 1), positive / n
    words = np.flatnonzero(np.maximum(df[0] // weight[0], df[1] // weight[1]) >= PAIR_ROWS)
    at = np.full(WORDS, -1, np.int64)
    at[words] = np.arange(len(words))
    doc, word = doc[at[bucket] >= 0], at[bucket[at[bucket] >= 0]]
    order = np.lexsort((word, doc))
    doc, word = doc[order], word[order]
    first = np.searchsorted(doc, np.arange(n + 1))
    rate, t = np.clip(rate[words], base, 0.98), len(words)
    by_word = np.argsort(word, kind="stable")
    ends = np.cumsum(np.bincount(word, minlength=t))
    found, block = np.zeros(t, bool), max(1, cells // max(t, 1))
    for i in range(0, t, block):
        z = min(t, i + block)
        counts = [np.zeros((z - i) * t, np.int64), np.zeros((z - i) * t, np.int64)]
        places = by_word[ends[i] - (ends[i] - (ends[i - 1] if i else 0)) : ends[z - 1]]
        after = first[doc[places] + 1] - places - 1  # the words of the same text that come later
        total = np.cumsum(after)
        s = 0
        while s < len(places):
            e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + cells, "right")))
            p, k = places[s:e], after[s:e]
            other = np.repeat(p + 1 - (np.cumsum(k) - k), k) + np.arange(k.sum())
            key = np.repeat((word[p] - i) * t, k) + word[other]
            label = np.repeat(y[doc[p]], k)
            for c in (0, 1):
                np.add(counts[c], np.bincount(key[label == c], minlength=len(counts[c])), out=counts[c])
            s = e
        some = np.flatnonzero(np.maximum(*counts) >= PAIR_ROWS)
        a, b = some // t + i, some % t
        have = counts[1][some] * weight[1]
        both = have + counts[0][some] * weight[0]
        r = np.maximum(rate[a], rate[b])
        # what the larger of both rates leaves unexplained
        chi = (have - both * r) ** 2 / (both * r * (1 - r) * weight.max())
        for x in (a, b):
            found[x[chi > PAIR_CHI]] = True
    return words[found]


def fit(
    doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, factors: int = 4, steps: int = 150, decay: float = 1e-4
) -> FactorizationMachine:
    """From distinct (doc, bucket) pairs and labels 0 or 1. Without both labels
    the model is a constant: their mean, drawn towards 0.5."""
    n, positive = len(y), int(y.sum())
    prior = (positive + 0.5) / (n + 1)
    bias = float(np.log(prior / (1 - prior)))
    none = FactorizationMachine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)), bias)
    if positive in (0, n):
        return none
    kept = np.union1d(_marginal(doc, bucket, y), _joint(doc, bucket, y))
    if not len(kept):
        return none
    at = np.full(2 * WORDS, -1, np.int32)
    at[kept] = np.arange(len(kept))
    use = at[bucket] >= 0
    doc, slot = doc[use], at[bucket[use]]
    rng = np.random.default_rng(7)
    w, v = np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), factors))
    params = [w, v, np.array([bias])]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        model = FactorizationMachine(kept, params[0], params[1], float(params[2][0]))
        err = 1 / (1 + np.exp(-np.clip(model.logits(doc, slot, n), -500, 500))) - y
        err /= n
        e = err[doc]
        grads = [np.bincount(slot, e, len(kept)) + decay * params[0] / len(kept), np.empty_like(params[1]), np.array([err.sum()])]
        for f in range(factors):
            vf = params[1][slot, f]
            rest = np.bincount(doc, vf, n)[doc] - vf
            grads[1][:, f] = np.bincount(slot, e * rest, len(kept)) + decay * params[1][:, f] / len(kept)
        for p, g, a, b in zip(params, grads, m1, m2):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= 0.1 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-9)
    return FactorizationMachine(kept, params[0], params[1], float(params[2][0]))


def _features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        buf, offs = buffer_of(batch.column(0))
        for a, z, b, o in slices(buf, offs):
            doc, bucket = _pairs(*term_buckets(b, o), 2 * WORDS)
            cut = np.searchsorted(doc, np.arange(z - a + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket.astype(np.int32)))
            yield pa.record_batch({"y": batch.column(1).slice(a, z - a), "buckets": lists})


def train(sample: DataFrame, **how) -> FactorizationMachine:
    """From (text, y) rows, as labelled_sample gives them."""
    table = sample.select("text", "y").mapInArrow(_features, "y int, buckets array<int>").toArrow()
    y = table["y"].to_numpy().astype(np.int8)
    lists = table["buckets"].combine_chunks()
    del table
    doc = np.repeat(np.arange(len(y), dtype=np.int32), lists.value_lengths().to_numpy())
    return fit(doc, lists.flatten().to_numpy(), y, **how)


def _logits(text: pa.Array, model: FactorizationMachine, at: np.ndarray) -> np.ndarray:
    k = max(1, len(model.buckets))
    buf, offs = buffer_of(text)
    out = np.empty(len(text))
    for a, z, b, o in slices(buf, offs):
        doc, bucket = term_buckets(b, o)
        slot = at[bucket]
        use = slot >= 0
        doc, slot = _pairs(doc[use], slot[use].astype(np.int64), k)
        out[a:z] = model.logits(doc, slot, z - a)
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _score(rows: Iterator[pa.RecordBatch], model: FactorizationMachine) -> Iterator[pa.RecordBatch]:
    at = model.slots()
    for batch in batches(rows):
        yield pa.record_batch({"id": batch.column(0), "score": pa.array(_logits(batch.column(1), model, at))})


def _keep(rows: Iterator[pa.RecordBatch], model: FactorizationMachine, text_at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    at = model.slots()
    for batch in batches(rows):
        yield batch.filter(pa.array(_logits(batch.column(text_at), model, at) < threshold))


def _model(docs, labels, id_col, text_col, label_col, sample, folds, held, how) -> FactorizationMachine:
    bounded_batches(docs.sparkSession)
    sampled = labelled_sample(docs, labels, id_col, text_col, label_col, sample, id_remainder("id", folds) != held)
    return train(sampled, **how)


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.7,
    sample: int = 20_000,
    folds: int = 3,
    held: int = 1,
    **how,
) -> DataFrame:
    """docs, all columns, without the rows that score_toxicity predicts as 1: one
    scan, nothing shuffled or joined."""
    model = _model(docs, labels, id_col, text_col, label_col, sample, folds, held, how)
    text_at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: _keep(it, model, text_at, threshold), docs.schema)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.7,
    sample: int = 20_000,
    folds: int = 3,
    held: int = 1,
    **how,
) -> DataFrame:
    """Per row of docs: the id, held_out, score (0 to 1) and predicted.

    The model learns only from labelled rows whose crc32(id as text) modulo
    folds isn't held, `sample` of them at most. Scores use nothing but the text;
    null and empty texts get the bias. Rows that repeat an id get a row each; a
    null id scores too and isn't held out. Without labels of both kinds, all
    scores are equal. An empty table gives an empty table.
    """
    rest = id_remainder("id", folds)
    model = _model(docs, labels, id_col, text_col, label_col, sample, folds, held, how)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _score(it, model), "id long, score double").select(
        F.col("id").alias(id_col),
        F.coalesce(rest == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
