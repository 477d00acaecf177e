"""Benchmark decontamination: single-word seeds without loss, then Smith-Waterman.

1. For a block of test items, one scan of the corpus counts how often each of
   the items' words stands in it. An alignment that reaches the threshold
   matches at least m of an item's L words, so it matches `seeds` of any
   L - m + seeds of them: the rarest so many are the item's seeds. Counts choose
   seeds for speed alone; whichever they are, no alignment is missed.
2. A second scan finds seeds in each text. `seeds` of one item within the
   length that an alignment can have bound a region. There a word of the item
   counts 2 and any other -1; only where such a sum, from some word on, reaches
   the least score can an alignment do so, and that passage is aligned with the
   item word by word (match 2, mismatch -1, gap -1). The best score over the
   greatest possible is the similarity, so copies with words changed, added or
   left out are scored by how much of the item they keep.

Items are streamed and taken in blocks of at most block_words words, each
broadcast with its seeds: that bound holds whatever the benchmark's size, and
more items mean more blocks. Texts are never shuffled; a text's hits stay in its
batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashstore import batches
from .shared import bounded_batches
from .textops import ALNUM_ANY_CASE, U, buffer_of, mix, owners, prefix_sums, range_hashes, slices, spans

MATCH, MISMATCH, GAP = 2, -1, -1


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, ptr = spans(buf, offs, ALNUM_ANY_CASE)
    return range_hashes(prefix_sums(buf, lower=True), starts, ends), ptr


def _pair_keys(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    return mix(words + item.astype(np.uint64) * U(0x9E3779B97F4A7C15))


@dataclass
class Items:
    """A block of items: words, and distinct words with the items that hold them."""

    ids: list
    words: np.ndarray
    ptr: np.ndarray
    keys: np.ndarray  # ascending
    item_ptr: np.ndarray  # of each key's items
    item: np.ndarray
    pairs: np.ndarray  # hashes of (word, item), all of them, ascending
    least: np.ndarray  # score that reaches the threshold, by item
    need: np.ndarray  # seeds that an alignment of this score matches
    span: np.ndarray  # words of a text that it covers at most

    @staticmethod
    def of(ids: list, texts: list[str], seeds: int, threshold: float) -> Items:
        buf, offs = buffer_of(pa.array(texts, pa.string()))
        words, ptr = word_hashes(buf, offs)
        size = np.diff(ptr)
        least = np.maximum(np.ceil(threshold * MATCH * size - 1e-9).astype(np.int64), 1)
        matched = -(-least // MATCH)
        # L words matched at most; then 2 L - least words may stand between them
        out = Items(ids, words, ptr, None, None, None, np.unique(_pair_keys(words, owners(ptr))), least, np.minimum(seeds, matched), 3 * size - least)
        return out.only(np.arange(len(words)))

    def only(self, places: np.ndarray) -> Items:
        """With the words at the given places alone as keys."""
        item = owners(self.ptr)[places]
        _, one = np.unique(_pair_keys(self.words[places], item), return_index=True)
        places, item = places[one], item[one]
        order = np.argsort(self.words[places], kind="stable")
        keys, first = np.unique(self.words[places][order], return_index=True)
        return replace(self, keys=keys, item_ptr=np.append(first, len(places)), item=item[order])

    def rarest(self, n: np.ndarray) -> Items:
        """With the seeds alone, given how often each key stands in the corpus."""
        of_place = n[np.searchsorted(self.keys, self.words)]
        item, size = owners(self.ptr), np.diff(self.ptr)
        order = np.lexsort((of_place, item))
        rank = np.arange(len(order)) - self.ptr[item]
        return self.only(order[rank < (size - -(-self.least // MATCH) + self.need)[item]])

    def lookup(self) -> np.ndarray:
        """A bitmap over 22 bits of the hash that most other words fail."""
        seen = np.zeros(1 << 22, bool)
        seen[(self.keys >> U(42)).astype(np.int64)] = True
        return seen


def _word_hits(words, items: Items, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and key numbers of the items' words in a slice."""
    at = np.flatnonzero(seen[(words >> U(42)).astype(np.int64)])
    k = np.minimum(np.searchsorted(items.keys, words[at]), max(0, len(items.keys) - 1))
    ok = items.keys[k] == words[at] if len(items.keys) else np.zeros(len(at), bool)
    return at[ok], k[ok]


def _word_counts(rows: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    seen, total = items.lookup(), np.zeros(len(items.keys), np.int64)
    for batch in batches(rows):
        buf, offs = buffer_of(batch.column(0))
        for _, _, b, o in slices(buf, offs):
            total += np.bincount(_word_hits(word_hashes(b, o)[0], items, seen)[1], minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.record_batch({"word": pa.array(some), "n": pa.array(total[some])})


def smith_waterman(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each a[i] with b[i], for all pairs at once:
    score, and how far into a and b it ends (exclusive).

    A row's dependence on its own left neighbour is a running maximum, since a
    gap costs the same for each word.
    """
    c, la, lb = len(a), max((len(x) for x in a), default=0), max((len(x) for x in b), default=0)
    x, y = np.zeros((c, la), np.uint64), np.ones((c, lb), np.uint64)
    in_x, in_y = np.zeros((c, la), bool), np.zeros((c, lb), bool)
    for i in range(c):
        x[i, : len(a[i])], in_x[i, : len(a[i])] = a[i], True
        y[i, : len(b[i])], in_y[i, : len(b[i])] = b[i], True
    best, end_a, end_b = np.zeros(c, np.int64), np.zeros(c, np.int64), np.zeros(c, np.int64)
    row = np.zeros((c, lb + 1), np.int32)
    ramp = (np.arange(lb + 1) * GAP).astype(np.int32)
    for k in range(la):
        step = np.where((x[:, k : k + 1] == y) & in_y & in_x[:, k : k + 1], MATCH, MISMATCH)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(new - ramp, axis=1) + ramp
        row[:, 1:][~in_y] = 0
        top = row.max(axis=1)
        more = (top > best) & in_x[:, k]
        best[more], end_a[more] = top[more], k + 1
        end_b[more] = row[more].argmax(axis=1)
    return best, end_a, end_b


def _align(pairs: list[tuple], items: Items, words: np.ndarray, threshold: float) -> Iterator[tuple]:
    """(doc, item, score, similarity, doc span, item span) of passages that reach the threshold."""
    pairs.sort(key=lambda p: (p[3] - p[2], p[1]))
    at = 0
    while at < len(pairs):
        end, area = at, 0
        while end < len(pairs) and (end == at or area < 1 << 19):
            area += pairs[end][3] - pairs[end][2] + 1
            end += 1
        part, at = pairs[at:end], end
        a = [items.words[items.ptr[p[1]] : items.ptr[p[1] + 1]] for p in part]
        b = [words[p[2] : p[3]] for p in part]
        score, end_a, end_b = smith_waterman(a, b)
        good = [i for i in range(len(part)) if score[i] >= threshold * MATCH * len(a[i])]
        # the same from the ends backwards gives the starts
        _, back_a, back_b = smith_waterman([a[i][: end_a[i]][::-1] for i in good], [b[i][: end_b[i]][::-1] for i in good])
        for i, ra, rb in zip(good, back_a.tolist(), back_b.tolist()):
            doc, item, lo, _ = part[i]
            yield doc, item, int(score[i]), float(score[i] / (MATCH * len(a[i]))), lo + int(end_b[i]) - rb, lo + int(end_b[i]), int(end_a[i]) - ra, int(end_a[i])


OUT = "id long, item_id long, score long, similarity double, doc_start long, doc_end long, item_start long, item_end long"


HITS = 1 << 21  # seeds' hits held at once, beyond those of one text


def _passages(words: np.ndarray, ptr: np.ndarray, at: np.ndarray, key: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """(doc, item, first word, last word + 1) of all passages in which an
    alignment can reach the least score, given the hits of seeds."""
    count = np.diff(items.item_ptr)[key]
    place = np.repeat(items.item_ptr[key] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    by = np.sort(items.item[place] * len(words) + np.repeat(at, count))
    item, pos = by // len(words), by % len(words)
    i = np.arange(len(pos))
    j = i + items.need[item] - 1
    inside = j < len(pos)
    i, j = i[inside], j[inside]
    near = (item[i] == item[j]) & (pos[j] - pos[i] < items.span[item[i]])
    i, j = i[near], j[near]
    doc = np.searchsorted(ptr, pos[i], "right") - 1
    same_doc = pos[j] < ptr[doc + 1]
    i, j, doc = i[same_doc], j[same_doc], doc[same_doc]
    if not len(i):
        return []
    item = item[i]
    lo = np.maximum(pos[j] - items.span[item] + 1, ptr[doc])
    hi = np.minimum(pos[i] + items.span[item], ptr[doc + 1])
    first = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1])]))
    item, doc, lo, hi = item[first], doc[first], lo[first], hi[np.append(first[1:], len(hi)) - 1]
    out = []
    ends = np.cumsum(hi - lo)
    a = 0
    while a < len(lo):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HITS, "right")))
        out += _dense(words, item[a:z], doc[a:z], lo[a:z], hi[a:z], items)
        a = z
    return out


def _dense(words: np.ndarray, item: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    size = hi - lo + 1  # a place before each region parts it from the one before
    head = np.cumsum(size) - size
    region = np.repeat(np.arange(len(lo)), size)
    pos = np.arange(len(region)) - head[region] + lo[region] - 1
    keys = _pair_keys(words[np.maximum(pos, 0)], item[region])
    k = np.minimum(np.searchsorted(items.pairs, keys), len(items.pairs) - 1)
    weight = np.where(items.pairs[k] == keys, MATCH, max(MISMATCH, GAP)).astype(np.int64)
    weight[head] = -MATCH * (len(region) + 1)
    total = np.cumsum(weight)
    # the greatest sum that ends here: any alignment that ends here scores at most that
    best = total - np.minimum.accumulate(total)
    enough = np.flatnonzero(best >= items.least[item[region]])
    if not len(enough):
        return []
    # a best alignment keeps above 0 from its start on, so it lies in one run of sums above 0
    run = np.maximum.accumulate(np.where(best == 0, np.arange(len(best)), 0))[enough] + 1
    last = np.append(np.flatnonzero(run[1:] != run[:-1]), len(run) - 1)
    start, end, region = run[last], enough[last], region[enough[last]]
    return list(zip(doc[region].tolist(), item[region].tolist(), pos[start].tolist(), (pos[end] + 1).tolist()))


def _leaks(text: pa.Array, items: Items, seen: np.ndarray, threshold: float) -> Iterator[tuple]:
    """(row, item number, score, similarity, spans) of a batch, one per pair."""
    buf, offs = buffer_of(text)
    for a, _, b, o in slices(buf, offs):
        words, ptr = word_hashes(b, o)
        at, key = _word_hits(words, items, seen)
        if not len(at):
            continue
        held = np.concatenate([[0], np.cumsum(np.diff(items.item_ptr)[key])])[np.searchsorted(at, ptr)]
        d, pairs = 0, []
        while d < len(ptr) - 1:
            z = max(d + 1, int(np.searchsorted(held, held[d] + HITS, "right")) - 1)
            x, y = np.searchsorted(at, ptr[[d, z]])
            pairs += _passages(words, ptr, at[x:y], key[x:y], items)
            d = z
        best: dict[tuple, tuple] = {}
        for r in _align(pairs, items, words, threshold):
            if r[:2] not in best or (r[2], -r[4]) > (best[r[:2]][2], -best[r[:2]][4]):
                best[r[:2]] = r
        for d, i, score, sim, s, e, ia, ib in best.values():
            yield a + d, i, score, sim, s - int(ptr[d]), e - int(ptr[d]), ia, ib


def _find(rows: Iterator[pa.RecordBatch], items: Items, threshold: float) -> Iterator[pa.RecordBatch]:
    seen = items.lookup()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
    names = [c.split()[0] for c in OUT.split(", ")]
    for batch in batches(rows):
        ids = batch.column(0)
        out = [(ids[d].as_py(), items.ids[i], *rest) for d, i, *rest in _leaks(batch.column(1), items, seen, threshold)]
        if out:
            yield pa.record_batch({k: pa.array(list(c), t) for k, c, t in zip(names, zip(*out), kinds)})


def _clean(
    rows: Iterator[pa.RecordBatch], items: Items, threshold: float, text_at: int
) -> Iterator[pa.RecordBatch]:
    seen = items.lookup()
    for batch in batches(rows):
        keep = np.ones(batch.num_rows, bool)
        keep[[r[0] for r in _leaks(batch.column(text_at), items, seen, threshold)]] = False
        yield batch.filter(pa.array(keep))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[tuple[list, list]]:
    """Items in the order of their ids; only one block is held at a time."""
    ids, texts, words = [], [], 0
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).dropna().orderBy("i", "t")
    for r in rows.toLocalIterator():
        n = len(r.t.split()) + 1
        if ids and words + n > block_words:
            yield ids, texts
            ids, texts, words = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        words += n
    if ids:
        yield ids, texts


def _rare_items(
    texts: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, seeds: int, threshold: float, block_words: int
) -> Iterator[Items]:
    """Each block's items with their seeds."""
    bounded_batches(texts.sparkSession)
    for ids, words in _blocks(benchmark, item_col, item_text_col, block_words):
        items = Items.of(ids, words, seeds, threshold)
        counted = texts.mapInArrow(lambda it, items=items: _word_counts(it, items), "word long, n long")
        n = np.zeros(len(items.keys), np.int64)
        for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect():  # one row per word of the block at most
            n[r.word] = r.n
        yield items.rarest(n)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    seeds: int = 3,
    threshold: float = 0.5,
    block_words: int = 500_000,
) -> DataFrame:
    """(document, item) pairs whose best alignment reaches the threshold: the
    ids, score, similarity, doc_start, doc_end, item_start, item_end (word
    spans, end exclusive).

    Words are runs of letters, digits and characters beyond ASCII, A-Z folded.
    All such pairs are found, as if every text were aligned with every item;
    `seeds` only weighs scans against alignments. Items with a null id or text,
    or without words, match nothing; null and empty texts hold nothing. Items that share an id are matched each on its own and may
    give a row each; rows of docs that repeat an id, or have none, likewise.
    Empty tables give an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = [rows.sparkSession.createDataFrame([], OUT)]
    for items in _rare_items(rows.select("text"), benchmark, item_col, item_text_col, seeds, threshold, block_words):
        parts.append(rows.mapInArrow(lambda it, items=items: _find(it, items, threshold), OUT))
    found = reduce(DataFrame.unionByName, parts[1:] or parts)
    return found.withColumnsRenamed({"id": id_col, "item_id": item_col})


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    seeds: int = 3,
    threshold: float = 0.5,
    block_words: int = 500_000,
) -> DataFrame:
    """docs, all columns, without the rows for which find_leaks has a pair: two
    scans per block of items, nothing shuffled or joined."""
    at, kept = docs.columns.index(text_col), docs
    texts = docs.select(F.col(text_col).alias("text"))
    for items in _rare_items(texts, benchmark, item_col, item_text_col, seeds, threshold, block_words):
        kept = kept.mapInArrow(lambda it, items=items: _clean(it, items, threshold, at), docs.schema)
    return kept
