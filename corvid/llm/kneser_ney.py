"""Interpolated modified Kneser-Ney n-gram model, counted and looked up in Spark.

1. Words of the training texts are counted (distinct hashes of a task's texts
   first, then Spark's aggregate) and stored as sorted hash arrays; a word's
   number is its place in them.
2. A task gathers the n-grams of a group of texts, those to score and those to
   learn from alike, as word numbers. It writes which of the group's distinct
   n-grams each token has to the shared folder and sends each shard one packed
   array of n-grams with their training counts. A shard is a hash of the word
   before the last; if that word has `hot` tokens or more, one of some shards from
   there on, by a hash of the last two, and of more the more tokens it has: so no
   word makes a shard much larger than others. All n-grams that end in the same
   two words meet in a shard, so it counts there too how many words precede each
   shorter n-gram. It keeps the packed arrays on the shared folder and passes on
   its counts of counts, from which the discounts come.
3. Contexts spread over shards have their totals added up by a second, small
   shuffle, and words the number of words that precede them by a third.
4. A task for each shard reads its arrays again, works out the probability of
   each n-gram and sends every group its own; there the tokens' are added up.
   So no text looks anything up in the model: work and reading grow with the
   n-grams alone, however many shards there are and whether they fit in memory.

Texts begin with order - 1 start symbols. The highest order discounts counts,
the lower ones numbers of preceding words; discounts come from the counts of
counts of each order. The lowest is interpolated with a uniform one over all
training words and one unseen, so that probabilities sum to one. log10 of a
probability travels in 40 bits, rounded to a multiple of 2^-32.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashstore
from .hashstore import HashStore, batches
from .labelled import id_remainder
from .shared import bounded_batches, discard, free_shuffles, fresh_path, materialize
from .textops import NOT_SPACE, SLICE, U, buffer_of, mix, owners, prefix_sums, range_hashes, signed, slices, spans

END = mix(np.array([0xE0D], np.uint64))[0]
UNK, START, STOP, WORDS_FROM = 0, 1, 2, 3
ORDERS = (2, 3, 4)
LEAST_PER_FILE = 4096  # words in a file of step 3
LEAST_SPREAD = U(8)  # shards of a word with `hot` tokens
FLUSH = 1_000_000  # distinct n-grams that a task gathers before it sends them
PLACES, WIDE = 32, 5  # binary places of log10 of a probability, bytes it travels in
TOTALS = ("total", "one", "two", "more")
GROUP = ("part", "number", "mark")  # a group's task, its number there and a hash of what it holds


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an END after each text, and each text's first token."""
    starts, ends, ptr = spans(buf, offs, NOT_SPACE)
    h = range_hashes(prefix_sums(buf, lower=True), starts, ends)
    n = len(offs) - 1
    out = np.full(len(h) + n, END, np.uint64)
    out[np.arange(len(h)) + owners(ptr)] = h
    return out, ptr + np.arange(n + 1)


# ---- words


def _count_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[np.ndarray] = []
    tally: list[np.ndarray] = []

    def merge() -> None:
        keys = np.concatenate([k for k in parts])
        n = np.concatenate([k for k in tally])
        keys, back = np.unique(keys, return_inverse=True)
        parts[:], tally[:] = [keys], [np.bincount(back, n, len(keys)).astype(np.int64)]

    def flush() -> pa.RecordBatch:
        merge()
        return pa.record_batch({"key": pa.array(signed(parts.pop())), "n": pa.array(tally.pop())})

    for batch in batches(rows):
        buf, offs = buffer_of(batch.column(0))
        for _, _, b, o in slices(buf, offs, 2 * SLICE):
            keys, n = np.unique(tokens(b, o)[0], return_counts=True)
            parts.append(keys)
            tally.append(n)
            if sum(map(len, parts)) > 2 * FLUSH:
                merge()
                if len(parts[0]) > FLUSH:
                    yield flush()
    if parts:
        yield flush()


@dataclass
class Vocabulary:
    """Training words with their counts and numbers, by hash."""

    store: HashStore
    n_words: int
    n_texts: int
    n_tokens: int

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and numbers of tokens; unseen words have count 0 and number UNK."""
        uniq, back = np.unique(hashes, return_inverse=True)
        got = self.store.get(uniq, n=np.int64(0))
        n, number = got["n"], np.where(got["found"], got["row"] + WORDS_FROM, UNK)
        if self.n_texts:
            n[uniq == END], number[uniq == END] = self.n_texts, STOP
        return n[back], number[back]


def build_vocabulary(training: DataFrame) -> Vocabulary:
    """From a table with one column, the texts."""
    counts = training.mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "words")
    end = int(signed(np.array([END]))[0])
    size = counts.agg(
        F.sum("n").alias("tokens"), F.count_if(F.col("key") != end).alias("words"), F.max(F.when(F.col("key") == end, F.col("n"))).alias("texts")
    ).first()
    if size.words >= 2**32 - WORDS_FROM:
        raise ValueError("more words than 32 bits number")
    store, _ = hashstore.build(counts.where(F.col("key") != end), size.words, "often")
    discard(counts)
    return Vocabulary(store, size.words, size.texts or 0, size.tokens or 0)


# ---- n-grams as columns: ends = word before the last << 32 | last word, rest = the words before those


@dataclass
class Grams:
    """n-grams; rest holds the third last word, with order 4 the fourth last above it."""

    ends: np.ndarray
    rest: np.ndarray
    hot: np.ndarray  # 0, or k + 1 if the word before the last is spread over LEAST_SPREAD << k shards

    def take(self, at: np.ndarray) -> Grams:
        return Grams(self.ends[at], self.rest[at], self.hot[at])

    def shorter(self, order: int) -> Grams:
        """The last `order` words of each."""
        return Grams(self.ends, self.rest & U((1 << 32 * (order - 2)) - 1), self.hot)

    def identity(self) -> np.ndarray:
        return mix(self.ends * U(0x9E3779B97F4A7C15) + mix(self.rest))

    def contexts(self, order: int) -> np.ndarray:
        return mix(mix(self.rest + U(order << 56)) + (self.ends >> U(32)) * U(0xC6A4A7935BD1E995))

    def shard(self, shards: int) -> np.ndarray:
        step = mix(self.ends + U(0x5BD1E995)) & ((LEAST_SPREAD << np.maximum(self.hot, 1).astype(np.uint64) - U(1)) - U(1))
        first = mix((self.ends >> U(32)) + U(0x5BD1E995)) % U(shards)
        return ((first + np.where(self.hot > 0, step, U(0))) % U(shards)).astype(np.int64)


def ngrams(hashes: np.ndarray, ptr: np.ndarray, vocab: Vocabulary, order: int, hot: int) -> tuple[Grams, np.ndarray]:
    """The n-gram that ends at each token, and the tokens' counts."""
    n, number = vocab.numbers(hashes)
    number = number.astype(np.uint64)

    def back(values: np.ndarray, first) -> np.ndarray:
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[ptr[:-1]] = first
        return out

    before = back(number, U(START))
    ends, heavy = before << U(32) | number, np.searchsorted(hot << np.arange(24), back(n, vocab.n_texts), "right").astype(np.uint8)
    rest = np.zeros(len(number), np.uint64)
    for k in range(order - 2):
        before = back(before, U(START))
        rest |= before << U(32 * k)
    return Grams(ends, rest, heavy), n


def distinct(g: Grams, counts: np.ndarray) -> tuple[Grams, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams with their counts added up, their identities, ascending, and which of them each one given is."""
    h = g.identity()
    order = np.argsort(h)
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first, back = np.flatnonzero(new), np.empty(len(h), np.uint32)
    back[order] = np.cumsum(new) - 1
    return g.take(order[first]), _sums(counts[order], first), h[first], back


def merged(g: Grams, counts: np.ndarray) -> tuple[Grams, np.ndarray]:
    return distinct(g, counts)[:2]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs that begin at the places given."""
    return np.add.reduceat(values, first) if len(first) else values[:0]


def pack(g: Grams, counts: np.ndarray, order: int) -> bytes:
    """n-grams, by their last two words: differences, words and counts as planes of bytes, compressed."""
    by = np.argsort(g.ends, kind="stable")  # keeps the order of those that come sorted
    ends = g.ends[by]
    ends[1:] -= ends[:-1].copy()
    planes = [ends.view(np.uint8).reshape(-1, 8).T.ravel(), counts[by].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.ravel(), g.hot[by].view(np.uint8)]
    if order > 2:
        rest = g.rest[by].view(np.uint8).reshape(-1, 8)[:, : 4 * (order - 2)]
        planes.append(rest.T.ravel())
    return len(counts).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes))


def unpack(blob: bytes, order: int) -> tuple[Grams, np.ndarray]:
    n, wide = int.from_bytes(blob[:8], "little"), 4 * (order - 2)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=(13 + wide) * n), np.uint8)
    ends = np.cumsum(np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
    counts = np.ascontiguousarray(planes[8 * n : 12 * n].reshape(4, n).T).view(np.uint32).ravel().astype(np.int64)
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :wide] = planes[13 * n :].reshape(wide, n).T
    return Grams(ends, rest.view(np.uint64).ravel(), planes[12 * n : 13 * n].copy()), counts


class Tally:
    """n-grams and counts of many arrays of distinct ones, merged now and then."""

    def __init__(self):
        self.parts: list[tuple[Grams, np.ndarray]] = []
        self.held = 0

    def add(self, g: Grams, counts: np.ndarray) -> None:
        self.parts.append((g, counts))
        self.held += len(counts)

    def merge(self) -> tuple[Grams, np.ndarray]:
        """By identity."""
        if not self.parts:
            return Grams(*(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint8))), np.zeros(0, np.int64)
        self.parts = [merged(*joined(self.parts))]
        self.held = len(self.parts[0][1])
        return self.parts[0]


def joined(parts: list[tuple[Grams, np.ndarray]]) -> tuple[Grams, np.ndarray]:
    """One after the other; empties the list."""
    *columns, counts = [np.concatenate(x) for x in zip(*((g.ends, g.rest, g.hot, c) for g, c in parts))]
    parts.clear()
    return Grams(*columns), counts


def _squeeze(x: np.ndarray) -> np.ndarray:
    """Planes of bytes, compressed."""
    return np.frombuffer(zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.ravel()), np.uint8)


def _text_path(path: str, part: int, number: int, mark: int) -> str:
    return f"{path}/texts-{part:06d}-{number:06d}-{mark & (2**64 - 1):016x}"


class Group:
    """Texts, the distinct n-grams in them, and which one each token has."""

    def __init__(self, most: int):
        self.tally, self.seen, self.texts, self.n_tokens, self.most = Tally(), [], [], 0, most

    def add(self, g: Grams, counts: np.ndarray, texts: list[np.ndarray]) -> None:
        g, counts, h, back = distinct(g, counts)
        self.tally.add(g, counts)
        self.seen.append((h, back))
        self.texts.append(texts)
        self.n_tokens += len(back)

    def full(self) -> bool:
        if self.tally.held > 2 * self.most:
            self.tally.merge()
            return self.tally.held > self.most or self.n_tokens > 8 * self.most
        return self.n_tokens > 8 * self.most

    def send(self, path: str, part: int, number: int, order: int, shards: int) -> pa.RecordBatch:
        """Writes the texts; gives each shard its n-grams, by their last two words."""
        g, counts = self.tally.merge()
        h, by = g.identity(), np.argsort(g.ends, kind="stable")
        by = by[np.argsort(g.shard(shards)[by], kind="stable")]
        place = np.empty(len(by), np.uint32)
        place[by] = np.arange(len(by), dtype=np.uint32)
        at = np.concatenate([place[np.searchsorted(h, own)][back] for own, back in self.seen])
        texts = [np.concatenate(c) for c in zip(*self.texts)]
        mark = hashlib.blake2b(at, digest_size=8)
        for c in texts[:-1]:  # the last are sums, which another processor may round otherwise
            mark.update(c)
        mark = int.from_bytes(mark.digest(), "little", signed=True)
        sizes = np.array([len(texts[0]), len(at), len(by)], np.int64)
        hashstore._write(_text_path(path, part, number, mark) + ".arrow", {"sizes": sizes, "at": _squeeze(at), "texts": np.frombuffer(_blob(*texts), np.uint8)})
        g, counts = g.take(by), counts[by]
        cuts = np.searchsorted(g.shard(shards), np.arange(shards + 1))
        some = np.flatnonzero(np.diff(cuts))
        blobs = [pack(g.take(slice(cuts[s], cuts[s + 1])), counts[cuts[s] : cuts[s + 1]], order) for s in some]
        own = [pa.array(np.full(len(some), x), t) for x, t in ((part, pa.int32()), (number, pa.int32()), (mark, pa.int64()))]
        return pa.record_batch({"shard": pa.array(some, pa.int32())} | dict(zip(GROUP, own)) | {"blob": pa.array(blobs, pa.binary())})


def _gather(rows: Iterator[pa.RecordBatch], vocab: Vocabulary, path: str, order: int, shards: int, hot: int, most: int) -> Iterator[pa.RecordBatch]:
    """From rows of an id, whether it is held out, and a text; a group has `most` distinct n-grams or a little more."""
    floor = np.log10(vocab.n_tokens + vocab.n_words + (vocab.n_texts > 0) + 1)
    part, number, group = TaskContext.get().partitionId(), 0, Group(most)
    for batch in batches(rows):
        ids, held = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        buf, offs = buffer_of(batch.column(2))
        for a, z, b, o in slices(buf, offs, 2 * SLICE):
            hashes, ptr = tokens(b, o)
            g, n = ngrams(hashes, ptr, vocab, order, hot)
            sizes = np.diff(ptr).astype(np.int64)
            known = np.add.reduceat((n > 0).astype(np.int64), ptr[:-1])
            base = np.add.reduceat(np.log10(n + 1) - floor, ptr[:-1])
            group.add(g, np.repeat(~held[a:z], sizes).astype(np.int64), [ids[a:z].view(np.uint64), none[a:z].astype(np.uint64), sizes, known, base.view(np.uint64)])
            if group.full():
                yield group.send(path, part, number, order, shards)
                number, group = number + 1, Group(most)
    if group.texts:
        yield group.send(path, part, number, order, shards)


# ---- shards


def _totals(contexts: np.ndarray, counts: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """By context, ascending: the sum of counts, and how many are 1, 2 and more; and which context each one given is."""
    keys, owner = np.unique(contexts, return_inverse=True)
    columns = counts, counts == 1, counts == 2, counts > 2
    return {"key": keys} | {k: np.bincount(owner, c, len(keys)).astype(np.int64) for k, c in zip(TOTALS, columns)}, owner


def shortened(g: Grams, counts: np.ndarray, order: int) -> tuple[Grams, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of the order below with how many of those given that training texts hold end in each, as distinct() does."""
    return distinct(g.shorter(order), (counts > 0).astype(np.int64))


def _blob(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([c.astype(np.uint64) for c in columns]).view(np.uint8).reshape(-1, 8).T.ravel())


def _columns(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).reshape(n, -1)


COUNTED = 5  # counts 1 to 4 and all else
PIECES = "kind int, part int, blob binary, k int, " + ", ".join(f"c{i} long" for i in range(1, COUNTED + 1))


def _spread(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, COUNTED), minlength=COUNTED + 1)[1:].tolist()


def _kept(table: pa.Table, path: str) -> None:
    """Writes the packed arrays that a shard got, with their groups."""
    blobs = [b.as_py() for b in table["blob"]]
    groups = {c: table[c].to_numpy() for c in GROUP}
    hashstore._write(path, groups | {"size": np.array([len(b) for b in blobs], np.int64), "bytes": np.frombuffer(b"".join(blobs), np.uint8)})


def _merge_shard(table: pa.Table, path: str, order: int, per_file: int, carry_bits: int, most: int) -> pa.Table:
    """Keeps a shard's arrays. Rows: kind 0, totals of spread contexts by
    their parts; kind 1, how many words precede a word, by files of step 3; kind
    2, counts of counts of order k."""
    shard, tally = table["shard"][0].as_py(), Tally()
    _kept(table, f"{path}/{shard:06d}.arrow")
    for blob in table["blob"]:
        g, counts = unpack(blob.as_py(), order)
        if len(some := np.flatnonzero(counts)):
            tally.add(g.take(some), counts[some])
        if tally.held > 4 * most:
            tally.merge()
    rows, (g, counts) = [], tally.merge()
    for k in range(order, 1, -1):
        if k < order:
            g, counts = shortened(g, counts, k)[:2]
        rows.append({"kind": 2, "part": -1, "blob": None, "k": k} | {f"c{i + 1}": n for i, n in enumerate(_spread(counts))})
        if len(spread := np.flatnonzero(g.hot)):
            carried, _ = _totals(g.take(spread).contexts(k), counts[spread])
            part = (carried["key"] >> U(64 - carry_bits)).astype(np.int64) if carry_bits else np.zeros(len(carried["key"]), np.int64)
            cuts = np.searchsorted(part, np.arange((1 << carry_bits) + 1))
            rows += [{"kind": 0, "part": int(p), "blob": _blob(*(c[cuts[p] : cuts[p + 1]] for c in carried.values()))} for p in np.flatnonzero(np.diff(cuts))]
    words, n = np.unique(g.ends & U(0xFFFFFFFF), return_counts=True)
    if len(words):
        cuts = np.searchsorted(words, np.arange(0, (int(words[-1]) // per_file + 2) * per_file, per_file).astype(np.uint64))
        rows += [{"kind": 1, "part": f, "blob": _blob(words[a:b], n[a:b])} for f, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), *[pa.int64()] * COUNTED]
    return pa.Table.from_pylist(rows, pa.schema(list(zip(names, kinds))))


def _merge_piece(table: pa.Table, path: str, per_file: int) -> pa.Table:
    """Adds up the totals of a part of the spread contexts, or a file's words."""
    kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
    if kind == 0:
        c = np.concatenate([_columns(b.as_py(), 1 + len(TOTALS)) for b in table["blob"]], axis=1)
        by = np.argsort(c[0])
        c = c[:, by]
        first = np.flatnonzero(np.concatenate([[True], c[0, 1:] != c[0, :-1]]))
        sums = [np.add.reduceat(x.astype(np.int64), first) for x in c[1:]]
        hashstore._write(f"{path}/totals-{part:06d}.arrow", {"key": c[0, first]} | dict(zip(TOTALS, sums)))
        counts = np.zeros(0, np.int64)
    else:
        counts = np.zeros(per_file, np.int64)
        for b in table["blob"]:
            words, n = _columns(b.as_py(), 2).astype(np.int64)
            np.add.at(counts, words - part * per_file, n)
        hashstore._write(f"{path}/words-{part:06d}.arrow", {"before": counts})
    row = {f"c{i + 1}": [n] for i, n in enumerate(_spread(counts[counts > 0]))} | {"types": [int(counts.sum())]}
    return pa.table(row)


def discounts(c1: int, c2: int, c3: int, c4: int) -> np.ndarray:
    """For counts 1, 2 and 3 or more, from how many keys have counts 1 to 4."""
    y = c1 / (c1 + 2 * c2) if c1 else 0.5
    ratios = [(k, c_next / c if c else 0.5) for k, c, c_next in ((1, c1, c2), (2, c2, c3), (3, c3, c4))]
    return np.array([0.0] + [min(max(k - (k + 1) * y * r, 0.05), k - 0.05) for k, r in ratios])


class NgramModel:
    """A fitted model's files; opens them where it is used."""

    def __init__(self, path: str, order: int, shards: int, per_file: int, carry_bits: int, vocab: Vocabulary, cuts: dict[int, np.ndarray], types: int, low_mass: float, most: int):
        self.path, self.order, self.shards, self.per_file, self.vocab = path, order, shards, per_file, vocab
        self.cuts, self.types, self.low_mass, self.most = cuts, types, low_mass, most
        self.files, self.totals = hashstore.Files(path), HashStore(path, carry_bits, "totals-")

    def _words(self, words: np.ndarray) -> np.ndarray:
        """How many words precede each."""
        out = np.zeros(len(words), np.int64)
        file = words // self.per_file
        for f in np.unique(file):
            if rows := self.files.get(f"words-{f:06d}"):
                at = np.flatnonzero(file == f)
                out[at] = rows["before"][words[at] - f * self.per_file]
        return out

    def _level(self, g: Grams, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct n-grams of order k: the discounted share, and the share left to the order below."""
        cut = self.cuts[k]
        sums, owner = _totals(g.contexts(k), counts)
        spread = np.zeros(len(sums["key"]), bool)
        spread[owner[g.hot > 0]] = True
        if len(hot := np.flatnonzero(spread)):
            v = self.totals.get(sums["key"][hot], **dict.fromkeys(TOTALS, np.int64(0)))
            for name in TOTALS:
                sums[name][hot] = v[name]
        known = np.maximum(sums["total"], 1)
        left = np.where(sums["total"] > 0, (cut[1] * sums["one"] + cut[2] * sums["two"] + cut[3] * sums["more"]) / known, 1.0)
        return np.maximum(counts - cut[np.minimum(counts, 3)], 0) / known[owner], left[owner]

    def log10(self, g: Grams, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | context) of a shard's distinct n-grams, of which training texts hold `counts`."""
        return np.log10(self._share(g, counts, self.order))

    def _share(self, g: Grams, counts: np.ndarray, k: int) -> np.ndarray:
        if k == 1:
            words, of = np.unique((g.ends & U(0xFFFFFFFF)).astype(np.int64), return_inverse=True)
            before, kinds = self._words(words), self.vocab.n_words + 2  # words, one unseen and the end
            return (np.maximum(before - self.cuts[1][np.minimum(before, 3)], 0) / max(self.types, 1) + self.low_mass / kinds)[of]
        if k == 2:
            below = self._share(g, counts, 1)
        else:
            short, n, _, to = shortened(g, counts, k - 1)
            below = self._share(short, n, k - 1)[to]
        own, left = self._level(g, counts, k)
        return own + left * below

    def answers(self, shard: int) -> Iterator[pa.RecordBatch]:
        """For each group that sent the shard n-grams, log10 of their probabilities, in the group's order."""
        if not (kept := hashstore._read(f"{self.path}/{shard:06d}.arrow")):
            return
        cuts = np.concatenate([[0], np.cumsum(kept["size"])])
        tally, runs, sizes, held = Tally(), [], [], 0  # a run: identities, which of them each n-gram has, the groups so far
        parts: list[tuple[Grams, np.ndarray]] = []
        for j, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
            parts.append(unpack(kept["bytes"][a:z].tobytes(), self.order))
            sizes.append(len(parts[-1][1]))
            held += sizes[-1]
            if held > 4 * self.most or z == cuts[-1]:
                g, counts, h, back = distinct(*joined(parts))
                tally.add(g, counts)
                runs.append((h, back, j + 1))
                held = 0
        if len(runs) > 1:
            g, counts = tally.merge()
        del tally
        every, p = g.identity(), np.rint(-self.log10(g, counts) * 2.0**PLACES).astype(np.uint64)
        del g, counts
        first = 0
        for h, back, last in runs:
            data = np.ascontiguousarray(p[np.searchsorted(every, h)][back].view(np.uint8).reshape(-1, 8)[:, :WIDE])
            offs = np.concatenate([[0], np.cumsum(sizes[first:last])]) * WIDE
            column = pa.Array.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(offs), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.record_batch({"shard": pa.array(np.full(last - first, shard), pa.int32())} | {c: pa.array(kept[c][first:last]) for c in GROUP} | {"blob": column})
            first = last


PACKED = "shard int, part int, number int, mark long, blob binary"


def fit(rows: DataFrame, order: int = 3, shard_tokens: int = 2_000_000, hot: int | None = None) -> NgramModel:
    """A model of the texts that aren't held out, in a table of ids, whether
    they are held out, and texts; its folder has all that scores the others too.
    A shard holds about shard_tokens n-grams; words with hot tokens (a quarter of
    it, if not given) are spread over shards."""
    if order not in ORDERS:
        raise ValueError(f"the order must be one of {ORDERS}")
    spark = rows.sparkSession
    vocab = build_vocabulary(rows.where("not held_out").select("text"))
    free_shuffles(spark)
    path, hot, most = fresh_path(spark, "ngrams"), hot or max(1, shard_tokens // 4), FLUSH
    shards = max(1, -(-vocab.n_tokens // shard_tokens))
    carry_bits = max(0, (shards - 1).bit_length() - 2)  # fewer parts than shards, as each shard sends each part a row
    # as many files as shards: what words are told by the shards stays bounded per file
    per_file = max(LEAST_PER_FILE, -(-(vocab.n_words + WORDS_FROM) // shards))
    packed = rows.mapInArrow(lambda it: _gather(it, vocab, path, order, shards, hot, most), PACKED)
    by_shard = packed.repartition(shards, "shard").groupBy("shard")
    pieces = materialize(by_shard.applyInArrow(lambda t: _merge_shard(t, path, order, per_file, carry_bits, most), PIECES), "shards")
    free_shuffles(spark)
    sums = [F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(1, COUNTED + 1)]
    cuts = {r.k: discounts(r.c1, r.c2, r.c3, r.c4) for r in pieces.where("kind = 2").groupBy("k").agg(*sums).collect()}  # a row per order
    low = (
        pieces.where("kind < 2").select("kind", "part", "blob").repartition(shards, "kind", "part").groupBy("kind", "part")
        .applyInArrow(lambda t: _merge_piece(t, path, per_file), ", ".join(f"c{i} long" for i in range(1, COUNTED + 1)) + ", types long")
        .agg(*sums, F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    )
    discard(pieces)
    cuts = {k: cuts.get(k, discounts(0, 0, 0, 0)) for k in range(2, order + 1)} | {1: discounts(low.c1, low.c2, low.c3, low.c4)}
    mass = float(cuts[1][1:] @ np.array([low.c1, low.c2, low.c3 + low.c4 + low.c5])) / low.types if low.types else 1.0
    free_shuffles(spark)  # the packed arrays: the first call comes too early for them
    return NgramModel(path, order, shards, per_file, carry_bits, vocab, cuts, low.types, mass, most)


def _answer(rows: Iterator[pa.RecordBatch], model: NgramModel) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        for shard in batch.column(0).to_pylist():
            yield from model.answers(shard)


def _add_up(table: pa.Table, path: str) -> pa.Table:
    """A group's texts with their scores."""
    part, number, mark = (table[c][0].as_py() for c in GROUP)
    kept = hashstore._read(_text_path(path, part, number, mark) + ".arrow")
    n_texts, n_tokens, n_grams = kept["sizes"].tolist()
    blobs = [table["blob"][int(j)].as_py() for j in np.argsort(table["shard"].to_numpy())]
    p = np.zeros((sum(map(len, blobs)) // WIDE, 8), np.uint8)
    p[:, :WIDE] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, WIDE)
    if len(p) != n_grams:  # part of the shuffle was done again, over rows in another order
        raise RuntimeError(f"a group of texts has {n_grams} n-grams and was told of {len(p)}: the table's rows must come in the same order each time")
    p = p.view(np.uint64).ravel().astype(np.float64) / 2.0**PLACES
    at = np.frombuffer(zstandard.ZstdDecompressor().decompress(kept["at"].tobytes()), np.uint8)
    at = np.ascontiguousarray(at.reshape(4, n_tokens).T).view(np.uint32).ravel()
    ids, none, sizes, known, base = _columns(kept["texts"].tobytes(), 5)
    sizes = sizes.astype(np.int64)
    return pa.table(
        {
            "id": pa.array(ids.view(np.int64), mask=none > 0),
            "n_tokens": pa.array(sizes),
            "n_known": pa.array(known.astype(np.int64)),
            "base_score": pa.array(base.view(np.float64)),
            "score": pa.array(-np.add.reduceat(p[at], np.cumsum(sizes) - sizes)),
        }
    )


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held: int = 2,
    order: int = 3,
    shard_tokens: int = 2_000_000,
    hot: int | None = None,
) -> DataFrame:
    """Per row of docs: the id, held_out, n_tokens, n_known, train_tokens,
    base_score, score and perplexity.

    The models learn from rows whose crc32(id as text) modulo folds isn't held
    (rows without an id are learned from). A text's tokens are its words, A-Z
    folded, and one end. base_score is the add-one unigram log10 probability,
    score that of the Kneser-Ney model of the given order (2 to 4), perplexity
    10^(-score / n_tokens). All training words are counted as themselves. Null
    and empty texts have the end alone. Rows that repeat an id count and score
    as rows of their own. With no training row all probabilities are uniform.
    An empty table gives an empty table. shard_tokens and hot shape the work and
    change no result.
    """
    bounded_batches(docs.sparkSession)
    held_out = F.coalesce(id_remainder("id", folds) == held, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).select("id", held_out.alias("held_out"), "text")
    model = fit(rows, order, shard_tokens, hot)
    answers = docs.sparkSession.range(0, model.shards, 1, model.shards).mapInArrow(lambda it: _answer(it, model), PACKED)
    scored = answers.repartition(model.shards, *GROUP).groupBy(*GROUP).applyInArrow(
        lambda t: _add_up(t, model.path), "id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        F.col("id").alias(id_col), held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.vocab.n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
