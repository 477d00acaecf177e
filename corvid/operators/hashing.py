"""Signed feature hashing: words, word pairs and character 4-grams to vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as T
from ..functions.terms import tokens
from .batches import bounded_batches, by_bytes, give_back

_TERM = re.compile(T.TERMS)
_BASIS, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


LONG = 64  # bytes from which a word is hashed by itself, not as a row of a grid


def fnv1a(words: list[str], state: np.ndarray | None = None) -> np.ndarray:
    """64-bit FNV-1a of each word's UTF-8 bytes, all words a byte at a time;
    state: what the hashes so far are, to go on from there."""
    raw = [w.encode() for w in words]
    h = np.full(len(raw), _BASIS, np.uint64) if state is None else state.copy()
    size = np.array([len(r) for r in raw], np.int64)
    for i in np.flatnonzero(size > LONG):
        x = int(h[i])
        for c in raw[i]:
            x = (x ^ c) * int(_PRIME) & 0xFFFFFFFFFFFFFFFF
        h[i] = x
    short = np.flatnonzero(size <= LONG)
    order = short[np.argsort(-size[short], kind="stable")]
    if not len(order):
        return h
    width = max(1, int(size[order[0]]))
    grid = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in order), np.uint8).reshape(-1, width)
    part, left = h[order], -size[order]
    for k in range(width):
        n = int(np.searchsorted(left, -k, "left"))  # words longer than k
        part[:n] = (part[:n] ^ grid[:n, k]) * _PRIME
    h[order] = part
    return h


def fnv1a_column(c: Column) -> Column:
    """fnv1a as a signed long of the same bits."""

    @pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        kinds = s.fillna("").unique().tolist()
        return s.map(dict(zip(kinds, fnv1a(kinds).view(np.int64).tolist())))

    return run(c)


@dataclass(frozen=True)
class HashingOptions:
    dim: int = 512
    word_ngrams: tuple[int, ...] = (1, 2)
    char_ngrams: int = 4
    sublinear_tf: bool = True
    use_idf: bool = True

    def __post_init__(self) -> None:
        if self.dim <= 0:
            raise ValueError(f"dim must be above 0, not {self.dim}")

    def describe(self) -> str:
        return "hashing to %d" % self.dim

    def fingerprint(self, idf_tag: str = "none") -> str:
        return ":".join(map(str, ("hashing", self.dim, *self.word_ngrams, f"chars{self.char_ngrams}", self.sublinear_tf, idf_tag)))

    def features(self, text: str) -> list[str]:
        words = _TERM.findall(text.lower())
        out = []
        for n in self.word_ngrams:
            out += words if n == 1 else ["_".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        if k := self.char_ngrams:
            for w in words:
                padded = f"#{w}#"
                out += [padded] if len(w) <= k else [padded[i : i + k] for i in range(len(padded) - k + 1)]
        return out


def _counts(texts: list[str], o: HashingOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, sorted, with net signed counts.

    Each distinct word's own hash and character grams, and each distinct pair of
    neighbours, are hashed once; texts then gather them by word number."""
    found, size = tokens(texts)
    kinds = found.dictionary_encode()
    words, ids = kinds.dictionary.to_pylist(), kinds.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    own = fnv1a(words)
    hashes, owner = [], []
    for n in o.word_ngrams:
        run, state, at = ids, own, np.arange(len(ids))
        for k in range(1, n):
            # runs of k words, numbered, and the word after each that lies in the same text
            ok = at + k < len(ids)
            ok[ok] = doc[at[ok]] == doc[at[ok] + k]
            at = at[ok]
            pair, run = np.unique(run[ok] * len(words) + ids[at + k], return_inverse=True)
            state = fnv1a(["_" + words[w] for w in (pair % len(words)).tolist()], state[pair // len(words)]) if len(pair) else state[:0]
        hashes.append(state[run])
        owner.append(doc[at])
    if k := o.char_ngrams:
        grams: dict[str, int] = {}
        of_word, per = [], []
        for w in words:
            padded = f"#{w}#"
            found = [padded] if len(w) <= k else [padded[i : i + k] for i in range(len(padded) - k + 1)]
            of_word += [grams.setdefault(g, len(grams)) for g in found]
            per.append(len(found))
        g, per = fnv1a(list(grams))[np.array(of_word, np.int64)], np.array(per, np.int64)
        first = np.cumsum(per) - per
        count = per[ids]
        hashes.append(g[np.repeat(first[ids] - (np.cumsum(count) - count), count) + np.arange(count.sum())])
        owner.append(np.repeat(doc, count))
    h, doc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, owner))
    sign = np.where(h.astype(np.uint64) >> np.uint64(63), 1, -1)
    at = doc * o.dim + (h.astype(np.uint64) % np.uint64(o.dim)).astype(np.int64)
    if len(texts) * o.dim <= 1 << 22:
        pairs = np.flatnonzero(np.bincount(at, minlength=1))
        net = np.bincount(at, sign)[pairs] if len(pairs) else np.zeros(0)
    else:
        pairs, back = np.unique(at, return_inverse=True)
        net = np.bincount(back, sign, len(pairs))
    return pairs // o.dim, pairs % o.dim, net.astype(np.int64)


def _features(rows: Iterator[pa.RecordBatch], o: HashingOptions) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for part in by_bytes(batch, 1):
            doc, bucket, net = _counts(part.column(1).to_pylist(), o)
            yield pa.record_batch({"chunk_id": part.column(0).take(pa.array(doc)), "bucket": pa.array(bucket.astype(np.int32)), "net": pa.array(net)})
    give_back()


def _sparse(rows: Iterator[pa.RecordBatch], o: HashingOptions) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for part in by_bytes(batch, 1):
            doc, bucket, net = _counts(part.column(1).to_pylist(), o)
            at = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = (pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (bucket, net))
            yield pa.record_batch(dict(zip(("chunk_id", "key", "bucket", "net"), (part.column(0), part.column(2), *lists))))
    give_back()


def _vec_batch(name: str, ids: pa.Array, v: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(v.astype(np.float32).ravel())
    return pa.record_batch({name: ids, "vec": pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), flat)})


def _weighted(rows: Iterator[pa.RecordBatch], e: HashingEmbedder) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for part in (batch.slice(a, 1024) for a in range(0, batch.num_rows, 1024)):
            doc = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy(zero_copy_only=False))
            bucket, net = (part.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            yield _vec_batch("chunk_id", part.column(0), e.weigh(part.num_rows, doc, bucket, net))
    give_back()


def hash_features(chunks: DataFrame, options: HashingOptions = HashingOptions()) -> DataFrame:
    """(chunk_id, bucket, net) for every bucket a chunk touches, also where signs cancel."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    bounded_batches(chunks.sparkSession)
    return chunks.select("chunk_id", "text").mapInArrow(lambda it: _features(it, options), f"chunk_id {kind}, bucket int, net long")


def fit_idf(chunks: DataFrame, options: HashingOptions = HashingOptions()) -> DataFrame:
    """(bucket, df, idf) of the buckets that occur: ln((N+1)/(df+1)) + 1."""
    n = chunks.agg(F.count("*").alias("n"))
    df = hash_features(chunks, options).groupBy("bucket").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("bucket", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


@dataclass
class HashingEmbedder:
    """Vectors of `dim` numbers; idf is held as an array of that many."""

    options: HashingOptions = HashingOptions()
    idf: np.ndarray | None = None
    tag: str = "none"

    def fit(self, chunks: DataFrame) -> HashingEmbedder:
        """Buckets that never occur get the weight of df 0. An empty corpus, or
        use_idf=False, leaves the weights out."""
        o = self.options
        n = chunks.count()
        if not o.use_idf or not n:
            return self
        key = chunks.agg(F.bit_xor(F.xxhash64("chunk_id", "text")).alias("x")).first().x
        return self._fitted(n, key, [(r.bucket, r.idf) for r in fit_idf(chunks, o).collect()])  # dim rows at most

    @property
    def fingerprint(self) -> str:
        return self.options.fingerprint(self.tag)

    def fit_encode(self, chunks: DataFrame) -> tuple[HashingEmbedder, DataFrame, DataFrame]:
        """fit and encode with one pass over the texts. Gives the fitted embedder,
        the vectors (chunk_id, vec), and the table of features, persisted, from
        which both are worked out: unpersist it when the vectors are stored."""
        o, kind = self.options, chunks.schema["chunk_id"].dataType.simpleString()
        bounded_batches(chunks.sparkSession)
        keyed = chunks.select("chunk_id", "text", F.xxhash64("chunk_id", "text").alias("key"))
        rows = keyed.mapInArrow(lambda it: _sparse(it, o), f"chunk_id {kind}, key long, bucket array<int>, net array<int>").persist()
        size = rows.agg(F.count("*").alias("n"), F.bit_xor("key").alias("x")).first()
        fitted = self
        if o.use_idf and size.n:
            found = rows.select(F.explode("bucket").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df")).collect()  # dim rows at most
            fitted = self._fitted(size.n, size.x, [(r.bucket, np.log((size.n + 1) / (r.df + 1)) + 1) for r in found])
        return fitted, rows.select("chunk_id", "bucket", "net").mapInArrow(lambda it: _weighted(it, fitted), f"chunk_id {kind}, vec array<float>"), rows

    def _fitted(self, n: int, key: int, idf: list[tuple[int, float]]) -> HashingEmbedder:
        weights = np.full(self.options.dim, np.log(n + 1) + 1)
        for bucket, value in idf:
            weights[bucket] = value
        return HashingEmbedder(self.options, weights, f"{n}-{sha1(str(key).encode()).hexdigest()[:8]}")

    def vectors(self, texts: list[str]) -> np.ndarray:
        return self.weigh(len(texts), *_counts(texts, self.options))

    def weigh(self, n: int, doc: np.ndarray, bucket: np.ndarray, net: np.ndarray) -> np.ndarray:
        """Unit vectors of n texts from their (text, bucket, net count) rows."""
        o = self.options
        w = np.sign(net) * np.log1p(np.abs(net)) if o.sublinear_tf else net.astype(np.float64)
        if self.idf is not None:
            w = w * self.idf[bucket]
        out = np.zeros((n, o.dim))
        out[doc, bucket] = w
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def encode(self, rows: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
        """(id, vec) with unit vectors; a text without features has a zero vector."""
        bounded_batches(rows.sparkSession)
        me, kind = self, rows.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in by_bytes(batch, 1):
                    yield _vec_batch(id_col, part.column(0), me.vectors(part.column(1).to_pylist()))
            give_back()

        return rows.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, vec array<float>")


def encode_cached(embedder: HashingEmbedder, chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of chunks through a cache (fingerprint, text_sha, vec): what is
    there is taken, the rest is encoded once per distinct text. Returns
    (vectors, rows to append to the cache)."""
    keyed = chunks.select("chunk_id", "text", F.sha1("text").alias("text_sha"))
    known = cache.where(F.col("fingerprint") == embedder.fingerprint).select("text_sha", "vec")
    missing = cache_misses(keyed, known)
    fresh = embedder.encode(missing, "text_sha").select("text_sha", "vec").cache()
    vectors = keyed.join(known.unionByName(fresh), "text_sha").select("chunk_id", "vec")
    return vectors, fresh.select(F.lit(embedder.fingerprint).alias("fingerprint"), "text_sha", "vec")


def cache_misses(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct texts by text_sha that the cache lacks."""
    return keyed.join(known, "text_sha", "left_anti").groupBy("text_sha").agg(F.min("text").alias("text"))
