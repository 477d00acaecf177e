"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut at spaces into units that no piece passes. The units of a batch
not met before are concatenated and indexed: all suffixes, to the length of the
longest piece, are sorted as packed code words, every piece is binary-searched
for its range of occurrences, and the resulting edges are sorted by position
and relaxed from left to right, all units at once.

For a BPE model the relaxation is exact: the last piece of each prefix's
encoding is unique, and an edge extends a prefix just if the pair (last piece,
edge's piece) encodes to itself, which is worked out once per pair by merging.
For a unigram model the best-scoring edge wins. Characters that no piece holds
become byte pieces. The model file is a parameter; nothing is trained.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashstore import batches
from .shared import bounded_batches
from .textops import U, buffer_of, lists, slices, span_hashes

MARK = "▁"
GAP = 0x10FFFF  # stands between units; no character
CACHE_TOKENS = 1_500_000
CACHE_PAIRS = 500_000
INDEXED = 400_000  # characters that are indexed at a time, unless one unit has more


def default_model() -> str:
    """The 32k-piece BPE vocabulary among the public tokenizers."""
    return os.environ.get("CORVID_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


class Pieces:
    """A model file's pieces, and what matching needs of them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        if model.trainer_spec.model_type not in (1, 2):
            raise ValueError("only BPE and unigram models are supported")
        kinds = pb.ModelProto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.bpe = model.trainer_spec.model_type == 2
        self.prefix = spec.add_dummy_prefix
        self.text = [p.piece for p in model.pieces]
        self.score = np.array([p.score for p in model.pieces])
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        normal = [i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        self.of = {self.text[i]: i for i in normal}
        raw = [b""] * len(self.text)
        for i in normal:
            raw[i] = self.text[i].replace(MARK, " ").encode()
        for b, i in self.byte.items():
            raw[i] = bytes([b])
        raw[self.unk] = b" \xe2\x81\x87 "
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)])[:-1]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        if self.bpe:  # a piece that merging doesn't reach is never an edge
            normal = [i for i in normal if len(self.text[i]) == 1 or self.merge(self.text[i]) == [i]]
        chars = sorted({c for i in normal for c in self.text[i]})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.bits = max(1, int(len(chars) + 1).bit_length())
        self.per_word = 63 // self.bits
        self.longest = max(len(self.text[i]) for i in normal)
        self.words = -(-self.longest // self.per_word)
        self.ids = np.array(normal, np.int64)
        self.lengths = np.array([len(self.text[i]) for i in normal], np.int64)
        grid = np.zeros((len(normal), self.words * self.per_word), np.int64)
        for row, i in enumerate(normal):
            grid[row, : len(self.text[i])] = self.code[[ord(c) for c in self.text[i]]]
        top = np.where(np.arange(grid.shape[1]) < self.lengths[:, None], grid, (1 << self.bits) - 1)
        self.low, self.high = self.pack(grid), self.pack(top)
        joined = {(self.code[ord(a)], self.code[ord(b)]) for i in normal for a, b in zip(self.text[i], self.text[i][1:])}
        width = 1 << self.bits
        self.joint = np.zeros(width * width if width <= 8192 else 0, bool)
        if len(self.joint):
            self.joint[[int(a) * width + int(b) for a, b in joined]] = True
        self.fits: dict[int, bool] = {}

    def pack(self, grid: np.ndarray) -> list[np.ndarray]:
        out = []
        for w in range(self.words):
            k = np.zeros(len(grid), np.int64)
            for c in range(self.per_word):
                k = (k << self.bits) | grid[:, w * self.per_word + c]
            out.append(k)
        return out

    def merge(self, text: str) -> list[int]:
        """Plain BPE: merge the best-scoring neighbours, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return [self.of.get(p, self.unk) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def pair_fits(self, a: int, b: int) -> bool:
        return self.merge(self.text[a] + self.text[b]) == [a, b]


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    return Pieces(path)


def _ranges(p: Pieces, keys: list[np.ndarray], bounds: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of all bounds at once in the sorted suffixes."""
    n = len(keys[0])
    lo, hi = np.zeros(len(bounds[0]), np.int64), np.full(len(bounds[0]), n, np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.minimum(mid, n - 1)
        less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, b in zip(keys, bounds):
            v = k[at]
            less |= same & (v < b)
            same &= v == b
        right = open_ & (less | (same & after))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


def encode_units(p: Pieces, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the units, one after the other, and how many each has."""
    text = chr(GAP).join(units) + chr(GAP)
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    code = p.code[raw].astype(np.int64)
    n = len(code)
    # suffixes as packed code words, ended by the first character no piece holds
    padded = np.concatenate([code, np.zeros(p.words * p.per_word, np.int64)])
    keys, alive = [], np.ones(n, bool)
    for w in range(p.words):
        k = np.zeros(n, np.int64)
        for c in range(w * p.per_word, (w + 1) * p.per_word):
            v = padded[c : c + n]
            alive &= v > 0
            k = (k << p.bits) | np.where(alive, v, 0)
        keys.append(k)
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    lo, hi = _ranges(p, keys, p.low, False), _ranges(p, keys, p.high, True)
    count = hi - lo
    del keys
    # 32 bits from here on: there are several edges for each character
    small = np.int32 if n < 2**30 and count.sum() < 2**31 else np.int64
    piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
    shift = lo - np.concatenate([[0], np.cumsum(count)[:-1]])
    pos = order.astype(small)[np.repeat(shift.astype(small), count) + np.arange(len(piece), dtype=small)]
    del order
    # where no piece holds both neighbours, what lies left and right is independent
    start = np.ones(n, bool)
    if len(p.joint):
        start[1:] = ~p.joint[(code[:-1] << p.bits) + code[1:]]
    else:
        start[1:] = (code[:-1] == 0) | (code[1:] == 0)
    segment = np.maximum.accumulate(np.where(start, np.arange(n, dtype=small), 0))
    rel = pos + p.lengths.astype(small)[piece] - segment[pos]
    if not len(rel) or rel.max() < 65536:
        rel = rel.astype(np.uint16)
    by = np.argsort(rel, kind="stable").astype(small)
    rel, pos, piece = rel[by], pos[by], piece[by]
    del by
    last, back = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
    lone = np.flatnonzero(code == 0)
    last[lone + 1], back[lone + 1] = -2, lone
    best = np.full(n + 1, -np.inf)
    best[np.flatnonzero(start)] = 0
    cuts = np.searchsorted(rel, np.arange(1, (int(rel[-1]) if len(rel) else 0) + 2))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        s, t = pos[a:b].astype(np.int64), p.ids[piece[a:b]]
        e = s + p.lengths[piece[a:b]]
        if p.bpe:
            ok = start[s]
            rest = np.flatnonzero(~ok)
            pairs, where = np.unique((last[s[rest]] << 20) | t[rest], return_inverse=True)
            ok[rest] = _fitting(p, pairs)[where]
        else:
            value = np.where(start[s], 0, best[s]) + p.score[t]
            rank = np.lexsort((-value, e))
            ok = np.zeros(len(s), bool)
            ok[rank[np.concatenate([[True], e[rank][1:] != e[rank][:-1]])]] = True
            inner = ok & ~start[np.minimum(e, n - 1)]
            best[e[inner]] = value[inner]
        last[e[ok]], back[e[ok]] = t[ok], s[ok]
    # walk back from every segment's end at once
    at = np.concatenate([np.flatnonzero(start)[1:], [n]])
    used = np.zeros(n + 1, bool)
    while len(at):
        used[at] = True
        at = back[at]
        at = at[~start[at]]
    ends = np.flatnonzero(used)
    got = last[ends]
    origin = back[ends]
    is_gap = raw[origin] == GAP
    unknown = (got == -2) & ~is_gap
    width = np.where(is_gap, 0, 1)
    if unknown.any() and p.byte:
        c = raw[origin[unknown]]
        width[unknown] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
    got[unknown] = p.unk
    ids = np.repeat(got, width)
    if unknown.any() and p.byte:
        first = np.cumsum(width) - width
        for i in np.flatnonzero(unknown):
            for k, b in enumerate(chr(raw[origin[i]]).encode("utf-8", "replace")):
                ids[first[i] + k] = p.byte[b]
    total = np.cumsum(width)
    closed = total[is_gap]
    return ids.astype(np.int32), np.diff(np.concatenate([[0], closed]))


def _fitting(p: Pieces, pairs: np.ndarray) -> np.ndarray:
    known = p.fits
    out = np.empty(len(pairs), bool)
    for i, key in enumerate(pairs.tolist()):
        ok = known.get(key)
        if ok is None:
            if len(known) > CACHE_PAIRS:
                known.clear()
            ok = known[key] = p.pair_fits(key >> 20, key & 0xFFFFF) if key >= 0 else False
        out[i] = ok
    return out


class Encoder:
    """Encodes batches, keeping what units met so far encode to."""

    def __init__(self, path: str):
        self.pieces = load_pieces(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts, and each text's count."""
        filled = np.diff(offs) > 0
        if self.pieces.prefix:
            buf = np.insert(buf, offs[:-1][filled], 0x20)
            offs = np.concatenate([[0], np.cumsum(np.diff(offs) + filled)])
        if b"\xe2\x96\x81" in (whole := buf.tobytes()):  # the mark itself reads as a space
            texts = [whole[a:b].replace(b"\xe2\x96\x81", b" ") for a, b in zip(offs[:-1], offs[1:])]
            buf = np.frombuffer(b"".join(texts), np.uint8)
            offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            whole = buf.tobytes()
        space = buf == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offs[:-1][filled]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(buf))
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        h = span_hashes(buf, starts, ends)
        uniq, one, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.pool) > CACHE_TOKENS:
            self.clear()
        at = np.searchsorted(self.keys, uniq)
        at[at == len(self.keys)] = 0
        have = self.keys[at] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
        new = np.flatnonzero(~have)
        if len(new):
            units = [whole[a:b].decode("utf-8", "replace").replace(" ", MARK) for a, b in zip(starts[one[new]], ends[one[new]])]
            total = np.cumsum([len(u) + 1 for u in units])
            cuts = np.searchsorted(total, np.arange(INDEXED, int(total[-1]), INDEXED)).tolist()
            parts = [encode_units(self.pieces, units[a:b]) for a, b in zip([0, *cuts], [*cuts, len(units)]) if a < b]
            ids, size = (np.concatenate(x) for x in zip(*parts))
            begin = len(self.pool) + np.cumsum(size) - size
            self.pool = np.concatenate([self.pool, ids])
            keys = np.concatenate([self.keys, uniq[new]])
            order = np.argsort(keys)
            self.keys = keys[order]
            self.at = np.concatenate([self.at, begin])[order]
            self.size = np.concatenate([self.size, size])[order]
        at = np.searchsorted(self.keys, uniq)[inv]
        size = self.size[at]
        total = np.cumsum(size)
        small = np.int32 if total[-1] < 2**30 else np.int64
        index = np.repeat((self.at[at] - (total - size)).astype(small), size)
        index += np.arange(total[-1], dtype=small)
        cut = np.searchsorted(starts, offs)
        total = np.concatenate([[0], total])
        return self.pool[index], np.diff(total[cut])


def decode_bytes(p: Pieces, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts that the ids stand for, and their offsets."""
    size = p.raw_len[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    small = np.int32 if total[-1] < 2**30 else np.int64
    index = np.repeat((p.raw_at[ids] - total[:-1]).astype(small), size)
    index += np.arange(total[-1], dtype=small)
    buf = p.raw[index]
    offs = total[np.concatenate([[0], np.cumsum(counts)])]
    if p.prefix:  # the first piece's space is the dummy prefix
        drop = offs[:-1][(np.diff(offs) > 0)]
        drop = drop[buf[drop] == 0x20]
        lost = np.zeros(len(buf), bool)
        lost[drop] = True
        kept = np.concatenate([[0], np.cumsum(~lost)])
        buf, offs = buf[~lost], kept[offs]
    return buf, offs


_encoders: dict[str, Encoder] = {}


def _encode(rows: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    enc = _encoders.setdefault(model, Encoder(model)) if model not in _encoders else _encoders[model]
    for batch in batches(rows):
        buf, offs = buffer_of(batch.column(1))
        for a, z, b, o in slices(buf, offs):
            ids, counts = enc.encode(b, o)
            back, at = decode_bytes(enc.pieces, ids, counts)
            same = np.diff(at) == np.diff(o)
            if same.all():
                wrong = np.concatenate([[0], np.cumsum(back != b)])
                same = wrong[o[1:]] == wrong[o[:-1]]
            else:
                same = np.array([back[at[i] : at[i + 1]].tobytes() == b[o[i] : o[i + 1]].tobytes() for i in range(z - a)], bool)
            yield pa.record_batch(
                {
                    "id": batch.column(0).slice(a, z - a),
                    "n_tokens": pa.array(counts.astype(np.int64)),
                    "ids": lists(ids, counts, pa.int32()),
                    "round_trip": pa.array(same),
                }
            )


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per row of docs: the id, n_tokens, ids and round_trip (whether decoding
    gives the text back; it doesn't where the text holds U+2581 itself).

    ids equal the reference library's encode() for models without normalisation.
    Null and empty texts have no tokens and round-trip. Texts aren't split or
    shortened whatever their length. Rows that repeat an id, or have none, get a
    row each. An empty table gives an empty table. The model path must be
    readable on the workers.
    """
    path = model or default_model()
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_tokens long, ids array<int>, round_trip boolean"
    return rows.mapInArrow(lambda it: _encode(it, path), schema).withColumnRenamed("id", id_col)


def _decode(rows: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    p = load_pieces(model)
    for batch in batches(rows):
        col = batch.column(1)
        counts = np.nan_to_num(np.asarray(col.value_lengths().fill_null(0))).astype(np.int64)
        buf, offs = decode_bytes(p, col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
        texts = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:])]
        nulls = np.asarray(col.is_null())
        yield pa.record_batch({"id": batch.column(0), "text": pa.array([None if x else t for t, x in zip(texts, nulls)], pa.string())})


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """Per row: the id and the text its ids stand for; null ids give null. Byte
    pieces that are no UTF-8 become U+FFFD."""
    path = model or default_model()
    bounded_batches(encoded.sparkSession)
    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(lambda it: _decode(it, path), "id long, text string").withColumnRenamed("id", id_col)
