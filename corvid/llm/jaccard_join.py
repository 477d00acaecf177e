"""Exact Jaccard self-join of documents by word n-grams, with signature trees.

1. Each text becomes its set of n-gram hashes. Texts with equal sets form one
   class, found by a 128-bit digest with partial aggregation; only classes go on.
2. Candidates. Two sets with Jaccard >= t differ in at most
   d = (1-t)/(1+t) (|A|+|B|) items. The hash range is cut into d + 1 + slack
   pieces by a rule that depends on the size band alone; two such sets agree on
   more than slack whole pieces, so equal (band, piece, digest of the items in
   it) leads to each linked pair. A set is entered in its own band, and in the
   next if it can pair with a set of it. Pieces hold about 1/(2(1-t)/(1+t))
   items, so passages that many texts share rarely fill one.
3. Keys join classes to the smallest class with that key (a star, not all
   pairs); components of that graph are closed under links.
4. Components are joined within tasks of bounded size. A task builds a signature
   tree: each node holds the OR of its sets' token bitmaps and their size range.
   A dual traversal drops pairs of nodes whose greatest possible overlap is
   under what the smallest sizes need, and counts common items of the pairs of
   leaves that remain. A component beyond the bound is cut into blocks by size
   and hash, and each pair of blocks whose sizes can link is a task. Where chance
   or templates made it, so that this costs more than its keys do, each key's
   classes are a group instead, cut likewise if need be, and a link counts in the
   group of the least key that both sets have.
Counts of links and union-find roots leave a task, one row per set, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashstore import batches, filter_ids, id_store
from .shared import bounded_batches, connected_components, materialize
from .textops import (
    NOT_SPACE, U, buffer_of, lists, mix, mix1, owners, prefix_sums, range_hashes, signed, slices, spans, windows,
)

GROWTH = 1.3  # from a size band to the next
FANOUT = 8


def shingles(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, ascending, and where each text's begin."""
    starts, ends, ptr = spans(buf, offs, NOT_SPACE)
    h = range_hashes(prefix_sums(buf, lower=True), starts, ends)
    words = np.diff(ptr)
    at, g = windows(h, ptr, n)
    doc = np.searchsorted(ptr, at, "right") - 1
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            x = U(words[d])
            with np.errstate(over="ignore"):
                for w in h[ptr[d] : ptr[d + 1]]:
                    x = x * U(0xC6A4A7935BD1E995) + w
            whole[i] = x
        doc, g = np.concatenate([doc, short]), np.concatenate([g, mix(whole)])
        order = np.argsort(doc, kind="stable")
        doc, g = doc[order], g[order]
    cut = np.searchsorted(doc, np.arange(len(offs)))
    for d in range(len(offs) - 1):
        g[cut[d] : cut[d + 1]].sort()
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    total = np.concatenate([[0], np.cumsum(fresh)])
    return g[fresh], total[cut]


class Bands:
    """The pieces that sets of each size band are cut into, for one threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.per = (den - num) / (den + num)

    def of(self, size: np.ndarray) -> np.ndarray:
        # ties at the border of a band go either way alike: only the band counts
        return np.floor(np.log(np.maximum(size, 1)) / log(GROWTH)).astype(np.int64)

    def high(self, band: np.ndarray) -> np.ndarray:
        """No set of the band is larger."""
        return np.floor(np.exp((band + 1) * log(GROWTH)) * (1 + 1e-9)).astype(np.int64) + 1

    def slack(self, band: np.ndarray) -> np.ndarray:
        d = self.differ(band)
        return (d >= 8).astype(np.int64) + (d >= 32)

    def differ(self, band: np.ndarray) -> np.ndarray:
        return np.floor(2 * self.high(band) * self.per + 1e-9).astype(np.int64)

    def pieces(self, band: np.ndarray) -> np.ndarray:
        return self.differ(band) + 1 + self.slack(band)


def _band_keys(g, ptr, size, band, bands: Bands, pick) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the picked texts in the given bands, with each key's text."""
    m_of = bands.pieces(band)
    doc = owners(ptr)
    use = pick[doc]
    g, doc = g[use], doc[use]
    piece = ((g >> U(32)) * m_of[doc].astype(np.uint64)) >> U(32)
    new = np.ones(len(g), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.add.reduceat(mix(g ^ U(0x5851F42D4C957F2D)), first)
    owner, piece = doc[first], piece[first]
    keys = mix(total + mix(piece + (band[owner].astype(np.uint64) << U(40))))
    held = np.bincount(owner, minlength=len(size))
    many = np.flatnonzero(pick & (m_of - held > bands.slack(band)))
    if len(many):  # so many empty pieces that they may be all that agrees
        more_k, more_o = [keys], [owner]
        for d in many:
            empty = np.setdiff1d(np.arange(m_of[d]), piece[owner == d].astype(np.int64)).astype(np.uint64)
            more_k.append(mix(mix(empty + (U(band[d]) << U(40))) ^ U(0xE703)))
            more_o.append(np.full(len(empty), d))
        keys, owner = np.concatenate(more_k), np.concatenate(more_o)
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
    return keys, owner


def signature_keys(g: np.ndarray, ptr: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Candidate keys and how many each text has. Sets so small that only an
    equal one can link have none."""
    size = np.diff(ptr)
    band = bands.of(size)
    alone = (2 * size + 1) * (bands.den - bands.num) < (bands.den + bands.num)  # no other set can link
    k1, o1 = _band_keys(g, ptr, size, band, bands, ~alone & (size > 0))
    reach = size * bands.den // bands.num  # the largest set that can link
    up = ~alone & (size > 0) & (bands.of(reach + 1) > band)
    k2, o2 = _band_keys(g, ptr, size, band + 1, bands, up)
    owner = np.concatenate([o1, o2])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([k1, k2])[order], np.bincount(owner, minlength=len(size))


def _digests(g: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(len(g) + 1, np.uint64)
        np.cumsum(mix(g + U(salt)), out=total[1:])
        out.append(mix(total[ptr[1:]] - total[ptr[:-1]] + mix1(salt)))
    return out[0], out[1]


def _profile(rows: Iterator[pa.RecordBatch], n: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        buf, offs = buffer_of(batch.column(1))
        for a, z, b, o in slices(buf, offs):
            g, ptr = shingles(b, o, n)
            d1, d2 = _digests(g, ptr)
            keys, held = signature_keys(g, ptr, bands)
            yield pa.record_batch(
                {
                    "id": batch.column(0).slice(a, z - a),
                    "n": pa.array(np.diff(ptr)),
                    "d1": pa.array(signed(d1)),
                    "d2": pa.array(signed(d2)),
                    "keys": lists(signed(keys), held, pa.int64()),
                }
            )


class SignatureTree:
    """Nodes of OR-combined bitmaps and size ranges over sets, level by level."""

    def __init__(self, sets: list[np.ndarray], width: int):
        self.sets = sets
        bits = np.zeros((len(sets), width // 8), np.uint8)
        for i, s in enumerate(sets):
            at = (s >> U(20)).astype(np.int64) & (width - 1)
            np.bitwise_or.at(bits[i], at >> 3, (1 << (at & 7)).astype(np.uint8))
        bits = bits.view(np.uint64)
        size = np.array([len(s) for s in sets], np.int64)
        # items beyond a set's own bits: they may share a bit with others
        spare = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, size, size, spare)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, sp = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append(
                (np.bitwise_or.reduceat(b, at, 0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sp, at))
            )


def _need(a: np.ndarray, b: np.ndarray, bands: Bands) -> np.ndarray:
    """The least overlap with which sets of these sizes link."""
    return -(-bands.num * (a + b) // (bands.num + bands.den))


def _possible(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, bands: Bands) -> np.ndarray:
    """Which pairs of nodes may hold a link, by the greatest possible overlap."""
    keep = np.zeros(len(i), bool)
    step = max(1, (8 << 20) // (x[0].shape[1] * 8))
    for s in range(0, len(i), step):
        p, q = i[s : s + step], j[s : s + step]
        most = np.bitwise_count(x[0][p] & y[0][q]).sum(1, dtype=np.int64) + np.minimum(x[3][p], y[3][q])
        most = np.minimum(most, np.minimum(x[2][p], y[2][q]))
        keep[s : s + step] = most >= _need(x[1][p], y[1][q], bands)
    return keep


def _traverse(x: SignatureTree, y: SignatureTree, bands: Bands, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that survive, in bounded portions; own: x is y and each pair comes once."""
    while len(x.levels) < len(y.levels):
        x.levels.append(x.levels[-1])
    while len(y.levels) < len(x.levels):
        y.levels.append(y.levels[-1])
    stack = [(len(x.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        keep = _possible(x.levels[level], y.levels[level], i, j, bands)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level == 0:
            if own:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue

        def below(tree, at):
            k = len(tree.levels[level - 1][0])
            if k == len(tree.levels[level][0]):  # a level that only fills up
                return at[:, None]
            c = at[:, None] * FANOUT + np.arange(FANOUT)
            return np.where(c < k, c, -1)

        ci, cj = below(x, i), below(y, j)
        p = np.repeat(ci, cj.shape[1], axis=1).ravel()
        q = np.tile(cj, (1, ci.shape[1])).ravel()
        ok = (p >= 0) & (q >= 0)
        if own:
            ok &= p <= q
        p, q = p[ok], q[ok]
        for s in range(0, len(p), 1 << 16):
            stack.append((level - 1, p[s : s + (1 << 16)], q[s : s + (1 << 16)]))


def _common(sets_x: list, sets_y: list, i: np.ndarray, j: np.ndarray, dense: tuple | None) -> np.ndarray:
    """Exact overlaps of the pairs."""
    if dense is not None:
        x, y = dense
        out = np.zeros(len(i), np.int64)
        step = max(1, (8 << 20) // (x.shape[1] * 8 + 1))
        for s in range(0, len(i), step):
            out[s : s + step] = np.bitwise_count(x[i[s : s + step]] & y[j[s : s + step]]).sum(1, dtype=np.int64)
        return out
    out = np.zeros(len(i), np.int64)
    for k, (p, q) in enumerate(zip(i, j)):
        a, b = sets_x[p], sets_y[q]
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        out[k] = np.count_nonzero(b[at] == a)
    return out


def _dense(sets_x: list, sets_y: list | None) -> tuple | None:
    """Bit rows over the items that two sets or more hold, if they stay small."""
    both = sets_x + (sets_y or [])
    items, count = np.unique(np.concatenate([*both, np.zeros(0, np.uint64)]), return_counts=True)
    items = items[count > 1]
    width = -(-max(1, len(items)) // 64)
    if width * 8 * len(both) > 64 << 20:
        return None

    def rows(sets):
        out = np.zeros((len(sets), width * 8), np.uint8)
        for k, s in enumerate(sets):
            at = np.searchsorted(items, s)
            at[at == len(items)] = 0
            at = at[items[at] == s] if len(items) else at[:0]
            np.bitwise_or.at(out[k], at >> 3, (1 << (at & 7)).astype(np.uint8))
        return out.view(np.uint64)

    x = rows(sets_x)
    return x, (rows(sets_y) if sets_y is not None else x)


def _width(sets: list[np.ndarray]) -> int:
    usual = int(np.median([len(s) for s in sets]))
    return 1 << min(16, max(8, (4 * usual).bit_length()))


def link_counts(
    sets: list[np.ndarray], weight: np.ndarray, bands: Bands, other: list[np.ndarray] | None = None, other_weight=None, less: list | None = None,
) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weights of linked partners for sets (and for the others, if pairs across
    two blocks are asked for) and the links that join components of sets +
    others, as a spanning forest. less: a set of numbers for each of sets +
    others; links between sets that share one of them count for nothing."""
    own = other is None
    there = sets if own else other
    gain, gain_there = np.zeros(len(sets), np.int64), np.zeros(len(there), np.int64)
    if own:
        gain_there = gain
    base = 0 if own else len(sets)
    root = list(range(base + len(there)))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    def alike_first(x: list[np.ndarray]) -> np.ndarray:  # sets with the same least hash lie side by side
        return np.lexsort(([len(s) for s in x], np.array([s[0] for s in x], np.uint64)))

    order_x = alike_first(sets)
    x = SignatureTree([sets[i] for i in order_x], w := _width(sets + ([] if own else there)))
    if own:
        y, order_y, weight_y = x, order_x, weight
    else:
        order_y = alike_first(there)
        y, weight_y = SignatureTree([there[i] for i in order_y], w), other_weight
    dense = _dense(x.sets, None if own else y.sets) if len(sets) + len(there) > 16 else None
    size_x, size_y = x.levels[0][1], y.levels[0][1]
    if less is not None:
        less_x, less_y = less[: len(sets)], less[base:]
        rows = _dense(less_x, None if own else less_y)
    joins: list[tuple[int, int]] = []
    for i, j in _traverse(x, y, bands, own):
        if not len(i):
            continue
        common = _common(x.sets, y.sets, i, j, dense)
        ok = bands.den * common >= bands.num * (size_x[i] + size_y[j] - common)
        i, j = order_x[i[ok]], order_y[j[ok]]
        if less is not None and len(i):
            fresh = _common(less_x, less_y, i, j, rows) == 0
            i, j = i[fresh], j[fresh]
        np.add.at(gain, i, weight_y[j])
        np.add.at(gain_there, j, weight[i])
        for p, q in zip(i.tolist(), (j + base).tolist()):
            a, b = find(p), find(q)
            if a != b:
                root[max(a, b)] = min(a, b)
                joins.append((p, q))
    return gain, gain_there, joins


def signed_key(x: int) -> np.uint64:
    return U(int(x) & (2**64 - 1))


def _task(table: pa.Table, n: int, bands: Bands) -> pa.Table:
    """Links within a task: rows (side, comp, by_key, cid, size, n, d1, d2, text);
    comp is a key where by_key says so."""
    buf, offs = buffer_of(table["text"])
    sets: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    good: list[np.ndarray] = []
    d1, d2 = table["d1"].to_numpy().view(np.uint64), table["d2"].to_numpy().view(np.uint64)
    for a, z, b, o in slices(buf, offs):
        g, ptr = shingles(b, o, n)
        sets += [g[ptr[k] : ptr[k + 1]] for k in range(z - a)]
        found, held = signature_keys(g, ptr, bands)
        keys += np.split(found, np.cumsum(held)[:-1])
        e1, e2 = _digests(g, ptr)
        good.append((e1 == d1[a:z]) & (e2 == d2[a:z]))  # another text under this id isn't this class
    cid, comp, side = table["cid"].to_numpy(), table["comp"].to_numpy(), table["side"].to_numpy()
    weight, by_key = table["size"].to_numpy(), table["by_key"].to_numpy()
    keep = np.flatnonzero(np.concatenate(good)) if good else np.zeros(0, np.int64)
    order = keep[np.lexsort((cid[keep], side[keep], comp[keep]))]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (cid[order][1:] != cid[order][:-1]) | (side[order][1:] != side[order][:-1]) | (comp[order][1:] != comp[order][:-1])
    order = order[fresh]
    out_id, out_gain, edge_a, edge_b = [], [], [], []
    cuts = np.flatnonzero(np.diff(comp[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        left, right = part[side[part] == 0], part[side[part] == 1]
        less = [np.unique(keys[k][keys[k] < signed_key(comp[k])]) for k in [*left, *right]] if by_key[part[0]] else None
        if len(right) == 0:
            if len(left) < 2:
                continue
            gain, _, joins = link_counts([sets[k] for k in left], weight[left], bands, less=less)
            both = left
            gains = gain
        else:
            if len(left) == 0:
                continue
            gain, more, joins = link_counts(
                [sets[k] for k in left], weight[left], bands, [sets[k] for k in right], weight[right], less
            )
            both, gains = np.concatenate([left, right]), np.concatenate([gain, more])
        some = gains > 0
        out_id.append(cid[both[some]])
        out_gain.append(gains[some])
        if joins:
            edge_a.append(cid[both[[p for p, _ in joins]]])
            edge_b.append(cid[both[[q for _, q in joins]]])
    cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    ids, gains, ea, eb = cat(out_id), cat(out_gain), cat(edge_a), cat(edge_b)
    return pa.table(
        {
            "cid": pa.array(np.concatenate([ids, ea])),
            "gain": pa.array(np.concatenate([gains, np.zeros(len(ea), np.int64)])),
            "to": pa.array(np.concatenate([ids, eb])),
        }
    )


def _groups(member: DataFrame, shared: DataFrame, task_items: int) -> DataFrame:
    """The classes of large components by component or, where their pairs of
    blocks would hold fewer n-grams in all, by shared key."""
    cost = F.col("load") * F.greatest(F.lit(1.0), F.col("load") / (task_items / 2))
    keyed = materialize(shared.distinct().join(member, "cid"), "keyed")
    by_key = keyed.groupBy("comp", "key").agg(F.sum("n").alias("load")).groupBy("comp").agg(F.sum(cost).alias("of_keys"))
    by_comp = member.groupBy("comp").agg(F.sum("n").alias("load")).select("comp", cost.alias("of_comp"))
    chosen = materialize(by_key.join(by_comp, "comp").where("of_keys < of_comp").select("comp"), "chosen")
    parted = keyed.join(chosen, "comp", "left_semi").drop("comp").withColumnRenamed("key", "comp").withColumn("by_key", F.lit(True))
    return materialize(parted.unionByName(member.join(chosen, "comp", "left_anti").withColumn("by_key", F.lit(False))), "parted")


def _blocks(parted: DataFrame, task_items: int) -> DataFrame:
    """Tasks for classes in groups (comp): small groups packed, larger ones in pairs of blocks."""
    loads = parted.groupBy("comp").agg(F.sum("n").alias("load"))
    tasks = max(1, ceil((loads.agg(F.sum("load")).first()[0] or 0) / task_items))
    columns = ["task", "side", "comp", "by_key", "cid", "rep", "size", "d1", "d2"]
    big = loads.where(F.col("load") > task_items).select("comp")
    small = parted.join(big, "comp", "left_anti").withColumns({"task": F.pmod(F.xxhash64("comp", F.lit(1)), F.lit(tasks)) + F.lit(1 << 40), "side": F.lit(0)})
    small, large = small.select(*columns), parted.join(big, "comp", "left_semi")
    blocks = large.groupBy("comp", "band").agg(F.least(F.ceil(F.sum("n") / (task_items / 2)), F.count("*")).cast("int").alias("parts"))
    block = large.join(blocks, ["comp", "band"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    mine = block.select("comp", "band", "part").distinct()  # a pair of blocks needs both: one alone is joined with itself
    pairs = mine.join(mine.select("comp", F.col("band").alias("b2"), F.col("part").alias("p2")), "comp").where("b2 >= band and b2 <= band + 3 and (b2 > band or p2 >= part)")

    def side(s: int, b: str, p: str) -> DataFrame:
        own = pairs.select(
            "comp", F.col(b).alias("band"), F.col(p).alias("part"), F.xxhash64("comp", "band", "part", "b2", "p2").alias("task"),
            ((F.col("b2") == F.col("band")) & (F.col("p2") == F.col("part"))).alias("alone"),
        )
        both = block.join(own, ["comp", "band", "part"])
        return (both if s == 0 else both.where(~F.col("alone"))).withColumn("side", F.lit(s)).select(*columns)

    return small.unionByName(side(0, "band", "part")).unionByName(side(1, "b2", "p2"))


def jaccard_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    num: int = 90,
    den: int = 100,
    task_items: int = 2_000_000,
) -> DataFrame:
    """Links between documents whose n-gram sets have Jaccard >= num/den.

    Words end at ASCII white space, A-Z is folded. A set holds the distinct
    n-grams; with fewer words, the whole sequence. Returns a row per row of
    docs: the id, n_shingles, n_similar (other rows linked directly),
    component_id (smallest id reachable) and class_id (smallest id with an equal
    set). Defined cases: null, empty and blank texts have 0 shingles and link
    with nothing; rows that repeat an id count as rows of their own; a row with
    a null id links with nothing and has null component and class; other
    columns are not read. An empty table gives an empty table.

    Texts are taken whole, however long. task_items bounds the n-grams that a
    task holds (per block of a group larger than that).
    """
    bounded_batches(docs.sparkSession)
    bands = Bands(num, den)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profile = materialize(
        rows.mapInArrow(lambda it: _profile(it, n, bands), "id long, n long, d1 long, d2 long, keys array<long>"),
        "profile",
    )
    live = profile.where("n > 0 and id is not null")
    classes = materialize(
        live.groupBy("n", "d1", "d2")
        .agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("keys").alias("keys"))
        .select(F.monotonically_increasing_id().alias("cid"), "*"),
        "classes",
    )
    entered = classes.select("cid", F.explode("keys").alias("key"))
    hubs = entered.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("far")).where("hub < far")
    stars = entered.join(hubs.select("key", "hub"), "key").where("cid <> hub")
    near = connected_components(stars.select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct())
    member = near.select(F.col("id").alias("cid"), F.col("component").alias("comp"))
    member = member.unionByName(near.select(F.col("component").alias("cid"), F.col("component").alias("comp")).distinct())
    narrow = classes.drop("keys")
    # bands as narrow as a link's size ratio, halved: linked sets lie at most two apart
    part_of = F.floor(F.log(F.col("n").cast("double")) / F.lit(-log(num / den) / 2 + 1e-9)).cast("int")
    member = materialize(member.join(narrow, "cid").withColumn("band", part_of), "members")
    loads = member.groupBy("comp").agg(F.sum("n").alias("load"))
    total = loads.agg(F.sum("load")).first()[0] or 0
    tasks = max(1, ceil(total / task_items))
    big = loads.where(F.col("load") > task_items).select("comp")
    small = member.join(big, "comp", "left_anti").select(
        F.pmod(F.xxhash64("comp"), F.lit(tasks)).alias("task"), F.lit(0).alias("side"), "comp", F.lit(False).alias("by_key"), "cid", "rep", "size", "d1", "d2"
    )
    work = small
    if big.limit(1).count():
        work = small.unionByName(_blocks(_groups(member.join(big, "comp", "left_semi"), entered.join(hubs.select("key"), "key"), task_items), task_items))
    # only candidates' texts are shuffled: the others fail a look-up in sorted arrays on the shared folder
    wanted = filter_ids(rows, "id", id_store(member.select("rep"), "wanted"), present=True)
    texts = work.join(wanted, work.rep == wanted.id).select("task", "side", "comp", "by_key", "cid", "size", "d1", "d2", "text")
    found = texts.groupBy("task").applyInArrow(lambda t: _task(t, n, bands), "cid long, gain long, to long")
    found = materialize(found, "links")
    gains = found.where("gain > 0").groupBy("cid").agg(F.sum("gain").alias("gain"))
    linked = connected_components(found.where("cid <> to").select(F.col("cid").alias("a"), F.col("to").alias("b")))
    label = narrow.join(linked.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = label.join(least, "component").join(gains, "cid", "left")
    label = label.select("n", "d1", "d2", "rep", "component_id", (F.coalesce("gain", F.lit(0)) + F.col("size") - 1).alias("similar"))
    out = profile.select("id", "n", "d1", "d2").join(label, ["n", "d1", "d2"], "left")
    none = F.col("n") == 0
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNull() | none, F.lit(0)).otherwise(F.col("similar")).cast("long").alias("n_similar"),
        F.when(none, F.col("id")).when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.when(none, F.col("id")).when(F.col("id").isNotNull(), F.col("rep")).alias("class_id"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, all columns, with one row of each group of linked rows: that with
    the smallest id. Rows that repeat an id are one row if their texts are
    equal; rows without an id stay."""
    groups = materialize(jaccard_groups(docs, id_col, text_col, **how).select(id_col, "component_id"), "groups")
    gone = groups.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).cast("long").alias("id"))
    kept = filter_ids(docs, id_col, id_store(gone, "gone"), present=False)
    size = groups.agg(F.count(id_col).alias("rows"), F.countDistinct(id_col).alias("ids")).first()
    if size.rows > size.ids:
        named = kept.where(F.col(id_col).isNotNull()).withColumn("__h", F.xxhash64(text_col)).dropDuplicates([id_col, "__h"])
        kept = named.drop("__h").unionByName(kept.where(F.col(id_col).isNull()))
    return kept
