"""Line deduplication by runs of lines, or by content-defined chunks of lines.

Runs (runs=True) leave nothing out: from each line on, and up to each line, the
shortest run of two lines or more with min_bytes bytes is a unit. A passage of
that size that stands twice, whatever surrounds it, is covered by such units,
so all its lines go where it stands again. Lines of a repeated run that stands
here first stay, even if a run that stood before overlaps it.

Chunks are fewer units, cut apart. Each line gets a 64-bit hash. A rolling hash over the last `window` line hashes
ends a chunk after a line when it is 0 modulo `divisor` and the chunk has two
lines or more, so that the same run of lines is cut alike wherever it stands.
A passage shorter than a few chunks is mostly missed by them.

Units whose hash occurs more than once are gathered with their bytes and
compared; where all bytes agree, the first occurrence (smallest id, then line)
stays and the others go.

Nothing is joined to the texts: repeated hashes go into sorted arrays on the
shared folder, which the scans map into memory. Only repeated units are
shuffled, pre-aggregated in each batch and again by Spark's partial aggregates,
so a unit that a third of all rows share costs a task a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashstore
from .shared import bounded_batches, discard, materialize
from .textops import U, buffer_of, line_spans, mix, prefix_sums, range_hashes, signed, slices


def chunk_lines(
    buf: np.ndarray, offs: np.ndarray, window: int = 2, divisor: int = 2, min_bytes: int = 32
) -> dict[str, np.ndarray]:
    """Lines and multi-line chunks of a slice of texts.

    Returns start, end, doc of lines and, for chunks of two lines or more and
    at least min_bytes bytes, first and last line (numbers within the slice)
    and hash.
    """
    start, end, doc = line_spans(buf, offs)
    total = prefix_sums(buf)
    h = range_hashes(total, start, end)
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    roll = mix(h)
    for k in range(1, window):
        back = np.zeros_like(h)
        back[k:] = np.where(number[k:] >= k, h[:-k], 0)
        roll = mix(roll * U(3) + back)
    cut = (roll % U(divisor) == 0) & (number > 0)
    # of neighbouring cuts the first, third, ... stay: a chunk has two lines or more
    fresh = cut.copy()
    fresh[1:] &= ~cut[:-1]
    run = np.maximum.accumulate(np.where(fresh, np.arange(len(cut)), 0))
    cut &= (np.arange(len(cut)) - run) % 2 == 0
    closing = np.ones(len(doc), bool)
    closing[:-1] = doc[1:] != doc[:-1]
    last = np.flatnonzero(cut | closing)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    keep = (last > first) & (end[last] - start[first] >= min_bytes)
    first, last = first[keep], last[keep]
    return {
        "start": start, "end": end, "doc": doc, "number": number,
        "first": first, "last": last, "hash": range_hashes(total, start[first], end[last]),
    }


def run_lines(buf: np.ndarray, offs: np.ndarray, min_bytes: int = 32) -> dict[str, np.ndarray]:
    """As chunk_lines, but the shortest runs of two lines or more and min_bytes
    bytes from each line on and up to each line, in the order of their lines."""
    start, end, doc = line_spans(buf, offs)
    i = np.arange(len(doc))
    last = np.maximum(np.searchsorted(end, start + min_bytes, "left"), i + 1)
    first = np.minimum(np.searchsorted(start, end - min_bytes, "right") - 1, i - 1)
    on, up = last < len(doc), first >= 0
    on[on], up[up] = doc[last[on]] == doc[on], doc[first[up]] == doc[up]
    both = np.unique(np.concatenate([i[on] * len(doc) + last[on], first[up] * len(doc) + i[up]]))
    first, last = both // max(1, len(doc)), both % max(1, len(doc))
    return {
        "start": start, "end": end, "doc": doc, "number": i - np.searchsorted(doc, doc),
        "first": first, "last": last, "hash": range_hashes(prefix_sums(buf), start[first], end[last]),
    }


def _units(buf: np.ndarray, offs: np.ndarray, how: dict) -> dict[str, np.ndarray]:
    return run_lines(buf, offs, how["min_bytes"]) if how["runs"] else chunk_lines(buf, offs, how["window"], how["divisor"], how["min_bytes"])


def _covered(c: dict[str, np.ndarray], units: np.ndarray) -> np.ndarray:
    """Which lines lie in one of the units."""
    n = len(c["doc"]) + 1
    return np.cumsum(np.bincount(c["first"][units], minlength=n) - np.bincount(c["last"][units] + 1, minlength=n))[:-1] > 0


def _hash_counts(rows: Iterator[pa.RecordBatch], how: dict) -> Iterator[pa.RecordBatch]:
    for batch in hashstore.batches(rows):
        buf, offs = buffer_of(batch.column(0))
        found = [_units(b, o, how)["hash"] for _, _, b, o in slices(buf, offs)]
        h, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.record_batch({"key": pa.array(signed(h)), "n": pa.array(n, pa.int64())})


def _repeated(rows: Iterator[pa.RecordBatch], store: hashstore.HashStore, how: dict) -> Iterator[pa.RecordBatch]:
    for batch in hashstore.batches(rows):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        buf, offs = buffer_of(batch.column(1))
        best: dict[tuple[int, bytes], tuple[int, int]] = {}
        for a, _, b, o in slices(buf, offs):
            c = _units(b, o, how)
            for i in np.flatnonzero(store.get(c["hash"])["found"]):
                f, t = c["first"][i], c["last"][i]
                key = int(signed(c["hash"])[i]), b[c["start"][f] : c["end"][t]].tobytes()
                at = int(ids[a + c["doc"][f]]), int(c["number"][f])
                if key not in best or at < best[key]:
                    best[key] = at
        if best:
            yield pa.record_batch(
                {
                    "key": pa.array([k for k, _ in best], pa.int64()),
                    "bytes": pa.array([v for _, v in best], pa.binary()),
                    "id": pa.array([v[0] for v in best.values()], pa.int64()),
                    "line": pa.array([v[1] for v in best.values()], pa.int32()),
                }
            )


def _rewrite(
    rows: Iterator[pa.RecordBatch], store: hashstore.HashStore, how: dict, id_at: int, text_at: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    for batch in hashstore.batches(rows):
        raw = batch.column(id_at)
        null_id = np.asarray(raw.is_null())
        ids = raw.fill_null(0).to_numpy(zero_copy_only=False)
        text = batch.column(text_at)
        buf, offs = buffer_of(text)
        lines_n, gone_n = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        cuts: list[list[dict]] = [[] for _ in range(len(ids))]
        new: dict[int, bytes] = {}
        for a, z, b, o in slices(buf, offs):
            c = _units(b, o, how)
            lines_n[a:z] = np.bincount(c["doc"], minlength=z - a)
            v = store.get(c["hash"], id=np.int64(0), line=np.int32(0))
            at = c["doc"][c["first"]] + a
            own = (v["id"] == ids[at]) & (v["line"] == c["number"][c["first"]])
            there = v["found"] & ~null_id[at]
            gone = _covered(c, np.flatnonzero(there & ~own)) & ~_covered(c, np.flatnonzero(there & own))
            if not gone.any():
                continue
            gone_n[a:z] = np.bincount(c["doc"][gone], minlength=z - a)
            for d in np.unique(c["doc"][gone]):
                lo, hi = np.searchsorted(c["doc"], [d, d + 1])
                edge = np.flatnonzero(np.diff(gone[lo:hi].astype(np.int8), prepend=0, append=0))
                cuts[a + d] = [{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2])]
                left = np.flatnonzero(~gone[lo:hi]) + lo
                new[int(a + d)] = b"\n".join(b[c["start"][i] : c["end"][i]].tobytes() for i in left)
        if new:
            values = text.to_pylist()
            for d, x in new.items():
                values[d] = x.decode("utf-8", "replace")
            text = pa.array(values, text.type)
        arrays = [*batch.columns]
        arrays[text_at] = text
        arrays += [pa.array(lines_n), pa.array(gone_n), pa.array(cuts, schema.field(len(arrays) + 2).type)]
        yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, schema)], schema=schema)


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2,
    divisor: int = 2,
    min_bytes: int = 32,
    runs: bool = False,
) -> DataFrame:
    """docs with repeated multi-line chunks removed from text_col; with runs, all
    repeated passages of two lines or more and min_bytes bytes.

    Adds n_lines (lines before; null and empty texts count as one empty line),
    n_removed_lines and removed (first and last line of each part that went,
    from 0). Defined cases: a null text stays null; a text of which every chunk
    goes becomes ""; a row with a null id is left alone and counts as no
    occurrence's owner; rows that repeat an id and text are alike, and none
    loses a chunk to the other; chunks of one line, under min_bytes bytes, or
    whose bytes differ though the 64-bit hashes agree, stay. Other columns pass
    unchanged, except columns with the three added names, which are replaced.
    An empty table gives an empty table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    bounded_batches(docs.sparkSession)
    how = {"window": window, "divisor": divisor, "min_bytes": min_bytes, "runs": runs}
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    counts = (
        narrow.select("text").mapInArrow(lambda it: _hash_counts(it, how), "key long, n long")
        .groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    )
    counts = materialize(counts, "repeated")
    repeated, _ = hashstore.build(counts, counts.count(), "repeated")
    discard(counts)
    found = narrow.mapInArrow(lambda it: _repeated(it, repeated, how), "key long, bytes binary, id long, line int")
    same = (
        found.groupBy("key")
        .agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi"), F.min(F.struct("id", "line")).alias("at"))
        .where("lo = hi")  # the bytes of all occurrences agree
        .select("key", "at.id", "at.line")
    )
    same = materialize(same, "chunks")
    store, _ = hashstore.build(same, same.count(), "chunks")
    discard(same)
    added = "n_lines long, n_removed_lines long, removed array<struct<first:int,last:int>>"
    docs = docs.drop("n_lines", "n_removed_lines", "removed")
    schema = StructType(docs.schema.fields + StructType.fromDDL(added).fields)
    arrow = to_arrow_schema(schema)
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: _rewrite(it, store, how, id_at, text_at, arrow), schema)
