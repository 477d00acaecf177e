"""Sorted hash arrays on the shared folder, memory-mapped by workers.

A store is a folder of shards; a shard holds the rows whose 64-bit key has
certain top bits: the keys, ascending, and one array for each value column.
Shards are written by Spark tasks (to a name of their own, then renamed, so
that a task that runs twice does no harm) and opened on first use. Where the
folder is a mounted one they are mapped and the pages that a worker touches are
all it holds; from another file system a shard is read when needed.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, local_path
from .textops import mix, signed

ROWS_PER_SHARD = 2_000_000


def _write(path: str, arrays: dict[str, np.ndarray]) -> None:
    sink = pa.BufferOutputStream()
    # a row of lists: the arrays may differ in length
    batch = pa.record_batch({k: pa.LargeListArray.from_arrays(pa.array([0, len(v)], pa.int64()), pa.array(v)) for k, v in arrays.items()})
    with pa.ipc.new_file(sink, batch.schema) as w:
        w.write_batch(batch)
    data = sink.getvalue()
    if path.startswith(("/", "file:")):
        own, path = local_path(path) + f".{uuid.uuid4().hex}", local_path(path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(own, "wb") as f:
            f.write(data)
        os.replace(own, path)
    else:
        fs, p = pafs.FileSystem.from_uri(path)
        fs.create_dir(p.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(p + (own := f".{uuid.uuid4().hex}")) as f:
            f.write(data)
        fs.move(p + own, p)


def _read(path: str) -> dict[str, np.ndarray] | None:
    if path.startswith(("/", "file:")):
        if not os.path.exists(local_path(path)):
            return None
        source = pa.memory_map(local_path(path))
    else:
        fs, p = pafs.FileSystem.from_uri(path)
        if fs.get_file_info(p).type == pafs.FileType.NotFound:
            return None
        source = fs.open_input_file(p)
    batch = pa.ipc.open_file(source).get_batch(0)
    return {k: batch.column(k).values.to_numpy(zero_copy_only=True) for k in batch.schema.names}


class Files:
    """A folder's files, opened in the worker that asks. Those used last stay
    open: `most` where they are mapped, `most_bytes` where they are read into
    memory. Pickles as its path."""

    def __init__(self, path: str, most: int = 1024, most_bytes: int = 128 << 20):
        self.path, self.most, self.most_bytes, self.held = path, most, most_bytes, 0
        self._open: OrderedDict[str, tuple[dict | None, int]] = OrderedDict()

    def __reduce__(self):
        return Files, (self.path, self.most, self.most_bytes)

    def get(self, name: str) -> dict[str, np.ndarray] | None:
        if name in self._open:
            self._open.move_to_end(name)
            return self._open[name][0]
        rows = _read(path := f"{self.path}/{name}.arrow")
        size = 0 if path.startswith(("/", "file:")) else sum(v.nbytes for v in (rows or {}).values())
        self._open[name] = rows, size
        self.held += size
        while len(self._open) > 1 and (len(self._open) > self.most or self.held > self.most_bytes):
            self.held -= self._open.popitem(last=False)[1][1]
        return rows


class HashStore:
    """Read side. starts: how many rows the shards before each hold, if known."""

    def __init__(self, path: str, bits: int, prefix: str = "", starts: np.ndarray | None = None):
        self.files, self.bits, self.prefix, self.starts = Files(path), bits, prefix, starts

    def shard(self, i: int) -> dict[str, np.ndarray] | None:
        return self.files.get(f"{self.prefix}{i:06d}")

    def get(self, keys: np.ndarray, **missing) -> dict[str, np.ndarray]:
        """Values for each key (uint64, any order), the given ones where it is
        absent; "found" tells which are there, "row" where, by all keys' order."""
        keys, back = np.unique(keys, return_inverse=True)
        out = {k: np.full(len(keys), v, np.asarray(v).dtype) for k, v in missing.items()}
        found, row = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        shard = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(shard, np.arange((1 << self.bits) + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[i], cuts[i + 1]
            rows = self.shard(int(i))
            if rows is None or not len(rows["key"]):
                continue
            at = np.minimum(np.searchsorted(rows["key"], keys[a:b]), len(rows["key"]) - 1)
            hit = rows["key"][at] == keys[a:b]
            found[a:b] = hit
            row[a:b] = at + (self.starts[i] if self.starts is not None else 0)
            for k in out:
                out[k][a:b][hit] = rows[k][at[hit]]
        return {k: v[back] for k, v in out.items()} | {"found": found[back], "row": row[back]}


def shard_bits(rows: int) -> int:
    """How many top bits of the key name a shard, for so many rows."""
    return max(0, (-(-rows // ROWS_PER_SHARD) - 1).bit_length())


def shard_column(key: str, bits: int):
    """A shard's number from a signed long that holds the unsigned key."""
    return F.shiftrightunsigned(F.col(key), 64 - bits).cast("int") if bits else F.lit(0)


def build(df: DataFrame, rows: int, name: str) -> tuple[HashStore, int]:
    """Writes df (long "key", distinct, and value columns) as a store; gives it
    and the rows written. rows sizes the shards, about 2 million each."""
    spark = df.sparkSession
    bits = shard_bits(rows)
    path = fresh_path(spark, name)
    names = [c for c in df.columns if c != "key"]

    def write(key: tuple, table: pa.Table) -> pa.Table:
        k = table["key"].to_numpy().view(np.uint64)
        order = np.argsort(k)
        _write(f"{path}/{key[0].as_py():06d}.arrow", {"key": k[order]} | {c: table[c].to_numpy()[order] for c in names})
        return pa.table({"s": [key[0]], "n": pa.array([len(k)], pa.int64())})

    done = df.withColumn("__shard", shard_column("key", bits)).groupBy("__shard").applyInArrow(write, "s int, n long")
    held = np.zeros(1 << bits, np.int64)
    for r in done.collect():  # a row per 2 million keys
        held[r.s] = r.n
    return HashStore(path, bits, starts=np.cumsum(held) - held), int(held.sum())


def _keys_of(ids: pa.Array) -> np.ndarray:
    return mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def id_store(ids: DataFrame, name: str) -> HashStore:
    """A store of the distinct ids in the one long column of a table."""

    def keyed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (pa.record_batch({"key": pa.array(signed(_keys_of(b.column(0))))}) for b in batches(rows))

    keys = ids.dropna().distinct().mapInArrow(keyed, "key long")
    return build(keys, ids.count(), name)[0]


def filter_ids(df: DataFrame, column: str, store: HashStore, present: bool) -> DataFrame:
    """Rows of df whose id the store holds, or doesn't (so null ids): a semi or
    anti join in which df isn't shuffled, whatever the store's size."""
    at = df.columns.index(column)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            ids = b.column(at)
            found = store.get(_keys_of(ids))["found"] & ~np.asarray(ids.is_null())
            yield b.filter(pa.array(found == present))

    return df.mapInArrow(run, df.schema)


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those that hold a row. Between them, and at the end of a task, memory that
    was freed goes back to the system: Spark keeps workers for later tasks."""
    try:
        for b in rows:
            if b.num_rows:
                yield b
                del b
                release_memory()
    finally:
        release_memory()


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    import ctypes

    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None
