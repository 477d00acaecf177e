"""Exact dense retrieval: cosine by block products.

As many queries as fit into SCAN_BYTES share a scan of the vectors; further ones
take another. Within a scan both sides are multiplied block by block, and a task
passes on k rows per query, so what is shuffled is k rows per query and task,
not a row per pair. Queries in several blocks are spread over the tasks, which
then take more of the vectors each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.filters import compile_filter
from .batches import bounded_batches, give_back, where_true
from .ranking import top_k

SCAN_BYTES = 64 << 20  # of query vectors sent to the workers for a scan
BLOCK = 512, 2048  # queries and vectors multiplied at a time


def _matrix(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten(), dtype=np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def normalized(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


class _Best:
    """Each query's k best so far, best first: by score to 9 digits, then by id."""

    def __init__(self, n: int, k: int, integers: bool):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.zeros((n, k), np.int64) if integers else np.full((n, k), "", object)
        self.low = np.full(n, -np.inf)

    def merge(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(q)
        q = np.concatenate([np.repeat(rows, self.k), q])
        score = np.concatenate([self.score[rows].ravel(), score])
        ids = np.concatenate([self.id[rows].ravel(), ids])
        order = np.lexsort((ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1], -np.round(score, 9), q))
        first = np.searchsorted(q[order], rows)
        order = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[rows] = score[order].reshape(-1, self.k)
        self.id[rows] = ids[order].reshape(-1, self.k)
        self.low[rows] = np.round(self.score[rows, -1], 9)


def _best(rows: Iterator[pa.RecordBatch], ids: pa.Array, q: np.ndarray, k: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Products in single precision leave out what is too far to matter, the
    rest is scored in double precision."""
    integers = pa.types.is_integer(id_type)
    best, rough = _Best(len(q), k, integers), q.astype(np.float32)
    slack = (q.shape[1] + 8) * 2.0**-23 + 2e-9  # beyond twice the error of a rough product
    for batch in rows:
        for start in range(0, batch.num_rows, BLOCK[1]):
            part = batch.slice(start, BLOCK[1])
            m = _matrix(part.column(1))
            if m.shape[1] != q.shape[1]:
                raise ValueError(f"vectors have {m.shape[1]} dimensions, the query {q.shape[1]}")
            m = normalized(m)
            names = part.column(0).to_numpy(zero_copy_only=False)
            near = m.astype(np.float32).T
            for a in range(0, len(q), BLOCK[0]):
                b = min(len(q), a + BLOCK[0])
                low = best.low[a:b]
                hit = rough[a:b] @ near >= (low - slack).astype(np.float32)[:, None]
                many = np.count_nonzero(hit)
                if many > hit.size // 16:
                    full = np.round(q[a:b] @ m.T, 12)
                    at = max(0, len(m) - k)
                    low = np.maximum(low, np.round(np.partition(full, at, axis=1)[:, at], 9)) if at else low
                    i, j = where_true(np.round(full, 9) >= low[:, None])
                    s = full[i, j]
                elif many:
                    i, j = where_true(hit)
                    s = np.round(np.einsum("ij,ij->i", q[a + i], m[j]), 12)
                    own = np.round(s, 9) >= low[i]
                    i, j, s = i[own], j[own], s[own]
                if many and len(i):
                    best.merge(i + a, s, names[j])
    for a in range(0, len(q), BLOCK[1]):
        i, j = where_true(best.score[a : a + BLOCK[1]] > -np.inf)
        found = best.id[a : a + BLOCK[1]][i, j]
        yield pa.record_batch({"query_id": ids.take(pa.array(i + a)), "chunk_id": pa.array(found, id_type), "score": pa.array(best.score[a : a + BLOCK[1]][i, j])})
    give_back()


def _packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as bytes, so that the driver takes them in without a row's objects."""
    for batch in rows:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        yield pa.record_batch({"batch": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def query_blocks(queries: DataFrame, most_bytes: int | None = None, k: int = 0) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Blocks of (query_id, unit vector), streamed to the driver one at a time.
    most_bytes counts all that a worker holds of a block: the vectors as sent, as
    read and in single precision, and scores and ids of k rows each."""
    ids, vecs, size = [], [], 0
    for r in queries.select("query_id", "vec").mapInArrow(_packed, "batch binary").toLocalIterator():
        batch = pa.ipc.open_stream(r.batch).read_next_batch()
        if not batch.num_rows:
            continue
        m = normalized(_matrix(batch.column(1)))
        each = 20 * m.shape[1] + 16 * k
        most, a = max(1, (most_bytes or SCAN_BYTES) // each), 0
        while a < len(m):
            b = min(len(m), a + most - size)
            ids.append(batch.column(0).slice(a, b - a))
            vecs.append(m[a:b])
            size += b - a
            a = b
            if size >= most:
                yield pa.concat_arrays(ids), np.concatenate(vecs)
                ids, vecs, size = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), np.concatenate(vecs)


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 5, where: dict[str, Any] | Column | None = None) -> DataFrame:
    """The k most similar vectors per query: (query_id, chunk_id, score, rank,
    source). vectors: chunk_id, vec (and what the filter reads, which is applied
    before the search); queries: query_id, vec. Negative and zero similarities
    count. Vectors of other dimensions than a query's raise ValueError."""
    if where is not None:
        vectors = vectors.where(where if isinstance(where, Column) else compile_filter(where, vectors.schema))
    narrow = vectors.select("chunk_id", "vec")
    q_type, c_type = queries.schema["query_id"].dataType.simpleString(), vectors.schema["chunk_id"].dataType.simpleString()
    schema = f"query_id {q_type}, chunk_id {c_type}, score double"
    spark, id_type = vectors.sparkSession, to_arrow_type(vectors.schema["chunk_id"].dataType)
    bounded_batches(spark)
    blocks = list(query_blocks(queries, k=k)) if k > 0 else []
    # many queries are shared out by query: the fewer parts the vectors come in, the fewer rows are shuffled
    tasks = -(-2 * spark.sparkContext.defaultParallelism // max(1, len(blocks)))
    near = narrow if len(blocks) < 2 else narrow.coalesce(tasks)
    parts = [near.mapInArrow(lambda it, ids=ids, q=q: _best(it, ids, q, k, id_type), schema) for ids, q in blocks]
    found = reduce(DataFrame.unionByName, parts or [spark.createDataFrame([], schema)])
    return top_k(found, max(k, 0)).withColumn("source", F.lit("dense"))


def upsert(store: DataFrame, rows: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """store with rows laid over it by key. Of rows that share a key the last
    wins: the greatest by `order`, else the last in the table's own order, of
    partitions and of rows in them."""
    place = F.col(order) if order else F.monotonically_increasing_id()
    # aggregated by parts before the shuffle, so a key that many rows share isn't gathered
    last = rows.withColumn("__at", place).groupBy(key).agg(F.max_by(F.struct(*rows.columns), "__at").alias("__row")).select("__row.*")
    return store.join(last.select(key), key, "left_anti").unionByName(last)


def vectors_for(store: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, vec) of the rows whose key is asked for; unknown ones are left out."""
    return store.join(ids.select(key).distinct(), key, "left_semi").select(key, "vec")


def get(store: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows for (position, key) in the order asked; unknown keys are left out."""
    return ids.join(store, key).orderBy("position")
