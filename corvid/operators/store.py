"""Where a stack keeps its vectors: a table behind a small interface.

A store of another kind (a server's client, say) subclasses VectorStore and is
registered by name; stacks ask for it with PipelineConfig(store=name).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import files
from . import dense


class VectorStore:
    """Vectors (chunk_id, vec) as a persisted table; scores are cosines, higher is better."""

    name = "memory"

    def __init__(self):
        self.table: DataFrame | None = None

    def add(self, rows: DataFrame) -> None:
        """Inserts rows, over those with the same chunk_id; of repeated ids the last wins."""
        old = self.table
        self._keep(rows if old is None else dense.upsert(old, rows.select(old.columns)))

    def _keep(self, table: DataFrame) -> None:
        old, self.table = self.table, table.persist()
        self.table.count()
        if old is not None:
            old.unpersist()

    def search(self, queries: DataFrame, k: int = 5, among: DataFrame | None = None) -> DataFrame:
        """The k nearest per query (query_id, vec), among the given chunk_ids if there are some."""
        rows = self._rows()
        return dense.dense_search(rows if among is None else rows.join(among.select("chunk_id"), "chunk_id", "left_semi"), queries, k)

    def get(self, ids: DataFrame) -> DataFrame:
        """Rows for (position, chunk_id), in that order; unknown ids are left out."""
        return dense.get(self._rows(), ids)

    def vectors_for(self, ids: DataFrame) -> DataFrame:
        """(chunk_id, vec) of the chunk_ids that are there."""
        return dense.vectors_for(self._rows(), ids)

    def _rows(self) -> DataFrame:
        if self.table is None:
            raise RuntimeError("nothing is stored yet")
        return self.table

    def count(self) -> int:
        return 0 if self.table is None else self.table.count()

    def __len__(self) -> int:
        return self.count()

    def reset(self) -> None:
        """Without rows from here on."""
        if self.table is not None:
            self.table.unpersist()
        self.table = None

    def persist(self) -> None:
        """Writes out what isn't written yet: nothing here."""

    def describe(self) -> str:
        return self.name


class ParquetStore(VectorStore):
    """Kept at a path, a version for each change; opens what is there."""

    name = "parquet"

    def __init__(self, path: str, spark: SparkSession | None = None):
        super().__init__()
        self.path, spark = path, spark or SparkSession.active()
        at = files.read_text(spark, f"{path}/CURRENT")
        self.table = None if at is None else spark.read.parquet(f"{path}/v{at}")

    def _keep(self, table: DataFrame) -> None:
        spark = table.sparkSession
        at = int(files.read_text(spark, f"{self.path}/CURRENT") or -1) + 1
        table.write.mode("overwrite").parquet(f"{self.path}/v{at}")
        files.write_text(spark, f"{self.path}/CURRENT", str(at))
        files.remove(spark, f"{self.path}/v{at - 2}")  # a reader may still be at the one before
        self.table = spark.read.parquet(f"{self.path}/v{at}")

    def reset(self) -> None:
        if self.table is not None:
            self._keep(self.table.limit(0))

    def describe(self) -> str:
        return f"{self.name} at {self.path}"


def _absent(name: str) -> Callable[..., VectorStore]:
    def make(**_) -> VectorStore:
        raise ImportError(f"the client of {name} isn't here; write a VectorStore over it and register that")

    return make


STORES: dict[str, Callable[..., VectorStore]] = {
    "memory": VectorStore, "parquet": ParquetStore, "chroma": _absent("chroma"), "qdrant": _absent("qdrant"),
}


def register_store(make: Callable[..., VectorStore], name: str | None = None) -> Callable[..., VectorStore]:
    """A class of stores under its name, or anything that makes one under the given one."""
    STORES[name or make.name] = make
    return make


def available_stores() -> list[str]:
    return sorted(STORES)


def build_store(name: str, **args) -> VectorStore:
    if name not in STORES:
        raise KeyError(f"no store {name!r}; there are {', '.join(available_stores())}")
    return STORES[name](**args)
