"""What the operators share on a cluster: the shared folder, tables written
there to cut lineage, and connected components."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Has Spark cut the batches that Python workers get by bytes too: by rows
    alone, a batch of long texts takes gigabytes. Holds for the session, unless
    it has a setting of its own."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is unset and
    all runs on one machine, as in tests, a folder of our own is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="corvid-")
        spark.sparkContext.setCheckpointDir(_own[key])
        atexit.register(_remove, spark, _own[key])
    return _own[key]


def _remove(spark: SparkSession, path: str) -> None:
    import shutil

    if path.startswith(("file:", "/")):
        shutil.rmtree(local_path(path), ignore_errors=True)
        return
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder is the cluster's to sweep
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/corvid-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def local_path(uri: str) -> str:
    """The path of a file: URI, as workers see it on the shared mount."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: computed once, kept
    when executors are lost, and its lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that materialize() wrote, once nothing will read it again."""
    _remove(df.sparkSession, df._table_path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now: it does so once
    the driver's garbage is collected, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Components of an undirected graph given as long columns (a, b).

    Returns (id, component), component being the smallest id reachable, one row
    for each id that some edge joins to a smaller one. Alternates large-star
    and small-star steps; a step is two shuffles of the edges with partial
    minima, so that a node with very many neighbours is never gathered in one
    task. An empty input gives an empty result; loops and repeated edges count
    for nothing.
    """
    cur = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    def marked(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return r.n, r.x

    mark = marked(cur)
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        star = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        star = star.distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        own = low.select("a", F.col("m").alias("b"))
        others = star.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, cur = cur, materialize(own.unionByName(others).distinct(), "cc")
        discard(old)
        now = marked(cur)
        if mark == now:
            return cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
        mark = now
    raise RuntimeError(f"no end after {rounds} rounds")
