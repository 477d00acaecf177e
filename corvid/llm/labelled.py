"""A bounded sample of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % k


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bound: int, where: Column | None = None
) -> DataFrame:
    """(id, text, y) of at most `bound` labelled documents.

    Ids are taken in the order of a hash, so the sample doesn't depend on how
    the table is laid out. An id labelled several times has the mean, taken as
    1 from 0.5; null labels and null ids count for nothing. Only the bounded
    id list is broadcast; texts aren't shuffled.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).dropna()
    if where is not None:
        marks = marks.where(where)
    marks = marks.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    ids = marks.orderBy(F.xxhash64("id"), "id").limit(bound)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(ids), "id")
