"""Reading and writing document collections and judged query sets."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

EXTENSIONS = tuple(f".{e}" for e in "md markdown rst txt".split())
QUERY_SCHEMA = "id string, query string, text string, relevant_doc_ids array<string>, grades map<string,double>, metadata map<string,string>"


def front_matter(text):
    """(pairs as map, body) of a text that may start with a --- block."""
    has = text.rlike(r"(?s)\A---.*?\n---")
    block = F.regexp_extract(text, r"(?s)\A---(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda line: F.instr(line, ":") > 0)
    key = lambda line: T.strip(F.substring_index(line, ":", 1))
    value = lambda line: F.regexp_replace(T.strip(F.regexp_replace(line, r"(?s)\A[^:]*:", "")), r"^[\"']+|[\"']+$", "")
    # the last of lines with one key wins
    pairs = F.aggregate(
        lines, F.create_map().cast("map<string,string>"),
        lambda m, line: F.map_concat(F.map_filter(m, lambda k, v: k != key(line)), F.create_map(key(line), value(line))),
    )
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)\A---.*?\n---", ""), r"\A\n+", "")
    none = F.create_map().cast("map<string,string>")
    return F.when(has, pairs).otherwise(none), F.when(has, body).otherwise(text)


def read_directory(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """Files below a directory as documents: the front matter's id, else the
    relative path without extension; metadata with the relative path as source."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    root = path if "://" in path else "file://" + os.path.abspath(path)
    # the keyword counts here: as an option, wholetext is overridden
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    full = F.col("_metadata.file_path")
    ends = "(?i)(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$"
    rel = F.url_decode(F.regexp_replace(full, r"\+", "%2B"))
    raw = raw.select(F.col("value"), rel.alias("full")).where(F.col("full").rlike(ends))
    base = root.removeprefix("file://").rstrip("/")
    tail = F.regexp_extract("full", rf"\Q{base}\E/+(.*)", 1)
    pairs, body = front_matter(F.col("value"))
    docs = raw.select(tail.alias("rel"), pairs.alias("pairs"), T.strip(body).alias("text"))
    named = F.try_element_at("pairs", F.lit("id"))
    rest = F.map_filter("pairs", lambda k, v: k != "id")
    source = F.when(F.map_contains_key(rest, F.lit("source")), rest).otherwise(F.map_concat(rest, F.create_map(F.lit("source"), F.col("rel"))))
    return docs.select(F.coalesce(named, F.regexp_replace("rel", r"\.[^./]+$", "")).alias("doc_id"), "text", source.alias("metadata"))


def read_jsonl(spark: SparkSession, path: str, id_field="id", text_field="text") -> DataFrame:
    """Lines of JSON as documents. Blank lines are skipped; a line that isn't an
    object or lacks the text raises an error with its number; without an id a
    line is named by its number in the file. What else it holds is metadata.

    A file is read in as many tasks as its size asks for: lines are numbered
    from the counts of the splits before their own, a row per split."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")
    )
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "split", (F.col("first") - F.coalesce(before, F.lit(0))).alias("first"))
    whole = lines.join(splits, ["file", "split"]).select("line", F.regexp_extract("file", "[^/]*$", 0).alias("file"), (F.col("at") - F.col("first")).alias("at"))
    rows = whole.where(T.strip("line") != "").withColumn("map", F.from_json("line", "map<string,string>", {"mode": "PERMISSIVE"}))
    where = F.concat(F.col("file"), F.lit(":"), (F.col("at") + 1).cast("string"))
    text = F.try_element_at("map", F.lit(text_field))
    bad = F.when(F.col("map").isNull() | (~F.startswith(T.strip("line"), F.lit("{"))), F.concat(F.lit("not a JSON object at "), where)).when(text.isNull(), F.concat(F.lit(f"no {text_field} at "), where))
    given = F.try_element_at("map", F.lit(id_field))
    falsy = given.isNull() | given.isin("", "0", "false")
    return rows.select(
        F.when(falsy, F.concat(F.lit("doc-"), (F.col("at") + 1).cast("string"))).otherwise(given).alias("doc_id"),
        F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(text).alias("text"),
        T.flatten_metadata(F.map_filter("map", lambda k, v: ~k.isin(id_field, text_field))).alias("metadata"),
    )


def load_documents(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS, id_field="id", text_field="text") -> DataFrame:
    """A directory of text files, or a file of JSON lines. ValueError if nothing is there."""
    docs = read_jsonl(spark, path, id_field, text_field) if os.path.isfile(path) else read_directory(spark, path, extensions)
    if docs.isEmpty():
        raise ValueError(f"no documents in {path}")
    return docs


def normalize_queries(raw: DataFrame) -> DataFrame:
    """(query_id, text, relevant_doc_ids, grades, metadata) from rows as in
    QUERY_SCHEMA: without a list, the relevant ids are those graded above 0;
    without an id, it derives from the query's text."""
    none = F.create_map().cast("map<string,double>")
    grades = F.coalesce("grades", none)
    graded = F.map_keys(F.map_filter(grades, lambda k, v: v > 0))
    listed = F.when(F.coalesce(F.size("relevant_doc_ids"), F.lit(0)) > 0, F.col("relevant_doc_ids")).otherwise(graded)
    words = F.coalesce("query", "text")
    return raw.select(
        F.coalesce("id", T.stable_id(F.col("query"))).alias("query_id"), words.alias("text"), listed.alias("relevant_doc_ids"),
        grades.alias("grades"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list or JSON lines of judged queries. ValueError if empty or if a
    query has no positive judgement."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    head = spark.read.text(path).where(T.strip("value") != "").first()
    as_list = head is not None and head.value.lstrip().startswith("[")
    queries = normalize_queries(spark.read.schema(QUERY_SCHEMA).json(path, multiLine=as_list))
    if queries.isEmpty():
        raise ValueError(f"no queries in {path}")
    unjudged = queries.where(F.size("relevant_doc_ids") == 0).orderBy("query_id").first()
    if unjudged is not None:
        raise ValueError(f"query {unjudged.query_id!r} has no relevant document")
    return queries


def unknown_items(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """Relevant judgements of documents that the collection lacks."""
    rel = judged.where("relevant").select("query_id", F.col("item_id").alias("doc_id"))
    return rel.join(docs.select("doc_id"), "doc_id", "left_anti").select("query_id", F.col("doc_id").alias("item_id"))


def write_queries(queries: DataFrame, path: str) -> None:
    """JSON lines; empty grades and metadata are left out."""
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    rows = queries.select(F.col("query_id").alias("id"), F.col("text").alias("query"), "relevant_doc_ids", full("grades").alias("grades"), full("metadata").alias("metadata"))
    rows.write.mode("overwrite").json(path)


