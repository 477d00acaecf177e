"""A retrieval stack built from a configuration: index once, answer batches."""

from __future__ import annotations

import json
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import compile_filter
from ..operators import fusion
from ..operators.bm25 import BM25Index, BM25Options
from ..operators.chunking import get_chunker
from ..operators.hashing import HashingEmbedder, HashingOptions, encode_cached
from ..operators.store import build_store
from ..sources import files
from .config import MORE, PipelineConfig

EMBEDDERS: dict[str, Any] = {"hashing": lambda **a: HashingEmbedder(HashingOptions(**{k: tuple(v) if isinstance(v, list) else v for k, v in a.items()}))}


def register_embedder(name: str, make) -> None:
    """make(**embedder_args) gives an object with fit(chunks), encode(rows,
    id_col, text_col) and fingerprint; if it has encode_queries, queries are
    encoded by that."""
    EMBEDDERS[name] = make


class Prefixed:
    """An embedder whose model wants passages and queries marked by prefixes."""

    def __init__(self, inner, passage: str = "", query: str = ""):
        self.inner, self.passage, self.query = inner, passage, query

    @property
    def fingerprint(self) -> str:
        return f"{self.inner.fingerprint}:{self.passage!r}"

    def _marked(self, rows: DataFrame, text_col: str, mark: str) -> DataFrame:
        return rows.withColumn(text_col, F.concat(F.lit(mark), F.col(text_col)))

    def fit(self, chunks: DataFrame) -> Prefixed:
        return Prefixed(self.inner.fit(self._marked(chunks, "text", self.passage)), self.passage, self.query)

    def encode(self, rows: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
        return self.inner.encode(self._marked(rows, text_col, self.passage), id_col, text_col)

    def encode_queries(self, rows: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
        return self.inner.encode(self._marked(rows, text_col, self.query), id_col, text_col)


class Retriever:
    """What a stack asks for hits. register_retriever makes one of these known."""

    def index(self, stack: RetrievalPipeline) -> None:
        """Builds what it needs from stack.chunks."""

    def retrieve(self, stack: RetrievalPipeline, queries: DataFrame, k: int, among: DataFrame | None) -> DataFrame:
        """The k best chunks for each of (query_id, text): query_id, chunk_id,
        score, rank from 1, source. among: the chunk_ids a filter leaves."""
        raise NotImplementedError


def register_retriever(name: str, make) -> None:
    """make() gives a Retriever; PipelineConfig(retriever=name) takes it."""
    MORE["retriever"][name] = make


def register_reranker(name: str, rerank) -> None:
    """rerank(stack, pool, k, **rerank_args) gives the k best of the pool
    (query_id, chunk_id, score, rank, query, text), with new score, rank, source."""
    MORE["rerank"][name] = rerank


class RetrievalPipeline:
    """chunks, vectors and the inverted index as DataFrames, and the plan over them."""

    def __init__(self, config: PipelineConfig | None = None, chunker=None, embedder=None, scorer=None):
        self.config = c = config or PipelineConfig()
        self.chunker = chunker or get_chunker(c.chunker, **c.chunker_args)
        if embedder is None:
            if c.embedder not in EMBEDDERS:
                raise KeyError(f"no embedder {c.embedder!r}; there are {', '.join(sorted(EMBEDDERS))}")
            embedder = EMBEDDERS[c.embedder](**c.embedder_args)
        self.embedder, self.scorer, self.store = embedder, scorer, build_store(c.store, **c.store_args)
        self.retriever = MORE["retriever"][c.retriever]() if c.retriever in MORE["retriever"] else None
        h = dict(c.hybrid_args)
        self.fusion = h.pop("fusion", "rrf")
        if self.fusion not in ("rrf", "weighted"):
            raise ValueError(f"fusion {self.fusion!r} is neither rrf nor weighted")
        self.weights, self.multiplier = h.pop("weights", None), max(1, int(h.pop("candidate_multiplier", 4)))
        self.smoothing = h.pop("rrf_smoothing", 60)
        if h:
            raise ValueError(f"no such hybrid settings: {', '.join(sorted(h))}")
        if c.rerank == "cross-encoder" and scorer is None:
            raise ImportError("a cross-encoder needs a scorer; pass one")
        self.chunks: DataFrame | None = None
        self.bm25: BM25Index | None = None
        self.n_docs = 0
        self._owned: list[DataFrame] = []

    @property
    def vectors(self) -> DataFrame | None:
        return self.store.table

    def release(self) -> None:
        """Frees what index() keeps in memory; the stack answers nothing afterwards."""
        for table in self._owned:
            table.unpersist()
        self._owned, self.chunks, self.bm25 = [], None, None
        self.store.reset()

    def _own(self, table: DataFrame) -> DataFrame:
        self._owned.append(table := table.persist())
        return table

    def index(self, docs: DataFrame, shared: dict | None = None) -> RetrievalPipeline:
        """Chunks docs and builds what the retriever needs. Indexing again replaces all.

        shared: what stacks over the same docs need not work out again; each puts
        its chunks, vectors and postings there and takes those of equal settings."""
        c = self.config
        self.release()
        shared = {} if shared is None else shared
        self.n_docs = docs.select("doc_id").distinct().count()
        at = self.chunker.describe(), json.dumps(c.chunker_args, sort_keys=True)
        made = shared.setdefault(at, {})
        if "chunks" not in made:
            made["chunks"] = self._own(self.chunker.split(docs).dropDuplicates(["chunk_id"]))
        self.chunks = made["chunks"]
        if self.retriever is not None:
            self.retriever.index(self)
        if (self.retriever is None and c.retriever != "bm25") or c.rerank == "mmr":
            how = c.embedder, json.dumps(c.embedder_args, sort_keys=True), c.fit_embedder, c.embedder_cache
            if how not in made:
                made[how] = self._encoded()
            self.embedder, vectors = made[how]
            self.store.add(vectors)
        if self.retriever is None and c.retriever != "dense":
            o = BM25Options(**c.bm25_args)
            how = o.remove_stopwords, o.stem
            if how not in made:
                made[how] = self._inverted(BM25Index.build(self.chunks, o))
            self.bm25 = made[how].with_options(o.k1, o.b)
        return self

    def _encoded(self) -> tuple[Any, DataFrame]:
        """The embedder, fitted if asked for, and the chunks' vectors."""
        c, embedder = self.config, self.embedder
        if c.fit_embedder and not c.embedder_cache and hasattr(embedder, "fit_encode"):
            embedder, vectors, features = embedder.fit_encode(self.chunks)
            vectors = self._own(vectors)
            vectors.count()
            features.unpersist()
            return embedder, vectors
        if c.fit_embedder:
            embedder = embedder.fit(self.chunks)
        return embedder, self._through_cache(embedder, c.embedder_cache) if c.embedder_cache else self._own(embedder.encode(self.chunks))

    def _inverted(self, index: BM25Index) -> BM25Index:
        return BM25Index(*(self._own(t) for t in (index.postings, index.term_stats, index.stats)), index.options)

    def _through_cache(self, embedder, path: str) -> DataFrame:
        """Files of the cache that can't be read count as absent: their texts are encoded again."""
        spark = self.chunks.sparkSession
        schema = "fingerprint string, text_sha string, vec array<float>"
        there = files.exists(spark, path)
        cache = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path) if there else spark.createDataFrame([], schema)
        vectors, fresh = encode_cached(embedder, self.chunks, cache.dropDuplicates(["fingerprint", "text_sha"]))
        vectors = self._own(vectors)
        vectors.count()
        fresh.write.mode("append").parquet(path)
        return vectors

    def _query_vectors(self, queries: DataFrame) -> DataFrame:
        encode = getattr(self.embedder, "encode_queries", self.embedder.encode)
        return encode(queries.select("query_id", "text"), "query_id")

    def _base(self, queries: DataFrame, k: int, test: Column | None) -> DataFrame:
        c = self.config
        lists = []
        depth = k * self.multiplier if c.retriever == "hybrid" else k
        among = None if test is None else self.chunks.where(test).select("chunk_id")
        if self.retriever is not None:
            only = self.retriever.retrieve(self, queries, k, among)
            return only.withColumn("components", F.create_map(F.col("source"), F.col("score")))
        if c.retriever != "bm25":
            lists.append(self.store.search(self._query_vectors(queries), depth, among))
        if c.retriever != "dense":
            lists.append(self.bm25.retrieve(self.chunks, queries, depth, test))
        if len(lists) == 1:
            only = lists[0]
            return only.withColumn("components", F.create_map(F.col("source"), F.col("score")))
        if self.fusion == "rrf":
            return fusion.rrf(lists, k, self.weights, self.smoothing)
        return fusion.weighted(lists, k, self.weights)

    def retrieve(self, queries: DataFrame, k: int = 5, where: dict[str, Any] | Column | None = None) -> DataFrame:
        """Hits for a batch of queries (query_id, text): query_id, rank, score,
        source, components, chunk_id, doc_id, text, metadata. Blank queries have none."""
        if self.chunks is None:
            raise RuntimeError("nothing is indexed yet")
        test = None if where is None or (isinstance(where, dict) and not where) else where if isinstance(where, Column) else compile_filter(where)
        asked = queries.where(F.trim("text") != "").select("query_id", "text")
        c, args = self.config, dict(self.config.rerank_args)
        if c.rerank is None:
            found = self._base(asked, k, test)
        elif c.rerank == "mmr":
            pool = self._base(asked, k * int(args.get("candidate_multiplier", 4)), test)
            pool = pool.join(self.store.vectors_for(pool), "chunk_id").join(self._query_vectors(asked).withColumnRenamed("vec", "qvec"), "query_id")
            found = fusion.mmr(pool, k, args.get("lambda_mult", args.get("lambda_", 0.7))).withColumn("components", F.create_map(F.lit("mmr"), F.col("score")))
        else:
            pool = self._base(asked, k * int(args.get("candidate_multiplier", 5)), test)
            pool = pool.join(self.chunks.select("chunk_id", "text"), "chunk_id").join(asked.withColumnRenamed("text", "query"), "query_id")
            if c.rerank in MORE["rerank"]:
                found = MORE["rerank"][c.rerank](self, pool, k, **args).withColumn("components", F.create_map(F.col("source"), F.col("score")))
            else:
                found = fusion.rescore(pool, k, self.scorer, int(args.get("batch_size", 32)))
        return found.join(self.chunks.select("chunk_id", "doc_id", "text", "metadata"), "chunk_id").select(
            "query_id", "rank", "score", "source", "components", "chunk_id", "doc_id", "text", "metadata"
        )

    def search(self, query: str, k=5, where=None) -> DataFrame:
        """One query's hits in order."""
        one = self.chunks.sparkSession.createDataFrame([("q", query)], "query_id string, text string")
        return self.retrieve(one, k, where).orderBy("rank").limit(max(k, 0))

    def stats(self) -> dict[str, Any]:
        r = self.chunks.agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean"), F.max(F.length("text")).alias("most")).first()
        out = {
            "documents": self.n_docs, "chunks": r.n, "chunks_per_document": round(r.n / self.n_docs, 2) if self.n_docs else 0.0,
            "mean_chunk_chars": round(r["mean"] or 0.0, 1), "max_chunk_chars": r.most or 0,
        }
        if self.vectors is not None:
            head = self.vectors.first()
            out |= {"vectors": self.vectors.count(), "dim": len(head.vec) if head else 0}
        return out

    def describe(self) -> str:
        return f"{self.chunker.describe()} -> {self.config.embedder} -> {self.config.label}"

    def save(self, path: str) -> None:
        """Tables and a manifest below path, in place of what was there. Each save
        is a version of its own, so that a stack may be saved where it was loaded
        from; the version before the last goes."""
        spark = self.chunks.sparkSession
        old = json.loads(files.read_text(spark, f"{path}/pipeline.json") or "{}").get("version", -1)
        at = f"{path}/v{old + 1}"
        tables = {"chunks": self.chunks, "vectors": self.vectors}
        if self.bm25 is not None:
            tables |= {"postings": self.bm25.postings, "term_stats": self.bm25.term_stats, "stats": self.bm25.stats}
        for name, table in tables.items():
            if table is not None:
                # queries read the postings of a few terms: files sorted by term let the scan skip the rest
                table = table.repartitionByRange("term").sortWithinPartitions("term") if name in ("postings", "term_stats") else table
                table.write.mode("overwrite").parquet(f"{at}/{name}")
        idf = getattr(self.embedder, "idf", None)
        manifest = {
            "version": old + 1, "config": self.config.to_dict(), "documents": self.n_docs, "tag": getattr(self.embedder, "tag", "none"),
            "idf": None if idf is None else idf.tolist(), "vectors": self.vectors is not None, "postings": self.bm25 is not None,
        }
        files.write_text(spark, f"{path}/pipeline.json", json.dumps(manifest))
        files.remove(spark, f"{path}/v{old - 1}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> RetrievalPipeline:
        text = files.read_text(spark, f"{path}/pipeline.json")
        if text is None:
            raise FileNotFoundError(f"no saved index in {path}")
        m = json.loads(text)
        t = lambda n: spark.read.parquet(f"{path}/v{m['version']}/{n}")
        p = RetrievalPipeline(PipelineConfig.from_dict(m["config"]))
        if m["idf"] is not None:
            p.embedder = HashingEmbedder(p.embedder.options, np.array(m["idf"]), m["tag"])
        p.n_docs, p.chunks = m["documents"], t("chunks")
        if m["vectors"]:
            p.store.table = t("vectors")
        if m["postings"]:
            p.bm25 = BM25Index(t("postings"), t("term_stats"), t("stats"), BM25Options(**p.config.bm25_args))
        if p.retriever is not None:
            p.retriever.index(p)
        return p
