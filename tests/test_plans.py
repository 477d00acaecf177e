"""Sources, stacks, evaluation, command line, service and ingest."""

import json
import os
import threading
import urllib.error
import urllib.request
from pathlib import Path

import pytest

from corvid import cli
from corvid.operators.chunking import Sentence
from corvid.operators.hashing import HashingEmbedder, HashingOptions
from corvid.plans import report as R
from corvid.plans.config import PipelineConfig, ablation_grid, expand_grid, load_grid
from corvid.plans.evaluate import evaluate, run_sweep
from corvid.plans.pipeline import RetrievalPipeline
from corvid.plans.service import BadRequest, search, search_batch, serve
from corvid.sources import corpus as S
from corvid.streaming.ingest import current, start_ingest

#: A folder with the example collection (corpus/, evalset.jsonl), where there is one.
EXAMPLES = Path(os.environ.get("CORVID_EXAMPLES", "/nowhere"))

FILES = {
    "auth.md": '---\nid: auth\ntitle: "Signing in"\nnot a pair\n---\n\n# Keys\n\nAPI keys expire after ninety days. ERR_4029 means too many requests.\n',
    "sub/hooks.TXT": "We post events to your endpoint. Failed deliveries are retried for three days.",
    "bills.rst": "---\nsource: ledger\n---\nInvoices are sent monthly. Refunds take five business days.",
    "skip.csv": "a,b",
    "odd.md": "--- no front matter",
}
QUERIES = [
    {"id": "q1", "query": "what does ERR_4029 mean", "grades": {"auth": 1.0}},
    {"id": "q2", "query": "failed deliveries retried", "relevant_doc_ids": ["sub/hooks"]},
    {"query": "monthly invoices", "grades": {"bills": 1.0, "auth": 0.5}},
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus dir")
    for name, text in FILES.items():
        (root / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "docs" / name).write_text(text, "utf-8")
    (root / "q.jsonl").write_text("\n".join(map(json.dumps, QUERIES)) + "\n\n", "utf-8")
    (root / "q.json").write_text(json.dumps(QUERIES, indent=1), "utf-8")
    (root / "docs.jsonl").write_text('{"team": "x", "id": "a", "text": " one "}\n\n{"text": "two", "n": 3}\n', "utf-8")
    return root


@pytest.fixture(scope="module")
def stack(spark, folder):
    docs = S.load_documents(spark, str(folder / "docs"))
    return RetrievalPipeline(PipelineConfig(embedder_args={"dim": 128})).index(docs)


def test_directory(spark, folder):
    got = {r.doc_id: r for r in S.load_documents(spark, str(folder / "docs")).collect()}
    assert set(got) == {"auth", "sub/hooks", "bills", "odd"}
    assert got["auth"].text.startswith("# Keys") and got["auth"].metadata == {"title": "Signing in", "source": "auth.md"}
    assert got["bills"].metadata == {"source": "ledger"} and got["sub/hooks"].metadata == {"source": "sub/hooks.TXT"}
    assert got["odd"].text == "--- no front matter"
    with pytest.raises(FileNotFoundError):
        S.load_documents(spark, str(folder / "absent"))


def test_json_lines(spark, folder, tmp_path):
    got = sorted(map(tuple, S.load_documents(spark, str(folder / "docs.jsonl")).collect()))
    assert got == [("a", " one ", {"team": "x"}), ("doc-3", "two", {"n": "3"})]
    for text, message in (('{"id": 1}', "bad.jsonl:1"), ('{"text": "a"}\n{nope', "bad.jsonl:2")):
        (tmp_path / "bad.jsonl").write_text(text)
        with pytest.raises(Exception, match=message):
            S.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_queries(spark, folder, tmp_path):
    for name in ("q.jsonl", "q.json"):
        got = {r.text: r for r in S.load_queries(spark, str(folder / name)).collect()}
        assert got["monthly invoices"].relevant_doc_ids == ["bills", "auth"] and len(got["monthly invoices"].query_id) == 16
        assert got["failed deliveries retried"].relevant_doc_ids == ["sub/hooks"]
    q = S.load_queries(spark, str(folder / "q.jsonl"))
    S.write_queries(q, str(tmp_path / "out"))
    assert S.normalize_queries(spark.read.schema(S.QUERY_SCHEMA).json(str(tmp_path / "out"))).count() == 3
    (tmp_path / "none.jsonl").write_text('{"id": "x", "query": "a"}')
    with pytest.raises(ValueError, match="x"):
        S.load_queries(spark, str(tmp_path / "none.jsonl"))
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        S.load_queries(spark, str(tmp_path / "empty.jsonl"))


def test_configuration(tmp_path):
    c = PipelineConfig(rerank="mmr", chunker_args={"size": 64}, chunker="fixed")
    assert c.label == "fixed@64 / hashing / hybrid[rrf] / +mmr"
    c.to_json(str(tmp_path / "a" / "c.json"))
    assert PipelineConfig.from_file(str(tmp_path / "a" / "c.json")) == c
    for bad in ({"retriever": "x"}, {"rerank": "x"}, {"what": 1}):
        with pytest.raises(ValueError):
            PipelineConfig.from_dict(bad)
    assert len(expand_grid(PipelineConfig(), ablation_grid())) == 12
    (tmp_path / "g.json").write_text(json.dumps({"base": {"chunker": "fixed"}, "grid": {"retriever": ["bm25", "dense"]}}))
    assert [x.label for x in load_grid(str(tmp_path / "g.json"))] == ["fixed / hashing / bm25", "fixed / hashing / dense"]


def test_retrieve_save_and_load(spark, stack, tmp_path):
    best = stack.search("ERR_4029", 2).collect()
    assert best[0].doc_id == "auth" and set(best[0].components) <= {"dense", "bm25"}
    assert stack.search("  ", 2).count() == 0
    assert {r.doc_id for r in stack.search("days", 5, {"source": "ledger"}).collect()} <= {"bills"}
    stack.save(str(tmp_path / "ix"))
    back = RetrievalPipeline.load(spark, str(tmp_path / "ix"))
    assert [(r.chunk_id, round(r.score, 9)) for r in back.search("retried days", 3).collect()] == [(r.chunk_id, round(r.score, 9)) for r in stack.search("retried days", 3).collect()]
    assert stack.stats()["documents"] == 4 and stack.stats()["dim"] == 128
    with pytest.raises(FileNotFoundError):
        RetrievalPipeline.load(spark, str(tmp_path))


@pytest.mark.parametrize("retriever,rerank,fusion", [("dense", "mmr", "rrf"), ("bm25", None, "rrf"), ("hybrid", "mmr", "weighted"), ("hybrid", "cross-encoder", "rrf")])
def test_stacks(spark, folder, retriever, rerank, fusion):
    c = PipelineConfig(retriever=retriever, rerank=rerank, hybrid_args={"fusion": fusion}, embedder_args={"dim": 64})
    p = RetrievalPipeline(c, scorer=lambda pairs: [float(len(t)) for _, t in pairs]).index(S.load_documents(spark, str(folder / "docs")))
    got = p.retrieve(S.load_queries(spark, str(folder / "q.jsonl")), 2)
    ranks = {}
    for r in got.collect():
        ranks.setdefault(r.query_id, []).append(r["rank"])
    assert len(ranks) == 3 and all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 2 for v in ranks.values())


def test_embedding_cache(spark, folder, tmp_path):
    docs = S.load_documents(spark, str(folder / "docs"))
    c = PipelineConfig(embedder_cache=str(tmp_path / "cache"), embedder_args={"dim": 32}, retriever="dense")
    one, two = (RetrievalPipeline(c).index(docs).search("days", 3).collect() for _ in range(2))
    assert [r.chunk_id for r in one] == [r.chunk_id for r in two] and spark.read.parquet(str(tmp_path / "cache")).count() == 4


def test_evaluate_sweep_and_reports(spark, folder, stack, tmp_path):
    q = S.load_queries(spark, str(folder / "q.jsonl"))
    r = evaluate(stack, q)
    assert r.metrics["recall@10"] == 1.0 and r.n_queries == 3 and r.metrics["recall@1"] <= r.metrics["recall@3"] <= r.metrics["recall@5"]
    assert "recall" in R.eval_text(r, [1, 3]) and r.confidence_interval("mrr")[1] <= 1
    assert 0 < r.latency_ms["p50"] <= r.latency_ms["p95"] <= r.latency_ms["max"] and "p95" in R.eval_text(r, [1, 3])
    assert sorted(x["latency_ms"] for x in r.per_query)[-1] == r.latency_ms["max"]
    assert set(evaluate(stack, q, timed=0).latency_ms) == {"mean"}
    assert latencies([1.0, 2.0, 3.0, 4.0]) == {"mean": 2.5, "p50": 2.5, "p95": pytest.approx(3.85), "max": 4.0}
    docs = S.load_documents(spark, str(folder / "docs"))
    configs = [PipelineConfig(retriever="bm25"), PipelineConfig(chunker="none"), PipelineConfig(retriever="bm25", chunker="fixed")]
    s = run_sweep(configs, docs, q, ks=[1, 5])
    assert "p95 ms" in R.sweep_text(s) and "ndcg" in R.sweep_text(s)
    assert s.ranked()[-1]["error"].startswith("KeyError") and s.best is not None and 0 <= s.spread <= 1
    R.sweep_html(s, str(tmp_path / "s.html"))
    r.label = "<b>x</b>"
    R.eval_html(r, str(tmp_path / "e.html"), [1, 5])
    assert "&lt;b&gt;x" in (tmp_path / "e.html").read_text() and "<b>x" not in (tmp_path / "e.html").read_text()
    assert R.table(["a"], []) == "(no rows)"


def test_sweep_shares_tables(spark, folder, monkeypatch):
    """Chunks are split once for each chunker, and nothing stays in memory."""
    docs, q = S.load_documents(spark, str(folder / "docs")), S.load_queries(spark, str(folder / "q.jsonl"))
    split = []
    plain = Sentence.split
    monkeypatch.setattr(Sentence, "split", lambda self, d: split.append(1) or plain(self, d))
    args = {"embedder_args": {"dim": 32}}
    configs = [PipelineConfig(retriever="bm25"), PipelineConfig(retriever="hybrid", **args), PipelineConfig(retriever="dense", **args), PipelineConfig(retriever="bm25", bm25_args={"b": 0.0})]
    spark.catalog.clearCache()
    shared = run_sweep(configs, docs, q, ks=[1, 5], timed=0)
    assert len(split) == 1 and spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    alone = [evaluate(RetrievalPipeline(c).index(docs), q, [1, 5], timed=0).metrics for c in configs]
    assert [r["metrics"] for r in shared.rows] == alone


def test_saved_over_its_own_source(spark, stack, tmp_path):
    at = str(tmp_path / "ix")
    want = [r.chunk_id for r in stack.search("days", 3).collect()]
    stack.save(at)
    for _ in range(3):
        p = RetrievalPipeline.load(spark, at)
        p.save(at)
    assert [r.chunk_id for r in RetrievalPipeline.load(spark, at).search("days", 3).collect()] == want
    assert sorted(x.name for x in (tmp_path / "ix").iterdir() if x.is_dir()) == ["v2", "v3"]


def test_stores(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(i, [float(a), float(b)]) for i, a, b in x], "chunk_id string, vec array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vec array<float>")
    for make in (VectorStore, lambda: ParquetStore(str(tmp_path / "store"), spark)):
        s = make()
        assert len(s) == 0
        s.add(rows(("a", 1, 0), ("b", 0, 1)))
        s.add(rows(("b", 1, 1), ("b", 1, 2), ("c", -1, 0)))
        s.persist()
        assert len(s) == 3 and [r.vec for r in s.vectors_for(rows(("b", 0, 0))).collect()] == [[1.0, 2.0]]
        assert [r.chunk_id for r in s.search(asked, 2).orderBy("rank").collect()] == ["a", "b"]
        assert [r.chunk_id for r in s.search(asked, 2, rows(("c", 0, 0))).collect()] == ["c"]
        assert [r.chunk_id for r in s.get(spark.createDataFrame([(0, "c"), (1, "x"), (2, "a")], "position int, chunk_id string")).collect()] == ["c", "a"]
        if isinstance(s, ParquetStore):
            assert len(ParquetStore(s.path, spark)) == 3
        s.reset()
        assert len(s) == 0
    with pytest.raises(ImportError):
        build_store("qdrant")
    with pytest.raises(KeyError):
        build_store("none")
    assert available_stores() == ["chroma", "memory", "parquet", "qdrant"]


def test_what_users_add(spark, folder, stack):
    class Counting(VectorStore):
        name, asked = "counting", 0

        def search(self, *a):
            Counting.asked += 1
            return super().search(*a)

    class Shortest(Retriever):
        def retrieve(self, stack, queries, k, among):
            rows = stack.chunks if among is None else stack.chunks.join(among, "chunk_id", "left_semi")
            best = rows.select("chunk_id", (-F.length("text")).cast("double").alias("score")).orderBy(F.desc("score")).limit(k)
            best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score")))).withColumn("source", F.lit("short"))
            return queries.select("query_id").crossJoin(best)

    register_store(Counting)
    register_retriever("shortest", Shortest)
    register_reranker("last first", lambda stack, pool, k: pool.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank")))).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank", F.lit("turned").alias("source")))
    docs, q = S.load_documents(spark, str(folder / "docs")), S.load_queries(spark, str(folder / "q.jsonl"))
    try:
        p = RetrievalPipeline(PipelineConfig(retriever="dense", store="counting", embedder_args={"dim": 16})).index(docs)
        assert p.retrieve(q, 1).count() == 3 and Counting.asked == 1 and len(p.store) == p.chunks.count()
        p = RetrievalPipeline(PipelineConfig(retriever="shortest", rerank="last first", rerank_args={})).index(docs)
        got = p.retrieve(q, 2).collect()
        assert len(got) == 6 and {r.source for r in got} == {"turned"}
        p.release()
        with pytest.raises(RuntimeError):
            p.retrieve(q, 1)
        seen = []
        inner = HashingEmbedder(HashingOptions(dim=16, use_idf=False))
        monkey = Prefixed(inner, "passage: ", "query: ")
        assert monkey.fingerprint != inner.fingerprint
        one = spark.createDataFrame([("x", "a")], "query_id string, text string")
        assert monkey.encode_queries(one).first().vec == inner.encode(one.withColumn("text", F.lit("query: a")), "query_id").first().vec
        assert not seen
    finally:
        del STORES["counting"], MORE["retriever"]["shortest"], MORE["rerank"]["last first"]


def test_corrupt_cache_files_are_absent(spark, folder, tmp_path):
    docs, at = S.load_documents(spark, str(folder / "docs")), tmp_path / "cache"
    c = PipelineConfig(embedder_cache=str(at), embedder_args={"dim": 32}, retriever="dense")
    want = [r.chunk_id for r in RetrievalPipeline(c).index(docs).search("days", 3).collect()]
    for f in at.glob("*.parquet"):
        f.write_bytes(b"no parquet")
        (at / f".{f.name}.crc").unlink(missing_ok=True)
    spark.catalog.clearCache()
    assert [r.chunk_id for r in RetrievalPipeline(c).index(docs).search("days", 3).collect()] == want


def test_json_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [json.dumps({"text": f"line {k} " + "x" * (k % 50), "tags": ["a", "b"], "n": 5, "none": None}) if k % 7 else "" for k in range(1, 400)]
    (tmp_path / "d.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        docs = S.read_jsonl(spark, str(tmp_path / "d.jsonl"))
        assert docs.rdd.getNumPartitions() > 1
        got = docs.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.doc_id, r.text.split()[1]) for r in got} == {(f"doc-{k}", str(k)) for k in range(1, 400) if k % 7}
    assert got[0].metadata == {"tags": "a, b", "n": "5"}


def test_command_line(spark, folder, tmp_path, capsys):
    docs, q, ix = str(folder / "docs"), str(folder / "q.jsonl"), str(tmp_path / "ix")
    assert cli.main(["index", "--corpus", docs, "--out", ix, "--retriever", "bm25"]) == 0
    assert cli.main(["query", "ERR_4029", "--index", ix, "--json", "-k", "1"]) == 0
    out = capsys.readouterr().out
    assert json.loads(out[out.index("{") :])["hits"][0]["doc_id"] == "auth"
    assert cli.main(["query", "--where", "{bad", "--index", ix, "x"]) == 2
    one, two = str(tmp_path / "1.json"), str(tmp_path / "2.json")
    assert cli.main(["eval", "--queries", q, "--index", ix, "--json", one, "--min-recall", "0.8"]) == 0
    assert cli.main(["eval", "--queries", q, "--corpus", docs, "--retriever", "bm25", "--json", two, "--gate-k", "7", "--min-recall", "0.5"]) == 1
    assert cli.main(["compare", one, two]) == 0 and "the same" in capsys.readouterr().out
    (tmp_path / "u.jsonl").write_text('{"id": "u", "query": "a", "relevant_doc_ids": ["absent"]}')
    assert cli.main(["eval", "--queries", str(tmp_path / "u.jsonl"), "--corpus", docs]) == 2
    assert cli.main(["eval", "--queries", q, "--index", str(tmp_path / "no")]) == 2
    (tmp_path / "g.json").write_text('[{"retriever": "bm25"}]')
    best = tmp_path / "best.json"
    assert cli.main(["sweep", "--corpus", docs, "--queries", q, "--grid", str(tmp_path / "g.json"), "--quiet", "--save-best", str(best)]) == 0
    assert PipelineConfig.from_file(str(best)).retriever == "bm25"


def test_service(spark, stack):
    with pytest.raises(BadRequest):
        search(stack, " ")
    with pytest.raises(BadRequest):
        search(stack, "a", 101)
    q = spark.createDataFrame([("a", "days"), ("b", " ")], "query_id string, text string")
    assert {r.query_id for r in search_batch(stack, q, 3).collect()} == {"a"}
    server = serve(stack, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        assert json.load(urllib.request.urlopen(at + "/health"))["status"] == "ok"
        assert json.load(urllib.request.urlopen(at + "/search?q=ERR_4029&k=1"))["hits"][0]["doc_id"] == "auth"
        post = urllib.request.Request(at + "/search", json.dumps({"query": "days", "where": {"source": "ledger"}}).encode())
        assert {h["doc_id"] for h in json.load(urllib.request.urlopen(post))["hits"]} == {"bills"}
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(at + "/search?q=")
    finally:
        server.shutdown()


def test_ingest(spark, tmp_path):
    src, at = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    stream = spark.readStream.schema("doc_id string, text string").json(str(src))
    for k, rows in enumerate(([("a", "One here. Two there."), ("b", "bee")], [("a", "Changed.")])):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"doc_id": i, "text": t}) for i, t in rows))
        start_ingest(stream, at, str(tmp_path / "cp"), Sentence(), HashingEmbedder(HashingOptions(dim=16))).awaitTermination(120)
    assert sorted((r.doc_id, r.text, len(r.vec)) for r in current(spark, at).collect()) == [("a", "Changed.", 16), ("b", "bee", 16)]


@pytest.mark.skipif(not EXAMPLES.is_dir(), reason="the example collection isn't there")
def test_published_quality_is_met(spark):
    docs, q = S.load_documents(spark, str(EXAMPLES / "corpus")), S.load_queries(spark, str(EXAMPLES / "evalset.jsonl"))
    want = {"bm25": (0.808, 0.925, 0.975, 0.918, 0.929), "dense": (0.758, 0.892, 0.933, 0.883, 0.895), "hybrid": (0.817, 0.933, 0.967, 0.931, 0.935)}
    for retriever, figures in want.items():
        p = RetrievalPipeline(PipelineConfig(chunker="sentence", retriever=retriever, embedder_args={"dim": 1024})).index(docs)
        assert p.chunks.count() == 62
        m = evaluate(p, q).metrics
        got = [m[k] for k in (*(f"recall@{k}" for k in (1, 3, 5)), "mrr", "ndcg@10")]
        assert got == pytest.approx(figures, abs=0.012), (retriever, got)
