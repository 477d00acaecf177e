"""Worked examples and brute-force versions of the retrieval engine."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvid import queries as engine
from corvid.functions import metrics as M
from corvid.functions import text as T
from corvid.functions.filters import compile_filter
from corvid.functions.terms import tokens
from corvid.operators import bm25_scan, fusion
from corvid.operators import chunking as C
from corvid.operators.bm25 import BM25Index, BM25Options
from corvid.operators.dense import dense_search, get, upsert
from corvid.operators.hashing import HashingEmbedder, HashingOptions, encode_cached, fnv1a, hash_features
from corvid.operators.ranking import as_context

CORPUS = [
    ("auth", "# Signing in\n\nUse an API key. Keys expire after ninety days.\n\n## Errors\n\nERR_4029 means too many requests."),
    ("hooks", "# Webhooks\n\nWe post events to your endpoint. Failed deliveries are retried for three days."),
    ("bills", "# Billing\n\nInvoices are sent monthly. Refunds take five business days."),
    ("roles", "# Roles\n\nAdmins can invite members. Members can read invoices."),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, i, t, {"n": str(k), "even": "yes" if k % 2 == 0 else "no"}) for k, (i, t) in enumerate(CORPUS)], "chunk_id string, doc_id string, text string, metadata map<string,string>").cache()


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "query_id string, text string")


def column(spark, f, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


# ---- text


def test_words_and_terms(spark):
    got = column(spark, T.word_tokens, ["ñandú's well-known, x_1!", ""])
    assert got == [["ñandú's", "well-known", ",", "x_1", "!"], []]
    assert column(spark, T.terms, ["ERR_4029: The retries were failing, classes boxes policies bus is"]) == [["err", "4029", "retry", "fail", "class", "box", "policy", "bus"]]
    stems = {"wishes": "wish", "ring": "ring", "going": "going", "bring": "bring", "walking": "walk", "used": "used", "asked": "ask", "glass": "glass", "cats": "cat", "his": "his", "ties": "tie", "flies": "fly"}
    assert dict(zip(stems, column(spark, T.stem, list(stems)))) == stems


def test_sentences(spark):
    texts = ['He met Dr. Who. "Fine." said e.g. Ann. See Fig. 3 now! Next (one) here.', "No end\n\nNew block. A", "", "Mr. X. Y went. 5 came?  \"Yes\" it is."]
    assert column(spark, T.sentences, texts) == [C.sentence_list(t) for t in texts]
    assert C.sentence_list("One is here. Two is there! 3 too.") == ["One is here.", "Two is there!", "3 too."]


def test_snippet(spark):
    assert column(spark, lambda c: T.snippet(c, 10), ["a  b\n c", "abcdefgh ijkl"]) == ["a b c", "abcdefgh…"]


# ---- chunkers


def simulate(sizes, size, overlap):
    """The packing told step by step."""
    out, cur, k = [], [], 0
    while k < len(sizes):
        if cur and sum(sizes[i] for i in cur) + sizes[k] > size:
            out.append((cur[0], cur[-1] + 1))
            tail = []
            for i in reversed(cur):
                if sum(sizes[j] for j in tail) + sizes[i] > overlap:
                    break
                tail.insert(0, i)
            cur = [] if len(tail) == len(cur) else tail
        else:
            cur.append(k)
            k += 1
    return out + ([(cur[0], cur[-1] + 1)] if cur else [])


def test_packing_equals_its_simulation():
    rng = random.Random(3)
    for _ in range(3000):
        size = rng.randrange(1, 30)
        overlap = rng.randrange(size)
        sizes = [rng.randrange(1, 14) for _ in range(rng.randrange(25))]
        assert C.pack(sizes, sizes, size, overlap) == simulate(sizes, size, overlap)


def test_fixed_windows(spark):
    words = " ".join(f"t{k}" for k in range(23))
    for size, overlap in ((10, 3), (23, 0), (5, 4), (100, 10)):
        out, at = [], 0
        while True:
            out.append(" ".join(words.split()[at : at + size]))
            if at + size >= 23:
                break
            at += size - overlap
        docs = spark.createDataFrame([("d", words), ("e", "")], "doc_id string, text string")
        got = C.Fixed(size, overlap).split(docs).orderBy("position").collect()
        assert [r.text for r in got] == out and [r.position for r in got] == list(range(len(out)))


def test_recursive_and_markdown():
    r = C.Recursive(40, 8)
    text = "# A\n\n" + "word " * 30 + "\n## B\n" + "x" * 100
    pieces = r.pieces_of(text)
    assert all(len(p) <= 40 + 8 + 5 for p in pieces) and "x" * 40 in "".join(pieces)
    md = C.Markdown(60, 5).pieces_of("intro\n# One\n\nbody one\n### Deep\nbody two\n# Empty\n# Two\nlast")
    assert md == ["intro", "One\n\nbody one", "One >  > Deep\n\nbody two", "Two\n\nlast"]
    assert C.Markdown(60, 5, include_trail=False).pieces_of("# T\nx") == ["x"]
    assert len(C.Markdown(60, 5).pieces_of("# T\n" + "many words here " * 20)) > 4


def test_chunk_ids_positions_and_metadata(spark):
    docs = spark.createDataFrame([("d", "a\n\n\n\n b", {"k": "v"}), ("e", " \n ", {})], "doc_id string, text string, metadata map<string,string>")
    import hashlib

    (row,) = C.Sentence().split(docs).collect()
    assert row.text == "a b" and row.metadata == {"k": "v", "chunker": "sentence"}
    assert row.chunk_id == hashlib.sha1("\x1f".join(["d", "0", "a b"]).encode()).hexdigest()[:16]


def test_chunker_settings():
    for make in (lambda: C.Fixed(0), lambda: C.Sentence(5, 5), lambda: C.Recursive(5, -1)):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(KeyError, match="fixed"):
        C.get_chunker("none")
    assert C.get_chunker("fixed", size=8, overlap=1).describe() == "fixed(size=8, overlap=1)"


# ---- filters


@pytest.mark.parametrize(
    "where,want",
    [
        ({"n": 2}, {"hooks": 0, "bills": 1}), ({"n": {"$eq": "2"}}, {"bills": 1}), ({"even": "yes", "n": {"$gt": 1}}, {"bills": 1, "auth": 0}),
        ({"n": {"$ne": 2}}, {"bills": 0, "auth": 1}), ({"gone": {"$ne": 2}}, {"auth": 1}), ({"gone": None}, {"auth": 1}), ({"gone": {"$in": ["x", None]}}, {"auth": 1}),
        ({"gone": {"$in": ["x"]}}, {"auth": 0}), ({"gone": {"$nin": ["x"]}}, {"auth": 1}), ({"even": {"$gte": 1}}, {"auth": 0}), ({"gone": {"$lt": 5}}, {"auth": 0}),
        ({"n": {"$gte": 1, "$lt": 3}}, {"hooks": 1, "bills": 1, "roles": 0}), ({}, {"auth": 1}), ({"n": {}}, {"auth": 1}), ({"n": {"$lte": "1"}}, {"hooks": 1, "bills": 0}),
    ],
)
def test_filters(chunks, where, want):
    kept = {r.chunk_id for r in chunks.where(compile_filter(where)).collect()}
    assert all((k in kept) == bool(v) for k, v in want.items())


def test_filters_unknown_and_nan(spark):
    with pytest.raises(ValueError, match="like"):
        compile_filter({"a": {"$like": 1}})
    df = spark.createDataFrame([({"x": "nan"},)], "metadata map<string,string>")
    assert df.where(compile_filter({"x": {"$gt": 1}})).count() == df.where(compile_filter({"x": {"$lt": 1}})).count() == 0


# ---- retrieval


def test_bm25_equals_its_formula(spark, chunks):
    ix = BM25Index.build(chunks)
    q = "invoices days invoices ERR_4029"
    got = {r.chunk_id: r.score for r in ix.retrieve(chunks, asked(spark, q), 10).collect()}
    toks = dict(zip([c for c, _ in CORPUS], column(spark, T.terms, [t for _, t in CORPUS])))
    (asked_terms,) = column(spark, T.terms, [q])
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    for name, w in toks.items():
        s = 0.0
        for t in asked_terms:
            df, tf = sum(t in x for x in toks.values()), w.count(t)
            if tf:
                s += max(math.log(1 + (n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avg))
        assert abs(got.get(name, 0.0) - s) < 1e-9
    assert max(got, key=got.get) == "auth"
    assert ix.retrieve(chunks, asked(spark, "", "the of"), 5).count() == 0 and ix.retrieve(chunks, asked(spark, q), 0).count() == 0
    # a filter leaves the statistics alone
    part = {r.chunk_id: r.score for r in ix.retrieve(chunks, asked(spark, q), 10, {"even": "yes"}).collect()}
    assert part == {k: v for k, v in got.items() if k in ("auth", "bills")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_texts(seed, n):
    rng = random.Random(seed)
    words = "the of bus boxes box policies policy passing passed pass well-known it's glass a'b -x- ring İs Key É1 err_4029".split()
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(25))) for _ in range(n)] + [None, "", "the of"]


def test_bm25_scan_equals_postings(spark, monkeypatch):
    """Texts scored where they lie give what the join of postings gives, with
    queries in several blocks, a filter, other settings and ties."""
    texts = random_texts(5, 90) + ["box glass"] * 9
    chunks = spark.createDataFrame([(k, t, k % 3) for k, t in enumerate(texts)], "chunk_id long, text string, third int").repartition(5)
    q = asked(spark, *[t or "" for t in random_texts(6, 7)], "box box glass").cache()
    plain = BM25Options(0.9, 0.4, remove_stopwords=False, stem=False)
    for pairs, cells, options, k, where in ((1 << 18, 1 << 20, BM25Options(), 500, None), (25, 40, plain, 4, None), (25, 40, BM25Options(), 3, {"third": 1})):
        monkeypatch.setattr(bm25_scan, "PAIRS", pairs)
        monkeypatch.setattr(bm25_scan, "CELLS", cells)
        ix = BM25Index.build(chunks, options)
        stored = BM25Index(ix.postings, ix.term_stats, ix.stats, options)
        got, want = ({(r.query_id, r["rank"], r.chunk_id): r.score for r in x.retrieve(chunks, q, k, where).collect()} for x in (ix, stored))
        assert got == pytest.approx(want, abs=1e-9) and got
    ask = BM25Index.build(chunks).ask(q, ["third"])
    ids, raw = zip(*q.collect())
    terms = [set(x) for x in column(spark, T.terms, raw)]
    held = [set(x or ()) for x in column(spark, T.terms, texts)]
    df = lambda t: sum(t in h for h in held)
    rare = [{t for t in x if math.log1p((len(texts) - df(t) + 0.5) / (df(t) + 0.5)) >= 1} for x in terms]
    want = {(i, k, len(r & h)) for i, r in zip(ids, rare) for k, h in enumerate(held) if len(r & h) >= 2}
    assert want == set(map(tuple, ask.shared(1, 2).collect()))
    ask.release()


def test_sweep_shares_rows_and_shuffles_no_pairs(spark, monkeypatch):
    """Four settings of the scores: the texts are read for one table of rows, and
    nothing is joined on terms or summed up by query and text."""
    made = []
    monkeypatch.setattr(bm25_scan.Asked, "__init__", lambda self, *a, f=bm25_scan.Asked.__init__, **k: made.append(self) or f(self, *a, **k))
    shown = plan(engine.sweep_leaderboard(spark, "/root/testdata/sf0.001"))
    assert len(made) == 1 and "term#" not in shown and "keys=[query_id#" in shown
    assert not any(x in line for line in shown.splitlines() if "keys=[" in line for x in ("chunk_id#", "term#"))


def test_terms_of_batches_equal_the_pattern():
    import re

    rng = random.Random(7)
    texts = ["".join(rng.choice("ab1'-- \nÉKİ_Zß") for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", None, "'", "-a-"]
    found, n = tokens(texts)
    assert found.to_pylist() == [w for t in texts for w in re.findall(T.TERMS, (t or "").lower())]
    assert n.tolist() == [len(re.findall(T.TERMS, (t or "").lower())) for t in texts] and tokens([])[0].to_pylist() == []


def test_dense_search(spark):
    rng = np.random.default_rng(2)
    m, q = rng.normal(size=(150, 8)), rng.normal(size=(7, 8))
    m[20] = m[40] = m[60]
    vectors = spark.createDataFrame([(k, v.tolist(), {"p": str(k % 2)}) for k, v in enumerate(m)], "chunk_id long, vec array<float>, metadata map<string,string>").repartition(5)
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate([*q, m[40]])], "query_id long, vec array<float>")
    unit = lambda x: x.astype(np.float32).astype(float) / np.linalg.norm(x.astype(np.float32).astype(float), axis=-1, keepdims=True)
    for k, where in ((5, None), (200, None), (4, {"p": 1})):
        got = {}
        for r in dense_search(vectors, queries, k, where).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.chunk_id
        for i, v in enumerate([*q, m[40]]):
            s = unit(m) @ unit(v)
            best = sorted((j for j in range(150) if where is None or j % 2), key=lambda j: (-round(s[j], 9), j))[:k]
            assert [got[i][r] for r in sorted(got[i])] == best
    assert dense_search(vectors, queries, 0).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        dense_search(vectors, spark.createDataFrame([(1, [1.0])], "query_id long, vec array<float>"), 1).collect()


def test_dense_search_in_blocks(spark, monkeypatch):
    """Ids that are text, equal vectors, queries in several blocks; a task hands
    on k rows per query, however many come nearer bit by bit or are equal."""
    from corvid.operators import dense as D

    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 6)).astype(np.float32).astype(float)
    m[50:90] = m[7]
    q = m[:40]
    order = np.argsort(m @ m[0])  # ever nearer to the first query
    batches = [pa.record_batch({"chunk_id": pa.array([f"v{k:03}" for k in part]), "vec": pa.array(m[part].tolist())}) for part in np.array_split(order, 9)]
    out = pa.Table.from_batches(D._best(iter(batches), pa.array(range(40)), D.normalized(q), 5, pa.string()))
    assert out.num_rows == 40 * 5
    monkeypatch.setattr(D, "SCAN_BYTES", 9 * (20 * 6 + 16 * 5))
    vectors = spark.createDataFrame([(f"v{k:03}", v.tolist()) for k, v in enumerate(m)], "chunk_id string, vec array<double>").repartition(4)
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "query_id long, vec array<double>")
    assert [len(ids) for ids, _ in D.query_blocks(queries, k=5)] == [9, 9, 9, 9, 4]
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, r + 1, f"v{j:03}") for i in range(40) for r, j in enumerate(sorted(range(300), key=lambda j: (-round(unit[i] @ unit[j], 9), j))[:5])}  # noqa: B023
    assert {(r.query_id, r["rank"], r.chunk_id) for r in dense_search(vectors, queries, 5).collect()} == want


def test_upsert_and_get(spark):
    schema = "chunk_id string, v int"
    store = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    new = spark.createDataFrame([("b", 3), ("c", 4), ("c", 5)], schema)
    out = upsert(store, new, order="v")
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", 3), ("c", 5)]
    ids = spark.createDataFrame([(0, "c"), (1, "x"), (2, "a")], "position int, chunk_id string")
    assert [r.chunk_id for r in get(out, ids).collect()] == ["c", "a"]


def test_fnv_known_values():
    assert [hex(x) for x in fnv1a(["", "a", "foobar"]).tolist()] == ["0xcbf29ce484222325", "0xaf63dc4c8601ec8c", "0x85944171f73967e8"]


def test_hashing_embedder(spark, chunks):
    o = HashingOptions(dim=64)
    e = HashingEmbedder(o).fit(chunks)
    got = {r.chunk_id: np.array(r.vec) for r in e.encode(chunks).collect()}
    feats = {i: o.features(t) for i, t in CORPUS}
    where = {f: (int(h % np.uint64(64)), 1 if h >> np.uint64(63) else -1) for fs in feats.values() for f, h in zip(fs, fnv1a(fs))}
    df = np.zeros(64)
    for fs in feats.values():
        df[list({where[f][0] for f in fs})] += 1
    for i, fs in feats.items():
        v = np.zeros(64)
        for f in fs:
            v[where[f][0]] += where[f][1]
        v = np.sign(v) * np.log1p(abs(v)) * (np.log(5 / (df + 1)) + 1)
        assert np.allclose(got[i], v / np.linalg.norm(v), atol=1e-6)
    assert hash_features(chunks, o).where("bucket >= 64 or bucket < 0").count() == 0
    assert not e.vectors([""]).any() and HashingOptions().features("ab cde") [:3] == ["ab", "cde", "ab_cde"]
    with pytest.raises(ValueError):
        HashingOptions(dim=0)
    cache = spark.createDataFrame([], "fingerprint string, text_sha string, vec array<float>")
    vectors, fresh = encode_cached(e, chunks, cache)
    assert vectors.count() == fresh.count() == 4
    assert encode_cached(e, chunks, fresh)[1].count() == 0


def hits(spark, source, *lists):
    rows = [(f"q{q}", c, s, r, source) for q, l in enumerate(lists) for r, (c, s) in enumerate(l, 1)]
    return spark.createDataFrame(rows, "query_id string, chunk_id string, score double, rank int, source string")


def test_fusion(spark):
    a = hits(spark, "dense", [("x", 0.9), ("y", 0.5), ("z", 0.1)])
    b = hits(spark, "bm25", [("y", 7.0), ("w", 7.0)])
    got = {r.chunk_id: r for r in fusion.rrf([a, b], 10, [1.0, 2.0]).collect()}
    assert got["y"].score == pytest.approx(1 / 62 + 2 / 61) and got["y"]["rank"] == 1 and got["y"].components == {"dense": 0.5, "bm25": 7.0}
    assert [r.chunk_id for r in sorted(got.values(), key=lambda r: r["rank"])] == ["y", "w", "x", "z"]
    flat = {r.chunk_id: r.score for r in fusion.weighted([a, b], 10).collect()}
    assert flat == pytest.approx({"x": 1.0, "y": 1.5, "z": 0.0, "w": 1.0})
    assert dict(fusion.contributions(fusion.rrf([a, b], 10)).select("chunk_id", "sources").collect())["y"] == "bm25,dense"
    with pytest.raises(ValueError):
        fusion.rrf([a, b], 3, [1.0])
    tie = fusion.rrf([hits(spark, "s", [("p", 1.0)]), hits(spark, "t", [("o", 1.0)])], 2).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == ["p", "o"]


def test_mmr(spark):
    rng = np.random.default_rng(4)
    rows, plan = [], {}
    for q in range(6):
        m, t = rng.normal(size=(15, 5)), rng.normal(size=5)
        m[1:5] = m[0]
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        t /= np.linalg.norm(t)
        rows += [(q, k, k + 1, 0.0, m[k].tolist(), t.tolist()) for k in range(15)]
        picks, rel = [], m @ t
        while len(picks) < 5:
            value = lambda k: rel[k] if not picks else 0.7 * rel[k] - 0.3 * max(m[k] @ m[j] for j in picks)  # noqa: B023, E731
            picks.append(max((k for k in range(15) if k not in picks), key=lambda k: (round(value(k), 9), -k)))
        plan[q] = picks
    pool = spark.createDataFrame(rows, "query_id int, chunk_id int, rank int, score double, vec array<double>, qvec array<double>")
    for q, picks in plan.items():
        got = fusion.mmr(pool, 5).where(F.col("query_id") == q).orderBy("rank").collect()
        assert [r.chunk_id for r in got] == picks
    with pytest.raises(ValueError):
        fusion.mmr(pool, 5, 1.5)


def test_mmr_of_uneven_pools_without_a_call_per_query(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for q in range(12):
        n = q % 4 + 1
        m, t = rng.normal(size=(n, 5)), rng.normal(size=5)
        rows += [(f"q{q}", f"c{k}", k + 1, 9.0, m[k].tolist(), t.tolist()) for k in range(n)]
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        rel, picks = u @ (t / np.linalg.norm(t)), []
        while len(picks) < min(3, n):
            picks.append(max((k for k in range(n) if k not in picks), key=lambda k: 0.5 * rel[k] - 0.5 * max((u[k] @ u[j] for j in picks), default=0)))  # noqa: B023
        want |= {(f"q{q}", r + 1, f"c{k}"): rel[k] if n > 1 else 9.0 for r, k in enumerate(picks)}
    pool = spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, score double, vec array<float>, qvec array<float>")
    out = fusion.mmr(pool, 3, 0.5)
    assert {(r.query_id, r["rank"], r.chunk_id): r.score for r in out.collect()} == pytest.approx(want, abs=1e-6)
    assert "InPandas" not in plan(out)


def test_long_texts_are_taken_apart_by_bytes(spark, monkeypatch):
    """Features and chunks: a worker holds a slice of texts, not thousands of them."""
    from pyspark.sql.functions import pandas_udf

    from corvid.operators import batches
    from corvid.operators import hashing as H

    taken, counts = [], H._counts
    monkeypatch.setattr(H, "_counts", lambda texts, o: taken.append(sum(map(len, texts))) or counts(texts, o))
    batch = pa.record_batch({"chunk_id": pa.array(range(900)), "text": pa.array(["some words " * 200] * 900), "key": pa.array(range(900))})
    assert sum(b.num_rows for b in H._sparse(iter([batch]), HashingOptions())) == 900 and max(taken) <= batches.SLICE
    spark.conf.unset(batches._BATCH)
    docs = spark.range(300, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("Some words. "), 9000).alias("text"))
    C.Sentence().split(docs)
    held = pandas_udf(lambda s: s.str.len() * 0.0 + len(s), "double")
    assert docs.select(held("text").alias("n")).agg(F.max("n")).first()[0] <= 80


def test_rescore(spark):
    pool = spark.createDataFrame([("q", "ask", c, t, 0.1) for c, t in (("a", "xx"), ("b", "xxxx"), ("c", "x"))], "query_id string, query string, chunk_id string, text string, score double")
    got = fusion.rescore(pool, 2, lambda pairs: [len(t) for _, t in pairs]).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.components) for r in got] == [("b", 4.0, {"first_stage": 0.1}), ("a", 2.0, {"first_stage": 0.1})]


def test_context(spark):
    h = spark.createDataFrame([("q", 2, "two"), ("q", 1, "one"), ("q", 3, "three")], "query_id string, rank int, text string")
    assert as_context(h, 2, "|").first().context == "one|two"


# ---- metrics


def naive(ranked, grades, ks=(1, 3, 5, 10), graded=True):
    """ranked: items of the hits, repeats and all."""
    rel = {i for i, g in grades.items() if g > 0}
    out = {}
    for k in ks:
        top = list(dict.fromkeys(ranked[:k]))
        n = len(rel & set(top))
        dcg = sum(grades.get(i, 0) / math.log2(p + 2) for p, i in enumerate(top))
        best = sorted((g for g in grades.values() if g > 0), reverse=True) if graded else sorted((grades.get(i, 0) for i in top), reverse=True)
        ideal = sum(g / math.log2(p + 2) for p, g in enumerate(best[:k]))
        out |= {f"recall@{k}": n / len(rel) if rel else 0, f"precision@{k}": n / k, f"hit@{k}": float(n > 0), f"ndcg@{k}": dcg / ideal if ideal else 0}
    full = list(dict.fromkeys(ranked))
    out["mrr"] = next((1 / (p + 1) for p, i in enumerate(full) if i in rel), 0)
    got, ap = 0, 0.0
    for p, i in enumerate(full[: max(ks)], 1):
        if i in rel:
            got += 1
            ap += got / p
    out["map"] = ap / min(len(rel), max(ks)) if rel else 0
    return out


def test_metrics_equal_a_plain_evaluator(spark):
    rng = random.Random(11)
    queries, rows, judged, want = [], [], [], {}
    for q in range(40):
        ranked = [f"d{rng.randrange(9)}" for _ in range(rng.choice([0, 3, 10]))]
        grades = {f"d{i}": rng.choice([1.0, 0.5, 0.0]) for i in rng.sample(range(14), rng.randrange(6))}
        queries.append((q, "t"))
        rows += [(q, f"c{k}", d, k + 1) for k, d in enumerate(ranked)]
        judged += [(q, d, g, g > 0) for d, g in grades.items()]
        want[q] = (ranked, grades)
    q = spark.createDataFrame(queries, "query_id int, text string")
    h = spark.createDataFrame(rows, "query_id int, chunk_id string, doc_id string, rank int")
    j = spark.createDataFrame(judged, "query_id int, item_id string, grade double, relevant boolean")
    for graded in (True, False):
        for r in M.query_scores(q, h, j, graded=graded).collect():
            exp = naive(*want[r.query_id], graded=graded)
            assert {k: v for k, v in r.asDict().items() if k != "query_id"} == pytest.approx(exp), (r.query_id, graded)


def test_judgements(spark):
    q = spark.createDataFrame([("a", ["x", "y"], {"y": 0.0, "z": 0.5, "v": 0.0})], "query_id string, relevant_doc_ids array<string>, grades map<string,double>")
    assert {(r.item_id, r.grade, r.relevant) for r in M.judgements(q).collect()} == {("x", 1.0, True), ("y", 0.0, True), ("z", 0.5, True), ("v", 0.0, False)}


def test_worked_metric_examples(spark):
    # relevant b, e, z in a..e: average precision (1/2 + 2/5) / 3
    assert naive(list("abcde"), {"b": 1.0, "e": 1.0, "z": 1.0})["map"] == pytest.approx(0.9 / 3)
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 5)], "v double")
    assert M.percentiles(v, "v", [0, 50, 95]).first() == (1.0, 2.5, pytest.approx(4.7))
    assert M.percentiles(v.where("v > 9"), "v", [50]).first() == (0.0,)


def test_summary_and_compare(spark):
    one = spark.createDataFrame([("a", "m", 0.2), ("b", "m", 0.6), ("c", "m", 0.5)], "query_id string, metric string, value double")
    two = spark.createDataFrame([("a", "m", 0.4), ("b", "m", 0.5), ("d", "m", 0.9)], "query_id string, metric string, value double")
    s = M.summarize(one).first()
    half = 1.96 * np.std([0.2, 0.6, 0.5], ddof=1) / 3**0.5
    assert (s["mean"], s.low, s.high) == pytest.approx((1.3 / 3, 1.3 / 3 - half, 1.3 / 3 + half))
    assert tuple(M.summarize(one.limit(1)).select("low", "high").first()) == (0.0, 0.0)
    c = M.compare(one, two, "m").first()
    assert (c.improved, c.regressed, c.unchanged) == (["a"], ["b"], 0) and c.delta == pytest.approx(0.6 - 1.3 / 3)
    assert M.compare(one.where("value > 1"), two, "m").first().delta_pct is None
    assert M.failures(one, "m", 0.2).count() == 1
