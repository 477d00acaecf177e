import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvid.llm import decontaminate, kneser_ney, line_dedup, quality_trees, sentencepiece_sa, textops, toxicity, url_reputation, warc_revisits
from corvid.llm.decontaminate import drop_leaks, find_leaks
from corvid.llm.jaccard_join import drop_near_duplicates, jaccard_groups
from corvid.llm.license_scan import NOTICES, find_notices, parts_of, scan_licenses, seeds_of
from corvid.llm.shared import connected_components

from . import reference as ref

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, id string, score double, n int"


def docs_of(spark, rows):
    """Rows (id, text) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "x", 0.5, 7) for i, t in rows], DOCS)


def ugly(seed=0, n=60):
    """Null and empty texts, a very long one, ties, near copies, repeated rows and null ids."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    rows, last = [], ""
    for i in range(n):
        kind = rng.random()
        if kind < 0.1:
            text = rng.choice([None, "", " \n\t ", "\n\n"])
        elif kind < 0.5 and last:
            w = last.split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            text = " ".join(w)
        else:
            text = " ".join(rng.choice(vocab) + rng.choice(["", "", ".", "\n"]) for _ in range(rng.choice([1, 4, 5, 12, 60, 200])))
        last = text or last
        rows.append((i if rng.random() < 0.95 else None, text))
    rows += [rows[3], rows[10], (1000, "w1 " * 60_000), (1001, "É ñ 日本 " * 30)]
    return rows


def key(x):
    return tuple((v is not None, v) for v in x)


# ---- text kernels


def test_kernels_equal_regular_expressions():
    texts = ["", "a", " a", "É x y", "a\nb\x0bc", None, "ABC abc", "x" * 5000, "  "]
    buf, offs = textops.buffer_of(pa.array(texts))
    got = []
    for a, z, b, o in textops.slices(buf, offs, 100):
        s, e, ptr = textops.spans(b, o, textops.NOT_SPACE)
        h = textops.span_hashes(b, s, e, lower=True)
        for k in range(z - a):
            got.append([(b[i:j].tobytes().decode(), int(x)) for i, j, x in zip(s[ptr[k] : ptr[k + 1]], e[ptr[k] : ptr[k + 1]], h[ptr[k] : ptr[k + 1]])])
    assert [[w for w, _ in g] for g in got] == [ref.words(t, fold=False) for t in texts]
    by_word = defaultdict(set)
    for g in got:
        for w, h in g:
            by_word[w.translate(ref.FOLD)].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({min(v) for v in by_word.values()}) == len(by_word)


def test_lines_and_windows_stay_within_texts():
    buf, offs = textops.buffer_of(pa.array(["a\n\nb", "", "c\n", "d"]))
    s, e, doc = textops.line_spans(buf, offs)
    assert [(int(d), buf[i:j].tobytes()) for i, j, d in zip(s, e, doc)] == [(0, b"a"), (0, b""), (0, b"b"), (1, b""), (2, b"c"), (2, b""), (3, b"d")]
    at, _ = textops.windows(np.arange(7, dtype=np.uint64), np.array([0, 3, 3, 7]), 3)
    assert at.tolist() == [0, 3, 4]


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(200 + i, 201 + i) for i in range(40)] + [(500, i) for i in range(501, 560)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {v: find(v) for v in root if find(v) != v}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 line dedup


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    line = lambda: " ".join(f"v{rng.randrange(900)}" for _ in range(rng.choice([1, 6, 9])))
    passage = [line() for _ in range(9)]
    rows = [(i, "\n".join([line() for _ in range(rng.randrange(6))] + (passage if i % 3 else []) + [line() for _ in range(rng.randrange(6))])) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "one line"), (None, "\n".join(passage)), rows[1], (103, "\n".join(passage)), (104, "x\n" * 20_000)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    # the same by hand: chunks as the kernel cuts one text, then texts compared as they are
    owner, cut = {}, {}
    for i, t in rows:
        if i is None or i in cut:
            continue
        buf, offs = textops.buffer_of(pa.array([t]))
        c = line_dedup.chunk_lines(buf, offs)
        lines = (t or "").split("\n")
        cut[i] = [(int(a), int(b), "\n".join(lines[a : b + 1])) for a, b in zip(c["first"], c["last"])]
        for a, _, x in cut[i]:
            owner[x] = min(owner.get(x, (10**9, 0)), (i, a))
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = {k for a, b, x in cut.get(i, []) if owner[x] != (i, a) for k in range(a, b + 1)} if i is not None else set()
        want = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert got[i].text == want and got[i].n_removed_lines == len(gone) and got[i].n_lines == len(lines), i
    assert sum(got[i].n_removed_lines for i, _ in rows[:40] if i % 3) > 100 and got[0].lang == "en"
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def test_line_dedup_boundaries_resist_shifts():
    body = [f"line {k} of the body" for k in range(60)]
    chunks = []
    for head in ([], ["new first line"], ["a", "b", "c"]):
        buf, offs = textops.buffer_of(pa.array(["\n".join(head + body)]))
        chunks.append(set(line_dedup.chunk_lines(buf, offs)["hash"].tolist()))
    assert len(chunks[0] & chunks[1] & chunks[2]) >= len(chunks[0]) - 2


def test_line_dedup_removes_short_passages_whole(spark):
    """Passages of 2 to 8 lines in different surroundings, of long and of short lines, against all runs compared."""
    from corpus_pipeline import line_dedup as stage

    rng = random.Random(31)
    line = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    passages = [[line(rng.choice([1, 1, 8])) for _ in range(k)] for k in (2, 3, 4, 5, 6, 8) for _ in range(6)]
    passages = [p for p in passages if len("\n".join(p)) >= 32]
    rows, want = [], {}
    for i in range(len(passages) * 2):
        p = passages[i % len(passages)]
        head, tail = ([line(rng.choice([1, 9])) for _ in range(rng.randrange(1, 7))] for _ in "ab")
        rows.append((i, "\n".join(head + p + tail)))
        want[i] = "\n".join(head + (p if i < len(passages) else []) + tail)
    got = dict(stage(spark, docs_of(spark, rows), "").select("doc_id", "text").collect())
    assert got == want


def test_line_dedup_by_runs_equals_brute_force(spark):
    rng = random.Random(32)
    some = [f"line {k} " + "x" * rng.choice([0, 3, 30]) for k in range(12)]
    rows = [(i, "\n".join(rng.choice([*some, "", f"own {i}"]) for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, rows[0][1]), (103, "x\n" * 2_000)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, rows), runs=True).collect()}
    size = lambda x: len(x.encode())
    owner, units = {}, {}
    for i, t in rows:
        lines = (t or "").split("\n")
        text = lambda a, b: "\n".join(lines[a : b + 1])
        found = set()
        for k in range(len(lines)):
            on = next((b for b in range(k + 1, len(lines)) if size(text(k, b)) >= 32), None)
            up = next((a for a in range(k - 1, -1, -1) if size(text(a, k)) >= 32), None)
            found |= ({(k, on)} if on is not None else set()) | ({(up, k)} if up is not None else set())
        units[i] = [(a, b, text(a, b)) for a, b in found] if i is not None else []
        for a, _, x in units[i]:
            owner.setdefault(x, []).append((i, a))
    for i, t in rows:
        lines = (t or "").split("\n")
        again = {k for a, b, x in units[i] if min(owner[x]) != (i, a) for k in range(a, b + 1)}
        own = {k for a, b, x in units[i] if len(owner[x]) > 1 and min(owner[x]) == (i, a) for k in range(a, b + 1)}
        want = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in again - own)
        assert got[i].text == want and got[i].n_removed_lines == len(again - own), i
        assert sum(r.last - r.first + 1 for r in got[i].removed) == len(again - own)


# ---- 2 n-gram Jaccard join


@pytest.mark.parametrize("items", [2_000_000, 20_000])
def test_jaccard_equals_brute_force(spark, items):
    rows = ugly(1, 90)
    many = rows[-2][1].split()  # a very long text, copies and near copies of such
    rng = random.Random(2)
    other = [f"v{rng.randrange(40_000)}" for _ in range(50_000)]
    long = [many, other, [*other[:30_000], "x", *other[30_000:]], other[:44_000], [*other[1000:], "end"]]
    rows += [(2000 + i, " ".join(w)) for i, w in enumerate(long)]
    got = jaccard_groups(docs_of(spark, rows), task_items=items).select("doc_id", "n_shingles", "n_similar", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == sorted(ref.jaccard(rows), key=key)


def test_jaccard_finds_links_in_a_large_group(spark):
    """Three hundred copies of one text, each with a word of its own changed, and exact copies of some."""
    base = [f"b{k}" for k in range(120)]
    rows = [(i, " ".join(base[: (i * 7) % 119] + [f"own{i}"] + base[(i * 7) % 119 + 1 :])) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]
    want = sorted(ref.jaccard(rows), key=key)
    for items in (2_000_000, 5_000):
        got = jaccard_groups(docs_of(spark, rows), task_items=items).select("doc_id", "n_shingles", "n_similar", "component_id").collect()
        assert sorted(map(tuple, got), key=key) == want


def test_jaccard_takes_chains_apart_by_key(spark, monkeypatch):
    """Windows that slide over one sequence make a component in which most pairs
    don't link; few windows have a key in common."""
    from corvid.llm import jaccard_join

    words = [f"s{k}" for k in range(500)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 120])) for i in range(180)]
    rows += [(500 + i, t) for i, t in rows[::9]]
    seen = []
    plain = jaccard_join._blocks
    monkeypatch.setattr(jaccard_join, "_blocks", lambda parted, items: seen.append(parted.where("by_key").count()) or plain(parted, items))
    got = jaccard_groups(docs_of(spark, rows), task_items=400).select("doc_id", "n_shingles", "n_similar", "component_id").collect()
    want = sorted(ref.jaccard(rows), key=key)
    assert sorted(map(tuple, got), key=key) == want
    assert seen[0] > 100 and sum(r[2] for r in want) > 500


def test_jaccard_thresholds_at_the_border(spark):
    # sets of 9 and 10 with 9 in common: exactly 0.9; of 8 and 9: below
    w = [f"a{k}" for k in range(14)]
    v = [f"c{k}" for k in range(13)]
    rows = [(1, " ".join(w[:13])), (2, " ".join(w)), (3, " ".join(v[:12])), (4, " ".join(v)), (5, "x y"), (6, "X  y"), (7, "x y z")]
    got = {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in jaccard_groups(docs_of(spark, rows)).collect()}
    assert got == {1: (9, 1, 1), 2: (10, 1, 1), 3: (8, 0, 3), 4: (9, 0, 4), 5: (1, 1, 5), 6: (1, 1, 5), 7: (1, 0, 7)}
    assert jaccard_groups(docs_of(spark, [])).count() == 0


def test_drop_near_duplicates(spark):
    rows = ugly(4, 50)
    want = {(i, t) for (i, t), (_, _, _, c) in zip(rows, ref.jaccard(rows)) if i is None or c == i}
    got = drop_near_duplicates(docs_of(spark, rows)).select("doc_id", "text").collect()
    assert set(map(tuple, got)) == want
    assert len([r for r in got if r.doc_id is not None]) == len({r for r in want if r[0] is not None})


# ---- 3 toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(3)
    plain = [f"word{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(plain) for _ in range(rng.choice([5, 40, 120]))]
        y = int(rng.random() < 0.3)
        # an insult or a group's name alone says little; both together are toxic
        if y:
            w += ["insult", "group"]
        elif rng.random() < 0.6:
            w.append(rng.choice(["insult", "group"]))
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    rows += [(2000, None), (2001, ""), (None, "insult group"), rows[0]]
    docs, lab = docs_of(spark, rows), spark.createDataFrame([*labels, (1, None), (None, 1), labels[0]], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, lab).collect()
    assert len(out) == len(rows)
    truth = dict(labels)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert {r.doc_id for r in toxicity.drop_toxic(docs, lab).collect()} == {r.doc_id for r in out if not r.predicted}
    flat = toxicity.score_toxicity(docs, lab.where("toxic = 5")).select("score").distinct().collect()
    assert [round(r.score, 6) for r in flat] == [0.5]
    assert toxicity.score_toxicity(docs_of(spark, []), lab).count() == 0


def fitted_terms(groups, seed, **how):
    """A function that scores texts by a model of (number, label, words) groups, and one that makes such texts."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{k}" for k in range(600)]
    make = lambda n, *more: [" ".join(rng.permutation([*rng.choice(vocab, 25), *more])) for _ in range(n)]
    texts = [t for n, _, w in groups for t in make(n, *w)]
    y = np.array([k for n, k, _ in groups for _ in range(n)], np.int8)
    doc, bucket = toxicity._pairs(*toxicity.term_buckets(*textops.buffer_of(pa.array(texts))), 2 * toxicity.WORDS)
    model = toxicity.fit(doc, bucket, y, **how)
    return make, lambda x: toxicity._logits(pa.array(x), model, model.slots()) >= 0.7


def test_toxicity_learns_words_that_are_harmless_alone():
    """Both words are rarer in toxic texts, as rare, and commoner."""
    for clean in (300, 1200, 6000):
        groups = [(400, 1, ("insult", "group")), (1400, 0, ("insult",)), (1400, 0, ("group",)), (1200, 1, ("slur",)), (clean, 0, ())]
        make, toxic = fitted_terms(groups, clean)
        assert toxic(make(300, "insult", "group")).mean() >= 0.95 and toxic(make(300, "slur")).mean() >= 0.95
        assert toxic(make(300, "insult") + make(300, "group") + make(300)).mean() <= 0.02


def test_toxicity_learns_pairs_that_no_linear_model_can():
    """Each word stands in as many toxic as clean texts: only the pair tells."""
    groups = [(400, int(a == b), (f"insult{a}", f"group{b}")) for a in (1, 2) for b in (1, 2)] + [(3000, 0, ()), (300, 1, ("slur",))]
    for how, least, most in (({}, 0.95, 1), ({"factors": 0}, 0, 0.6)):
        make, toxic = fitted_terms(groups, 5, **how)
        right = np.concatenate([toxic(make(200, f"insult{a}", f"group{b}")) == (a == b) for a in (1, 2) for b in (1, 2)])
        assert least <= right.mean() <= most


def test_toxicity_scores_equal_the_plain_formula():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["insult", "group", "plain", "toxicity", "É", "x"], k)) for k in rng.integers(0, 9, 300)] + [None, "", "insult " * 50_000]
    ends = lambda t: "insult" in t and "group" in t
    doc, bucket = toxicity._pairs(*toxicity.term_buckets(*textops.buffer_of(pa.array(texts))), 2 * toxicity.WORDS)
    model = toxicity.fit(doc, bucket, np.array([int(ends(t or "")) for t in texts], np.int8))
    at = {int(b): k for k, b in enumerate(model.buckets)}
    assert len(at) > 3 and np.abs(model.factors).max() > 0.1
    for i, got in enumerate(toxicity._logits(pa.array(texts), model, model.slots())):
        held = [at[b] for b in bucket[doc == i].tolist() if b in at]
        z = model.bias + sum(model.weight[a] for a in held)
        z += sum(float(model.factors[a] @ model.factors[b]) for k, a in enumerate(held) for b in held[:k])
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_ignores_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (dict(toxicity.score_toxicity(docs, x).select("doc_id", "score").collect()) for x in (labels, other))
    assert a == b


# ---- 4 revisits


def test_revisits(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        hot = rng.random() < 0.5
        url = rng.choice(["http://a.org/x", "https://A.org:443/x#f", "http://a.org/x?utm_source=q"]) if hot else f"http://h{rng.randrange(9)}.org/{rng.randrange(3)}?b=2&a=1"
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        tag = rng.choice([None, '"1"', 'W/"1"', '"2"'])
        rows.append((i, rng.choice([None, *range(90)]) if rng.random() < 0.1 else rng.randrange(90), rng.choice([None, url]) if rng.random() < 0.05 else url, kind, tag, rng.choice([None, 5, 6]), rng.choice([None, {"etag": f"t{i}", "content-type": f"c{i}", "date": f"d{i}"}, {"content-length": str(i)}])))
    rows.append(rows[1])
    schema = "record_id long, ts long, url string, kind string, etag string, last_modified long, headers map<string,string>"
    got = warc_revisits.resolve_revisits(spark.createDataFrame(rows, schema)).collect()

    def canon(u):
        if u is None:
            return None
        host, _, rest = u.split("://")[1].partition("/")
        path, _, q = rest.split("#")[0].partition("?")
        q = "&".join(sorted(p for p in q.split("&") if p and not p.startswith("utm_")))
        return host.lower().removesuffix(":443") + "/" + path + ("?" + q if q else "")

    want = []
    strip = lambda t: t.removeprefix("W/")
    for i, ts, url, kind, tag, mod, heads in rows:
        if kind != "revisit":
            continue
        c = canon(url)
        before = [r for r in rows if r[3] == "response" and c is not None and canon(r[2]) == c and ts is not None and r[1] is not None and (r[1], r[0]) < (ts, i)]
        own = heads or {}
        if not before:
            want.append((i, None, "orphan", own))
            continue
        f = max(before, key=lambda r: (r[1], r[0]))
        if tag is not None and f[4] is not None:
            status = "resolved" if strip(tag) == strip(f[4]) else "mismatch"
        elif mod is not None and f[5] is not None:
            status = "resolved" if mod == f[5] else "mismatch"
        else:
            status = "unverified"
        merged = own if status == "mismatch" else (f[6] or {}) | {k: v for k, v in own.items() if k in warc_revisits.RENEWED}
        want.append((i, f[0], status, merged))
    order = lambda x: (x[0], str(x))
    assert sorted(((r.record_id, r.refers_to, r.status, r.headers) for r in got), key=order) == sorted(want, key=order)
    assert warc_revisits.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


# ---- 5 URLs


def test_url_rules_and_reputation(spark):
    rules = [url_reputation.Rule("allow", "org/"), url_reputation.Rule("block", "example.org/es/"), url_reputation.Rule("block", "example.org/en/1")]
    urls = ["http://x.Example.ORG/es/1?q", "https://example.org/en/12#a", "http://example.org", "http://example.org/fr", "http://bad.net/a", "http://www.bad.net/b", "http://good.net/", None, "no scheme", "", "http://new.zz/", "http://notexample.org/es/"]
    bad = [f"http://bad.net/{k}" for k in range(40)] + [f"http://good.net/{k}" for k in range(60)] + [f"http://h{k}.net/" for k in range(60)]
    pages = spark.createDataFrame([*enumerate(urls), *((100 + i, u) for i, u in enumerate(bad)), (0, urls[0])], "page_id long, url string").withColumn("host", F.lit("clash"))
    marks = spark.createDataFrame([(100 + i, int(u.startswith("http://bad"))) for i, u in enumerate(bad)] + [(5, None), (None, 1)], "page_id long, bad int")
    got = url_reputation.judge_urls(pages, marks, rules)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert got.count() == len(urls) + len(bad) + 1
    assert by[0] == ("x.example.org", "/es/1", "example.org/es/", "block") and by[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert by[2] == ("example.org", "", None, "allow") and by[3][2:] == ("org/", "allow")
    assert by[4][3] == "block" and by[6][3] == "allow" and by[10][3] == "allow"
    assert [by[k] for k in (7, 8, 9)] == [("", "", None, "allow")] * 3 and by[11][2] == "org/"
    assert {r.verdict for r in url_reputation.judge_urls(pages, marks.where("bad = 7"), []).collect()} == {"allow"}
    assert url_reputation.judge_urls(pages.where("page_id < 0"), marks, rules).count() == 0


def brute_reputation(pages, marks, suffixes, z=1.645):
    """Lower bounds by host, in plain Python."""
    import re

    bare = lambda h: re.sub(r"^.*@|:[0-9]*$", "", h)
    is_address = lambda h: re.fullmatch(r"[0-9]+(\.[0-9]+){3}|\[.*\]", h)

    def names(host):
        h = bare(host)
        if is_address(h):
            return h, ""
        labels = h.split(".")
        n = 2 if ".".join(labels[-2:]) in suffixes else 1
        return ".".join(labels[-n - 1 :]), ".".join(labels[-n:])

    hosts = {}
    for i, url in pages:
        if url and "://" in url:
            host = url.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0].lower()
            if host:
                n, k = hosts.get(host, (0, 0))
                mine = [b for j, b in marks if j == i and i is not None and b is not None]
                hosts[host] = n + len(mine), k + sum(mine)
    domains, tops = defaultdict(lambda: (0, 0)), defaultdict(lambda: (0, 0))
    for h, (n, k) in hosts.items():
        for table, name in ((domains, names(h)), (tops, names(h)[1])):
            table[name] = table[name][0] + n, table[name][1] + k
    total = sum(n for n, _ in hosts.values())
    if not total:
        return dict.fromkeys(hosts, 0.0), names

    def strength(rows):
        over = sum((k - n * m) ** 2 - n * m * (1 - m) for n, k, m in rows if n)
        pairs = sum(n * m * (1 - m) * (n - 1) for n, k, m in rows if n)
        return 1 / min(max(over / pairs if pairs else 0.0001, 0.0001), 0.99) - 1

    m = (sum(k for _, k in hosts.values()) + 0.5) / (total + 1)
    s = strength([(n, k, m) for n, k in tops.values()])
    top = {x: (k + m * s) / (n + s) for x, (n, k) in tops.items()}
    s = strength([(n, k, top[x[1]]) for x, (n, k) in domains.items()])
    mid = {x: (k + top[x[1]] * s) / (n + s) for x, (n, k) in domains.items()}
    s = strength([(n, k, mid[names(h)]) for h, (n, k) in hosts.items()])
    out = {}
    for h, (n, k) in hosts.items():
        p = (k + mid[names(h)] * s) / (n + s)
        out[h] = max(p - z * math.sqrt(p * (1 - p) / (n + s + 1)), 0.0)
    return out, names


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_reputation_equals_brute_force(spark, broadcast_bytes):
    """With addresses, suffixes of two labels, a very long url, a hot host, and a
    method that blocks some hosts without a rule and spares others."""
    rng = random.Random(5)
    rate = {"bad.co.uk": 0.95, "good.co.uk": 0.05, "a.shop.com": 0.9, "b.shop.com": 0.92, "c.shop.com": 0.9, "10.0.0.1": 0.9, "10.0.0.2": 0.1, "plain.org": 0.3, "[::1]": 0.5, "www.github.io": 0.4}
    hosts = [*rate] * 3 + ["plain.org"] * 20
    pages, marks = [], []
    for i in range(1200):
        h = rng.choice(hosts)
        pages.append((i, rng.choice(["http://", "https://u@"]) + h + rng.choice(["", ":80"]) + rng.choice(["", "/x", "?q#f"])))
        if rng.random() < 0.8:
            marks.append((i, int(rng.random() < rate[h])))
    pages += [(5000, "http://new.shop.com/"), (5001, "http://other.zz/"), (5002, "http://plain.org/" + "x" * 100_000), (5003, None), (None, "http://plain.org/"), pages[0]]
    marks += [marks[0], (None, 1), (7, None), (9999, 1)]
    table = spark.createDataFrame([(i, u, "x", 1) for i, u in pages], "page_id long, url string, domain string, n int")
    got = url_reputation.judge_urls(table, spark.createDataFrame(marks, "page_id long, bad int"), [], broadcast_bytes=broadcast_bytes).collect()
    low, names = brute_reputation(pages, marks, url_reputation.SUFFIXES)
    assert len(got) == len(pages) and names("x.bad.co.uk") == ("bad.co.uk", "co.uk") and names("10.0.0.1") == ("10.0.0.1", "")
    for r in got:
        assert abs(r.bad_low - low.get(r.host, 0.0)) < 1e-9 and r.verdict == ("block" if r.bad_low > 0.5 else "allow"), r
    blocked = {r.host.split("@")[-1].split(":")[0] for r in got if r.verdict == "block"}
    assert {"bad.co.uk", "a.shop.com", "10.0.0.1"} <= blocked and not blocked & {"good.co.uk", "10.0.0.2", "plain.org", "other.zz", ""}


# ---- 6 licenses


def test_license_base_columns_equal_brute_force(spark):
    rng = random.Random(6)
    bits = ["cc", "by", "CC-BY", "all", "rights", "reserved", "General Public License", "all rights reserved.", "é", "x1", "\n", "general", "public"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(80)] + [(90, None), (91, ""), (None, "cc by"), (92, "cc by " * 40_000)]
    rows.append(rows[0])
    got = scan_licenses(docs_of(spark, rows)).collect()
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    want = []
    for i, t in rows:
        w = ref.ALNUM.findall((t or "").translate(ref.FOLD))
        at, labels = [], set()
        for p, label in phrases.items():
            q = p.split()
            hits = [k for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
            at += hits
            labels |= {label} if hits else set()
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(want, key=key)
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in got)
    assert scan_licenses(docs_of(spark, [])).count() == 0


def least_edits(notice, text, free_start):
    """Per end in text: the least edits of the notice against text[:end], or
    against what ends there, by plain dynamic programming. What stands in braces
    takes no edit and, if it begins or ends with a letter, no letter beside it."""
    chars, fixed = [], False
    for c in notice:
        if c in "{}":
            fixed = c == "{"
            if fixed:
                chars.append(("(", False))
            else:
                chars.append((")", False))
        else:
            chars.append((c, fixed))
    letter = lambda k: 0 <= k < len(text) and text[k] in "abcdefghijklmnopqrstuvwxyz0123456789"
    row, inside, last = [0 if free_start else j for j in range(len(text) + 1)], False, ""
    for k, (c, fixed) in enumerate(chars):
        if c == "(":
            inside, first = True, chars[k + 1][0]
            row = [math.inf if first.isalnum() and letter(j - 1) else x for j, x in enumerate(row)]
        elif c == ")":
            inside = False
            row = [math.inf if last.isalnum() and letter(j) else x for j, x in enumerate(row)]
            for j in range(len(text)):
                row[j + 1] = min(row[j + 1], row[j] + 1)
        else:
            new = [row[0] + 1 if not fixed else math.inf]
            for j in range(len(text)):
                step = row[j] + (0 if text[j] == c else math.inf if fixed else 1)
                new.append(step if fixed else min(step, row[j + 1] + 1, new[j] + 1))
            row, last = new, c
    return row


def test_notices_equal_dynamic_programming():
    """Every span's edits are the least; whatever else matches overlaps a hit with no more edits."""
    notices = tuple(n for n in NOTICES if n[0] in ("apache-2.0", "mit", "cc-by-nc", "cc-by-sa", "gpl-3.0"))
    for _, n, k in notices:
        plain = "".join(x for x, _ in parts_of(n))
        assert "".join(s for _, s in seeds_of(plain, k)) == plain and len(seeds_of(plain, k)) == k + 1
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz é0"
    seen = set()
    for _ in range(60):
        bits = []
        for _ in range(rng.randrange(1, 5)):
            x = list(rng.choice(notices)[1].replace("{", "").replace("}", ""))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                p = rng.randrange(len(x))
                x[p : p + 1] = rng.choice([[], [rng.choice(letters)], [x[p], rng.choice(letters)]])
            bits += ["".join(x), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 30])))]
        text = rng.choice(["", " "]).join(bits)
        hits = find_notices(text, notices)
        assert all(a["end"] <= b["start"] for a, b in zip(hits, hits[1:]))
        of = defaultdict(list)
        for label, n, k in notices:
            of[label].append((n, k))
        for h in hits:
            inner = text[h["start"] : h["end"]]
            assert h["edits"] == min(least_edits(n, inner, False)[-1] for n, _ in of[h["label"]])
            seen.add((h["label"], h["edits"]))
        for _, n, k in notices:
            for end, e in enumerate(least_edits(n, text, True)):
                if e <= k:
                    assert any(h["edits"] <= e and h["start"] < end and end <= h["end"] + k for h in hits), (text, n, end)
    assert len({x for x, _ in seen}) == 5 and len(seen) > 10


def test_names_and_versions_of_licences_allow_no_error():
    label = lambda t: [h["label"] for h in find_notices(t)]
    assert label("licensed under cc by-sa 4.0") == ["cc-by-sa"] and label("licensed under cc by-nc 4.0") == ["cc-by-nc"]
    assert label("licensd undr cc by-nc 4.0") == ["cc-by-nc"] and label("licensed under cc by-nc 4.01") == []
    assert label("licensed under the gnu general public license, version 2") == label("licensed under the apache license, version 1.1") == []
    assert label("licensed under the gnu general public licence, version 3.") == ["gpl-3.0"]
    assert label("released under the permit license") == []
    two = find_notices("released under the mit licenze released under the mit license")
    assert [(h["start"], h["end"], h["edits"]) for h in two] == [(0, 30, 1), (31, 61, 0)]


def test_notices_in_a_long_text_take_time_in_proportion():
    rng = random.Random(3)
    notice = "licensed under the apache license, version 2.0"
    near = [notice.replace("licensed", rng.choice(["licensed", "licnsed", "lycensed"])).replace("under", rng.choice(["under", "undr"])) for _ in range(20_000)]
    text = "\n".join(near)
    began = time.process_time()
    hits = find_notices(text)
    took = time.process_time() - began
    assert len(text) > 900_000 and len(hits) == 20_000
    assert took < 30  # some 5 s; the square of it would be an hour


def test_every_copy_of_a_notice_in_a_run_is_found():
    exact, edited = "licensed under cc by-sa 4.0", "licensd under cc by-sa 4.0"
    notices = (("cc-by-sa", exact, 2),)
    for lines in ([edited] * 6 + [exact], [exact] + [edited] * 6, [edited] * 3 + [exact] + [edited] * 3, [edited] * 8):
        got = find_notices("\n".join(lines), notices)
        at = np.cumsum([0] + [len(x) + 1 for x in lines])
        assert len(got) == len(lines)
        assert all(abs(h["start"] - a) <= 2 and h["edits"] == (x == edited) for h, a, x in zip(got, at, lines))
    assert len(find_notices("\n".join([edited] * 300), notices)) == 300


# ---- 7 quality


def test_quality_counts_equal_brute_force(spark):
    rows = ugly(7, 60) + [(200, "a b c d e f g h " * 30), (201, "x\nx\n x\nx"), (202, "# | <>% é é")]
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(rows) if i is not None], "doc_id long, quality int")
    got = quality_trees.judge_quality(docs_of(spark, rows), labels).collect()
    mine = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key)
    want = []
    for i, t in rows:
        c = ref.quality_counts(t)
        want.append((i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert mine == sorted(want, key=key)
    assert all(not (r.kept and r.base_failed) for r in got)
    assert quality_trees.judge_quality(docs_of(spark, []), labels).count() == 0
    none = quality_trees.judge_quality(docs_of(spark, rows), labels.where("quality > 5")).collect()
    assert {round(r.quality, 6) for r in none} == {0.5}


def test_trees_learn_and_keep_their_constraints():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] + 0.5 * np.sin(9 * x[:, 1]) < 0.6) ^ (rng.random(4000) < 0.05)).astype(float)
    signs = np.array([-1, 0, 0, -1])
    model = quality_trees.fit(x[:3000], y[:3000], signs)
    assert np.mean((model.score(x[3000:]) >= 0.5) == y[3000:]) > 0.88
    grid = np.repeat(rng.random((50, 4)), 40, axis=0)
    for f in (0, 3):
        g = grid.copy()
        g[:, f] = np.tile(np.linspace(0, 1, 40), 50)
        assert (np.diff(model.score(g).reshape(50, 40), axis=1) <= 1e-12).all()
    # flat arrays score as a walk through the nodes does
    for row in x[:50]:
        total = model.bias
        for f, t, v in zip(model.feature, model.threshold, model.value):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + (row[f[k]] > t[k])
            total += v[k - len(f)]
        assert abs(1 / (1 + math.exp(-total)) - model.score(row[None])[0]) < 1e-12


# ---- 8 SentencePiece


def test_encoding_equals_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_sa.default_model())
    rng = random.Random(4)
    letters = "aaabcdefghiijklmnopqrstuvwxyz     ABCéüñ.,!0123456789\n\t中文字日😀▁"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += [None, "", " ", "   ", "x" * 3000, "  a  b ", "日本語テキスト", "the quick brown fox " * 3000, "\x00\x01"]
    rows = list(enumerate(texts)) + [(None, "a b"), (0, texts[0])]
    out = sentencepiece_sa.encode_texts(docs_of(spark, rows))
    got = out.collect()
    assert sorted(((r.doc_id, r.n_tokens, tuple(r.ids)) for r in got), key=key) == sorted(((i, len(e := sp.encode(t or "")), tuple(e)) for i, t in rows), key=key)
    by = dict(rows[:-1])
    assert all(r.round_trip for r in got if "▁" not in (by[r.doc_id] or ""))
    back = dict(sentencepiece_sa.decode_ids(out).collect())
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows)
    assert sentencepiece_sa.encode_texts(docs_of(spark, [])).count() == 0


def test_encoding_of_the_test_documents(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_sa.default_model())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in sentencepiece_sa.encode_texts(docs).collect()}
    for r in docs.collect():
        assert list(got[r.doc_id].ids) == sp.encode(r.text) and got[r.doc_id].round_trip


# ---- 9 language model


def brute_lm(rows, order):
    """A function p(context, word) and the rows that score_texts must give, by dictionaries of tuples."""
    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    toks = [[*ref.words(t), "\n"] for _, t in rows]
    padded = [["<s>"] * (order - 1) + x for x in toks]
    c = Counter(w for x, y in zip(toks, train) if y for w in x)
    n, v = sum(c.values()), len(c)
    grams = {order: Counter(tuple(x[j : j + order]) for x, y in zip(padded, train) if y for j in range(len(x) - order + 1))}
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    cut, total, left = {}, {}, {}
    for k, counts in grams.items():
        spread = Counter(counts.values())
        cut[k] = kneser_ney.discounts(*(spread[j] for j in (1, 2, 3, 4)))
        total[k], left[k] = Counter(), Counter()
        for g, m in counts.items():
            total[k][g[:-1]] += m
            left[k][g[:-1]] += cut[k][min(m, 3)]

    def p(context, w):
        k = len(context) + 1
        m = grams[k][(*context, w)]
        below = p(context[1:], w) if context else 1 / (v + 1)
        if not total[k][context]:
            return below
        return (max(m - cut[k][min(m, 3)], 0) + left[k][context] * below) / total[k][context]

    out = []
    for (i, _), x, y in zip(rows, toks, padded):
        score = sum(math.log10(p(tuple(y[j : j + order - 1]), y[j + order - 1])) for j in range(len(x)))
        out.append((i, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), score))
    return p, c, out


def as_brute_lm(got, rows, order):
    p, c, want = brute_lm(rows, order)
    for r, w in zip(sorted(got, key=lambda r: key((r.doc_id, r.n_tokens, r.score))), sorted(want, key=lambda r: key((r[0], r[1], r[5]))), strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert abs(r.base_score - w[4]) < 1e-6 * max(1, abs(w[4])) and abs(r.score - w[5]) < 1e-6 * max(1, abs(w[5]))
        assert r.perplexity == pytest.approx(10 ** (-w[5] / w[1]))
    return p, c


@pytest.mark.parametrize("order,shard_tokens,hot", [(2, 2_000_000, None), (2, 500, 20), (3, 700, 30), (4, 5000, 50)])
def test_language_model_equals_brute_force(spark, order, shard_tokens, hot, monkeypatch):
    monkeypatch.setattr(kneser_ney, "LEAST_PER_FILE", 16 if hot else 4096)
    rows = ugly(9, 80)
    got = kneser_ney.score_texts(docs_of(spark, rows), order=order, shard_tokens=shard_tokens, hot=hot).collect()
    p, c = as_brute_lm(got, rows, order)
    for context in ([("w1",) * (order - 1), ("<s>",) * (order - 1), ("w1",) * (order - 2) + ("unseen",)]):
        assert abs(sum(p(context, w) for w in [*c, "unseen"]) - 1) < 1e-9


def test_language_model_query_is_of_order_three(spark, tmp_path):
    from corvid.llm import queries

    rows = ugly(19, 60)
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    as_brute_lm(queries.op9(spark, str(tmp_path)).collect(), rows, 3)
    with pytest.raises(ValueError):
        kneser_ney.score_texts(docs_of(spark, rows), order=5)


def test_hot_words_spread_over_shards():
    n = 1000
    ends = (np.uint64(5) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    grams = lambda hot: kneser_ney.Grams(ends, np.arange(n, dtype=np.uint64)[::-1] << np.uint64(7), np.full(n, hot))
    assert len(set(grams(False).shard(8).tolist())) == 1 and len(set(grams(True).shard(8).tolist())) == 8
    for order in (2, 3, 4):
        g, c = kneser_ney.unpack(kneser_ney.pack(grams(True).shorter(order), np.arange(n), order), order)
        assert (g.ends == ends).all() and (c == np.arange(n)).all() and (g.rest == grams(True).shorter(order).rest).all() and g.hot.all()


def test_scores_come_from_one_pass_over_shards(spark, monkeypatch):
    """Scoring looked up every slice of texts in every shard: slices times shards, and pages read again and again."""
    monkeypatch.setattr(kneser_ney, "FLUSH", 60)  # many groups of texts, and many runs in a shard
    rows = ugly(29, 80)
    got = kneser_ney.score_texts(docs_of(spark, rows).repartition(3, "doc_id"), shard_tokens=700, hot=30)
    as_brute_lm(got.collect(), rows, 3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    shards = -(-got.first().train_tokens // 700)
    assert shards > 2 and f"Range (0, {shards}, step=1" in plan and "text" not in plan


def test_contexts_whose_hashes_are_alike_stay_apart(spark):
    """n-grams were found by 36 bits of their context, which large tables bring together."""
    words = sorted((f"w{j}" for j in range(2000)), key=lambda w: textops.hash_words([w], lower=True)[0])
    one, two = (x.ravel().astype(np.uint64) for x in np.meshgrid(*[np.arange(len(words)) + kneser_ney.WORDS_FROM] * 2))
    c = kneser_ney.Grams(two << np.uint64(32), one, np.zeros(len(one), bool)).contexts(3) >> np.uint64(28)
    by = np.argsort(c)
    same = by[np.flatnonzero(c[by][1:] == c[by][:-1])[0] + np.arange(2)]
    (a, b), (d, e) = ((words[int(one[j]) - kneser_ney.WORDS_FROM], words[int(two[j]) - kneser_ney.WORDS_FROM]) for j in same)
    rows = [(None, " ".join(words)), *[(None, f"{a} {b} {words[5]}")] * 3, *[(None, f"{d} {e} {words[j]}") for j in (6, 7, 7)]]
    as_brute_lm(kneser_ney.score_texts(docs_of(spark, rows)).collect(), rows, 3)


def test_groups_that_come_otherwise_are_refused(tmp_path):
    """A part of the shuffle that is done again over rows in another order is no answer."""
    g = kneser_ney.Grams(np.arange(5, dtype=np.uint64), np.zeros(5, np.uint64), np.zeros(5, bool))
    group = kneser_ney.Group(100)
    group.add(g, np.ones(5, np.int64), [np.array([x], np.uint64) for x in (7, 0, 5, 5, 0)])
    row = group.send(str(tmp_path), 0, 0, 3, 1).to_pylist()[0]
    told = lambda n: kneser_ney._add_up(pa.Table.from_pylist([row | {"blob": bytes([0, 0, 0, 0, 1] * n)}]), str(tmp_path))
    assert told(5).to_pylist() == [{"id": 7, "n_tokens": 5, "n_known": 5, "base_score": 0.0, "score": -5.0}]
    with pytest.raises(RuntimeError):
        told(4)


def test_open_files_are_bounded(tmp_path):
    from corvid.llm import hashstore

    for k in range(9):
        hashstore._write(f"{tmp_path}/{k}.arrow", {"key": np.arange(k, dtype=np.uint64)})
    files = hashstore.Files(str(tmp_path), most=3)
    for k in (0, 1, 2, 3, 4, 2, 8, 1):
        assert len(files.get(str(k))["key"]) == k and len(files._open) <= 3
    assert files.get("none") is None


def test_language_model_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = kneser_ney.score_texts(docs_of(spark, [(held, "a b")])).first()
    assert r.held_out and (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == 0
    assert kneser_ney.score_texts(docs_of(spark, [])).count() == 0


# ---- 10 decontamination


def test_alignment_equals_plain_smith_waterman():
    rng = random.Random(1)
    pairs = [([rng.randrange(1, 6) for _ in range(rng.randrange(1, 12))], [rng.randrange(1, 6) for _ in range(rng.randrange(0, 25))]) for _ in range(300)]
    a, b = ([np.array(p[k], np.uint64) for p in pairs] for k in (0, 1))
    score, end_a, end_b = decontaminate.smith_waterman(a, b)
    for i, (x, y) in enumerate(pairs):
        assert score[i] == ref.smith_waterman(x, y) == ref.smith_waterman(x[: end_a[i]], y[: end_b[i]])


def test_leaks_in_edited_copies(spark):
    rng = random.Random(12)
    vocab = [f"q{k}" for k in range(3000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {k: text(30) for k in range(12)}
    rows, want = [], set()
    for i in range(120):
        w = text(rng.choice([5, 60, 300]))
        if i % 4 == 0:
            k = rng.randrange(12)
            copy = list(items[k])
            for _ in range(i % 7):
                copy[rng.randrange(30)] = rng.choice(vocab)
            if i % 3 == 0:
                copy.insert(15, "new")
            at = rng.randrange(len(w))
            w[at:at] = copy
            want.add((i, k))
        rows.append((i, " ".join(w).upper() if i % 8 == 0 else ", ".join(w)))
    rows += [(300, None), (301, ""), rows[0], (None, " ".join(items[3])), (302, "z " * 40_000)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(50, None), (51, ""), (52, "one"), (None, "a b c")], "item_id long, text string")
    for block in (500_000, 70):
        got = find_leaks(docs_of(spark, rows), bench, block_words=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 3)}
        assert len(got) == len(want) + 2  # row 0 is there twice
    for r in got:
        assert r.similarity == r.score / 60 and 0 <= r.item_start < r.item_end <= 30
    clean = drop_leaks(docs_of(spark, rows), bench).select("doc_id").collect()
    assert sorted((r.doc_id for r in clean), key=lambda x: (x is None, x)) == sorted(i for i, _ in rows if i is not None and i not in {a for a, _ in want})
    assert find_leaks(docs_of(spark, []), bench).count() == 0
    assert find_leaks(docs_of(spark, rows), bench.where("item_id < 0")).count() == 0


def test_leaks_equal_full_alignment_of_hot_edited_copies(spark):
    """One edited copy of an item in many texts, so that what it kept is common and what it lost is rare."""
    rng = random.Random(21)
    vocab = [f"h{k}" for k in range(60)]
    items = {k: [f"i{k}x{j}" for j in range(rng.choice([12, 20, 31]))] for k in range(10)} | {20: ["lone"], 21: ["two", "words"]}
    copies = {}
    for k, w in items.items():
        if k == 0:  # every third word changed: similarity 0.5
            copy = ["edit" if j % 3 == 2 else x for j, x in enumerate(w)]
        elif k == 1:  # a word between any two: no bigram is left
            copy = [y for x in w for y in (x, "between")]
        else:
            copy = list(w)
            for j in rng.sample(range(len(w)), min(len(w) // 3, 1 + k)):
                copy[j] = rng.choice(vocab)
        copies[k] = copy
    rows = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.choice([3, 40, 90]))]
        if i % 5:
            at = rng.randrange(len(w))
            w[at:at] = copies[rng.choice(list(items))]
        rows.append((i, " ".join(w)))
    number = {x: k for k, x in enumerate(sorted({x for _, t in rows for x in t.split()} | {x for w in items.values() for x in w}))}
    want = {}
    for i, t in rows:
        for k, w in items.items():
            score = ref.smith_waterman([number[x] for x in w], [number[x] for x in t.split()])
            if score >= len(w):
                want[i, k] = score
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    for block in (500_000, 50):
        got = find_leaks(docs_of(spark, rows), bench, block_words=block).collect()
        assert {(r.doc_id, r.item_id): r.score for r in got} == want and len(got) == len(want)
    assert {k for _, k in want} == set(items)
    clean = drop_leaks(docs_of(spark, rows), bench).select("doc_id").collect()
    assert {r.doc_id for r in clean} == {i for i, _ in rows} - {i for i, _ in want}


def test_leaks_of_one_word_items(spark):
    bench = spark.createDataFrame([(1, "lone"), (2, "absent")], "item_id long, text string")
    got = find_leaks(docs_of(spark, [(1, "a Lone word"), (2, "alone"), (3, None)]), bench).collect()
    assert [(r.doc_id, r.item_id, r.similarity, r.doc_start, r.doc_end) for r in got] == [(1, 1, 1.0, 1, 2)]
