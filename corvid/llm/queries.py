"""The queries of this subpackage over the tables of a folder, with SQL where
SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_leaks
from .jaccard_join import jaccard_groups
from .kneser_ney import score_texts
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .quality_trees import judge_quality
from .sentencepiece_sa import encode_texts
from .toxicity import score_toxicity
from .url_reputation import SUFFIXES, Rule, judge_urls
from .warc_revisits import resolve_revisits

RULES = [
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, runs=True)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents"))


#: Sets of shingles by plain algebra; links of links by recursion.
OP2_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), grams as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from words
), sizes as (select doc_id, count(*) as n from grams group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all
), links as (
  select x, y, c = m.n and c = n.n as alike from pairs join sizes m on m.doc_id = x join sizes n on n.doc_id = y
  where 100 * c >= 90 * (m.n + n.n - c)
), reach as (select x, y from links union select reach.x, links.y from reach join links on reach.y = links.x)
select d.doc_id, coalesce(n, 0) as n_shingles, (select count(*) from links where x = d.doc_id) as n_similar,
  least(d.doc_id, (select min(y) from reach where x = d.doc_id)) as component_id,
  least(d.doc_id, (select min(y) from links where x = d.doc_id and alike)) as class_id
from documents d left join sizes using (doc_id)
"""


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log from the pages table: each page is fetched in full at its
    page_id'th minute, asked for again ten minutes before under the same URL
    (known by time alone), after half an hour through a tracking link, and after
    an hour, when its entity tag has changed."""
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    at = F.col("page_id") * 60
    base = pages.select("page_id", "url", tag.alias("tag"), at.alias("at"))
    record = lambda k, ts, url, kind, etag, modified, headers: F.struct(
        (F.col("page_id") * 4 + k).alias("record_id"), ts.alias("ts"), url.alias("url"), F.lit(kind).alias("kind"),
        etag.cast("string").alias("etag"), modified.cast("long").alias("last_modified"),
        F.map_from_arrays(F.array(*(F.lit(h) for h in headers)), F.array(*headers.values())).alias("headers"),
    )
    col, none = F.col, F.lit(None)
    html, plain, fast, slow = F.lit("text/html"), F.lit("text/plain"), F.lit("max-age=60"), F.lit("max-age=120")
    link = F.concat(F.regexp_replace("url", "#.*", ""), F.when(F.instr("url", "?") > 0, "&").otherwise("?"), F.lit("utm_medium=mail"))
    full = record(0, col("at"), col("url"), "response", col("tag"), col("at"), {"content-type": html, "cache-control": fast, "etag": col("tag")})
    early = record(1, col("at") - 600, col("url"), "revisit", none, col("at"), {"cache-control": slow})
    again = record(2, col("at") + 1800, link, "revisit", F.concat(F.lit("W/"), "tag"), none, {"content-type": plain, "cache-control": slow})
    late = record(3, col("at") + 3600, col("url"), "revisit", F.lit('"new"'), col("at"), {"etag": F.lit('"new"')})
    return base.select(F.inline(F.array(full, early, again, late)))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolve_revisits(captures(_table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    header = lambda h: F.try_element_at("headers", F.lit(h))
    return done.select(
        "record_id", "url_key", "ts", "refers_to", "status", header("etag").alias("etag"),
        header("cache-control").alias("cache_control"), header("content-type").alias("content_type"),
    )


OP4_SQL = r"""
with base as (
  select page_id, url, '"' || substr(md5(html), 1, 16) || '"' as tag, page_id * 60 as tick from pages
), log as (
  select page_id * 4 as record_id, tick as ts, url, true as full_, tag as etag, tick as last_modified,
         tag as h_etag, 'max-age=60' as h_cache, 'text/html' as h_type from base
  union all select page_id * 4 + 1, tick - 600, url, false, null, tick, null, 'max-age=120', null from base
  union all select page_id * 4 + 2, tick + 1800,
         regexp_replace(url, '#.*', '') || case when instr(url, '?') > 0 then '&' else '?' end || 'utm_medium=mail',
         false, 'W/' || tag, null, null, 'max-age=120', 'text/plain' from base
  union all select page_id * 4 + 3, tick + 3600, url, false, '"new"', tick, '"new"', null, null from base
), keyed as (
  select *,
    regexp_replace(lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)), ':(80|443)?$', '')
    || case when regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1) end
    || case when q = '' then '' else '?' || q end as url_key
  from (select *, coalesce(array_to_string(list_sort(list_filter(
          string_split(regexp_extract(url, '^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), '&'),
          lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]*|gclid|fbclid)(=.*)?$'))), '&'), '') as q from log)
), seen as (
  select *, max(case when full_ then ts * 100000000000 + record_id end) over w as prev from keyed
  window w as (partition by url_key order by ts, record_id rows between unbounded preceding and 1 preceding)
), matched as (
  select r.*, f.record_id as refers_to, f.etag as f_etag, f.last_modified as f_modified, f.h_etag as g_etag, f.h_cache as g_cache, f.h_type as g_type
  from seen r left join keyed f on f.full_ and f.url_key = r.url_key and f.ts * 100000000000 + f.record_id = r.prev
  where not r.full_
), judged as (
  select *, case when refers_to is null then 'orphan'
    when etag is not null and f_etag is not null then
      case when regexp_replace(etag, '^W/', '') = regexp_replace(f_etag, '^W/', '') then 'resolved' else 'mismatch' end
    when last_modified is not null and f_modified is not null then
      case when last_modified = f_modified then 'resolved' else 'mismatch' end
    else 'unverified' end as status
  from matched
)
select record_id, url_key, ts, refers_to, status,
  case when status in ('resolved', 'unverified') then coalesce(h_etag, g_etag) else h_etag end as etag,
  case when status in ('resolved', 'unverified') then coalesce(h_cache, g_cache) else h_cache end as cache_control,
  case when status in ('resolved', 'unverified') then g_type else h_type end as content_type
from judged
"""


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of the documents table's ids serve as outcomes of the pages
    with those numbers: bad if of low quality or toxic."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    labelled = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return judge_urls(_table(spark, sf_dir, "pages"), labelled, RULES).withColumn("bad_low", F.round("bad_low", 6))


def _rules_sql(column: str, other: str) -> str:
    out = other
    for r in sorted(RULES, key=lambda r: (len(r.text), r.text)):
        fits = f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
        out = f"case when {fits} then '{getattr(r, column)}' else {out} end"
    return out


_RHO = "1 / least(greatest(coalesce(sum(({k} - {n} * {m}) ** 2 - {n} * {m} * (1 - {m})) / nullif(sum({n} * {m} * (1 - {m}) * ({n} - 1)), 0), 0.0001), 0.0001), 0.99) - 1"
OP5_SQL = f"""
with urls as (
  select page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages
), marks as (
  select doc_id as page_id, count(*)::double as n, sum(case when quality = 0 or toxic = 1 then 1.0::double else 0.0::double end) as k
  from labels where doc_id is not null and ((quality = 0 or toxic = 1) is not null) group by doc_id
), counts as (
  select host, string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') as parts, coalesce(sum(n), 0.0::double) as n, coalesce(sum(k), 0.0::double) as k
  from urls left join marks using (page_id) where host <> '' group by host
), named as (
  select *, case when regexp_matches(array_to_string(parts, '.'), '^([0-9]+(\\.[0-9]+){{3}}|\\[.*\\])$') then ''
    when array_to_string(parts[-2:], '.') in ({", ".join(f"'{x}'" for x in sorted(SUFFIXES))}) then array_to_string(parts[-2:], '.')
    else parts[-1] end as suffix from counts
), hosts as (
  select host, suffix, case when suffix = '' then array_to_string(parts, '.')
    else array_to_string(parts[-(len(string_split(suffix, '.')) + 1):], '.') end as domain, n, k from named
), domains as (select domain, suffix, sum(n) as n, sum(k) as k from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(k) as k from domains group by all),
whole as (select (sum(k) + 0.5) / (sum(n) + 1) as m from suffixes having sum(n) > 0),
s1 as (select m, {_RHO.format(k="k", n="n", m="m")} as s from suffixes, whole where n > 0 group by m),
p1 as (select suffix, (k + m * s) / (n + s) as a from suffixes, s1),
s2 as (select {_RHO.format(k="k", n="n", m="a")} as s from domains join p1 using (suffix) where n > 0),
p2 as (select domain, (k + a * s) / (n + s) as a from domains join p1 using (suffix), s2),
s3 as (select {_RHO.format(k="k", n="n", m="a")} as s from hosts join p2 using (domain) where n > 0),
p3 as (select host, (k + a * s) / (n + s) as a, n + s as t from hosts join p2 using (domain), s3),
low as (
  select u.page_id, u.host, u.path, coalesce(greatest(a - 1.645 * sqrt(a * (1 - a) / (t + 1)), 0.0), 0.0) as low from urls u left join p3 using (host)
)
select page_id, host, path, {_rules_sql("text", "null")} as rule,
  {_rules_sql("verdict", "case when low > 0.5 then 'block' else 'allow' end")} as verdict, round(low, 6) as bad_low from low
"""


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_line_dedup": op1,
    "op2_jaccard_join": op2,
    "op3_toxicity": op3,
    "op4_warc_revisits": op4,
    "op5_url_reputation": op5,
    "op6_license_scan": op6,
    "op7_quality_trees": op7,
    "op8_sentencepiece": op8,
    "op9_kneser_ney": op9,
    "op10_decontaminate": op10,
}

ORACLES = {"op2_jaccard_join": OP2_SQL, "op4_warc_revisits": OP4_SQL, "op5_url_reputation": OP5_SQL}
