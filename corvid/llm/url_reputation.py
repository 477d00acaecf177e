"""URL filter: rules first, then empirical-Bayes reputation of the host.

Labelled page outcomes (1 bad) are counted by host. Rates are shrunk through
beta-binomial priors down the name: all pages -> public suffix -> registered
domain -> host, each level's prior centred on the posterior mean above it, with
a strength found by the method of moments from how much that level's counts
spread beyond binomial chance. A page is blocked if the lower bound of its
host's posterior bad rate is above a limit.

Pages are counted by host in one pass; all else is worked out from that table
and the smaller ones of domains and suffixes, and only sums pass through the
driver. Names are joined to rows by broadcast if their measured size allows it;
beyond that, names that hold a thousandth of the rows or more (a thousand at
most) are broadcast, and the other rows are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Public suffixes of several labels under which unrelated parties register; every single label is one too.
SUFFIXES = frozenset(
    f"{second}.{top}"
    for top, seconds in {
        "uk": "co org ac gov ltd plc me net sch nhs", "au": "com net org edu gov id asn", "nz": "co net org ac govt", "za": "co org net web ac gov",
        "jp": "co ne or ac go ad gr ed", "kr": "co or ne re go ac", "in": "co net org gen firm ac edu gov", "il": "co org net ac gov",
        "br": "com net org gov edu art blog", "ar": "com net org gob edu", "mx": "com net org gob edu", "co": "com net org gov edu", "pe": "com net org gob edu",
        "cn": "com net org gov edu ac", "tw": "com net org gov edu idv", "hk": "com net org gov edu idv", "sg": "com net org gov edu", "my": "com net org gov edu",
        "th": "co or in ac go net", "id": "co or web ac go net", "ph": "com net org gov edu", "vn": "com net org gov edu", "tr": "com net org gov edu gen web",
        "ua": "com net org gov edu", "pl": "com net org gov edu waw", "ru": "com net org msk spb", "gr": "com net org gov edu", "at": "co or gv ac", "es": "com org nom gob edu",
        "pt": "com org gov edu", "it": "gov edu", "fr": "com asso gouv", "hu": "co org", "ro": "com org", "ng": "com org net gov edu", "ke": "co or ne go ac",
        "eg": "com org net gov edu", "sa": "com org net gov edu", "ae": "co org net gov ac", "pk": "com org net gov edu", "bd": "com org net gov edu",
        "io": "github gitlab", "com": "blogspot wordpress herokuapp appspot", "app": "netlify vercel web", "dev": "pages workers", "net": "azurewebsites cloudfront",
    }.items()
    for second in seconds.split()
)


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and paths that start so."""

    verdict: str
    text: str  # host, then the path from its "/"

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_host(host: Column) -> Column:
    """Without user and port."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$", "")


def public_suffix(host: Column, suffixes: frozenset[str] = SUFFIXES) -> Column:
    """Of a bare host: the longest of the suffixes it ends with, else its last
    label; "" for addresses."""
    out = F.substring_index(host, ".", -1)
    for k in sorted({s.count(".") + 1 for s in suffixes}):
        tail = F.substring_index(host, ".", -k)
        out = F.when(tail.isin(sorted(s for s in suffixes if s.count(".") + 1 == k)), tail).otherwise(out)
    return F.when(host.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"), "").otherwise(out)


def registered_domain(host: Column, suffix: Column) -> Column:
    """Of a bare host: its suffix and one label more, or an address whole."""
    labels = F.size(F.split(suffix, r"\.")) + 1
    return F.when(suffix == "", host).otherwise(F.array_join(F.slice(F.split(host, r"\."), -F.least(labels, F.size(F.split(host, r"\."))), labels), "."))


def _beside(rows: DataFrame, table: DataFrame, key: str, broadcast_bytes: int) -> DataFrame:
    """rows with the columns of a materialized table beside them; the table has a
    row for each key, and in `held` how many of the rows have it."""
    size = table.agg(F.sum(F.octet_length(key) + 64).alias("bytes"), F.sum("held").alias("rows")).first()
    if (size.bytes or 0) <= broadcast_bytes:
        return rows.join(F.broadcast(table.drop("held")), key, "left")
    hot = table.where(F.col("held") * 1000 >= size.rows).drop("held")  # a thousand at most
    found = [c for c in hot.columns if c != key]
    one = rows.join(F.broadcast(hot.withColumnsRenamed({c: f"__{c}" for c in found}).withColumn("__hot", F.lit(True))), key, "left")
    # rows with a hot key need no partner: they get keys of their own and spread evenly
    spread = F.when(F.col("__hot"), F.concat(F.lit("\0"), F.rand(1).cast("string"))).otherwise(F.col(key))
    rest = table.where(F.col("held") * 1000 < size.rows).drop("held").withColumnRenamed(key, "__key")
    both = one.withColumn("__to", spread).join(rest, F.col("__to") == F.col("__key"), "left")
    return both.select(*rows.columns, *(F.coalesce(f"__{c}", c).alias(c) for c in found))


def _strength(counts: DataFrame, mean: Column) -> float:
    """Prior strength from (n, k) rows around a mean: 1 / rho - 1 with rho the
    moment estimate of the correlation within a group, held to [0.0001, 0.99]."""
    spread = F.col("n") * mean * (1 - mean)
    r = counts.agg(
        F.sum((F.col("k") - F.col("n") * mean) ** 2 - spread).alias("over"), F.sum(spread * (F.col("n") - 1)).alias("pairs")
    ).first()
    rho = r.over / r.pairs if r.pairs else 0.0001
    return 1 / min(max(rho, 0.0001), 0.99) - 1


def host_reputation(
    counts: DataFrame, z: float = 1.645, suffixes: frozenset[str] = SUFFIXES, broadcast_bytes: int = 32 << 20
) -> DataFrame:
    """From (host, held, n, k), a row per host with how many rows have it, how
    many of them are labelled and how many of those bad: the same with domain,
    suffix, mean and low, the posterior mean and its lower bound. Hosts without
    labels have their domain's mean as prior and posterior. Without any label, low is 0."""
    bare = bare_host(F.col("host"))
    hosts = counts.withColumn("suffix", public_suffix(bare, suffixes)).withColumn("domain", registered_domain(bare, F.col("suffix")))
    hosts = materialize(hosts, "hosts")
    sums = [F.count("*").alias("held"), F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = materialize(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    tops = materialize(domains.groupBy("suffix").agg(*sums), "suffixes")
    whole = tops.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    if not whole.n:
        return hosts.withColumns({"mean": F.lit(0.5), "low": F.lit(0.0)})
    mean = (whole.k + 0.5) / (whole.n + 1)

    def posterior(above: Column, strength: float) -> Column:
        return (F.col("k") + above * strength) / (F.col("n") + strength)

    known = F.col("n") > 0
    top = posterior(F.lit(mean), _strength(tops.where(known), F.lit(mean)))
    tops = materialize(tops.select("suffix", "held", top.alias("above")), "suffixes")
    domains = _beside(domains, tops, "suffix", broadcast_bytes)
    middle = posterior(F.col("above"), _strength(domains.where(known), F.col("above")))
    domains = materialize(domains.select("domain", "held", middle.alias("above")), "domains")
    hosts = _beside(hosts, domains, "domain", broadcast_bytes)
    strength = _strength(hosts.where(known), F.col("above"))
    a = posterior(F.col("above"), strength)
    low = F.greatest(a - z * F.sqrt(a * (1 - a) / (F.col("n") + strength + 1)), F.lit(0.0))
    return hosts.withColumns({"mean": a, "low": low}).drop("above")


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    z: float = 1.645,
    limit: float = 0.5,
    suffixes: frozenset[str] = SUFFIXES,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """Per row of pages: the id, host, path, rule, verdict and bad_low.

    labelled has (page id, bad). The longest rule that fits decides; without
    one, a page is blocked if bad_low, the lower bound of its host's posterior,
    is above limit. A null url or one without "://" has empty host and path, no
    reputation and a bad_low of 0. A label counts for each row of its page id;
    null labels and ids count for nothing. Rows that repeat an id get a row each.
    Without labels, bad_low is 0 for all. Very long urls are taken whole. Columns
    of other names aren't read. An empty table gives an empty table.

    suffixes: public suffixes of several labels; an address (v4, or v6 in
    brackets) is a domain of its own.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    marks = labelled.select(F.col(id_col).alias("id"), F.col("bad").cast("double").alias("bad")).dropna()
    marks = marks.groupBy("id").agg(F.count("*").cast("double").alias("n"), F.sum("bad").alias("k"))
    counts = rows.where("host <> ''").select("id", "host").join(marks, "id", "left").groupBy("host").agg(
        F.count("*").alias("held"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0.0)).alias("k")
    )
    names = materialize(host_reputation(counts, z, suffixes, broadcast_bytes).select("host", "held", F.col("low").alias("bad_low")), "names")
    rows = _beside(rows, names, "host", broadcast_bytes).withColumn("bad_low", F.coalesce("bad_low", F.lit(0.0)))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("bad_low") > limit, "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rows.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "bad_low")
