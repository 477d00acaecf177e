"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with inner hyphens and apostrophes, or one character of punctuation.
WORDS = r"(?U)\w+(?:['’-]\w+)*|[^\s\w]"
_TERM = "[0-9a-z]+"
TERMS = f"{_TERM}(?:['-]{_TERM})*"
STOPWORDS = tuple(
    "the of and to in a is that it for on as with at by from be are was or an were has have its how into who will what which when where".split()
)
_UNIT = "\x1f"
_ABBREVIATIONS = (r"e\.g", r"i\.e", "etc", "vs", "No", "Fig")
#: White space after a sentence's end, with closers before it, unless an abbreviation ends there.
_NEVER = (r"[A-Z][a-z]\.", r"\b[A-Z]\.", *(rf"\b{a}\." for a in _ABBREVIATIONS))
_CLOSERS, _OPENERS = r"""[\])'"]*""", r"""[\[("'0-9A-Z]"""
SENTENCE_END = "(?U)" + "".join(f"(?<!{x})" for x in _NEVER) + rf"(?<=[!?.]){_CLOSERS}\s+(?={_OPENERS})"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def stable_id(*parts: Column) -> Column:
    """16 hexadecimal digits that depend on the parts' text alone."""
    joined = F.concat_ws(_UNIT, *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return F.substring(F.sha1(joined), 1, 16)


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORDS), F.lit(0))


def n_words(c: Column) -> Column:
    """The number of word_tokens."""
    return F.regexp_count(c, F.lit(WORDS))


def sentences(c: Column) -> Column:
    """Sentences of each block (blocks end at blank lines), stripped, none blank."""
    parts = F.flatten(F.transform(F.split(c, "\n{2,}"), lambda b: F.split(b, SENTENCE_END)))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def stem(t: Column) -> Column:
    """A term without a plural or common verb ending."""
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    long = n > 4
    ends = lambda *tails: reduce(Column.__or__, (t.endswith(x) for x in tails))
    return (
        F.when(long & t.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(long & ends("xes", "sses", "shes", "ches"), cut(2))
        .when((n > 5) & t.endswith("ing"), cut(3))
        .when(long & t.endswith("ed"), cut(2))
        .when((n > 3) & t.endswith("s") & ~ends("ss", "us", "is"), cut(1))
        .otherwise(t)
    )


def terms(c: Column, remove_stopwords: bool = True, stemmed: bool = True) -> Column:
    """A text's search terms, repeats and order kept."""
    out = F.regexp_extract_all(F.lower(c), F.lit(TERMS), F.lit(0))
    if remove_stopwords:
        out = F.filter(out, lambda t: ~t.isin(*STOPWORDS))
    return F.transform(out, stem) if stemmed else out


def snippet(c: Column, width: int = 240) -> Column:
    """White space runs made one space, cut to width with an ellipsis."""
    flat = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.rtrim(F.substring(flat, 1, width - 1)), F.lit("…"))).otherwise(flat)


def l2_normalized(v: Column) -> Column:
    """A vector divided by its length, a zero vector left as it is."""
    d = F.transform(v, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: x / F.greatest(size, F.lit(1e-12)))


def flatten_metadata(pairs: Column) -> Column:
    """A map of values as JSON parsing leaves them, text for nested ones, without
    null values; lists become their items joined by ", ", all else stays text."""
    kept = F.map_filter(pairs, lambda k, v: v.isNotNull())

    def flat(k: Column, v: Column) -> Column:
        items = F.when(v.rlike(r"(?s)\A\[.*\]\z"), F.from_json(v, "array<string>"))
        return F.coalesce(F.array_join(items, ", ", "None"), v)

    return F.transform_values(kept, flat)
