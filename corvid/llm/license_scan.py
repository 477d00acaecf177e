"""License scan: base phrases by words, short notices with errors.

A notice of k allowed errors is cut into k + 1 seeds: any text within k edits
of it holds one of them whole (pigeonhole). One pass with an automaton over all
notices' seeds finds candidates; the regex library then matches the notice with
bounded errors in the window that seeds of one start imply, and reports its span
and edits. What tells one licence from another (names, version numbers) stands
in braces and allows no error: edits are made in the rest.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashstore import batches
from .shared import bounded_batches
from .textops import ALNUM_ANY_CASE, buffer_of, hash_words, owners, prefix_sums, range_hashes, slices, spans

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: (label, notice, edits allowed): about one edit in ten characters, none in braces.
NOTICES = (
    ("apache-2.0", "licensed under the {apache} license, version {2.0}", 4),
    ("mit", "released under the {mit} license", 3),
    ("mit", "permission is hereby granted, free of charge, to any person {obtaining}", 5),
    ("cc-by-nc", "licensed under cc {by-nc 4.0}", 2),
    ("cc-by-sa", "licensed under cc {by-sa 4.0}", 2),
    ("gpl-3.0", "licensed under the {gnu} general public license, version {3}", 5),
    ("bsd", "redistribution and use in source and binary forms, with or without modification", 7),
    ("mpl-2.0", "subject to the terms of the {mozilla} public license, v. {2.0}", 5),
    ("isc", "permission to use, copy, modify, {and/or} distribute this software", 6),
    ("unlicense", "this is free and unencumbered software released into the public domain", 6),
)


def parts_of(notice: str) -> list[tuple[str, bool]]:
    """(text, whether it must stand as it is) of a notice with braces."""
    out = [(x, i % 2 == 1) for i, x in enumerate(notice.replace("}", "{").split("{"))]
    return [x for x in out if x[0]]


def seeds_of(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 parts that cover the notice: (offset, part)."""
    cut = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:])]


@lru_cache(maxsize=4)
def _searcher(notices: tuple):
    import ahocorasick
    import regex

    found: dict[str, list[tuple[int, int]]] = {}
    patterns, sizes = [], []
    for i, (_, notice, errors) in enumerate(notices):
        parts = parts_of(notice)
        plain = "".join(x for x, _ in parts)
        for at, seed in seeds_of(plain, errors):
            found.setdefault(seed, []).append((i, at))
        exact = lambda x: "(?<![a-z0-9])" * x[0].isalnum() + regex.escape(x) + "(?![a-z0-9])" * x[-1].isalnum()
        patterns.append(regex.compile("".join(exact(x) if fixed else f"(?:{regex.escape(x)}){{e<={errors}}}" for x, fixed in parts), regex.BESTMATCH))
        sizes.append(len(plain))
    automaton = ahocorasick.Automaton()
    for seed, where in found.items():
        automaton.add_word(seed, (len(seed), where))
    automaton.make_automaton()
    return automaton, patterns, sizes


def _windows(text: str, automaton, sizes: list[int], notices: tuple) -> dict[int, list[tuple[int, int]]]:
    """Where each notice may stand. Seeds that put its start within its errors
    share a window, so that a window has at most three errors more than it."""
    starts: dict[int, set[int]] = {}
    for end, (size, where) in automaton.iter(text):
        for i, at in where:
            starts.setdefault(i, set()).add(end + 1 - size - at)
    out = {}
    for i, found in starts.items():
        e, runs = notices[i][2], []
        for x in sorted(found):
            if runs and x - runs[-1][0] <= e:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        out[i] = [(max(0, x - e), min(len(text), y + sizes[i] + e)) for x, y in runs]
    return out


def find_notices(text: str, notices: tuple = NOTICES) -> list[dict]:
    """Matches in a text whose A-Z is folded: label, span, edits. Of spans that
    overlap, the one with fewer edits stays, of equals that of the longer
    notice, then the first. Takes time in proportion to the text."""
    automaton, patterns, sizes = _searcher(notices)
    hits = []
    for i, windows in _windows(text, automaton, sizes, notices).items():
        label, _, e = notices[i]
        for parts in ([w] for w in windows):
            while parts:
                x, y = parts.pop()
                m = patterns[i].search(text, x, y) if y - x >= sizes[i] - e else None
                if m and sum(m.fuzzy_counts) <= e:
                    hits.append({"label": label, "start": m.start(), "end": m.end(), "edits": sum(m.fuzzy_counts), "size": sizes[i]})
                    parts += [(x, m.start()), (m.end(), y)]
    hits.sort(key=lambda h: (h["edits"], -h["size"], h["start"], h["end"], h["label"]))
    begins: list[int] = []
    best: list[dict] = []
    for h in hits:
        at = bisect_right(begins, h["start"])
        if (not at or best[at - 1]["end"] <= h["start"]) and (at == len(best) or h["end"] <= begins[at]):
            begins.insert(at, h["start"])
            best.insert(at, h)
    return best


def phrase_places(buf: np.ndarray, offs: np.ndarray, phrases: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each phrase the text and word number of every place."""
    starts, ends, ptr = spans(buf, offs, ALNUM_ANY_CASE)
    h, doc = range_hashes(prefix_sums(buf, lower=True), starts, ends), owners(ptr)
    out = []
    for phrase in phrases:
        keys = hash_words(phrase.split(" "))
        total = len(h) - len(keys) + 1
        at = np.flatnonzero(h[: max(total, 0)] == keys[0])
        for k in range(1, len(keys)):
            at = at[h[at + k] == keys[k]]
        at = at[doc[at] == doc[at + len(keys) - 1]]
        out.append((doc[at], at - ptr[doc[at]]))
    return np.diff(ptr), out


def _scan(rows: Iterator[pa.RecordBatch], phrases: dict, notices: tuple) -> Iterator[pa.RecordBatch]:
    names = list(phrases)
    fold = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    for batch in batches(rows):
        buf, offs = buffer_of(batch.column(1))
        for a, z, b, o in slices(buf, offs):
            n_words, places = phrase_places(b, o, names)
            n = z - a
            base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[set] = [set() for _ in range(n)]
            for name, (doc, word) in zip(names, places):
                base += np.bincount(doc, minlength=n)
                np.minimum.at(first, doc, word)
                np.maximum.at(last, doc, word)
                for d in np.unique(doc):
                    labels[d].add(phrases[name])
            found = [find_notices(b[o[i] : o[i + 1]].tobytes().translate(fold).decode(), notices) for i in range(n)]
            absent = base == 0
            yield pa.record_batch(
                {
                    "id": batch.column(0).slice(a, n),
                    "n_words": pa.array(n_words.astype(np.int64)),
                    "n_base": pa.array(base),
                    "first_word": pa.array(first, mask=absent),
                    "last_word": pa.array(last, mask=absent),
                    "base_labels": pa.array([",".join(sorted(x)) for x in labels]),
                    "labels": pa.array([",".join(sorted(x | {h["label"] for h in f})) for x, f in zip(labels, found)]),
                    "score": pa.array([1.0 if x else max((1 - h["edits"] / h["size"] for h in f), default=0.0) for x, f in zip(labels, found)], pa.float64()),
                    "notices": pa.array([[{k: h[k] for k in ("label", "start", "end", "edits")} for h in f] for f in found], NOTICE),
                }
            )


NOTICE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: tuple = NOTICES
) -> DataFrame:
    """Per row of docs: the id, n_words, n_base, first_word, last_word,
    base_labels, labels, score and notices (label, span in code points, edits).

    Words are runs of digits, letters and characters beyond ASCII, A-Z folded.
    n_base counts the places where a phrase's words stand in a row. Each list of
    labels is distinct, sorted and comma-joined. score is 1 with a base label,
    else 1 - edits / length of the best notice, else 0. Null and empty texts
    have 0 words, "" for labels and score 0; very long texts are searched whole,
    in time that grows with their length. Rows that repeat an id, or have
    none, get a row each. An empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = (
        "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
        " notices array<struct<label:string,start:int,end:int,edits:int>>"
    )
    return rows.mapInArrow(lambda it: _scan(it, phrases, notices), schema).withColumnRenamed("id", id_col)
