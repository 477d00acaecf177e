"""Chunkers: from documents (doc_id, text, metadata) to chunks.

Each gives the raw pieces of a text as an array; the shared wrapper strips them,
drops blank ones (they still use up a position) and names the rest. `fixed` is
one expression; the others walk a text step by step, in Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, fields
from itertools import accumulate, batched

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import text as T
from .batches import bounded_batches, give_back

_WORDS = re.compile(T.WORDS.removeprefix("(?U)"))
_SENTENCE = re.compile(T.SENTENCE_END.removeprefix("(?U)"))
_BLANK_LINES = re.compile("\n{2,}")
_HEADING = re.compile("(#{1,6})\\s+(.*)")


def word_count(text: str) -> int:
    return len(_WORDS.findall(text))


def tiktoken_length(ranks_path: str, pattern: str) -> Callable[[str], int]:
    """A length in tokens of a vocabulary file, in place of words or characters."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(coder.encode_ordinary(text))


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError(f"size must be above 0, not {size}")
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be from 0 to below size, not {overlap}")


def sentence_list(text: str) -> list[str]:
    out = []
    for block in _BLANK_LINES.split(text):
        out += [s for s in map(str.strip, _SENTENCE.split(block)) if s]
    return out


def pack(units: Sequence[str], sizes: Sequence[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows [first, end) of a greedy packing with carried overlap.

    With prefix sums each window's end, and where the next begins, are binary
    searches: the longest run within size (one unit at least); then back to the
    longest suffix within overlap, unless that is the whole window. Where the
    unit after the suffix wouldn't fit beside it, the suffix is a window itself.
    """
    check_window(size, overlap)
    total = [0, *accumulate(sizes)]
    out, first, n = [], 0, len(units)
    while first < n:
        end = max(first + 1, bisect_right(total, total[first] + size) - 1)
        out.append((first, end))
        if end == n:
            break
        carry = end
        while carry > first and total[end] - total[carry - 1] <= overlap:
            carry -= 1
        first = carry if carry > first else end
    return out


def pack_text(
    units: Sequence[str], size: int, overlap: int, length: Callable[[str], int], joiner: str, least: int
) -> list[str]:
    """Windows as texts; a last one under `least` is joined to the one before it."""
    spans = pack(units, [length(u) for u in units], size, overlap)
    out = [joiner.join(units[a:b]) for a, b in spans]
    if len(out) > 1 and length(out[-1]) < least:
        last = out.pop()
        out[-1] += joiner + last
    return out


@dataclass(frozen=True)
class Chunker:
    """Subclasses have a name and give pieces as a Column, or pieces_of one text."""

    name = "chunker"

    def pieces_of(self, text: str) -> list[str]:
        raise NotImplementedError

    def pieces(self, text: Column) -> Column:
        split = self.pieces_of

        @pandas_udf("array<string>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series([split(t or "") for t in s], dtype=object)
            give_back()

        return run(text)

    def describe(self) -> str:
        shown = [f"{f.name}={getattr(self, f.name)}" for f in fields(self) if f.type == "int"]
        return f"{self.name}({', '.join(shown)})"

    def split(self, docs: DataFrame) -> DataFrame:
        """Chunks: chunk_id, doc_id, position, text, metadata (the document's and
        the chunker's name). A document without pieces has none."""
        bounded_batches(docs.sparkSession)
        meta = F.col("metadata") if "metadata" in docs.columns else F.lit(None).cast("map<string,string>")
        empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        kept = F.map_filter(F.coalesce(meta, empty), lambda k, v: k != "chunker")
        named = F.map_concat(kept, F.create_map(F.lit("chunker"), F.lit(self.name)))
        raw = docs.select(F.col("doc_id"), named.alias("metadata"), F.posexplode(self.pieces(F.col("text"))).alias("position", "piece"))
        piece = raw.withColumn("text", T.strip("piece")).where("text <> ''")
        return piece.select(T.stable_id(F.col("doc_id"), F.col("position"), F.col("text")).alias("chunk_id"), "doc_id", "position", "text", "metadata")


@dataclass(frozen=True)
class Fixed(Chunker):
    """Windows of `size` word tokens joined by spaces, each `overlap` into the one before."""

    size: int = 256
    overlap: int = 32
    name = "fixed"

    def __post_init__(self) -> None:
        check_window(self.size, self.overlap)

    def pieces(self, text: Column) -> Column:
        step = self.size - self.overlap
        words = T.word_tokens(text)
        n = F.size(words)
        last = F.when(n <= self.size, 0).otherwise(F.ceil((n - self.size) / step) * step).cast("int")
        cut = lambda s: F.array_join(F.slice(words, s + 1, F.lit(self.size)), " ")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), cut)).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Sentence(Chunker):
    """Whole sentences packed to `size` words with about `overlap` words carried."""

    size: int = 180
    overlap: int = 40
    length: Callable[[str], int] = field(default=word_count, compare=False)
    name = "sentence"

    def __post_init__(self) -> None:
        check_window(self.size, self.overlap)

    def pieces_of(self, text: str) -> list[str]:
        return pack_text(sentence_list(text), self.size, self.overlap, self.length, " ", max(1, self.size // 6))


@dataclass(frozen=True)
class Recursive(Chunker):
    """Splits at the coarsest separator that brings pieces under `size` characters,
    then packs them; a separator stays at the front of what follows it."""

    size: int = 800
    overlap: int = 120
    separators: tuple[str, ...] = (*("\n" + x for x in ("## ", "### ", "\n", "")), ". ", " ", "")
    length: Callable[[str], int] = field(default=len, compare=False)
    name = "recursive"

    def __post_init__(self) -> None:
        check_window(self.size, self.overlap)

    def _cut(self, text: str) -> list[str]:
        # a stack of (piece, number of separators already used) keeps the order without recursion
        stack, out = [(text, 0)], []
        while stack:
            piece, level = stack.pop()
            while self.length(piece) > self.size and level < len(self.separators) and self.separators[level] and self.separators[level] not in piece:
                level += 1
            if self.length(piece) <= self.size or level == len(self.separators):
                out.append(piece)
            elif not (sep := self.separators[level]):
                out += map("".join, batched(piece, self.size))
            else:
                head, *tail = piece.split(sep)
                stack += reversed([(p, level + 1) for p in (head, *(sep + t for t in tail))])
        return out

    def pieces_of(self, text: str) -> list[str]:
        units = [p for p in self._cut(text.strip()) if p.strip()]
        return pack_text(units, self.size, self.overlap, self.length, "", max(1, self.size // 8))


@dataclass(frozen=True)
class Markdown(Chunker):
    """Sections between headings, each led by its trail of headings; those over
    max_size are split as by Recursive."""

    max_size: int = 1200
    overlap: int = 100
    include_trail: bool = True
    name = "markdown"

    def __post_init__(self) -> None:
        check_window(self.max_size, self.overlap)

    def pieces_of(self, text: str) -> list[str]:
        trail: list[str] = []
        sections: list[tuple[tuple[str, ...], list[str]]] = [((), [])]
        for line in text.splitlines():
            if m := _HEADING.fullmatch(line):
                depth = len(m[1]) - 1
                trail = [*trail[:depth], *[""] * (depth - len(trail)), m[2].strip()]
                sections.append((tuple(trail), []))
            else:
                sections[-1][1].append(line)
        out: list[str] = []
        for heads, lines in sections:
            body = "\n".join(lines).strip()
            if not body:
                continue
            if heads and self.include_trail:
                body = " > ".join(heads) + "\n\n" + body
            out += [body] if len(body) <= self.max_size else Recursive(self.max_size, self.overlap).pieces_of(body)
        return out


CHUNKERS: dict[str, type[Chunker]] = {c.name: c for c in (Fixed, Sentence, Recursive, Markdown)}


def register_chunker(kind: type[Chunker]) -> type[Chunker]:
    CHUNKERS[kind.name] = kind
    return kind


def get_chunker(name: str, **options) -> Chunker:
    if name not in CHUNKERS:
        raise KeyError(f"no chunker {name!r}; there are {', '.join(sorted(CHUNKERS))}")
    return CHUNKERS[name](**options)
