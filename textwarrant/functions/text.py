"""Text as columns: normalisation, words, terms, sentences, spans."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \w differs from the Unicode meaning that is wanted here, with or without its flag.
PUNCTUATION = r"[^\p{L}\p{N}_\s]"
#: Texts whose pieces are Python objects at a time.
TEXTS_AT_ONCE = 64
#: What Python's \s means, in a Java class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(text: Column) -> Column:
    """Lower case, without punctuation, words parted by single spaces."""
    bare = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def words(text: Column) -> Column:
    """The words of a text that is already normalised; none for an empty one."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def runs(words_: Column, n: int) -> Column:
    """All runs of ``n`` words in order, each as one string."""

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - F.lit(n - 1))
        return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(words_, of)


def chunks(text: Column, size: int) -> Column:
    """A text in pieces of ``size`` characters; an empty one has no piece."""
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    pieces = F.transform(starts, lambda i: F.substr(text, i * size + 1, F.lit(size)))
    return F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))


def pieces(text: Column, find: Callable[[str], Iterable[tuple[int, int]]]) -> Column:
    """array<struct<text, start, end>> of the places that ``find`` tells; none for null.

    Spark has no function that tells where matches are, and a fold that carries
    the place copies what it has gathered at every step.
    """

    kind = pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def some(texts: pa.Array) -> pa.Array:
        parts, starts, ends, edges = [], array("i"), array("i"), array("i", [0])
        for t in texts.to_pylist():
            for a, b in find(t) if t is not None else ():
                parts.append(t[a:b])
                starts.append(a)
                ends.append(b)
            edges.append(len(starts))
        rows = pa.StructArray.from_arrays([pa.array(parts, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows)

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # as Python objects a batch's pieces take many times its own memory, and as Arrow's several times: few texts at a time
        for texts in batches:
            yield from (some(texts.slice(at, TEXTS_AT_ONCE)) for at in range(0, len(texts), TEXTS_AT_ONCE))

    return F.arrow_udf(of, "array<struct<text:string,start:int,end:int>>")(text)


def sentence_spans(text: Column) -> Column:
    """array<struct<text, start, end>> of sentences, half open, without the white space around them.

    A sentence ends with one of ``. ! ? ؟`` before white space, or at a line's end.
    """
    end = re.compile(r"(?<=[.!?؟])(?=\s)|\n")

    def find(value: str) -> Iterable[tuple[int, int]]:
        at = 0
        for stop in [*(m.end() for m in end.finditer(value)), len(value)]:
            part = value[at:stop]
            if body := part.strip():
                lead = len(part) - len(part.lstrip())
                yield at + lead, at + lead + len(body)
            at = stop

    return pieces(text, find)


def token_pieces(text: Column) -> Column:
    """array<struct<text, start, end>>: what stands between white space."""
    return pieces(text, lambda value: (m.span() for m in re.finditer(r"\S+", value)))


def token_spans(text: Column) -> Column:
    """array<struct<text, norm, start, end>>: the words of a text as written, normalised, with their places.

    What is punctuation only is no word.
    """
    return F.filter(with_norms(token_pieces(text)), lambda x: x["norm"] != "")


def with_norms(pieces_: Column) -> Column:
    """Pieces of a text, each with its normal form, which may be empty."""
    return F.transform(pieces_, lambda x: F.struct(x["text"].alias("text"), normalize(x["text"]).alias("norm"), x["start"].alias("start"), x["end"].alias("end")))


def token_count(text: Column) -> Column:
    """How many words :func:`token_spans` finds, in one pass and without making them; null for null.

    Possessive, and tried where a word begins only, so that long runs of signs take one pass too.
    """
    return F.regexp_count(text, F.lit(rf"(?<![^{SPACE}])[^{SPACE}\p{{L}}\p{{N}}_]*+[\p{{L}}\p{{N}}_]"))
