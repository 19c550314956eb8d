"""Sequence alignment of texts, on candidate pairs only: these run Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def similarity(a: Column, b: Column, least: float | None = None) -> Column:
    """Mean of the Ratcliff-Obershelp ratios of characters and of words.

    With ``least`` null where it can't be that, rounded to six places, by words and the characters in common in any order: characters are aligned for the others only.
    """

    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        from collections import Counter
        from difflib import SequenceMatcher

        def one(x: str, y: str) -> float | None:
            if x is None or y is None:
                return None
            in_words = SequenceMatcher(None, x.split(), y.split(), autojunk=False).ratio()
            if least is not None:
                total = len(x) + len(y)
                most = 2.0 * (Counter(x) & Counter(y)).total() / total if total else 1.0
                if round((most + in_words) / 2, 6) < least:
                    return None
            return (SequenceMatcher(None, x, y).ratio() + in_words) / 2

        return pd.Series([one(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return F.pandas_udf(of, DoubleType())(a, b)


def similarity_bound(a: Column, b: Column) -> Column:
    """At least the similarity, in one pass over both: what their characters and words have in common in any order."""

    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        from collections import Counter

        def share(x: Counter, y: Counter) -> float:
            total = x.total() + y.total()
            return 2.0 * (x & y).total() / total if total else 1.0

        def one(x: str, y: str) -> float | None:
            if x is None or y is None:
                return None
            return (share(Counter(x), Counter(y)) + share(Counter(x.split()), Counter(y.split()))) / 2

        return pd.Series([one(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return F.pandas_udf(of, DoubleType())(a, b)


def opcodes(a: Column, b: Column, autojunk: bool = True) -> Column:
    """array<struct<op, i1, i2, j1, j2>>: how the words of ``a`` become those of ``b``; equal stretches are left out."""

    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        rows = []
        for x, y in zip(left, right, strict=True):
            found = SequenceMatcher(None, list(x), list(y), autojunk=autojunk).get_opcodes()
            rows.append([o for o in found if o[0] != "equal"])
        return pd.Series(rows, dtype=object)

    return F.pandas_udf(of, "array<struct<op:string,i1:int,i2:int,j1:int,j2:int>>")(a, b)


def word_differences(a_words: Column, b_words: Column) -> Column:
    """Messages about replaced, extra and missing words."""
    cut = lambda w, i, j: F.array_join(F.slice(w, i + 1, j - i), " ")
    said = lambda o: (
        F.when(o["op"] == "replace", F.concat(F.lit("'"), cut(a_words, o["i1"], o["i2"]), F.lit("' differs from '"), cut(b_words, o["j1"], o["j2"]), F.lit("'")))
        .when(o["op"] == "delete", F.concat(F.lit("extra words: '"), cut(a_words, o["i1"], o["i2"]), F.lit("'")))
        .otherwise(F.concat(F.lit("missing words: '"), cut(b_words, o["j1"], o["j2"]), F.lit("'")))
    )
    return F.transform(opcodes(a_words, b_words), said)


def readings(a_raw: Column, a_norm: Column, b_raw: Column, b_norm: Column, around: int = 3) -> Column:
    """array<struct<before, a, b, after>>: where two readings of a page differ, with words around."""
    cut = lambda w, i, j: F.array_join(F.slice(w, i + 1, F.greatest(j - i, F.lit(0))), " ")
    part = lambda o: F.struct(
        cut(a_raw, F.greatest(o["i1"] - around, F.lit(0)), o["i1"]).alias("before"),
        cut(a_raw, o["i1"], o["i2"]).alias("a"),
        cut(b_raw, o["j1"], o["j2"]).alias("b"),
        cut(a_raw, o["i2"], o["i2"] + around).alias("after"),
    )
    return F.transform(opcodes(a_norm, b_norm, autojunk=False), part)


def decomposed(text: Column, form: str = "NFKD") -> Column:
    """Unicode normalisation; of a decomposition the combining signs go."""

    def of(texts: pd.Series) -> pd.Series:
        import unicodedata

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            t = unicodedata.normalize(form, t)
            return "".join(c for c in t if not unicodedata.combining(c)) if form == "NFKD" else t

        return texts.map(one)

    return F.pandas_udf(of, "string")(text)


def ordered_share(quote_words: Column, text_words: Column, weights: Column) -> Column:
    """The weighted share of a quote's words that a text holds in order; ``weights`` go with the quote's words."""

    def of(quotes: pd.Series, texts: pd.Series, weight: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        out = []
        for q, t, w in zip(quotes, texts, weight, strict=True):
            total = float(sum(w))
            blocks = SequenceMatcher(None, list(q), list(t), autojunk=False).get_matching_blocks()
            out.append(sum(float(sum(w[b.a : b.a + b.size])) for b in blocks) / total if total else 0.0)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(of, DoubleType())(quote_words, text_words, weights)
