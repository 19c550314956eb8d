"""Quotations in several languages against the accepted wordings of each: finding them, and matching word by word."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarrant.functions.fuzzy import decomposed
from textwarrant.operators.retrieve import Asked, best_of_texts, bm25_idf, bm25_part, rounded, top_per_group
from textwarrant.tables import materialize

#: The share of a quotation's weight from which its wording is the accepted one.
SAME = 0.85
#: Words of an idf above this count as missing where a wording lacks them.
TELLING = 2.0
#: Words that a quotation has at least where it is found, and where it is matched.
FOUND_WORDS, MATCHED_WORDS = 4, 3
#: Characters before a quotation that are read for a hint of its kind.
BEFORE = 80


def letters_only(text: Column) -> Column:
    """Runs of letters of a lower-case text without its accents; none for null."""
    return F.coalesce(F.regexp_extract_all(decomposed(F.lower(text)), F.lit(r"\p{L}+"), F.lit(0)), F.array().cast("array<string>"))


def find_quotations(texts: DataFrame, cues: Mapping[str, str], said: Mapping[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, quote, hint) of the quotations in each text, ``end`` exclusive.

    A quotation is what stands in quotation marks, 12 characters and FOUND_WORDS
    words at least; its hint is the first kind of ``cues`` whose pattern the BEFORE
    characters before it hold. In a sentence without such marks it is what follows
    the first match of a pattern of ``said``, whose kind is the hint. Null texts and texts
    without quotations have no row; repeated rows are told each; texts are read whole.
    """
    marked = re.compile(r'["“”«»]([^"“”«»]{12,})["“”«»]')
    sentence = re.compile(r"(?<=[.!?؟।])\s+|\n+")
    before = [(k, re.compile(p, re.IGNORECASE)) for k, p in cues.items()]
    after = [(k, re.compile(rf"(?:{p})\s*[:,]?\s*", re.IGNORECASE)) for k, p in said.items()]

    def enough(words: str) -> bool:
        return len(re.findall(r"[^\W\d_]+", words)) >= FOUND_WORDS

    def found(text: str) -> Iterator[tuple[int, int, str, str | None]]:
        taken = []
        for m in marked.finditer(text):
            if enough(m[1]):
                near = text[max(0, m.start() - BEFORE) : m.start()]
                taken.append(m.span())
                yield m.start(), m.end(), m[1], next((k for k, p in before if p.search(near)), None)
        edges = [0, *(x for m in sentence.finditer(text) for x in m.span()), len(text)]
        nearest = 0
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            while nearest < len(taken) and taken[nearest][1] <= a:
                nearest += 1
            if nearest < len(taken) and taken[nearest][0] < b:
                continue
            cue = min(((m.start(), m.end(), k) for k, p in after if (m := p.search(text, a, b))), default=None)
            if cue:
                words = text[cue[1] : b].strip(" .,;:")
                if enough(words):
                    yield cue[1], cue[1] + len(text[cue[1] : b].rstrip(" .,;:")), words, cue[2]

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else sorted(found(t), key=lambda x: x[:2]) for t in texts], dtype=object)

    spans = F.pandas_udf(of, "array<struct<start:int,end:int,quote:string,hint:string>>")(F.col(text_col))
    return texts.select(id_col, F.inline(spans))


def _aligned(quote: Column, wording: Column, weights: Column) -> Column:
    """struct<share, missing>: the weight of the quote's words that the wording holds in order, and telling words that it doesn't."""

    def of(quotes: pd.Series, wordings: pd.Series, weights: pd.Series) -> pd.DataFrame:
        from difflib import SequenceMatcher

        shares, missing = [], []
        for q, t, w in zip(quotes, wordings, weights, strict=True):
            held = [False] * len(q)
            for block in SequenceMatcher(None, list(q), list(t), autojunk=False).get_matching_blocks():
                held[block.a : block.a + block.size] = [True] * block.size
            shares.append(float(sum(x for x, h in zip(w, held, strict=True) if h)) / (float(sum(w)) or 1.0))
            missing.append(list(dict.fromkeys(x for x, h, y in zip(q, held, w, strict=True) if not h and y > TELLING)))
        return pd.DataFrame({"share": shares, "missing": missing})

    return F.pandas_udf(of, "share double, missing array<string>")(quote, wording, weights)


def _bm25(asked: Asked, texts: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """BM25 of wordings given as their words, in order."""
    held = texts.column("wording")
    text, _, pair = asked.met(held)
    many = len(asked.query)
    met, tf = np.unique(text * many + pair, return_counts=True)
    text, pair = met // many, met % many
    dl = pc.list_value_length(held).to_numpy()[text]
    part = asked.weights["weight"][pair] * bm25_part(tf, dl, asked.weights["mean"][pair])
    return asked.summed(text, pair, part, len(texts)), asked.summed(text, pair, None, len(texts))


def match_quotations(quotes: DataFrame, wordings: DataFrame, floors: Mapping[str, float], k: int = 25, max_df_share: float = 0.2, by: Sequence[str] = ("quote_id", "lang")) -> DataFrame:
    """Each quotation's nearest accepted wording: ``by``, status, kind, text_id, share, missing, and the reference that is right.

    ``quotes`` has ``by`` (which name a row, lang among them), text, hint and given (a
    reference, or null); ``wordings`` has text_id, kind, lang, reference and text.
    Each language and kind is an index of its own, with its own counts; a hint
    leaves its kind's alone. Of an index the ``k`` wordings of the highest BM25
    (terms in more than ``max_df_share`` of it are skipped) are compared word by word, and
    the one that holds most of the quote's idf in order counts; of kinds the greater share.

    Below its kind's floor a quote is ``baseless``; ``verified`` from SAME on if no
    telling word is missing and the reference given is right; else ``semantic_variant``.
    Equal shares go to the better rank, then the smaller text_id. Quotes of fewer than
    MATCHED_WORDS words, of null text, or that share no term with their index are baseless with a null
    share. No wordings: all are. A text_id names one wording; wordings are scored where they are
    read, and only what can be among a quotation's ``k`` is a row.
    """
    by, index = list(by), ["kind", "lang"]
    held = materialize(wordings.select("text_id", "kind", "lang", "reference", letters_only(F.col("text")).alias("wording")), "wordings")
    stats = held.groupBy(*index).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("wording")).alias("mean"))
    df = held.select(*index, F.explode(F.array_distinct("wording")).alias("term")).groupBy(*index, "term").agg(F.count(F.lit(1)).alias("df"))
    df = materialize(df, "wording-terms")
    stats = stats.join(df.groupBy(*index).agg(F.min("df").alias("rarest")), index)

    asked = quotes.select(*by, "hint", "given", letters_only(F.col("text")).alias("quote"))
    meets = asked.filter(F.size("quote") >= MATCHED_WORDS).join(stats, "lang").filter("hint is null or hint = kind")
    placed = meets.select(*by, "kind", "n", "mean", "rarest", F.posexplode("quote").alias("at", "term")).join(df, [*index, "term"], "left")
    placed = placed.withColumn("weight", bm25_idf(F.col("n"), F.coalesce("df", "rarest")))
    placed = materialize(placed, "quote-terms")
    # one name for a quotation and its index, by which it is asked
    asks, name = F.to_json(F.struct(*by, "kind")), F.to_json(F.struct(*index))
    usable = placed.filter(F.col("df") <= F.col("n") * max_df_share).groupBy(*by, "kind", "term", "mean", "weight").agg(F.count(F.lit(1)).alias("times"))
    pairs = materialize(usable.select(asks.alias("asks"), "term", (F.col("times") * F.col("weight")).alias("weight"), "mean", name.alias("index")), "quote-weights")
    found = best_of_texts(held.filter("text_id is not null").select("text_id", name.alias("index"), "wording"), pairs, _bm25, k, index="index")
    keys = placed.select(asks.alias("asks"), *by, "kind").distinct()
    scored = found.select("asks", "text_id", rounded(F.col("score")).alias("score")).join(keys, "asks").drop("asks")
    near = materialize(top_per_group(scored, [*by, "kind"], "score", "text_id", k), "near-wordings")

    whole = placed.groupBy(*by, "kind").agg(F.sort_array(F.collect_list(F.struct("at", "term", "weight"))).alias("q"))
    pairs = near.join(whole, [*by, "kind"]).join(held.select("text_id", *index, "reference", "wording"), ["text_id", *index])
    told = _aligned(F.transform("q", lambda x: x["term"]), F.col("wording"), F.transform("q", lambda x: x["weight"]))
    pairs = pairs.select(*by, "kind", "text_id", "rank", "reference", told.alias("told")).select("*", F.round("told.share", 6).alias("share"), "told.missing")
    best = pairs.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("share"), "rank", "text_id"))).filter("place = 1")

    floor = F.create_map(*[F.lit(x) for pair in floors.items() for x in pair])[F.col("kind")]
    right = F.col("given").isNull() | F.col("given").eqNullSafe(F.col("reference"))
    status = F.when(F.col("share").isNull() | (F.col("share") < floor), "baseless").when((F.col("share") >= SAME) & (F.size("missing") == 0) & right, "verified").otherwise("semantic_variant")
    rows = asked.select(*by, "given").join(best.select(*by, "kind", "text_id", "reference", "share", "missing"), by, "left")
    right_one = F.when((status != "baseless") & ~right, F.col("reference"))
    return rows.select(*by, status.alias("status"), "kind", "text_id", "share", "missing", right_one.alias("right_reference"))
