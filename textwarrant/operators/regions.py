"""Stretches of a text that its marks, or words before it, say are quoted."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarrant.functions import arabic
from textwarrant.functions.text import TEXTS_AT_ONCE, let, normalize, token_pieces, with_norms, words

# The marks of a quotation, the surest first.
MARKS = [
    ("quran", "[﴾﴿](.*?)[﴾﴿]"),
    ("curly_brace", r"\{(.*?)\}"),
    ("guillemets", "«(.*?)»"),
    ("curly", "“(.*?)”"),
    ("straight", '"(.*?)"'),
    ("round", r"\((.*?)\)"),
    ("square", r"\[(.*?)\]"),
]
#: What one of these begins with.
OPENING = "﴾﴿{«“\"(["
# Words that name the speaker or the book, looked for among so many words before a mark.
SPEAKER = "تعالى وتعالى سبحانه وسبحانه جل وجل عز وعز وعلا".split()
CONTEXT = "التنزيل القران الايه الايات ايه كتابه محكم".split()
# Verbs of saying; names that are the speaker straight after such a verb only; other speakers and
# words in between; an honorific; and the pair whose second word belongs to the speaker's name.
SAID = "قال وقال فقال يقول ويقول قوله وقوله فيقول".split()
NAMES = "الله ربنا ربكم".split()
OTHER_SPEAKERS = "النبي رسول الرسول".split()
BETWEEN = "ايضا كذلك ثم".split()
HONORIFIC = "صلى الله عليه وسلم".split()
JOINED = ("رسول", "الله")
# What ends a clause, and what a claim is stripped of.
CLAUSE_END = "[.؟!؛،\\n]|[﴾﴿]|[«“\"(\\[]"
TRIMMED = " \t\r\n:.،؛؟!()[]«»“”\"﴾﴿-"
#: Tokens after a verb of saying among which the speaker has to be.
REACH = 3
LOOKBACK = 6
LEAST_WORDS = 3
LEAST_IN_BRACES = 5


class Lexicon(NamedTuple):
    """Normal forms of the words that announce a quotation."""

    said: Sequence[str]
    speaker: Sequence[str]
    names: Sequence[str]
    others: Sequence[str]
    between: Sequence[str]
    honorific: Sequence[str]
    joined: tuple[str, str]
    context: Sequence[str]
    clause_end: str = CLAUSE_END


ARABIC = Lexicon(SAID, SPEAKER, NAMES, OTHER_SPEAKERS, BETWEEN, HONORIFIC, JOINED, CONTEXT)


def trimmed(text: Column) -> Column:
    """A claim without the signs around it."""
    signs = re.escape(TRIMMED)
    return F.regexp_replace(text, f"^[{signs}]+|[{signs}]+$", "")


def tokens(text: Column, normal: Callable[[Column], Column]) -> Column:
    """array<struct<norm, start, end>>: the words of a text that have a normal form, with their places."""
    return _named(with_norms(token_pieces(text)), normal)


def _named(found: Column, normal: Callable[[Column], Column]) -> Column:
    form = lambda t: t["norm"] if normal is normalize else normal(t["text"])
    named = F.transform(found, lambda t: F.struct(form(t).alias("norm"), t["start"].alias("start"), t["end"].alias("end")))
    return F.filter(named, lambda t: t["norm"] != "")


def attributed_spans(text: Column, toks: Column, lexicon: Lexicon = ARABIC) -> Column:
    """array<struct<start, end>>: what follows words that name who said it, up to the end of the clause.

    A verb of saying opens one if among the next three words is a speaker, or
    a word that stands between, or straight after it a name. The names, honorifics and
    further speakers that follow are skipped. After a quotation the search goes on behind it; where
    nothing follows, from the next verb.
    """
    of = lambda listed: F.array(*[F.lit(w) for w in listed]).cast("array<string>")
    kind = "array<struct<start:int,end:int>>"

    def spans(ts: Column) -> Column:
        norms = F.transform(ts, lambda t: t["norm"])

        def skipped(ns: Column) -> Column:
            """1 for each word that belongs to the naming of a speaker."""
            size = len(lexicon.honorific)

            def flag(w: Column, i: Column, opens: Column) -> Column:
                honoured = F.lit(False)
                for back in range(size):
                    honoured = honoured | F.coalesce((i >= back) & F.get(opens, F.greatest(i - back, F.lit(0))), F.lit(False))
                second = (w == lexicon.joined[1]) & (i >= 1) & (F.get(ns, F.greatest(i - 1, F.lit(0))) == lexicon.joined[0])
                return (F.array_contains(of([*lexicon.speaker, *lexicon.others]), w) | second | honoured).cast("int")

            opens = F.transform(ns, lambda w, i: F.slice(ns, i + 1, F.lit(max(size, 1))) == of(lexicon.honorific))
            return let(opens, lambda o: F.transform(ns, lambda w, i: flag(w, i, o)))

        def found(ns: Column, skip: Column) -> Column:
            verbs = F.filter(F.transform(ns, lambda w, i: F.when(F.array_contains(of(lexicon.said), w), i)), lambda i: i.isNotNull())
            near = of([*lexicon.speaker, *lexicon.others, *lexicon.between])

            def step(state: Column, i: Column) -> Column:
                def opened(first: Column) -> Column:
                    start = F.get(ts, first)["start"]
                    stop = F.regexp_instr(F.substr(text, start + 1), F.lit(lexicon.clause_end))
                    end = F.when(stop > 0, start + stop - 1).otherwise(F.length(text))
                    return let(F.struct(start.alias("start"), end.alias("end")), lambda r: F.struct(r["end"].alias("at"), F.concat(state["spans"], F.array(r)).alias("spans")))

                next_ = F.sequence(i + 1, i + REACH)
                marker = F.get(F.filter(next_, lambda k: F.coalesce(F.array_contains(near, F.get(ns, k)), F.lit(False)) | ((k == i + 1) & F.coalesce(F.array_contains(of(lexicon.names), F.get(ns, k)), F.lit(False)))), F.lit(0))
                # the first word behind the marker that does not name the speaker
                open_ = let(marker, lambda m: F.when(m.isNotNull(), m + F.nullif(F.array_position(F.slice(skip, m + 2, F.greatest(F.size(skip) - m - 1, F.lit(0))), F.lit(0)), F.lit(0)).cast("int")))
                return F.when(F.get(ts, i)["start"] < state["at"], state).otherwise(let(open_, lambda first: F.when(first.isNull(), state).otherwise(opened(first))))

            begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))
            return F.aggregate(verbs, begin, step, lambda s: s["spans"])

        return let(norms, lambda ns: let(skipped(ns), lambda skip: found(ns, skip)))

    return let(toks, spans)


def quoted_regions(rows: DataFrame, lexicon: Lexicon = ARABIC, normal: Callable[[Column], Column] = arabic.normalize, text_col: str = "text") -> DataFrame:
    """Adds ``regions``: array<struct<start, end, text_start, text_end, kind, text, attributed>>: marked quotations and attributed ones, by their places.

    An attributed one of fewer than LEAST_WORDS words, or that meets a marked one, is none.
    """
    marked = _marked_regions(rows, text_col, lexicon, normal)
    part = lambda a, b: F.substr(F.col(text_col), a + 1, b - a)
    fields = ("start", "end", "text_start", "text_end", "kind", "text", "attributed")
    said = F.transform(
        attributed_spans(F.col(text_col), _named(F.col("_tokens"), normal), lexicon),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["start"].alias("text_start"), s["end"].alias("text_end"), F.lit("attributed").alias("kind"), part(s["start"], s["end"]).alias("text"), F.lit(True).alias("attributed")),
    )
    marked = marked.withColumn("_said", said)
    apart = lambda s: ~F.exists("regions", lambda r: (r["start"] < s["end"]) & (s["start"] < r["end"]))
    own = F.filter("_said", lambda s: apart(s) & (F.size(words(normal(s["text"]))) >= LEAST_WORDS))
    both = F.concat(F.transform("regions", lambda r: F.struct(*[r[c].alias(c) for c in fields])), own)
    none = F.filter("regions", lambda r: F.lit(False))
    both = F.when(F.col(text_col).isNull(), F.transform(none, lambda r: F.struct(*[r[c].alias(c) for c in fields]))).otherwise(F.array_sort(both))
    return marked.withColumn("regions", both).drop("_said", "_tokens")


def signs(lexicon: Lexicon = ARABIC) -> dict[str, str]:
    """RE2 patterns for the columns text and form, one of which is found wherever a text has a region.

    An opening mark in the text, or in its form a verb of saying with a name or speaker among the next words.
    White space that parts words for Python and not for Java counts as a mark, as words are then not those of the form.
    """
    listed = lambda words_: "(?:" + "|".join(re.escape(w) for w in words_ if w) + ")"
    found = {"text": f"[{re.escape(OPENING)}\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"}
    near = [*lexicon.speaker, *lexicon.others, *lexicon.between]
    after = [f"{listed(lexicon.names)}(?: |$)"] if any(lexicon.names) else []
    after += [f"(?:[^ ]+ ){{0,{REACH - 1}}}{listed(near)}(?: |$)"] if any(near) else []
    if any(lexicon.said) and after:
        found["form"] = f"(?:^| ){listed(lexicon.said)} (?:{'|'.join(after)})"
    return found


def _marked(text: Column) -> Column:
    """All that stands in marks, of every kind; regions of different kinds may overlap."""
    kinds = [(rank, kind, re.compile(pattern, re.S)) for rank, (kind, pattern) in enumerate(MARKS)]

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                some = texts.iloc[at : at + TEXTS_AT_ONCE]
                yield pd.Series([[(rank, *m.span(), *m.span(1), kind, m[1]) for rank, kind, find in kinds for m in find.finditer(t)] if t else [] for t in some], dtype=object)

    return F.pandas_udf(of, "array<struct<rank:int,start:int,end:int,text_start:int,text_end:int,kind:string,text:string>>")(text)


def marked_regions(rows: DataFrame, text_col: str = "text", lexicon: Lexicon = ARABIC, normal: Callable[[Column], Column] = arabic.normalize) -> DataFrame:
    """Adds ``regions``: array<struct<rank, start, end, text_start, text_end, kind, text, n_words, attributed>>, in order of their places.

    Regions of fewer than LEAST_WORDS words are none; of those that overlap the
    one with the surer mark stays, and of one kind the first. A region is
    attributed by its mark - braces only around a sentence - or by a word for
    the speaker just before it. A null or empty text has no regions.
    """
    return _marked_regions(rows, text_col, lexicon, normal).drop("_tokens")


def _marked_regions(rows: DataFrame, text_col: str, lexicon: Lexicon, normal: Callable[[Column], Column]) -> DataFrame:
    """:func:`marked_regions` with the texts' pieces and their norms as ``_tokens``, for which Python reads a text once."""
    said = F.array(*[F.lit(w) for w in [*lexicon.speaker, *lexicon.context]])

    def counted(r: Column) -> Column:
        return F.struct(*[r[c].alias(c) for c in ("rank", "start", "end", "text_start", "text_end", "kind", "text")], F.size(words(normal(r["text"]))).alias("n_words"))

    def apart(taken: Column, r: Column) -> Column:
        clash = F.exists(taken, lambda t: (t["start"] < r["end"]) & (r["start"] < t["end"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(r)))

    def told(r: Column) -> Column:
        before = F.filter("_tokens", lambda t: (t["end"] <= r["start"]) & (t["norm"] != ""))
        last = F.slice(before, F.greatest(F.size(before) - (LOOKBACK - 1), F.lit(1)), LOOKBACK)
        by_word = F.exists(last, lambda t: F.array_contains(said, normal(t["text"])))
        by_mark = (r["kind"] == "quran") | ((r["kind"] == "curly_brace") & (r["n_words"] >= LEAST_IN_BRACES))
        return F.struct(*[r[c].alias(c) for c in ("rank", "start", "end", "text_start", "text_end", "kind", "text", "n_words")], (by_mark | by_word).alias("attributed"))

    kind = "array<struct<rank:int,start:int,end:int,text_start:int,text_end:int,kind:string,text:string,n_words:int>>"
    held = rows.withColumns({"_marked": _marked(F.col(text_col)), "_tokens": with_norms(token_pieces(F.col(text_col)))})
    long_enough = F.filter(F.transform("_marked", counted), lambda r: r["n_words"] >= LEAST_WORDS)
    kept = F.aggregate(F.array_sort(long_enough), F.array().cast(kind), apart)
    by_place = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    return held.withColumn("regions", F.transform(F.array_sort(kept, by_place), told)).drop("_marked")
