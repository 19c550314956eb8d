"""Cleaning, trimming and scoring of texts as columns."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarrant.functions.text import TEXTS_AT_ONCE, let, words

# Marks over and under letters and the stretching sign; signs that turn the direction of writing.
MARKS = r"[\x{064B}-\x{065F}\x{0670}\x{0640}]"
DIRECTION = r"[\x{200E}\x{200F}]"
# Shapes of keys, in the order in which they are looked for.
SECRETS = r"sk-[A-Za-z0-9_-]{6,}|AIza[0-9A-Za-z_-]{16,}|AQ\.[0-9A-Za-z_-]{16,}"
# Letters written in more than one way.
LIGHT = ("إأآٱىة", "اااايه")
# Particles of one letter that are written as part of a word.
PARTICLES = "وفبل"
# What a grade is called, by the first pattern that its name holds, and what is said besides.
GRADES = {
    "mawdu|fabricat": "موضوع", "batil": "باطل", "very da": "ضعيف جدًا", "munkar": "منكر", "shadh": "شاذ", "hasan sahih": "حسن صحيح",
    "da[ie]i?f": "ضعيف", "sahih": "صحيح", "hasan": "حسن",
}
GRADE_NOTES = {"mauquf|muquf|mawquf": "موقوف", "maqtu": "مقطوع", "mursal": "مرسل", "mutawatir": "متواتر"}
GRADE_BOOKS = {"agreed upon|bukhari and muslim|bukhari.*muslim": "متفق عليه", "bukhari": "أصله في البخاري", "muslim": "أصله في مسلم"}


def one_line(text: Column) -> Column:
    """Without signs of direction; white space made single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, DIRECTION, ""), r"[ \t\r\n\f\x0B]+", " "))


def as_embedded(text: Column, most_words: int = 200, most_chars: int = 1500) -> Column:
    """What of a text is embedded: without marks, its first words and of these the first characters."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, MARKS, ""), r"[ \t\r\n\f\x0B]+", " "))
    return F.substring(F.array_join(F.slice(words(bare), 1, most_words), " "), 1, most_chars)


def unit(vector: Column, dims: int | None = None) -> Column:
    """The vector's first ``dims`` components, at length one; a zero vector stays."""
    cut = vector if dims is None else F.slice(vector, 1, dims)

    def of(v: Column) -> Column:
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        return let(length, lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))

    return let(cut, of)


def redact(message: Column) -> Column:
    """Keys in a message are never passed on."""
    return F.regexp_replace(message, SECRETS, "[redacted]")


def without_opening(text: Column, opens: Column, count: int) -> Column:
    """struct<text, short>: where ``opens``, without its first ``count`` words; a text of no more words stays and is told short."""
    held = words(text)
    short = opens & (F.size(held) <= count)
    cut = F.array_join(F.slice(held, count + 1, F.greatest(F.size(held) - count, F.lit(0))), " ")
    return F.struct(F.when(opens & ~short, cut).otherwise(text).alias("text"), short.alias("short"))


def argument_key(arguments: Mapping[str, Column], secret: Sequence[str] = ("api_key",)) -> Column:
    """A call's arguments as JSON in order of their names, without secret ones: the key of its remembered answer."""
    return F.to_json(F.struct(*[arguments[k].alias(k) for k in sorted(arguments) if k not in secret]), {"ignoreNullFields": "false"})


def grade_label(grade: Column) -> Column:
    """A transliterated grade in Arabic, with its notes; another one as it is, an empty one a dash."""
    low = F.lower(F.coalesce(grade, F.lit("")))

    def first(table: Mapping[str, str]) -> Column:
        found = F.lit(None).cast("string")
        for pattern, name in reversed(table.items()):
            found = F.when(low.rlike(pattern), F.lit(name)).otherwise(found)
        return found

    core = first(GRADES)
    head = F.when(low.rlike("isnaa?d|sanad"), F.concat(F.lit("إسناده "), core)).otherwise(core)
    head = F.when(low.rlike("lighairihi"), F.concat(head, F.lit(" لغيره"))).otherwise(head)
    notes = [F.when(low.rlike(p), F.lit(n)) for p, n in GRADE_NOTES.items()]
    other = F.trim(F.coalesce(grade, F.lit("")))
    return F.when(core.isNull(), F.when(other == "", "—").otherwise(other)).otherwise(F.concat_ws(" · ", head, *notes, first(GRADE_BOOKS)))


def layer_quality(text: Column, least_arabic: int = 80, least_latin: int = 40) -> Column:
    """struct<single, stray, trusted>: whether a page's text layer reads like text.

    Too many tokens of one character, or glyphs that belong to no text, tell a
    broken layer; so do too few letters.
    """
    tokens = F.filter(F.split(text, r"[ \t\r\n\f\x0B]+"), lambda w: w != "")
    letters = F.regexp_count(text, F.lit(r"[\x{0600}-\x{06FF}]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    stray = F.regexp_count(text, F.lit(r"[\x{0100}-\x{024F}\x{1E00}-\x{1EFF}\x{E000}-\x{F8FF}\x{FFFD}]")) / F.greatest(F.length(text), F.lit(1))
    single = let(tokens, lambda t: F.size(F.filter(t, lambda w: F.length(w) == 1)) / F.greatest(F.size(t), F.lit(1)))
    enough = (letters >= least_arabic) | (latin >= least_latin)
    return F.struct(single.alias("single"), stray.alias("stray"), (enough & (single < 0.35) & (stray < 0.01)).alias("trusted"))


def light_fold(text: Column) -> Column:
    """Lower case, without marks, letters of one kind alike, all else spaces."""
    bare = F.translate(F.regexp_replace(F.lower(text), MARKS, ""), *LIGHT)
    return F.regexp_replace(bare, r"[^\p{L}]", " ")


def wording_score(quote: Column, text: Column) -> Column:
    """The share of a quote's words, of two letters or more, that a text holds, with or without a joined particle."""
    return folded_score(light_fold(quote), light_fold(text))


def folded_score(quote: Column, text: Column) -> Column:
    """:func:`wording_score` of texts that are folded already.

    A null text holds no word. Spark looks a word up in an array from its beginning, which for two texts takes the product of their words.
    """

    def share(quote: str, held: set[str]) -> float:
        wanted = [w for w in quote.split(" ") if len(w) > 1]
        bare = lambda w: w[1:] if w[0] in PARTICLES else w.removeprefix("ال")
        return sum(w in held or bare(w) in held or "ال" + w in held for w in wanted) / len(wanted) if wanted else 0.0

    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for quotes, texts in batches:
            for at in range(0, len(quotes), TEXTS_AT_ONCE):
                pairs = zip(quotes.slice(at, TEXTS_AT_ONCE).to_pylist(), texts.slice(at, TEXTS_AT_ONCE).to_pylist(), strict=True)
                yield pa.array([share(q or "", set((t or "").split(" ")) - {""}) for q, t in pairs], pa.float64())

    return F.arrow_udf(of, "double")(quote, text)


def best_slice(held: Column, quote: Column) -> Column:
    """struct<at, hits>: where words of a quote best agree, place by place, with a stretch of as many words; the first of equals.

    Null where the words are no more than two longer than the quote, or where
    less than half agree: then the whole is meant.
    """

    def of(h: Column) -> Column:
        def slices(q: Column) -> Column:
            hits = lambda i: F.aggregate(F.transform(q, lambda w, j: (F.get(h, i + j) == w).cast("int")), F.lit(0), lambda s, x: s + x)
            places = F.transform(F.sequence(F.lit(0), F.size(h) - F.size(q)), lambda i: F.struct(hits(i).alias("hits"), (-i).alias("back")))
            best = F.when((F.size(q) > 0) & (F.size(h) > F.size(q) + 2), F.array_max(places))
            return let(best, lambda b: F.when(b["hits"] * 2 >= F.size(q), F.struct((-b["back"]).alias("at"), b["hits"].alias("hits"))))

        return let(quote, slices)

    return let(held, of)


def without_remarks(text: Column) -> Column:
    """Without remarks in brackets at the end and the white space around."""
    return F.trim(F.regexp_replace(text, r"(\s*[\[(][^\[\]()]*[\])])+\s*$", ""))


def citation(*parts: Column) -> Column:
    """The parts that are there and not empty, joined by commas."""
    return F.concat_ws(", ", *[F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts])
