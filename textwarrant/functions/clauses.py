"""Clauses of sentences, what a claim must have, and rewritten claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarrant.functions.text import let, normalize, words

# Signs that end a clause, and words that deny.
CLAUSE_END = "[،؛:,;]"
NEGATIONS = "لا لم لن ليس ليست غير ما بدون no not never".split()
# Leading letters that cling to a word.
CLITICS = "وف"


def clause_pieces(sentence: Column, least_words: int = 3) -> Column:
    """array<string>: the clauses of a sentence that have enough words, where it has more than one; trimmed."""
    parts = F.transform(F.split(sentence, CLAUSE_END), lambda p: F.trim(p))
    long_enough = F.filter(parts, lambda p: F.size(words(normalize(p))) >= least_words)
    return F.when(F.size(parts) > 1, long_enough).otherwise(F.array().cast("array<string>"))


def without_lead(sentence: Column, leads: str, least_words: int = 2) -> Column:
    """Without an opening that ``leads`` (a pattern) tells, where enough words are left."""
    rest = F.regexp_replace(sentence, f"^(?:{leads})\\s*", "")
    return F.when(F.size(words(normalize(rest))) >= least_words, rest).otherwise(sentence)


def after_last(sentence: Column, frame: str, least_words: int = 2) -> Column:
    """What follows the last of the words that frame a statement, where enough words do."""
    rest = F.regexp_replace(sentence, f"^.*(?:^|\\s){frame}\\s+", "")
    return F.when(F.size(words(normalize(rest))) >= least_words, rest).otherwise(sentence)


def only_of(words_: Column, listed: Sequence[str], most_others: int = 1) -> Column:
    """Whether words say hardly more than the listed ones do, as those that introduce a quotation."""
    known = F.array(*[F.lit(w) for w in listed])
    return F.size(F.filter(words_, lambda w: ~F.array_contains(known, w))) <= most_others


def has_subject(words_: Column, vague: Sequence[str]) -> Column:
    known = F.array(*[F.lit(w) for w in vague])
    return F.exists(words_, lambda w: ~F.array_contains(known, w))


def core(word: Column) -> Column:
    """A word without a leading letter that clings to it."""
    return F.when(F.length(word) > 3, F.regexp_replace(word, f"^[{CLITICS}]", "")).otherwise(word)


def rewrite_span(sentence: Column, claim: Column) -> Column:
    """struct<first, last>: the places of a rewritten claim's first and last word in its sentence (arrays of words); null if it adds a word, changes the order or drops all negations.

    A fold over the claim's words that carries the places.
    """
    denies = lambda w: F.exists(w, lambda x: F.array_contains(F.array(*[F.lit(n) for n in NEGATIONS]), x))

    def placed(held: Column) -> Column:
        def of(wanted: Column) -> Column:
            ahead = lambda s, w: F.array_position(F.slice(held, s["last"] + 1, F.greatest(F.size(held) - s["last"], F.lit(0))), w).cast("int")
            begin = F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"))

            def step(s: Column, w: Column) -> Column:
                to = lambda at: F.when((s["last"] < 0) | (at == 0), F.struct(s["first"].alias("first"), F.lit(-1).alias("last"))).otherwise(
                    F.struct(F.when(s["first"] == 0, s["last"] + at).otherwise(s["first"]).alias("first"), (s["last"] + at).alias("last"))
                )
                return let(F.when(s["last"] < 0, F.lit(0)).otherwise(ahead(s, w)), to)

            places = F.aggregate(wanted, begin, step)
            fine = (F.size(wanted) > 0) & ~(denies(held) & ~denies(wanted))
            return let(places, lambda p: F.when(fine & (p["last"] > 0), F.struct((p["first"] - 1).alias("first"), (p["last"] - 1).alias("last"))))

        return let(F.transform(claim, core), of)

    return let(F.transform(sentence, core), placed)


# Letters whose seat tells a vowel, and the short vowels.
SEATED = "أإ"
LETTER_AND_MARKS = r"\p{L}[\x{064B}-\x{0650}]*"


def marks_conflict(a: Column, b: Column) -> Column:
    """Whether two readings (arrays of words as written, as many) differ in a mark or a seat that both write.

    Letters meet by their places in words of as many letters; a place where one side
    has no mark says nothing.
    """
    units = lambda w: F.regexp_extract_all(w, F.lit(LETTER_AND_MARKS), F.lit(0))
    marks = lambda u: F.array_sort(F.array_distinct(F.split(F.substring(u, 2, 16), "")))

    def unlike(x: Column, y: Column) -> Column:
        seats = F.substring(x, 1, 1) != F.substring(y, 1, 1)
        seated = F.lit(SEATED).contains(F.substring(x, 1, 1)) & F.lit(SEATED).contains(F.substring(y, 1, 1))
        return (seats & seated) | ((F.length(x) > 1) & (F.length(y) > 1) & (marks(x) != marks(y)))

    def words_differ(x: Column, y: Column) -> Column:
        return let(units(x), lambda u: let(units(y), lambda v: (F.size(u) == F.size(v)) & F.exists(F.zip_with(u, v, unlike), lambda d: F.coalesce(d, F.lit(False)))))

    return (F.size(a) == F.size(b)) & F.exists(F.zip_with(a, b, words_differ), lambda d: d)
