"""Classifiers that read word lists; each is a column of its inputs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarrant.functions import arabic
from textwarrant.functions.text import let, words
from textwarrant.operators import lexicons as lex


def _any_of(forms: list[str]) -> str:
    return "|".join(re.escape(arabic.folded(f)).replace(r"\ ", " ") for f in forms)


def holds(normal: Column, listed: str) -> Column:
    """Whether a form begins a word of the normalised text, also after a clinging letter, and ends one."""
    return normal.rlike(f"(?:^| )(?:وب|ول|[وفبل])?(?:{_any_of(lex.forms(listed))})(?= |$)")


def assertion(text: Column) -> Column:
    """How a sentence states a ruling: consensus, hedged, definite or none."""

    def of(t: Column) -> Column:
        closing = t.rlike("(?:^| )سن[هة]$")
        ascribed = t.rlike(r"(?:^| )سن[هة] (?:مؤكد[هة] )?(?:عند|في مذهب|على قول)(?: |$)")
        ruling = holds(t, lex.RULING) | closing | ascribed
        return F.when(holds(t, lex.CONSENSUS), "consensus").when(~ruling, "none").when(holds(t, lex.HEDGE), "hedged").otherwise("definite")

    # "in the year 1400" is no ruling
    return let(F.trim(F.regexp_replace(arabic.normalize(text), r"(?:^|(?<= ))سن[هة] \d", " ")), of)


def agreement(text: Column) -> Column:
    """What a passage's wording says of scholars: agreement, disagreement, both or none."""

    def of(t: Column) -> Column:
        rest = F.regexp_replace(t, "(لا|بلا|لا نعلم|لا يعلم) خلاف", " ")
        agree, disagree = holds(t, lex.AGREE), holds(rest, lex.DISAGREE) | F.concat(F.lit(" "), rest, F.lit(" ")).contains(" خلاف ")
        return F.when(agree & disagree, "both").when(agree, "agreement").when(disagree, "disagreement").otherwise("none")

    return let(arabic.normalize(text), of)


def rulings(text: Column) -> Column:
    """The families of rulings that a text states, in order of first mention; a negated form hides its positive."""
    masked = F.concat(F.lit(" "), arabic.normalize(text), F.lit(" "))
    labels = list(lex.RULING_FAMILIES)
    for i, label in enumerate(labels):
        # a sign stands for what was read, so that later families don't read it again
        masked = F.regexp_replace(masked, f" [وفبل]?(?:{_any_of(lex.forms(lex.RULING_FAMILIES[label]))})", f" {chr(0xE000 + i)}")
    signs = F.regexp_extract_all(masked, F.lit(f"[{chr(0xE000)}-{chr(0xE000 + len(labels) - 1)}]"), F.lit(0))
    names = F.create_map(*[F.lit(x) for i, label in enumerate(labels) for x in (chr(0xE000 + i), label)])
    return F.transform(F.array_distinct(signs), lambda s: F.element_at(names, s))


def schools(text: Column) -> Column:
    def of(t: Column) -> Column:
        return F.filter(F.array(*[F.when(holds(t, f), F.lit(name)) for name, f in lex.SCHOOLS.items()]), lambda x: x.isNotNull())

    return let(arabic.normalize(text), of)


def positions(text: Column, most: int = 6) -> Column:
    """array<struct<schools, text, ruling>>: the first sentences of a passage that name a school."""
    sentences = F.transform(F.split(text, r"(?<=[.؛:])\s+"), lambda s: F.trim(s))
    named = F.transform(F.filter(sentences, lambda s: F.length(s) >= 15), lambda s: F.struct(schools(s).alias("schools"), F.substring(s, 1, 600).alias("text"), F.get(rulings(s), F.lit(0)).alias("ruling")))
    return F.slice(F.filter(named, lambda x: F.size(x["schools"]) > 0), 1, most)


def direction(claim: Column, reported: Column) -> Column:
    """same, different, or null where either side is not one ruling; ``reported`` is an array of rulings."""
    pairs = F.create_map(*[x for k, v in lex.SAME_RULING.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])

    def of(want: Column) -> Column:
        one, got = F.get(want, F.lit(0)), F.get(reported, F.lit(0))
        same = (got == one) | F.coalesce(F.array_contains(F.try_element_at(pairs, one), got), F.lit(False))
        return F.when((F.size(want) == 1) & (F.size(F.array_distinct(reported)) == 1), F.when(same, "same").otherwise("different"))

    return let(rulings(claim), of)


def ruling_status(assertion_: Column, marks: Column, direction_: Column) -> Column:
    """The verdict on a stated ruling, from the passages shown (``marks``: the agreement of each)."""
    has = lambda m: F.array_contains(marks, m)
    return (
        F.when(F.size(marks) == 0, "not_found")
        .when(has("disagreement"), F.when(assertion_ == "consensus", "consensus_claim_disputed").when(assertion_ == "definite", "stated_as_certain_disputed").otherwise("disagreement_acknowledged"))
        .when(has("both"), F.when(assertion_ == "consensus", "consensus_claim_disputed").when(assertion_ != "hedged", "partly_disputed").otherwise("disagreement_acknowledged"))
        .when(has("agreement"), F.when(direction_ == "different", "agreement_differs").when(direction_ == "same", "agreement_reported").otherwise("found_no_marker"))
        .otherwise("found_no_marker")
    )


def strength(classification: Column, book: Column, grades: Column) -> Column:
    """quran, sahihayn, sahih, hasan, daif, disputed or ungraded, of an array of grades; null for other texts."""
    kind = lambda g: F.when(g.contains("sahih"), "sahih").when(g.contains("hasan"), "hasan").when(g.rlike("|".join(lex.WEAK_GRADES)), "daif")

    def of(kinds: Column) -> Column:
        has = lambda k: F.coalesce(F.array_contains(kinds, k), F.lit(False))
        return F.when(has("daif") & (has("sahih") | has("hasan")), "disputed").when(has("sahih"), "sahih").when(has("hasan"), "hasan").when(has("daif"), "daif").otherwise("ungraded")

    kinds = F.filter(F.transform(F.coalesce(grades, F.array().cast("array<string>")), lambda g: kind(F.lower(g))), lambda x: x.isNotNull())
    return F.when(classification == "quran", "quran").when(classification != "hadith", None).when(book.isin(lex.TWO_SAHIHS), "sahihayn").otherwise(let(kinds, of))


def level(classification: Column, book: Column) -> Column:
    return F.when(classification == "quran", 1).when(classification == "hadith", F.when(book.isin(lex.TWO_SAHIHS), 2).otherwise(3))


def evidence_weight(items: Column) -> Column:
    """Of array<struct<strength, covers_all>>: what addresses only part of a claim counts half; unknown is not part."""
    weights = F.create_map(*[F.lit(x) for pair in lex.WEIGHTS.items() for x in pair])
    one = lambda i: F.coalesce(F.try_element_at(weights, i["strength"]), F.lit(1.0)) * F.when(~i["covers_all"], 0.5).otherwise(1.0)
    return F.aggregate(items, F.lit(0.0), lambda s, i: s + one(i))


def outcome(supporting: Column, contradicting: Column) -> Column:
    strong = lambda items: F.exists(items, lambda i: F.coalesce(i["strength"].isin(lex.STRONG), F.lit(False)))
    s, c = F.size(supporting) > 0, F.size(contradicting) > 0
    return F.when(s & c, "mixed").when(s, F.when(strong(supporting), "supported").otherwise("supported_weakly")).when(c & strong(contradicting), "contradicted").otherwise("no_clear_evidence")


def segment_level(status: Column, has_source: Column, strength_: Column) -> Column:
    return F.when((status == "baseless") | ~has_source, None).when(strength_.isin(lex.SETTLED), "أ").when(strength_ == "hasan", "ب").otherwise("ج")


def segment_verdict(status: Column, classification: Column, has_source: Column, strength_: Column) -> Column:
    """bad, fix, khl or ok, for a quoted text."""
    graded = F.when(strength_.isin("sahihayn", "sahih", "hasan"), "ok").when(strength_ == "daif", "bad").when(strength_ == "disputed", "khl").otherwise("fix")
    return F.when((status == "verified") & has_source, F.when(classification == "quran", "ok").otherwise(graded)).when((status == "semantic_variant") & has_source, "fix").otherwise("bad")


def claim_verdict(outcome_: Column, ruling_status_: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in lex.RULING_VERDICTS.items() for x in pair])
    by_outcome = F.when(outcome_.isin("supported_in_part", "supported_weakly"), "fix").when(outcome_ == "contradicted", "bad").when(outcome_ == "mixed", "khl").when(outcome_ == "refer_to_scholar", "ref").otherwise("neu")
    return F.coalesce(F.try_element_at(table, ruling_status_), by_outcome)


def worst(verdicts: Column) -> Column:
    """The gravest of an array of verdicts."""
    ranks = F.array(*[F.lit(v) for v in lex.VERDICT_RANK])
    return F.array_min(F.transform(verdicts, lambda v: F.struct(F.array_position(ranks, v).alias("at"), v.alias("v"))))["v"]


def grade_category(grade: Column) -> Column:
    bare = F.regexp_replace(grade, "[ً-ٰٟـ]", "")
    out = F.lit("other")
    for name, listed in reversed(lex.GRADE_CATEGORIES.items()):
        out = F.when(bare.rlike("|".join(lex.forms(listed))), name).otherwise(out)
    return out


def has_claim_cue(text: Column) -> Column:
    """A hard cue, or a verb of saying with a word for the source."""
    overlap = lambda w, listed: F.arrays_overlap(w, F.array(*[F.lit(x) for x in listed]))
    return let(words(arabic.normalize(text)), lambda w: overlap(w, lex.HARD_CUES) | (overlap(w, lex.SAID_VERBS) & overlap(w, lex.SOURCE_WORDS)))


def genre(text: Column) -> Column:
    """khutbah, article, post, lesson, question or text, by cues; a cue near the start counts double."""
    order = ["khutbah", "post", "question", "lesson", "article"]

    def of(t: Column) -> Column:
        scores = []
        for kind in order:
            score = F.lit(0)
            for cue in lex.GENRE_CUES[kind]:
                pattern = "(?iu)" + cue.replace(r"\b", r"(?U)\b")
                at = F.regexp_instr(t, F.lit(pattern))
                early = (at <= 120) | F.substring(t, 1, 600).rlike(pattern) if kind == "khutbah" else at <= 120
                score = score + F.when(at == 0, 0).when(early, 2).otherwise(1)
            if kind == "question":
                score = score + F.when(F.trim(t).rlike(r"[?؟]$") & (n_words(t) < 80), 2).otherwise(0)
            scores.append(score)
        return let(F.array(*scores), lambda s: pick(t, s))

    def n_words(t: Column) -> Column:
        return F.regexp_count(t, F.lit(r"\S+"))

    def pick(t: Column, s: Column) -> Column:
        best = F.array_max(s)
        kinds = F.array(*[F.lit(k) for k in order])
        return F.when(best == 0, F.when(n_words(t) > 220, "article").otherwise("text")).when(best < 2, "text").otherwise(F.element_at(kinds, F.array_position(s, best).cast("int")))

    return let(F.regexp_replace(text, "[ً-ٰٟـ]", ""), of)


def language(text: Column) -> Column:
    """ar, ur, en, fr, id, tr, es or other: by script, then by two or more common words."""
    arabic_, latin = F.regexp_count(text, F.lit("[؀-ۿ]")), F.regexp_count(text, F.lit("[A-Za-zÀ-ɏ]"))

    def hits(w: Column, listed: str) -> Column:
        common = F.array(*[F.lit(s) for s in listed.split()])
        return F.size(F.filter(w, lambda x: F.array_contains(common, x)))

    def of(w: Column) -> Column:
        names = F.array(*[F.lit(name) for name in lex.LANGUAGE_WORDS])
        counts = F.array(*[hits(w, listed) for listed in lex.LANGUAGE_WORDS.values()])
        return let(counts, lambda c: F.when(F.array_max(c) < 2, "other").otherwise(F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))))

    found = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    return F.when(arabic_ >= latin, F.when(F.regexp_count(text, F.lit(f"[{lex.URDU_LETTERS}]")) >= 3, "ur").otherwise("ar")).otherwise(let(found, of))
