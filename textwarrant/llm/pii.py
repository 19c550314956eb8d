"""Personal data by weak supervision: labelers vote on spans, their reliabilities are estimated, a span classifier is trained."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarrant.tables import materialize

KINDS = ("email", "ip", "card", "phone")

#: Matches of these are the base. No form backs off over a run of characters, as
#: texts may hold runs of any length: possessive repeats, and starts at the
#: beginning of a run or where the last match ended. Chains of digits are
#: matched as a whole where they have 12 to 19, and not at all otherwise.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Forms that the base misses: spelled separators, numbers beside other numbers, phones without a plus.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?: ?[\[({] ?(?:at|AT|@) ?[\])}] ?| (?:at|AT) |@)[A-Za-z0-9-]++(?:(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])(?<![0-9][.])[0-9]{1,3}+(?:(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) )[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}|[0-9]{12,19}+)(?![0-9])",
    "phone": r"(?<![0-9+])(?:(?:\+|00)[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])|(?<![0-9.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9.-]?[0-9])",
}
#: Fixed values of the gazetteers: endings of hosts, first digits of card issuers, calling codes.
HOST_ENDINGS = "com org net edu gov mil int info biz io de fr es en uk eu us ca au nl be ch at it pt br mx ar jp cn in ru pl se no dk fi"
CARD_STARTS = "4 51 52 53 54 55 22 23 24 25 26 27 34 37 60 65 35 36 30 38 62 50 56 57 58 67"
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 355 356 357 358 359 380 420 421"
#: Words that speak for a kind, or against any, where they stand shortly before a span.
CUES = {
    "email": "mail email e-mail contact courriel correo write",
    "ip": "ip host server addr address dirección adresse",
    "card": "card visa mastercard amex carte karte kreditkarte tarjeta",
    "phone": "tel phone call fax mobile telefon téléphone teléfono appelez anrufen llame",
}
CONTRARY = "version release isbn issn doi order invoice serial build chapter section rfc license"
#: Code points before a span in which its cue may stand.
CONTEXT = 24

LABELERS = ("shape", "valid", "base", "gazetteer", "context", "edges")
#: Rounds of expectation and maximisation, where they begin, and what is counted besides what is seen (votes for, votes in all).
ROUNDS = 25
START_PRIOR, START_YES, START_NO = 0.5, 0.8, 0.3
SEEN_YES, SEEN_NO = (4.0, 5.0), (1.0, 4.0)
#: Matches whose lengths are summed together.
RUN = 256


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _before(values: Column, join: Callable[[Column, Column], Column], zero: int) -> Column:
    """All values before each, joined: those of runs first, so that no array grows by one element over all matches."""

    def running(part: Column) -> Column:
        none = F.struct(F.lit(zero).alias("t"), F.array().cast("array<int>").alias("s"))
        return F.aggregate(part, none, lambda acc, x: F.struct(join(acc["t"], x).alias("t"), F.concat(acc["s"], F.array(acc["t"])).alias("s")), lambda acc: acc["s"])

    def placed(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(zero), join))
        return F.flatten(F.zip_with(parts, running(totals), lambda p, t: F.transform(running(p), lambda x: join(x, t))))

    def runs(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / RUN).cast("int")), lambda b: F.slice(all_, b * RUN + 1, F.lit(RUN)))

    return _let(values, lambda all_: _let(runs(all_), placed))


def apart(spans: Column, others: Column) -> Column:
    """The spans that meet none of the others; either's own don't overlap, and all are in order."""
    end = lambda s: s["start"] + F.length(s["m"])
    tagged = lambda a, own: F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), end(s).alias("end"), s.alias("s")))
    far = (1 << 31) - 1

    def kept(all_: Column) -> Column:
        reached = _before(F.transform(all_, lambda x: F.when(x["own"], 0).otherwise(x["end"])), lambda a, b: F.greatest(a, b), 0)
        ahead = F.reverse(_before(F.reverse(F.transform(all_, lambda x: F.when(x["own"], far).otherwise(x["start"]))), lambda a, b: F.least(a, b), far))
        free = lambda r, n: F.filter(all_, lambda x, i: x["own"] & (F.get(r, i) <= x["start"]) & (F.get(n, i) >= x["end"]))
        return F.transform(_let(reached, lambda r: _let(ahead, lambda n: free(r, n))), lambda x: x["s"])

    # ties: the other comes first
    merged = lambda own: _let(F.array_sort(F.concat(tagged(own, True), tagged(others, False))), kept)
    return _let(spans, lambda own: F.when((F.size(own) > 0) & (F.size(others) > 0), merged(own)).otherwise(own))


def matches(text: Column, pattern: str) -> Column:
    """Each match's string, start (code points), what stands before it since the last match, and the code point after it."""

    def placed(pieces: Column, found: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(pieces, i)))

        def row(m: Column, i: Column, start: Column) -> Column:
            gap = F.get(pieces, i)
            return F.struct(m.alias("m"), (start + F.length(gap)).alias("start"), F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(1)).alias("after"))

        return _let(_before(sizes, lambda a, b: a + b, 0), lambda starts: F.transform(found, lambda m, i: row(m, i, F.get(starts, i))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.filter(_let(F.lit(""), lambda e: F.array(F.struct(e.alias("m"), F.lit(0).alias("start"), e.alias("before"), e.alias("after")))), lambda _: F.lit(False))
    return F.coalesce(_let(found, lambda f: F.when(F.size(f) > 0, _let(F.split(text, pattern, -1), lambda p: placed(p, f)))), empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of its last one."""

    def worth(i: Column) -> Column:
        x = F.ascii(F.substr(digits, i, F.lit(1))) - 48
        return F.when((F.length(digits) - i) % 2 == 0, x).when(x > 4, x * 2 - 9).otherwise(x * 2)

    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    return F.aggregate(places, F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """What a match of the base has to fulfil besides its form."""
    octet = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    if kind == "ip":
        return F.rlike(m, F.lit(rf"^{octet}(?:\.{octet}){{3}}$"))
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _any_of(words: str) -> str:
    return "|".join(words.split())


def _plain(m: Column) -> Column:
    """A span whose spelled separators are written as signs."""
    dots = F.regexp_replace(m, r" ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) ", ".")
    return F.regexp_replace(dots, r" ?[\[({] ?(?:at|AT|@) ?[\])}] ?| (?:at|AT) ", "@")


def votes(kind: str, span: Column, is_base: bool) -> Column:
    """One sign for each labeler: 1 for, 0 against, - for no vote."""
    m, before, after = span["m"], span["before"], span["after"]
    plain, digits = _plain(m), _digits(m)
    said = lambda yes: F.when(yes, "1").otherwise("0")
    if kind == "email":
        shape = said(F.rlike(m, F.lit(r"@|[\[({] ?(?:at|AT)| (?:dot|DOT) ")))
        valid = said(F.rlike(plain, F.lit(r"^[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,24}$")))
        gazetteer = said(F.rlike(plain, F.lit(rf"(?i)\.(?:{_any_of(HOST_ENDINGS)})$")))
        # words that only may be spelled signs need a host that there can be
        valid = F.when(F.rlike(m, F.lit(" (?:at|AT) ")), F.least(valid, gazetteer)).otherwise(valid)
    elif kind == "ip":
        shape = F.when(F.rlike(m, F.lit(r"^[0-9.]+$")), "1").otherwise("-")
        valid = said(passes(kind, plain))
        gazetteer = F.when(F.rlike(plain, F.lit(r"^(?:0|255)\.")), "0").otherwise("-")
    elif kind == "card":
        shape = said(F.rlike(m, F.lit(r"^(?:[0-9]+|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$")))
        valid = said(F.length(digits).between(12, 19) & luhn(digits))
        gazetteer = said(F.rlike(digits, F.lit(rf"^(?:{_any_of(CARD_STARTS)})")))
    else:
        shape = said(F.rlike(m, F.lit(r"^(?:\+|00)[0-9]{1,3}[ .-]?[(0-9]|^\([0-9]{3}\)")))
        valid = said(F.length(digits).between(9, 15))
        gazetteer = F.when(~F.rlike(m, F.lit(r"^(?:\+|00)")), "-").otherwise(said(F.rlike(digits, F.lit(rf"^(?:00)?(?:{_any_of(CALLING_CODES)})"))))
    cue = lambda words: F.lit(rf"(?iu)(?:^|[^\p{{L}}])(?:{_any_of(words)})(?:[^\p{{L}}]|$)")
    context = F.when(F.rlike(before, cue(CONTRARY)), "0").when(F.rlike(before, cue(CUES[kind])), "1").otherwise("-")
    touched = F.rlike(before, F.lit(r"[\p{L}\p{N}_=/#]$")) | F.rlike(after, F.lit(r"^[\p{L}\p{N}_=/@]"))
    return F.concat(shape, valid, F.lit("1" if is_base else "-"), gazetteer, context, F.when(touched, "0").otherwise("1"))


def features(span: Column) -> Column:
    """What the classifier looks at, as strings of few values each: separators, length, neighbours, digits."""
    m = span["m"]
    signs = F.concat(*[F.when(F.contains(m, F.lit(c)), c).otherwise("") for c in "@+(-. ["])
    kind_of = lambda c: F.when(c == "", "none").when(F.rlike(c, F.lit(r"[\p{L}]")), "letter").when(F.rlike(c, F.lit(r"[\p{N}]")), "digit").when(F.rlike(c, F.lit(r"\s")), "space").when(F.rlike(c, F.lit("[=_/\"#@]")), "sign").otherwise("other")
    length = F.least(F.floor(F.log2(F.length(m))), F.lit(8)).cast("string")
    digits = F.least(F.length(_digits(m)), F.lit(20)).cast("string")
    return F.array(F.concat(F.lit("s"), signs), F.concat(F.lit("l"), length), F.concat(F.lit("b"), kind_of(F.right(span["before"], F.lit(1)))), F.concat(F.lit("a"), kind_of(span["after"])), F.concat(F.lit("d"), digits))


def candidates(text: Column) -> Column:
    """Every span that labelers vote on: kind (number), start, end, base, votes and features.

    The base's own spans, and those of the loose forms that meet none of the base's of their kind.
    """

    def of_kind(number: int, kind: str) -> Column:
        def described(span: Column, is_base: bool) -> Column:
            start = span["start"].cast("long")
            return F.struct(F.lit(number).alias("kind"), start.alias("start"), (start + F.length(span["m"])).alias("end"), F.lit(is_base).alias("base"), votes(kind, span, is_base).alias("votes"), features(span).alias("features"))

        def added(base: Column) -> Column:
            loose = apart(matches(text, LOOSE[kind]), base)
            return F.concat(F.transform(base, lambda s: described(s, True)), F.transform(loose, lambda s: described(s, False)))

        return _let(F.filter(matches(text, BASE[kind]), lambda s: passes(kind, s["m"])), added)

    return F.concat(*[of_kind(i, kind) for i, kind in enumerate(KINDS)])


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, prior, yes, no) by expectation and maximisation over counts (kind, votes, n).

    ``prior`` is the share of true spans, ``yes`` and ``no`` each labeler's
    chance to vote for a true and for a false one. There are 3 ** labelers
    patterns of votes at most, so a kind's counts are one short array, which a
    fold goes over once a round.
    """
    of_kind = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("seen"))
    each = F.array(*[F.lit(i) for i in range(1, len(LABELERS) + 1)])
    fill = lambda x: F.transform(each, lambda _: F.lit(x))
    begin = F.struct(F.lit(START_PRIOR).alias("prior"), fill(START_YES).alias("yes"), fill(START_NO).alias("no"))

    def weighed(theta: Column) -> Column:
        def row(p: Column) -> Column:
            chance = _chance(p["votes"], theta["prior"], lambda i: F.get(theta["yes"], i), lambda i: F.get(theta["no"], i))
            return _let(chance, lambda c: F.struct(p["votes"].alias("votes"), (p["n"] * c).alias("true"), (p["n"] * (1.0 - c)).alias("false")))

        return F.transform("seen", row)

    def renewed(rows: Column) -> Column:
        total = lambda which, keep: F.aggregate(F.filter(rows, keep), F.lit(0.0), lambda a, r: a + r[which])
        vote = lambda r, i: F.substr(r["votes"], i, F.lit(1))

        def rate(which: str, seen: tuple[float, float]) -> Column:
            return F.transform(each, lambda i: (total(which, lambda r: vote(r, i) == "1") + seen[0]) / (total(which, lambda r: vote(r, i) != "-") + seen[1]))

        true, false = total("true", lambda _: F.lit(True)), total("false", lambda _: F.lit(True))
        return F.struct(((true + 1.0) / (true + false + 2.0)).alias("prior"), rate("true", SEEN_YES).alias("yes"), rate("false", SEEN_NO).alias("no"))

    theta = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, lambda t, _: _let(weighed(t), renewed))
    return of_kind.select("kind", theta.alias("t")).select("kind", "t.*")


def _chance(vote: Column, prior: Column, yes: Callable[[Column], Column], no: Callable[[Column], Column]) -> Column:
    """That a span with these votes is a true one, labelers taken as independent."""
    odds = F.ln(prior / (1.0 - prior))
    for i in range(len(LABELERS)):
        y, n, sign = yes(F.lit(i)), no(F.lit(i)), F.substr(vote, F.lit(i + 1), F.lit(1))
        odds = odds + F.when(sign == "1", F.ln(y / n)).when(sign == "0", F.ln((1.0 - y) / (1.0 - n))).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-odds))


def _literal(model: dict[str, float]) -> Column:
    return F.from_json(F.lit(json.dumps(model)), "map<string,double>")


def find(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Each row's ``keep`` columns and pii_spans: array of (kind, start, end, base, chance) in order of start, then kind.

    Regular expressions propose spans: the base, which always stays, and looser
    forms. Six labelers vote on each: its shape, a check of its value, the base
    itself, gazetteers, words before it and its neighbours. Expectation and
    maximisation estimate, over the votes on all spans, how reliable each
    labeler is; the chances that follow train a naive Bayes classifier over the
    spans' features, which decides about the looser spans. One that the value
    check votes against is never added. Texts are read once, no text is
    shuffled, and what the driver gets is the model: four kinds, six labelers
    and some hundred feature values.

    Starts and ends are code points, the end exclusive. A null or empty text has
    no spans; repeated rows get the same ones; an empty table gives an empty
    one. A text of any length is searched whole, in time that grows with it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    proposed = materialize(docs.select(F.struct(*keep).alias("row"), candidates(text).alias("spans")), "pii-spans")
    each = proposed.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    theta = reliabilities(each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"))).collect()
    rate = {f"{r.kind}{which}{i}": x for r in theta for which, values in (("y", r.yes), ("n", r.no)) for i, x in enumerate(values)}
    rate |= {f"{r.kind}p": r.prior for r in theta}
    held = _literal(rate)

    def chance(kind: Column, vote: Column) -> Column:
        of = lambda which: lambda i: F.element_at(held, F.concat(kind.cast("string"), F.lit(which), i.cast("string")))
        return _chance(vote, F.element_at(held, F.concat(kind.cast("string"), F.lit("p"))), of("y"), of("n"))

    valued = each.select("kind", "votes", F.explode("features").alias("feature"))
    counts = valued.groupBy("kind", "votes", "feature").agg(F.count(F.lit(1)).alias("n")).withColumn("c", chance(F.col("kind"), F.col("votes")))
    learned = counts.groupBy("kind", "feature").agg(F.sum(F.col("n") * F.col("c")).alias("true"), F.sum(F.col("n") * (1 - F.col("c"))).alias("false")).collect()
    weight: dict[str, float] = {}
    for number in {r.kind for r in learned}:
        own = [r for r in learned if r.kind == number]
        true, false = (sum(r[c] for r in own if r.feature[0] == "l") for c in ("true", "false"))
        weight[f"{number}"] = math.log((true + 1) / (false + 1))
        for first in {r.feature[0] for r in own}:
            values = [r for r in own if r.feature[0] == first]
            for r in values:
                # a class that has seen little takes the share of both
                share = (r.true + r.false) / (true + false)
                weight[f"{number}{r.feature}"] = math.log((r.true + share) / (true + 1)) - math.log((r.false + share) / (false + 1))
    weights = _literal(weight)

    def scored(s: Column) -> Column:
        number = s["kind"].cast("string")
        odds = F.aggregate(s["features"], F.element_at(weights, number), lambda a, f: a + F.coalesce(F.element_at(weights, F.concat(number, f)), F.lit(0.0)))
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"), (F.substr(s["votes"], F.lit(2), F.lit(1)) != "0").alias("valid"), (1.0 / (1.0 + F.exp(-odds))).alias("chance"))

    chosen = F.filter(F.transform("spans", scored), lambda s: s["base"] | (s["valid"] & (s["chance"] >= 0.5)))
    named = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(F.array_sort(chosen), lambda s: F.struct(F.get(named, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["chance"].alias("chance")))
    return proposed.select("row.*", spans.alias("pii_spans"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap the first, with the others' rest left out."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substr(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        new = F.when(s["start"] >= acc["at"], F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]")))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["parts"], new).alias("parts"))

    return F.aggregate(spans, begin, cut, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["at"].cast("int") + 1)))
