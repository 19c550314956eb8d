"""What a corpus says about a text: quoted, altered, built from quoted parts, or none of it."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarrant.functions import fuzzy
from textwarrant.functions.clauses import marks_conflict
from textwarrant.functions.text import let, normalize, runs, words
from textwarrant.operators import entries as held
from textwarrant.operators import match, regions
from textwarrant.operators.meeting import alike_in_length_and_words, estimated, near_any, runs_met
from textwarrant.tables import materialize


class Rules(NamedTuple):
    """How texts are read, and from where on what is found counts."""

    #: A text's form is the forms of its words, joined by single spaces.
    normal: held.Normal = normalize
    #: A form that keeps letters which ``normal`` makes alike; None where there are none.
    strict: held.Normal | None = None
    quotas: Mapping[str, int] = {"verse": 20, "window": 10, "hadith": 10}
    gate: tuple[float, float] = held.GATE
    strict_gate: tuple[float, float] = held.STRICT_GATE
    #: Kinds whose every mark and letter counts, and the one whose phrases have to be distinctive.
    exact_kinds: tuple[str, ...] = ("verse", "window")
    gated: str = "hadith"
    variant: float = 0.60
    least_words: int = 3
    run_words: int = 4
    #: A sentence of more words is taken for prose that may hold quotations; one that runs cover so far is a quotation itself.
    long_sentence: int = 12
    whole_from: float = 0.6
    lexicon: regions.Lexicon = regions.ARABIC


class Corpus:
    """Entries (see ``entries.spelled``) and the weights of their words, each written once; weights when they are first asked for."""

    def __init__(self, entries: DataFrame) -> None:
        self.entries = entries
        self._idf, self.sizes = held.word_weights(entries)

    @cached_property
    def idf(self) -> DataFrame:
        return materialize(self._idf, "corpus-idf")


def corpus(entries: DataFrame) -> Corpus:
    return Corpus(materialize(entries, "corpus-entries"))


def as_written(text: Column, normal: held.Normal) -> Column:
    """array<struct<raw, norm>>: the words of a text as written that have a normal form."""
    raw = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.filter(F.transform(raw, lambda w: F.struct(w.alias("raw"), normal(w).alias("norm"))), lambda w: w["norm"] != "")


def first_window_conflicts(claim: Column, source: Column) -> Column:
    """Whether the first place in ``source`` where the claim's words stand has other marks; both as ``as_written`` has them.

    False where the words stand nowhere, and where marks agree at the first such place.
    """

    def aligned(c: Column, s: Column) -> Column:
        joined = lambda w: F.concat(F.lit(" "), F.array_join(F.transform(w, lambda x: x["norm"]), " "), F.lit(" "))
        ahead = F.call_function("substring_index", joined(s), joined(c), F.lit(1))
        # the needle's leading space belongs to the word before
        at = F.size(words(ahead))
        raw = lambda w: F.transform(w, lambda x: x["raw"])
        return F.when(F.contains(joined(s), joined(c)), marks_conflict(raw(c), raw(F.slice(s, at + 1, F.size(c))))).otherwise(False)

    return let(claim, lambda c: let(source, lambda s: F.when(F.size(c) > 0, aligned(c, s)).otherwise(False)))


def verbatim(segments: DataFrame, over: Corpus, rules: Rules = Rules(), seg: str = "seg") -> DataFrame:
    """(seg, entry, kind, how, others, conflict): the entry that a segment is found in word for word.

    Kinds in their order, an entry's whole form before a part of one; of windows
    that hold a part the tightest. The gated kind counts for distinctive
    segments. ``conflict`` says what of the writing differs all the same: the letters that the normal form
    makes alike, or marks, for which the first aligned window decides.
    """
    # hits are few, and carry their texts: segments are read once
    hits = materialize(held.found_in(segments.select(seg, "text", "form"), over.entries, seg, rules.least_words), "verbatim-hits")
    gated = hits.filter(F.col("kind") == rules.gated)
    if not gated.isEmpty():
        asked = gated.groupBy(seg).agg(F.first("form").alias("form"))
        passed = held.weighed(asked, over.idf, over.sizes, rules.gated, seg).filter(held.distinctive(F.col("weights"), rules.gate)).select(seg, F.lit(True).alias("passed"))
        hits = hits.join(passed, seg, "left").filter((F.col("kind") != rules.gated) | F.col("passed"))
    hits = hits.withColumn("stage", F.col("entry.rank") * 2 - F.col("full").cast("int"))
    tight = F.when((F.col("kind") == "window") & ~F.col("full"), F.col("entry.members")).otherwise(0)
    hits = hits.withColumn("tight", tight)
    order = Window.partitionBy(seg).orderBy("stage", "tight", "entry")
    first = hits.withColumn("others", F.count(F.lit(1)).over(Window.partitionBy(seg, "stage", "tight")) - 1).withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    told = first.join(over.entries.select("entry", F.col("text").alias("source")), "entry")
    letters = F.lit(False)
    if rules.strict:
        spaced = lambda t: F.concat(F.lit(" "), rules.strict(t), F.lit(" "))
        letters = ~F.contains(spaced(F.col("source")), spaced(F.col("text")))
    marks = first_window_conflicts(as_written(F.col("text"), rules.normal), as_written(F.col("source"), rules.normal))
    exact = F.col("kind").isin(*rules.exact_kinds)
    conflict = F.when(exact & letters, "letter spelling differs from the source").when(exact & marks, "explicit marks differ from the source")
    return told.select(seg, "entry", "kind", F.when(F.col("full"), "full").otherwise("partial").alias("how"), "others", conflict.alias("conflict"))


def most_alike(segments: DataFrame, over: Corpus, rules: Rules = Rules(), seg: str = "seg") -> DataFrame:
    """(seg, entry, kind, form, score): of each segment's candidates the most similar form, where it reaches ``variant``.

    Candidates are chosen over all entries, by quotas for each kind; ties go to
    entries in their order, then forms. Alignment is quadratic and most texts are like none, so the
    order is turned round without a change of the result: pairs are found
    whose lengths and words in common let them reach the threshold, these are aligned,
    and the quotas are worked out for the segments that any such pair is left of.
    """
    ratio = lambda a, b: 2 * F.least(a, b) / (a + b)
    size = lambda form: (F.length(form).alias("c"), F.size(words(form)).alias("w"))
    forms = held.each_form(over.entries).select(F.monotonically_increasing_id().alias("f"), "entry", "kind", "no", "form", *size(F.col("form")))
    forms = materialize(forms, "alike-forms")
    segs = segments.select(seg, "form", *size(F.col("form"))).filter(F.col("w") >= rules.least_words)
    # a segment that is too short for the shortest form, or too long for the longest, is like none
    ends = forms.agg(*[f(x).alias(f"{x}{i}") for x in ("c", "w") for i, f in enumerate((F.min, F.max))])
    near = lambda x: ratio(F.col(x), F.greatest(f"{x}0", F.least(f"{x}1", x)))
    segs = segs.join(F.broadcast(ends)).filter((near("c") + near("w")) / 2 >= rules.variant).select(seg, "form", "c", "w")
    if estimated(segments) > estimated(forms):
        pairs = alike_in_length_and_words(segs, forms, rules.variant).select(seg, F.col("form").alias("a"), "f")
        pairs = pairs.join(forms.select("f", "entry", "kind", "no", F.col("form").alias("b")), "f")
    else:
        segs = materialize(segs.withColumn("f", F.monotonically_increasing_id()), "alike-segments")
        pairs = alike_in_length_and_words(forms.select("entry", "kind", "no", "form", "c", "w"), segs, rules.variant)
        pairs = pairs.select("f", "entry", "kind", "no", F.col("form").alias("b")).join(segs.select("f", seg, F.col("form").alias("a")), "f")
    # the alignments are made once, over all cores however few rows are left
    pairs = materialize(pairs.filter(fuzzy.similarity_bound(F.col("a"), F.col("b")) >= rules.variant), "alike-pairs")
    scored = pairs.withColumn("score", F.round(fuzzy.similarity(F.col("a"), F.col("b"), rules.variant), 6)).filter(F.col("score") >= rules.variant)
    scored = materialize(scored.select(seg, "entry", "kind", "no", "a", "b", "score"), "alike-scored")
    if not scored.isEmpty():
        asked = scored.groupBy(seg).agg(F.first("a").alias("form"))
        picked = held.candidates(asked, over.entries, over.idf, over.sizes, rules.quotas, seg).select(seg, "entry")
        scored = scored.join(picked, [seg, "entry"])
    best = scored.groupBy(seg).agg(F.min_by(F.struct("entry", "kind", F.col("b").alias("form"), "score"), F.struct(-F.col("score"), F.col("entry"), F.col("no"))).alias("best"))
    return best.select(seg, "best.*")


def quoted_runs(texts: DataFrame, over: Corpus, rules: Rules = Rules(), seg: str = "seg") -> DataFrame:
    """(seg, start, n_words, entry): left to right, the longest stretches of a text's form that stand in an entry.

    Stretches of the gated kind begin where ``run_words`` words are distinctive
    by the stricter gate. A stretch is the first entry's that holds all of it.
    """
    refs = held.each_form(over.entries).select(F.struct("entry", "no").alias("ref"), F.col("form").alias("text"))
    islands = materialize(match.verbatim_runs(refs, texts.select(seg, F.col("form").alias("text")), "ref", seg, rules.run_words), "runs")
    spans = islands.select(seg, F.col("ref.entry").alias("entry"), F.col("text_start").cast("int").alias("s"), (F.col("text_start") + F.col("n_words")).cast("int").alias("e")).distinct()
    gated = F.col("entry.rank") == F.lit(held.KINDS.index(rules.gated) + 1)
    free = spans.filter(~gated).withColumn("fixed", F.lit(False))
    if not spans.filter(gated).isEmpty():
        asked = texts.join(spans.filter(gated).select(seg).distinct(), seg, "left_semi")
        weights = held.weighed(asked, over.idf, over.sizes, rules.gated, seg)
        begins = F.filter(F.sequence(F.col("s"), F.col("e") - rules.run_words), lambda i: held.distinctive(F.slice("weights", i + 1, F.lit(rules.run_words)), rules.strict_gate))
        fixed = spans.filter(gated).join(weights, seg).select(seg, "entry", F.explode(begins).alias("s"), "e", F.lit(True).alias("fixed"))
        free = free.unionByName(fixed)
    spans = materialize(free, "runs-open")
    rows = spans.groupBy(seg).agg(F.sort_array(F.collect_set(F.struct("s", "e", "fixed"))).alias("spans"))
    kind = "array<struct<s:int,e:int>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("kept"))

    def step(state: Column, _: Column) -> Column:
        clipped = F.transform(F.filter("spans", lambda x: ~x["fixed"] | (x["s"] >= state["at"])), lambda x: F.struct(F.greatest(x["s"], state["at"]).alias("s"), (-x["e"]).alias("e")))
        best = F.array_min(F.filter(clipped, lambda x: -x["e"] - x["s"] >= rules.run_words))
        return let(best, lambda b: F.when(b.isNull(), state).otherwise(F.struct((-b["e"]).alias("at"), F.concat(state["kept"], F.array(F.struct(b["s"].alias("s"), (-b["e"]).alias("e")))).alias("kept"))))

    kept = rows.select(seg, F.explode(F.aggregate("spans", begin, step, lambda s: s["kept"])).alias("k")).select(seg, F.col("k.s").alias("ks"), F.col("k.e").alias("ke"))
    whole = kept.join(spans, seg).filter((F.col("s") <= F.col("ks")) & (F.col("e") >= F.col("ke")) & (~F.col("fixed") | (F.col("s") <= F.col("ks"))))
    return whole.groupBy(seg, "ks", "ke").agg(F.min("entry").alias("entry")).select(seg, F.col("ks").alias("start"), (F.col("ke") - F.col("ks")).alias("n_words"), "entry")


_NONE = "array<string>"


def decide(segments: DataFrame, over: Corpus, rules: Rules = Rules(), seg: str = "seg") -> DataFrame:
    """(seg, status, how, entry, others, confidence, differences) of each segment: (seg, text).

    Word for word first (``verbatim``): verified, or a variant where its writing
    differs. What is left is a variant of the most similar candidate
    (``most_alike``), else of the entry of its longest quoted stretch, with all
    stretches told in order, else baseless. Each stage only sees what those before it left.

    A segment whose normal form is empty is baseless, and so is a null one.
    Repeated texts get the same answer; an empty table gives none.
    """
    texts = materialize(segments.select(seg, F.coalesce("text", F.lit("")).alias("text")).withColumn("form", rules.normal(F.col("text"))), "segments")
    none, long_ = F.array().cast(_NONE), lambda x: x.cast("long")
    same = verbatim(texts, over, rules, seg)
    same = materialize(
        same.select(seg, F.when(F.col("conflict").isNull(), "verified").otherwise("variant").alias("status"), "how", "entry", long_(F.col("others")).alias("others"), F.lit(1.0).alias("confidence"), F.when(F.col("conflict").isNull(), none).otherwise(F.array("conflict")).alias("differences")), "decided-verbatim"
    )
    rest = texts.join(same.select(seg), seg, "left_anti")
    alike = most_alike(rest, over, rules, seg).join(texts.select(seg, F.col("form").alias("own")), seg)
    alike = materialize(
        alike.select(seg, F.lit("variant").alias("status"), F.lit("altered").alias("how"), "entry", F.lit(0).cast("long").alias("others"), F.round("score", 2).alias("confidence"), fuzzy.word_differences(words(F.col("own")), words(F.col("form"))).alias("differences")), "decided-alike"
    )
    rest = rest.join(alike.select(seg), seg, "left_anti")
    parts = materialize(quoted_runs(rest, over, rules, seg), "decided-parts")
    told = parts.groupBy(seg).agg(F.sum("n_words").alias("covered"), F.min_by("entry", F.struct(-F.col("n_words"), F.col("start"))).alias("entry"), F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("runs"))
    told = told.join(rest.select(seg, words(F.col("form")).alias("w")), seg)
    built = told.select(seg, F.lit("variant").alias("status"), F.lit("parts").alias("how"), "entry", F.lit(0).cast("long").alias("others"), F.round(F.col("covered") / F.size("w"), 2).alias("confidence"), stretches(F.col("w"), F.col("runs")).alias("differences"))
    built = materialize(built, "decided-built")
    rest = rest.join(built.select(seg), seg, "left_anti")
    entry = over.entries.schema["entry"].dataType
    baseless = rest.select(seg, F.lit("baseless").alias("status"), F.lit(None).cast("string").alias("how"), F.lit(None).cast(entry).alias("entry"), F.lit(0).cast("long").alias("others"), F.lit(None).cast("double").alias("confidence"), none.alias("differences"))
    return same.unionByName(alike).unionByName(built).unionByName(baseless)


def stretches(w: Column, runs: Column) -> Column:
    """Quoted and other stretches of words in reading order, as messages; ``runs`` (start, n_words) are in order."""
    cut = lambda label, i, n: F.when(n > 0, F.concat(F.lit(label), F.array_join(F.slice(w, i + 1, n), " "), F.lit("'")))
    end = lambda r: r["start"] + r["n_words"]

    def told(r: Column, i: Column) -> Column:
        before = F.when(i > 0, end(F.get(runs, i - 1))).otherwise(0)
        return F.array(cut("not found: '", before, r["start"] - before), cut("verbatim: '", r["start"], r["n_words"]))

    last = end(F.element_at(runs, -1))
    all_ = F.concat(F.flatten(F.transform(runs, told)), F.array(cut("not found: '", last, F.size(w) - last)))
    return F.filter(all_, lambda m: m.isNotNull())


def review(sentences: DataFrame, over: Corpus, rules: Rules = Rules()) -> DataFrame:
    """The findings in each sentence (seg, text): (seg, start, stop, found, status, how, entry, others, confidence, differences).

    ``start`` and ``stop`` are code points of the sentence. A sentence that is
    quoted word for word is told whole. Else its marked and attributed
    quotations are told, each by its own decision - one that nothing attributes
    only where it is like an entry - and, if the sentence is long or like no
    entry, the stretches of four words and more outside them that stand in an entry.
    If these leave no region and cover ``whole_from`` of the sentence, or there are none, the sentence
    is told whole, by the decision that also looks for parts.

    Most sentences are like no entry, have no run of one and no quotation: they are
    baseless, which is told in the one pass that reads all (``near_any``). The others are looked at closely.
    """
    rows = sentences.select("seg", "text")
    if estimated(rows) <= estimated(over.entries):
        return _reviewed(rows, over, rules)
    rows = rows.select("seg", F.length("text").alias("stop"), "text", rules.normal(F.col("text")).alias("form"))
    told = near_any(rows, held.each_form(over.entries), rules.least_words, rules.run_words, rules.variant, regions.signs(rules.lexicon))
    told = materialize(told, "review-told")
    close = _reviewed(told.filter("near").select("seg", "text"), over, rules)
    fixed = {"start": F.lit(0), "found": F.lit("sentence"), "status": F.lit("baseless"), "others": F.lit(0), "differences": F.array()}
    rest = told.filter("not near").withColumns(fixed)
    rest = rest.select(*[(F.col(f.name) if f.name in rest.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in close.schema])
    return close.unionByName(rest)


def _reviewed(sentences: DataFrame, over: Corpus, rules: Rules) -> DataFrame:
    """:func:`review` of sentences that are all looked at closely."""
    n_words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    marked = F.transform("regions", lambda r, i: F.struct(i.alias("no"), r["start"].alias("start"), r["end"].alias("stop"), r["attributed"].alias("attributed"), regions.trimmed(r["text"]).alias("text")))
    sents = regions.quoted_regions(sentences.select("seg", "text"), rules.lexicon, rules.normal)
    sents = sents.select("seg", "text", n_words.alias("n"), F.length("text").alias("length"), F.filter(marked, lambda r: r["text"] != "").alias("marked"))
    sents = materialize(sents, "reviewed")
    # keys carry what is told of a sentence or region, so that decisions don't have to meet the sentences again
    key = lambda **of: F.struct(F.col("seg"), *[c.cast("boolean" if name == "attributed" else "int").alias(name) for name, c in of.items()]).alias("key")
    whole = sents.select(key(no=F.lit(-1), start=F.lit(0), stop=F.col("length"), n=F.col("n"), attributed=F.lit(False)), "text")
    regs = sents.select("seg", F.explode_outer("marked").alias("r")).filter("r is not null")
    regs = regs.select(key(no=F.col("r.no"), start=F.col("r.start"), stop=F.col("r.stop"), n=F.lit(0), attributed=F.col("r.attributed")), F.col("r.text").alias("text"))
    decided = materialize(decide(whole.unionByName(regs), over, rules, "key"), "review-decided")
    columns = [c for c in decided.columns if c != "key"]
    own = decided.filter("key.no = -1").select("key.seg", "key.n", F.col("key.stop").alias("stop"), *columns)
    # few sentences are like an entry: what is left of the others is told by what these leave
    like = materialize(own.filter("status <> 'baseless'").select("seg", "n", "status", "how"), "review-like")
    verified = F.col("status") == "verified"

    found = decided.filter("key.no >= 0 and (key.attributed or status <> 'baseless')").select("key.seg", "key.start", "key.stop", F.lit("region").alias("found"), *columns)
    found = found.join(like.filter(verified).select("seg"), "seg", "left_anti")
    # stretches are looked for between the regions, where the sentence is long or like none
    passed = like.filter(verified | ~((F.col("n") > rules.long_sentence) | (F.col("how") == "parts"))).select("seg")
    searched = sents.join(passed, "seg", "left_anti")
    forms = held.each_form(over.entries).select("form")
    if estimated(sents) > estimated(forms):
        # a stretch between regions is one of the sentence: only sentences that have any are looked at closely
        grams = forms.select(F.explode(runs(words(F.col("form")), rules.run_words)).alias("gram"))
        rows = searched.select("seg", F.array_join(F.transform(regions.tokens(F.col("text"), rules.normal), lambda t: t["norm"]), " ").alias("form"))
        met = materialize(runs_met(rows, grams, rules.run_words).select("seg").distinct(), "review-met")
        searched = materialize(searched.join(met, "seg", "left_semi"), "review-searched")
    # places come from Python, which counts code points as Spark does
    tokens = searched.select("seg", regions.tokens(F.col("text"), rules.normal).alias("tokens"), "marked")
    # a stretch ends where a region stands in between: words are numbered over all, and regions leave gaps
    numbered = tokens.select("seg", F.explode(F.transform("tokens", lambda t, i: F.struct(i.alias("i"), F.exists("marked", lambda m: (m["start"] <= t["start"]) & (t["start"] < m["stop"])).alias("inside"), t.alias("t")))).alias("x")).select("seg", "x.*").filter("not inside")
    line = Window.partitionBy("seg").orderBy("i")
    numbered = numbered.withColumn("part", F.col("i") - F.row_number().over(line))
    texts = numbered.groupBy("seg", "part").agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("ts"))
    texts = texts.select(F.struct("seg", "part").alias("piece"), F.transform("ts", lambda x: x["t"]).alias("ts"))
    texts = materialize(texts.withColumn("form", F.array_join(F.transform("ts", lambda t: t["norm"]), " ")), "review-pieces")
    ran = quoted_runs(texts.select("piece", "form"), over, rules, "piece").join(texts.select("piece", "ts"), "piece")
    first, last = F.get("ts", F.col("start")), F.get("ts", F.col("start") + F.col("n_words") - 1)
    ran = ran.select(F.col("piece.seg").alias("seg"), first["start"].alias("start"), last["end"].alias("stop")).join(searched.select("seg", "n", "text"), "seg")
    ran = ran.withColumn("text", regions.trimmed(F.substr("text", F.col("start") + 1, F.col("stop") - F.col("start"))))
    ran = materialize(ran.select(F.struct("seg", "start", "stop", "n").alias("key"), n_words.alias("n_words"), "text", rules.normal(F.col("text")).alias("form")), "review-runs")
    same = verbatim(ran, over, rules, "key").filter("conflict is null")
    ran = same.join(ran.select("key", "n_words"), "key").select("key.*", F.lit("run").alias("found"), F.lit("verified").alias("status"), "how", "entry", F.col("others").cast("long").alias("others"), F.lit(1.0).alias("confidence"), F.array().cast(_NONE).alias("differences"), F.col("n_words").cast("int").alias("n_words"))
    none = F.lit(None).cast("int")
    both = materialize(found.withColumns({"n": none, "n_words": none}).unionByName(ran), "review-found")

    counted = both.groupBy("seg").agg(F.bool_or(F.col("found") == "region").alias("regions"), F.sum("n_words").alias("covered"), F.max("n").alias("n"))
    around = materialize(counted.filter(F.col("regions") | (F.col("covered") / F.col("n") < rules.whole_from)).select("seg"), "review-around")
    parts = both.drop("n", "n_words").join(around, "seg", "left_semi")
    rest = own.drop("n").join(around, "seg", "left_anti")
    whole = rest.withColumns({"start": F.lit(0), "found": F.lit("sentence")}).select(*parts.columns)
    return whole.unionByName(parts)
