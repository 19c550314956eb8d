"""Entries of a corpus with several spellings each: forms, windows of entries that follow each other, exact and contained matches."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarrant.functions.text import let, normalize, runs, words
from textwarrant.operators.meeting import estimated, runs_met

Normal = Callable[[Column], Column]
#: Kinds of entries, those to be named first before the others.
KINDS = ("verse", "window", "hadith")
#: Words of the shortest phrase that counts as a part of an entry, entries of the longest window.
LEAST_WORDS = 3
WINDOW = 5
#: What a phrase of everyday texts needs to point at one: idf of its second rarest word, and of all its words.
GATE = (4.0, 12.0)
STRICT_GATE = (5.5, 18.0)


def spelled(rows: DataFrame, texts: Column, kind: Column, normal: Normal = normalize, id_col: str = "item_id") -> DataFrame:
    """(entry, kind, text, forms): each row with the distinct normal forms of its spellings, in their order.

    ``texts`` is an array, the text as written first; spellings without a word
    are none, and a row without any form is no entry. ``entry`` is a struct of
    the kind's place, the row's id and the number of members, by which entries are in order.
    """
    able = F.filter(texts, lambda t: F.coalesce(normal(t), F.lit("")) != "")
    forms = F.array_distinct(F.transform(able, lambda t: normal(t)))
    entry = F.struct(_place(kind).alias("rank"), F.col(id_col).alias("item_id"), F.lit(1).alias("members"))
    return rows.select(entry.alias("entry"), kind.alias("kind"), F.get(able, F.lit(0)).alias("text"), forms.alias("forms")).filter(F.size("forms") > 0)


def _place(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int")


def windows(entries: DataFrame, places: DataFrame, most: int = WINDOW) -> DataFrame:
    """Entries made of two to ``most`` entries that follow each other, as ``spelled`` has them.

    ``places`` has item_id, group and place (whole numbers); of two entries at
    one place the one with the smaller id counts. The form with number k of a window joins the
    members' forms with number k, or their last where they have fewer.
    """
    own = entries.select(F.col("entry.item_id").alias("item_id"), "text", "forms").join(places, "item_id")
    starts = F.sequence(F.col("place") - (most - 1), F.col("place"))
    held = own.select("group", F.explode(starts).alias("start"), F.struct("place", "item_id", "text", "forms").alias("m"))
    # a window has most members at most, whatever the group's size; rows of one place first meet as one
    one = held.groupBy("group", "start", "m.place").agg(F.min_by("m", "m.item_id").alias("m"))
    met = one.groupBy("group", "start").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    unbroken = F.filter("ms", lambda m, i: m["place"] == F.col("start") + i)
    met = met.withColumn("ms", unbroken).filter(F.size("ms") >= 2)
    met = met.select(F.explode(F.transform(F.sequence(F.lit(2), F.size("ms")), lambda n: F.slice("ms", F.lit(1), n))).alias("ms"))
    most_forms = F.array_max(F.transform("ms", lambda m: F.size(m["forms"])))
    form = lambda k: F.array_join(F.transform("ms", lambda m: F.get(m["forms"], F.least(k, F.size(m["forms"]) - 1))), " ")
    forms = F.array_distinct(F.transform(F.sequence(F.lit(0), most_forms - 1), form))
    entry = F.struct(_place(F.lit("window")).alias("rank"), F.col("ms")[0]["item_id"].alias("item_id"), F.size("ms").alias("members"))
    return met.select(entry.alias("entry"), F.lit("window").alias("kind"), F.array_join(F.transform("ms", lambda m: m["text"]), " ").alias("text"), forms.alias("forms"))


def each_form(entries: DataFrame) -> DataFrame:
    """(entry, kind, no, form)."""
    return entries.select("entry", "kind", F.posexplode("forms").alias("no", "form"))


def found_in(segments: DataFrame, entries: DataFrame, seg: str = "seg", least_words: int = LEAST_WORDS) -> DataFrame:
    """(seg's columns, entry, kind, full): entries of which a form is the segment's, or holds it as consecutive whole words; each entry once.

    ``segments`` has seg, form and what else is wanted of the hits; they are read once. The first words of a
    segment meet the runs of as many words of all forms of an entry; a segment of
    fewer words meets whole forms and is part of nothing. What meets is then compared in full.
    """
    asked = segments.filter("form <> ''")
    long_ = lambda f: F.size(words(f)) >= least_words
    seed = F.array_join(F.slice(words(F.col("form")), 1, least_words), " ")
    asked = asked.select("*", F.when(long_(F.col("form")), seed).otherwise(F.col("form")).alias("seed"))
    if estimated(asked) > estimated(entries):
        keys = F.flatten(F.transform("forms", lambda f: F.when(long_(f), runs(words(f), least_words)).otherwise(F.array(f))))
        met = entries.select("entry", F.explode(F.array_distinct(keys)).alias("seed"))
    else:
        each = each_form(entries).select("entry", "form")
        short = each.filter(~long_(F.col("form"))).select("entry", F.col("form").alias("seed"))
        wanted = asked.filter(long_(F.col("form"))).select(F.col("seed").alias("gram"))
        met = runs_met(each, wanted, least_words).select("entry", F.col("gram").alias("seed")).distinct().unionByName(short)
    met = asked.join(met.distinct(), "seed").drop("seed").join(entries.select("entry", "kind", "forms"), "entry")
    spaced = lambda f: F.concat(F.lit(" "), f, F.lit(" "))
    met = met.withColumn("full", F.array_contains("forms", F.col("form")))
    met = met.filter(F.col("full") | (long_(F.col("form")) & F.exists("forms", lambda f: spaced(f).contains(spaced(F.col("form"))))))
    return met.select(*segments.columns, "entry", "kind", "full")


def word_weights(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, term, idf) and (kind, n, unseen): ln(1 + n / entries with the word) over the entries of each kind by itself.

    A word in several forms of an entry counts once.
    """
    n = entries.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    df = entry_words(entries).groupBy("kind", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(F.broadcast(n), "kind").select("kind", "term", F.log1p(F.col("n") / F.col("df")).alias("idf"))
    return idf, n.withColumn("unseen", F.log1p("n"))


def entry_words(entries: DataFrame) -> DataFrame:
    """(entry, kind, term): the distinct words of all forms of an entry."""
    return entries.select("entry", "kind", F.explode(F.array_distinct(F.flatten(F.transform("forms", words)))).alias("term"))


def weighed(texts: DataFrame, idf: DataFrame, sizes: DataFrame, kind: str, seg: str = "seg") -> DataFrame:
    """(seg, weights): the idf of each word of a text's form, in order, by the statistics of one kind."""
    at = texts.select(seg, F.posexplode(words(F.col("form"))).alias("i", "term"))
    unseen = F.broadcast(sizes.filter(F.col("kind") == kind).select("unseen"))
    valued = at.join(idf.filter(F.col("kind") == kind).select("term", "idf"), "term", "left").join(unseen, how="left")
    valued = valued.select(seg, F.struct("i", F.coalesce("idf", "unseen").alias("w")).alias("x"))
    return valued.groupBy(seg).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["w"]).alias("weights"))


def distinctive(weights: Column, gate: tuple[float, float] = GATE) -> Column:
    """Whether words of these idf point at a text: their second rarest and all together are rare enough."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    return let(F.sort_array(weights, False), lambda w: (F.size(w) >= 2) & F.coalesce(F.get(w, F.lit(1)) >= gate[0], F.lit(False))) & (total >= gate[1])


def candidates(segments: DataFrame, entries: DataFrame, idf: DataFrame, sizes: DataFrame, quotas: Mapping[str, int], seg: str = "seg") -> DataFrame:
    """(seg, entry, kind, place): of each kind the quota's best entries by idf-weighted overlap of distinct words.

    Words met by both, over all of either: rare ones count most, and long
    entries lose by what they hold besides. Ties go to entries in their order.
    """
    asked = segments.select(seg, F.explode(F.array_distinct(words(F.col("form")))).alias("term"))
    own = entry_words(entries).join(idf, ["kind", "term"])
    whole = own.groupBy("entry").agg(F.sum("idf").alias("ew"))
    # a segment's words weigh by each kind's statistics, those that no entry has as the rarest
    met = asked.join(idf, "term")
    counted = asked.groupBy(seg).agg(F.count(F.lit(1)).alias("terms"))
    qw = met.groupBy(seg, "kind").agg(F.sum("idf").alias("seen"), F.count(F.lit(1)).alias("met")).join(counted, seg).join(F.broadcast(sizes), "kind")
    qw = qw.select(seg, "kind", (F.col("seen") + (F.col("terms") - F.col("met")) * F.col("unseen")).alias("qw"))
    shared = asked.join(own, "term").groupBy(seg, "entry", "kind").agg(F.sum("idf").alias("overlap"))
    scored = shared.join(qw, [seg, "kind"]).join(whole, "entry")
    score = F.round(F.col("overlap") / (F.col("qw") + F.col("ew") - F.col("overlap")), 9)
    order = Window.partitionBy(seg, "kind").orderBy(F.desc("score"), "entry")
    quota = F.element_at(F.create_map(*[x for k, q in quotas.items() for x in (F.lit(k), F.lit(q))]), F.col("kind"))
    return scored.withColumn("score", score).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= quota).select(seg, "entry", "kind", "place")
