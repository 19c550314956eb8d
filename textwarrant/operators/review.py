"""Composites: a text verified, evidence gathered, two editions merged."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarrant.functions import fuzzy
from textwarrant.operators import decision, entries
from textwarrant.operators.retrieve import top_per_group
from textwarrant.tables import materialize

def most_similar(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Each left text's most similar of its candidates: (left_id, right_id, a, b, score), ties to smaller ids.

    ``pairs`` has both ids, ``left`` (left_id, a), ``right`` (right_id, b). Alignment is
    quadratic, so it is done for the candidate of the greatest bound first, and
    then for those only whose bound reaches that one's score.
    """
    texts = lambda ids: ids.join(left, left_id).join(right, right_id)
    bounds = texts(pairs).select(left_id, right_id, F.round(fuzzy.similarity_bound(F.col("a"), F.col("b")), 6).alias("bound"))
    bounds = materialize(bounds.filter("bound is not null"), "similar-bounds")
    order = Window.partitionBy(left_id).orderBy(F.desc("bound"), right_id)
    ranked = bounds.withColumn("rn", F.row_number().over(order))
    exact = F.round(fuzzy.similarity(F.col("a"), F.col("b")), 6)
    first = materialize(texts(ranked.filter("rn = 1").select(left_id, right_id)).select(left_id, right_id, exact.alias("score")), "similar-first")
    reach = ranked.filter("rn > 1").join(first.select(left_id, F.col("score").alias("least")), left_id).filter("bound >= least")
    rest = texts(reach.select(left_id, right_id)).select(left_id, right_id, exact.alias("score"))
    both = first.unionByName(rest).groupBy(left_id).agg(F.min(F.struct((-F.col("score")).alias("minus"), right_id)).alias("b"))
    return texts(both.select(left_id, F.col(f"b.{right_id}").alias(right_id), (-F.col("b.minus")).alias("score")))


def verify(segments: DataFrame, corpus: DataFrame, segment_id: str, corpus_id: str, candidates: int = 20) -> DataFrame:
    """Each segment's status, match type, source, confidence and differences, by ``decision.decide`` over texts of one kind and one spelling."""
    over = decision.corpus(entries.spelled(corpus, F.array("text"), F.lit("verse"), id_col=corpus_id))
    found = decision.decide(segments.select(F.col(segment_id).alias("seg"), "text"), over, decision.Rules(quotas={"verse": candidates}))
    status = F.when(F.col("status") == "variant", "semantic_variant").otherwise(F.col("status"))
    match_type = F.when(F.col("how").isin("full", "altered"), "full").when(F.col("how").isNotNull(), "partial")
    return found.select(F.col("seg").alias(segment_id), F.col("entry.item_id").alias(corpus_id), status.alias("status"), match_type.alias("match_type"), "confidence", "differences")


def accepts_similar(share: Column, matched: Column, cosine: Column, n_terms: Column) -> Column:
    """Whether two texts are near enough to point one out for the other."""
    near = ((share >= 0.5) & (matched >= 4) & (cosine >= 0.7)) | ((share >= 0.75) & (matched >= 3) & (cosine >= 0.8))
    return near & ~((n_terms >= 14) & (share < 0.65))


def evidence_card(items: DataFrame, by: str, limit: int = 5, related: int = 3) -> DataFrame:
    """Direct items up to ``limit``, and related ones up to ``related`` only where fewer than three are direct.

    ``items`` has level, direct, score and item_id; the order is level, then score.
    """
    order = Window.partitionBy(by, "direct").orderBy("level", F.desc("score"), "item_id")
    ranked = items.withColumn("place", F.row_number().over(order)).withColumn("n_direct", F.count_if("direct").over(Window.partitionBy(by)))
    return ranked.filter((F.col("direct") & (F.col("place") <= limit)) | (~F.col("direct") & (F.col("n_direct") < 3) & (F.col("place") <= related)))


def boosted(hits: DataFrame, by: str, group: str, factor: Column) -> DataFrame:
    """Hits of the group that the best hit belongs to, their scores times ``factor``; the others as they are."""
    first = F.first(group).over(Window.partitionBy(by).orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("score", F.round(F.when(first.eqNullSafe(F.col(group)), F.col("score") * factor).otherwise(F.col("score")), 9))


def keyword_check(hits: DataFrame, asked: DataFrame, headings: DataFrame, group: str, factor: Column, status: Column, by: str = "query_id", pool: int = 24, show: int = 3, least: float = 0.6) -> DataFrame:
    """What a claim's best passages say of it, by its words alone: (``by``, n_shown, doc_id, status).

    Of each claim's ``pool`` best ``hits`` (``by``, doc_id, score, share, and what ``factor``
    and ``status`` read) those in the best one's ``group`` are raised. Of the first
    ``show`` those are shown that hold ``least`` of the claim's words and share a word
    of their heading with it; the first of these gives the status. ``asked`` is (``by``,
    term) and ``headings`` (doc_id, term). A claim without a passage is
    ``not_found``; equal scores go to the smaller doc_id.
    """
    top = top_per_group(hits, [by], "score", "doc_id", pool).drop("rank")
    raised = top_per_group(boosted(top, by, group, factor), [by], "score", "doc_id", show)
    held = raised.filter(F.col("share") >= least).select(by, "doc_id", "rank", status.alias("status"))
    headed = held.select(by, "doc_id").join(headings.select("doc_id", "term"), "doc_id").join(asked.select(by, "term"), [by, "term"])
    shown = held.join(headed, [by, "doc_id"], "left_semi").groupBy(by)
    shown = shown.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rank", "doc_id", "status")).alias("first"))
    told = asked.select(by).distinct().join(shown, by, "left")
    return told.select(by, F.coalesce("n", F.lit(0)).alias("n_shown"), "first.doc_id", F.when(F.col("n").isNull(), "not_found").otherwise(F.col("first.status")).alias("status"))


def keeps_order(wanted: Column, held: Column) -> Column:
    """Whether ``held`` (words) has all of ``wanted`` in order: a fold that carries the last place."""
    ahead = lambda at, w: F.array_position(F.slice(held, at + 1, F.greatest(F.size(held) - at, F.lit(0))), w).cast("int")
    last = F.aggregate(wanted, F.lit(0), lambda at, w: F.when(at < 0, at).when(ahead(at, w) > 0, at + ahead(at, w)).otherwise(F.lit(-1)))
    return (F.size(wanted) > 0) & (last > 0)


def head_lookup(ranges: DataFrame, heads: DataFrame, texts: DataFrame, range_id: str) -> DataFrame:
    """The head text of each row in a range, each shown once, with the last row that it covers.

    ``ranges`` has group, first and last; ``heads`` (group, place, head);
    ``texts`` (group, place, text).
    """
    rows = ranges.select(range_id, "group", F.explode(F.sequence("first", "last")).alias("place"))
    last = heads.groupBy("group", "head").agg(F.max("place").alias("covers_to"))
    found = rows.join(heads, ["group", "place"], "left").withColumn("head", F.coalesce("head", "place"))
    once = found.groupBy(range_id, "group", "head").agg(F.min("place").alias("shown_at"))
    named = once.join(texts.select("group", F.col("place").alias("head"), "text"), ["group", "head"]).join(last, ["group", "head"], "left")
    return named.select(range_id, "group", "head", "shown_at", F.coalesce("covers_to", "head").alias("covers_to"), "text")


def merge_editions(a: DataFrame, b: DataFrame, by: str, least: float = 0.8) -> DataFrame:
    """Two editions of each book as one: (book, a_at, b_at, how).

    Both have at (the order), key and text. Stretches that align pair; in a
    stretch that differs each text takes the most similar one left, or the one at
    its place if the other side has no text there and the stretches are as long.
    Then texts that only one side has pair by equal keys, in order. A book is one
    alignment and so one group.
    """

    def of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        book = (left if len(left) else right)[by].iloc[0]
        left, right = left.sort_values("at"), right.sort_values("at")
        return pd.DataFrame([(book, *row) for row in _aligned(left, right, least)], columns=[by, "a_at", "b_at", "how"]).astype({"a_at": "Int64", "b_at": "Int64"})

    kind = a.schema[by].dataType.simpleString()
    return a.groupBy(by).cogroup(b.groupBy(by)).applyInPandas(of, f"{by} {kind}, a_at long, b_at long, how string")


def _aligned(left: pd.DataFrame, right: pd.DataFrame, least: float) -> Iterator[tuple[int | None, int | None, str]]:
    from difflib import SequenceMatcher

    ka, kb, ta, tb = list(left["key"]), list(right["key"]), list(left["at"]), list(right["at"])
    blank = [not t for t in right["text"]]
    pairs: list[tuple[int | None, int | None, str]] = []
    for op, i1, i2, j1, j2 in SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if op == "equal":
            pairs += [(i1 + n, j1 + n, "same") for n in range(i2 - i1)]
            continue
        free = [j for j in range(j1, j2)]
        for i in range(i1, i2):
            rated = [(SequenceMatcher(None, ka[i], kb[j], autojunk=False).ratio(), j) for j in free if not blank[j]]
            score, j = max(rated, default=(0.0, None))
            at = j1 + i - i1
            if score >= least:
                pairs.append((i, j, "similar"))
                free.remove(j)
            elif i2 - i1 == j2 - j1 and blank[at] and at in free:
                pairs.append((i, at, "place"))
                free.remove(at)
            else:
                pairs.append((i, None, "a"))
        pairs += [(None, j, "b") for j in free if not blank[j]]
    alone: dict[str, list[int]] = {}
    for i, j, how in pairs:
        if how == "b":
            alone.setdefault(kb[j], []).append(j)
    met = {}
    for i, j, how in pairs:
        if how == "a" and alone.get(ka[i]):
            met[i] = alone[ka[i]].pop(0)
    taken = set(met.values())
    for i, j, how in pairs:
        if how == "a" and i in met:
            yield ta[i], tb[met[i]], "moved"
        elif not (how == "b" and j in taken):
            yield None if i is None else ta[i], None if j is None else tb[j], how
