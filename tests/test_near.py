"""Sentences that are like no entry are told in one pass; only the others are looked at closely: F1 of round 4."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_decision import LEX, ROWS, RULES, TEXTS
from textwarrant.functions import fuzzy
from textwarrant.functions.text import normalize
from textwarrant.operators import decision, entries, meeting, regions, verify


@pytest.fixture(scope="module")
def over(spark):
    rows = spark.createDataFrame(ROWS, "item_id long, kind string, texts array<string>, group string, place int")
    one = entries.spelled(rows, F.col("texts"), F.col("kind"))
    return decision.corpus(one.unionByName(entries.windows(one, rows.filter("place is not null").select("item_id", "group", "place"))))


def bag(a, b):
    return sum(min(a.count(x), b.count(x)) for x in set(a))


def near(form, forms, least_words, run_words, least):
    w = form.split()
    grams = lambda x, n: {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
    for f in forms:
        v = f.split()
        if form == f and len(w) < least_words or len(w) >= least_words and len(w) < run_words and grams(w, len(w)) & grams(v, len(w)) or grams(w, run_words) & grams(v, run_words):
            return True
        if len(w) >= least_words and (common := bag(w, v)) and (2 * bag(form, f) / (len(form) + len(f)) + 2 * common / (len(w) + len(v))) / 2 >= least:
            return True
    return False


@pytest.mark.parametrize(("block", "least_words", "run_words"), [(1000, 3, 4), (7, 3, 4), (1000, 1, 3), (1000, 2, 6), (1000, 5, 3)])
def test_rows_that_are_near_a_form(spark, monkeypatch, block, least_words, run_words):
    monkeypatch.setattr(meeting, "NEAR_FORMS_AT_ONCE", block)
    monkeypatch.setattr(meeting, "NEAR_TEXTS_AT_ONCE", 50)
    draw = random.Random(5)
    made = lambda n, most: [" ".join(draw.choice(["a", "bb", "ccc", "dd́", "e𝔸", *(f"own{k}" for k in range(30))]) for _ in range(draw.randint(1, most))) for _ in range(n)]
    forms = [*made(25, 12), "a", "bb own1", "own1 own2 own3", "x y z", "zz"]
    texts = [*made(600, 14), "", "unknown", "x y", "y z", "x y z", "zz", "own2 own3", "own1 bb", "n o n e of it", *forms]
    rows = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)] + [(-1, None, None)], "id int, text string, form string").repartition(3)
    got = meeting.near_any(rows, spark.createDataFrame([(f,) for f in forms], "form string"), least_words, run_words, 0.6, {})
    told = {r.id: (r.near, r.text) for r in got.collect()}
    assert got.columns == ["id", "text", "near"] and told.pop(-1) == (True, None)
    want = {i: near(t, forms, least_words, run_words, 0.6) for i, t in enumerate(texts)}
    # no row is missed, and none is near besides
    assert {i: n for i, (n, _) in told.items()} == want and {i: t for i, (_, t) in told.items()} == {i: t if want[i] else None for i, t in enumerate(texts)}
    assert 20 < sum(want.values()) < len(texts) - 20


def test_without_forms_only_signs_count(spark):
    rows = spark.createDataFrame([(1, "a (b", "a b"), (2, "a b", "a b"), (3, "", "")], "id int, text string, form string")
    got = meeting.near_any(rows, spark.createDataFrame([], "form string"), 3, 4, 0.6, {"text": r"[(]"})
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a (b", True), (2, None, False), (3, None, False)]


def test_letters_of_large_alphabets_are_not_counted(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "t", "a b c x"), (2, "t", "z z z")], "id int, text string, form string")
    forms = spark.createDataFrame([("a b c y",)], "form string")
    monkeypatch.setattr(meeting, "ALPHABET", 2)
    assert {r.id: r.near for r in meeting.near_any(rows, forms, 3, 5, 0.6, {}).collect()} == {1: True, 2: False}


def test_texts_with_a_region_have_a_sign(spark):
    draw = random.Random(7)
    parts = [*LEX.said, *LEX.speaker, *LEX.names, *LEX.others, *LEX.between, *LEX.honorific, *LEX.context, *"one two three four ( ) « » “ ” [ ] { } \" , . - \n".split(" "), "Said:", "‘GOD’"]
    texts = [draw.choice(["", " "]).join([" ".join(draw.choice(parts) for _ in range(draw.randint(1, 14)))] * 2) for _ in range(1500)]
    texts += ["said\x1cgod one two three", "said\xa0god one two three", "said god　one two three four", *[t for t in TEXTS if t]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("form", normalize(F.col("text")))
    held = {r.id for r in regions.quoted_regions(rows, LEX, normalize).filter(F.size("regions") > 0).select("id").collect()}
    told = meeting.near_any(rows.repartition(2), spark.createDataFrame([], "form string"), 3, 4, 0.6, regions.signs(LEX)).filter("near")
    assert held <= (signed := {r.id for r in told.select("id").collect()}) and len(held) > 300 and len(signed) < len(texts)


def test_a_review_is_that_of_all_looked_at_closely(spark, over):
    draw = random.Random(9)
    pieces = [w for t in TEXTS if t for w in t.split(" ")] + ["other", "words", "and", "a\xa0light", "said\x85lord"]
    texts = [*TEXTS, *(" ".join(draw.choice(pieces) for _ in range(draw.randint(1, 12))) for _ in range(300))]
    segs = spark.createDataFrame(list(enumerate(texts)), "seg int, text string")
    told, closely = decision.review(segs, over, RULES), decision._reviewed(segs, over, RULES)
    assert told.schema == closely.schema
    assert sorted(map(str, told.collect())) == sorted(map(str, closely.collect()))


def test_sentences_like_none_are_not_looked_at_closely(spark, monkeypatch):
    items = spark.createDataFrame([(i, [f"the of and in to a own{i} word{i} mine{i}"]) for i in range(20)], "item_id long, texts array<string>")
    over = decision.corpus(entries.spelled(items, F.col("texts"), F.lit("verse")))
    docs = spark.createDataFrame([(i, f"It rained all day.\nThe of and in to a own{i} word{i} mine{i}.\nNothing (at all) was found there! No.") for i in range(20)], "doc_id long, text string")
    read = {}

    def counted(df, name, *a, write=decision.materialize):
        out = write(df, name, *a)
        read[name] = out.count()
        return out

    monkeypatch.setattr(decision, "materialize", counted)
    got = verify.verify_texts(docs, over).groupBy("no", "status").count().collect()
    assert {(r.no, r.status): r["count"] for r in got} == {(0, "baseless"): 20, (1, "verified"): 20, (2, "baseless"): 20, (3, "baseless"): 20}
    # the second has words of an entry, the third a mark
    assert read["reviewed"] == 40


def test_similarity_that_is_wanted_from_a_threshold_on(spark):
    draw = random.Random(11)
    made = lambda: " ".join(draw.choice(["ab", "ba", "abc", "cab", "d"]) for _ in range(draw.randint(0, 9)))
    rows = spark.createDataFrame([(made(), made()) for _ in range(400)] + [("", ""), (None, "a")], "a string, b string")
    got = rows.select(F.round(fuzzy.similarity(F.col("a"), F.col("b")), 6).alias("all"), F.round(fuzzy.similarity(F.col("a"), F.col("b"), 0.6), 6).alias("some")).collect()
    assert all(r.some == r.all for r in got if r.all is not None and r.all >= 0.6) and all(r.some is None or r.some == r.all for r in got)
    assert sum(r.some is None for r in got) > 50 and sum(r.some is not None for r in got) > 50
