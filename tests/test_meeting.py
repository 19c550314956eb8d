"""What two tables have in common is found where the larger is read, and only what meets becomes rows."""

import random

import pytest
from pyspark.sql import functions as F

from textwarrant.operators import decision, match, meeting, verify


def forms_of(n, words, seed, most=30):
    draw = random.Random(seed)
    return ["", *(" ".join(draw.choice(words) for _ in range(draw.randint(1, most))) for _ in range(n - 1))]


@pytest.mark.parametrize("block", [3, 1000])
def test_runs_that_meet(spark, monkeypatch, block):
    monkeypatch.setattr(meeting, "RUNS_AT_ONCE", block)
    forms = forms_of(60, ["a", "b", "cc", "d́"], 1)
    wanted = {" ".join(f.split()[:3]) for f in forms_of(8, ["a", "b", "cc", "x"], 2) if len(f.split()) > 2} | {"x y z"}
    rows = spark.createDataFrame([*enumerate(forms), (99, None)], "id int, form string")
    grams = spark.createDataFrame([(w,) for w in wanted] * 2, "gram string")
    got = sorted(map(tuple, meeting.runs_met(rows, grams, 3).collect()))
    assert got == sorted((k, i, g) for k, f in enumerate(forms) for i in range(len(f.split()) - 2) if (g := " ".join(f.split()[i : i + 3])) in wanted)
    assert got and meeting.runs_met(rows, grams.limit(0), 3).collect() == []


@pytest.mark.parametrize("block", [7, 1000])
def test_pairs_alike_in_length_and_words(spark, monkeypatch, block):
    monkeypatch.setattr(meeting, "FORMS_AT_ONCE", block)
    monkeypatch.setattr(meeting, "TEXTS_AT_ONCE", 5)
    left, right = ([(i, f, len(f), len(f.split())) for i, f in enumerate(forms_of(n, ["a", "bb", "ccc", "d"], s)) if f] for n, s in ((40, 3), (25, 4)))
    rows = spark.createDataFrame(left, "id int, form string, c int, w int")
    forms = spark.createDataFrame(right, "f long, form string, c int, w int")
    got = sorted((r.id, r.f) for r in meeting.alike_in_length_and_words(rows, forms, 0.7).collect())
    ratio = lambda a, b: 2 * min(a, b) / (a + b)
    common = lambda a, b: sum(min(a.split().count(x), b.split().count(x)) for x in set(a.split()))
    want = [
        (i, j)
        for i, a, c, w in left
        for j, b, d, v in right
        if (ratio(c, d) + ratio(w, v)) / 2 >= 0.7 and common(a, b) and (ratio(c, d) + 2 * common(a, b) / (w + v)) / 2 >= 0.7
    ]
    assert got == sorted(want) and 0 < len(want) < len(left) * len(right)


def written(spark, run):
    """Records that shuffles have written while ``run`` ran."""
    store = spark._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_words_of_sentences_are_not_rows(spark):
    """Sentences that share words with every entry and are like none: F3."""
    items = spark.createDataFrame([(i, "verse", [f"the of and in to a own{i} word{i} mine{i}"]) for i in range(40)], "item_id long, kind string, texts array<string>")
    over = decision.corpus(decision.held.spelled(items, F.col("texts"), F.col("kind")))
    texts = [(i, f"the and of to in a thing{i} that{i} no{i}") for i in range(3000)]
    segs = spark.createDataFrame(texts, "seg int, text string")
    assert written(spark, lambda: decision.review(segs, over).count()) < 3 * len(texts)


@pytest.mark.parametrize("many", ["texts", "refs"])
def test_runs_of_the_larger_side_are_not_rows(spark, many):
    """Long texts that share one run with the few of the other side: F21."""
    long_ = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(60)) + " one two three four five") for i in range(200)], "a int, text string")
    few = spark.createDataFrame([(1, "zero one two three four"), (2, "no such run is here")], "b int, text string")
    long_, few = meeting.materialize(long_, "long"), meeting.materialize(few, "few")
    refs, texts = (few, long_) if many == "texts" else (long_, few)
    ref_id, text_id = ("b", "a") if many == "texts" else ("a", "b")
    found = []
    rows = written(spark, lambda: found.extend(match.verbatim_runs(refs, texts, ref_id, text_id).collect()))
    assert {(r.a, r.b, r.n_words) for r in found} == {(i, 1, 4) for i in range(200)}
    assert rows < 200 * 20


def test_segments_are_read_once(spark):
    """What sentences are made from is not worked out for each step of the cascade: F15."""
    items = spark.createDataFrame([(1, ["one two three four five"]), (2, ["six"])], "item_id long, texts array<string>")
    over = decision.corpus(decision.held.spelled(items, F.col("texts"), F.lit("verse")))
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(i):
        read.add(1)
        return ["two three four", "six", "none of it", ""][i % 4]

    segs = spark.range(400).select(F.col("id").alias("seg"), F.explode(F.array(made("id"))).alias("text"))
    got = verify.first_source(segs, over).collect()
    assert {(r.seg % 4, r.entry.item_id, r.stage) for r in got} == {(0, 1, 2), (1, 2, 1)} and len(got) == 200
    assert read.value == 400
