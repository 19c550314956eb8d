"""Words of one text that another holds, in time that grows with their words and not with the product."""

import time

from pyspark.sql import functions as F

from textwarrant.functions import clean


def test_scores_of_odd_texts(spark):
    rows = [(0, "Aa bb bb cc", "bb AA"), (1, "", "a"), (2, None, "a"), (3, "aa", None), (4, "a b", ""), (5, "وكتاب كتاب الكتاب كتب", "الكتاب"), (6, "ال aa", "aa"), (7, "كتابٌ aa", "كتاب")]
    held = spark.createDataFrame(rows, "id int, q string, t string").repartition(1)
    got = {r.id: round(r.s, 6) for r in held.select("id", clean.wording_score(F.col("q"), F.col("t")).alias("s")).collect()}
    assert got == {0: 0.75, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.5, 6: 0.5, 7: 0.5}


def test_texts_of_many_words(spark):
    word = lambda i: "".join(chr(ord("a") + int(d)) for d in str(i))
    quote, text = (" ".join(word(i) for i in range(at, at + 60_000)) for at in (100_000, 200_000))
    rows = spark.createDataFrame([(quote, text)], "q string, t string")
    start = time.time()
    assert rows.select(clean.wording_score(F.col("q"), F.col("t"))).first()[0] == 0.0
    assert time.time() - start < 20
