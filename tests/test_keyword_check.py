"""What a claim's passages say of it by keywords, by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from textwarrant.operators import review


def test_keyword_check(spark):
    hits = [
        # the best hit's group is raised: 2 passes 1, and 3 of another group isn't raised
        (1, 1, 9.0, 0.9, "a", 1.0, "one"), (1, 2, 8.0, 0.7, "a", 1.6, "two"), (1, 3, 8.5, 0.8, "b", 1.6, "three"), (1, 4, 1.0, 0.9, "b", 1.0, "four"),
        # too small a share; a heading without a word of the claim; both in order
        (2, 1, 5.0, 0.59, "a", 1.0, "one"), (2, 5, 4.0, 0.9, "a", 1.0, "five"), (2, 4, 3.0, 0.6, "b", 1.0, "four"),
        # nothing left
        (3, 5, 5.0, 0.9, "a", 1.0, "five"),
        # a null group is a group; equal scores go to the smaller id; the fourth is not shown
        (4, 4, 2.0, 0.9, None, 1.0, "four"), (4, 3, 2.0, 0.9, None, 1.0, "three"), (4, 2, 2.0, 0.9, None, 1.0, None), (4, 1, 1.0, 1.0, "a", 9.0, "one"),
    ]
    hits = spark.createDataFrame(hits, "query_id int, doc_id int, score double, share double, source string, raise double, said string")
    asked = spark.createDataFrame([(q, t) for q in (1, 2, 3, 4, 5) for t in ("x", "y")], "query_id int, term string")
    headings = spark.createDataFrame([(d, t) for d in (1, 2, 3, 4) for t in ("x", "y")] + [(5, "z")], "doc_id int, term string")
    rows = review.keyword_check(hits, asked, headings, "source", F.col("raise"), F.col("said")).collect()
    assert sorted(tuple(r) for r in rows if r["query_id"] != 4) == [(1, 3, 2, "two"), (2, 1, 4, "four"), (3, 0, None, "not_found"), (5, 0, None, "not_found")]
    assert [tuple(r) for r in rows if r["query_id"] == 4] == [(4, 3, 2, None)]
    assert review.keyword_check(hits.limit(0), asked.limit(0), headings, "source", F.col("raise"), F.col("said")).count() == 0
