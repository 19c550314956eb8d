"""Pieces are Python objects for a few texts at a time."""

from pyspark.sql import functions as F

from textwarrant.functions import text


def test_few_texts_are_held_as_objects(spark):
    """The peak of a worker's objects while it finds the pieces of a batch of 10,000 texts."""

    def find(value):
        import tracemalloc

        tracemalloc.is_tracing() or tracemalloc.start()
        if value == "peak":
            yield 0, 1
            yield 0, 1000 + tracemalloc.get_traced_memory()[1] // 1_000_000
        else:
            yield from ((i, i + 2) for i in range(0, len(value), 2))

    rows = spark.range(4001, numPartitions=1).select(F.when(F.col("id") == 4000, "peak").otherwise("ab" * 100).alias("t"))
    peak = rows.select(text.pieces(F.col("t"), find).alias("p")).agg(F.max(F.col("p")[1]["end"])).first()[0] - 1000
    assert 0 <= peak < 40


def test_pieces_of_odd_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), ("ab\U0001d400c",)], "t string").repartition(1)
    found = {r.t: [tuple(x) for x in r.p] for r in rows.select("t", text.pieces(F.col("t"), lambda v: [(i, i + 2) for i in range(len(v) - 1)]).alias("p")).collect()}
    assert found == {None: [], "": [], "ab\U0001d400c": [("ab", 0, 2), ("b\U0001d400", 1, 3), ("\U0001d400c", 2, 4)]}
