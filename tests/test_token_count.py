"""Words counted without being made."""

import re
import time

from pyspark.sql import functions as F

from textwarrant.functions.text import SPACE, token_count, token_spans


def test_the_count_is_that_of_the_spans(spark):
    texts = [None, "", " ", "a", "a b", "--", " - a -b- c_ ؟ سلام, 12\n\nx", "a b c\x1cd\x0be", "é!\U0001d400 \U0001f600 \U0001f600x", "...a...b ...", "İI ßẞ ª² ①", "=" * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.a == (None if r.t is None else r.b) for r in rows.select("t", token_count(F.col("t")).alias("a"), F.size(token_spans(F.col("t"))).alias("b")).collect())
    assert all(bool(re.match(f"[{SPACE}]", chr(c))) == chr(c).isspace() for c in range(0x110000))


def test_long_runs_of_signs_take_one_pass(spark):
    rows = spark.createDataFrame([("=" * 3_000_000 + " a",)], "t string")
    start = time.time()
    assert rows.select(token_count(F.col("t"))).first()[0] == 1 and time.time() - start < 20
