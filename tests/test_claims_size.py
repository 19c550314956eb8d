"""Claims of any length and number."""

import json

import pytest
from pyspark.sql import functions as F

from textwarrant.functions import parse


@pytest.mark.parametrize("claims", [["x" * 300_000, "y"], ['"\\' * 100_000], ["a\n"] * 50_000, ["ß  \\\\" * 20_000, " "]])
def test_long_answers_are_read_whole(spark, claims):
    rows = spark.createDataFrame([(json.dumps({"claims": claims}),), (json.dumps({"claims": claims})[:-1],)], "answer string")
    found = rows.select(parse.strict_claims(F.col("answer")).alias("c")).collect()
    assert found[0]["c"] == [c.strip(" ") for c in claims if c.strip(" ")] and found[1]["c"] is None
