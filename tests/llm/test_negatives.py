"""Hard negatives against all products of a small table."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textwarrant.llm import negatives


def brute(rows, k=5, positives=5, every=100, share=80, scale=256):
    usable = {(i, l, tuple(math.floor(scale * x) for x in v)) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, l, v in usable:
        if i % every:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=True))  # noqa: B023, E731
        near = lambda same: sorted((-score(w), j) for j, m, w in usable if j != i and (m == l) == same and len(w) == len(v))  # noqa: B023, E731
        other = near(False)
        for ps, p in near(True)[:positives]:
            inside = [(s, j) for s, j in other if share * -ps <= 100 * -s <= 100 * -ps]
            out += [(i, p, r, j, -ps, -s) for r, (s, j) in enumerate(inside[:k], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"block": F.lit("x"), "grp": F.lit("y")})
    return sorted(tuple(r) for r in negatives.mine(table, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def random_rows(n, dims, seed, clusters=0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, dims)) if clusters else None
    x = draw.normal(size=(n, dims)) * 0.2 + (centres[draw.integers(0, clusters, n)] if clusters else 0)
    return [(i, int(draw.integers(0, 4)), [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("clusters", [0, 6])
def test_all_windows_are_whole(spark, monkeypatch, clusters):
    monkeypatch.setattr(negatives, "ZONE", 3)
    monkeypatch.setattr(negatives, "GROUP", 7)
    rows = random_rows(1_500, 8, 4 + clusters, clusters)
    assert mined(spark, rows, every=20, block=16) == brute(rows, every=20)


def test_odd_rows(spark):
    rows = random_rows(300, 3, 9)
    copies = [(1_000 + i, i % 2, [0.5, 0.25, -0.125]) for i in range(600)]  # ties, and more than a block of copies
    odd = [(None, 1, [1.0, 2.0, 3.0]), (2_000, None, [1.0, 2.0, 3.0]), (2_100, 1, None), (2_200, 1, [1.0, None, 3.0]), (2_300, 1, [float("nan"), 1.0, 1.0]), (2_400, 1, [float("inf"), 1.0, 1.0])]
    odd += [(2_500, 1, []), (2_501, 1, []), (2_502, 2, []), (2_600, 2, [0.0, 0.0, 0.0]), (2_700, 1, [1.0]), (2_701, 1, [1.0]), (2_702, 2, [0.9]), (2_700, 1, [1.0]), (-100, 1, [0.3, -0.3, 0.3])]
    rows += copies + odd
    assert mined(spark, rows) == brute(rows)


def test_scores_beyond_a_double_are_exact(spark):
    draw = random.Random(2)
    rows = [(i, i % 2, [draw.choice([-1, 1]) * draw.random() * 2.0**20 for _ in range(4)]) for i in range(300)]
    assert any(abs(r[4]) > 1 << 53 for r in brute(rows))
    assert mined(spark, rows) == brute(rows)


def test_blocks_of_clusters_are_not_all_read(spark, monkeypatch):
    """Where vectors have structure, zone maps leave blocks unread."""
    needed = {}
    kept = negatives.materialize
    monkeypatch.setattr(negatives, "materialize", lambda df, name: needed.setdefault(name, kept(df, name)))
    rows = random_rows(2_000, 8, 5, 20)
    mined(spark, rows, every=20, block=16)
    read = needed["negatives-positives-needed"].select(F.sum(F.size("anchors"))).first()[0]
    blocks = needed["negatives-blocks"].count()
    assert read < 0.25 * 100 * blocks


def test_an_empty_table(spark):
    assert mined(spark, []) == []
