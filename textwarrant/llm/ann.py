"""Approximate nearest neighbours by shifted Hilbert curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarrant.tables import materialize

#: Curves, the dimensions that vectors are projected to and bits of each.
ORDERINGS = 16
PROJECTED = 16
BITS = 3
SEED = 5
#: The share of all vectors that a query looks at on each curve, at least, rows of a block, and query blocks of one group.
WINDOW = 0.05
BLOCK = 128
SPAN = 64
#: Blocks on both sides that a query looks at first, on one curve, and what scores may differ by between two products.
FIRST = 8
ROUNDING = 1e-9


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of cells (n, d) with coordinates below 2 ** bits, as whole numbers.

    Coordinates are turned to the transposed curve index by undoing its
    rotations and reflections from the top bit down, then by a Gray decode, and
    their bits are interleaved; d * bits is 62 at most.
    """
    x = [c.copy() for c in cells.astype(np.int64).T]
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | ((c ^ turn) >> level) & 1
    return key


def curve_keys(vectors: np.ndarray, ordering: int) -> np.ndarray:
    """Keys of vectors on one curve: projected at random, spread evenly, shifted at random."""
    n, dims = vectors.shape
    draw = np.random.default_rng([SEED, ordering, dims])
    d = min(PROJECTED, dims)
    axes = np.linalg.qr(draw.normal(size=(dims, d)))[0]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    # about uniform in (0, 1): a unit vector's part along an axis deviates by 1 / sqrt(dims)
    spread = 1.0 / (1.0 + np.exp(-1.702 * (unit @ axes) * np.sqrt(dims)))
    cells = ((spread + draw.random(d)) / 2 * (1 << BITS)).astype(np.int64)
    return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def _usable(vector: Column) -> Column:
    """Whether a vector is there, without null or non-finite components, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, window: float = WINDOW, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank, vec_id, score (cosine), nearest first, ties to smaller ids.

    Queries are the rows whose id is divisible by ``every``; each is held against
    all rows but its own. Equal vectors are one point of the search, with their
    k + 1 smallest ids, so that thousands of copies are one row; a row that
    repeats id and vector counts once. Of an id with two vectors each asks and
    each is found, by its better score.

    On each of ORDERINGS curves the points are dealt by range of key; their places
    follow from each partition's count by a prefix sum, and ``block`` places make a
    block. A query looks at its own block and at as many on both sides as make
    ``window`` of all points, one at least; a block's task returns the best of its
    points for each query that looks at it, by exact cosine, and these are merged.
    Queries meet a block in groups of SPAN of their own blocks, so no group holds
    more than a block of points and SPAN blocks of queries, however many rows there
    are. Before that each query looks at FIRST blocks on both sides of its own on
    one curve: blocks return nothing below the (k + 1)th best of these, which
    leaves the result as it is and most of the rows to merge unmade. With vectors that have no structure fewer points would not do: the share
    is what keeps the recall at any size, and the work grows with it.

    Vectors that are null or zero, or hold null or non-finite components, take no
    part; nor do rows without id. Vectors of different dimensions don't compare
    and are searched apart. An empty table finds nothing; other columns don't matter.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & _usable(F.col("v")))
    of_vector = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("rn", F.row_number().over(of_vector)).filter(F.col("rn") <= k + 1)
    points = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # an id with two vectors may be the least of both, so points have numbers of their own
    points = materialize(points.select(F.monotonically_increasing_id().alias("p"), F.col("ids")[0].alias("least"), "ids", "v"), "ann-points")
    asked = rows.filter(F.col("id") % every == 0).join(points.select("p", F.col("v").alias("pv")), F.col("v") == F.col("pv"))
    asked = materialize(asked.select(F.col("id").alias("query_id"), F.col("p").alias("q")).distinct(), "ann-queries")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = points.select("p", "v").mapInArrow(_keyed, "o int, key long, p long")
    keyed = materialize(keyed.repartitionByRange(parts, "o", "key", "p").withColumn("pid", F.spark_partition_id()), "ann-keys")
    counts = keyed.groupBy("o", "pid").agg(F.count(F.lit(1)).alias("n"))
    curve = Window.partitionBy("o")
    ahead = curve.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.ceil((F.sum("n").over(curve) * F.lit(window) / block - 1) / 2).cast("int")
    counts = counts.select(F.col("o").alias("co"), F.col("pid").alias("cp"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), F.greatest(reach, F.lit(1)).alias("reach"))
    placed = keyed.join(counts, (F.col("o") == F.col("co")) & (F.col("pid") == F.col("cp")))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("o", "pid").orderBy("key", "p")) - 1
    placed = materialize(placed.select("o", "p", "reach", F.floor(place / block).cast("int").alias("block")), "ann-places")

    best = k + 1

    def ranked(group: pd.DataFrame) -> pd.DataFrame:
        asks, ids = group["asks"].to_numpy(bool), group["p"].to_numpy()
        if not asks.any() or asks.all():
            return pd.DataFrame({"q": [], "p": [], "score": []}, dtype="float64").astype({"q": "int64", "p": "int64"})
        x = np.stack(group["v"].to_numpy()).astype(np.float64)
        length = np.sqrt((x * x).sum(axis=1))
        score = (x[asks] @ x[~asks].T) / (length[asks][:, None] * length[~asks][None, :])
        # all of those that tie with the last, and reach what the query has already
        least = np.partition(score, -best, axis=1)[:, -best] if score.shape[1] > best else score.min(axis=1)
        least = np.fmax(least, group["floor"].to_numpy(np.float64)[asks])
        query, found = np.nonzero(score >= least[:, None])
        return pd.DataFrame({"q": ids[asks][query], "p": ids[~asks][found], "score": score[query, found]})

    def looked(places: DataFrame, floors: DataFrame | None) -> DataFrame:
        """What queries find in the blocks up to ``reach`` away from their own, a block's best for each query."""
        # groups of a block: the query blocks that look at it, SPAN at a time
        groups = F.sequence(F.lit(0), F.floor(F.col("reach") * 2 / SPAN).cast("int"))
        none = F.lit(None).cast("double")
        held = places.join(points.select("p", "v"), "p").select("o", "block", F.explode(groups).alias("part"), "p", "v", none.alias("floor"), F.lit(False).alias("asks"))
        askers = places.join(asked.select(F.col("q").alias("p")).distinct(), "p").join(points.select("p", "v"), "p")
        askers = askers.withColumn("floor", none) if floors is None else askers.join(floors, "p", "left")
        near = F.sequence(F.greatest(F.col("block") - F.col("reach"), F.lit(0)), F.col("block") + F.col("reach"))
        askers = askers.select("o", "p", "v", "reach", "floor", F.col("block").alias("own"), F.explode(near).alias("block"))
        part = F.floor((F.col("own") - F.col("block") + F.col("reach")) / SPAN).cast("int")
        askers = askers.select("o", "block", part.alias("part"), "p", "v", "floor", F.lit(True).alias("asks"))
        return held.unionByName(askers).groupBy("o", "block", "part").applyInPandas(ranked, "q long, p long, score double")

    first = looked(placed.filter(F.col("o") % ORDERINGS == 0).withColumn("reach", F.least("reach", F.lit(FIRST))), None)
    last = Window.partitionBy("q").orderBy(F.desc("score"), "p")
    floors = first.withColumn("rn", F.row_number().over(last)).filter(F.col("rn") == best)
    floors = materialize(floors.select(F.col("q").alias("p"), (F.col("score") - F.lit(ROUNDING)).alias("floor")), "ann-floors")
    found = looked(placed, floors)
    found = found.groupBy("q", "p").agg(F.max("score").alias("score")).join(points.select("p", "least", "ids"), "p")
    found = found.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "least", "p"))).filter(F.col("rn") <= best)
    pairs = asked.join(found, "q").select("query_id", "score", F.explode("ids").alias("vec_id"))
    pairs = pairs.filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A curve's number tells the dimensions as well: vectors of each have curves of their own."""
    for batch in batches:
        sizes = batch.column(1).value_lengths().to_numpy()
        for dims in np.unique(sizes).tolist():
            own = batch.filter(pa.array(sizes == dims))
            x = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, dims)
            for o in range(ORDERINGS):
                number = np.full(len(x), dims * ORDERINGS + o, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(curve_keys(x, o)), own.column(0)], names=["o", "key", "p"])
