"""Hard negatives: blocks along a Hilbert curve, read where interval arithmetic says that a window reaches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarrant.llm.ann import curve_keys
from textwarrant.tables import materialize

#: Rows of a block, blocks of a zone (read by one task), anchors of a group.
BLOCK = 256
ZONE = 32
GROUP = 1024
#: Whole numbers up to here are exact in a double.
EXACT = float(1 << 53)
#: What a score has to be at least for a task to return it: 64 bits.
LARGEST = 1 << 63

_BLOCKS = "pid int, seq int, dims int, label long, ids array<long>, v array<double>, lo array<double>, hi array<double>, anchors int"
_PICKED = "grp long, zone long, block long, anchors array<int>"
_FOUND = "anchor long, win int, id long, score long"


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _whole(x: Column) -> Column:
    """The floor of a double as a double; those from 2^52 on have no fraction."""
    return F.when(F.abs(x) < F.lit(float(1 << 52)), F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, v) with the number of dimensions and the place on the curve."""
    for batch in batches:
        sizes = batch.column("v").value_lengths().to_numpy()
        for dims in np.unique(sizes).tolist():
            own = batch.filter(pa.array(sizes == dims))
            keys = np.zeros(own.num_rows, np.int64)
            if dims:
                x = _matrix(own.column("v"), dims)
                # large components would overflow where they are squared, and zero has no direction
                x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
                keys = curve_keys(np.where(np.any(x != 0, axis=1, keepdims=True), x, 1.0), 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(own.num_rows, dims, np.int32)), pa.array(keys), *own.columns], names=["dims", "key", *own.schema.names])


def _blocked(block: int, every: int):
    """Blocks of sorted rows: each of one label and one number of dimensions, with the least and the most of each dimension."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seq, before = TaskContext.get().partitionId(), 0, 0
        held, size = [], 0

        def made(rows: pa.Table) -> pa.RecordBatch:
            nonlocal seq, before
            dims, label = rows.column("dims")[0].as_py(), rows.column("label")[0].as_py()
            ids = rows.column("id").combine_chunks()
            flat = pa.concat_arrays([c.flatten() for c in rows.column("v").chunks])
            x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dims)
            numbers = [pa.array([n], pa.int32()) for n in (pid, seq, dims)]
            # an anchor's number within its partition gives it a group
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (ids, flat, pa.array(x.min(axis=0)), pa.array(x.max(axis=0)))]
            out = pa.RecordBatch.from_arrays([*numbers, pa.array([label], pa.int64()), *arrays, pa.array([before], pa.int32())], names=[c.split()[0] for c in _BLOCKS.split(", ")])
            seq += 1
            before += int((ids.to_numpy() % every == 0).sum())
            return out

        for batch in batches:
            kind = np.stack([batch.column("dims").to_numpy(), batch.column("label").to_numpy()])
            edges = np.r_[0, np.flatnonzero((kind[:, 1:] != kind[:, :-1]).any(axis=0)) + 1, batch.num_rows]
            for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if held and (held[0].column("dims")[0], held[0].column("label")[0]) != (batch.column("dims")[start], batch.column("label")[start]):
                    yield made(pa.Table.from_batches(held))
                    held, size = [], 0
                while start < stop:
                    part = batch.slice(start, min(block - size, stop - start))
                    held.append(part)
                    size += part.num_rows
                    start += part.num_rows
                    if size == block:
                        yield made(pa.Table.from_batches(held))
                        held, size = [], 0
        if held:
            yield made(pa.Table.from_batches(held))

    return cut


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of whole numbers held as doubles: doubles where they are exact, else Python's integers."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return a @ b.T
    whole = lambda x: np.array([[int(c) for c in row] for row in x.tolist()], object)
    return whole(a) @ whole(b).T


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that an anchor's product with any row of a block can be, by the block's zone map."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    if not anchors.size or not lo.size:
        zero = np.zeros((len(anchors), len(lo)))
        return zero, zero
    if np.abs(anchors).max() * max(np.abs(lo).max(), np.abs(hi).max()) * anchors.shape[1] >= EXACT:
        # sums that round may miss a window's edge; such blocks are read
        open_ = np.full((len(anchors), len(lo)), np.inf)
        return -open_, open_
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


def first_k(anchor: np.ndarray, win: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each anchor's window, by score, ties to smaller ids."""
    order = np.lexsort((ids, -score, win, anchor))
    anchor, win = anchor[order], win[order]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (win[1:] != win[:-1])] if len(order) else np.zeros(0, bool)
    begun = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - begun < k]


def _search(blocks: DataFrame, groups: DataFrame, same: bool, k: int, name: str) -> DataFrame:
    """(anchor, win, id, score): the first ``k`` rows in each anchor's windows; anchors by their numbers.

    ``groups`` has a row for each group of anchors: grp, dims, and of each anchor
    its number, id, label and vector, and the ends of its windows, bottom and top. Rows of an anchor's own label
    count if ``same``, else those of other labels.

    First the blocks' zone maps alone meet the groups, and bounds say which
    anchors have to read which block; then the blocks that any anchor of a group
    reads are sent to it, a zone's at a time, and each task returns the first k.
    """
    zones = blocks.select("zone", "block", "dims", "label", "lo", "hi")
    # a group meets the zone maps of ZONE * ZONE blocks at a time
    maps = zones.withColumn("chunk", F.floor(F.col("zone") / ZONE))
    chunks = maps.select("dims", "chunk").distinct()
    asked = groups.join(chunks, "dims")

    def windows(g: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = np.asarray(g["v"], np.float64).reshape(len(g["ids"]), g["dims"])
        return v, np.asarray(g["bottom"], np.float64).reshape(len(v), -1), np.asarray(g["top"], np.float64).reshape(len(v), -1)

    def picked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            g = left.iloc[0]
            labels, (v, bottom, top) = np.asarray(g["labels"]), windows(g)
            lo, hi = (np.stack(right[c].to_numpy()).astype(np.float64) for c in ("lo", "hi"))
            least, most = bounds(v, lo, hi)
            fits = (labels[:, None] == right["label"].to_numpy()[None, :]) == same
            met = np.zeros_like(fits)
            for w in range(bottom.shape[1]):
                met |= (most >= bottom[:, w : w + 1]) & (least <= top[:, w : w + 1])
            for j in np.flatnonzero((met & fits).any(axis=0)).tolist():
                out.append((g["grp"], right["in"].iloc[j], right["block"].iloc[j], np.flatnonzero(met[:, j] & fits[:, j]).astype(np.int32)))
        return pd.DataFrame(out, columns=["grp", "zone", "block", "anchors"])

    # the maps are sent to each group's key by a join on the chunk, which every group has
    # new names, as both sides of a cogroup come from the same tables
    near = asked.select(F.col("grp").alias("to"), "dims", "chunk").join(maps, ["dims", "chunk"])
    near = near.select("to", F.col("chunk").alias("of"), F.col("zone").alias("in"), *[F.col(c).alias(c) for c in ("block", "label", "lo", "hi")])
    need = asked.groupBy("grp", "chunk").cogroup(near.groupBy("to", "of")).applyInPandas(picked, _PICKED)
    need = materialize(need, f"negatives-{name}-needed")

    def read(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(left) and len(right):
            g = left.iloc[0]
            numbers, ids, (v, bottom, top) = np.asarray(g["numbers"]), np.asarray(g["ids"]), windows(g)
            for block in right.itertuples():
                at = np.asarray(block.anchors)
                own = np.asarray(block.found)
                s = scores(v[at], np.asarray(block.v, np.float64).reshape(len(own), v.shape[1]))
                for w in range(bottom.shape[1]):
                    inside = (s >= bottom[at, w : w + 1]) & (s <= top[at, w : w + 1]) & (s < LARGEST) & (s >= -LARGEST)
                    if same:
                        inside &= ids[at][:, None] != own[None, :]
                    if not inside.any():
                        continue
                    if inside.shape[1] > k and s.dtype != object:
                        kept = np.where(inside, s, -np.inf)
                        inside &= kept >= np.partition(kept, -k, axis=1)[:, [-k]]
                    i, j = np.nonzero(inside)
                    found.append((numbers[at][i], np.full(len(i), w, np.int32), own[j], s[i, j].astype(np.int64)))
        anchor, win, other, score = (np.concatenate(c) for c in zip(*found, strict=True))
        best = first_k(anchor, win, other, score, k)
        return pd.DataFrame({"anchor": anchor[best], "win": win[best], "id": other[best], "score": score[best]})

    sent = need.join(blocks.select("block", "ids", "v"), "block").select(F.col("grp").alias("to"), F.col("zone").alias("of"), F.col("anchors").alias("anchors"), F.col("ids").alias("found"), F.col("v").alias("v"))
    asking = need.select("grp", "zone").distinct().join(groups, "grp")
    found = asking.groupBy("grp", "zone").cogroup(sent.groupBy("to", "of")).applyInPandas(read, _FOUND)
    order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    k: int = 5,
    positives: int = 5,
    every: int = 100,
    share: int = 80,
    scale: int = 256,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first ``k`` hard negatives of each anchor and positive.

    Anchors are the rows whose id is divisible by ``every``. Components count as
    floor(scale * x); a score is an integer inner product. An anchor's positives
    are its best ``positives`` other rows of the same label; a negative is a row
    of another label whose score lies between ``share`` percent of the
    positive's and the positive's own. Higher scores come first, ties by id.

    Rows lie in blocks along a Hilbert curve within their label, written as
    Parquet with the least and the most of each dimension. An anchor's window of
    scores (for positives: from its fifth best in its own block up) is held
    against what interval arithmetic allows a block; only blocks that it reaches
    are read. A task holds a group of GROUP anchors and one zone of ZONE blocks.

    Rows without id, label or vector take no part, nor do those with null or
    non-finite components; zero vectors do. Vectors of different dimensions
    are not compared. A row that repeats id, label and vector counts once; rows
    of one id that differ each count, but are never positives of each other. Scores that do not fit 64 bits don't
    count. An empty table has no anchors; other columns don't matter.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: _whole(x * F.lit(float(scale))))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & _usable(F.col(vector_col).cast("array<double>")))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v")).filter(_usable(F.col("v"))).distinct()
    keyed = materialize(rows.mapInArrow(_keyed, "dims int, key long, id long, label long, v array<double>"), "negatives-rows")

    ordered = keyed.repartitionByRange(parts, "dims", "label", "key", "id").sortWithinPartitions("dims", "label", "key", "id")
    cut = materialize(ordered.mapInArrow(_blocked(block, every), _BLOCKS), "negatives-cut")
    # places of blocks and anchors over all partitions: a prefix sum over one row for each
    own = F.size(F.filter("ids", lambda i: i % every == 0))
    sums = cut.groupBy("pid").agg(F.count(F.lit(1)).alias("blocks"), F.sum(own).alias("asking"))
    ahead = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("pid", F.coalesce(F.sum("blocks").over(ahead), F.lit(0)).alias("blocks"), F.coalesce(F.sum("asking").over(ahead), F.lit(0)).alias("asking"))
    placed = cut.join(sums, "pid").withColumn("block", F.col("blocks") + F.col("seq"))
    placed = placed.withColumn("zone", F.floor(F.col("block") / ZONE)).withColumn("first", F.col("asking") + F.col("anchors"))
    blocks = materialize(placed.select("zone", "block", "dims", "label", "first", "ids", "v", "lo", "hi"), "negatives-blocks")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's anchors, each with the score of its last positive within the block, or none."""
        for batch in batches:
            for row in range(batch.num_rows):
                block_ = batch.slice(row, 1)
                ids = block_.column("ids").flatten().to_numpy()
                at = np.flatnonzero(ids % every == 0)
                if not len(at):
                    continue
                dims, label, first = (block_.column(c)[0].as_py() for c in ("dims", "label", "first"))
                x = block_.column("v").flatten().to_numpy().reshape(len(ids), dims)
                s = scores(x[at], x)
                floor = np.full(len(at), -np.inf)
                if s.dtype != object and (ids[None, :] != ids[at][:, None]).sum(axis=1).min() >= positives:
                    others = np.where(ids[None, :] == ids[at][:, None], -np.inf, s)
                    floor = np.partition(others, -positives, axis=1)[:, -positives]
                offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * dims)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(((first + np.arange(len(at))) // GROUP) + (dims << 40)),
                        pa.array(first + np.arange(len(at))),
                        pa.array(np.full(len(at), dims, np.int32)),
                        pa.array(ids[at]),
                        pa.array(np.full(len(at), label)),
                        pa.ListArray.from_arrays(offsets, pa.array(x[at].ravel())),
                        pa.array(floor),
                    ],
                    names=["grp", "a", "dims", "id", "label", "v", "floor"],
                )

    asking = blocks.select("dims", "label", "first", "ids", "v").mapInArrow(anchors, "grp long, a long, dims int, id long, label long, v array<double>, floor double")
    asking = materialize(asking, "negatives-anchors")
    def packed(anchors: DataFrame) -> DataFrame:
        """A row for each group; low and high are the ends of each anchor's windows."""
        rows = anchors.groupBy("grp", "dims").agg(F.collect_list(F.struct("a", "id", "label", "v", "low", "high")).alias("rows"))
        row = lambda c: F.transform("rows", lambda r: r[c])
        flat = [F.flatten(row(c)).alias(n) for c, n in (("v", "v"), ("low", "bottom"), ("high", "top"))]
        return rows.select("grp", "dims", row("a").alias("numbers"), row("id").alias("ids"), row("label").alias("labels"), *flat)

    groups = packed(asking.withColumns({"low": F.array("floor"), "high": F.array(F.lit(float("inf")))}))
    chosen = materialize(_search(blocks, materialize(groups, "negatives-groups"), True, positives, "positives"), "negatives-positives")

    # the windows of an anchor's positives; where there are fewer, windows that nothing is in
    low = F.ceil(F.col("score").cast("decimal(20,0)") * share / 100).cast("double")
    span = F.struct(low.alias("low"), F.col("score").cast("double").alias("high"))
    spans = chosen.groupBy(F.col("anchor").alias("a")).agg(F.map_from_entries(F.collect_list(F.struct("rank", span.alias("span")))).alias("spans"))
    edge = lambda c, none: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda r: F.coalesce(F.element_at("spans", r)[c], F.lit(none)))
    groups = packed(asking.join(spans, "a").withColumns({"low": edge("low", float("inf")), "high": edge("high", float("-inf"))}))
    found = _search(blocks, materialize(groups, "negatives-windows"), False, k, "negatives")
    of_number = asking.select(F.col("a").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = chosen.join(of_number, "anchor").select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("win"))
    return found.join(pairs, ["anchor", "win"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
