"""Near duplicates by SimHash, candidates by pigeonring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from textwarrant.llm.components import connected_components
from textwarrant.tables import materialize

BITS = 64
SEED = 42
#: Shingles hashed at a time, and fingerprints of one key that one task compares at a time.
CHUNK = 1 << 16
BLOCK = 4096
SMALL_RUN = 48


def _fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = ends - np.fromiter(map(len, words), np.int64, len(words))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n], ends[min(shingle, len(words)) - 1 :]
    counts = np.zeros(8 * 256, np.int64)
    column = np.arange(8) * 256
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + column).ravel(), minlength=8 * 256)
    ones = counts.reshape(8, 256) @ _BYTE_BITS
    return int(np.packbits((2 * ones > n).ravel(), bitorder="little").view("<i8")[0])


#: bytes.split() parts words at exactly the bytes 09-0D and 20.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """SimHash of the XXH64 hashes of all word shingles, repeats counted.

    Zero for a null text and one without words; a text of fewer words than a
    shingle has one shingle, all of it.
    """

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_fingerprint(t, shingle) for t in texts], dtype="int64")

    return F.pandas_udf(of, LongType())(text)


def ring_segments(budget: int) -> list[int]:
    """Masks of the ring's segments: three more than the bits that may differ."""
    m = budget + 3
    cuts = [BITS * i // m for i in range(m + 1)]
    return [((1 << b) - (1 << a)) & ((1 << BITS) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def ring_keys(budget: int) -> list[int]:
    """The masks whose equality makes a candidate.

    Where at most ``budget`` of 64 bits differ, the differences x of m segments
    on a ring have some start from which every chain of l segments holds at most
    l * budget / m of them (the pigeonring principle). Listed are the sets of
    three clean segments - the first one among them - that such chains allow;
    the others that a chain leaves open differ. As m - budget = 3 segments are
    clean in any case, each pair within the budget has such a set.
    """
    masks = ring_segments(budget)
    m = len(masks)
    found = set()
    for start in range(m):
        for rest in combinations(range(1, m), 2):
            dirty = [d for d in range(1, m) if d not in rest]
            if all(sum(d < l for d in dirty) <= l * budget // m for l in range(1, m + 1)):
                found.add(masks[start] | masks[(start + rest[0]) % m] | masks[(start + rest[1]) % m])
    return sorted(found)


def within(x: np.ndarray, budget: int) -> np.ndarray:
    """Which differences x pass the ring's chains, and then the full Hamming check."""
    masks = ring_segments(budget)
    m = len(masks)
    parts = [np.bitwise_count(x & np.uint64(k)).astype(np.int16) for k in masks]
    viable = np.zeros(len(x), bool)
    for start in range(m):
        chain, fits = np.zeros(len(x), np.int16), np.ones(len(x), bool)
        for l in range(1, m):
            chain = chain + parts[(start + l - 1) % m]
            fits &= chain <= l * budget // m
        viable |= fits
    found = np.zeros(len(x), bool)
    found[viable] = np.bitwise_count(x[viable]) <= budget
    return found


class _Forest:
    """Union-find over fingerprints; keeps links that join two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        if (x := self.root(a)) == (y := self.root(b)):
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _run_links(keys: np.ndarray, fps: np.ndarray, budget: int, forest: _Forest) -> list[tuple[int, int]]:
    """Links inside the runs of equal keys; only those that join two trees."""
    out: list[tuple[int, int]] = []
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(edge)
    size_at = np.repeat(sizes, sizes)
    left_in_run = np.repeat(edge[1:], sizes) - np.arange(len(keys))
    for d in range(1, min(SMALL_RUN, int(sizes.max(initial=0)))):
        i = np.flatnonzero((size_at <= SMALL_RUN) & (left_in_run > d))
        ok = within(fps[i] ^ fps[i + d], budget)
        out += [(a, b) for a, b in zip(fps[i[ok]].tolist(), fps[i[ok] + d].tolist(), strict=True) if forest.join(a, b)]
    for r in np.flatnonzero(sizes > SMALL_RUN):
        rest = fps[edge[r] : edge[r + 1]]
        todo = [rest[0]]
        rest = rest[1:]
        while len(rest):
            if not todo:
                todo, rest = [rest[0]], rest[1:]
            u = todo.pop()
            near = within(rest ^ u, budget)
            todo += list(rest[near])
            out += [(int(u), b) for b in rest[near].tolist() if forest.join(int(u), b)]
            rest = rest[~near]
    return out


def fingerprint_links(fps: DataFrame, budget: int = 4) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp), enough of them to join what ``budget`` bits join.

    Fingerprints that share a key meet in one task, which emits a spanning forest
    of their links, never all pairs. Of keys with more than BLOCK fingerprints the
    fingerprints are dealt into blocks and each two blocks meet in a task of
    their own, so no task holds more than two blocks of one key.
    """
    masks = ring_keys(budget)
    signed = [k - (1 << BITS) if k >> (BITS - 1) else k for k in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(k)) for k in signed])).alias("t", "part"))
    many = keyed.groupBy("t", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    many = materialize(many.select(F.col("t").alias("ht"), F.col("part").alias("hp"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "simhash-large-keys")
    keyed = keyed.join(many, (F.col("t") == F.col("ht")) & (F.col("part") == F.col("hp")), "left")
    own = F.pmod(F.hash("fp"), F.col("blocks"))
    other = F.transform(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1), lambda x: F.coalesce(F.least(own, x) * F.col("blocks") + F.greatest(own, x), F.lit(0)))
    keyed = keyed.select("fp", "t", "part", F.explode(other).alias("pair"))
    dealt = keyed.repartition("t", "part", "pair").sortWithinPartitions("t", "part", "pair", "fp")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        forest = _Forest()
        held: list[np.ndarray] = []
        for batch in batches:
            t, part, pair, fp = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("t", "part", "pair", "fp"))
            rows = np.stack([t.astype(np.int64), part, pair.astype(np.int64), fp])
            rows = np.concatenate([*held, rows], axis=1)
            same = (rows[:3] == rows[:3, -1:]).all(axis=0)
            whole = len(same) - (np.argmin(same[::-1]) if not same.all() else len(same))
            held = [rows[:, whole:]]
            if whole:
                yield _as_batch(_keyed_links(rows[:, :whole], budget, forest), schema)
            if len(forest.up) > 1_000_000:
                forest = _Forest()
        if held and held[0].shape[1]:
            yield _as_batch(_keyed_links(held[0], budget, forest), schema)

    return dealt.mapInArrow(links, "a long, b long").distinct()


def _keyed_links(rows: np.ndarray, budget: int, forest: _Forest) -> list[tuple[int, int]]:
    new = np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)]
    return _run_links(np.cumsum(new), np.ascontiguousarray(rows[3]).view(np.uint64), budget, forest)


def _as_batch(links: list[tuple[int, int]], schema: pa.Schema) -> pa.RecordBatch:
    pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)


def near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint and component: (id_col, fp, component_id).

    Fingerprints link at ``budget`` or fewer differing bits; a component's id is
    the smallest document id in it. Texts without words, null ones too, have the
    fingerprint zero and link like any other. Repeated rows give repeated rows.
    An id may be null; it is never the smallest of a component with others. Texts
    of any length count whole, their shingles hashed a chunk at a time; an empty table gives an empty one; other columns are not looked at.
    """
    prints = materialize(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")), "simhash-prints")
    least = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = connected_components(fingerprint_links(least.select("fp"), budget))
    roots = materialize(roots.join(least, F.col("node") == F.col("fp")).select("node", "root", "least"), "simhash-roots")
    parts = roots.groupBy("root").agg(F.min("least").alias("component"))
    linked = roots.join(parts, "root").select(F.col("node").alias("fp"), "component")
    of_print = materialize(least.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "simhash-components")
    return prints.join(of_print, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _held(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, _id, _digest, _text) of each row; a null text is the empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.unhex(F.md5(text)).alias("_digest"), text.alias("_text"))


def _least(*by: str) -> list[Column]:
    """The first row of a group: the smallest id, no id after all others, then the digest."""
    return [F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", *by)).alias("first")]


def _once(held: DataFrame, chosen: DataFrame, again: DataFrame) -> DataFrame:
    """The rows of ``held`` whose id and digest are ``chosen``; of rows that repeat both, one."""
    chosen = chosen.select(F.col("_id").alias("_i"), F.col("_digest").alias("_d"))
    again = again.select(F.col("_id").alias("_i"), F.col("_digest").alias("_d"))
    def on(a: DataFrame, b: DataFrame) -> Column:
        return a["_id"].eqNullSafe(b["_i"]) & (a["_digest"] == b["_d"])

    kept = held.join(chosen, on(held, chosen), "left_semi")
    single = kept.join(again, on(kept, again), "left_anti")
    return single.unionByName(kept.join(again, on(kept, again), "left_semi").dropDuplicates(["_id", "_digest"]))


def _repeated(prints: DataFrame) -> DataFrame:
    found = prints.groupBy("_id", "_digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return materialize(found.select("_id", "_digest"), "simhash-repeated")


def similar_texts(texts: DataFrame, shingle: int = 5, similarity: str = "0.8") -> DataFrame:
    """Links (a, b) among ``texts`` (tid, text; tid unique) that join all pairs of Jaccard ``similarity`` or more.

    Exact: texts compare by their sets of word shingles, as 64-bit hashes. In one
    order of all shingles, two sets that are so similar share one of the first
    n - ceil(similarity * n) + 1 of each, so these meet in an equi-join; lengths
    and places in the order rule out most of the pairs that meet, and the sets
    decide. Shingles that a sample calls common come last in the order, which
    changes the work and never the result.

    Where more than SMALL_RUN sets meet, each is held first against one of its
    length; only those that this doesn't join are then held against one another,
    so a group of many copies makes as many pairs as it has members. Texts
    without words are alike.
    """
    common = _common_shingles(texts, shingle)
    keyed = texts.select("tid", "text").mapInArrow(_prefixes(shingle, similarity, common), "key long, pair long, n long, place long, tid long")
    dealt = keyed.repartition("key", "pair").sortWithinPartitions("key", "pair", "n", "tid")
    met = materialize(dealt.mapInArrow(_meetings(similarity), "large boolean, key long, pair long, n long, place long, a long, b long"), "similar-met")
    links = _verified(met.filter("not large").select("a", "b").distinct(), texts, shingle, similarity)
    large = met.filter("large").select("key", "pair", "n", "place", F.col("a").alias("tid"))
    if large.isEmpty():
        return links
    roots = materialize(connected_components(links), "similar-roots")
    large = large.join(roots, F.col("tid") == F.col("node"), "left").withColumn("part", F.coalesce("root", "tid")).drop("node", "root")
    dealt = large.repartition("key", "pair").sortWithinPartitions("key", "pair", "n", "tid")
    rest = dealt.select("key", "pair", "n", "place", "tid", "part").mapInArrow(_partings(similarity), "a long, b long").distinct()
    return links.unionByName(_verified(rest, texts, shingle, similarity))


#: The share of texts whose shingles are counted to order them, in how many of these a common one is, and how many are kept.
#: A share, as of a fixed number of texts a shingle is held uncommon by ever more, and pairs grow as their square.
ORDER_SHARE = 1 / 12
COMMON_FROM = 2
COMMON_KEPT = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def _shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; all of a text of fewer words is one."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    k = min(shingle, len(words))
    out = np.full(len(words) - k + 1 if words else 0, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + len(out)]) * _ODD
        out ^= out >> _SHIFT
    return np.unique(out)


def _common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts hold, sorted, and in about how many texts each is, by a sample of them."""
    sample = texts.filter(F.pmod(F.xxhash64("tid"), F.lit(1 << 20)) < ORDER_SHARE * (1 << 20)).select("text")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_set(text.as_py(), shingle).view(np.int64))], names=["key"])

    counts = sample.mapInArrow(listed, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON_FROM)
    rows = counts.orderBy(F.desc("n"), "key").limit(COMMON_KEPT).toArrow()
    keys = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows.column("n").to_numpy()[order] / ORDER_SHARE


def _prefixes(shingle: int, similarity: str, common: tuple[np.ndarray, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    num, den = Fraction(similarity).as_integer_ratio()
    keys, holders = common
    # a key that is in more texts than BLOCK is dealt into blocks, each two of which meet
    blocks_of = dict(zip(keys[holders > BLOCK].tolist(), np.ceil(holders[holders > BLOCK] / BLOCK).astype(int).tolist(), strict=True))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = _shingle_set(text.as_py(), shingle)
                n = len(found)
                last = _among(found, keys)
                first = np.concatenate([found[~last], found[last]])[: n + num * n // -den + 1]
                first = first if n else np.zeros(1, np.uint64)
                place, pair = np.arange(len(first)), np.zeros(len(first), np.int64)
                if blocks_of and any(many := [blocks_of.get(k, 0) for k in first.tolist()]):
                    dealt = [(i, min(own, x) * b + max(own, x)) for i, b in enumerate(many) for own in [tid % b if b else 0] for x in range(max(1, b))]
                    place, pair = np.array(dealt, np.int64).T
                held.append(np.stack([first.view(np.int64)[place], pair, np.full(len(place), n), place, np.full(len(place), tid)]))
                size += len(place)
                if size > CHUNK:
                    yield _columns(np.concatenate(held, axis=1), ("key", "pair", "n", "place", "tid"))
                    held, size = [], 0
            if held:
                yield _columns(np.concatenate(held, axis=1), ("key", "pair", "n", "place", "tid"))

    return rows


def _among(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``found`` are among the sorted ``keys``: by search, as a text's few would else be sorted with all keys."""
    if not len(keys):
        return np.zeros(len(found), bool)
    return keys[np.minimum(np.searchsorted(keys, found), len(keys) - 1)] == found


def _columns(rows: np.ndarray, names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r)) for r in rows], names=list(names))


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Columns of the batches as rows of whole numbers, cut where key and pair, the first two, change."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns])
        if not rows.shape[1]:
            continue
        change = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
        if held and (held[0][:2, -1] != rows[:2, 0]).any():
            yield np.concatenate(held, axis=1)
            held = []
        if len(change):
            yield np.concatenate([*held, rows[:, : change[-1] + 1]], axis=1)
            held = []
            rows = rows[:, change[-1] + 1 :]
        held.append(rows)
    if held:
        yield np.concatenate(held, axis=1)


def _possible(n: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether rows i and j of a run, with as many shingles and the key at these places, can be similar."""
    a, b, p, q = n[i], n[j], place[i], place[j]
    most = np.minimum(p, q) + 1 + np.minimum(a - p, b - q) - 1
    return ((a == 0) & (b == 0)) | ((den * np.minimum(a, b) >= num * np.maximum(a, b)) & (most * (num + den) >= num * (a + b)))


def _distinct_pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
    return pairs[pairs["a"] != pairs["b"]]


def _meetings(similarity: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of small runs; of large runs pairs with the first of about the same length, and all members."""
    num, den = Fraction(similarity).as_integer_ratio()
    names = ("key", "pair", "n", "place", "a", "b")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_runs(batches):
            edge = np.flatnonzero(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0), True])
            sizes = np.diff(edge)
            keep = np.repeat(sizes > 1, sizes)
            rows, sizes = rows[:, keep], sizes[sizes > 1]
            edge = np.r_[0, np.cumsum(sizes)]
            _, _, n, place, tid = rows
            size_at = np.repeat(sizes, sizes)
            left = np.repeat(edge[1:], sizes) - np.arange(len(n))
            found = []
            for d in range(1, min(SMALL_RUN, int(sizes.max(initial=0)))):
                i = np.flatnonzero((size_at <= SMALL_RUN) & (left > d))
                i = i[_possible(n, place, i, i + d, num, den)]
                found.append((tid[i], tid[i + d]))
            for r in np.flatnonzero(sizes > SMALL_RUN):
                at, end = edge[r], edge[r + 1]
                while at < end:
                    stop = at + np.searchsorted(n[at:end], n[at] * den // num, "right")
                    j = np.arange(at + 1, stop)
                    j = j[_possible(n, place, np.full(len(j), at), j, num, den)]
                    found.append((np.full(len(j), tid[at]), tid[j]))
                    at = stop
            pairs = _distinct_pairs(found)
            zero = np.zeros(len(pairs), np.int64)
            large = np.concatenate([rows, rows[4:]])[:, size_at > SMALL_RUN]
            for part, kind in ((np.stack([zero, zero, zero, zero, pairs["a"], pairs["b"]]), False), (large, True)):
                if part.shape[1]:
                    batch = _columns(part, names)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.shape[1], kind)), *batch.columns], names=["large", *names])

    return met


def _partings(similarity: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of a run whose parts differ."""
    num, den = Fraction(similarity).as_integer_ratio()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_runs(batches):
            edge = np.flatnonzero(np.r_[True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0), True])
            found, size = [], 0
            for at, end in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                _, _, n, place, tid, part = rows[:, at:end]
                if (part == part[0]).all():
                    continue
                for d in range(1, end - at):
                    i = np.arange(end - at - d)
                    if not (near := den * n[i] >= num * n[i + d]).any():
                        break
                    i = i[near & (part[i] != part[i + d])]
                    i = i[_possible(n, place, i, i + d, num, den)]
                    found.append((tid[i], tid[i + d]))
                    size += len(i)
                    if size > CHUNK:
                        yield pa.RecordBatch.from_pandas(_distinct_pairs(found), preserve_index=False)
                        found, size = [], 0
            if found:
                yield pa.RecordBatch.from_pandas(_distinct_pairs(found), preserve_index=False)

    return pairs


#: Buckets of a set's parities.
PARITIES = 1024


def _of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(tid, text) of the texts in ``pairs``."""
    used = materialize(pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct(), "similar-used")
    return texts.select("tid", "text").join(used, "tid", "left_semi")


def _parities(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, odd = [], []
            for text in batch.column(1):
                found = _shingle_set(text.as_py(), shingle)
                sizes.append(len(found))
                odd.append(np.packbits(np.bincount((found % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(odd, pa.binary())], names=["tid", "n", "odd"])

    return marks


def _not_ruled_out(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(len(total), -1) for k in (4, 5))
            differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            # of sets of t shingles together that differ in x, the Jaccard is (t - x) / (t + x)
            stays = den * (total - differ) >= num * (total + differ)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(stays)) for k in (0, 1)], names=["a", "b"])

    return left


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: str) -> DataFrame:
    """The pairs (a, b) whose shingle sets have Jaccard ``similarity`` or more.

    Parities rule out most pairs before texts are moved: two sets differ in at
    least as many shingles as they have buckets of unlike parity.
    """
    num, den = Fraction(similarity).as_integer_ratio()
    pairs = materialize(pairs, "similar-candidates")
    marks = materialize(_of(pairs, texts).mapInArrow(_parities(shingle), "tid long, n long, odd binary"), "similar-parities")
    a, b = (marks.select(F.col("tid").alias(k), F.col("n").alias(f"n{k}"), F.col("odd").alias(f"o{k}")) for k in ("a", "b"))
    marked = pairs.join(b, "b").join(a, "a").select("a", "b", "na", "nb", "oa", "ob")
    pairs = materialize(marked.mapInArrow(_not_ruled_out(num, den), "a long, b long"), "similar-left")
    texts = materialize(_of(pairs, texts), "similar-left-texts")
    left = texts.select(F.col("tid").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("tid").alias("b"), F.col("text").alias("tb"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            found = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, own = a, _shingle_set(ta.as_py(), shingle)
                other = _shingle_set(tb.as_py(), shingle)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                if shared * (num + den) >= num * (len(own) + len(other)):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return materialize(joined.mapInArrow(similar, "a long, b long"), "similar-links")


def drop_similar(docs: DataFrame, shingle: int = 5, similarity: str = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts: that with the smallest id, a null id after all others.

    Texts link at Jaccard ``similarity`` or more of their sets of word shingles, by
    :func:`similar_texts`; groups are the components of these links. The columns
    are those of ``docs``. An id may repeat or be null: rows go by text, not by id.
    """
    held = _held(docs, id_col, text_col)
    prints = materialize(held.select("_id", "_digest"), "similar-prints")
    again = _repeated(prints)
    least = materialize(prints.groupBy("_digest").agg(*_least()).select("first._id", "_digest"), "similar-distinct")
    texts = _once(held, least, again).select(F.monotonically_increasing_id().alias("tid"), "_id", "_digest", F.col("_text").alias("text"))
    texts = materialize(texts, "similar-texts")
    roots = materialize(connected_components(similar_texts(texts, shingle, similarity)), "similar-parts")
    parts = texts.select("tid", "_id", "_digest").join(roots, F.col("tid") == F.col("node"), "left").withColumn("part", F.coalesce("root", "tid"))
    chosen = materialize(parts.groupBy("part").agg(*_least("_digest")).select("first._id", "first._digest"), "similar-chosen")
    return _once(held, chosen, again).select("_row.*")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that with the smallest id, a null id after all others.

    Rows go by their own fingerprint, not by their id: of an id with two texts
    each counts in its component, and texts without id are as good as others.
    Of rows that repeat id and text one stays.
    """
    held = _held(docs, id_col, text_col)
    prints = materialize(held.select("_id", "_digest", fingerprint(F.col("_text"), shingle).alias("fp")), "simhash-prints")
    least = materialize(prints.groupBy("fp").agg(*_least("_digest")), "simhash-distinct")
    roots = materialize(connected_components(fingerprint_links(least.select("fp"), budget)), "simhash-roots")
    parts = least.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("part"))
    chosen = materialize(parts.agg(F.min("first").alias("first")).select("first._id", "first._digest"), "simhash-chosen")
    return _once(held, chosen, _repeated(prints)).select("_row.*")
