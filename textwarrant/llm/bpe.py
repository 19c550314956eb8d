"""Byte-level BPE: encoding by a fold of ranked merges, decoding by concatenation."""

from __future__ import annotations

import base64
import heapq
import json
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

#: UTF-8 bytes of text whose distinct words are folded together, as one row.
BLOCK_BYTES = 4_000_000
#: Characters from which a text's words are numbered as they are found, not as one list.
LONG_TEXT = 1_000_000
#: The words that a sample of about so many documents holds most often, at most so many, are folded once and sent to all tasks.
SAMPLE_DOCUMENTS = 20_000
LEXICON = 400_000
#: Words of more bytes are merged before the fold, which looks at every pair in every round.
LONG_WORD = 64
#: Characters of a plan's description: the driver keeps one of each run, and the rank map alone has millions.
PLAN_TEXT = 100_000
#: Above any id.
IDS = 1 << 24


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _last_split(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two ids that the merges make of a token's bytes before they make the token; None if they never do."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(rank, i) for i in range(len(parts) - 1) if (rank := ranks.get(parts[i] + parts[i + 1])) is not None]
        if not found:
            return None
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return ranks[parts[0]], ranks[parts[1]]


def merge_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """left id * IDS + right id -> id of the token that the two make together, one pair for each token.

    While nothing is merged across a token's ends, its bytes are merged as if they
    stood alone, so that no other two parts of it ever stand side by side.
    """
    table = {}
    for token, rank in ranks.items():
        if len(token) > 1 and (split := _last_split(token, ranks)):
            table[split[0] * IDS + split[1]] = rank
    return table


class Cells(NamedTuple):
    """The merge table in two flat arrays, and the bits of an id in them; ``end`` is an id of no token."""

    start: list[int]
    cell: list[int]
    bits: int
    end: int


def displaced(table: dict[int, int], ids: int) -> Cells:
    """cell[start[left] + right] = left, merged and 0, of ``bits`` bits each.

    The rows of the sparse table, longest first, lie over one another where their
    filled cells leave gaps, at places drawn until one fits; a cell says whose it
    is. There are three cells an id, of which one is filled.
    """
    bits = (ids + 1).bit_length()
    if 3 * bits + 1 > 63:
        raise ValueError(f"{ids} ids are too many: three must fit a long")
    rows: dict[int, list[int]] = {}
    for pair in table:
        rows.setdefault(pair // IDS, []).append(pair % IDS)
    empty = ((1 << bits) - 1) << 2 * bits
    start, cell = np.zeros(ids + 1, np.int64), np.full(3 * ids + 2, empty, np.int64)
    draw = np.random.default_rng(0)
    for left, rights in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        at = np.array(rights)
        place = next(p for p in iter(lambda: int(draw.integers(0, len(cell) - ids)), None) if (cell[p + at] == empty).all())
        start[left] = place
        cell[place + at] = [(left << 2 * bits) + (table[left * IDS + r] << bits) for r in rights]
    return Cells(start.tolist(), cell.tolist(), bits, ids)


class Literals(NamedTuple):
    """The merge table as two literal arrays, the bits of an id and the id of an end."""

    start: Column
    cells: Column
    bits: int
    end: int


def rank_literals(model: Model) -> Literals:
    """The merge table as literals."""
    return Literals(F.from_json(F.lit(model.start), "array<bigint>"), F.from_json(F.lit(model.cells), "array<bigint>"), model.bits, model.ids)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fold_merges(word: Column, literals: Literals) -> Column:
    """The ids (array<int>) of a word given as the ids of its bytes, array<bigint>.

    An id carries the rank of its pair with the next one, so that a round looks
    up two pairs and no more. Each merges the leftmost pair of the lowest rank; a word of n bytes
    has n - 1 rounds at most, and rounds after the last merge do nothing.
    """
    bits, low_bits, end = literals.bits, F.lit((1 << literals.bits) - 1).cast("long"), F.lit(literals.end).cast("long")
    merges = F.lit(1 << 2 * bits)

    def paired(a: Column, b: Column) -> Column:
        """The merged id before the id of a; ``merges`` or more where the two don't merge."""
        cell = F.get(literals.cells, F.get(literals.start, a) + b) - F.shiftleft(a, 2 * bits)
        return cell.bitwiseAND(F.lit((1 << 3 * bits + 1) - 1)).bitwiseOR(a)

    def at(ids: Column, i: Column) -> Column:
        return F.coalesce(F.get(ids, i).bitwiseAND(low_bits), end)

    def _if(holds: Column, then: Column, otherwise: Column) -> Column:
        return F.call_function("if", holds, then, otherwise)

    def merged(pairs: Column) -> Column:
        # two pairs of one rank are the same pair, so the least one's first place is the leftmost of the lowest rank
        return _let(F.array_min(pairs), lambda low: F.when(low < merges, _let(F.array_position(pairs, low).cast("int"), lambda place: joined(pairs, low, place))).otherwise(pairs))

    def joined(pairs: Column, low: Column, place: Column) -> Column:
        # the place counts from 1, and so is that of the id which goes from 0
        new = F.shiftright(low, bits)
        one = lambda x, i: _if(i == place - F.lit(1), paired(new, at(pairs, place + F.lit(1))), _if(i == place - F.lit(2), paired(x.bitwiseAND(low_bits), new), x))
        return F.filter(F.transform(pairs, lambda x, i: _if(i >= place, x, one(x, i))), lambda _, i: i != place)

    first = F.transform(word, lambda a, i: paired(a, at(word, i + F.lit(1))))
    rounds = F.sequence(F.lit(1), F.greatest(F.size(word) - 1, F.lit(1)))
    return F.transform(F.aggregate(rounds, first, lambda pairs, _: merged(pairs)), lambda x: x.bitwiseAND(low_bits).cast("int"))


def heap_merges(ids: list[int], table: dict[int, int]) -> list[int]:
    """The same merges in n log n steps, for long words."""
    n = len(ids)
    ids, before, after = list(ids), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := table.get(ids[i] * IDS + ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or ids[i] != a or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0 and (new := table.get(ids[left] * IDS + ids[right])) is not None:
                heapq.heappush(heap, (new, left, ids[left], ids[right]))
    return [x for x in ids if x >= 0]


def _word_rows(texts: DataFrame, pattern: str) -> DataFrame:
    """(word, n): distinct words of each batch of texts with their counts; long words are left out."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        for batch in batches:
            held: Counter = Counter()
            for text in batch.column(0):
                held.update(find(text.as_py() or ""))
            held = {w: n for w, n in held.items() if len(w.encode("utf-8", "surrogatepass")) <= LONG_WORD}
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(counted, "word string, n long")


class Model(NamedTuple):
    """What a rank file says: its merges, the tokens taken whole, the ids of the bytes, and the merge table as JSON."""

    pairs: np.ndarray
    merged: np.ndarray
    whole: dict[bytes, int]
    byte_ids: list[int]
    start: str
    cells: str
    bits: int
    ids: int


@lru_cache(maxsize=2)
def read_model(path: str) -> Model:
    """Made once in a process for each path."""
    ranks = read_ranks(path)
    table = merge_table(ranks)
    cells = displaced(table, max(ranks.values()) + 1)
    reached = set(table.values())
    # as whole words, tokens that their own bytes' merges don't reach are taken as they are
    whole = {t: r for t, r in ranks.items() if len(t) > 1 and r not in reached}
    pairs = np.fromiter(table, np.int64, len(table)), np.fromiter(table.values(), np.int32, len(table))
    return Model(*pairs, whole, [ranks[bytes([b])] for b in range(256)], json.dumps(cells.start), json.dumps(cells.cell), cells.bits, cells.end)


def lexicon(docs: DataFrame, pattern: str, fold, byte_ids: Sequence[int], text_col: str, id_col: str) -> pa.RecordBatch:
    """Frequent words (word) and the ids that each is made of (ids).

    From about SAMPLE_DOCUMENTS documents, by a hash of their ids; LEXICON words
    at most. What it leaves out is folded where it is met, so the sample decides
    about time and not about results.
    """
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, docs.count()))
    place = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(11)), F.lit(1 << 20))
    words = _word_rows(docs.filter(place < share * (1 << 20)).select(text_col), pattern).groupBy("word").agg(F.sum("n").alias("n"))
    words = words.filter("n > 1").orderBy(F.desc("n"), "word").limit(LEXICON).select("word")
    of_byte = F.array(*[F.lit(int(i)).cast("long") for i in byte_ids])
    raw = F.hex(F.col("word").cast("binary"))
    unit = F.transform(F.sequence(F.lit(1), F.octet_length("word")), lambda i: F.get(of_byte, F.conv(F.substr(raw, 2 * i - 1, F.lit(2)), 16, 10).cast("int")))
    found = words.repartition(32).select("word", fold(unit).alias("ids")).toArrow().combine_chunks()
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in found.columns]
    return pa.RecordBatch.from_arrays(columns, names=found.column_names)


def _short_descriptions(spark: SparkSession) -> None:
    """Plans are described in PLAN_TEXT characters at most from here on in this session; a shorter setting stays."""
    name = "spark.sql.maxPlanStringLength"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > PLAN_TEXT:
        spark.conf.set(name, PLAN_TEXT)


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Each row's ``keep`` columns, its tokens (array<int>) and the same packed (binary, little-endian 32-bit).

    A text is parted by ``pattern``, each match encoded by itself as its UTF-8
    bytes, without special tokens. Tasks number the distinct words of blocks of
    texts, of BLOCK_BYTES at most unless one text has more; Spark's higher-order
    functions fold the merges over the bytes of each word, by a literal map of
    ranks, and put the texts' ids together by the numbers. Words that ``lexicon``
    holds have been folded before. No text is shuffled, and a task keeps one
    Python process: the lexicon and the words of one block.

    A null or empty text has no tokens. Rows of any kind stay, repeated ones too;
    an empty table gives an empty one. A text of any length is encoded whole. Kept
    columns named ``tokens`` or ``packed`` give way to the operator's. The session
    describes plans in PLAN_TEXT characters at most from then on.
    """
    _short_descriptions(docs.sparkSession)
    key, keep = keep[0], [c for c in keep if c.lower() not in ("tokens", "packed")]
    model = read_model(ranks_path)
    whole, byte_ids = model.whole, model.byte_ids
    kept = StructType([docs.schema[c] for c in keep])
    ids_type = ArrayType(ArrayType(IntegerType()))
    block_type = StructType([StructField("rows", ArrayType(kept)), StructField("places", ids_type), StructField("done", ids_type), StructField("words", ArrayType(ArrayType(LongType())))])
    literals = rank_literals(model)
    fold = lambda w: fold_merges(w, literals)
    frequent = lexicon(docs, pattern, fold, byte_ids, text_col, key)
    sent = docs.sparkSession.sparkContext.broadcast((frequent, model.pairs, model.merged))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern)
        lookup = np.array(byte_ids, np.int64)
        common, keys, merges = sent.value
        base = {w: i for i, w in enumerate(common.column(0).to_pylist())}
        bounds = np.r_[0, np.cumsum(common.column(1).value_lengths().to_numpy())].astype(np.int64)
        known_ids = common.column(1).flatten().to_numpy()
        table: dict[int, int] = {}

        def merged(raw: bytes) -> np.ndarray:
            if raw in whole:
                return np.array([whole[raw]], np.int32)
            if not table:
                table.update(zip(keys.tolist(), merges.tolist(), strict=True))
            return np.array(heap_merges(lookup[np.frombuffer(raw, np.uint8)].tolist(), table), np.int32)

        def block(rows: list[pa.Array], places: list[np.ndarray], seen: dict[str, int]) -> pa.RecordBatch:
            of_base = np.fromiter((base.get(w, -1) for w in seen), np.int64, len(seen))
            raw = {i: w.encode("utf-8", "surrogatepass") for i, (w, n) in enumerate(zip(seen, of_base.tolist(), strict=True)) if n < 0}
            odd = {i: merged(r) for i, r in raw.items() if len(r) > LONG_WORD or r in whole}
            folds = [lookup[np.frombuffer(r, np.uint8)] for i, r in raw.items() if i not in odd]
            # the words to fold come first, then those of the lexicon, then those merged here
            kind = np.where(of_base < 0, 0, 1)
            kind[list(odd)] = 2
            number = np.empty(len(seen), np.int32)
            number[np.argsort(kind, kind="stable")] = np.arange(len(seen), dtype=np.int32)
            used = of_base[kind == 1]
            sizes = [*(bounds[used + 1] - bounds[used]).tolist(), *map(len, odd.values())]
            done = _lists(np.concatenate([_gathered(known_ids, bounds, used), *odd.values()]), sizes)
            flat = np.concatenate([np.zeros(0, np.int64), *folds])
            columns = [
                pa.concat_arrays(rows),
                _lists(number[np.concatenate([np.zeros(0, np.int32), *places])], list(map(len, places))),
                done,
                _lists(flat, list(map(len, folds))),
            ]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], names=["rows", "places", "done", "words"])

        rows, places, seen, size = [], [], _Places(), 0
        for batch in batches:
            row, text = batch.column(0), batch.column(1)
            taken = 0
            for i, bytes_ in enumerate(pc.fill_null(pc.binary_length(text), 0).to_pylist()):
                value = text[i].as_py() or ""
                if len(value) < LONG_TEXT:
                    words = find.findall(value)
                    places.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
                else:
                    places.append(np.fromiter((seen[m.group()] for m in find.finditer(value)), np.int32))
                size += bytes_
                if size >= BLOCK_BYTES:
                    yield block([*rows, row.slice(taken, i + 1 - taken)], places, seen)
                    rows, places, seen, size, taken = [], [], _Places(), 0, i + 1
            if taken < len(row):
                rows.append(row.slice(taken))
        if places:
            yield block(rows, places, seen)

    def ids_of(places: Column, words: Column) -> Column:
        return F.flatten(F.transform(places, lambda p: F.get(words, p)))

    held = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text")).mapInArrow(blocks, block_type)
    words = F.concat(F.transform("words", fold), F.col("done"))
    coded = _let(words, lambda known: F.transform("places", lambda p, i: F.struct(F.get("rows", i).alias("row"), ids_of(p, known).alias("tokens"))))
    # no block is empty; a plain inline would make its array once more, to ask for its size
    coded = held.select(F.inline_outer(coded)).select("row.*", "tokens")
    return coded.withColumn("packed", _joined(F.col("tokens"), [i.to_bytes(4, "little") for i in range(model.ids)]))


class _Places(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _joined(tokens: Column, pieces: Sequence[bytes | None]) -> Column:
    """The bytes of each token, ``pieces[token]``, one after the other.

    Strings are bytes to Spark, which joins arrays of strings only.
    """
    coded = json.dumps([None if p is None else base64.b64encode(p).decode() for p in pieces])
    held = F.from_json(F.lit(coded), "array<binary>").cast("array<string>")
    return F.array_join(F.transform(tokens, lambda i: F.get(held, i)), "").cast("binary")


def _lists(values: np.ndarray, sizes: Sequence[int] | np.ndarray) -> pa.ListArray:
    """``values`` parted into lists of ``sizes``."""
    offsets = np.r_[0, np.cumsum(np.asarray(sizes, np.int64))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _gathered(values: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` at ``places``, one after the other."""
    starts, sizes = bounds[places], bounds[places + 1] - bounds[places]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)].astype(np.int32)


def decode(tokens: Column, ranks_path: str) -> Column:
    """The bytes of token ids (array<int>): their pieces, one after the other; null for null."""
    ranks = read_ranks(ranks_path)
    pieces: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return _joined(tokens, pieces)
