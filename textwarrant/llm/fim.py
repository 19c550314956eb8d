"""Fill-in-middle: texts cut at units of letters, found by arithmetic on whole words of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before the three parts in an output; a text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are cut, and of 100 that are cut so many have their suffix first.
CUT_SHARE = 90
SPM_SHARE = 20
#: Bytes whose marks are held at once.
CHUNK = 1 << 20

ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
ONE, EIGHT, SEVEN, TOP = np.uint64(1), np.uint64(8), np.uint64(7), np.uint64(56)


def _letters(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is an ASCII letter."""
    low = (words & LOW7) | (ONES * np.uint64(0x20))
    return (low + ONES * np.uint64(0x80 - ord("a"))) & ~(low + ONES * np.uint64(0x80 - ord("z") - 1)) & ~words & HIGH


def _later_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that continues a code point (10xxxxxx)."""
    return words & ~(words << ONE) & HIGH


def unit_ends(data: np.ndarray) -> np.ndarray:
    """The high bit of each byte, of all words but the last, after which a unit ends.

    ``data`` (uint64, little-endian) is UTF-8 and one word more, to look ahead
    into. A unit ends where the next byte neither continues a code point nor is
    a letter after a letter.
    """
    letters, later = _letters(data), _later_bytes(data)
    both = (letters[:-1] & _next(letters)) | _next(later)
    return ~both & HIGH


def _next(marks: np.ndarray) -> np.ndarray:
    """The marks of the following bytes, at the places of the bytes before them."""
    return (marks[:-1] >> EIGHT) | (marks[1:] << TOP)


def _select(marks: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The byte of each word that holds its nth mark, from 1."""
    upto = (marks >> SEVEN) * ONES  # each byte: marks up to and with its own, 8 at most
    reached = ((upto | HIGH) - nth.astype(np.uint64) * ONES) & HIGH
    return 8 - np.bitwise_count(reached).astype(np.int64)


class Units:
    """The units of texts that lie one after the other in ``data``, between ``bounds``.

    Holds a byte and a running count for each word; a word's marks are made
    again where a unit is looked for in it.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.data, self.bounds = data, bounds
        #: A text's last byte ends a unit, whatever the next text begins with.
        ends = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        self.last = np.unique(ends)
        counts = [np.zeros(0, np.uint8)]
        for at in range(0, len(data), CHUNK):
            counts.append(np.bitwise_count(self._marks(at // 8, min(at + CHUNK, len(data)) - at)))
        self.upto = np.r_[0, np.cumsum(np.concatenate(counts), dtype=np.int64)]

    def _marks(self, word: int, size: int) -> np.ndarray:
        """The marks of the ``size`` bytes from a word on."""
        n, at = -(-size // 8), word * 8
        held = np.zeros(8 * (n + 1), np.uint8)
        part = self.data[at : at + 8 * (n + 1)]
        held[: len(part)] = part
        marks = unit_ends(held.view("<u8"))
        flags = marks.view(np.uint8)
        flags[size:] = 0
        own = self.last[np.searchsorted(self.last, at) : np.searchsorted(self.last, at + size)] - at
        flags[own] = 0x80
        return marks

    def before(self, place: np.ndarray) -> np.ndarray:
        """Units that end before each place."""
        word, byte = place // 8, place % 8
        held = self._at(np.minimum(word, max(len(self.upto) - 2, 0)))
        below = (ONE << (EIGHT * byte.astype(np.uint64))) - ONE
        return self.upto[word] + np.where(byte > 0, np.bitwise_count(held & below), 0)

    def end_of(self, unit: np.ndarray) -> np.ndarray:
        """The place after each unit, counted from 1 over all texts; 0 for none."""
        word = np.searchsorted(self.upto, unit, side="left") - 1
        found = np.maximum(word, 0)
        place = found * 8 + _select(self._at(found), np.maximum(unit - self.upto[found], 1)) + 1
        return np.where(unit > 0, place, 0)

    def _at(self, words: np.ndarray) -> np.ndarray:
        """The marks of single words."""
        if not len(self.data):
            return np.zeros(len(words), np.uint64)
        places = words[:, None] * 8 + np.arange(16)
        held = np.where(places < len(self.data), self.data[np.minimum(places, len(self.data) - 1)], 0).astype(np.uint8)
        marks = np.ascontiguousarray(unit_ends(np.ascontiguousarray(held).view("<u8").ravel())[::2])
        flags = marks.view(np.uint8).reshape(-1, 8)
        flags[places[:, :8] >= len(self.data)] = 0
        near = np.searchsorted(self.last, places[:, :8])
        flags[self.last[np.minimum(near, max(len(self.last) - 1, 0))] == places[:, :8]] = 0x80
        return marks


def _code_points(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points between places, counted over a running sum of first bytes."""
    upto = np.zeros(len(data) // CHUNK + 2, np.int64)
    for i, at in enumerate(range(0, len(data), CHUNK)):
        upto[i + 1] = upto[i] + np.count_nonzero((data[at : at + CHUNK] & 0xC0) != 0x80)

    def before(place: int) -> int:
        chunk = place // CHUNK
        return int(upto[chunk]) + int(np.count_nonzero((data[chunk * CHUNK : place] & 0xC0) != 0x80))

    order = {p: before(p) for p in {*begin.tolist(), *end.tolist()}} if len(begin) else {}
    return np.array([order[e] - order[b] for b, e in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)


def cuts(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's units, and the code points of its prefix and of its middle.

    The prefix ends after the smaller of ``first % (n + 1)`` and
    ``second % (n + 1)`` of the n units, the middle after the larger.
    """
    sizes = np.array([0 if s is None else s for s in pc.binary_length(texts).to_pylist()], np.int64)
    bounds = np.r_[0, np.cumsum(sizes)]
    units_of, prefix, middle = (np.zeros(len(sizes), np.int64) for _ in range(3))
    values = texts.fill_null("")
    start = 0
    while start < len(sizes):
        # texts of CHUNK bytes together at most, or one longer text
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + CHUNK, side="right")) - 1)
        part = values.slice(start, stop - start)
        raw, offsets = part.buffers()[2], np.frombuffer(part.buffers()[1], np.int64 if pa.types.is_large_string(part.type) else np.int32)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        own = offsets.astype(np.int64) - int(offsets[0])
        units = Units(data, own)
        begun = units.before(own)
        n = np.diff(begun)
        a, b = first[start:stop] % (n + 1), second[start:stop] % (n + 1)
        low, high = (np.where(u > 0, units.end_of(begun[:-1] + u), own[:-1]) for u in (np.minimum(a, b), np.maximum(a, b)))
        units_of[start:stop] = n
        prefix[start:stop] = _code_points(data, own[:-1], low)
        middle[start:stop] = _code_points(data, low, high)
        start = stop
    return units_of, prefix, middle


def _cut(text: Column, first: Column, second: Column) -> Column:
    """Struct of n, prefix and middle (long), by Arrow batches."""

    def found(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        columns = cuts(texts, one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["n", "prefix", "middle"])

    return F.arrow_udf(found, "n long, prefix long, middle long")(text, first, second)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with fim_n, fim_form, fim_prefix_chars, fim_middle_chars and fim_output.

    A text's units are runs of ASCII letters and single other code points. Where
    it is cut, and whether its suffix comes first, follow from the SHA-256 of its
    id alone, so that a row's output doesn't hang on other rows or on tasks.

    A null text counts as empty, and empty texts stay plain, as do those that hold
    a marker. A null id is hashed as ``1:``. Rows of any kind stay, repeated ones
    too, which get the same output; an empty table gives an empty one. Texts of
    any length are cut whole: a task holds one batch, and marks of CHUNK bytes.
    Columns of these names are replaced; others are left as they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substr(digest, F.lit(1 + 8 * i), F.lit(8)), 16, 10).cast("long") for i in range(4)]
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(marker))
    plain = (text == "") | marked | (h[2] % 100 >= CUT_SHARE)
    form = F.when(plain, "plain").when(h[3] % 100 < SPM_SHARE, "spm").otherwise("psm")
    own = [c for c in docs.columns if c not in ("fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output")]
    cut = docs.select(F.struct(*own).alias("row"), text.alias("text"), form.alias("form"), _cut(text, h[0], h[1]).alias("cut"))
    text, at, size = F.col("text"), F.col("cut.prefix").cast("int"), F.col("cut.middle").cast("int")
    prefix, middle, suffix = F.substr(text, F.lit(1), at), F.substr(text, at + 1, size), F.substr(text, at + size + 1)
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    chars = [F.when(F.col("form") != "plain", F.col(f"cut.{c}")).alias(f"fim_{c}_chars") for c in ("prefix", "middle")]
    return cut.select("row.*", F.col("cut.n").alias("fim_n"), F.col("form").alias("fim_form"), *chars, output.alias("fim_output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of: its three parts in their own order."""
    between = lambda start, stop: F.split_part(F.split_part(output, F.lit(start), F.lit(2)), F.lit(stop), F.lit(1))
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
