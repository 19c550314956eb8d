"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarrant.tables import materialize

DIMENSIONS = 1024
GRAM = 3
SEED = 7
UNKNOWN = "und"
#: Labelled rows of a language that its prototype is learned from, about.
SAMPLE_PER_LANGUAGE = 4000
#: The cosine from which a text counts as told: above that of 200 to 1,000 random letters and spaces, 0.04 to 0.05.
#: Of the 10,000 labelled texts of sf0.1 two of one word lie below.
LEAST = 0.06
#: Texts whose n-grams are bundled together, n-grams that are bound at a time, and n-grams of one text at a time.
TEXTS_AT_ONCE = 256
GRAMS_AT_ONCE = 4096
CHUNK = 1 << 20


class Encoder:
    """Texts as bundles of bound letters.

    Every letter has a random vector of 1 and -1. An n-gram is the product of its
    letters' vectors, each rotated by its place; a text is the sum of its
    n-grams. What is no letter parts words; a word's edges count as one more
    letter, so a word of one letter has an n-gram as well.
    """

    def __init__(self) -> None:
        self.is_letter = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams as numbers of 21 bits a letter, and their counts."""
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = []
        for at in range(0, len(text), CHUNK):
            # a chunk's n-grams begin in it; the letters of the next are looked at
            piece = text[max(0, at - 1) : at + CHUNK + 1].lower().encode("utf-32-le", "surrogatepass")
            codes = np.frombuffer(piece, np.uint32).astype(np.int64)
            codes = np.r_[0, np.where(self.is_letter[codes], codes, 0), 0]
            middle = codes[1:-1] != 0
            if at:
                middle[0] = False
            if at + CHUNK < len(text):
                middle[-1] = False
            found.append((codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[middle])
        return np.unique(np.concatenate(found), return_counts=True)

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), DIMENSIONS), np.int8)
        for place in range(GRAM):
            codes, where = np.unique(grams >> (21 * (GRAM - 1 - place)) & 0x1FFFFF, return_inverse=True)
            if len(codes):
                out *= np.stack([np.roll(self.letter(int(c)), place) for c in codes])[where]
        return out

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """One row per text; zero where a text has no letters."""
        grams, counts = zip(*map(self.grams, texts), strict=True)
        known, where = np.unique(np.concatenate(grams), return_inverse=True)
        row = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        for at in range(0, len(known), GRAMS_AT_ONCE):
            part = (where >= at) & (where < at + GRAMS_AT_ONCE)
            table = np.zeros((len(texts), min(GRAMS_AT_ONCE, len(known) - at)), np.float32)
            table[row[part], where[part] - at] = np.concatenate(counts)[part]
            out += table @ self.vectors(known[at : at + GRAMS_AT_ONCE]).astype(np.float32)
        return out


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> dict[str, list[float]]:
    """A prototype per language: the bundle of its texts, each of length one.

    ``labelled`` may be of any size. Of a language with more than ``per_language``
    texts about so many are taken, by a hash of their ids; which ones depends on
    nothing else. The driver receives one vector per language.
    """
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = materialize(rows.groupBy(F.col(lang_col).alias("_lang")).agg(F.count(F.lit(1)).alias("_n")), "langid-counts")
    place = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(SEED)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place")).join(counts, F.col("lang") == F.col("_lang"))
    rows = rows.filter(F.col("place") * F.col("_n") < per_language).select("lang", "text")

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                units = _unit(encoder.bundles(texts[at : at + TEXTS_AT_ONCE]))
                for lang, unit in zip(langs[at : at + TEXTS_AT_ONCE], units, strict=True):
                    sums[lang] = sums.get(lang, 0.0) + unit
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], names=["lang", "v"])

    sums = rows.mapInArrow(bundled, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    # whole numbers add up alike in any order
    sums = sums.groupBy("lang", "i").agg(F.sum(F.round(F.col("x") * 1e6).cast("long")).alias("x"))
    table = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r["lang"]: [float(p["x"]) for p in r["v"]] for r in table.orderBy("lang").collect()}


def predict(text: Column, prototypes: dict[str, list[float]]) -> Column:
    """struct<lang, score>: the language of the nearest prototype by cosine, and that cosine, 0 at least.

    ``und`` and 0 for a text that is null or has no letters, or if nothing was
    learned. Of equal cosines the first language by code point wins.
    """
    langs = sorted(prototypes)
    known = _unit(np.array([prototypes[k] for k in langs]).reshape(len(langs), DIMENSIONS))

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder()
        for texts in batches:
            values, out = [t if isinstance(t, str) else None for t in texts], []
            for at in range(0, len(values), TEXTS_AT_ONCE):
                units = _unit(encoder.bundles(values[at : at + TEXTS_AT_ONCE]))
                cosines = units @ known.T if langs else np.zeros((len(units), 1))
                best = cosines.argmax(axis=1)
                for unit, i, cosine in zip(units.any(axis=1), best, cosines.max(axis=1), strict=True):
                    out.append((langs[i], min(1.0, max(0.0, float(cosine)))) if unit and langs else (UNKNOWN, 0.0))
            yield pd.DataFrame(out, columns=["lang", "score"])

    return F.pandas_udf(found, "lang string, score double")(text)


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by their ids: not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learned(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[float]]:
    """Prototypes of the labelled documents that are not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return learn(rows.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns of ``docs`` and held_out, lang_pred and score, which replace columns of these names.

    Learns from the labelled documents that are not held out; a document without
    id is not learned from. Predictions look at texts alone, whole ones of any length, whose n-grams are
    bound GRAMS_AT_ONCE at a time. Repeated rows are predicted alike; an empty table gives an empty one.
    """
    prototypes = _learned(docs, id_col, text_col, lang_col)
    told = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), predict(F.col(text_col), prototypes).alias("_told"))
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in ("held_out", "lang_pred", "score")]
    return told.select(*own, held_out(F.col("_id")).alias("held_out"), F.col("_told.lang").alias("lang_pred"), F.col("_told.score").alias("score"))


def keep_identified(
    docs: DataFrame,
    least: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The documents whose language could be told; columns as in ``docs``.

    A text is told by a cosine of ``least`` or more, whatever its length. Others, like no learned
    language, go, as do null texts and those without letters. If nothing was learned no language can be
    ruled out, and every text with a letter stays. Repeated rows share their fate;
    an empty table gives an empty one.
    """
    prototypes = _learned(docs, id_col, text_col, lang_col)
    if not prototypes:
        return docs.filter(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    told = docs.select(F.struct("*").alias("_row"), predict(F.col(text_col), prototypes).alias("_told"))
    return told.filter((F.col("_told.lang") != UNKNOWN) & (F.col("_told.score") >= least)).select("_row.*")
