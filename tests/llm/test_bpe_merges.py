"""The merge table that stands in each plan of the encoder: one pair for each token, in three cells an id."""

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from textwarrant.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_the_table_has_the_one_pair_that_makes_each_token():
    ranks = bpe.read_ranks(RANKS)
    table = bpe.merge_table(ranks)
    assert sorted(table.values()) == sorted(r for t, r in ranks.items() if len(t) > 1)  # 98,783 pairs for 50,000 tokens before
    # "abc" is made of "ab" and "c" as that is merged first, though "a" and "bc" make it too; "xyz" is made of nothing, as "xy" is no token
    own = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259}
    assert bpe.merge_table(own) == {97 * bpe.IDS + 98: 256, 98 * bpe.IDS + 99: 257, 256 * bpe.IDS + 99: 258}


def test_cells_tell_each_pair_and_no_other():
    model = bpe.read_model(RANKS)
    table = bpe.merge_table(bpe.read_ranks(RANKS))
    start, cell, bits, end = bpe.displaced(table, model.ids)
    assert len(cell) <= 3 * model.ids + 2 and end == model.ids  # seven an id before
    draw = np.random.default_rng(0)
    other = [int(a) * bpe.IDS + int(b) for a, b in draw.integers(0, end + 1, (100_000, 2))]
    for pair in [*table, *other]:
        told = cell[start[pair // bpe.IDS] + pair % bpe.IDS] - (pair // bpe.IDS << 2 * bits)
        assert (told >> bits if 0 <= told < 1 << 2 * bits else None) == table.get(pair)


def test_the_fold_merges_as_tiktoken_does(spark):
    model = bpe.read_model(RANKS)
    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    draw = np.random.default_rng(1)
    words = ["".join(" aaabeinrsth.é日'"[i] for i in draw.integers(0, 16, draw.integers(1, 20))) for _ in range(400)] + ["a" * n for n in range(1, 65)] + [" " * n for n in range(1, 65)]
    rows = [(w, [model.byte_ids[b] for b in w.encode()]) for w in words]
    folded = spark.createDataFrame(rows, "word string, bytes array<bigint>").select("word", bpe.fold_merges(F.col("bytes"), bpe.rank_literals(model)).alias("ids"))
    assert folded.schema["ids"].dataType.simpleString() == "array<int>"
    for r in folded.collect():
        assert r.ids == own.encode_ordinary(r.word), r.word
