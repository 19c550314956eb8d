"""Exact top-k BM25 search: an inverted index per shard, block-max pruning, one merge."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarrant.tables import materialize

K1 = 1.2
B = 0.75
TERM = re.compile(r"[^\W_]+")
#: Documents and characters of a shard at most (one text may have more), and documents of a block.
SHARD_DOCUMENTS = 8192
SHARD_CHARACTERS = 32_000_000
BLOCK = 64
#: A term in a sixteenth of a shard's documents, and in so many, is a column of the shard's matrix.
FREQUENT = 16
LEAST_FREQUENT = 64
#: Queries that one shard is held against at a time, and how many times more shards each round has.
QUERIES_AT_ONCE = 256
#: Postings of rare terms that are scored at a time; one query may have more.
POSTINGS_AT_ONCE = 1_000_000
ROUNDS = 8
#: (query, term) pairs that are sent to all tasks at a time.
QUERY_PAIRS = 1_000_000
#: Digits that scores are compared and returned with: sums of other orders agree to them.
DIGITS = 9

INDEX = "ids array<bigint>, lengths array<bigint>, terms array<bigint>, starts array<bigint>, places array<int>, counts array<int>"


class _Vocabulary(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        digest = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = number = digest - (1 << 64) if digest >> 63 else digest
        return number


def _terms(text: str | None, vocabulary: _Vocabulary) -> np.ndarray:
    words = TERM.findall(text.lower()) if text else []
    return np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))


def _shard(ids: list[int], texts: list[np.ndarray]) -> list[np.ndarray]:
    """A shard's index: postings by term, then by document.

    Documents stand by their most frequent term and then their length, so that
    those of a block are of a kind and its bounds are tight.
    """
    pairs = [np.unique(t, return_counts=True) for t in texts]
    first = np.array([p[0][p[1].argmax()] if len(p[0]) else 0 for p in pairs], np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.lexsort((np.array(ids), lengths, first))
    ids_, lengths, pairs, texts = np.array(ids, np.int64)[order], lengths[order], [pairs[i] for i in order], [texts[i] for i in order]
    place = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p[0]) for p in pairs])
    term, count = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]).astype(np.int32)
    order = np.argsort(term, kind="stable")
    terms, starts = np.unique(term[order], return_index=True)
    return [ids_, lengths, terms, np.r_[starts, len(order)].astype(np.int64), place[order], count[order]]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard; a task makes shards of the documents that it reads, so nothing is shuffled.

    Terms are runs of letters and digits in lower case, by a 64-bit hash: of v
    terms two share one with odds of about v * v / 2^65.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in INDEX.split(", ")]

        def row(ids: list[int], texts: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in _shard(ids, texts)], names=names)

        ids, texts, size, vocabulary = [], [], 0, _Vocabulary()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(_terms(text, vocabulary))
                size += len(text or "")
                if len(ids) >= SHARD_DOCUMENTS or size >= SHARD_CHARACTERS:
                    yield row(ids, texts)
                    ids, texts, size, vocabulary = [], [], 0, _Vocabulary()
        if ids:
            yield row(ids, texts)

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col)
    return rows.mapInArrow(index, INDEX)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Searcher:
    """A shard with its frequent terms as a matrix, and the block maxima of that."""

    def __init__(self, ids, lengths, terms, starts, places, counts, mean: float) -> None:
        self.ids, self.terms, self.starts, self.places, self.n = ids, terms, starts, places, len(ids)
        self.part = counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[places] / mean))
        df = np.diff(starts)
        frequent = (df * FREQUENT >= self.n) & (df >= LEAST_FREQUENT)
        self.column = np.where(frequent, np.cumsum(frequent) - 1, -1)
        of_posting = np.repeat(self.column, df)
        self.dense = np.zeros((self.n, int(frequent.sum())))
        self.dense[places[of_posting >= 0], of_posting[of_posting >= 0]] = self.part[of_posting >= 0]
        self.blocks = np.arange(0, self.n, BLOCK)
        self.most = np.maximum.reduceat(self.dense, self.blocks, axis=0)

    def best(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best documents of each query (numbered from 0) with a score of ``least`` or more.

        Rare terms are few postings and are scored at once. With the block maxima
        of the frequent ones they bound what a block can have for each query; a
        block is scored for the queries whose k-th score so far it can reach, the
        most promising blocks first.
        """
        many = len(least)
        at = np.minimum(np.searchsorted(self.terms, term), max(0, len(self.terms) - 1))
        found = self.terms[at] == term if len(self.terms) else np.zeros(len(term), bool)
        query, at, weight = query[found], at[found], weight[found]
        common = self.column[at] >= 0
        wanted = np.zeros((self.dense.shape[1], many))
        wanted[self.column[at[common]], query[common]] = weight[common]
        start, size = self.starts[at[~common]], self.starts[at[~common] + 1] - self.starts[at[~common]]
        rare = self._rare(query[~common], start, size, weight[~common], many)
        bound = self.most @ wanted + np.maximum.reduceat(rare, self.blocks, axis=0)
        score, top, least = np.zeros((self.n, many)), np.zeros((many, k)), np.maximum(least, 10.0**-DIGITS)
        for b in np.argsort(-bound.sum(axis=1), kind="stable"):
            use = np.flatnonzero(bound[b] >= least - 2 * 10.0**-DIGITS)
            if len(use):
                rows = slice(b * BLOCK, (b + 1) * BLOCK)
                new = self.dense[rows] @ wanted[:, use] + rare[rows][:, use]
                score[rows, use] = new
                top[use] = np.partition(np.concatenate([top[use], new.T], axis=1), -k, axis=1)[:, -k:]
                least[use] = np.maximum(least[use], top[use].min(axis=1))
        score = np.round(score, DIGITS)
        place, asked = np.nonzero(score >= np.round(least, DIGITS))
        value = score[place, asked]
        order = np.lexsort((self.ids[place], -value, asked))
        asked, place, value = asked[order], place[order], value[order]
        first = np.r_[True, asked[1:] != asked[:-1]] if len(asked) else np.zeros(0, bool)
        rank = np.arange(len(asked)) - np.maximum.accumulate(np.where(first, np.arange(len(asked)), 0))
        return asked[rank < k], self.ids[place[rank < k]], value[rank < k]

    def _rare(self, query: np.ndarray, start: np.ndarray, size: np.ndarray, weight: np.ndarray, many: int) -> np.ndarray:
        """What the postings at ``start`` add to each document (rows) and query (columns), for some queries at a time.

        The pairs are in order of their queries, so that a query's postings are summed in one go whatever stands beside it.
        """
        rare = np.zeros((self.n, many))
        own = np.bincount(query, size, many)
        group = (np.cumsum(own) - own) // POSTINGS_AT_ONCE
        firsts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(firsts, [*firsts[1:], many], strict=True):
            pairs = slice(*np.searchsorted(query, [a, b]))
            posting = _ranges(start[pairs], size[pairs])
            cell = self.places[posting].astype(np.int64) * (b - a) + np.repeat(query[pairs] - a, size[pairs])
            rare[:, a:b] = np.bincount(cell, self.part[posting] * np.repeat(weight[pairs], size[pairs]), self.n * (b - a)).reshape(self.n, b - a)
        return rare


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each query: query_id, rank, doc_id, score.

    ``queries`` has query_id and text; a query's terms are the distinct terms of
    its whole text. Scores are BM25 with k1 1.2 and b 0.75, with statistics over
    all documents, so those of all shards compare: each shard's k best merge to
    the exact k best of all. Ties go to smaller ids.

    Queries are taken in blocks of QUERY_PAIRS terms, by a hash of their ids; one
    block at a time is sent to the tasks, which hold it against every shard. That
    goes in rounds over ROUNDS times more shards each: a query's k-th score so far
    is sent along, and shards return only what reaches it. So the rows to merge
    grow with the logarithm of the number of shards.

    Null and empty texts, and those without letters or digits, find and are found
    by nothing; rows without id take no part. A row repeated is ranked again. Of
    queries with one id the terms are put together. A document that shares a term has a score above zero and
    is told if it is 1e-9 or more, the last digit that scores are rounded to. No documents or no queries find nothing.
    """
    spark = docs.sparkSession
    # a shard to a file: a reader makes all rows of a file one batch, and a task's documents may be many shards
    index = materialize(build_index(docs, id_col, text_col), "bm25-index", rows_per_file=1)
    sizes = index.select(F.size("ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("length"))
    total = sizes.agg(F.sum("n"), F.sum("length")).first()
    n, mean = total[0] or 0, max(1, total[1] or 0) / max(1, total[0] or 0)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms, starts = batch.column(0)[i].values, batch.column(1)[i].values.to_numpy()
                yield pa.RecordBatch.from_arrays([terms, pa.array(np.diff(starts))], names=["term", "df"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vocabulary = _Vocabulary()
            terms = [np.unique(_terms(t, vocabulary)) for t in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(), [len(t) for t in terms])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([np.zeros(0, np.int64), *terms]))], names=["query_id", "term"])

    pairs = queries.filter("query_id is not null").select(F.col("query_id").cast("long"), "text").mapInArrow(asked, "query_id long, term long").distinct()
    df = index.select("terms", "starts").mapInArrow(told, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    pairs = materialize(pairs.join(df, "term").select("query_id", "term", idf.alias("idf")), "bm25-queries")
    blocks = max(1, math.ceil(pairs.count() / QUERY_PAIRS))

    rounds = max(1, math.ceil(math.log(max(1, index.count()), ROUNDS)))
    turn = F.pmod(F.xxhash64(F.get("ids", F.lit(0)), F.size("ids")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    merged = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    done: DataFrame | None = None
    for block in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        query, term, weight = (own.column(c).to_numpy() for c in ("query_id", "term", "idf"))
        by_query = np.lexsort((term, query))
        query, term, weight = query[by_query], term[by_query], weight[by_query]
        best: DataFrame | None = None
        for r in range(rounds):
            least = {}
            if best is not None:
                least = {x["query_id"]: x["score"] for x in best.filter(F.col("rank") == k).select("query_id", "score").collect()}
            low, high = 0.0 if r == 0 else ROUNDS ** (r - rounds), ROUNDS ** (r + 1 - rounds)
            shards = index.filter((turn >= low) & (turn < high))
            sent = _sent(spark, query, term, weight, least)
            found = shards.mapInArrow(_against(sent, k, mean), "query_id long, doc_id long, score double")
            rows = found if best is None else found.unionByName(best.drop("rank"))
            best = materialize(merged(rows), "bm25-best")
            sent.unpersist()
        done = best if done is None else done.unionByName(best)
    return done.select("query_id", "rank", "doc_id", "score")


def _sent(spark: SparkSession, query: np.ndarray, term: np.ndarray, weight: np.ndarray, least: dict[int, float]):
    """A block of queries for all tasks: ids, where the terms of each begin, terms, weights and the least scores."""
    asked, first = np.unique(query, return_index=True)
    first = np.r_[first, len(query)]
    return spark.sparkContext.broadcast((asked, first, term, weight, np.array([least.get(int(q), 0.0) for q in asked])))


def _against(sent, k: int, mean: float):
    """A function for tasks that holds a block of queries against their shards."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, first, term, weight, least = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Searcher(*(c[i].values.to_numpy() for c in batch.columns), mean)
                for at in range(0, len(asked), QUERIES_AT_ONCE):
                    to = min(at + QUERIES_AT_ONCE, len(asked))
                    own = slice(first[at], first[to])
                    number = np.repeat(np.arange(to - at), np.diff(first[at : to + 1]))
                    q, ids, score = shard.best(number, term[own], weight[own], least[at:to], k)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[at:to][q]), pa.array(ids), pa.array(score)], names=["query_id", "doc_id", "score"])

    return searched
