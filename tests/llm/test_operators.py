"""The ten operators against brute force, and on odd rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from corpus_pipeline import identify_language
from textwarrant.llm import ann, bm25, bpe, langid, linededup, mixing, sharding, simhash, tokencount, warc
from textwarrant.llm.components import connected_components

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Columns of an input that operators use for themselves, too.
CLASHES = {"size": 1, "score": 0.5, "rank": 7, "shard": 3, "fp": 9, "_id": 4, "mix_size": 2, "line_count": 8, "lang_pred": "x", "tokens": "t", "_row": 1}
DOCS = "doc_id long, text string, lang string, source string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(draw.integers(0, 60)) for i in draw.integers(0, len(WORDS), n))


def odd_rows() -> list[tuple]:
    rows = [(i, prose(i, 30 + i), "en", f"s{i % 3}") for i in range(24)]
    rows += [(30, None, None, None), (31, "", "en", "s0"), (32, " \n\t ", None, "s1"), (33, "!!! 123", "en", None), (None, "a text without id", None, "s2")]
    rows += [(34, rows[3][1], "en", "s1"), (3, rows[3][1], "en", "s0"), (3, rows[3][1], "en", "s0"), (35, "x" * 300_000 + " " + prose(9, 20_000), "en", "s0")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    return docs.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_targets_and_copies(odd, empty):
    found = mixing.mix_sources(odd)
    assert set(odd.columns) <= set(found.columns) and len(found.columns) == len(set(found.columns))
    rows = found.collect()
    assert len(rows) == len(odd_rows())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(odd.repartition(3)).collect()))
    total, size = sum(n_words(r[1]) for r in odd_rows()), defaultdict(int)
    for r in odd_rows():
        size[r[3]] += n_words(r[1])
    weight = dict(zip(sorted(s for s in size if s is not None), (5.0, 2.0, 1.0)))
    weight[None] = 5.0
    target, open_ = {}, set(size)
    while True:  # the contract's own words: the excess is shared again until none is above
        level = (total - sum(target.values())) / max(1e-9, sum(weight[s] for s in open_))
        above = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not above:
            break
        target |= {s: 3.0 * size[s] for s in above}
        open_ -= above
    target |= {s: level * weight[s] for s in open_}
    taken = defaultdict(int)
    for r in rows:
        assert r.mix_size == n_words(r.text) and 0 <= r.mix_taken <= 3 * r.mix_size
        assert r.mix_target == pytest.approx(target[r.source])
        taken[r.source] += r.mix_taken
    largest = {s: max(n_words(r[1]) for r in odd_rows() if r[3] == s) for s in size}
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    copies = mixing.take_copies(found)
    assert copies.count() == sum(r.mix_copies for r in rows)
    assert mixing.mix_sources(empty).count() == 0


def test_mix_prefers_likely_documents(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', if(id % 2 = 0, 1, 9)) as text", "if(id % 4 < 3, 'a', 'b') as source")
    rows = mixing.mix_sources(docs, weights=(1, 3)).filter("source = 'a'").groupBy("mix_size").agg(F.avg("mix_copies").alias("c")).collect()
    share = {r.mix_size: r.c for r in rows}
    assert 0 < share[1] < share[9] <= 1


def test_line_dedup(spark, odd, empty):
    rows = [(i, "\n".join(["Menu | Home", f"own line {i}", " Menu | Home "] + (["seldom"] if i < 3 else [])), "en", "site") for i in range(20)]
    rows += [(i, "\n".join(["Menu | Home", f"other {i}", ""]), "en", "other") for i in range(30, 34)] + [(50, None, "en", "site"), (51, "", "en", None)]
    out = {r.doc_id: r for r in linededup.drop_boilerplate(spark.createDataFrame(rows, DOCS), 0.5, 3).collect()}
    assert out[5].text == "own line 5" and (out[5].line_count, out[5].line_dropped) == (3, 2)
    assert out[1].text == "own line 1\nseldom"
    assert out[31].text == "other 31\n"
    assert out[50].text is None and out[50].line_count == 0 and out[51].text == ""
    assert linededup.drop_boilerplate(odd).count() == len(odd_rows())
    assert linededup.drop_boilerplate(empty).count() == 0


def test_language_id(spark, odd, empty):
    alphabets = {"aa": "abcde", "bb": "eghij", "cc": "yzwvu"}
    def text(lang, i, n):
        draw = np.random.default_rng([i, n])
        return " ".join("".join(alphabets[lang][k] for k in draw.integers(0, 5, 6)) for _ in range(n))
    rows = [(i, text(lang, i, 30), lang, "s") for i in range(200) for lang in [list(alphabets)[i % 3]]]
    out = langid.identify(spark.createDataFrame(rows, DOCS)).collect()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    assert sum(r.lang_pred == r.lang for r in out) >= 0.98 * len(out)
    found = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert {found[i].lang_pred for i in (30, 31, 32, 33)} == {"und"} and found[None].lang_pred == "en"
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (30, 31, 32, 33)").count() == 0 and kept.count() == len(odd_rows()) - 4
    assert langid.identify(empty).count() == 0
    nothing = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_only_texts_near_a_learned_language_stay(spark):
    alphabets = {"aa": "abcde", "bb": "eghij", "cc": "yzwvu"}
    def text(letters, i, n):
        draw = np.random.default_rng([i, n])
        return " ".join("".join(letters[k] for k in draw.integers(0, len(letters), 6)) for _ in range(n))
    own = [(i, text(alphabets[lang], i, 3 + i % 40), lang, "s") for i in range(200) for lang in [list(alphabets)[i % 3]]]
    other = [(500 + i, text("mnopqrs", i, 3 + i % 40), None, "s") for i in range(60)] + [(600, "Я не знаю этого языка", None, "s")]
    nothing = [(700, None, None, "s"), (701, "12 !", None, "s")]
    docs = spark.createDataFrame(own + other + nothing, DOCS)
    assert {r.doc_id for r in identify_language(spark, docs, "").collect()} == {r[0] for r in own}
    unlabelled = identify_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
    assert {r.doc_id for r in unlabelled.collect()} == {r[0] for r in own + other}


def test_grams_of_long_texts_are_whole(monkeypatch):
    encoder = langid.Encoder()
    text = "Ein Text, der nicht in ein Stück passt: Straße über Ödland."
    whole = [x.tolist() for x in encoder.grams(text)]
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "CHUNK", size)
        assert [x.tolist() for x in encoder.grams(text)] == whole


def warc_rows(pages):
    newest = {}
    for i, _, html in pages:
        newest[html or ""] = max(i, newest.get(html or "", i))
    for i, _, html in pages:
        raw, last = (html or "").encode(), newest[html or ""]
        yield (i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == last else "revisit", None if i == last else last)


@pytest.mark.parametrize("split", ["1k", "128m"])
def test_warc_round_trip(spark, split):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(i, f"http://h{i % 3}/p", f"<p>{i % 40}</p>" + "é" * (i % 50)) for i in range(150)]
    pages += [(200, None, None), (201, "u\r\nX: y", ""), (202, "u", inner), (203, "u", "a" + inner * 3), (204, "u", "WARC/1.1\r\n"), (205, "u", "z" * 200_000), (206, "u", inner), (207, "u", "\r\n\r\n\r\n\r\n")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("mine")).repartition(3)
        found = warc.round_trip(table)
        rows = found.select(warc.page_id(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", warc.page_id(F.col("refers_to"))).collect()
        payloads = {r[0]: bytes(r[1]) for r in found.filter("record_type = 'response'").select(warc.page_id(F.col("record_id")), "payload").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(map(tuple, rows)) == sorted(warc_rows(pages))
    assert payloads[203] == ("a" + inner * 3).encode() and payloads[205] == b"z" * 200_000
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_revisits_of_a_size(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    rows = warc.round_trip(pages, least_revisit=3).select(warc.page_id(F.col("record_id")), "record_type").collect()
    assert sorted(map(tuple, rows)) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def brute_bm25(docs, queries, k):
    terms = {i: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in docs}
    df = Counter(w for c in terms.values() for w in c)
    n, mean = len(docs), sum(sum(c.values()) for c in terms.values()) / len(docs)
    out = {}
    for q, text in queries:
        scores = []
        for i, c in terms.items():
            s = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in set(re.findall(r"[^\W_]+", (text or "").lower())) if c[w])
            if s > 0:
                scores.append((-round(s, 9), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_bm25_is_exact(spark, empty, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_DOCUMENTS", 70)
    monkeypatch.setattr(bm25, "QUERY_PAIRS", 300)
    docs = [(i, prose(i, 5 + i % 90)) for i in range(400)] + [(500, None), (501, ""), (502, "--"), (503, prose(3, 8)), (504, prose(3, 8)), (505, "alpha " * 5000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    asked = table.filter("doc_id % 25 = 0 or doc_id > 499").selectExpr("doc_id as query_id", "text")
    found = defaultdict(list)
    for r in bm25.search(table, asked, 10).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.doc_id, r.score))
    expected = brute_bm25(docs, [d for d in docs if d[0] % 25 == 0 or d[0] > 499], 10)
    for q, hits in expected.items():
        assert [i for i, _ in found[q]] == [i for i, _ in hits]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in hits], abs=1e-7)
    assert bm25.search(empty.select("doc_id", "text"), empty.selectExpr("doc_id as query_id", "text")).count() == 0


def test_shards(spark, odd, empty):
    rows = odd_rows() + [(100 + i, "the same text", "en", "s") for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("g", F.lit(1)).repartition(5)
    out = sharding.shard_by_bytes(docs, 8).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(8))
    assert len({r.shard for r in out if r.doc_id is not None and r.doc_id >= 100}) == 1
    texts = defaultdict(list)
    for i, t, _, _ in rows:
        texts[i].append(t)
    for r in out:
        t = texts[r.doc_id][0]
        assert r.size == len((t or "").encode()) + 16 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
    even = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id, repeat('x', cast(id % 50 as int))) as text")
    sizes = [r[0] for r in sharding.shard_by_bytes(even, 40).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) <= 200
    assert sharding.shard_by_bytes(empty).count() == 0


def brute_simhash(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [4096, 8])
def test_simhash(spark, odd, empty, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL_RUN", min(block, 48))
    base = prose(1, 150).split()
    rows = odd_rows()
    for i in range(60):
        words = list(base)
        words[(7 * i) % 150] = f"changed{i}"
        rows.append((1000 + i, " ".join(words), "en", "s"))
    rows = [r for r in rows if r[1] is None or len(r[1]) < 100_000]
    docs = spark.createDataFrame(rows, DOCS)
    out = simhash.near_duplicates(docs).collect()
    prints = {(i, t): brute_simhash(t) for i, t, _, _ in rows}
    fps = sorted(set(prints.values()))
    root = {f: f for f in fps}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for (i, _), f in prints.items():
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    by_id = defaultdict(set)
    for (i, _), f in prints.items():
        by_id[i].add((f, least.get(find(f))))
    assert len(out) == len(rows)
    for r in out:
        assert (r.fp % (1 << 64), r.component_id) in by_id[r.doc_id]
    kept = simhash.drop_near_duplicates(docs.withColumns({k: F.lit(v) for k, v in CLASHES.items()})).collect()
    ids = [r.doc_id for r in kept]
    assert len(ids) == len(set(ids)) and set(ids) - {None} == set(least.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block, run", [(4096, 48), (8, 4)])
def test_similar_documents(spark, odd, empty, monkeypatch, block, run):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL_RUN", run)
    draw = np.random.default_rng(5)
    rows = [r for r in odd_rows() if r[1] is None or len(r[1]) < 100_000]
    for group in range(12):
        base = prose(500 + group, 20 + 25 * group).split()
        for copy in range(8):
            words = list(base)
            for at in draw.choice(len(words), draw.integers(0, 2 + len(words) // 20), replace=False):
                words[at] = f"edit{copy}"
            rows.append((2000 + 10 * group + copy, " ".join(words[draw.integers(0, 2) :]), "en", "s"))
    rows += [(3000 + i, " ".join([*WORDS, f"tail{i}"]), "en", "s") for i in range(40)]
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    far = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
                far += (brute_simhash(rows[i][1]) ^ brute_simhash(rows[j][1])).bit_count() > 4
    assert far > 20
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
        else:
            least.setdefault(find(i), 10**9)
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({k: F.lit(v) for k, v in CLASHES.items()})
    kept = simhash.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(10**9 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.drop_similar(empty).count() == 0


def test_parities_rule_out_no_similar_pair(spark):
    words = prose(8, 6000).split()
    texts = [" ".join(words[:n][k:]) for n in (5, 40, 300, 3000, 6000) for k in (0, n // 12, n // 6)] + ["", prose(9, 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "tid long, text string")
    pairs = spark.createDataFrame([(i, j) for j in range(len(texts)) for i in range(j)], "a long, b long")
    sets = [set(simhash._shingle_set(t, 5).tolist()) for t in texts]
    own = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 5 * len(a & b) >= 4 * len(a | b)}
    assert len(own) > 8 and {(r.a, r.b) for r in simhash._verified(pairs, docs, 5, "0.8").collect()} == own


@pytest.mark.parametrize("drop", [simhash.drop_similar, simhash.drop_near_duplicates])
def test_documents_go_by_text_not_by_id(spark, drop):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (2, b, "en", "s"), (5, b, "en", "s"), (None, a, "en", "s"), (None, c, "en", "s"), (None, prose(4, 60), "en", "s")]
    kept = drop(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", a), ("2", b), ("None", c), ("None", prose(4, 60))])


def test_every_difference_within_the_budget_shares_a_key():
    keys = np.array(simhash.ring_keys(4), dtype=np.uint64)
    assert len(keys) == 35
    draw = np.random.default_rng(0)
    for _ in range(4000):
        x = np.uint64(sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 5), replace=False)))
        assert (keys & x == 0).any() and simhash.within(np.array([x]), 4)[0]
    far = draw.integers(0, 1 << 63, 500, dtype=np.uint64)
    assert (simhash.within(far, 4) == (np.bitwise_count(far) <= 4)).all()


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 300), (300, 200), (200, 100), (7, 7)]
    out = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def test_bpe(spark, odd, empty):
    ranks = bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = odd_rows()[:-1] + [(900, "Grüße, 世界! 😀😀\x00\x85   it's  \n\n  end ", "de", "s"), (901, "ab" * 700 + " " * 500, "en", "s"), (902, "<|endoftext|>", "en", "s")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit(1)).repartition(3)
    out = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "text", "row"))
    out = out.withColumn("back", bpe.decode(F.col("tokens"), RANKS)).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = own.encode_ordinary(r.text or "")
        assert r.tokens == ids and bytes(r.packed) == np.array(ids, "<u4").tobytes() and bytes(r.back) == (r.text or "").encode()
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_heap_merges_are_the_merges():
    ranks = bpe.read_ranks(RANKS)
    table = bpe.merge_table(ranks)
    own = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    draw = np.random.default_rng(0)
    for _ in range(200):
        text = "".join("abeinrst hé日"[i] for i in draw.integers(0, 12, draw.integers(1, 300)))
        assert bpe.heap_merges([ranks[bytes([b])] for b in text.encode()], table) == own.encode_ordinary(text)


def test_token_counts(spark, odd, empty):
    pieces, has_bytes = tokencount.read_pieces(MODEL)
    own = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=has_bytes))
    own.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = [t for _, t, _, _ in odd_rows()] + ["日本語 テスト", "x😀😀y", "  two  spaces", "\n\t", "▁▁", "<0x41><s>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.n for r in docs.select("doc_id", tokencount.token_count(F.col("text"), MODEL).alias("n")).collect()}
    assert out == {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert empty.select(tokencount.token_count(F.col("text"), MODEL)).count() == 0


def test_unknown_runs_without_byte_pieces():
    vocabulary = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.5), ("ab", -2.5), ("▁ab", -4.0)]
    own = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    own.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = tokencount.Counter(vocabulary, False)
    for text in ("ab", "xx ab", "axxb xx", "abab aab", "x", "bbx xab"):
        assert counter.of(text) == len(own.encode(text, add_special_tokens=False).ids), text


def brute_nearest(rows, k, every):
    held = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for q, v in held:
        if q % every == 0:
            scored = sorted((-round(float(v @ w / (math.sqrt(v @ v) * math.sqrt(w @ w))), 12), i) for i, w in held if i != q)
            yield q, [(i, -s) for s, i in scored[:k]]


def test_nearest_neighbours(spark):
    draw = np.random.default_rng(0)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(300)]
    rows += [(i, rows[10][1]) for i in range(300, 380)]
    rows += [(400, None), (450, [0.0] * 8), (500, [math.nan] + [1.0] * 7), (550, [math.inf] + [1.0] * 7), (600, [None] + [1.0] * 7), (650, [1.0, 2.0]), (700, []), (None, rows[1][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(3)).repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    found = defaultdict(list)
    for r in ann.nearest(table).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    expected = dict(brute_nearest(rows, 5, 50))
    assert set(found) == set(expected)
    for q, hits in expected.items():
        assert [i for i, _ in found[q]] == [i for i, _ in hits], q
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in hits])
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(few).collect()] == [(0, 1, 1, 0.0)]
    assert ann.nearest(few.limit(0)).count() == 0


def test_recall_where_windows_are_part_of_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 32))
    rows = [(i, (centres[i % 40] + 0.5 * draw.normal(size=32)).tolist()) for i in range(4000)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = defaultdict(set)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 4000, 50):
        s = x @ x[q]
        s[q] = -2
        hits += len(found[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / 400 >= 0.9


def test_the_first_look_leaves_the_result_as_it_is(spark, monkeypatch):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=16).tolist()) for i in range(1200)]
    rows += [(i, rows[50][1]) for i in range(1200, 1240)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "FIRST", 1)
    order = ("query_id", "rank")
    floored = ann.nearest(table, every=25, window=0.3, block=32).orderBy(*order).collect()
    monkeypatch.setattr(ann, "ROUNDING", 10.0)
    free = ann.nearest(table, every=25, window=0.3, block=32).orderBy(*order).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in floored] == [(r.query_id, r.rank, r.vec_id) for r in free]
    assert [r.score for r in floored] == pytest.approx([r.score for r in free])


def test_hilbert_neighbours_are_neighbours():
    for d, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = ann.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_recall_of_the_registered_search(spark):
    """Vectors without structure: the registered windows, on several blocks, against brute force."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = table.collect()
    assert len(rows) > 4 * ann.BLOCK
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = defaultdict(set)
    for r in ann.nearest(table).collect():
        found[r.query_id].add(r.vec_id)
    hits, wanted = 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        hits += len(found[ids[q]] & set(ids[np.argsort(-s)[:5]].tolist()))
        wanted += 5
    assert hits / wanted >= 0.9


def test_profiles_against_plain_loops(spark):
    """Bundles, prototypes and cosines written out letter by letter."""
    encoder = langid.Encoder()

    def bundle(text):
        codes = [ord(c) if c.isalpha() else 0 for c in (text or "").lower()]
        out = np.zeros(langid.DIMENSIONS)
        for i, code in enumerate(codes):
            if code:
                gram = (codes[i - 1] if i else 0, code, codes[i + 1] if i + 1 < len(codes) else 0)
                bound = np.ones(langid.DIMENSIONS)
                for place, c in enumerate(gram):
                    bound *= np.roll(encoder.letter(c), place)
                out += bound
        return out

    texts = ["A b, cde!", "der die das und", "the that and of", "", None, "ÄÖ ßx 12 y", "dddd eeee " * 30]
    assert np.allclose(encoder.bundles(texts), [bundle(t) for t in texts])
    unit = lambda v: v / np.linalg.norm(v) if v.any() else v
    learned = {"de": ["der die das und", "die und den"], "en": ["the that and of", "of the and"]}
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in learned.items() for t in ts)]
    prototypes = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    plain = {k: unit(sum(unit(bundle(t)) for t in ts)) for k, ts in learned.items()}
    for k in plain:
        assert np.allclose(unit(np.array(prototypes[k])), plain[k], atol=1e-5)
    asked = spark.createDataFrame([(t,) for t in texts], "text string").repartition(1)
    for r in asked.select("text", langid.predict(F.col("text"), prototypes).alias("p")).collect():
        cosines = {k: float(unit(bundle(r.text)) @ v) for k, v in plain.items()}
        best = max(cosines, key=cosines.get)
        told = bool(bundle(r.text).any())
        assert r.p.lang == (best if told else "und")
        assert abs(r.p.score - (min(1.0, max(0.0, cosines[best])) if told else 0.0)) < 1e-4


def test_shards_against_a_plain_prefix_sum(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    held = []
    for i, t in rows:
        h = xxhash.xxh64_intdigest((t or "").encode(), 42) if t is not None else 0
        held.append(((h - (1 << 64) if h >> 63 else h, zlib.crc32((t or "").encode()), t is None), (i is not None, i or 0), len((t or "").encode()) + 16))
    held.sort()
    total, at, expected, heads = sum(x[2] for x in held), 0, [], {}
    group, began = None, 0.0
    for n, (g, (_, i), size) in enumerate(held):
        if g != group:
            group, began = g, at + size / 2
        shard = int(began * 40 / total)
        heads.setdefault(shard, n)
        expected.append((size, shard, n - heads[shard]))
        at += size
    found = [(r.size, r.shard, r.slot) for r in sharding.shard_by_bytes(odd).collect()]
    assert sorted(found) == sorted(expected)


def test_bpe_of_long_texts_and_columns_of_its_own_names(spark, monkeypatch):
    import public_tokenizers
    import tiktoken

    from textwarrant.llm import bpe

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    monkeypatch.setattr(bpe, "LONG_TEXT", 5_000)
    texts = ["word of a very long text, é 😀. " * 5_000, "short", None, "x" * 70 + " y" * 3_000]
    docs = spark.createDataFrame([(i, t, "kept", "own", "own") for i, t in enumerate(texts)], "doc_id long, text string, lang string, tokens string, Packed string")
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=("doc_id", "tokens", "Packed", "lang"))
    assert coded.columns == ["doc_id", "lang", "tokens", "packed"]
    assert {r.doc_id: list(r.tokens) for r in coded.collect()} == {i: own.encode_ordinary(t or "") for i, t in enumerate(texts)}
