"""Operators against brute force and worked-out answers."""

import difflib
import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from textwarrant.functions import arabic, clauses, fuzzy
from textwarrant.functions.text import normalize, sentence_spans, token_spans
from textwarrant.operators import gates, match, retrieve, spans
from textwarrant.sources import corpora
from textwarrant.streaming import stateful

DRAW = random.Random(3)


def sentence(n, letters="abcd"):
    return " ".join(DRAW.choice(letters) for _ in range(n))


def greedy(words, refs, least=4):
    """Left to right, the longest run from each place that some reference holds."""
    held = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    i, out = 0, []
    while i + least <= len(words):
        j = i + least
        if tuple(words[i:j]) not in held:
            i += 1
            continue
        while j < len(words) and tuple(words[i : j + 1]) in held:
            j += 1
        out.append((i, j - i))
        i = j
    return out


def test_runs_and_containment_match_brute_force(spark):
    texts = [(i, sentence(DRAW.randint(0, 25))) for i in range(60)]
    refs = [(i, sentence(DRAW.randint(1, 9))) for i in range(25)]
    t, r = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(refs, "item_id long, text string")
    kept = match.greedy_runs(match.verbatim_runs(r, t, "item_id", "doc_id"), "doc_id").collect()
    expected = {(i, *run) for i, x in texts for run in greedy(x.split(), [y.split() for _, y in refs])}
    assert {(k.doc_id, k.text_start, k.n_words) for k in kept} == expected and len(kept) == len(expected)
    pairs = {(p.item_id, p.doc_id) for p in match.containment(r, t, "item_id", "doc_id").collect()}
    assert pairs == {(a, b) for a, x in refs for b, y in texts if len(x.split()) >= 3 and f" {x} " in f" {y} "}


def test_normalize_is_idempotent_and_spans_point_into_the_text(spark):
    texts = ["Hello,  World! It's fine.\nNext line? Yes", "", "  ...  ", "é1_2 ﷺ x", "a.b c"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    once = normalize(F.col("text"))
    for r in rows.select("text", once.alias("a"), normalize(once).alias("b"), token_spans(F.col("text")).alias("w"), sentence_spans(F.col("text")).alias("s")).collect():
        assert r.a == r.b and [x.norm for x in r.w] == r.a.split()
        for x in [*r.w, *r.s]:
            assert r.text[x.start : x.end] == x.text and x.text == x.text.strip()
    assert [x.text for x in rows.select(F.explode(sentence_spans(F.col("text")))).collect() for x in x][:3] == ["Hello,  World!", "It's fine.", "Next line?"]


def test_bm25_grows_with_term_frequency(spark):
    tf = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (2, "a", 3), (2, "b", 1), (3, "c", 4)], "doc_id long, term string, tf int")
    asked = spark.createDataFrame([(0, "a", 1.0)], "query_id long, term string, weight double")
    scores = {r.doc_id: r.score for r in retrieve.bm25_scores(asked, tf).collect()}
    assert set(scores) == {1, 2} and scores[2] > scores[1]


def test_fusion_adds_weighted_ranks(spark):
    one = spark.createDataFrame([(0, 7, 1), (0, 8, 2)], "query_id long, doc_id long, rank int")
    two = spark.createDataFrame([(0, 7, 3)], "query_id long, doc_id long, rank int")
    best = retrieve.fuse([("keyword", 0.5, one), ("meaning", 1.0, two)], 5).orderBy("rank").first()
    assert (best.doc_id, best.found_by) == (7, "keyword+meaning") and best.score == pytest.approx(0.024070, abs=1e-6)


def test_similarity_is_difflib(spark):
    rows = [(sentence(DRAW.randint(1, 80)), sentence(DRAW.randint(1, 80))) for _ in range(20)] + [("", ""), ("a", None)]
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", fuzzy.similarity(F.col("a"), F.col("b")).alias("s")).collect():
        if r.b is None:
            assert r.s is None
            continue
        chars = difflib.SequenceMatcher(None, r.a, r.b).ratio()
        assert r.s == pytest.approx((chars + difflib.SequenceMatcher(None, r.a.split(), r.b.split(), autojunk=False).ratio()) / 2)


def test_subtract_keeps_what_no_cut_touches(spark):
    draw = random.Random(5)
    whole, cuts = [], []
    for d in range(40):
        whole.append((d, 10, 10 + draw.randint(1, 40)))
        cuts += [(d, a, a + draw.randint(1, 12)) for a in (draw.randint(0, 60) for _ in range(draw.randint(0, 4)))]
    schema = "doc_id int, start int, end int"
    out = spans.subtract(spark.createDataFrame(whole, schema), spark.createDataFrame(cuts, schema), ["doc_id"]).collect()
    left = {(r.doc_id, i) for r in out for i in range(r.start, r.end)}
    assert left == {(d, i) for d, a, b in whole for i in range(a, b) if not any(c == d and s <= i < e for c, s, e in cuts)}


def limited(hits, limit, window):
    kept, out = [], []
    for t in hits:
        kept = [x for x in kept if t - x <= window]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def test_rate_limit_in_batches_and_as_a_stream(spark, tmp_path):
    draw = random.Random(1)
    rows = sorted((float(draw.randint(0, 300)), i, f"u{i % 3}") for i in range(200))
    rows = [(u, i, t) for t, i, u in rows]
    schema = "user string, id long, at double"
    expected = {}
    for u in ("u0", "u1", "u2"):
        own = sorted((t, i) for v, i, t in rows if v == u)
        expected |= dict(zip([i for _, i in own], limited([t for t, _ in own], 5, 60.0)))
    batch = stateful.rate_limit(spark.createDataFrame(rows, schema), "user", "at", "id", 5, 60.0)
    assert {r.id: r.accepted for r in batch.collect()} == expected
    edges = [t for t in sorted({r[2] for r in rows})]
    cut = edges[len(edges) // 2]
    for n, part in enumerate(([r for r in rows if r[2] <= cut], [r for r in rows if r[2] > cut])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = stateful.stream_rate_limit(stream, "user", "at", "id", 5, 60.0)
        done = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        done.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.id: r.accepted for r in found} == expected and len(found) == len(rows)


def test_remembered_results(spark):
    rows = [("k", 1, 0.0, "a"), ("k", 2, 1.0, "b"), ("k", 3, 2.0, "a"), ("k", 4, 3.0, "c"), ("k", 5, 4.0, "b"), ("k", 6, 5.0, "a"), ("k", 7, 99.0, "a")]
    table = spark.createDataFrame(rows, "user string, id long, at double, item string")
    hits = {r.id: r.hit for r in stateful.remembered(table, "user", "at", "id", "item", 50.0, 2).collect()}
    # b is the longest unused when c comes; a is when b comes again
    assert hits == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False}


def test_corpus_files(spark, tmp_path):
    first = [{"text": "آية", "source": {"book": "القرآن الكريم", "chapter": "c", "number": "1:1"}}, {"text": "x", "match_text": "y"}]
    second = [{"text": "z", "classification": "hadith", "grades": [{"name": "n", "grade": "Sahih"}]}]
    (tmp_path / "a.json").write_text(json.dumps(first, ensure_ascii=False), encoding="utf-8")
    with gzip.open(tmp_path / "b.json.gz", "wt", encoding="utf-8") as f:
        json.dump(second, f)
    rows = corpora.read_corpus(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json.gz")]).orderBy("entry_id").collect()
    assert [(r.entry_id, r.classification, r.text, r.forms) for r in rows] == [(0, "quran", "آية", ["ايه"]), (1, "hadith", "x", ["x", "y"]), (2, "hadith", "z", ["z"])]
    assert rows[2].grades[0].grade == "Sahih" and rows[1].number == ""

    passages = spark.createDataFrame([(5, "e", "s", None, 1, 2, 3, "t"), (4, "e", "s", "h", 1, 1, 9, "u")], "old int, e string, s string, h string, n int, v int, p int, t string")
    corpora.write_passages(passages.drop("old"), str(tmp_path / "p"), ["v", "p"])
    back = corpora.read_passages(spark, str(tmp_path / "p")).orderBy("id").collect()
    assert [(r.id, r.t, r.h) for r in back] == [(0, "u", "h"), (1, "t", "")]
    assert corpora.read_passages(spark, str(tmp_path / "nothing")).count() == 0

    (tmp_path / "t.txt").write_text("# c\n\n1|1|one|more\n1|2|two\n1|2|again\n", encoding="utf-8")
    assert {(r.chapter, r.verse): r.text for r in corpora.read_delimited(spark, str(tmp_path / "t.txt")).collect()} == {(1, 1): "one|more", (1, 2): "again"}

    (tmp_path / "tr").mkdir()
    (tmp_path / "tr" / "x.json").write_text(json.dumps({"meta": {"key": "k", "language": "en", "version": "1"}, "verses": {"1:1": "v"}}))
    (tmp_path / "tr" / "y.json").write_text(json.dumps({"meta": {"key": "f", "language": "fr"}, "verses": {"1:1": "w"}}))
    assert [tuple(r) for r in corpora.read_translations(spark, str(tmp_path / "tr"), "en").collect()] == [("k", "1", 99, "1:1", "v")]

    vectors = spark.createDataFrame([(1, [0.5, -1.0]), (2, [0.0, 0.0])], "id long, vector array<float>")
    print_ = corpora.corpus_fingerprint(vectors.withColumn("t", F.lit("x")), "id", "t")
    corpora.write_vectors(vectors, str(tmp_path / "v"), print_)
    assert corpora.read_vectors(spark, str(tmp_path / "v"), "other") is None
    read = {r.id: r.vector for r in corpora.read_vectors(spark, str(tmp_path / "v"), print_).collect()}
    assert read[1] == pytest.approx([0.5, -1.0], abs=0.01) and read[2] == [0.0, 0.0]

    blob = tmp_path / "f.bin"
    blob.write_bytes(b"data")
    assert bytes(corpora.pinned(spark, str(blob), hashlib.sha256(b"data").hexdigest()).first().content) == b"data"
    with pytest.raises(Exception, match="not the file expected"):
        corpora.pinned(spark, str(blob), "0" * 64).collect()

    pages = spark.createDataFrame([("9", "2", "1.0", "b"), ("9", "1", "7", "a"), ("9", "x", "1", "c"), ("8", "1", "1", "d"), ("9", "1", "8", "")], "book_id string, volume_number string, page_number string, text string")
    pages.write.parquet(str(tmp_path / "pages"))
    read = corpora.read_pages(spark, str(tmp_path / "pages"), "9")
    assert [tuple(r) for r in read.collect()] == [(1, 7, "a"), (2, 1, "b")]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = corpora.read_pages(spark, str(tmp_path / "pages"), "9")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(book_id,9)" in plan


def test_lexicon_forms_fold_like_texts(spark):
    from textwarrant.operators import lexicons as lex

    forms = [f for listed in (lex.RULING, lex.CONSENSUS, lex.HEDGE, lex.AGREE, lex.DISAGREE) for f in lex.forms(listed)]
    rows = spark.createDataFrame([(f,) for f in forms], "form string").select("form", arabic.normalize(F.col("form")).alias("n")).collect()
    assert all(arabic.folded(r.form) == r.n for r in rows)


def test_null_texts_are_a_form_of_their_own(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, None), (3, None), (4, "a  B!"), (5, "")], "doc_id int, text string")
    rows = {r.doc_id: (r.first_id, r.other_matches) for r in match.exact_matches(docs).collect()}
    assert rows == {1: (1, 1), 4: (1, 1), 2: (2, 1), 3: (2, 1), 5: (5, 0)}


def test_claims_stand_for_what_they_touch(spark):
    local = spark.createDataFrame([(1, 0, 5, True), (1, 6, 9, False), (1, 20, 25, False), (2, 0, 3, False)], "doc_id int, start int, end int, verified boolean")
    claims = spark.createDataFrame([(1, 1, 4, 7), (1, 2, 7, 12), (1, 3, 11, 15), (1, 4, 30, 33)], "doc_id int, place int, start int, end int")
    found = sorted(tuple(r) for r in gates.merge_claims(local, claims, "doc_id").select("doc_id", "start", "end", "kind").collect())
    # the first claim touches the verified finding; the third overlaps the second
    assert found == [(1, 0, 5, "verified"), (1, 7, 12, "claim"), (1, 20, 25, "local"), (1, 30, 33, "claim"), (2, 0, 3, "local")]


def test_marks_of_two_readings(spark):
    cases = [("كَتَبَ", "كَتَبَ", False), ("كَتَبَ", "كُتِبَ", True), ("كتب", "كُتِبَ", False), ("إن", "أن", True), ("ان", "أن", False), ("كَتَبَ نصا", "كَتَبَ", False)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, said boolean")
    for r in rows.select("i", "said", clauses.marks_conflict(F.split("a", " "), F.split("b", " ")).alias("found")).collect():
        assert r.found == r.said, cases[r.i]


def test_rewritten_claims(spark):
    cases = [("ويأمر الاسلام بالصدقة", "يأمر بالصدقة", (0, 2)), ("a b c", "c a", None), ("a not b", "a b", None), ("a not b", "a not", (0, 1)), ("a b", "", None), ("a b", "x", None)]
    rows = spark.createDataFrame([(i, s, c) for i, (s, c, _) in enumerate(cases)], "i int, s string, c string")
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    for r in rows.select("i", clauses.rewrite_span(split("s"), split("c")).alias("at")).collect():
        assert (tuple(r["at"]) if r["at"] else None) == cases[r.i][2], cases[r.i]
