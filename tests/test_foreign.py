"""Quotations in several languages, against plain loops."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import pytest

from textwarrant.operators import foreign

FLOORS = {"verse": 0.60, "narration": 0.62}
WORDINGS = "text_id string, kind string, lang string, reference string, text string"
QUOTES = "quote_id int, lang string, text string, hint string, given string"


def plain_words(text):
    text = unicodedata.normalize("NFKD", (text or "").lower())
    return re.findall(r"[^\W\d_]+", "".join(c for c in text if not unicodedata.combining(c)))


def plain_match(quote, wordings):
    """(status, text_id, share, missing) of one quote by scoring every wording of its language."""
    _, lang, text, hint, given = quote
    q, options = plain_words(text), []
    for kind in FLOORS:
        held = [(w[0], w[3], plain_words(w[4])) for w in wordings if w[1] == kind and w[2] == lang]
        if len(q) < 3 or not held or hint not in (None, kind):
            continue
        n, mean = len(held), sum(len(t) for _, _, t in held) / len(held)
        df = Counter(x for _, _, t in held for x in set(t))
        idf = {x: math.log(1 + (n - d + 0.5) / (d + 0.5)) for x, d in df.items()}
        weight = [idf.get(x, max(idf.values())) for x in q]
        scores = []
        for name, ref, t in held:
            tf = Counter(t)
            usable = [x for x in q if tf[x] and df[x] <= 0.2 * n]
            if usable:
                scores.append((-round(sum(idf[x] * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for x in usable), 9), name, ref, t))
        for rank, (_, name, ref, t) in enumerate(sorted(scores)[:25]):
            inside = set()
            for b in SequenceMatcher(None, q, t, autojunk=False).get_matching_blocks():
                inside |= set(range(b.a, b.a + b.size))
            share = round(sum(w for i, w in enumerate(weight) if i in inside) / sum(weight), 6)
            missing = list(dict.fromkeys(x for i, x in enumerate(q) if i not in inside and weight[i] > 2.0))
            options.append((-share, rank, name, kind, ref, missing))
    if not options:
        return "baseless", None, None, None
    share, _, name, kind, ref, missing = min(options)
    status = "baseless" if -share < FLOORS[kind] else "verified" if -share >= 0.85 and not missing and given in (None, ref) else "semantic_variant"
    return status, name, -share, missing


@pytest.fixture
def wordings(spark):
    texts = [f"le{i} grâce{i % 7} vient{i % 5} à celui{i} qui donne{i % 11} sans compter{i} jour{i % 3}" for i in range(40)]
    texts = [re.sub(r"\d+", lambda m: "abcdefghij"[int(m[0]) % 10] + "klmnopqrst"[int(m[0]) // 10], t) for t in texts]
    return [(f"w{i}", "verse" if i % 2 else "narration", "fr" if i % 4 < 2 else "de", f"{i}:1", t) for i, t in enumerate(texts)] + [("e", "verse", "fr", None, ""), ("n", "narration", "de", "0:0", None)]


def test_match(spark, wordings):
    texts = [w[4] for w in wordings[:40]]
    quotes = [(i, "fr" if i % 4 < 2 else "de", t, None, None) for i, t in enumerate(texts[:12])]
    quotes += [(20 + i, "fr" if i % 4 < 2 else "de", " ".join(x if j != 4 else "zzzz" for j, x in enumerate(t.split())), None, None) for i, t in enumerate(texts[:8])]
    quotes += [(40, "fr", texts[1].upper().replace("Â", "A"), None, "9:9"), (41, "fr", texts[1], "narration", None), (42, "fr", texts[1], "verse", "1:1")]
    quotes += [(50, "fr", None, None, None), (51, "fr", "", None, None), (52, "es", texts[0], None, None), (53, "fr", "zz yy xx ww", None, None), (54, None, texts[0], None, None)]
    quotes += [(60, "fr", " ".join(reversed(texts[1].split())), None, None), (61, "fr", " ".join([texts[1]] * 300), None, None)]
    found = foreign.match_quotations(spark.createDataFrame(quotes, QUOTES), spark.createDataFrame(wordings, WORDINGS), FLOORS).collect()
    assert len(found) == len(quotes)
    by = {r["quote_id"]: r for r in found}
    for q in quotes:
        r = by[q[0]]
        assert (r["status"], r["text_id"], r["share"], r["missing"]) == plain_match(q, wordings), q
    assert by[1]["status"] == "verified" and by[21]["status"] == "semantic_variant" and by[21]["missing"] == ["zzzz"]
    assert by[40]["right_reference"] == "1:1" and by[40]["status"] == "semantic_variant" and by[42]["status"] == "verified"
    assert {by[i]["status"] for i in (50, 51, 52, 53, 54)} == {"baseless"}


def test_no_wordings(spark):
    quotes = spark.createDataFrame([(1, "fr", "un deux trois quatre", None, None)], QUOTES)
    rows = foreign.match_quotations(quotes, spark.createDataFrame([], WORDINGS), FLOORS).collect()
    assert [(r["status"], r["share"]) for r in rows] == [("baseless", None)]


def test_find(spark):
    said = {"verse": r"the book says", "narration": r"the teacher[^.:]{0,40}?\s+said"}
    cues = {"narration": "teacher", "verse": "book"}
    texts = [
        (1, 'In the book: "give what you can give" and "too short". The teacher once said: seek what is good, always.'),
        (2, 'The book says "a marked passage of words", so no more. The book says: one two.\nThe book says nothing is lost here;'),
        (3, None), (4, ""), (5, "No quotation at all. " * 5000), (6, "«Один два три четыре пять»"),
    ]
    rows = foreign.find_quotations(spark.createDataFrame(texts, "doc_id int, text string"), cues, said).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["quote"], r["hint"]))
        text = dict(texts)[r["doc_id"]][r["start"] : r["end"]]
        assert text.strip('"«» .,;:') == r["quote"]
    assert got == {
        1: [("give what you can give", "verse"), ("seek what is good, always", "narration")],
        2: [("a marked passage of words", "verse"), ("nothing is lost here", "verse")],
        6: [("Один два три четыре пять", None)],
    }
