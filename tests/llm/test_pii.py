"""Personal data: the base against a plain loop over the given forms, what is added, and the estimates against plain arithmetic."""

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from textwarrant.llm import pii, queries

GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_base(text):
    found = []
    for number, (kind, form) in enumerate(GIVEN.items()):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and checksum(digits), "phone": 9 <= len(digits) <= 15}
            if fine[kind]:
                found.append((m.start(), number, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def found(spark, texts):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = pii.find(table).select("doc_id", pii.listed(F.filter("pii_spans", lambda s: s["base"])).alias("base"), pii.listed(F.col("pii_spans")).alias("all")).collect()
    return {r.doc_id: ([x for x in r.base.split(",") if x], [x for x in r.all.split(",") if x]) for r in rows}


def test_base_spans_are_those_of_the_given_forms(spark):
    draw = random.Random(7)
    parts = ["a@b.c", "x.y@z", "@", ".", "-", " ", "+1", "(", ")", "4111111111111111", "4111 1111-1111 1111", "12", "7", "300.1.2.3.4", "10.0.0.1", "001.2.3.255", "é", "😀", "_d@e.f-g.h", "word", "\n", "+49 30 1234567", "555-3296"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 14))) for _ in range(1_500)]
    texts += [None, "", "1" * 5_000, "a" * 10_000 + "@", "1.2.3.4 " * 3_000, "+1 (269) 555-3296 4524132264652876", "12 " * 5_000, "-" * 3_000]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        base, spans = got[i]
        assert base == plain_base(t), repr((t or "")[:90])
        assert set(base) <= set(spans) and len(spans) == len(set(spans))


def test_what_labelers_add(spark):
    plain = ["mail joe.b@mail3.example.com, or call +1 (269) 555-3296 now", "card 4111111111111111, host 10.11.12.13 and", "nothing of the kind, version 3.0 and 12 of 20", "the 4539578763621486 end"] * 40
    odd = {
        "call +1 (269) 555-3296 4111111111111111 then": {"phone:5:22", "card:23:39"},
        "at 4111111111111111 27.65.93.188 too": {"card:3:19", "ip:20:32"},
        "write joe [at] mail3.example [dot] com soon": {"email:6:38"},
        "order 4111111111111112 of 2024-01-02 10:20": set(),
        "look at it dot by dot, 1234 5678 90": set(),
    }
    got = found(spark, [*plain, *odd])
    for i, (text, spans) in enumerate(odd.items()):
        assert set(got[len(plain) + i][1]) == spans, text


def test_reliabilities_are_those_of_plain_rounds(spark):
    draw = random.Random(1)
    seen = {"".join(draw.choice("01-") for _ in pii.LABELERS): draw.randrange(1, 50) for _ in range(30)}
    p, yes, no = pii.START_PRIOR, [pii.START_YES] * 6, [pii.START_NO] * 6
    for _ in range(pii.ROUNDS):
        chance = {}
        for v in seen:
            odds = math.log(p / (1 - p)) + sum(math.log(y / n) if c == "1" else math.log((1 - y) / (1 - n)) if c == "0" else 0 for c, y, n in zip(v, yes, no, strict=True))
            chance[v] = 1 / (1 + math.exp(-odds))
        true, false = {v: n * chance[v] for v, n in seen.items()}, {v: n * (1 - chance[v]) for v, n in seen.items()}
        rate = lambda w, s, i: (sum(x for v, x in w.items() if v[i] == "1") + s[0]) / (sum(x for v, x in w.items() if v[i] != "-") + s[1])
        p = (sum(true.values()) + 1) / (sum(seen.values()) + 2)
        yes, no = [rate(true, pii.SEEN_YES, i) for i in range(6)], [rate(false, pii.SEEN_NO, i) for i in range(6)]
    got = pii.reliabilities(spark.createDataFrame([(0, v, n) for v, n in seen.items()], "kind int, votes string, n long")).first()
    assert abs(got.prior - p) < 1e-9 and all(abs(a - b) < 1e-9 for a, b in zip([*got.yes, *got.no], [*yes, *no], strict=True))


def test_query_of_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op13_pii(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        base = plain_base(d.text)
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k + ":") for b in base) for k in pii.KINDS]
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert (len(r.spans.split(",")) if r.spans else 0) == len(base) + r.n_added


def test_redaction_repeated_rows_and_an_empty_table(spark):
    table = spark.createDataFrame([(1, "é mail a@b.cc and 10.0.0.1.", "k"), (1, "é mail a@b.cc and 10.0.0.1.", "k"), (None, None, None)], "doc_id long, text string, kind string")
    rows = pii.find(table, keep=("doc_id", "text", "kind")).select(pii.redact(F.col("text"), F.col("pii_spans")).alias("t"), "kind").collect()
    assert sorted(str(r.t) for r in rows) == ["None", "é mail [email] and [ip].", "é mail [email] and [ip]."]
    assert pii.find(table.limit(0)).collect() == []
