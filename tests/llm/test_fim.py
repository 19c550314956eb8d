"""Fill-in-middle against a plain loop over units."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textwarrant.llm import fim

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
ODD = [None, "", "a", "abc", "é", "<P>", "x<S>y", "ab<", "😀😀 zoé", "\n\n\n", "a" * 5000, "éa" * 3000, "word, " * 2000, "<S" * 9, "S>", "Zz@[`{", "\x00\x7f\x80", "日本語 text 𐍈"]


def plain_rule(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_marks_are_those_of_the_units():
    draw = random.Random(3)
    texts = ["".join(draw.choice("abZ, .é😀<1\n") for _ in range(draw.randrange(60))) for _ in range(400)] + [x for x in ODD if x is not None]
    for size in (1, 7, 400, len(texts)):
        part = texts[:size]
        n, p, m = fim.cuts(pa.array(part), np.zeros(len(part), np.int64), np.full(len(part), 1 << 40))
        for i, t in enumerate(part):
            units = UNIT.findall(t)
            assert n[i] == len(units) and p[i] == 0 and m[i] == len("".join(units[: (1 << 40) % (len(units) + 1)])), repr(t[:40])


def test_every_cut_of_a_text_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(fim, "CHUNK", 64)
    text = "ab é, cde 😀x" * 40
    units = UNIT.findall(text)
    for u in range(len(units) + 1):
        n, p, m = fim.cuts(pa.array(["", text, None]), np.full(3, u), np.full(3, len(units)))
        assert n.tolist() == [0, len(units), 0] and p[1] == len("".join(units[:u])) and p[1] + m[1] == len(text)


def test_rows_are_those_of_the_plain_rule(spark):
    rows = [(i, t, "kept") for i, t in enumerate(ODD * 12)] + [(None, "no id here", "kept"), (3, "abc", "kept"), (3, "abc", "kept"), (77, "many words of a very long text, é 😀. " * 60_000, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut string").withColumns({"row": F.lit(1), "form": F.lit("own"), "fim_n": F.lit(-1)})
    out = fim.transform(docs)
    got = out.withColumn("again", fim.restore(F.col("fim_output"), F.col("fim_form"))).collect()
    assert set(docs.columns) <= set(out.columns) and len(got) == len(rows)
    key = lambda r: (str(r[0]), r[1] or "", str(r[1]))
    for (doc_id, text, _), r in zip(sorted(rows, key=key), sorted(got, key=lambda r: key((r.doc_id, r.text))), strict=True):
        assert (r.fim_n, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_output) == plain_rule(doc_id, text)
        assert r.again == (text or "") and r.cut == "kept" and r.row == 1 and r.form == "own"
    assert {r.fim_form for r in got} == {"plain", "psm", "spm"}


def test_an_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []
