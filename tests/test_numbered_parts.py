"""Numbered paragraphs in running text, against a plain loop."""

from __future__ import annotations

import random
import re

from textwarrant.operators.numbering import numbered_parts

NUMBER = r"(?<!\w)(\d{1,4}) - "


def plain(text):
    parts, last, place = [], 0, 0
    for m in re.finditer(NUMBER, text):
        n, at, heading = int(m[1]), m.start(), ""
        if last < n <= (last + 3 if parts else 2):
            near = max(place, at - 120)
            if (h := re.search(r"(?:^|[.)\]»؛])\s*([^.:؛()]{3,90}):\s*$", text[near:at])) and len(h[1].split()) <= 10:
                heading, at = h[1], near + h.start(1)
            parts.append([n, at, heading])
            last, place = n, at
    edges = [*(p[1] for p in parts), len(text)]
    out = [(n, a, b, h) for (n, a, h), b in zip(parts, edges[1:], strict=True)]
    return ([(parts[0][0] - 1 if parts else 0, 0, edges[0], "")] if edges[0] or not parts else []) + out


def test_numbered_parts(spark):
    draw = random.Random(5)
    pieces = ["1 - ", "2 - ", "3 - ", "4 - ", "6 - ", "9 - ", "10 - ", "a word ", "in the year 3 - and on. ", "On gold: ", "A title of far more words than ten words may be here now: ", "end. ", "(see 2 - ) ", "x" * 100 + " ", "\n"]
    texts = [(i, "".join(draw.choices(pieces, k=draw.randint(0, 25)))) for i in range(150)]
    texts += [(900, None), (901, ""), (902, "no number"), (903, "99999999999 - x"), (904, "1 - a. On gold: 2 - b"), (904, "1 - a. On gold: 2 - b"), (905, "".join(f"{i} - é text. " for i in range(1, 800)))]
    rows = numbered_parts(spark.createDataFrame(texts, "doc_id int, text string"), NUMBER).collect()
    assert sorted(tuple(r) for r in rows) == sorted((i, *p) for i, t in texts if t is not None for p in plain(t))
    assert [tuple(r)[1:] for r in rows if r["doc_id"] == 904][:2] == [(1, 0, 7, ""), (2, 7, 21, "On gold")]
