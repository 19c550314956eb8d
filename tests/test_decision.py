"""Decisions about texts against a plain program of the same rules."""

import difflib
import math
import re

import pytest
from pyspark.sql import functions as F

from textwarrant.functions import arabic
from textwarrant.operators import decision, entries, regions

MARKS = "[ً-ِ]"
LEX = regions.Lexicon(["said", "says"], ["lord", "high"], ["god"], ["master"], ["also"], ["peace", "on", "him"], ("master", "god"), ["book"], r"[.!;,\n]|[«(\[]")


def norm(t):
    return " ".join(re.sub(r"[^\w\s]", "", re.sub(MARKS, "", t.lower())).split())


class Plain:
    """The rules over lists, one text at a time."""

    def __init__(self, rows, rules):
        self.rules = rules
        self.entries = []
        for i, kind, texts, group, place in rows:
            forms = list(dict.fromkeys(norm(t) for t in texts if t and norm(t)))
            if forms:
                self.entries.append(dict(id=(entries.KINDS.index(kind) + 1, i, 1), kind=kind, text=next(t for t in texts if t and norm(t)), forms=forms, at=(group, place)))
        at = {e["at"]: e for e in reversed(self.entries) if e["at"][1] is not None}
        for e in [e for e in self.entries if at.get(e["at"]) is e]:
            members = [e]
            while len(members) < 5 and (n := at.get((e["at"][0], e["at"][1] + len(members)))):
                members.append(n)
                k = max(len(m["forms"]) for m in members)
                forms = list(dict.fromkeys(" ".join(m["forms"][min(x, len(m["forms"]) - 1)] for m in members) for x in range(k)))
                self.entries.append(dict(id=(2, e["id"][1], len(members)), kind="window", text=" ".join(m["text"] for m in members), forms=forms, at=(None, None)))
        self.entries.sort(key=lambda e: e["id"])
        self.idf, self.n = {}, {}
        for kind in entries.KINDS:
            own = [e for e in self.entries if e["kind"] == kind]
            self.n[kind] = len(own)
            for e in own:
                for w in {w for f in e["forms"] for w in f.split()}:
                    self.idf[kind, w] = self.idf.get((kind, w), 0) + 1
        self.idf = {(k, w): math.log(1 + self.n[k] / df) for (k, w), df in self.idf.items()}

    def weight(self, kind, w):
        return self.idf.get((kind, w), math.log(1 + self.n[kind]))

    def rare(self, form, gate):
        x = sorted((self.weight("hadith", w) for w in form.split()), reverse=True)
        return len(x) >= 2 and x[1] >= gate[0] and sum(x) >= gate[1]

    def verbatim(self, text, form):
        if not form:
            return None
        hits = []
        for e in self.entries:
            if e["kind"] == "hadith" and not self.rare(form, self.rules.gate):
                continue
            if form in e["forms"]:
                hits.append((e["id"][0] * 2 - 1, 0, e["id"], "full", e))
            elif len(form.split()) >= 3 and any(f" {form} " in f" {f} " for f in e["forms"]):
                hits.append((e["id"][0] * 2, e["id"][2] if e["kind"] == "window" else 0, e["id"], "partial", e))
        if not hits:
            return None
        first = min(hits, key=lambda h: h[:3])
        conflict = first[4]["kind"] != "hadith" and self.conflict(text, first[4]["text"])
        return ("variant" if conflict else "verified", first[3], first[2], sum(h[:2] == first[:2] for h in hits) - 1, 1.0)

    @staticmethod
    def conflict(claim, source):
        left, right = ([w for w in t.split() if norm(w)] for t in (claim, source))
        a, b = [norm(w) for w in left], [norm(w) for w in right]
        units = lambda w: re.findall(rf"[^\W\d_]{MARKS}*", w)
        for at in range(len(b) - len(a) + 1):
            if b[at : at + len(a)] == a:
                for x, y in zip(left, right[at : at + len(a)], strict=True):
                    u, v = units(x), units(y)
                    if len(u) == len(v) and any(len(p) > 1 and len(q) > 1 and set(p[1:]) != set(q[1:]) for p, q in zip(u, v, strict=True)):
                        return True
                return False
        return False

    def alike(self, form):
        w = set(form.split())
        if len(form.split()) < 3:
            return None
        best = None
        for kind, quota in self.rules.quotas.items():
            qw, scored = sum(self.weight(kind, x) for x in w), []
            for e in (e for e in self.entries if e["kind"] == kind):
                own = {x for f in e["forms"] for x in f.split()}
                if both := sum(self.weight(kind, x) for x in w & own):
                    scored.append((-round(both / (qw + sum(self.weight(kind, x) for x in own) - both), 9), e["id"], e))
            for _, _, e in sorted(scored, key=lambda s: s[:2])[:quota]:
                for no, f in enumerate(e["forms"]):
                    s = (difflib.SequenceMatcher(None, form, f).ratio() + difflib.SequenceMatcher(None, form.split(), f.split(), autojunk=False).ratio()) / 2
                    key = (-round(s, 6), e["id"], no)
                    if s >= self.rules.variant and (best is None or key < best):
                        best = key
        return best and ("variant", "altered", best[1], 0, round(-best[0], 2))

    def holds(self, phrase):
        for e in self.entries:
            if (e["kind"] != "hadith" or self.rare(phrase, self.rules.strict_gate)) and any(f" {phrase} " in f" {f} " for f in e["forms"]):
                return e["id"]
        return None

    def runs(self, w, blocked=()):
        found, i = [], 0
        while i + 4 <= len(w):
            if any(k in blocked for k in range(i, i + 4)) or not (entry := self.holds(" ".join(w[i : i + 4]))):
                i += 1
                continue
            j = i + 4
            while j < len(w) and j not in blocked and (longer := self.holds(" ".join(w[i : j + 1]))):
                entry, j = longer, j + 1
            found.append((i, j, entry))
            i = j
        return found

    def decide(self, text):
        form = norm(text or "")
        if found := self.verbatim(text or "", form) or self.alike(form):
            return found
        if parts := self.runs(form.split()):
            return ("variant", "parts", max(parts, key=lambda p: (p[1] - p[0], -p[0]))[2], 0, round(sum(p[1] - p[0] for p in parts) / len(form.split()), 2))
        return ("baseless", None, None, 0, None)

    def regions(self, text):
        toks = [(norm(m.group()), m.start(), m.end()) for m in re.finditer(r"\S+", text) if norm(m.group())]
        out = []
        for kind, pattern in regions.MARKS:
            for m in re.finditer(pattern, text, re.S):
                n = len(norm(m[1]).split())
                if n >= 3 and not any(m.start() < e and s < m.end() for s, e, *_ in out):
                    before = [t[0] for t in toks if t[2] <= m.start()][-6:]
                    out.append((*m.span(), m[1], kind == "quran" or (kind == "curly_brace" and n >= 5) or any(w in [*LEX.speaker, *LEX.context] for w in before)))
        i = 0
        while i < len(toks):
            if toks[i][0] in LEX.said:
                near = [*LEX.speaker, *LEX.others, *LEX.between]
                m = next((k for k in range(i + 1, min(i + 4, len(toks))) if toks[k][0] in near or (k == i + 1 and toks[k][0] in LEX.names)), None)
                if m is not None:
                    f = m + 1
                    while f < len(toks):
                        if toks[f][0] in [*LEX.speaker, *LEX.others] or (toks[f][0] == "god" and toks[f - 1][0] == "master"):
                            f += 1
                        elif [t[0] for t in toks[f : f + 3]] == LEX.honorific:
                            f += 3
                        else:
                            break
                    if f < len(toks):
                        start = toks[f][1]
                        stop = re.compile(LEX.clause_end).search(text, start)
                        end = stop.start() if stop else len(text)
                        if len(norm(text[start:end]).split()) >= 3 and not any(start < e and s < end for s, e, *_ in out):
                            out.append((start, end, text[start:end], True))
                        i = max(i + 1, next((k for k, t in enumerate(toks) if t[1] >= end), len(toks)))
                        continue
            i += 1
        return sorted(out), toks

    def review(self, text):
        own = self.decide(text)
        if own[0] == "verified":
            return [(0, len(text), "sentence", *own)]
        regs, toks = self.regions(text)
        found = []
        for s, e, claim, attributed in regs:
            claim = claim.strip(regions.TRIMMED)
            if claim and ((d := self.decide(claim))[0] != "baseless" or attributed):
                found.append((s, e, "region", *d))
        marked, covered = bool(found), 0
        if len(text.split()) > 12 or own[0] == "baseless" or own[1] == "parts":
            blocked = {k for k, t in enumerate(toks) if any(s <= t[1] < e for s, e, *_ in regs)}
            for i, j, _ in self.runs([t[0] for t in toks], blocked):
                claim = text[toks[i][1] : toks[j - 1][2]].strip(regions.TRIMMED)
                d = self.verbatim(claim, norm(claim))
                if d and d[0] == "verified":
                    found.append((toks[i][1], toks[j - 1][2], "run", *d))
                    covered += len(claim.split())
        if found and (marked or covered / len(text.split()) < 0.6):
            return sorted(found, key=str)
        return [(0, len(text), "sentence", *own)]


A, I = "َ", "ِ"  # noqa: E741
ROWS = [
    (1, "verse", [f"In the be{A}ginning was a lone light over every water", "In the begining was a lone lite over every water"], "g", 1),
    (2, "verse", ["Then came a second light and stayed"], "g", 2),
    (3, "verse", ["After that none spoke of it again for long years"], "g", 3),
    (4, "verse", ["None spoke"], "h", 1),
    (5, "hadith", ["It was told by Aban from Barr from Cedric that wonderful quinces ripen slowly beneath northern glaciers in the beginning was a lone light"], None, None),
    (6, "hadith", ["He who plants quinces under glaciers waits longer than mountaineers expect"], None, None),
    (7, "verse", ["Then came a second light and stayed"], "k", 1),
    (8, "verse", [None, "", "Only as spelled here"], "k", 9),
    (9, "hadith", ["!!!", None], None, None),
]
TEXTS = [
    "In the beginning was a lone light over every water", "in the begining was a lone lite over every water!", f"In the be{I}ginning was a lone light over every water", f"was a lone light o{I}ver every",
    "Then came a second light and stayed", "light over every water then came a second", "none spoke", "None spoke of it", "In the start was a lone bright over all water", "stayed after that none spoke",
    "wonderful quinces ripen slowly beneath northern glaciers", "it was told by", "people say wonderful quinces ripen slowly beneath northern glaciers and that came a second light and stayed with us all for many long days",
    "He said lord high light over every water then came, and more words", "The master said also peace on him then came a third light and left. What", 'so the book has "Then came a third light and went" in it', 'he wrote "nothing at all of it" once',
    "they said: god none spoke of it again; and says the master god peace on him he who plants quinces under mountains waits longer than anyone", "only as spelled here", "", None, "...", "quinces glaciers", "said lord", "said high lord peace on him, light over every water",
    "a «was a lone light over» and (a second light and stayed) with after that none spoke of it again for long years in all of this prose", "came a second light and stayed after that none spoke of it again for long", "said lord one two three four said also five six seven eight; nine",
]


@pytest.fixture(scope="module")
def over(spark):
    rows = spark.createDataFrame(ROWS, "item_id long, kind string, texts array<string>, group string, place int")
    one = entries.spelled(rows, F.col("texts"), F.col("kind"))
    return decision.corpus(one.unionByName(entries.windows(one, rows.filter("place is not null").select("item_id", "group", "place"))))


RULES = decision.Rules(gate=(0.9, 4.0), strict_gate=(0.9, 4.1), lexicon=LEX)


def entry_of(r):
    return r.entry and tuple(r.entry)


@pytest.mark.parametrize("quota", [20, 1])
def test_each_decision_is_that_of_the_plain_rules(spark, over, quota):
    rules = RULES._replace(quotas={k: quota for k in entries.KINDS})
    plain = Plain(ROWS, rules)
    assert sorted(map(tuple, (r.entry for r in over.entries.collect()))) == [e["id"] for e in plain.entries]
    segs = spark.createDataFrame(list(enumerate(TEXTS)), "seg int, text string")
    got = {r.seg: r for r in decision.decide(segs, over, rules).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert (got[i].status, got[i].how, entry_of(got[i]), got[i].others, got[i].confidence) == plain.decide(t), t
    assert {(r.status, r.how) for r in got.values()} >= {("verified", "full"), ("verified", "partial"), ("variant", "full"), ("variant", "altered"), ("variant", "parts"), ("baseless", None)}


def test_each_review_is_that_of_the_plain_rules(spark, over):
    plain = Plain(ROWS, RULES)
    segs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t and norm(t)], "seg int, text string")
    got = {}
    for r in decision.review(segs, over, RULES).collect():
        got.setdefault(r.seg, []).append((r.start, r.stop, r.found, r.status, r.how, entry_of(r), r.others, r.confidence))
    for r in segs.collect():
        assert sorted(got[r.seg], key=str) == plain.review(r.text), r.text
    assert {f[2] for rows in got.values() for f in rows} == {"sentence", "region", "run"}


def test_stretches_that_are_not_found_are_told(spark):
    row = spark.sql("select split('a b c d e f g h', ' ') w, array(struct(1 as start, 2 as n_words), struct(3 as start, 4 as n_words)) runs")
    assert row.select(decision.stretches(F.col("w"), F.col("runs"))).first()[0] == ["not found: 'a'", "verbatim: 'b c'", "verbatim: 'd e f g'", "not found: 'h'"]


def test_attributed_quotations_of_arabic(spark):
    texts = ["قال تعالى إن مع العسر يسرا، ثم", "وقال النبي صلى الله عليه وسلم إنما الأعمال بالنيات وإنما", "قال الواعظ إن الله يحب الصابرين", "قال رسول الله صلى الله عليه وسلم", "قال تعالى ﴿إن مع العسر يسرا﴾", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: [(x.kind, x.text) for x in r.regions] for r in regions.quoted_regions(rows, normal=arabic.normalize).collect()}
    assert got == {0: [("attributed", "إن مع العسر يسرا")], 1: [("attributed", "إنما الأعمال بالنيات وإنما")], 2: [], 3: [], 4: [("quran", "إن مع العسر يسرا")], 5: []}


def test_letters_that_the_normal_form_makes_alike(spark):
    rules = decision.Rules(normal=arabic.normalize, strict=lambda t: arabic.normalize(t, keep_taa=True))
    rows = spark.createDataFrame([(1, ["إن رحمة الله قريب من المحسنين"])], "item_id long, texts array<string>")
    corpus = decision.corpus(entries.spelled(rows, F.col("texts"), F.lit("verse"), arabic.normalize))
    segs = spark.createDataFrame([(1, "رحمة الله قريب من"), (2, "رحمه الله قريب من"), (3, "أن رحمة الله")], "seg int, text string")
    got = {r.seg: (r.status, r.differences) for r in decision.decide(segs, corpus, rules).collect()}
    assert got == {1: ("verified", []), 2: ("variant", ["letter spelling differs from the source"]), 3: ("variant", ["explicit marks differ from the source"])}


def test_no_rows_and_no_entries(spark, over):
    none = spark.createDataFrame([], "seg int, text string")
    assert decision.review(none, over, RULES).collect() == []
    empty = decision.corpus(over.entries.limit(0))
    some = spark.createDataFrame([(1, "one two three four")], "seg int, text string")
    assert [r.status for r in decision.review(some, empty, RULES).collect()] == ["baseless"]
