"""Worked examples of rules over small tables written out here, with their answers worked out by hand."""

import base64
from collections.abc import Callable
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarrant.functions import arabic, clean, fuzzy, parse
from textwarrant.functions.text import normalize, words
from textwarrant.operators import regions, review, rules, spans

EXAMPLES: dict[str, tuple[Callable[[SparkSession], DataFrame], str]] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        EXAMPLES[f.__name__] = (f, sql)
        return f

    return add


CASES: list[tuple[str, Callable[[Column], Column], str, str]] = []


def by_hand(name: str, rule: Callable[[Column], Column], cases: dict[str, str]) -> None:
    CASES.extend((name, rule, text, answer) for text, answer in cases.items())




@query("""select * from (values (1, 0, 20), (1, 60, 100), (2, 0, 10), (3, 5, 8)) v(id, start, "end")""")
def span_subtract(spark: SparkSession) -> DataFrame:
    whole = spark.createDataFrame([(1, 0, 100), (2, 0, 10), (3, 0, 8), (4, 2, 6)], "id int, start int, end int")
    cuts = spark.createDataFrame([(1, 20, 40), (1, 30, 60), (2, 10, 12), (3, 0, 5), (4, 0, 9)], "id int, start int, end int")
    return spans.subtract(whole, cuts, ["id"]).select("id", "start", "end")




@query("""select * from (values (1, 'b', 5, 15), (1, 'd', 20, 30), (2, 'x', 0, 3), (2, 'y', 3, 6)) v(id, name, start, "end")""")
def greedy_select(spark: SparkSession) -> DataFrame:
    rows = [(1, "a", 0, 10, 0.7), (1, "b", 5, 15, 0.9), (1, "c", 14, 22, 0.8), (1, "d", 20, 30, 0.6), (2, "x", 0, 3, 0.5), (2, "y", 3, 6, 0.5)]
    table = spark.createDataFrame(rows, "id int, name string, start int, end int, share double")
    return spans.greedy(table, ["id"], [-F.col("share"), F.col("name")], ["name"]).select("id", "name", "start", "end")




@query("""select * from (values (1, 'aXYef.'), (2, 'abcd'), (3, 'one three')) v(id, text)""")
def apply_edits(spark: SparkSession) -> DataFrame:
    rows = [(1, "abcdef.", [(1, 4, "XY"), (0, 2, "no")]), (2, " . abcd", []), (3, "one two three", [(4, 7, "")])]
    table = spark.createDataFrame(rows, "id int, text string, edits array<struct<start:int,end:int,to:string>>")
    return table.select("id", spans.apply_edits(F.col("text"), F.col("edits")).alias("text"))


by_hand("labelled_record", lambda t: F.array_join(F.transform(F.array_sort(F.map_entries(parse.labelled(t))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"), {
    "الراوي: أنس | المحدث: فلان - المصدر: كتاب الصفحة أو الرقم: 12 | خلاصة حكم المحدث: صحيح": "grade=صحيح;narrator=أنس;page=12;scholar=فلان;source=كتاب", "نص": "",
})
by_hand("strict_json_claims", lambda t: F.coalesce(F.array_join(parse.strict_claims(t), "+"), F.lit("error")), {'{"claims":["a"," "]}': "a", '{"claims":"a"}': "error", "not json": "error", "{}": "error", '{"claims":["x"," y "]}': "x+y", '{"claims":[]}': "", '{"claims":[1]}': "error"})
by_hand("reference_range", lambda t: F.coalesce(F.array_join(parse.reference(t), ","), F.lit("error")), {"33:41-42": "33:41,33:42", "115:1": "error", "2:5-3": "error", "2:1-13": "error", "1:7": "1:7", "x": "error"})
by_hand("image_payload", lambda t: F.coalesce(parse.image_payload(t)["error"], parse.image_payload(t)["bytes"].cast("string")), {
    "data:image/png;base64," + base64.b64encode(b"12345").decode(): "5", "data:text/html;base64,AAAA": "not an image", "hello": "not an image", "data:image/jpeg;base64,A": "not base64",
})
by_hand("day_pack", lambda t: F.concat_ws(" ", parse.pack_day(t.cast("date")).cast("string"), parse.unpack_day(parse.pack_day(t.cast("date"))).cast("string")), {"2026-03-19": "32845 2026-03-19", "2026-01-01": "32768 2026-01-01"})
by_hand("plain_number", lambda t: parse.plain_number(t.cast("double")), {"7.0": "7", "7.5": "7.5", "0": "0"})


@query("""select * from (values (1, '''b'' differs from ''x''; missing words: ''d'''), (2, 'extra words: ''c'''), (3, '')) v(id, said)""")
def word_diff(spark: SparkSession) -> DataFrame:
    table = spark.createDataFrame([(1, "a b c", "a x c d"), (2, "a b c", "a b"), (3, "A, b", "a b!")], "id int, a string, b string")
    return table.select("id", F.array_join(fuzzy.word_differences(words(normalize(F.col("a"))), words(normalize(F.col("b")))), "; ").alias("said"))




@query("""select * from (values (1, 'one two', 'tree', 'three', 'four five six')) v(id, before, a, b, after)""")
def reading_diff(spark: SparkSession) -> DataFrame:
    table = spark.createDataFrame([(1, "one two tree four five six seven", "One two three four five six seven.")], "id int, a string, b string")
    raw = lambda c: F.split(c, " ")
    found = fuzzy.readings(raw(F.col("a")), F.transform(raw(F.col("a")), normalize), raw(F.col("b")), F.transform(raw(F.col("b")), normalize))
    return table.select("id", F.explode(found).alias("d")).select("id", "d.*")


by_hand("arabic_normalize", arabic.normalize, {
    "الصَّلَاةُ": "الصلاه", "كـــتاب": "كتاب", "آمَنَ": "امن", "ذٰلك": "ذلك", "موسىٰ": "موسى", "الصلوٰة": "الصلاه", "Hello, World!": "hello world",
    "لٰكنهم": "لكنهم", "إبراهم": "ابراهيم", "وهٰذا  الكتاب": "وهذا الكتاب", "": "", "!!": "",
})
by_hand("arabic_keep_taa", lambda t: arabic.normalize(t, keep_taa=True), {"الصَّلَاةُ": "الصلاة", "سنة": "سنة"})
by_hand("light_stem", arabic.stem, {"المسلمون": "مسلم", "والكتاب": "كتاب", "كتابهم": "تاب", "من": "من", "الله": "الل", "بيت": "بيت", "صلاتها": "صلات"})
by_hand("search_terms", lambda t: F.array_join(arabic.terms(t), " "), {"ما حكم الصلاة في البيت": "صلا بيت", "هل يجوز هذا": ""})
by_hand("body_start", lambda t: arabic.body_start(words(arabic.normalize(t))).cast("string"), {
    "حدثنا فلان عن فلان قال رسول الله صلى الله عليه وسلم قال انما الاعمال بالنيات": "12", "نص بلا سند": "0", "صلى الله عليه وسلم انه قال ان الاعمال": "6",
})
by_hand("ruling_assertion", rules.assertion, {
    "زكاة الحلي واجبة بالإجماع": "consensus", "صلاة الضحى سنة": "definite", "الوتر سنة عند الجمهور": "hedged", "هذه واجبات منزلية": "none", "في سنة 1400": "none", "يجوز ذلك على الراجح": "hedged",
})
by_hand("ruling_agreement", rules.agreement, {
    "اتفق الفقهاء على ذلك": "agreement", "اختلف الفقهاء في ذلك": "disagreement", "لا خلاف في ذلك": "agreement", "اتفق الفقهاء على الأصل وذهب الحنفية إلى غيره": "both", "نص عادي": "none",
})
by_hand("ruling_families", lambda t: F.array_join(rules.rulings(t), "+"), {
    "لا يجب الوتر": "غير واجب", "الوتر واجب ويسن قبله الشفع": "واجب+سنة", "لا يجوز ويحرم": "لا يجوز+حرام", "بيع جائز": "جائز", "نص": "", "يكره وقيل يحرم ثم يكره": "مكروه+حرام",
})
by_hand("schools_named", lambda t: F.array_join(rules.schools(t), "+"), {"ذهب الحنفية والشافعية إلى ذلك": "الحنفية+الشافعية", "قال أحمد": "الحنابلة", "نص": ""})
by_hand("school_positions", lambda t: F.array_join(F.transform(rules.positions(t), lambda p: F.concat(F.array_join(p["schools"], "+"), F.lit("="), F.coalesce(p["ruling"], F.lit("-")))), ";"), {
    "ذهب الحنفية إلى أنه واجب. وقال الشافعية إنه مستحب. وهذا نص آخر طويل بلا ذكر.": "الحنفية=واجب;الشافعية=سنة", "قصير": "",
})
by_hand("grade_category", rules.grade_category, {"إسناده صحيح": "sahih", "لا يصح": "daif", "حديث حسن": "hasan", "موضوع": "fabricated", "كذا": "other", "ليس بصحيح": "daif"})
by_hand("claim_cue", lambda t: rules.has_claim_cue(t).cast("string"), {"رواه مسلم": "true", "قال النبي كذا": "true", "قال الرجل": "false", "نبينا محمد": "false"})
by_hand("text_genre", rules.genre, {
    "إن الحمد لله نحمده ونستعينه": "khutbah", "انشرها تؤجر": "post", "هل يجوز كذا؟": "question", "كلام عادي": "text", "In conclusion this article ends": "article", "lorem " * 230: "article", "the lesson was a lecture": "lesson",
})
by_hand("text_language", rules.language, {
    "هذا نص": "ar", "یہ ایک ہے اور ڈر ٹھیک گھر": "ur", "the prophet said": "en", "le prophète dit": "fr", "yang dan di": "id", "bu ve bir": "tr", "el profeta dijo": "es", "xyz qqq": "other", "123": "ar",
})


@query("""select * from (values (1, 'sahihayn', 2), (2, 'disputed', 3), (3, 'hasan', 3), (4, 'ungraded', 3), (5, 'quran', 1), (6, 'daif', 3), (7, 'sahih', 3), (8, null, null)) v(id, strength, level)""")
def source_strength(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "hadith", "صحيح مسلم", ["Daif"]), (2, "hadith", "b", ["Sahih", "Daif"]), (3, "hadith", "b", ["Hasan"]), (4, "hadith", "b", []), (5, "quran", "q", None),
        (6, "hadith", "b", ["Weak"]), (7, "hadith", "b", ["Hasan", "Sahih li ghairihi"]), (8, "other", "b", None),
    ]
    table = spark.createDataFrame(rows, "id int, classification string, book string, grades array<string>")
    return table.select("id", rules.strength(F.col("classification"), F.col("book"), F.col("grades")).alias("strength"), rules.level(F.col("classification"), F.col("book")).alias("level"))




@query("""select * from (values (1, 'mixed', 20.0, 0.5), (2, 'supported_weakly', 0.5, 0.0), (3, 'no_clear_evidence', 0.0, 0.5), (4, 'contradicted', 0.0, 1.5), (5, 'no_clear_evidence', 0.0, 0.0), (6, 'supported', 1.0, 0.0)) v(id, outcome, pro, contra)""")
def claim_outcome(spark: SparkSession) -> DataFrame:
    rows = [
        (1, [("sahih", None)] * 10, [("daif", True)]), (2, [("daif", True)], []), (3, [], [("daif", None)]), (4, [], [("hasan", True)]), (5, [], []), (6, [("sahih", False)], []),
    ]
    kind = "array<struct<strength:string,covers_all:boolean>>"
    table = spark.createDataFrame(rows, f"id int, s {kind}, c {kind}")
    return table.select("id", rules.outcome(F.col("s"), F.col("c")).alias("outcome"), rules.evidence_weight(F.col("s")).alias("pro"), rules.evidence_weight(F.col("c")).alias("contra"))




@query("""select * from (values (1, 'not_found'), (2, 'consensus_claim_disputed'), (3, 'stated_as_certain_disputed'), (4, 'disagreement_acknowledged'), (5, 'partly_disputed'), (6, 'agreement_differs'), (7, 'agreement_reported'), (8, 'found_no_marker'), (9, 'found_no_marker')) v(id, status)""")
def ruling_status(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "definite", [], None, []), (2, "consensus", ["disagreement"], None, []), (3, "definite", ["agreement", "disagreement"], None, []), (4, "hedged", ["disagreement"], None, []),
        (5, "definite", ["both"], None, []), (6, "definite", ["agreement"], "هذا واجب", ["سنة"]), (7, "definite", ["agreement"], "لا يجوز كذا", ["حرام"]), (8, "definite", ["agreement"], "نص", ["حرام"]), (9, "none", ["none"], None, []),
    ]
    table = spark.createDataFrame(rows, "id int, assertion string, marks array<string>, claim string, reported array<string>")
    way = rules.direction(F.col("claim"), F.col("reported"))
    return table.select("id", rules.ruling_status(F.col("assertion"), F.col("marks"), way).alias("status"))




@query("""select * from (values (1, 'ok', 'أ'), (2, 'ok', 'أ'), (3, 'bad', 'ج'), (4, 'khl', 'ج'), (5, 'fix', 'ج'), (6, 'fix', 'أ'), (7, 'bad', null), (8, 'ok', 'ب')) v(id, verdict, level)""")
def quote_verdict(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "verified", "quran", True, "quran"), (2, "verified", "hadith", True, "sahih"), (3, "verified", "hadith", True, "daif"), (4, "verified", "hadith", True, "disputed"),
        (5, "verified", "hadith", True, "ungraded"), (6, "semantic_variant", "quran", True, "quran"), (7, "baseless", "unverified", False, None), (8, "verified", "hadith", True, "hasan"),
    ]
    table = spark.createDataFrame(rows, "id int, status string, classification string, has_source boolean, strength string")
    status, source, strength = F.col("status"), F.col("has_source"), F.col("strength")
    return table.select("id", rules.segment_verdict(status, F.col("classification"), source, strength).alias("verdict"), rules.segment_level(status, source, strength).alias("level"))




@query("""select * from (values (1, 'bad', 2), (2, 'ok', 0), (3, 'khl', 1)) v(id, worst, blocking)""")
def review_assessment(spark: SparkSession) -> DataFrame:
    """The gravest verdict of a text's findings and how many of them stand in the way."""
    rows = [(1, "mixed", None), (1, "none", "school_differs"), (1, "none", "agreement_reported"), (2, "none", "school_matches"), (3, "mixed", None), (3, "evidence_only", None)]
    table = spark.createDataFrame(rows, "id int, outcome string, status string").withColumn("v", rules.claim_verdict(F.col("outcome"), F.col("status")))
    return table.groupBy("id").agg(F.collect_list("v").alias("all"), F.count_if(F.col("v").isin("bad", "fix", "khl")).alias("blocking")).select("id", rules.worst(F.col("all")).alias("worst"), "blocking")




@query("""select * from (values ('b', 1, 1, 'same'), ('b', 2, null, 'a'), ('b', 3, 3, 'similar'), ('b', 4, null, 'a'), ('b', 5, 6, 'same'), ('b', 6, 5, 'moved'), ('b', null, 7, 'b'), ('c', 1, 1, 'same'), ('c', 2, 2, 'place')) v(book, a_at, b_at, how)""")
def sequence_merge(spark: SparkSession) -> DataFrame:
    a = [("b", 1, "first one", "x"), ("b", 2, "only here", "x"), ("b", 3, "the third text of all", "x"), ("b", 4, "zzzz", "x"), ("b", 5, "moves about", "x"), ("b", 6, "the last", "x")]
    b = [("b", 1, "first one", "x"), ("b", 3, "the third text of alls", "x"), ("b", 4, "", ""), ("b", 5, "the last", "x"), ("b", 6, "moves about", "x"), ("b", 7, "new", "x")]
    a, b = [*a, ("c", 1, "x y", "x"), ("c", 2, "gone there", "x")], [*b, ("c", 1, "x y", "x"), ("c", 2, "", "")]
    kind = "book string, at long, key string, text string"
    a, b = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    return review.merge_editions(a, b, "book")




@query("""select * from (values (1, true), (2, false), (3, true), (4, false), (5, true)) v(id, fits)""")
def similar_accept(spark: SparkSession) -> DataFrame:
    rows = [(1, 0.5, 4, 0.7, 6), (2, 0.5, 4, 0.69, 6), (3, 0.75, 3, 0.8, 4), (4, 0.6, 9, 0.9, 14), (5, 0.65, 9, 0.9, 14)]
    table = spark.createDataFrame(rows, "id int, share double, matched int, cosine double, n int")
    return table.select("id", review.accepts_similar(F.col("share"), F.col("matched"), F.col("cosine"), F.col("n")).alias("fits"))




@query("""select * from (values (1, true), (2, false), (3, false), (4, true)) v(id, kept)""")
def rewrite_order(spark: SparkSession) -> DataFrame:
    rows = [(1, "a c", "a b c"), (2, "c a", "a b c"), (3, "a x", "a b c"), (4, "b b", "a b c b")]
    table = spark.createDataFrame(rows, "id int, wanted string, held string")
    return table.select("id", review.keeps_order(words(F.col("wanted")), words(F.col("held"))).alias("kept"))




@query("""select * from (values (1, 'quran', true, 'إن مع العسر يسرا'), (1, 'round', false, 'هذا قول من الناس'), (2, 'curly_brace', false, 'a b c'),
 (3, 'curly_brace', true, 'one two three four five'), (4, 'guillemets', true, 'واحد اثنان ثلاثة')) v(id, kind, attributed, text)""")
def marked_regions(spark: SparkSession) -> DataFrame:
    rows = [
        (1, 'قال تعالى ﴿إن مع العسر يسرا﴾ ثم "كلمة واحدة" و(هذا قول من الناس)'), (2, "he said [one two {a b c} three] and {x y}"),
        (3, "{one two three four five}"), (4, "في محكم التنزيل «واحد اثنان ثلاثة»"), (5, ""), (6, None),
    ]
    found = regions.marked_regions(spark.createDataFrame(rows, "id int, text string")).select("id", F.explode("regions").alias("r"))
    return found.select("id", "r.kind", "r.attributed", "r.text")



by_hand("grade_label", clean.grade_label, {"": "—", "Weird": "Weird", " odd ": "odd", "unknown": "unknown"})


@pytest.mark.parametrize("name", sorted({c[0] for c in CASES}))
def test_rule(spark, name):
    own = [(i, c) for i, c in enumerate(CASES) if c[0] == name]
    rows = spark.createDataFrame([(i, c[2]) for i, c in own], "i int, text string")
    got = {r.i: r.answer for r in rows.select("i", own[0][1][1](F.col("text")).alias("answer")).collect()}
    assert got == {i: c[3] for i, c in own}


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_example(spark, name):
    build, sql = EXAMPLES[name]
    expected = duckdb.connect().sql(sql)
    columns = expected.columns
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in build(spark).collect()))) == sorted(map(str, (tuple(float(x) if isinstance(x, Decimal) else x for x in r) for r in expected.fetchall())))
