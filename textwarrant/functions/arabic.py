"""Arabic spelling: folding, light stems, terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarrant.functions.text import PUNCTUATION, let, words

# Spellings of the Uthmani text and the modern spelling of each.
SPELLINGS = {
    "ذالك": "ذلك",
    "كذالك": "كذلك",
    "ذالكم": "ذلكم",
    "الرحمان": "الرحمن",
    "هاذا": "هذا",
    "هاذه": "هذه",
    "هاذان": "هذان",
    "هاؤلاء": "هؤلاء",
    "لاكن": "لكن",
    "اولائك": "اولئك",
    "الاه": "اله",
    "الالاه": "الاله",
    "ياسين": "يس",
    "طاها": "طه",
    "الربواا": "الربا",
    "الربوا": "الربا",
    "ابراهم": "ابراهيم",
    "ابرهيم": "ابراهيم",
    "الزنى": "الزنا",
    "يئوده": "يؤوده",
}
# Letters that may cling to the front of such a word, and endings after it, in their order.
CLITICS = "وفبلكسا"
ENDINGS = ["", "ه", "ها", "هم", "هما", "هن", "ك", "كم", "كما", "كن", "نا", "ي", "ى", "ين", "ان", "ا", "له", "ون", "م", "ن"]
# What the light stemmer takes off, in its order.
STEM_PREFIXES = ["وبال", "وال", "بال", "كال", "فال", "لل", "ال", "ول", "وب", "فب", "و", "ف", "ب", "ل", "ك"]
STEM_SUFFIXES = ["ها", "هم", "هن", "كم", "نا", "ات", "ون", "ين", "ان", "ه", "ي", "ك"]
# Words that say nothing about a topic.
STOPWORDS = """
ما ماذا هل كيف لماذا متي متى اين من في علي على عن الي الى مع هذا هذه ذلك تلك هو هي هم انا نحن انت اذا ان لا لم لن قد
كان كانت يكون تكون او ثم بعد قبل كل بين حتي حتى الذي التي الذين اللذين ذو ذات حكم احكام يجوز يجب
الاسلام اسلام شرعا شرع الشرع الدين ديني
""".split()

MARKS = "[ً-ٟ]*"


def fold(text: Column, keep_taa: bool = False) -> Column:
    """One spelling for the letters that editions write differently; marks go.

    The steps' order matters: a dagger alef is dropped after alef maqsura, is an
    alef with the waw before a taa marbuta, and an alef elsewhere, before marks
    and stretching go; then forms of alef become one, hamza and alef become
    alef, and taa marbuta becomes haa, unless ``keep_taa``.
    """
    steps = [
        (f"(ى{MARKS})ٰ", "$1"),
        (f"و{MARKS}ٰ(?={MARKS}ة)", "ا"),
        ("ٰ", "ا"),
        ("[ً-ٟۖ-ۭـ]", ""),
        ("[أإآٱ]", "ا"),
        ("ءا", "ا"),
    ]
    for pattern, instead in steps:
        text = F.regexp_replace(text, pattern, instead)
    return text if keep_taa else F.translate(text, "ة", "ه")


def _modern(word: Column) -> Column:
    """The modern spelling of a word whose stem is listed; the shortest clitic first, then the endings' order."""
    stems = "|".join(sorted(SPELLINGS, key=len, reverse=True))
    table = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])

    def at(n: int, ending: str) -> Column:
        rest = F.substr(word, F.lit(n + 1), F.length(word) - n - len(ending))
        fits = word.rlike(f"^[{CLITICS}]{{{n}}}({stems}){ending}$")
        return F.when(fits, F.concat(F.substr(word, F.lit(1), F.lit(n)), F.element_at(table, rest), F.lit(ending)))

    # few words have a listed stem at all
    any_ = word.rlike(f"^[{CLITICS}]{{0,3}}({stems})({'|'.join(e for e in ENDINGS if e)})?$")
    return F.when(any_, F.coalesce(*[at(n, e) for n in range(4) for e in ENDINGS], word)).otherwise(word)


def normalize(text: Column, keep_taa: bool = False) -> Column:
    """Folded, in lower case, without punctuation, in modern spelling, words parted by single spaces."""
    bare = F.regexp_replace(F.lower(fold(text, keep_taa)), PUNCTUATION, "")
    return F.array_join(F.transform(words(F.trim(F.regexp_replace(bare, r"\s+", " "))), _modern), " ")


def stem(word: Column) -> Column:
    """The word without the first prefix, then the first suffix, that leaves three letters."""
    first = F.regexp_replace(word, f"^(?:{'|'.join(STEM_PREFIXES)})(?=.{{3}})", "")
    return F.regexp_replace(first, f"(?<=.{{3}})(?:{'|'.join(STEM_SUFFIXES)})$", "")


def terms(text: Column) -> Column:
    """Stems of a text's words that are no stopwords and of more than one letter."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    held = F.filter(words(normalize(text)), lambda w: ~F.array_contains(stop, w) & (F.length(w) > 1))
    return F.transform(held, stem)


# The honorific that closes a chain of narrators, and words that may follow it.
HONORIFIC = ["صلى", "الله", "عليه", "وسلم"]
AFTER_HONORIFIC = ["قال", "يقول", "فقال", "انه", "ان"]


def body_start(normal_words: Column, most: int = 80) -> Column:
    """The place, from 0, of the first word after a chain of narrators; 0 where none closes early on."""
    closing, after = F.array(*[F.lit(w) for w in HONORIFIC]), F.array(*[F.lit(w) for w in AFTER_HONORIFIC])

    def of(w: Column) -> Column:
        last = F.least(F.size(w) - 5, F.lit(most - 1))
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        first = F.get(F.filter(starts, lambda i: F.slice(w, i + 1, 4) == closing), F.lit(0)) + 4
        follows = lambda at: ((at < F.size(w) - 1) & F.coalesce(F.array_contains(after, F.get(w, at)), F.lit(False))).cast("int")
        one = first + follows(first)
        return F.coalesce(F.when(one > first, one + follows(one)).otherwise(one), F.lit(0))

    return let(normal_words, of)


def folded(text: str) -> str:
    """``fold`` of a lexicon's form, which has no marks."""
    return text.lower().translate(str.maketrans("أإآٱة", "ااااه"))
