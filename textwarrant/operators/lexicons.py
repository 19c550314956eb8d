"""Word lists that rules read, as data. The forms and their order."""

RULING = """
سنة مؤكدة|من السنة|مسنون|يسن|تسن|حرام|محرم|محرمة|يحرم|تحرم|حرمة|لا يجوز|لا تجوز|يجوز|تجوز|جائز|جائزة|مباح|مباحة|واجب|واجبة|يجب|تجب|وجوب|فرض|فريضة|
مستحب|مستحبة|يستحب|مكروه|مكروهة|يكره|باطل|باطلة|يبطل|تبطل|لا يصح|لا تصح|يصح|تصح|بدعة|نجس|نجسة|طاهر|ينقض|لا ينقض|يفسد|تفسد|شرط|ركن|لا تجب|لا يجب|حلال|يقع|لا يقع
"""
CONSENSUS = """
بالإجماع|إجماعا|أجمع العلماء|أجمع الفقهاء|أجمعت الأمة|أجمع المسلمون|اتفق العلماء|اتفق الفقهاء|اتفقت المذاهب|باتفاق العلماء|باتفاق الفقهاء|بلا خلاف|لا خلاف|يتفقون|متفقون|
يتفق المسلمون|يتفق العلماء|بلا نزاع|العلماء متفقون|جميع العلماء|كل العلماء|المذاهب الأربعة متفقة|عند جميع المذاهب|محل إجماع
"""
HEDGE = """
على الراجح|الراجح|الأرجح|الأصح|في قول|على قول|عند الجمهور|جمهور العلماء|جمهور الفقهاء|الجمهور|اختلف|خلاف|بعض العلماء|بعض الفقهاء|عند الحنفية|عند المالكية|عند الشافعية|
عند الحنابلة|في مذهب|قولين|أقوال|الأحوط|الأظهر|المشهور|على الصحيح
"""
AGREE = """
اتفق الفقهاء|اتفق العلماء|اتفقوا|اتفق الأئمة|أجمع|الإجماع|إجماعا|بالإجماع|بلا خلاف|لا خلاف|لا نعلم خلافا|لا يعلم خلاف|باتفاق|محل اتفاق|اتفاقا|متفق عليه بين
"""
DISAGREE = """
اختلف الفقهاء|اختلف العلماء|اختلفوا|واختلف|على قولين|على أقوال|ثلاثة أقوال|ثلاثة آراء|خلافا ل|وخالف|في رواية|وفي رواية|وفي قول|والقول الثاني|وذهب|ذهب الجمهور|ذهب جمهور|
جمهور الفقهاء|وقال بعضهم|ويرى بعض|في المسألة خلاف|وعن أحمد رواية|ومقابل الأصح
"""
SCHOOLS = {
    "الحنفية": "الحنفية|أبو حنيفة|أبي حنيفة|الأحناف",
    "المالكية": "المالكية|مالك رحمه",
    "الشافعية": "الشافعية|الشافعي",
    "الحنابلة": "الحنابلة|أحمد|الحنبلية",
    "الجمهور": "الجمهور|جمهور الفقهاء",
    "الظاهرية": "الظاهرية|ابن حزم",
}
# Negated families come first: their words are not read again as the positive.
RULING_FAMILIES = {
    "غير واجب": "لا يجب|لا تجب|ليس بواجب|ليست بواجبة|غير واجب|غير واجبة|عدم الوجوب|عدم وجوب|لا يلزم",
    "لا يجوز": "لا يجوز|لا تجوز|عدم الجواز|عدم جواز|غير جائز|غير جائزة",
    "لا ينقض": "لا ينقض|لا تنقض|عدم النقض|عدم نقض|غير ناقض",
    "واجب": "واجب|واجبة|وجوب|يجب|تجب|فرض|فريضة|يفترض|لازم|يلزم",
    "سنة": "سنة|مسنون|مسنونة|يسن|تسن|مستحب|مستحبة|يستحب|استحباب|مندوب|مندوبة|يندب",
    "حرام": "حرام|محرم|محرمة|يحرم|تحرم|تحريم|حرمة",
    "مكروه": "مكروه|مكروهة|يكره|تكره|كراهة|كراهية",
    "جائز": "يجوز|تجوز|جائز|جائزة|جواز|مباح|مباحة|إباحة|يباح",
    "ينقض": "ينقض|تنقض|نقض|ناقض|ناقضة",
    "يبطل": "يبطل|تبطل|باطل|باطلة|بطلان|يفسد|تفسد|فاسد|فاسدة",
}
SAME_RULING = {"لا يجوز": ["لا يجوز", "حرام"], "حرام": ["حرام", "لا يجوز"], "غير واجب": ["غير واجب", "سنة", "جائز", "مكروه"]}
TWO_SAHIHS = ["صحيح البخاري", "صحيح مسلم"]
STRONG = ["quran", "sahihayn", "sahih", "hasan"]
SETTLED = ["quran", "sahihayn", "sahih"]
WEIGHTS = {"quran": 3.0, "sahihayn": 3.0, "sahih": 2.0, "hasan": 1.5, "disputed": 1.0, "daif": 0.5, "ungraded": 0.5}
WEAK_GRADES = ["daif", "da'if", "weak", "mawdu", "munkar", "fabricated", "batil"]
# The first category with a word in the grade is the grade's.
GRADE_CATEGORIES = {
    "fabricated": "موضوع|باطل|لا أصل له|لا اصل له|ليس له أصل|ليس له اصل|مكذوب|كذب|ليس بحديث|لا يعرف مرفوعا",
    "daif": "لم يصح|جرحه|ليس بصحيح|غير صحيح|ليس بثابت|لم يثبت|لا يثبت مرفوعا|ضعيف|ضعفه|لا يعرف|لين|منكر|لا يصح|لا يثبت|شاذ|معلول|مرسل|منقطع|واه|فيه ضعف|متروك|مجهول",
    "hasan": "حسن",
    "sahih": "صحيح|ثابت|متفق عليه|على شرط|إسناده جيد|اسناده جيد|رجاله ثقات",
}
HARD_CUES = "حديث الحديث احاديث الاحاديث روى رواه روي اخرجه الايه ايه الايات القران قرانا".split()
SAID_VERBS = "قال وقال فقال يقول ويقول قالت قوله وقوله".split()
SOURCE_WORDS = "النبي رسول تعالى سبحانه".split()
GENRE_CUES = {
    "khutbah": [
        "إن الحمد لله", "الحمد لله نحمده", "أما بعد", "عباد الله", "أيها المسلمون", "أيها المؤمنون", "أيها الإخوة", "أيها الناس", "اتقوا الله",
        "الخطبة الثانية", "أقول قولي هذا", "معاشر المسلمين", "خطبة", "الحمد لله الذي", "معاشر المؤمنين", "يا عباد الله", "أيها الأحبة",
        "إخوة الإيمان", "أوصيكم ونفسي", "بارك الله لي ولكم", "praise be to allah", "dear brothers", "brothers and sisters", "o servants of allah",
        "khutbah", "fear allah",
    ],
    "post": [
        "انشرها", r"انشر\b", "شارك", "تؤجر", "لا تجعلها تقف عندك", "أرسلها", "صدقة جارية", r"#\S+", r"[\x{1F300}-\x{1FAFF}]", r"\bshare\b",
        r"\bforward\b", r"\brepost\b", r"\blike and\b",
    ],
    "question": [
        "هل يجوز", "ما حكم", "ما الحكم", "سؤال", "أفتونا", r"\bis it (?:permissible|allowed|haram|halal)\b", "what is the ruling",
    ],
    "lesson": [
        "الدرس", "درسنا", "في هذا الدرس", "المحاضرة", "الفائدة الأولى", r"\blesson\b", r"\blecture\b",
    ],
    "article": [
        "المقال", "مقالة", "خلاصة القول", "الخاتمة", r"\barticle\b", r"\bin conclusion\b",
    ],
}
LANGUAGE_WORDS = {
    "en": "the and of is to that in it for was he his with allah prophet said says not be are this you they",
    "fr": "le la les et des est que qui dans pour une un du au il elle dit ne pas allah prophète",
    "id": "yang dan di itu dengan tidak ini dari untuk dalam adalah ke kepada allah nabi",
    "tr": "ve bir bu için ile olan de da ne gibi çok allah peygamber dedi",
    "es": "el la los las y que de es en un una por con para dijo no allah profeta",
}
URDU_LETTERS = "ٹڈڑںےۓھگچپژ"
VERDICT_RANK = ["bad", "fix", "khl", "ref", "neu", "ok"]
RULING_VERDICTS = {
    "school_differs": "bad", "consensus_claim_disputed": "bad", "agreement_differs": "bad", "stated_as_certain_disputed": "khl", "partly_disputed": "khl",
    "school_matches": "ok", "disagreement_acknowledged": "ok", "agreement_reported": "ok", "found_no_marker": "neu", "not_found": "neu",
}


def forms(listed: str) -> list[str]:
    return [f for f in listed.replace("\n", "").split("|") if f]
