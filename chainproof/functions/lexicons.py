"""Word lists, patterns and scales of the Arabic source material. Every operator
takes them as parameters, so other material brings its own."""

from __future__ import annotations

#: Letters that are folded, and what they become. Fixed values.
FOLD_FROM, FOLD_TO = "أإآٱىة", "اااايه"
#: Marks and the lengthening stroke, which are deleted. Fixed values.
MARKS = r"[\u0610-\u061A\u064B-\u065F\u0670\u0640]"
#: Those of them whose combining classes are under those of the marks that letters compose with. Fixed values.
VOWEL_SIGNS = r"[\u064B-\u0652\u0670]"
#: Text without these is composed and has no marks or folded letters.
NOT_LATIN = r"[^\x00-\u02FF]"
#: Eastern digits in order. Fixed values.
EASTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩"

#: Honorific phrases. Fixed values.
HONORIFICS = r"رضي\s+الله\s+عنه(?:م|ا|ما)?|صلى\s+الله\s+عليه\s+و?سلم|ﷺ|عليه(?:م)?\s+السلام|رحمه\s+الله(?:\s+تعالى)?|تعالى"

#: Second words of a name that a third belongs to. Fixed values.
SON_OF = ("بن", "بنت")

#: Words of a name without identity: for aligned chains, and two further profiles. Fixed values.
NAME_NOISE = {
    "align": ["ابن", "بن", "بنت", "ابو", "ابي", "ام", "امير", "المؤمنين", "حفص", "ال", "الامام", "رضي", "الله", "عنه", "عنها", "عنهم", "تعالى", "سيدنا", "مولانا", "حضرت", "او", "أو"],
    "recover": ["ابن", "بن", "بنت", "ابو", "ابي", "ام", "امير", "المؤمنين", "حفص", "ال", "الامام", "رضي", "الله", "عنه", "عنها", "عنهم", "تعالى", "سيدنا", "مولانا", "حضرت", "او", "أو"],
    "recover_graded": ["ابن", "بن", "بنت", "ابو", "ابي", "ام", "ال", "الامام", "رضي", "الله", "عنه", "عنها", "عنهم", "تعالى", "او", "أو", "ثقه", "ضعيف", "صدوق", "متروك", "كذاب", "كوفي", "بصري", "مدني", "شامي", "تابعي", "صحابي"],
}
_PLACES = ["الليثي", "الانصاري", "التيمي", "الكلابي", "الاشعري", "القرشي", "الكوفي", "البصري", "المدني", "الشامي", "الدمشقي", "البغدادي", "الحميدي", "الازدي", "التميمي", "الخزاعي", "الثقفي", "السلمي", "الجمحي"]
_MORE_PLACES = ["الفارسي", "الحارثي", "الهمذاني", "الواسطي", "المخزومي", "الزهري", "العدوي", "الجعفي", "الفزاري", "الباهلي", "الفهري", "الكناني"]
#: Words of tribe and place, by the same profiles. Fixed values.
NAME_AFFIXES = {"align": _PLACES, "recover": _PLACES + _MORE_PLACES, "recover_graded": _PLACES + _MORE_PLACES}

#: Generation words, in the order that a pattern tries them. Fixed values.
ORDINALS = ["الأولى", "الثانية", "الثالثة", "الرابعة", "الخامسة", "السادسة", "السابعة", "الثامنة", "التاسعة", "العاشرة", "الحادية عشرة", "الثانية عشرة"]
ORDINAL_PREFIX = "طبقة "

#: Verbs of a mere mention. Fixed values.
MENTION_VERBS = ["ذكره", "ذُكر", "ذكر"]

#: Grade buckets: tier and label. Fixed values.
GRADE_TIERS = {"prophet": 7, "companion": 6, "reliable": 5, "mostly_reliable": 4, "unknown": 3, "weak": 2, "abandoned": 1, "fabricator": 0}
GRADE_LABELS = {"companion": "صحابي", "reliable": "ثقة", "mostly_reliable": "صدوق", "weak": "ضعيف", "abandoned": "متروك", "fabricator": "متهم بالكذب", "unknown": "غير معروف الحال"}
UNKNOWN_LABEL = "غير معروف الحال"

#: Severity phrases, in order. Fixed values.
SEVERITY = [
    (r"كذّ?اب|وضّ?اع|يضع\s+الحديث|دجّ?ال", "fabricator"),
    (r"متروك|متَّهم\s+بالكذب|ساقط|لا\s+شيء|ليس\s+بشيء", "abandoned"),
    (r"ليس\s+بثقة|ضعيف|واهي|منكر\s+الحديث|سيّ?ئ\s+الحفظ|لين", "weak"),
]

#: Reasons of criticism: pattern, reason, family; in order. Fixed values.
REASONS = [
    (r"كذاب|كذّاب|دجال|وضّاع|يضع\s+الحديث|يضع|يكذب", "kidhb", "adala"),
    (r"متهم\s+بالكذب|متّهم\s+بالكذب|اتهموه\s+بالكذب", "tuhmat_kidhb", "adala"),
    (r"فاسق|مجاهر\s+بالفسق", "fisq", "adala"),
    (r"مجهول|لا\s+يعرف|غير\s+معروف(\s+الحال)?", "jahala", "adala"),
    (r"مبتدع|رافضي|خارجي|مرجئ|قدري\s+داعية", "bidaa", "adala"),
    (r"فاحش\s+الغلط|كثير\s+الخطأ", "fahsh_ghalat", "dabt"),
    (r"مغفّل|الغفلة|كثير\s+الغفلة", "ghafla", "dabt"),
    (r"يخطئ|كثير\s+الغلط|سيء\s+الحفظ", "ghalat", "dabt"),
    (r"مخالف\s+للثقات|خالف\s+الثقات|منكر\s+الحديث", "mukhalafa", "dabt"),
    (r"مختلط|اختلط|تغيّر|فاسد\s+الحفظ", "fasad_hifz", "dabt"),
]

#: Openings before a quoted grade. Fixed values.
PREAMBLE = r"^(قال|روى|ذكره|ذكر|وثقه|ضعفه|قال فيه)\s+\S+\s*:?\s*"

#: Verbs of reception: explicit and ambiguous. Fixed values.
EXPLICIT = ["haddathana", "haddathani", "akhbarana", "akhbarani", "anbaana", "anbaani", "samitu", "qala-li", "qala-lana"]
AMBIGUOUS = ["qala", "an", "anna"]
#: Surface forms of the verbs, longest first where one begins another. Fixed values.
FORMULAS = {
    "حدثنا": "haddathana", "حدثني": "haddathani", "أخبرنا": "akhbarana", "أخبرني": "akhbarani", "أنبأنا": "anbaana", "أنبأني": "anbaani",
    "سمعت": "samitu", "قال لي": "qala-li", "قال لنا": "qala-lana", "قال": "qala", "عن": "an", "أن": "anna",
}

#: Ranks of attested verbs. Fixed values.
VERB_RANKS = {"samaa": 5, "liqa": 4, "idraka": 3, "rawa": 2, "kataba": 1}
VERB_LABELS = {"samaa": "صرَّح بالسماع", "liqa": "ثبت اللقاء", "idraka": "أدركه", "rawa": "روى عنه", "kataba": "كاتبه"}
#: Opening of a phrase that makes the subject the teacher. Fixed value.
TEACHER_PHRASE = "روى عنه"
#: Authors of works on meetings that did not happen. Fixed values.
DENIAL_AUTHORS = {"marasil_ibn_abi_hatim": "ابن أبي حاتم", "jami_al_tahsil": "العلائي", "tahdhib": "ابن حجر"}
DENIAL_AUTHOR = "أئمة الفنّ"

#: Tests of the protected class by profile: patterns on generation, on grade text; whether the
#: grade bucket counts. Fixed values.
PROTECTED = {
    "ascription": (r"صحاب|صحبة|له\s+رؤية", r"صحاب|صحبة|له\s+صحبة|أدرك\s+النبي", True),
    "spread": (r"صحاب|صحبة|له\s+صحبة|أدرك\s+النبي|العشرة", r"صحاب|صحبة|له\s+صحبة|أدرك\s+النبي|العشرة", True),
    "grade": (r"صحاب|صحبة|له\s+رؤية|العشرة", r"صحاب|صحبة|له\s+صحبة", False),
    "entity": (r"صحاب|العشرة", r"صحاب|صحبة|له\s+صحبة|أدرك\s+النبي", True),
}
#: Successor tests on the generation text. Fixed values.
SUCCESSOR, SUCCESSOR_GENERATIONS, NOT_SUCCESSOR = "تابع", "الثانية|الثالثة|الرابعة", "الصحاب|الأولى"

#: Markers of ascription on normalised text. Fixed values.
DIVINE = r"(قال\s+الله(\s+تعالي|\s+عز\s+و?جل|\s+تبارك\s+و?تعالي)?|يقول\s+الله(\s+تعالي|\s+عز\s+و?جل)?|فيما\s+يرويه?\s+عن\s+رب|عن\s+رب[هك]|يقول\s+ربكم)"
RAISED = r"(رسول\s+الله(\s+صلي\s+الله\s+عليه\s+و?سلم)?|النبي(\s+صلي\s+الله\s+عليه\s+و?سلم)?|محمد(ا)?\s+(صلي|رسول)|ﷺ|صلي\s+الله\s+عليه\s+و?سلم)"
RAISED_IN_EFFECT = r"(امرنا(\s+ب|\s+ان)|نهينا(\s+عن|\s+ان)|يبلغ\s+به(\s+النبي|\s+رسول)?|يرفعه|رواية|من\s+السنه)"

#: The appended source. Fixed values.
SOURCE_ID, SOURCE_NAME, SOURCE_GRADE, SOURCE_DEATH, SOURCE_CITIES = -1, "رسول الله ﷺ", "prophet", "11 هـ", "المدينة، مكة"

#: Keywords at which a verdict starts. Fixed values.
VERDICT_WORDS = ["ثقة", "ثبت", "حافظ", "صدوق", "لا بأس به", "حسن الحديث", "ضعيف", "متروك", "ليس بشيء", "ليس بثقة", "مجهول", "صحابي", "تابعي", "من كبار التابعين", "كذاب", "وضاع", "منكر الحديث", "لين الحديث"]
DEFAULT_VERDICT = "ذكره العجلي في معرفة الثقات"
#: Openings of a narration. Fixed values.
NARRATION = r"^(روى\s+(?:عن|عنه)|حدثنا|حدثناه|أخبرنا|أنبأنا|قال\s+حدثنا|قال\s+أخبرنا|أملى\s+علينا|سمعت)(?=\s|$)"
#: A critic's name as it is spelt, and the verbs before it. Fixed values.
SPEAKER = r"(?:قال|وقال|قال\s+لي|سئل|وذكر|قال\s+لنا)\s+(?:(?:أبو|أبي)\s+الحسن\s+)?ال[دذ][َّ ]*ا?رَ?ا?قُ?ط[ْ]?نِ?ي[ّ]?\s*(?::|في\s+«[^»]+»\s*:)"
RELAY = r"قال\s+([^:]{1,40})\s*:\s*$"
#: Marks of parallel chains and of joint speech; relatives. Fixed values.
BRANCH_MARK, LINK, JOINT = "ح", "عن", ("قالا", "قالوا", "كلاهما", "كلهم", "جميعا")
FATHER, GRANDFATHER = ("أبيه", "ابيه"), ("جده",)
#: How a name that is the source begins, on normalised text. Fixed value.
SOURCE_MENTION = r"^(?:رسول\s+الله|النبي|محمد\s+رسول|سيدنا\s+محمد|محمد\s+صلي|ﷺ)"
#: Levels of spread. Fixed values.
MANY, SOME, TWO = 10, 3, 2
