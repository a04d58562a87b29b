import unicodedata

from pyspark.sql import functions as F

from chainproof.functions import rules, similarity
from chainproof.functions import text as T


def one(spark, column, *values, names=("c",)):
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([values], schema).select(column).first()[0]


def test_normalize(spark):
    n = T.normalize(F.col("c"))
    assert one(spark, n, "محـــمد") == "محمد"
    assert one(spark, n, "  أحمدُ   إلى ") == "احمد الي"
    for word in ("أحمد", "إسحاق", "آدم"):
        assert one(spark, n, unicodedata.normalize("NFD", word)) == one(spark, n, word)
        assert one(spark, T.normalize(n), word) == one(spark, n, word)


def test_years_and_dates(spark):
    y = T.parse_years(F.col("c"))
    assert one(spark, y, None) == [] and one(spark, y, "-") == [] and one(spark, y, "") == []
    assert one(spark, y, "99هـ") == [99]
    assert one(spark, y, "178 هـ ، أو 179 هـ") == [178, 179]
    assert one(spark, y, "99999999999 2000 0") == []
    cases = [("179", "117", "possible"), ("300", "100", "impossible"), ("100", "300", "impossible"), ("200", "100 105", "impossible"), ("200", "100 115", "possible"), ("", "1", "unknown")]
    for s, t, want in cases:
        assert one(spark, rules.check_dates(T.parse_years(F.col("a")), T.parse_years(F.col("b"))), s, t, names=("a", "b")) == want


def test_null_in_every_scalar(spark):
    c = F.col("c")
    for f in (T.normalize, T.strip_phrases, T.digits_to_ascii, T.strip_footnote_refs, T.short_name, T.rank_label_short, T.printed_grade, T.severity_from_text, T.primary_year, T.combine_cities):
        assert one(spark, f(c), None) is None
    assert one(spark, T.is_mention_only(c), None) is False
    assert one(spark, T.grade_tier(c), None) == 3
    assert one(spark, T.formula_strength(c), None) == "unknown"
    assert one(spark, T.input_status(c), None) == "missing"
    assert one(spark, T.tag_reasons(F.coalesce(c, F.lit(""))), None) == []


def test_trigrams_as_defined(spark):
    assert sorted(one(spark, similarity.trigrams(F.col("c")), "ab cd")) == sorted({"  a", " ab", "ab ", "  c", " cd", "cd "})
    assert one(spark, similarity.trigram_similarity(F.col("a"), F.col("b")), "", "", names=("a", "b")) == 0


def test_protected_class_without_generation(spark):
    """Criticism of an entity without a generation text is kept."""
    from chainproof.operators import evidence as E

    entities = spark.createDataFrame([(1, None), (2, "صحابي")], "entity_id long, tabaqat string")
    grades = spark.createDataFrame([(1, 1, "b", "weak", "x"), (2, 2, "b", "weak", "x")], "grade_id long, entity_id long, source_book string, bucket string, grade_text string")
    rows = E.graded_rows(grades, E.protected_entities(entities, grades), "harshest").collect()
    assert [r["entity_id"] for r in rows] == [1]


def test_word_similarity_of_extents(spark):
    """Examples that the documentation of the database extension gives, and brute force."""
    words = ["word", "two words", "words", "a word in two words wordless", "sword", "", "two"]
    grams = lambda w: [f"  {w} "[i : i + 3] for i in range(len(w) + 1)]
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "q string, t string")
    g, o = similarity.trigrams(F.col("q")), similarity.ordered_trigrams(F.col("t"))
    out = rows.select("q", "t", similarity.extent_similarity(g, o), similarity.extent_similarity(g, o, strict=True), similarity.extent_similarity(g, o, least=0.4)).collect()
    known = {(r[0], r[1]): r[2:4] for r in out}
    assert known["word", "two words"] == (0.8, 4 / 7) and known["word", "words"] == (0.8, 4 / 7)

    def best(q, units):
        runs = [set().union(*units[i:j]) for i in range(len(units)) for j in range(i + 1, len(units) + 1)]
        return max((len(q & x) / len(q | x) for x in runs), default=0.0)

    for q, t, extent, strict, over in out:
        own = set().union(*map(grams, q.split())) if q else set()
        want = best(own, [{x} for w in t.split() for x in grams(w)]) if own else 0.0
        assert abs(extent - want) < 1e-12 and abs(strict - (best(own, [set(grams(w)) for w in t.split()]) if own else 0.0)) < 1e-12
        assert abs(over - want) < 1e-12 or want < 0.4


def test_composition_is_that_of_unicode(spark):
    """All characters of the Basic Multilingual Plane, decomposed and not, and random runs of marks and letters."""
    import random

    from chainproof.functions.nfc import nfc

    plane = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    apart = [d for c in plane if (d := unicodedata.normalize("NFD", c)) != c]
    rng = random.Random(1)
    marks = [c for c in plane if unicodedata.combining(c)]
    odd = marks + [d[0] for d in apart] + [d[-1] for d in apart] + list("aeouاوي") + [chr(c) for c in range(0x1100, 0x1200)]
    runs = ["".join(rng.choice((rng.choice(odd), rng.choice(marks), rng.choice("aeo اوي"))) for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = plane + apart + runs + ["e\u0301", "", "plain", "\U0001d15e x\u0301"]
    out = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(4).select("i", nfc(F.col("s"))).collect()
    assert all(got == unicodedata.normalize("NFC", texts[i]) for i, got in out if texts[i] != texts[-1])
    assert out and one(spark, nfc(F.col("c")), None) is None
    assert one(spark, T.normalize(F.col("c")), "Cafe\u0301 a\u064e\u0654") == "Caf\u00e9 a\u0654".replace("\u0654", "")
