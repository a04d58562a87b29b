"""The audit of whole texts on a small fixture of Arabic names, with expectations by hand; and the fold of
names against brute force."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chainproof.functions import lexicons as X
from chainproof.operators import chains as C
from chainproof.operators.audit import Registry, audit

PASSAGE = "انما الاعمال بالنيات ولكل امرئ ما نوي"


@pytest.fixture(scope="module")
def registry(spark):
    people = [
        (1, "مالك بن أنس", "السابعة", "ثقة", "reliable", "179 هـ", None, False),
        (2, "نافع مولى ابن عمر", "الثالثة", "ثقة", "reliable", "117 هـ", None, False),
        (3, "عبد الله بن عمر", "صحابي", "", "companion", "73 هـ", None, False),
        (4, "سفيان الضعيف البصري", "العاشرة", "ضعيف", "weak", "200 هـ", None, False),
        (5, "سليمان المدلس الكوفي", "الخامسة", "ثقة", "reliable", "140 هـ", 4, None),
        (6, "قتيبة البعيد", "العاشرة", "ثقة", "reliable", "400 هـ", None, False),
    ]
    entities = spark.createDataFrame(people, "entity_id long, full_name string, tabaqat string, grade_text string, bucket string, death string, tadlis_tier int, practices_taswiya boolean")
    edges = spark.createDataFrame([(1, 2, ["b1", "b2"]), (2, 3, ["b1"]), (4, 2, ["b1"]), (5, 2, ["b1"])], "student_id long, teacher_id long, books array<string>")
    denials = spark.createDataFrame([(1, 4, 3, "tahdhib", "لم يسمع منه")], "denial_id long, student_id long, teacher_id long, source_book string, phrase string")
    verbs = spark.createDataFrame([(1, 1, 2, "samaa", "b1", "سمع منه")], "attestation_id long, student_id long, teacher_id long, verb string, source_book string, phrase string")
    chain = "حدثنا مالك بن أنس عن نافع مولى ابن عمر عن عبد الله بن عمر: "
    other = "حدثنا سفيان الضعيف البصري عن نافع مولى ابن عمر عن أمير المؤمنين عبد الله بن عمر: "
    corpus = [(10, "x", chain + PASSAGE), (11, "y", other + PASSAGE), (12, "x", PASSAGE), (13, "z", "حدثنا قتيبة البعيد: كلام غير ذلك كله"), (14, "z", None)]
    return Registry(
        entities=entities, variants=entities.selectExpr("entity_id", "full_name as variant"), prominence=spark.createDataFrame([(i, 7 - i) for i in range(1, 7)], "entity_id long, prominence long"),
        edges=edges, denials=denials, verbs=verbs, corpus=spark.createDataFrame(corpus, "text_id long, book_id string, text string"))


def test_audit(spark, registry):
    raised = "قال رسول الله صلى الله عليه وسلم " + PASSAGE
    texts = [
        (1, f"حدثنا مالكُ بن أنس رضي الله عنه، عن نافع مولى ابن عمر، عن عبد الله بن عمر: {raised}"),
        (2, f"حدثنا سفيان الضعيف البصري عن نافع مولى ابن عمر عن عبد الله بن عمر: {raised}"),
        (3, f"حدثنا سفيان الضعيف البصري عن عبد الله بن عمر: {raised}"),
        (4, f"حدثنا قتيبة البعيد عن نافع مولى ابن عمر: {PASSAGE}"),
        (5, f"حدثنا سليمان المدلس الكوفي عن نافع مولى ابن عمر عن عبد الله بن عمر: {raised}"),
        (6, f"حدثنا زفزاف ضضض عن نافع مولى ابن عمر: {PASSAGE}"),
        (7, PASSAGE), (8, None), (9, "ن" * 4001), (10, "لا شيء من ذلك"),
        (11, f"حدثنا سفيان الضعيف البصري عن عبد الله بن عمر ح وحدثنا مالك بن أنس عن نافع مولى ابن عمر عن عبد الله بن عمر: {raised}"),
        (12, f"حدثنا مالك بن أنس عن نافع مولى ابن عمر وعن عبد الله بن عمر: {PASSAGE}"),
    ]
    rows = {r["text_id"]: r for r in audit(spark.createDataFrame(texts, "text_id long, text string"), registry).collect()}
    assert len(rows) == len(texts)
    one = rows[1]
    # the corpus has the passage three times, in two books, twice with a chain; the fold takes the two spellings of 3 for one
    assert (one["matches"], one["distinct_books"], one["total_chains"], one["min_count"], one["narrowest_level"]) == (3, 2, 2, 1, 0)
    assert (one["verdict"], one["attribution"], one["terminal_id"], one["spread"], one["ways"]) == ("sahih_candidate", "marfu_sarih", 3, "gharib_mutlaq", 1)
    assert (one["rank"], one["acceptance"], one["break_type"], one["strength"], one["ruling"]) == ("sahih_li_dhatih", "maqbul", "none", "some_heard", "clean")
    assert one["explanation"] == "heard | 1 > 2"
    assert rows[2]["verdict"] == "daif" and rows[2]["acceptance"] == "mardud" and rows[2]["explanation"].startswith("weak | 4 | ")
    assert rows[3]["verdict"] == "broken" and rows[3]["break_type"] == "muallaq" and "لم يسمع منه" in rows[3]["explanation"]
    assert rows[4]["verdict"] == "broken" and rows[4]["explanation"] == "dates | 6 > 2" and rows[4]["attribution"] == "maqtu"
    assert rows[5]["ruling"] == "suspended" and rows[5]["verdict"] == "sahih_candidate"
    assert rows[6]["verdict"] == "needs_review" and rows[6]["rank"] == "needs_review" and rows[6]["acceptance"] == "indeterminate"
    assert (rows[7]["status"], rows[7]["verdict"], rows[7]["matches"], rows[7]["rank"], rows[7]["spread"]) == ("ok", "needs_review", 3, None, "unknown")
    assert (rows[8]["status"], rows[8]["verdict"], rows[9]["status"]) == ("missing", None, "too_long")
    assert (rows[10]["verdict"], rows[10]["matches"]) == ("needs_review", 0)
    # from the pivot, the other branch claims a contact that dates forbid
    assert (rows[12]["branches"], rows[12]["verdict"], rows[12]["terminal_id"]) == (2, "sahih_candidate", 2)
    assert (rows[11]["branches"], rows[11]["verdict"], rows[11]["confirmed_by"]) == (2, "sahih_candidate", None)


def test_fold_of_names_is_brute_force(spark):
    names = ["مالك بن انس", "مالك", "ابو عبد الله مالك بن انس", "عمر بن الخطاب", "امير المؤمنين عمر بن الخطاب", "بن", "ابن", "بن", "نافع مولي عمر", "عمر نافع", "سعيد الكوفي", "سعيد"]
    chains = [(p, 100 - (i * 37) % 50, i, [names[(i * 5 + k * p) % len(names)] for k in range(1 + i % 4)]) for p in (1, 2) for i in range(30)]
    noise, places = set(X.NAME_NOISE["align"]), set(X.NAME_AFFIXES["align"])
    tokens = lambda n: {w for w in n.split() if len(w) >= 2 and w not in noise | places}

    def same(a, b):
        x, y = tokens(a), tokens(b)
        if not x or not y:
            return a == b
        return 2 * len(x & y) >= len(x | y) or (min(len(x), len(y)) >= 2 and (x <= y or y <= x))

    want = {}
    for p in (1, 2):
        levels = defaultdict(list)
        for _, _, _, own in sorted((c for c in chains if c[0] == p), key=lambda c: (-c[1], c[2])):
            for level, n in enumerate(reversed(own)):
                if not any(same(g, n) for g in levels[level]):
                    levels[level].append(n)
        want |= {(p, level): (len(g), g[:5]) for level, g in levels.items()}
    got = C.level_counts(spark.createDataFrame(chains, "passage_id long, score long, chain_id long, names array<string>")).collect()
    assert {(r["passage_id"], r["level"]): (r["n"], r["samples"]) for r in got} == want


def test_fold_in_rounds_is_the_fold(spark):
    """Random names of few tokens, so that runs of names decide each other."""
    import random

    rng = random.Random(2)
    words = ["مالك", "انس", "عمر", "نافع", "زيد", "بكر"]
    rows = [(g, i, " ".join(rng.sample(words, rng.randint(1, 4)))) for g in range(25) for i in range(30)]
    rows = list({(g, n): (g, i, n) for g, i, n in rows}.values())
    same = lambda x, y: 2 * len(x & y) >= len(x | y) or (min(len(x), len(y)) >= 2 and (x <= y or y <= x))
    want = set()
    for g in range(25):
        stay = []
        for _, _, n in sorted(r for r in rows if r[0] == g):
            if not any(same(set(n.split()), set(m.split())) for m in stay):
                stay.append(n)
        want |= {(g, n) for n in stay}
    got = C.folded_names(spark.createDataFrame(rows, "g long, o long, name string"), ["g"], noise=["بن"], affixes=["الكوفي"]).collect()
    assert {(r["g"], r["name"]) for r in got} == want and len(got) == len(want)


def test_best_path_is_brute_force(spark):
    """The chosen candidates against all paths of short chains, with gaps, ties and positions of one candidate."""
    import itertools
    import random

    rng = random.Random(4)
    candidates = [(c, 0, pos, e, rng.choice([0.4, 0.5, 0.9])) for c in range(40) for pos in range(rng.randint(1, 5)) if rng.random() < 0.9 for e in rng.sample(range(1, 9), rng.randint(1, 4))]
    edges = {(rng.randint(1, 8), rng.randint(1, 8)) for _ in range(16)}
    hints = {(rng.randint(1, 8), rng.randint(1, 8)) for _ in range(6)}  # entity, student
    years = {e: rng.choice([100, 150, 200, 300, None]) for e in range(1, 9)}

    def weight(s, e):
        near = years[s] is not None and years[e] is not None and abs(years[s] - years[e]) <= 80
        return 2 * ((s, e) in edges) + 4 * ((e, s) in hints) + near

    want = {}
    for c in range(40):
        places = sorted({r[2] for r in candidates if r[0] == c})
        options = [[(r[3], round(r[4] * 10**6)) for r in candidates if r[0] == c and r[2] == p] for p in places]
        best = None
        for way in itertools.product(*options):
            links = [weight(a[0], b[0]) if q == p + 1 else 0 for a, b, p, q in zip(way, way[1:], places, places[1:], strict=False)]
            key = (-sum(links), -sum(x[1] for x in way), [x[0] for x in way])
            if best is None or key < best[0]:
                best = (key, links)
        if best:
            for i, p in enumerate(places):
                want[c, p] = (best[0][2][i], sum(best[1][max(i - 1, 0) : i + 1]))
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    got = C.disambiguate(frame(candidates, "chain_id long, branch_no int, pos long, entity_id long, score double"), frame(edges, "student_id long, teacher_id long"), frame(years.items(), "entity_id long, year int"), frame(hints, "entity_id long, student_id long"))
    assert {(r["chain_id"], r["pos"]): (r["entity_id"], r["support"]) for r in got.collect()} == want


def test_only_like_names_of_a_level_are_folded(spark):
    """Of a level of many names those that may be like another one are rows of their own, the others one count; repeated names count once."""
    names = [f"w{i} v{i}" for i in range(200)] + ["w7 v7 u", "w9 v9 u", "w9 v9 u", "w3 v3"]
    chains = spark.createDataFrame([(1, 5, i, [n]) for i, n in enumerate(names)] + [(2, 5, 900, ["w7 v7"])], "passage_id long, score long, chain_id long, names array<string>")
    got = {r["passage_id"]: r for r in C.level_counts(chains).collect()}
    assert got[1]["n"] == 200 and got[1]["samples"] == [f"w{i} v{i}" for i in range(5)] and got[2]["n"] == 1 and got[2]["samples"] == ["w7 v7"]
    assert {r["passage_id"]: r["n"] for r in C.level_counts(chains, samples=0).collect()} == {1: 200, 2: 1}
    rows = chains.select("passage_id", F.explode("names").alias("name"), F.struct("score", "chain_id").alias("o"))
    kept = C._meeting(rows, ["passage_id"], "name", [], [], 0).collect()
    assert sorted(r["m"]["name"] for r in kept if r["meets"]) == ["w7 v7", "w7 v7 u", "w9 v9", "w9 v9 u"]
    assert sorted((r["passage_id"], r["n"]) for r in kept if not r["meets"]) == [(1, 198), (2, 1)]
