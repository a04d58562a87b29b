import json
import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainproof.functions import nfc, similarity
from chainproof.functions.text import words
from chainproof.operators import evidence as E
from chainproof.operators import matching as M
from chainproof.operators import parse as P
from chainproof.operators import passages as A
from chainproof.plans import chain_queries as CQ
from chainproof.sources import io as IO
from chainproof.streaming import state as ST


def grams(text):
    return {f"  {w} "[i : i + 3] for w in text.split() for i in range(len(w) + 1)}


def test_similarity_join_is_brute_force(spark):
    names = ["red ring brand", "red rng brand", "blue bolt", "blue bolt small", "bolt", "zz", "ring red brand", "red ring brand"]
    left = spark.createDataFrame(list(enumerate(names)), "mention_id long, name string")
    for tau in (0.3, 0.5, 0.85):
        got = {(r["left_name"], r["right_name"]) for r in M.similar_names(left, left, tau, least=1).collect()}
        want = {(a, b) for a in names for b in names if 1000 * len(grams(a) & grams(b)) >= round(1000 * tau) * len(grams(a) | grams(b))}
        assert got == want


def test_passages_against_the_expression(spark):
    passages = spark.createDataFrame([(1, "the red ring of brand"), (2, "blue bolt small"), (3, "x")], "passage_id long, text string")
    corpus = spark.createDataFrame([(1, "a the red rng of brand here"), (2, "nothing"), (3, "bolt small blue and the red"), (4, None), (5, "")], "text_id long, text string")
    got = {(r["passage_id"], r["text_id"]): round(r["score"], 9) for r in A.passage_match_topk(passages, corpus, 0.2).collect()}
    both = passages.where("length(text) >= 6").select("passage_id", F.col("text").alias("q")).crossJoin(corpus.where("text is not null"))
    score = similarity.word_similarity(similarity.trigrams(F.col("q")), F.size(words(F.col("q"))), words(F.col("text")))
    want = {(r[0], r[1]): round(r[2], 9) for r in both.select("passage_id", "text_id", score).collect() if r[2] >= 0.2}
    assert got == want


def test_quota(spark):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    events = spark.createDataFrame([(i, 1, at(i)) for i in range(21)] + [(50, 2, at(0)), (51, 1, at(601))], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r["id"]: r["allowed"] for r in ST.sliding_quota(events).collect()}
    assert [i for i, ok in got.items() if not ok] == [20] and got[51] and got[50]


def test_stream_quota_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 2, f"2024-01-01 00:00:{i:02d}") for i in range(12)], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ST.stream_quota(stream, 3, 600).writeStream.format("memory").queryName("quota").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    got = {(r["id"], r["allowed"]) for r in spark.sql("select * from quota").collect()}
    assert got == {(r["id"], r["allowed"]) for r in ST.sliding_quota(events, 3, 600).collect()}


def test_stream_quota_in_order_over_batches(spark, tmp_path):
    """Hits that come in any order are decided as on a table once the watermark has passed them, and idle keys are forgotten."""
    import random

    rng = random.Random(9)
    hits = [(i, i % 3, i * 7 % 120) for i in range(90)] + [(100 + i, 9, 5 * i) for i in range(10)]
    rng.shuffle(hits)
    parts = [hits[:40], hits[40:75], hits[75:], [(900, 77, 4000)], [(901, 77, 8000)], [(902, 77, 9000)]]
    frame = lambda rows: spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"))
    for i, part in enumerate(parts):
        frame(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(frame(hits[:1]).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
        out = ST.stream_quota(stream, 4, 60, delay="10 minutes").writeStream.format("memory").queryName("ordered").outputMode("append")
        q = out.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        kept = [x["numRowsTotal"] for p in q.recentProgress for x in p["stateOperators"]]
        q.stop()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    got = {(r["key"], r["id"], r["allowed"]) for r in spark.sql("select * from ordered").collect()}
    want = {(r["key"], r["id"], r["allowed"]) for r in ST.sliding_quota(frame(hits + parts[3]), 4, 60).collect()}
    assert {r for r in got if r[0] != 77} == {r for r in want if r[0] != 77} and len({r for r in want if not r[2]}) > 10
    assert max(kept) >= 4 and kept[-1] == 1  # only the last key is left


def test_corpus_tree(spark, tmp_path):
    (tmp_path / "b1").mkdir()
    (tmp_path / "books.json").write_text(json.dumps({"sunni": {"the_9_books": [{"id": "b1", "name_ar": "ا", "name_en": "A"}, {"id": "b2", "name_ar": "ب", "name_en": "B"}], "forties": [], "other_books": []}}))
    (tmp_path / "b1/index.json").write_text(json.dumps([{"file": "c1.json", "name_ar": "x"}, {"file": "c2.json", "name_ar": "y"}]))
    for c in ("c1", "c2"):
        (tmp_path / f"b1/{c}.json").write_text(json.dumps([{"id": 1, "idInBook": 7, "arabic": c, "english": {"narrator": "n", "text": "t"}, "grade": None}]))
    rows = IO.read_corpus(spark, str(tmp_path)).orderBy("chapter_no").collect()
    assert [(r["book_id"], r["chapter_no"], r["arabic"], r["number"]) for r in rows] == [("b1", 1, "c1", 7), ("b1", 2, "c2", 7)]


def test_profiles_overlay_and_jsonl(spark, tmp_path):
    profile = {"id": 320, "full_name": "x", "death": "-", "namings": ["a", "b"], "classical_sources": {"m": {"entry_id": 1, "grade_en": "weak", "grade_ar": "ض"}}, "teachers": [2], "students": [3]}
    (tmp_path / "s.json").write_text(json.dumps({"320": profile}))
    parts = IO.explode_profile(IO.read_profiles(spark, str(tmp_path / "s.json")))
    assert {k: v.count() for k, v in parts.items()} == {"narrator": 1, "name_variant": 2, "source_grade": 1, "transmission": 2}
    assert parts["narrator"].first()["death"] == "-"
    (tmp_path / "o.csv").write_text('name,death\nأحمد,100\nاحمد,200\nعلي,-\n"a ""b""",7\n')
    got = IO.read_csv_overlay(spark, str(tmp_path / "o.csv"), "name string, death string", "name", "death")
    assert {r["death"] for r in got.collect()} == {"100", "7"}
    IO.write_jsonl(got, str(tmp_path / "j"))
    assert IO.read_jsonl(spark, str(tmp_path / "j"), "name string").count() == 2
    IO.replace_slice(str(tmp_path / "p"), spark.createDataFrame([("a", 1), ("b", 1)], "k string, v long"), ["k"])
    IO.replace_slice(str(tmp_path / "p"), spark.createDataFrame([("b", 2)], "k string, v long"), ["k"])
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("a", 1), ("b", 2)}


def test_chain_and_branches(spark):
    texts = spark.createDataFrame([(1, "حدثنا أحمد، حدثنا علي بن زيد، عن أبيه، عن أنس: قال كذا")], "chain_id long, text string")
    pos, payload = P.segment_chain(texts)
    names = [(r["name"], r["formula"]) for r in P.resolve_relatives(pos).orderBy("pos").collect()]
    assert names == [("أحمد", "haddathana"), ("علي بن زيد", "an"), ("زيد", "an"), ("أنس", None)]
    assert payload.first()["payload"] == "قال كذا"
    two = spark.createDataFrame([(1, "حدثنا أحمد عن حماد عن هشام وعن ثابت"), (2, None), (3, "")], "chain_id long, text string")
    got = defaultdict(list)
    for r in P.split_branches(two).orderBy("branch_no").collect():
        got[r["chain_id"]].append(r["text"])
    assert got[1] == ["حدثنا أحمد عن حماد عن هشام", "حدثنا أحمد عن ثابت"]


def test_branches_of_worked_examples(spark):
    """A lone mark, a fork from a pivot, teachers of their own, joint speech, relatives, and texts without any of these."""
    want = {
        "حدثنا أبو بكر، حدثنا إسماعيل، ح قال وحدثني زهير، حدثنا إسماعيل بن إبراهيم، عن يونس، عن حميد": [["أبو بكر", "إسماعيل", "يونس", "حميد"], ["زهير", "إسماعيل بن إبراهيم", "يونس", "حميد"]],
        "حدثنا أبو بكر بن أبي شيبة وعمرو الناقد كلاهما عن الأسود بن عامر، حدثنا أسود، حدثنا حماد بن سلمة، عن هشام بن عروة، عن أبيه، عن عائشة، وعن ثابت، عن أنس، أن النبي ﷺ قال: كذا": [["أبو بكر بن أبي شيبة", "الأسود بن عامر", "حماد بن سلمة", "هشام بن عروة", "عروة", "عائشة"], ["أبو بكر بن أبي شيبة", "الأسود بن عامر", "حماد بن سلمة", "ثابت", "أنس"]],
        "حدثنا علي عن سفيان وحدثنا عمر عن هشام": [["علي", "سفيان"], ["عمر", "هشام"]],
        "أخبرنا علي عن سفيان، قال: وأخبرنا عمر": [["علي", "سفيان"], ["عمر"]],
        "حدثنا علي عن سفيان وأخبرنا عمر عن سفيان عن نافع": [["علي", "سفيان", "نافع"], ["عمر", "سفيان", "نافع"]],
        "حدثنا أحمد ح وحدثنا زهير ح وحدثنا قتيبة عن مالك عن نافع": [["أحمد", "مالك", "نافع"], ["زهير", "مالك", "نافع"], ["قتيبة", "مالك", "نافع"]],
        "حدثنا ابن علية حدثنا ابن نمير ح وحدثني زهير حدثنا شعبة عن قتادة": [["ابن علية", "ابن نمير", "قتادة"], ["زهير", "شعبة", "قتادة"]],
        "حدثني أبو الطاهر، وهارون بن سعيد الأيلي، قالا أخبرنا ابن وهب، عن يونس: متن": [["أبو الطاهر", "ابن وهب", "يونس"]],
        "حدثنا وكيع وابن نمير وأبو معاوية قالوا حدثنا الأعمش": [["وكيع", "الأعمش"]],
        "حدثنا أبو وائل وعمر قالا حدثنا الأعمش عن أمه عن عمه": [["أبو وائل", "الأعمش", "أمه", "عمه"]],
        "عن عمر بن إسحاق بن يسار عن جده وعن أنس": [["عمر بن إسحاق بن يسار", "يسار"], ["عمر بن إسحاق بن يسار", "أنس"]],
        "حدثنا علي بن محمد عن محمد عن إسحاق عن أبيه": [["علي بن محمد", "محمد", "إسحاق", "أبيه"]],
        "لا شيء": [], "": [], None: [],
    }
    texts = spark.createDataFrame(list(enumerate(want)), "chain_id long, text string")
    branches = P.split_branches(texts)
    positions, payload = P.segment_chain(branches)
    got = defaultdict(lambda: defaultdict(list))
    for r in positions.orderBy("chain_id", "branch_no", "pos").collect():
        got[r["chain_id"]][r["branch_no"]].append(r["name"])
    for i, (text, names) in enumerate(want.items()):
        assert list(got[i].values()) == names, text
        assert all(len(b) == len(set(b)) for b in names)
    said = {(r["chain_id"], r["branch_no"]): r["payload"] for r in payload.collect()}
    assert said[1, 0] == said[1, 1] == "أن النبي ﷺ قال كذا" and said[7, 0] == "متن" and said[12, 0] == "لا شيء"


def test_scans_over_books_of_many_blocks(spark):
    """Entries that reach over blocks of pages, in blocks of any size, against one pass over each book."""
    import random

    rng = random.Random(11)
    kinds = ["7 - زيد", "قال كذا وكذا", "حدثنا فلان", "( ٣ ) حاشية", "كلام آخر", "نص طويل هنا"]
    rows = [(b, p, i, rng.choice(kinds[1:] if rng.random() < 0.9 else kinds[:1])) for b in (1, 2, None) for p in range(60) for i in range(rng.randint(0, 3))]
    paras = spark.createDataFrame(rows, "book_id long, page_id long, para_no int, text string")
    header = r"^([0-9]+)\s*-\s*(.+)$"
    carried, sections = set(), set()
    for b in (1, 2, None):
        start, n, closed, parts = None, 0, True, []
        for _, p, i, text in sorted((r for r in rows if r[0] == b), key=lambda r: r[1:3]):
            opens = text == kinds[0]
            if opens and i == 0:
                start = p
            elif start is not None and not (opens and i == 0):
                carried.add((b, p, i, start))
            if opens:
                sections.add((b, n, " ".join(parts)))
                n, closed, parts = n + 1, False, []
            else:
                closed = closed or text in kinds[2:4]
                parts += [] if closed else [text]
        sections.add((b, n, " ".join(parts)))
    sections = {s for s in sections if len(s[2]) >= 4 and s[1] > 0}
    for pages in (1, 7, 256):
        got = P.carry_header(paras, header, pages=pages).collect()
        assert {(r["book_id"], r["page_id"], r["para_no"], r["entry_start"]) for r in got} == carried and len(got) == len(carried)
        assert {(r["book_id"], r["entry_no"], r["text"]) for r in P.entry_sections(paras, header, pages=pages).collect()} == sections


def test_attributed_verdicts(spark):
    paras = spark.createDataFrame([(1, 0, "• قال البرقاني: قال الدارقطني: ثقة (١٢). وقال الدارقطني: ضعيف."), (2, 0, "لا شيء")], "page long, para_no int, text string")
    rows = P.extract_attributed(paras).orderBy("verdict_no").collect()
    assert [(r["verdict"], r["page_ref"], r["relayed_via"]) for r in rows] == [("ثقة", "12", "البرقاني"), ("ضعيف", None, None)]


def test_plans_stay_on_the_jvm(spark):
    from chainproof.plans import QUERIES

    for name in ("cl18_audit", "jn01_match_topk", "ag06_cl09_bottleneck"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan


def test_nearest_is_brute_force(spark):
    """The best entities of each distinct name, where entities have several names, names several entities, and scores and prominence tie."""
    names = ["red ring brand", "red rng brand", "blue bolt", "blue bolt small", "bolt", "ring red brand", "blue bolts"]
    variants = [(e, names[(e * i + i) % len(names)]) for e in range(40) for i in range(1, 4)]
    prominence = [(e, e % 3) for e in range(0, 40, 2)]
    mentions = spark.createDataFrame(list(enumerate(names * 3)), "mention_id long, name string")
    right = spark.createDataFrame(variants, "entity_id long, variant string")
    weights = spark.createDataFrame(prominence, "entity_id long, prominence long")
    for k, tau in ((1, 0.3), (4, 0.3), (12, 0.5)):
        best = {}
        for a in names:
            for e, b in variants:
                common, either = len(grams(a) & grams(b)), len(grams(a) | grams(b))
                if 1000 * common >= round(1000 * tau) * either:
                    best[a, e] = max(best.get((a, e), 0), common / either)
        want = set()
        for i, a in enumerate(names * 3):
            rank = sorted((-s, -dict(prominence).get(e, 0), e) for (n, e), s in best.items() if n == a)[:k]
            want |= {(i, e, -p, r + 1) for r, (_, p, e) in enumerate(rank)}
        assert {(r["mention_id"], r["entity_id"], r["prominence"], r["rank"]) for r in M.match_topk(mentions, right, weights, k, tau).collect()} == want
        near = M.nearest(mentions, right, tau, k, weights, entity="entity_id", variant="variant")
        assert near.count() <= k * len(names)  # a row for no mention


def test_usage_time_is_spelt_as_in_sql(spark, tmp_path):
    """A time whose microseconds end with zeros."""
    import duckdb
    from chainproof.plans import QUERIES, SQL

    for end in ("120000", "000000", "123456", "500000"):
        folder = tmp_path / end
        folder.mkdir()
        duckdb.sql(f"copy (select i as event_id, timestamp '2024-01-01 10:20:00.{end}' as ts from range(5000) r(i)) to '{folder}/events.parquet' (format parquet)")
        own = duckdb.connect()
        own.sql(f"create view events as select * from '{folder}/events.parquet'")
        assert [tuple(r) for r in QUERIES["st04_monthly_usage"](spark, str(folder)).collect()] == own.sql(SQL["st04_monthly_usage"]).fetchall()


def test_equal_pairs_of_names_are_compared_once(spark, tmp_path):
    """Repeated names: as in SQL, and one comparison for each different pair."""
    import glob

    import duckdb
    from chainproof.plans import QUERIES, SQL
    from chainproof.sources.work import work_dir

    duckdb.sql(f"copy (select i as p_partkey, case i % 2 when 0 then 'red ring' else 'blue bolt' end as p_name, 'Brand#1' as p_brand, 'LARGE' as p_type from range(40) r(i)) to '{tmp_path}/part.parquet' (format parquet)")
    own = duckdb.connect()
    own.sql(f"create view part as select * from '{tmp_path}/part.parquet'")
    assert sorted(tuple(r) for r in QUERIES["sc21_word_similarity"](spark, str(tmp_path)).collect()) == sorted(own.sql(SQL["sc21_word_similarity"]).fetchall())
    compared = glob.glob(work_dir(spark).removeprefix("file://") + "/chainproof/*/compared")
    assert [spark.read.parquet(p).count() for p in compared] == [2]


def test_texts_are_cut_once(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.createDataFrame([(1, "حدثنا زيد، عن عمرو، عن بكر: متن")], "chain_id long, text string").write.parquet(path)
    positions, payloads = P.segment_chain(spark.read.parquet(path))
    plan = positions._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # else a text would be cut again for each of its names
    assert [tuple(r) for r in positions.orderBy("pos").collect()] == [(1, 0, 0, "زيد", "an"), (1, 0, 1, "عمرو", "an"), (1, 0, 2, "بكر", None)]
    assert payloads.first()["payload"] == "متن"


def test_safe_characters_are_composed():
    points = [c for c in range(0x10000) if re.match(f"[{nfc.SAFE}]", chr(c))]
    assert len(points) > 1000 and not [c for c in points if unicodedata.combining(chr(c)) or unicodedata.normalize("NFC", chr(c)) != chr(c) or re.match(f"[{nfc.rough()}]", chr(c))]


def test_only_passages_that_a_text_has_enough_of_are_held_against_it():
    def occurrences(text):
        index = sorted((g, i) for i, w in enumerate(text.split()) for g in set(A._grams(w)))
        before = [b[1] if a == b[0] else -1 for (a, _), b in zip(index, [(None, -1), *index], strict=False)]
        return len(text.split()), np.array([g for g, _ in index], np.int64), np.array([i for _, i in index], np.int32), np.array(before, np.int32)

    texts = ["red green blue", "green grey", "one two three four five", "blue"]
    passages = A._Passages([(i, sorted({g for w in t.split() for g in A._grams(w)}), len(t.split())) for i, t in enumerate(texts)], 450, 10)
    held = lambda text: passages._possible(np.unique(np.flatnonzero(np.isin(passages.grams, occurrences(text)[1])))).tolist()
    assert [held(t) for t in ("green blue", "one two three", "nothing like", "")] == [[0, 1, 3], [2], [], []]
    for text in ("a green and blue sea", "red red red green blue red", "one three two", "nothing like", "x"):
        words, found = text.split(), {}
        for i, t in enumerate(texts):
            n = len(t.split())
            most = max(len(grams(t) & grams(" ".join(words[j : j + n]))) for j in range(max(len(words) - n + 1, 1)))
            if most >= -(-len(grams(t)) * 450 // 1000):
                found[i] = most
        assert dict(zip(*[x.tolist() for x in passages.best(*occurrences(text))], strict=True)) == found


def test_files_of_a_stream_grow_in_number(spark, tmp_path):
    docs = spark.range(10_000, numPartitions=9)
    each = CQ.stream_files(docs, str(tmp_path / "stream"))
    assert (each, len(list((tmp_path / "stream").glob("part-*")))) == (3, 9)  # before: three files, whatever the size
    assert spark.read.parquet(str(tmp_path / "stream")).count() == 10_000


def test_a_share_of_the_texts_bounds_the_others_only(spark, monkeypatch):
    monkeypatch.setattr(A, "FIRST", 8)
    monkeypatch.setattr(A, "SHARE", 2)
    texts = [f"red green {'blue ' * (i % 4)}w{i % 7} grey sea{i % 5}" for i in range(60)] + ["", None]
    corpus = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    passages = spark.createDataFrame([(1, "green blue sea3"), (2, "grey w5 red"), (3, "nothing like it")], "passage_id long, text string")
    index = A.text_index(corpus)
    assert index.columns == ["tid", "t"]  # before: three arrays of every occurrence of a trigram, 16 times the text
    expected = set()
    for pid, q in passages.collect():
        best, n = [], len(q.split())
        for i, t in enumerate(texts):
            w = (t or "").split()
            most = max(len(grams(q) & grams(" ".join(w[j : j + n]))) for j in range(max(len(w) - n + 1, 1)))
            if most * 1000 >= len(grams(q)) * 450:
                best.append((-most / len(grams(q)), i))
        expected |= {(pid, i, -s, r + 1) for r, (s, i) in enumerate(sorted(best)[:10])}
    assert {tuple(r) for r in A.search_index(passages, index).collect()} == expected


def test_windows_are_counted_in_parts(monkeypatch):
    texts = ["red green blue", "green grey", "one two three four five"]
    rows = [(i, sorted({g for w in t.split() for g in A._grams(w)}), len(t.split())) for i, t in enumerate(texts)]
    words = ("red green blue one two three four " * 9).split()
    whole = A._Passages(rows, 450, 10)
    expected = [x.tolist() for x in whole.windows(len(words), *A._Words(whole.grams).occurrences(words))]
    monkeypatch.setattr(A, "CELLS", 70)
    parts = A._Passages(rows, 450, 10)
    assert [x.tolist() for x in parts.windows(len(words), *A._Words(parts.grams).occurrences(words))] == expected != [[], []]


def test_names_of_all_shapes_are_found_in_one_reading(spark):
    names = ["abcdef", "zwölfte", "a bcdefg", "ab cd e", "abc defghijk lm", "abc defghijk lmn", "f ghi", "abcdefg h", "x" * 20 + " yy " + "z" * 90, "x" * 20 + " yy " + "z" * 91, "😀 smile 😀", "q" * 70, "q" * 71]
    texts = ["xabc defghijk lmnop", "abcdefg ab cd ez", "the " + "x" * 21 + " yy " + "z" * 90, "zzzwölftens a bcdefgh", "ab cd", "", "o😀 smile 😀o", "q" * 70, "f ghi abcdef"]
    n = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, nid long")
    t = spark.createDataFrame([(i, f"b{i % 2}", x) for i, x in enumerate(texts)], "id long, book string, t string")
    found = E._mentioned(t, n)
    assert sorted(tuple(r) for r in found.collect()) == sorted((i, f"b{i % 2}", j) for i, x in enumerate(texts) for j, y in enumerate(names) if y in x)
    few = spark.createDataFrame([("nothing", 0)], "name string, nid long")
    assert E._mentioned(t, few).count() == E._mentioned(t, n.limit(0)).count() == 0
    # before: an automaton of 200,000 names at the most, and the texts were read again for each further one
    assert E._anchor(*E._shape(names[4])) == E._anchor(*E._shape(names[8])) and len({E._anchor(*E._shape(x)) for x in names}) <= 6


def test_names_of_one_file_are_made_by_many_tasks(spark):
    one = spark.range(100).selectExpr("id as entity_id", "concat('name ', id % 7) as name").coalesce(1)
    assert M._dealt(one, "entity_id").rdd.getNumPartitions() == 4  # before: the one task that reads the file made all distinct names
    facts = spark.createDataFrame([("red ring", "blue bolt", "")] * 3 + [("red ring", None, "")], "subject string, other string, phrase string")
    registry = spark.createDataFrame([(1, "red ring"), (2, "blue bolt"), (3, None)], "entity_id long, variant string")
    assert [tuple(r) for r in M.resolve_pairs(facts, registry).collect()] == [(1, 2, "")]


def test_many_passages_are_found_by_keys(monkeypatch):
    """Passages of whose trigrams a text has enough, by threes of trigrams of a group: as by counting all, without a look at the posting lists."""
    rng = random.Random(3)
    monkeypatch.setattr(A, "KEYED", 20)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    common = [word("abcdefg", rng.randint(3, 8)) for _ in range(300)]
    rare = [f"{word('0123456789abcdef', 32)} {word('0123456789abcdef', 32)}" for _ in range(300)]
    passages = rare + [" ".join(rng.choice(common) for _ in range(rng.randint(1, 14))) for _ in range(200)]
    texts = [f"{rng.choice(passages)[rng.randint(0, 20) :]} x {word('abcdef', 20)}" for _ in range(100)] + [" ".join(rng.choice(common) for _ in range(rng.randint(0, 40))) for _ in range(50)]
    rows = [(i, sorted({g for w in t.split() for g in A._grams(w)}), len(t.split())) for i, t in enumerate(passages)]
    held = {tuple(t.split()): [i for i, g, _ in rows if len(set(g) & {x for w in t.split() for x in A._grams(w)}) >= -(-len(g) * 450 // 1000)] for t in texts}
    whole = A._Passages(rows, 450, 10)
    assert whole.quick.keyed[:300].all()
    for key in (1e-9, 8, 10**6):  # by keys alone, by what is cheaper, by posting lists alone
        monkeypatch.setattr(A, "KEY", key)
        found = whole.possible([x for x, _ in A._Words(whole.grams).all_occurrences([t.split() for t in texts])])
        assert [x.tolist() for x in found] == [held[tuple(t.split())] for t in texts]
    monkeypatch.setattr(A, "KEY", 1e-9)
    only = A._Passages(rows[:300], 450, 10)
    counted = only._counted
    monkeypatch.setattr(only, "_counted", lambda *x: counted(*x) if x[-1] else pytest.fail("posting lists of passages with keys"))
    for i in range(100):
        words = f"some of {rare[i]}".split()
        assert only.windows(len(words), *A._Words(only.grams).occurrences(words))[0].tolist() == [i]


def test_shapes_of_names_of_three_words_are_not_all_tried(spark, monkeypatch):
    """Their second words are told by the blanks of a text: however many shapes names have, few stretches of a text are looked at, and none is missed."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 20])))
    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(60)]
    names = {t[i : i + rng.randint(3, 60)] for t in texts for i in rng.sample(range(len(t) + 1), min(8, len(t)))} | {f"{word()} {word()} {word()}" for _ in range(200)}
    names = sorted(x for x in names if x)
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("book", F.lit("b"))
    got = E._mentioned(frame, spark.createDataFrame(list(enumerate(names)), "nid long, name string")).collect()
    assert sorted((r["id"], r["nid"]) for r in got) == sorted((i, j) for i, t in enumerate(texts) for j, n in enumerate(names) if n in t)

    looked, hashes = [], E._Spelling.hashes
    monkeypatch.setattr(E._Spelling, "hashes", lambda self, b, e: looked.append(len(b)) or hashes(self, b, e))
    sides = [(a, c) for a in range(1, 17) for c in range(1, 17)]
    bits = [np.zeros(8192, np.uint8) for _ in range(3)]
    long = " ".join("abcdefghijklmnop" for _ in range(500))
    for i, (b, e) in enumerate([(15, 35), (0, 50), (0, 34)]):  # as if one name were known: a letter around the second word, all, and what is before the third
        h = hashes(E._Spelling(long), np.array([b]), np.array([e]))
        for k in range(E.TIMES):
            at = int(E._place(h, k)[0] & np.uint64(8 * 8192 - 1))
            bits[i][at >> 3] |= 1 << (at & 7)
    found = E._stretches(long, tuple(bits), *E._sought([], sides))
    assert found == {long[:50]} and sum(looked) <= 500 * (1 + 16 + 17)  # 256 shapes for each second word's length else
