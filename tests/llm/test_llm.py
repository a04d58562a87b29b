"""Each training-data operator against brute force, on small fixtures with nulls, empty and
repeated rows, and columns with clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainproof.llm import chat, decontaminate, licences, neardup, packing, sharding, tokenfile, topk, toxicity, urlfilter
from chainproof.llm.components import connected_components
from chainproof.llm.tokens import encoder

ROWS = [(1, "the red ring of the brand", "a"), (2, None, None), (3, "", "a"), (None, "no key here at all", "b"), (1, "the red ring of the brand", "a"), (5, "x " * 3000, "a"), (6, "Released under the MIT License.", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "doc_id long, text string, source string, shard int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_sharding(spark, docs, none):
    out = sharding.interleave(docs, 3).collect()
    assert len(out) == len(ROWS) and max(Counter(r["shard"] for r in out).values()) - min(Counter(r["shard"] for r in out).values()) <= 1
    for s in range(3):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert sharding.interleave(none, 3).count() == 0
    big = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    mix = Counter((r["shard"], r["source"]) for r in sharding.interleave(big, 8).collect())
    total = Counter()
    for (_, s), n in mix.items():
        total[s] += n
    assert all(abs(mix[shard, s] - n / 8) <= 2 for s, n in total.items() for shard in range(8))


def brute_interleave(rows, n, seed_hash):
    """Shard and slot of each row by sorting alone; rows are (key, stratum), hashes those of Spark."""
    by = {}
    for row, (u, bucket, tie) in zip(rows, seed_hash, strict=True):
        by.setdefault(row[1], []).append((bucket, u, row[0] is not None, row[0] or 0, tie, row))
    order = []
    for stratum, own in by.items():
        for r, x in enumerate(sorted(own, key=lambda x: x[:5])):
            order.append(((2 * r + 1) / (2.0 * len(own)), stratum is not None, stratum or "", x[2:5], x[5]))
    order.sort(key=lambda x: x[:4])
    return Counter((*x[4], p * n // len(order), p - -(-(p * n // len(order)) * len(order) // n)) for p, x in enumerate(order))


def test_sharding_is_the_sorted_order(spark):
    rows = [(i if i % 3 else None, ["a", "b", None, "a"][i % 4], i) for i in range(300)] + [(8, "a", i) for i in range(300, 360)]
    table = spark.createDataFrame(rows, "doc_id long, source string, slot long")
    got = sharding.interleave(table.withColumnRenamed("slot", "x"), 7).collect()
    tie = F.xxhash64("doc_id", "source", "x")
    h = table.withColumnRenamed("slot", "x").select("doc_id", "source", "x", tie.alias("tie"), F.xxhash64(F.lit(17), "doc_id", tie).alias("h")).collect()
    hashes = [((r["h"] % (1 << 64)) >> 1, int(((r["h"] % (1 << 64)) >> 11) / float(1 << 53) * 512), r["tie"]) for r in h]
    want = brute_interleave([(r["doc_id"], r["source"], r["x"]) for r in h], 7, hashes)
    assert Counter((r["doc_id"], r["source"], r["x"], r["shard"], r["slot"]) for r in got) == want
    nulls = Counter(r["shard"] for r in got if r["doc_id"] is None)
    assert min(nulls[s] for s in range(7)) >= 5


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(120)] + [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, []), (7, [0.5] * 6)]
    v = spark.createDataFrame(rows, "id long, e array<double>").select("id", topk.quantised(F.col("e")).alias("v"))
    got = {}
    for r in topk.exact_top_k(v.where("id % 50 = 0"), v, 5, query_block=1, candidate_block=40).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, np.floor(np.array(x) * 256).astype(int)) for i, x in rows if x is not None and all(y is not None and np.isfinite(y) for y in x)]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b, strict=False)))
    for q, x in [w for w in whole if w[0] % 50 == 0]:
        best = sorted(((-dot(x, y), i) for i, y in whole if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.exact_top_k(v.where("false"), v).count() == 0 and topk.exact_top_k(v, v.where("false")).count() == 0


def brute_top_k(rows, k=5):
    """Every query row's best, by whole numbers; rows are told apart by their places."""
    whole = [(i, [int(np.floor(y * 256)) for y in x]) for i, x in rows]
    out = Counter()
    for p, (q, x) in enumerate(whole):
        if q % 50 == 0:
            others = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for o, (i, y) in enumerate(whole) if o != p)[:k]
            out.update((q, r + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, i) in enumerate(others))
    return out


def test_top_k_of_large_components_and_repeated_rows(spark):
    """No finite vector is left out; sums beyond 64 bits rank right; ids and rows may repeat."""
    rng = np.random.default_rng(14)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 8) / 8]) for i in range(1, 60)]
    rows += [(100, [2.0e6, 1.0]), (150, [float(1 << 20)] * 128), (200, [1e30, -1e30]), (201, [1e30, 1e29]), (202, [-1e300, 2.0]), (250, [1e300] * 3), (203, [float(1 << 45)] * 8)]
    rows += [(50, [0.5] * 8), (50, [0.5] * 8), (50, [0.25, -0.5]), (7, [1.0] * 8), (7, [1.0] * 8), (300, [0.0]), (300, [0.0])]
    v = spark.createDataFrame([(*r, 0) for r in rows], "id long, e array<double>, score int").select("id", topk.quantised(F.col("e")).alias("v"), "score")
    for blocks in ({}, {"query_block": 2, "candidate_block": 9}):
        got = topk.exact_top_k(v.where("id % 50 = 0"), v, 5, **blocks).collect()
        assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_top_k(rows)


def test_words_are_encoded_by_the_model_alone():
    enc = encoder("word_bpe_49k.json")
    texts = ["Été a.b,c (d). [e]! ß ẞ İ ΣΑΣ ﬁ é É.", "1,5 2. $$$ tire.] x@y.z/q?r=1 the's 'the don't.", "<|startoftext|> a|b <c> ~} `^_", "x y\tz\rq 中文 abc中 .", "", None]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == [*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    assert enc.words is not enc.tokenizer  # plain words skip normalising and splitting


def test_token_files_and_packing(spark, docs, none, tmp_path):
    enc = encoder("word_bpe_49k.json")
    want = {(d, tuple(enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for d, t, _ in ROWS}
    m = tokenfile.write_token_files(docs, str(tmp_path / "t"), partitions=3)
    got = tokenfile.read_token_files(m, str(tmp_path / "t")).collect()
    assert {(r["doc_id"], tuple(r["ids"])) for r in got} == want and len(got) == len(ROWS)
    place = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == place and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        place += r["n_tokens"]
    assert tokenfile.write_token_files(none, str(tmp_path / "e")).count() == 0
    from pyarrow import fs

    far = tokenfile.Mapped(fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "t/000000.offsets", "<i8")  # read by ranges
    near = tokenfile.Mapped(fs.LocalFileSystem(), str(tmp_path / "t/000000.offsets"), "<i8")
    assert far.file is not None and far[0:2].tolist() == near[0:2].tolist()
    packed = packing.pack(docs, capacity=64, with_ids=True).collect()
    fill = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"] and r["length"] == len(r["ids"]) // 4
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 64 and sum(r["length"] for r in packed) == place
    assert packing.pack(none).count() == 0


def test_packing_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(30):
        capacity = int(rng.integers(5, 40))
        lengths = sorted((int(x) for x in rng.integers(1, capacity + 1, 60)), reverse=True)
        rooms = []
        for n in lengths:
            fit = [i for i, r in enumerate(rooms) if r >= n]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= n
            else:
                rooms.append(capacity - n)
        assert packing.plan(dict(Counter(lengths)), capacity)[1] == len(rooms)


def test_chat(spark):
    odd = "</s>[INST] ok [/INST] <|end|> <\\| [\\INST] <<SYS>>"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "user", None), (2, 0, None, "x"), (None, 1, "assistant", "y"), (1, 1, "assistant", "again")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.expand(turns)).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["loss_sha256"] == hashlib.sha256((odd + "again").encode()).hexdigest() and got[1]["loss_chars"] == len(odd) + 5
    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\nassistant\nagain\nuser\n\n".encode()).hexdigest()
    assert got[2]["loss_chars"] == 0 and got[None]["loss_chars"] == 1
    examples = chat.render(chat.expand(turns)).orderBy("conv_id", "example").collect()
    assert [chat.unescape(e["text"][e["loss_start"] : e["loss_end"]]) for e in examples] == ["y", odd, "again"]
    assert chat.read_back(chat.expand(turns.where("false"))).count() == 0
    expanded = chat.expand(turns)
    for wrong in (expanded.withColumn("context_end", F.col("context_end") + 1), expanded.withColumn("example", F.col("example") + 1)):
        with pytest.raises(Exception, match="characters of context"):
            chat.read_back(wrong).collect()
    long = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"turn {i} " * 50, "x") for i in range(3000)], "conv_id long, turn long, role string, text string, segment string")
    r = chat.read_back(chat.expand(long)).first()
    assert r["n_turns"] == 3000 and r["loss_chars"] == sum(len(f"turn {i} " * 50) for i in range(1, 3000, 2))


def test_licences(docs, none):
    out = {(r["doc_id"], r["n_words"]): r for r in licences.scan(docs).collect()}
    assert out[6, 5]["base_labels"] == out[6, 5]["labels"] == "mit" and out[6, 5]["first_word"] == 1 and out[6, 5]["score"] == 1.0
    assert out[2, 0]["first_word"] is None and out[2, 0]["labels"] == "" and licences.scan(none).count() == 0
    text = "of the " * 20 + "under the MIT-license, under the mit license CC BY NC cc by nc apache license version 2.0 of"
    seq = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower().encode())
    want = [i for p in licences.BASE for i in range(len(seq)) if seq[i : i + len(p.split())] == p.encode().split()]
    assert sorted(licences.Scanner(licences.TEMPLATES, licences.BASE).scan(text)["starts"]) == sorted(want)


def test_licence_chains_and_statistics_against_brute_force():
    rng = np.random.default_rng(12)
    sequences = [[b"%d" % x for x in rng.integers(0, 5, n)] for n in (9, 30, 12)]
    automaton = licences.Automaton(sequences, set())
    text = [b"%d" % x for x in rng.integers(0, 6, 300)] + sequences[1]
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    got = [n for _, n in automaton.statistics([automaton.ids.get(w, 0) for w in text])]
    assert got == [max((n for n in range(min(i + 1, 30) + 1) if n == 0 or tuple(text[i - n + 1 : i + 1]) in runs)) for i in range(len(text))]
    for gap in (2, 12):
        seeds = [(int(x), int(y), int(n)) for x, y, n in zip(rng.integers(0, 400, 60), rng.integers(0, 300, 60), rng.choice([3, 5, 90, 150], 60), strict=True)]
        best = {}

        def covered(seed):
            if seed not in best:
                x, y, n = seed
                before = [covered(p)[0] for p in set(seeds) if p[0] + p[2] <= x <= p[0] + p[2] + gap and p[1] + p[2] <= y]
                best[seed] = (n + max(before, default=0),)
            return best[seed]

        assert licences.chained(seeds, gap)[0] == max(covered(s)[0] for s in seeds)
    words = [f"w{i}" for i in range(200)]
    scanner = licences.Scanner([("long", " ".join(words))], licences.BASE)
    found = scanner.scan("x " * 5 + " ".join(words[:90]) + " odd " + " ".join(words[90:]))
    assert found["labels"] == ["long"] and found["score"] == 1.0 and found["spans"][0][1:3] == (5, 205)


def brute_components(texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {i: shingles(t) for i, t in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(spark, docs, none):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 500, 80)]
    texts = []
    for i in range(60):  # a group of near-copies with 0 to 6 edits, some out of reach of the others
        w = list(base)
        for _ in range(int(rng.integers(0, 7))):
            w[int(rng.integers(0, 80))] = f"e{rng.integers(0, 30)}"
        texts.append((i, " ".join(w)))
    texts += [(100, None), (101, ""), (102, "One two"), (103, "one TWO"), (104, "É é"), (105, texts[0][1].upper())]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    rows = neardup.near_duplicates(table).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert neardup.near_duplicates(docs).count() == len(ROWS) and neardup.near_duplicates(none).count() == 0


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """Many components that share shingles, none of them a star of its bucket; blocks of four rows."""
    rng = np.random.default_rng(15)
    common, texts = [f"c{x}" for x in range(60)], []
    for g in range(12):
        base = common[:44] + [f"g{g}x{x}" for x in range(12)]
        for i in range(6):
            w = list(base)
            for _ in range(i):
                w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 40)}"
            texts.append((100 * g + i, " ".join(w)))
    texts += [(5000, "long text " * 60_000), (5001, "long text " * 60_000 + "end")]
    want = brute_components(texts)
    table = spark.createDataFrame(texts, "doc_id long, text string")
    for block in (4, 1024):
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table).collect()} == want


def test_near_duplicates_of_short_texts(spark):
    """Sets of few shingles miss no link: 3 of 4 shingles in common."""
    texts = []
    for i in range(150):
        w = [f"w{i}x{k}" for k in range(8)]
        texts += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:7]))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in texts}
    for size in range(1, 22):
        shingles = np.sort(np.random.default_rng(size).integers(0, 1 << 63, size + 1, dtype=np.uint64))
        some = set(neardup.first_shingles(shingles[:size], 75))
        assert len(some) == size - -(-75 * size // 100) + 1 and (size * 100 < 75 * (size + 1) or some & set(neardup.first_shingles(shingles, 75)) or size + 1 > 21)


def test_near_duplicates_with_repeated_and_null_keys(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve", "red blue green white black pink grey brown gold teal lime navy"
    rows = [(5, a), (3, a + " x"), (5, b), (9, b + " y"), (None, a), (None, "no key and no other of its kind at all"), (None, None), (7, None), (7, None), (9, b + " y")]
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, component int")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table).collect())
    assert got == Counter({(5, 3, False): 1, (3, 3, True): 1, (5, 5, True): 1, (9, 5, False): 2, (None, 3, False): 1, (None, None, True): 2, (7, 7, True): 2})
    stays = neardup.representatives(table)
    assert stays.columns == table.columns and sorted(r["component"] for r in stays.collect()) == [1, 2, 5, 6, 7, 8]
    same = spark.createDataFrame([(1, a, "x"), (1, a, "x"), (None, b, "x"), (None, b, "x")], "doc_id long, text string, _row string")
    assert sorted((str(r["doc_id"]), r["_row"]) for r in neardup.representatives(same).collect()) == [("1", "x"), ("None", "x")]
    assert neardup.representatives(table.where("false")).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(60, 50), (50, 70), (80, 80)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[60] == got[70] == got[50] == 50


def test_toxicity(spark, none):
    rows = [(i, ("fine words here again " if i % 4 else "fine words scum here ") + f"t{i}") for i in range(400)] + [(900, None), (901, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    got = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(400)) and got[900]["predicted"] == got[901]["predicted"] == 0
    # null and repeated keys, equal and very long texts, columns with the names of results
    odd = spark.createDataFrame([(None, "scum", 1.0), (1, "scum", 2.0), (1, "scum", 2.0), (7, "fine words " * 100_000, None), (8, "scum " * 50_000, 0.0)], "doc_id long, text string, score double")
    rows = toxicity.score(odd, model).collect()
    assert [r["predicted"] for r in rows] == [1, 1, 1, 0, 1] and len({r["score"] for r in rows[:3]}) == 1
    assert toxicity.kept(odd, model).collect() == odd.where("doc_id = 7").collect()
    held = spark.createDataFrame([(None,), (5,)], "doc_id long").select(toxicity.held_out(F.col("doc_id"))).collect()
    assert [r[0] for r in held] == [False, zlib.crc32(b"5") % 5 == 0]
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


@pytest.mark.parametrize(("clean", "toxic"), [(58, 12), (500, 12)])
def test_toxicity_of_few_examples(spark, clean, toxic):
    rng = np.random.default_rng(9)
    lexicon, bad = [f"{x:x}w" for x in range(200, 320)], ["scum", "filth", "vermin", "lout"]
    some = lambda words, n: list(rng.choice(words, n))
    rows = [(i, " ".join(some(lexicon, 20) + [b for k, b in enumerate(bad) if i < toxic and k in (i % 4, (i + 1) % 4)])) for i in range(clean + toxic)]
    more = [(10_000 + i, " ".join(some(lexicon, 20) + ([bad[i % 4], bad[(i + 1) % 4]] if i < 20 else []))) for i in range(100)]
    table = spark.createDataFrame(rows + more, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < toxic)) for i in range(clean + toxic)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(table, toxicity.fit(table, labels)).collect()}
    assert sum(got[10_000 + i] for i in range(20)) >= 16 and sum(got[10_000 + i] for i in range(20, 100)) <= 4


def test_nearest_is_exhaustive(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(toxicity, "LONG", 12)
    for spread in (40, 400):
        vectors = []
        for _ in range(700):
            t = np.unique(np.minimum((rng.random(6) ** 3 * spread).astype(np.int32), spread - 1))
            w = rng.random(len(t)) + 0.1
            vectors.append((t, w / np.sqrt(w @ w)))
        vectors[5] = (vectors[5][0][:0], vectors[5][1][:0])
        index = toxicity.Index(vectors, spread)
        dense = np.zeros((700, spread))
        for i, (t, w) in enumerate(vectors):
            dense[i, t] = w
        for i, (t, w) in enumerate(vectors[:60]):
            ids, got = index.nearest(t, w, 15)
            want = np.sort(dense[:, t] @ w)[::-1][:15]
            assert np.allclose(got, want[want > 0], atol=1e-5) and np.allclose(dense[ids][:, t] @ w, got, atol=1e-5)
            assert i not in index.nearest(t, w, 15, without=i)[0]


def test_nearest_of_many_texts_is_that_of_each():
    rng = np.random.default_rng(6)
    vectors = []
    for _ in range(500):
        t = np.unique((rng.random(30) ** 3 * 3000).astype(np.int32))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt(w @ w)))
    index, texts = toxicity.Index(vectors, 3000), [*vectors[:90], (vectors[0][0][:0], vectors[0][1][:0])]
    for without in (None, list(range(91))):
        for i, (ids, cosines) in enumerate(index.nearest_all(texts, 15, without)):
            one = index.nearest(*texts[i], 15, without=-1 if without is None else i)
            assert ids.tolist() == one[0].tolist() and cosines.tolist() == one[1].tolist()  # to the last bit


def test_decontamination(spark, docs, none):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    items = [(i, " ".join(word() for _ in range(24)) + ". " + " ".join(word() for _ in range(6)) + ".") for i in range(12)]
    noise = lambda n: " ".join(word() for _ in range(n))
    changed = " ".join(w if k % 5 else word() for k, w in enumerate(items[3][1].split()))
    texts = [(i, noise(150)) for i in range(80)] + [(100, noise(70) + " " + items[2][1].upper() + " " + noise(70)), (101, noise(30) + " " + changed + " " + noise(90)), (102, None)]
    benchmark = spark.createDataFrame([*items, (None, "x"), (99, None)], "item_id long, text string")
    hits = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in hits} == {(100, 2), (101, 3)}
    assert decontaminate.contaminated(none, benchmark).count() == 0 and decontaminate.contaminated(docs, benchmark.where("false")).count() == 0


def test_decontamination_of_much_repeated_items(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    items = [(i, " ".join(word() for _ in range(24)) + ". " + " ".join(word() for _ in range(6)) + ".") for i in range(12)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rare = [w for i, t in items if i != 5 for w in re.findall("[a-h]+", t)]
    other = lambda n: " ".join(rng.choice(rare, n))
    # one item, whole or with a sixth of its words changed, in a third of the documents, between rarer words of the others
    copy = lambda i: items[5][1] if i % 2 else " ".join(w if k % 6 else word() for k, w in enumerate(items[5][1].split()))
    texts = [(i, f"{other(40 + i % 9)} {copy(i)} {other(30)}" if i % 3 == 0 else other(100)) for i in range(300)]
    hits = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in hits} == {(i, 5) for i in range(0, 300, 3)}
    few = [(i, " ".join(word() for _ in range(40))) for i in range(48)] + [(100 + i, items[7][1]) for i in range(2)]
    hits = decontaminate.contaminated(spark.createDataFrame(few, "doc_id long, text string"), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in hits} == {(100, 7), (101, 7)}


def test_decontamination_of_long_items(spark):
    rng = np.random.default_rng(8)
    some = lambda n: " ".join("".join(w) for w in rng.choice(list("abcdefgh"), (n, 6)))
    items = [(i, f"{some(n)}. {some(10)}.") for i, n in enumerate((20, 60, 70, 300, 900, 3000))]
    changed = lambda t: " ".join(w if k % 5 else "other" for k, w in enumerate(t.split()))
    texts = [(i, some(120)) for i in range(60)]
    texts += [(100 + i, f"{some(50 + i)} {t} {some(40)}") for i, t in items] + [(200 + i, f"{some(45 - i)} {changed(t)} {some(9)}") for i, t in items]
    hits = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in hits) == sorted((n + i, i) for n in (100, 200) for i, _ in items)


def test_url_filter(spark):
    e = [("l", "block", "host", "A.example", "add", "2024-01-10"), ("l", "block", "host", "a.example", "remove", "2024-01-20"), ("w", "allow", "prefix", "a.example/x", "add", "2024-01-01"), ("d", "block", "domain", "b.example", "add", "2024-02-01"), ("d", "block", None, "b", "add", "2024-02-01")]
    entries = spark.createDataFrame(e, "list string, verdict string, kind string, value string, action string, at string").withColumn("at", F.to_date("at"))
    c = [("http://a.example/q?x", "2024-01-09"), ("http://u@A.example:80/q", "2024-01-10"), ("https://a.example/q", "2024-01-20"), ("http://a.example/x/y", "2024-01-15"), ("http://m.b.example/", "2024-03-01"), (None, "2024-03-01"), ("http://a.example/q", None), ("no url", "2024-01-15"), ("no url", "2024-01-15")]
    captures = spark.createDataFrame(c, "url string, fetched_at string").withColumn("fetched_at", F.to_date("fetched_at"))
    got = Counter((r["url"], r["verdict"], r["list"]) for r in urlfilter.judge(captures, entries).collect())
    assert sum(got.values()) == len(c) and got["no url", "none", None] == 2
    assert got["http://u@A.example:80/q", "block", "l"] == got["http://a.example/x/y", "allow", "w"] == got["http://m.b.example/", "block", "d"] == got["https://a.example/q", "none", None] == 1
    assert urlfilter.judge(captures, entries.where("false")).where("verdict <> 'none'").count() == 0
    clash = captures.withColumns({"verdict": F.lit("mine"), "key": F.lit("k"), "entry": F.lit(1), "rank": F.lit(2)})
    out = urlfilter.judge(clash, entries)
    assert out.count() == len(c) and {r["key"] for r in out.collect()} == {"k"} and out.where("verdict = 'mine'").count() == 0
