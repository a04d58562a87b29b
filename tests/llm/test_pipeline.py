"""The corpus pipeline, stage by stage and whole, against brute force on a small corpus."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from chainproof.llm import decontaminate, toxicity
from chainproof.llm.tokens import encoder


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(texts):
    """Components of row numbers by links of 0.75 or more."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            if x and 100 * len(x & sets[b]) >= 75 * len(x | sets[b]):
                parent[find(a)] = find(b)
    return [find(i) if s else None for i, s in enumerate(sets)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Rows with the reason why they go, or stay: (doc_id, text, source, lang, n_chars, why)."""
    rng = np.random.default_rng(11)
    lexicon = ["".join(rng.choice(list("bcdfgklmnprstvz"), 5)) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(lexicon, n))
    rows, items = [], [(i, some(28) + ". " + some(7) + ".") for i in range(6)]
    toxic = lambda: " ".join(["scum", "vermin", some(30), "scum", "filth"])
    rows += [(i, toxic(), "toxic") for i in range(40)] + [(100 + i, some(60), "stays") for i in range(120)]
    for i in range(5):
        text = some(50)
        rows += [(400 + 3 * i, text, "stays"), (401 + 3 * i, text.upper(), "copy"), (402 + 3 * i, text + " more", "copy")]
    rows += [(500 + i, f"{some(40)} {items[i][1]} {some(40)}", "leak") for i in range(4)]
    twice, lone, odd = some(40), some(45), some(44)
    rows += [(600, twice, "stays"), (600, twice, "copy"), (None, lone, "stays"), (None, lone, "copy"), (None, f"{some(20)} {items[5][1]} {some(20)}", "leak")]
    rows += [(700, odd, "stays"), (701, odd + " end", "copy"), (701, some(50), "stays"), (None, None, "stays"), (800, "", "stays"), (800, "", "stays"), (900, some(9000), "stays")]
    folder = tmp_path_factory.mktemp("sf")
    # a column with the name of a working one
    docs = spark.createDataFrame([(d, t, "s", "en", len(t or ""), why) for d, t, why in rows], "doc_id long, text string, source string, lang string, n_chars long, component string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 40)) for i in [*range(40), *range(100, 220)]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def count(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def wanted(rows, *why):
    return Counter((d, t) for d, t, w in rows if w in why)


def test_stages_and_whole(spark, corpus):
    folder, rows = corpus
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "packing"]
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns and count(clean) == wanted(rows, "stays", "copy", "leak")
    # on its own input: one row of each brute-force component, the smallest doc_id's
    texts = [(d, t) for d, t, _ in rows]
    component = groups([t for _, t in texts])
    best = {}
    for i, c in enumerate(component):
        if c is not None:
            best.setdefault(c, []).append((texts[i][0] is None, texts[i][0] or 0, texts[i][1]))
    want = Counter((None if none else d, t) for none, d, t in map(min, best.values())) + Counter(x for x, c in zip(texts, component, strict=True) if c is None)
    alone = stages["near_dedup"](spark, docs, folder)
    assert alone.columns == docs.columns and count(alone) == want
    free = stages["decontamination"](spark, docs, folder)
    assert free.columns == docs.columns and count(free) == wanted(rows, "stays", "copy", "toxic")
    empty = docs.where("false")
    assert all(stages[n](spark, empty, folder).count() == 0 for n in ("toxicity", "near_dedup", "decontamination", "packing"))

    enc = encoder("word_bpe_49k.json")
    packed = corpus_pipeline.run(spark, folder).collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    pieces = Counter()
    for (d, t), n in wanted(rows, "stays").items():
        ids = np.array(enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 4096):
            pieces[d, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += n
    assert got == pieces
    fill = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 4096


def test_recall_of_the_search(spark):
    """Of all hits that an exhaustive comparison of every window with every item finds, 0.9 or more."""
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    items = decontaminate.Items([tuple(r) for r in benchmark.select("item_id", "text").orderBy("item_id").collect()])
    want = set()
    for doc, text in docs.select("doc_id", "text").collect():
        ids = decontaminate._as_numbers([text], items.vocabulary)[0]
        n = np.bincount(ids, minlength=len(items.vocabulary) + 1)
        for i, own in enumerate(items.ids):
            terms, counts = items.terms[i]
            if np.minimum(n[terms], counts).sum() < decontaminate.SHARE * len(own):  # no window can have more
                continue
            if any(decontaminate.confirmed(ids, a, a + size, items, i) for size in decontaminate.WINDOWS for a in range(0, max(1, len(ids) - size // 2), size // 2)):
                want.add((doc, items.keys[i]))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert len(want) > 20 and got <= want and len(got) >= 0.9 * len(want)


def test_search_in_blocks_and_passes(spark, monkeypatch):
    rng = np.random.default_rng(21)
    some = lambda n: " ".join("".join(w) for w in rng.choice(list("abcdefgh"), (n, 6)))
    items = [(i, f"{some(20)}. {some(8)}.") for i in range(24)] + [(24, None), (3, f"{some(20)}. {some(8)}.")]
    texts = [(i, f"{some(60)} {items[i][1]} {some(50)}") for i in range(24)] + [(100 + i, some(90)) for i in range(30)]
    texts += [(7, items[7][1]), (7, items[7][1]), (None, items[25][1].upper()), (200, some(30_000) + " " + items[2][1])]
    table = spark.createDataFrame([(*t, 0.0) for t in texts], "doc_id long, text string, share double")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = Counter([(i, i) for i in range(24)] + [(7, 7)] * 2 + [(None, 3), (200, 2)])
    for size, blocks in ((240, 8), (5, 8), (5, 2)):
        monkeypatch.setattr(decontaminate, "ITEMS", size)
        monkeypatch.setattr(decontaminate, "BLOCKS", blocks)
        assert Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(table, benchmark).collect()) == want
        assert decontaminate.kept(table, benchmark).select("doc_id").where("doc_id < 100").count() == 0


def test_model_learns_outside_the_held_out_fifth(spark):
    """Labels of the held-out rows change no score."""
    rng = np.random.default_rng(31)
    words = [f"w{i}" for i in range(60)]
    table = spark.createDataFrame([(i, " ".join(rng.choice(words, 12)) + (" scum" if i % 5 == 0 else "")) for i in range(200)], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, int((i % 5 == 0) != (flip and held(i)))) for i in range(200)], "doc_id long, toxic int")
        scores.append(sorted((r["doc_id"], r["score"]) for r in toxicity.score(table, toxicity.fit(table, labels)).drop("evidence").collect()))
    assert scores[0] == scores[1]


def test_basis_is_fitted_on_all_passages(spark, monkeypatch):
    """Every passage of every document is a row of the matrix, however many there are, and the basis holds what the best one holds."""
    monkeypatch.setattr(decontaminate, "ROWS", 7)
    monkeypatch.setattr(decontaminate, "BESIDE", 10)
    monkeypatch.setattr(decontaminate, "RANK", 20)
    rng = np.random.default_rng(5)
    some = lambda n: " ".join(f"w{i}" for i in np.minimum(rng.zipf(1.4, n), 90))
    texts = [(i, some(int(n))) for i, n in enumerate(rng.integers(0, 400, 60))] + [(90, None), (91, "none of these"), (None, some(70))]
    items = decontaminate.Items([(i, some(20)) for i in range(6)])
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    numbered = decontaminate._numbers(docs, items, "doc_id", "text")
    df, count = decontaminate._frequencies(numbered, len(items.vocabulary) + 1)
    items.weigh(df, count)
    space = items.blocks()[0]
    passages = [x[i : i + 64] for x in decontaminate._as_numbers([t for _, t in texts], items.vocabulary) for i in range(0, len(x), 64)]
    rows = np.array([np.bincount(space.place[x], minlength=len(space.idf)) * space.idf for x in passages])
    norms = np.linalg.norm(rows, axis=1)
    rows = rows[norms > 0] / norms[norms > 0][:, None]
    assert count == len(passages) > 100 and len(rows) > 100
    gram = rows.T @ rows
    assert np.allclose(decontaminate._times_gram(numbered, space, np.eye(len(gram))), gram, atol=1e-4)
    own = space.rows()
    whole = gram + 900 * count / 10 * own.T @ own
    basis = decontaminate.latent_basis(numbered, count, space)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-6)
    best = np.linalg.eigvalsh(whole)[::-1][: basis.shape[1]].sum()
    assert np.trace(basis.T @ whole @ basis) >= 0.999 * best and np.allclose(own @ basis @ basis.T, own, atol=0.05)
