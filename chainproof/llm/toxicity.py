"""Toxicity by nearest labelled examples.

Features are a text's words and the openings of its longer words; the vocabulary is all that the
examples have. Examples are a bounded sample of labelled rows (``SAMPLE`` for each label), whole. A
term's weight is its inverse document frequency, counted over all documents, times its correlation
with the label in the sample: chance terms weigh little, but every term counts.

The nearest examples are those of largest cosine of such vectors, found exactly by an inverted index
with block maxima. The lists of rarer terms are added up whole; those of the ``LONG`` terms that most
examples have are held by blocks of examples, with each block's largest weight, and blocks are
opened in descending order of what their examples can still reach, until none can hold a neighbour.

A neighbour votes with a weight that falls with its distance; votes are weighted so that the
sample stands for all labelled rows, and an isotonic fit of left-out votes makes them
probabilities. A text that shares no term with any example scores as the labels are on the whole.

Terms are known by their 64-bit hashes, so that a worker holds arrays and no dictionary of words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainproof.llm.common import mixed, short_batches, sliced, written

#: Labelled rows of each label that the model is fitted on, at most.
SAMPLE = 1000
#: Neighbours that vote; examples in a block; terms that are held by blocks; blocks opened first; texts that blocks are opened for at once.
NEIGHBOURS, BLOCK, LONG, FIRST, TEXTS = 15, 64, 2048, 4, 256
#: Terms whose counts go together in one row; characters beyond which a text's words are counted first.
CHUNK, GIANT = 8192, 4_000_000

_word = re.compile(r"\w+")
_rng = np.random.default_rng(20_240_311)
_PLACE = _rng.integers(1, 1 << 63, 7, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIZE = _rng.integers(1, 1 << 63, 8, dtype=np.uint64)


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, word) of what words stand for: each word itself, and its openings of four to seven
    letters where it is longer."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    sums = np.cumsum(np.array(words, "U7").view(np.uint32).reshape(n, 7).astype(np.uint64) * _PLACE, axis=1)
    hashes, owners = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)], [np.arange(n)]
    for k in range(4, 8):
        on = np.flatnonzero(size > k)
        hashes.append(mixed(sums[on, k - 1] ^ _SIZE[k]))
        owners.append(on)
    return np.concatenate(hashes), np.concatenate(owners)


def spelled(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The different words of texts; and of each occurrence the text, the word and how many it is."""
    words = [_word.findall(t.lower()) if t and len(t) < GIANT else Counter(m[0] for m in _word.finditer((t or "").lower())) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    times = np.concatenate([np.ones(len(w), np.int64) if isinstance(w, list) else np.fromiter(w.values(), np.int64, len(w)) for w in words])
    return list(number), np.repeat(np.arange(len(texts)), sizes), ids, times


def counted(texts: list[str | None], vocabulary: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, counts) of each text: places in the sorted hashes of ``vocabulary``, or where there is
    none the hashes themselves; ascending."""
    words, text, ids, times = spelled(texts)
    if not words or vocabulary is not None and not len(vocabulary):
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
    term, owner = hashed(words)
    own = np.unique(term) if vocabulary is None else vocabulary
    place = np.minimum(np.searchsorted(own, term), len(own) - 1)
    known = own[place] == term
    place, owner = place[known], owner[known]
    place = place[np.argsort(owner, kind="stable")]
    n = np.bincount(owner, minlength=len(words))
    first = np.cumsum(n) - n
    m = n[ids]  # terms of each occurrence
    at = np.repeat(first[ids] - np.cumsum(m) + m, m) + np.arange(m.sum())
    key, back = np.unique(np.repeat(text, m) * len(own) + place[at], return_inverse=True)
    counts = np.bincount(back, np.repeat(times, m), minlength=len(key)).astype(np.int64)
    cuts = np.searchsorted(key, np.arange(1, len(texts)) * len(own))
    terms = key % len(own) if vocabulary is not None else own[key % len(own)]
    return list(zip(np.split(terms, cuts), np.split(counts, cuts), strict=True))


def whole(weights: np.ndarray) -> np.ndarray:
    """Weights of 0 to 1 in whole 2^24ths, so that sums of their products are exact in any order."""
    return np.round(weights * (1 << 24)) / (1 << 24)


class Index:
    """Inverted index of unit vectors (terms, weights) with block maxima for the terms of most examples."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        heavy = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        self.order = np.array(sorted(range(len(vectors)), key=lambda i: (heavy[i], i)), dtype=np.int64)  # like texts share blocks
        self.place = np.argsort(self.order)
        self.blocks = max(1, -(-len(vectors) // BLOCK))
        none = np.zeros(0, np.int64)
        doc = np.concatenate([none, *(np.full(len(vectors[i][0]), k) for k, i in enumerate(self.order))]).astype(np.int32)
        term = np.concatenate([none, *(vectors[i][0] for i in self.order)])
        weight = whole(np.concatenate([none, *(vectors[i][1] for i in self.order)])).astype(np.float32)
        df = np.bincount(term, minlength=n_terms)
        long = np.argsort(-df, kind="stable")[:LONG]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[long] = np.arange(len(long))
        column = self.column[term]
        on = column >= 0
        self.dense = np.zeros((self.blocks, len(long), BLOCK), np.float32)
        self.dense[doc[on] // BLOCK, column[on], doc[on] % BLOCK] = weight[on]
        self.top = self.dense.max(axis=2).T.astype(np.float64)
        by = np.argsort(term[~on], kind="stable")
        self.doc, self.weight = doc[~on][by], weight[~on][by]
        df[long] = 0
        self.cut = np.concatenate([[0], np.cumsum(df)])

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """What ``nearest_all`` gives for one text."""
        return self.nearest_all([(terms, weights)], k, [without] if without >= 0 else None)[0]

    def nearest_all(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of the k largest cosines over 0 of each text, ties to the first in the index's
        order; a text's example in ``without`` is left out. Examples are numbered as given. A block is opened for
        all texts that it may matter to at once, by a product of matrices."""
        n, width = len(texts), self.blocks * BLOCK
        row = np.repeat(np.arange(n), [len(t) for t, _ in texts])
        terms, weights = np.concatenate([t for t, _ in texts]).astype(np.int64), whole(np.concatenate([w for _, w in texts]))
        a = self.cut[terms]
        m = self.cut[terms + 1] - a
        places = np.repeat(a - np.cumsum(m) + m, m) + np.arange(m.sum())
        sums = np.bincount(np.repeat(row * width, m) + self.doc[places], self.weight[places] * np.repeat(weights, m), minlength=n * width)
        sums = sums.astype(np.float64).reshape(n, self.blocks, BLOCK)
        for i, x in enumerate(without or ()):
            sums[(i, *divmod(self.place[x], BLOCK))] = -np.inf
        columns = self.column[terms]
        on = columns >= 0
        q = np.zeros((n, self.dense.shape[1]))
        q[row[on], columns[on]] = weights[on]
        bound = sums.max(axis=2) + q @ self.top + 1e-6

        def opened(todo: np.ndarray) -> None:
            for block in np.flatnonzero(todo.any(axis=0)):
                own = np.flatnonzero(todo[:, block])
                sums[own, block] += q[own] @ self.dense[block].astype(np.float64)

        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, axis=1)
        first &= bound >= 2e-6
        opened(first)
        least = np.full(n, 2e-6)
        if k <= width:
            best = np.where(first[:, :, None], sums, -np.inf).reshape(n, width)
            least = np.maximum(least, np.partition(best, width - k, axis=1)[:, width - k])
        open_ = bound >= least[:, None]
        opened(open_ & ~first)
        out = []
        for own, seen in zip(sums, open_, strict=True):
            found = np.flatnonzero((own > 0) & seen[:, None])
            s = own.ravel()[found]
            if len(found) > k:
                found, s = (x[s >= np.partition(s, len(s) - k)[len(s) - k]] for x in (found, s))
            turn = np.lexsort((found, -s))[:k]
            out.append((self.order[found[turn]], s[turn]))
        return out


class Model:
    """Vocabulary, weights, index, class weights and calibration."""

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, base: float):
        self.vocabulary, self.weight, self.base = vocabulary, weight.astype(np.float32), base
        self.index = Index([], len(vocabulary))
        self.labels, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.per_label = (1.0, 1.0)
        self.knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of a text's vector of length one."""
        w = (1 + np.log(counts)) * self.weight[terms]
        terms, w = terms[w > 0], w[w > 0]
        return terms, w / np.sqrt(w @ w) if len(w) else w

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[float | None, np.ndarray, np.ndarray]]:
        """Vote (None without neighbours), nearest examples and cosines of each text's vector."""
        out = []
        for at in range(0, len(texts), TEXTS):
            for ids, cosines in self.index.nearest_all(texts[at : at + TEXTS], NEIGHBOURS, without and without[at : at + TEXTS]):
                toxic = self.labels[ids]
                w = np.where(toxic == 1, self.per_label[1], self.per_label[0]) / (1.05 - np.minimum(cosines, 1.0))
                out.append((float(w[toxic == 1].sum() / w.sum()) if len(ids) else None, ids, cosines))
        return out

    def score(self, raw: float | None) -> float:
        return float(min(1.0, max(0.0, self.base if raw is None else np.interp(raw, *self.knots))))

    def judged(self, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[float, np.ndarray, np.ndarray]]]]:
        """Slices of the batches, and for each row score, nearest examples and cosines."""
        for batch in sliced(batches, column):
            units = [self.unit(t, n) for t, n in counted(batch.column(column).to_pylist(), self.vocabulary)]
            yield batch, [(self.score(raw), ids, cosines) for raw, ids, cosines in self.votes(units)]


def isotonic(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of label by raw (pool adjacent violators)."""
    groups: list[list[float]] = []  # weight, weighted label, first and last raw
    for x in np.unique(raw):
        own = raw == x
        groups.append([float(weight[own].sum()), float((weight * label)[own].sum()), float(x), float(x)])
        while len(groups) > 1 and groups[-2][1] * groups[-1][0] >= groups[-1][1] * groups[-2][0]:
            g = groups.pop()
            groups[-1] = [groups[-1][0] + g[0], groups[-1][1] + g[1], groups[-1][2], g[3]]
    x = np.array([v for g in groups for v in (g[2], g[3])])
    y = np.array([v for g in groups for v in [g[1] / g[0]] * 2])
    return x, y


def may_learn(key: Column) -> Column:
    """Rows whose labels a model may learn from; the others are held out. False for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def held_out(key: Column) -> Column:
    """Rows of the held-out fifth. False for a null key, which has no label to learn from either."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _document_frequencies(texts: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents that have each term, and all documents. Each task counts its own; the counts go in
    chunks of terms, so what meets is in proportion to tasks and vocabulary."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)
    schema, names = "chunk long, part binary", ["chunk", "part"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, rows = shared.value, 0
        df = np.zeros(len(vocabulary), np.int64)
        for batch in sliced(batches, "text"):
            rows += batch.num_rows
            found = counted(batch.column("text").to_pylist(), vocabulary)
            df += np.bincount(np.concatenate([t for t, _ in found]), minlength=len(df))
        some = [c for c in range(0, len(df), CHUNK) if df[c : c + CHUNK].any()]
        parts = [np.array([rows], np.int64).tobytes(), *(df[c : c + CHUNK].tobytes() for c in some)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *(c // CHUNK for c in some)], pa.int64()), pa.array(parts, pa.binary())], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in zip(batch.column("chunk").to_pylist(), batch.column("part"), strict=True):
                v = np.frombuffer(x.as_buffer(), np.int64)
                own[c] = own[c] + v if c in own else v.copy()
        for c, v in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=names)

    df, rows = np.zeros(len(vocabulary)), 0
    for r in texts.mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect():  # the vocabulary's size
        v = np.frombuffer(r["part"], np.int64)
        if r["chunk"] < 0:
            rows = int(v[0])
        else:
            df[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(v)] = v
    return df, rows


def _examples(texts: DataFrame, sample: DataFrame) -> DataFrame:
    """(id, y, terms, counts) of the sample's different texts, terms as hashes in binary."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows = [(t.tobytes(), n.astype(np.int32).tobytes()) for t, n in counted(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), *(pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1))], names=["id", "y", "terms", "counts"])

    one = texts.join(F.broadcast(sample), "id").select("id", "y", "text")  # 2 * SAMPLE ids at most
    found = written(one.mapInArrow(spell, "id long, y int, terms binary, counts binary").withColumn("hash", F.xxhash64("terms", "counts")), "examples")
    first = found.groupBy("hash", "y").agg(F.min("id").alias("id"))
    different = written(found.join(first, ["hash", "y", "id"], "left_semi").dropDuplicates(["hash", "y", "id"]), "different")
    # one id may have many texts: the bound is on rows
    parts = [different.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id", "hash").limit(SAMPLE).drop("hash") for v in (0, 1)]
    return written(parts[0].unionByName(parts[1]), "examples")


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labels (0 or 1) of rows outside the held-out fifth, and the texts of
    ``docs``. Labels that are null, have a null key or no document teach nothing; of several
    labels of one key the largest counts; equal texts of one label are one example."""
    spark = docs.sparkSession
    short_batches(spark)
    k, t = F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")
    y = labels.select(k.alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y in (0, 1)").where(may_learn(F.col("id")))
    y = y.groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(k.alias("id"), t.alias("text"))
    y = written(y.join(texts.select("id").distinct(), "id", "left_semi"), "labels")
    totals = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = None
    for v in (0, 1):
        part = y.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
        sample = part if sample is None else sample.unionByName(part)
    base = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1) if totals else 0.0
    table = _examples(texts, sample)
    rows = sorted(((r["id"], r["y"], np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], np.int32)) for r in table.collect()), key=lambda r: r[:2])  # 2 * SAMPLE rows at most
    y_of = np.array([r[1] for r in rows], np.int64)
    n1 = int(y_of.sum())
    n0 = len(y_of) - n1
    if not n0 or not n1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), base)

    vocabulary = np.unique(np.concatenate([r[2] for r in rows]))
    numbered = [(np.searchsorted(vocabulary, t), n) for _, _, t, n in rows]
    m = np.bincount(np.concatenate([t for t, _ in numbered]), minlength=len(vocabulary)).astype(np.float64)
    a = np.bincount(np.concatenate([t for (t, _), v in zip(numbered, y_of, strict=True) if v] or [np.zeros(0, np.int64)]), minlength=len(vocabulary)).astype(np.float64)
    correlation = np.abs(a * n0 - (m - a) * n1) / np.sqrt(float(n0) * n1 * m * np.maximum(n0 + n1 - m, 1e-9))
    df, count = _document_frequencies(texts.select("text"), vocabulary)
    model = Model(vocabulary, (np.log((1 + count) / (1 + df)) + 1) * correlation, base)
    model.labels, model.ids = y_of, np.array([r[0] for r in rows], np.int64)
    model.per_label = (totals[0] / n0, totals[1] / n1)
    model.index = Index([model.unit(t, n) for t, n in numbered], len(vocabulary))

    shared = spark.sparkContext.broadcast(model)
    same = lambda i, y, t, n: (i, y, xxhash.xxh3_64_intdigest(bytes(t) + bytes(n)))
    place = spark.sparkContext.broadcast({same(i, y, t.tobytes(), n.tobytes()): at for at, (i, y, t, n) in enumerate(rows)})

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, places = shared.value, place.value
        for batch in sliced(batches, "terms"):
            units, at = [], []
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "y", "terms", "counts")), strict=True):
                at.append(places[same(*row)])
                terms = np.searchsorted(model.vocabulary, np.frombuffer(row[2], np.uint64))
                units.append(model.unit(terms, np.frombuffer(row[3], np.int32)))
            raw = [r for r, _, _ in model.votes(units, at)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw, pa.float64())], names=["i", "raw"])

    got = table.repartition(16).mapInArrow(left_out, "i long, raw double").where("raw is not null").collect()
    if got:
        raw, own = np.array([r["raw"] for r in got]), y_of[[r["i"] for r in got]]
        model.knots = isotonic(raw, own, np.where(own == 1, model.per_label[1], model.per_label[0]))
    for x in (shared, place):
        x.destroy()  # no later task reads them
    return model


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, score, predicted (score >= 0.5) and evidence, the
    nearest three examples (doc_id, label, cosine).

    Null and empty texts have no terms and score as the labels are on the whole; null and repeated
    keys are scored row by row, and equal texts score alike; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, label: int, cosine: double>>"
    kinds = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, rows in model.judged(batches, "text"):
            s = np.array([r[0] for r in rows], dtype=np.float64)
            evidence = [[{"doc_id": int(model.ids[i]), "label": int(model.labels[i]), "cosine": min(1.0, float(v))} for i, v in zip(ids[:3], cosines[:3], strict=True)] for _, ids, cosines in rows]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(evidence, kinds)], names=["doc_id", "score", "predicted", "evidence"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, schema)


def kept(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that score 0.5 or more. Rows are judged one by one
    where they are read; nothing is joined back, so null and repeated keys do not matter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in shared.value.judged(batches, text):
            yield batch.filter(pa.array([r[0] < 0.5 for r in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
