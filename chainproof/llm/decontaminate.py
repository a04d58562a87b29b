"""Benchmark decontamination by latent semantic retrieval.

A randomised singular value decomposition of TF-IDF passages gives a latent space; benchmark items
and every window of every document are projected into it, and windows of large cosine to an item
are candidates. Items longer than the longest window are cut into passages, each with a latent row
of its own that points to its item, so that a window holds a whole passage. A candidate is a hit if
the longest common subsequence of its words and the item's covers enough of the item, and enough of
the item's answer (its last sentence), so passages with words changed, dropped or put in are found,
and passages that are merely about the same are not.

The vocabulary is the benchmark's. The texts are read into a written table of each document's words
as numbers in that vocabulary (0: not in it); fitting and search read that table. Document
frequencies are counted over all passages. The decomposition is fitted on every passage of every
document, and the items themselves, in one reading; every window of every document is searched that
has as many of the benchmark's words as a hit needs. Every term has a weight of one at least, however
common: copies of an item make its own words common. The similarity is the inner product in the
latent space over the norms of the whole vectors, so what the space does not hold of a window counts
against it; of the window's norm no more than the item's counts, so rarer words around a copy do not
hide it. It is linear in the words, so windows are sums over words of one table of terms by passages.

Items are put into blocks of about ``ITEMS`` passages, each with a latent space of its own, which
bounds what a decomposition holds (a space has more dimensions than passages). ``BLOCKS`` blocks
share vocabulary, numbers and frequencies and are searched in one pass over the documents; larger
benchmarks take more passes, so what tasks hold does not grow with them.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainproof.llm.common import short_batches, sliced, written

#: Passages of items in a block, dimensions of the latent space (more where a block has more
#: passages than usual) and further ones of the range finder; blocks of one pass over the documents.
ITEMS, RANK, OVER, BLOCKS = 240, 256, 16, 8
#: Tasks that add up a product of matrices, at most; passages that one multiplies at once.
ADDERS, ROWS = 16, 64
#: Words of a passage.
PASSAGE = 64
#: Sizes of the windows that are searched, in words; each starts half a window after the last.
WINDOWS = (32, 64)
#: Words that all windows are made of whole runs of.
STEP = 16
#: Least similarity of a candidate; least shares of item and answer in the common subsequence.
COSINE, SHARE, ANSWER = 0.4, 0.6, 0.5
#: What the rows of items weigh in the decomposition, besides ``BESIDE`` passages of weight 1 or less; of more, more.
ITEM_WEIGHT, BESIDE = 30.0, 50_000

#: Bytes of words: 0-9, a-z and all that are not ASCII; others part words.
_FOLD = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_sentence = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def answer_words(text: str) -> int:
    """Words of the item's answer: its last sentence, or its last quarter if it has one only."""
    parts = [n for n in (len(words(s)) for s in _sentence.split(text)) if n]
    return parts[-1] if len(parts) > 1 else -(-sum(parts) // 4)


def common_subsequence(item: np.ndarray, text: np.ndarray, answer: int) -> tuple[int, int]:
    """Length of the longest common subsequence, and of that of the item's last ``answer`` words,
    bit-parallel over the item."""
    def length(pattern: list[int]) -> int:
        masks: dict[int, int] = {}
        for i, w in enumerate(pattern):
            masks[w] = masks.get(w, 0) | 1 << i
        full = (1 << len(pattern)) - 1
        v = full
        for w in seen:
            if m := masks.get(w):
                u = v & m
                v = ((v + u) | (v - u)) & full
        return len(pattern) - v.bit_count()

    seen = text.tolist()
    own = item.tolist()
    return length(own), length(own[len(own) - answer :])


def passages_of(n: int) -> int:
    """Passages of an item of ``n`` words: one as far as the longest window goes; beyond, as many of
    equal length that each is no longer than half of it, so that some window holds it whole."""
    return 1 if n <= max(WINDOWS) else -(-n // (max(WINDOWS) // 2))


class Items:
    """The benchmark items of one pass: vocabulary, words as numbers, answers, weights."""

    def __init__(self, items: list[tuple[int, str]]):
        kept = [(i, t, w) for i, t, w in ((i, t, words(t)) for i, t in items) if w]
        self.keys, self.answers = [i for i, _, _ in kept], [answer_words(t) for _, t, _ in kept]
        self.vocabulary: dict[bytes, int] = {}
        for _, _, ws in kept:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.ids = [np.array([self.vocabulary[w] for w in ws], np.int32) for _, _, ws in kept]
        self.terms = [np.unique(x, return_counts=True) for x in self.ids]

    def weigh(self, df: np.ndarray, passages: int) -> None:
        """Smoothed inverse document frequencies, 1 at least; 0 for words that are in no item."""
        self.idf = np.log((1 + passages) / (1 + df)) + 1
        self.idf[0] = 0

    def blocks(self) -> list["Space"]:
        """About equal blocks of ``ITEMS`` passages or, where one item has more, its own."""
        spaces, own, n = [], [], 0
        for i, x in enumerate(self.ids):
            more = passages_of(len(x))
            if own and n + more > ITEMS:
                spaces.append(Space(self, own))
                own, n = [], 0
            own.append(i)
            n += more
        return [*spaces, Space(self, own)] if own else spaces


class Space:
    """The latent space of one block of items. Its terms are numbered anew, by ``place``."""

    def __init__(self, items: Items, own: list[int]):
        cut = [np.array_split(items.ids[i], passages_of(len(items.ids[i]))) for i in own]
        self.item = [i for i, c in zip(own, cut, strict=True) for _ in c]  # of each passage
        used = np.unique(np.concatenate([p for c in cut for p in c]))
        self.place = np.zeros(len(items.idf), np.int32)
        self.place[used] = np.arange(1, len(used) + 1)
        self.idf = np.concatenate([[0.0], items.idf[used]])
        self.parts = [self.place[p] for c in cut for p in c]
        # a hit's common words, if they lie within a window's length, touch three halves of windows
        # at most, so one window of two halves has half of them
        self.least = min(-(-int(np.ceil(SHARE * len(x))) // 2) for x in self.parts)

    def rows(self) -> np.ndarray:
        """Unit TF-IDF rows of the items' passages."""
        out = np.zeros((len(self.parts), len(self.idf)), np.float32)
        for r, x in zip(out, self.parts, strict=True):
            np.add.at(r, x, self.idf[x])
        self.norms = np.linalg.norm(out, axis=1)
        return out / self.norms[:, None]

    def project(self, basis: np.ndarray) -> None:
        """``basis``: terms by dimensions."""
        latent = self.rows() @ basis
        self.near = ((basis * self.idf[:, None]) @ latent.T).astype(np.float32)  # what a word adds to each passage's inner product


def _as_numbers(texts: list[str | None], vocabulary: dict[bytes, int]) -> list[np.ndarray]:
    get = vocabulary.get
    return [np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws)) for ws in map(words, texts)]


def _numbers(docs: DataFrame, items: Items, key: str, text: str) -> DataFrame:
    """(doc_id, ids): each document's words as numbers (binary, int32)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            out = [x.tobytes() for x in _as_numbers(batch.column("text").to_pylist(), vocabulary.value)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(number, "doc_id long, ids binary")


def _frequencies(numbered: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """Passages that have each term, and all passages; terms by one rows meet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(terms, np.int64), 0
        for batch in sliced(batches, "ids"):
            for x in batch.column("ids").to_pylist():
                ids = np.frombuffer(x, np.int32)
                n += -(-len(ids) // PASSAGE)
                at = np.flatnonzero(ids)
                pair = np.unique((at // PASSAGE) * terms + ids[at])
                df += np.bincount(pair % terms, minlength=terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*some, -1], pa.int64()), pa.array([*df[some], n], pa.int64())], names=["term", "n"])

    df, n = np.zeros(terms), 0
    for r in numbered.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] < 0:
            n = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, n


def _rows(texts: list[bytes], place: np.ndarray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit TF-IDF rows of all passages of texts, some at a time: their terms, and the rows over these. Passages
    of the same commonest term are put together, as they are of one language and have more terms in common."""
    texts = [np.frombuffer(x, np.int32) for x in texts]
    sizes = np.array([len(x) for x in texts], np.int64)
    passages = -(-sizes // PASSAGE)
    firsts = np.cumsum(passages) - passages
    local = place[np.concatenate(texts)]
    at = np.flatnonzero(local)
    of = (np.repeat(firsts, sizes) + (np.arange(len(local)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // PASSAGE)[at]
    local, begins = local[at], np.flatnonzero(np.diff(of, prepend=-1))
    if not len(local):
        return
    by_idf = np.argsort(np.argsort(idf, kind="stable"))
    order = np.argsort(np.minimum.reduceat(by_idf[local], begins), kind="stable")
    lengths = np.diff(begins, append=len(local))[order]
    ends = np.cumsum(lengths)
    local = local[np.arange(len(local)) + np.repeat(begins[order] - (ends - lengths), lengths)]
    for i in range(0, len(order), ROWS):
        n = lengths[i : i + ROWS]
        own = local[ends[i] - lengths[i] : ends[i] - lengths[i] + n.sum()]
        used = np.zeros(len(idf), bool)
        used[own] = True
        terms = np.flatnonzero(used)
        cells = np.repeat(np.arange(len(n)) * len(terms), n) + (np.cumsum(used) - 1)[own]
        rows = (np.bincount(cells, minlength=len(n) * len(terms)).reshape(len(n), -1) * idf[terms]).astype(np.float32)
        yield terms, rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _times_gram(numbered: DataFrame, space: Space, omega: np.ndarray) -> np.ndarray:
    """A'A omega for the unit TF-IDF rows A of all passages: each task sums its own rows' part and
    the parts are summed in chunks of terms, a chunk at a time. ``ADDERS`` tasks at the most make parts,
    so that these are bounded."""
    terms, dims, chunk = *omega.shape, 256
    shared = numbered.sparkSession.sparkContext.broadcast((omega.astype(np.float32), space.idf, space.place))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega, idf, place = shared.value
        out = np.zeros((terms, dims), np.float32)
        for batch in sliced(batches, "ids"):
            for t, rows in _rows(batch.column("ids").to_pylist(), place, idf):
                out[t] += rows.T @ (rows @ omega[t])
        for c in range(0, terms, chunk):
            own = out[c : c + chunk]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([c // chunk], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["chunk", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in zip(batch.column("chunk").to_pylist(), batch.column("part").to_pylist(), strict=True):
                v = np.frombuffer(x, np.float32).astype(np.float64)
                own[c] = own[c] + v if c in own else v
        for c, v in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["chunk", "part"])

    summed = numbered.select("ids").coalesce(ADDERS).mapInArrow(part, "chunk long, part binary").repartition("chunk").mapInArrow(add, "chunk long, part binary")
    out = np.zeros((terms, dims))
    for r in summed.collect():  # terms by dims, which the block of items bounds
        v = np.frombuffer(r["part"]).reshape(-1, dims)
        out[r["chunk"] * chunk : r["chunk"] * chunk + len(v)] = v
    return out


def latent_basis(numbered: DataFrame, count: int, space: Space) -> np.ndarray:
    """Leading right singular vectors (terms by dimensions) of the TF-IDF rows of all ``count`` passages and
    the items, by a randomised range finder and the Nystrom approximation in it: one reading of the passages."""
    terms = len(space.idf)
    rank = max(RANK, len(space.parts) + OVER)
    dims = min(rank + OVER, terms)
    omega, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((terms, dims)))
    rows = space.rows()
    # items keep their weight against the passages, however many these are
    y = _times_gram(numbered, space, omega) + ITEM_WEIGHT**2 * max(1.0, count / BESIDE) * (rows.T @ (rows @ omega))
    values, vectors = np.linalg.eigh((omega.T @ y + y.T @ omega) / 2)
    good = values > values[-1] * 1e-6  # sums are of single precision
    basis, _, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return basis[:, :rank]


#: Weighted words, or runs of words, of a group of documents that are searched together.
_GROUP = 4_000


def _candidates(texts: list[np.ndarray], s: Space) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, passage, from, to, similarity) of the windows near an item's passage, of a group of
    texts."""
    gap = max(WINDOWS) // STEP  # runs between texts, which no window spans
    runs = np.array([-(-len(x) // STEP) + gap for x in texts])
    bases = np.cumsum(runs) - runs
    local = [s.place[x] for x in texts]
    at = [np.flatnonzero(x) for x in local]
    words_ = np.concatenate([x[p] for x, p in zip(local, at, strict=True)])
    if len(words_) < s.least:
        return
    of = np.concatenate([p // STEP + b for p, b in zip(at, bases, strict=True)])
    first = np.flatnonzero(np.diff(of, prepend=-1))
    near, square = np.zeros((runs.sum(), s.near.shape[1]), np.float32), np.zeros(runs.sum())
    near[of[first]] = np.add.reduceat(s.near[words_], first, axis=0)
    square[of[first]] = np.add.reduceat(s.idf[words_] ** 2, first)  # gives the windows' norms, less where words repeat
    count = np.bincount(of, minlength=len(square))
    for size in WINDOWS:
        step, width = size // 2 // STEP, size // STEP
        starts = np.concatenate([np.arange(b, b + max(1, -(-(len(x) - size // 2) // STEP)), step) for x, b in zip(texts, bases, strict=True)])
        starts = starts[sum(count[starts + k] for k in range(width)) >= s.least]
        v = sum(near[starts + k] for k in range(width))
        norms = np.sqrt(sum(square[starts + k] for k in range(width))).astype(np.float32)
        norms = np.minimum(norms[:, None], s.norms[None, :])
        w, parts = np.nonzero(v >= COSINE * norms)
        own = np.searchsorted(bases, starts[w], side="right") - 1
        where = (starts[w] - bases[own]) * STEP
        cosines = np.minimum(1.0, v[w, parts] / norms[w, parts])
        yield from zip(own.tolist(), parts.tolist(), where.tolist(), (where + size).tolist(), cosines.tolist(), strict=True)


def confirmed(text: np.ndarray, a: int, b: int, items: Items, item: int) -> tuple[float, float] | None:
    """Shares of the item and of its answer in the common subsequence with the text's words from a to
    b, and as many on either side as the item has; None if that is no hit."""
    own = items.ids[item]
    region = text[max(0, a - len(own)) : b + len(own)]
    region = region[region > 0]
    terms, counts = items.terms[item]
    place = np.minimum(np.searchsorted(terms, region), len(terms) - 1)
    same = terms[place] == region
    # the words in common, in any order, are no fewer than those of the subsequence
    if np.minimum(np.bincount(place[same], minlength=len(terms)), counts).sum() < SHARE * len(own):
        return None
    n, answer = common_subsequence(own, region[same], items.answers[item])
    share, answered = n / len(own), answer / items.answers[item]
    return (share, answered) if share >= SHARE and answered >= ANSWER else None


class Search:
    """What tasks need to search documents for the items of one pass."""

    def __init__(self, items: Items, spaces: list[Space]):
        self.items, self.spaces = items, spaces

    def _group(self, texts: list[np.ndarray], first: int) -> Iterator[tuple]:
        best: dict[tuple[int, int], tuple] = {}
        for s in self.spaces:
            for text, part, a, b, cosine in _candidates(texts, s):
                item = s.item[part]
                if shares := confirmed(texts[text], a, b, self.items, item):
                    best[text, item] = max(best.get((text, item), (0.0,)), (*shares, cosine, -a))
        for (t, i), (n, m, c, a) in best.items():
            yield first + t, self.items.keys[i], c, n, m, -a

    def hits(self, texts: list[np.ndarray]) -> Iterator[tuple]:
        """(text, item, cosine, share, answer_share, near_word) of texts as numbers; a group of texts is
        searched at a time."""
        own, weight, runs, first = [], 0, 0, 0
        for i, x in enumerate(texts):
            own.append(x)
            weight += np.count_nonzero(x)
            runs += len(x) // STEP + 4
            if weight >= _GROUP or runs >= _GROUP:
                yield from self._group(own, first)
                own, weight, runs, first = [], 0, 0, i + 1
        if own:
            yield from self._group(own, first)


def _searches(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str) -> Iterator[tuple[Search, DataFrame]]:
    """For each pass the fitted search and the numbered documents."""
    short_batches(docs.sparkSession)
    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("item_id is not null and text is not null")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([sum(passages_of(len(words(t))) for t in batch.column("text").to_pylist())], pa.int64())], names=["n"])

    n = items.select("text").mapInArrow(passages, "n long").agg(F.sum("n")).first()[0] or 0
    passes = max(1, -(-n // (ITEMS * BLOCKS)))
    for p in range(passes):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).orderBy("item_id", "text").collect()  # ITEMS * BLOCKS passages, about
        benchmark_items = Items([(r["item_id"], r["text"]) for r in own])
        if not benchmark_items.ids:
            continue
        numbered = written(_numbers(docs, benchmark_items, key, text), "numbers")
        df, count = _frequencies(numbered, len(benchmark_items.vocabulary) + 1)
        benchmark_items.weigh(df, count)
        spaces = benchmark_items.blocks()
        for space in spaces:
            space.project(latent_basis(numbered, count, space))
        yield Search(benchmark_items, spaces), numbered


def contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The hits: doc_id, item_id, cosine, share (of the item's words in the common subsequence),
    answer_share and near_word (start of the window), a row for each document and item.

    Documents and items with null or empty texts have no hits; a null doc_id is reported as such;
    repeated rows are reported each; items with a null id are left out, and of several items with one
    id each counts. Empty tables give no rows; other columns are ignored, whatever their names.
    """
    schema = "doc_id long, item_id long, cosine double, share double, answer_share double, near_word long"
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
    out = None
    for search, numbered in _searches(docs, benchmark, key, text, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(search)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "ids"):
                keys = batch.column("doc_id").to_pylist()
                rows = [(keys[t], *rest) for t, *rest in shared.value.hits([np.frombuffer(x, np.int32) for x in batch.column("ids").to_pylist()])]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "cosine", "share", "answer_share", "near_word"])

        hits = numbered.mapInArrow(run, schema)
        out = hits if out is None else out.unionByName(hits)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def kept(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that hold a benchmark passage. Rows are judged one by one
    where they are read; nothing is joined back, so null and repeated keys do not matter."""
    out = docs
    for search, _ in _searches(docs, benchmark, key, text, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(search)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = shared.value
            for batch in sliced(batches, text):
                texts = _as_numbers(batch.column(text).to_pylist(), search.items.vocabulary)
                bad = {t for t, *_ in search.hits(texts)}
                yield batch.filter(pa.array([i not in bad for i in range(len(texts))], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
