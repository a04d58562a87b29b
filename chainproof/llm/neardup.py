"""Near-duplicate detection by min-max hashing.

Each of ``PERMUTATIONS`` permutations of the 64-bit shingle hashes is evaluated once and gives two
signature values, the minimum and the maximum over the document's set; both agree between two
sets with probability of their Jaccard similarity. Bands of four values (both values of two
permutations) are bucket keys. Minimum and maximum of one permutation agree together with probability
I (I - 1) / (U (U - 1)), so of sets of 17 shingles or more a pair of similarity 0.75 misses all 32
bands with probability below 1e-5. Sets of up to ``EXACT`` shingles, for which that is more, and all
that can be similar to them, have further keys: their first shingles in one order of all, of which two
similar sets share one for certain.

Links are confirmed on the full shingle sets. Documents of one set are one class and never paired.
A bucket is first settled against its smallest member only. The classes of buckets that still
hold more than one component are then joined exactly: their shingles are put into one order of
rising frequency, and two of them can only be similar if they share one early enough in both orders
that as many follow it as a link needs (prefix and positional filter), and are of like size. Of each
such shingle, the classes outside its largest component are joined with all others of other
components, in a grid of blocks of at most about ``BLOCK`` rows on either side, so that no shingle is
one task. So every pair that shares a bucket is linked, is in one component, cannot be linked, or has
been compared, and a group of copies costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chainproof.llm.common import give_back, mixed, numbered_rows, short_batches, sliced, written
from chainproof.llm.components import connected_components

PERMUTATIONS, BANDS = 64, 32
#: Sets of so many shingles at most get the further keys that miss none.
EXACT = 16
#: Classes of one shingle on either side of a block of comparisons, about.
BLOCK = 1024
#: Shared shingles before one that are looked at to tell whether a pair has met before.
EARLIER = 32
#: Words whose hashes a worker keeps; beyond it the memory starts anew.
MEMORY = 50_000

_rng = np.random.default_rng(20_240_229)
_MULTIPLY = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_words = _Words()


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles. A-Z are lower-cased, words are
    split at ASCII white space; a text of fewer words is one shingle, one without words none."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    width = min(n, size)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total += h[k : n - width + 1 + k] * _PLACE[k]
    return np.unique(mixed(total))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) int64 bucket keys of non-empty sets."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    per = PERMUTATIONS // BANDS
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for k in range(per):
            y = x * _MULTIPLY[band * per + k] + _ADD[band * per + k]
            key = mixed(key * _PLACE[5] + np.minimum.reduceat(y, starts))
            key = mixed(key * _PLACE[6] + np.maximum.reduceat(y, starts))
        out[:, band] = key
    return out.view(np.int64)


def _runs(sets: list[np.ndarray], most: int = 100_000) -> Iterator[list[int]]:
    run, total = [], 0
    for i, s in enumerate(sets):
        if len(s):
            run.append(i)
            total += len(s)
            if total >= most:
                yield run
                run, total = [], 0
    if run:
        yield run


def first_shingles(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The further bucket keys of a small set (sorted): a similar one shares at least one of them."""
    n = len(shingles)
    if not n or n > EXACT * 100 // percent:
        return np.zeros(0, np.int64)
    return mixed(shingles[: n - -(-percent * n // 100) + 1] * _PLACE[7]).view(np.int64)


def signatures(rows: DataFrame, row: str, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """row, doc_id, n_shingles, a 128-bit hash of the set (s1, s2) and its bucket keys; the last three
    null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            if len(_words) > MEMORY:
                _words.clear()
            keys: list = [None] * len(sets)
            for run in _runs(sets):
                for i, bands in zip(run, band_keys([sets[i] for i in run]), strict=True):
                    keys[i] = np.concatenate([bands, first_shingles(sets[i], percent)])
            whole = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([w[0] for w in whole], pa.int64()), pa.array([w[1] for w in whole], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["row", "doc_id", "n_shingles", "s1", "s2", "keys"],
            )
        _words.clear()
        give_back()

    of = rows.select(F.col(row).alias("row"), F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return of.mapInArrow(sign, "row long, doc_id long, n_shingles long, s1 long, s2 long, keys array<long>")


def _sets(rows: DataFrame, row: str, text: str, chosen: DataFrame) -> DataFrame:
    """(id, shingles) of the classes in ``chosen`` (id, row), from the whole text of that row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = [shingle_set(t).view(np.int64) for t in batch.column("text").to_pylist()]
            if len(_words) > MEMORY:
                _words.clear()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])
        _words.clear()
        give_back()

    texts = rows.select(F.col(row).alias("row"), F.col(f"`{text}`").cast("binary").alias("text"))
    # the rows grow with the corpus, so the join is the same at every size: never a broadcast
    return texts.join(chosen.hint("merge"), "row").select("id", "text").mapInArrow(make, "id long, shingles array<long>")


def _early_shingles(sets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """(key, id, n, i, component): the shingles (key) that documents of ``placed`` share with others
    of it and that stand, at place i in the order of rising frequency, before the last with which a
    link is possible."""
    ids = written(placed.select("id", "n", "component").distinct(), "documents")
    tokens = sets.join(ids.select("id"), "id", "left_semi").select("id", F.explode("shingles").alias("key"))
    counts = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id"))
    own = counts.where("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))  # these come first, and no other has them
    rows = tokens.join(written(counts.where("c > 1").select("key", "c"), "counts"), "key")
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("c", "key")) - 1)
    rows = rows.join(ids, "id").join(own, "id", "left").withColumn("i", F.col("r") + F.coalesce("own", F.lit(0)))
    return rows.where(100 * (F.col("n") - F.col("i")) >= percent * F.col("n")).select("key", "id", "n", "i", "component")


def _mixed_buckets(placed: DataFrame) -> DataFrame:
    """The rows of buckets (key) that hold more than one component."""
    several = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    return placed.join(written(several, "mixed"), "key", "left_semi")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets have 100 * intersection >= percent * union."""
    of = lambda end: sets.select(F.col("id").alias(end), F.col("shingles").alias(f"set_{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b").distinct()


def _further_pairs(early: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that ``early`` (key, id, n, i, component) leaves possible: of
    each key, those outside the largest component with all others. A pair is made at the first shingle that it shares: not where
    one of the ``EARLIER`` before is shared too (further back, it may be made again)."""
    early = early.withColumn("earlier", F.collect_list("key").over(W.partitionBy("id").orderBy("i").rowsBetween(-EARLIER, -1)))
    sizes = early.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(
        F.max(F.struct("c", "component")).alias("l"), F.sum("c").alias("m"))
    grid = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sizes = written(sizes.select("key", F.col("l.component").alias("largest"), grid(F.col("m")).alias("across"), grid(F.col("m") - F.col("l.c")).alias("down")), "sizes")
    # sets of one band or of neighbouring bands alone can be similar
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    rows = early.join(sizes, "key").withColumn("band", band)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = rows.where("component <> largest").withColumn("x", every("across")).withColumn("y", deal("down")).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    one = one.select("key", "band", "x", "y", F.col("id").alias("o"), F.col("n").alias("o_n"), F.col("i").alias("o_i"), F.col("component").alias("o_component"), F.col("earlier").alias("o_earlier"))
    two = rows.where("down > 0").withColumn("y", every("down")).withColumn("x", deal("across")).select("key", "band", "x", "y", "id", "n", "i", "component", "largest", "earlier")
    most = F.least(F.col("n") - F.col("i"), F.col("o_n") - F.col("o_i"))  # from here on in both orders
    once = (F.col("component") == F.col("largest")) | (F.col("o") < F.col("id"))  # of two outside the largest, the smaller first
    able = 100 * most >= percent * (F.col("n") + F.col("o_n") - most)
    new = ~F.arrays_overlap("earlier", "o_earlier")
    met = one.join(two, ["key", "band", "x", "y"]).where((F.col("component") != F.col("o_component")) & once & able & new)
    return met.select(F.least("o", "id").alias("a"), F.greatest("o", "id").alias("b")).distinct()


def _grouped(rows: DataFrame, row: str, key: str, text: str, percent: int) -> DataFrame:
    """row, doc_id, n_shingles, component (a number; null for empty sets) and component_id (its smallest
    doc_id) of each row."""
    short_batches(rows.sparkSession)
    signed = written(signatures(rows, row, key, text, percent), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbers that are written with the classes

    keyed = classes.select("id", "n", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.min_by("n", "id").alias("lead_n"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    members = written(keyed.join(written(buckets, "buckets"), "key"), "members")
    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  else the sizes alone rule it out
    # the full sets of all that share a bucket: the only time that texts are shuffled
    sets = written(_sets(rows, row, text, classes.select("id", "row").join(members.select("id").distinct(), "id", "left_semi")), "sets")
    star = members.where("id <> lead").where(near(F.col("n"), F.col("lead_n"))).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = written(confirmed(written(star, "pairs"), sets, percent), "links")
    components = written(connected_components(links), "components")

    # buckets that still hold more than one component
    placed = members.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = written(_mixed_buckets(placed), "placed")
    early = written(_mixed_buckets(written(_early_shingles(sets, placed, percent), "early")), "early")
    more = written(confirmed(written(_further_pairs(early, percent), "pairs"), sets, percent), "links")
    if not more.isEmpty():
        components = written(connected_components(links.unionByName(more)), "components")

    of_class = written(classes.select("s1", "s2", "id", "doc_id").join(components, "id", "left").withColumn("component", F.coalesce("component", "id")), "of_class")
    smallest = written(of_class.groupBy("component").agg(F.min("doc_id").alias("component_id")), "smallest")
    named = of_class.select("s1", "s2", "component").join(smallest, "component")
    return signed.select("row", "doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left").drop("s1", "s2")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that
    confirmed links reach), kept (doc_id = component_id).

    Null and empty texts and those without words are linked with nothing. Rows that share a key are
    documents each, in the component of their own text. Rows with a null key are linked as any; they
    are kept only where no document of their component has a key, and component_id is null there. An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows, row = numbered_rows(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    out = _grouped(rows, row, "doc_id", "text", percent)
    out = out.withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def representatives(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """``docs``, all columns, with exactly one row of each component, that of the smallest key, null
    keys last, and of rows that share it any one; and with all rows of empty sets. Rows are told
    apart by a number of their own, so null and repeated keys do not matter."""
    rows, row = numbered_rows(docs)
    found = _grouped(rows, row, key, text, percent).where("component is not null").select("row", "doc_id", "component")
    found = written(found, "found")
    stays = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m")).select("m.row")
    goes = written(found.select("row").join(stays, "row", "left_anti"), "goes").select(F.col("row").alias(row))
    return rows.join(goes, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
