"""Near-duplicate detection by 64-bit SimHash and the generalised pigeonhole principle.

A fingerprint bit is the majority of that bit over the hashes of a text's word shingles. Fingerprints
that differ in at most ``BITS`` = 2 bits are linked, and a text's component is what links reach.

The search works on distinct fingerprints, so copies cost nothing. The 64 bits are put into four
groups of 16, correlated bits together, and a partition is one group (four partitions) or two
(two partitions). Whatever thresholds t of sum ``BITS + 1 - partitions``, each -1 or more, a
fingerprint gives to the partitions, any other within ``BITS`` of it is within t of it on one
of them: fewer differing bits on all would add up to more than ``BITS``. So each fingerprint may have
thresholds of its own, which dynamic programming chooses by the candidates that the counts of values of
the groups let expect: exact for one group, the product of the shares of two. A partition of common
values then gets -1 and is not probed at all. All fingerprints are in the index of every partition;
each probes the values within t of its own, and whatever it meets there is verified on all bits.
Which of the two layouts is used follows from the same estimates over all fingerprints.

A key that more than ``CROWD`` fingerprints have is not joined. Those who have or probe it are linked
over midpoints: two fingerprints are within two bits of each other if and only if they are both within
one bit of some third, so each gives 65 keys, and all that share one are linked to the smallest. The
cost of a crowd is so in proportion to its size and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainproof.llm.common import give_back, sliced, written
from chainproof.llm.components import connected_components

#: Differing bits of linked fingerprints at most.
BITS = 2
#: Groups of bits, and how many bits each has; their values are counted one by one.
GROUPS, WIDTH = 4, 16
#: Fingerprints of a key that are joined at most; of larger keys, over midpoints.
CROWD = 1024
#: What making and shuffling one probe costs, in comparisons of candidates.
PROBE = 16
#: Bytes of a text whose words are held at once, about.
PIECE = 1 << 20

_BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)
_SPACE = b" \t\n\x0b\x0c\r"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of the text in runs of bounded size."""
    at, n = 0, len(text)
    while n - at > 2 * PIECE:
        end = min((i for i in (text.find(s, at + PIECE) for s in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) if i >= 0), default=n)
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    digest, width = xxhash.xxh64_intdigest, min(size, len(words))
    n = len(words) - width + 1
    ends = starts[width - 1 :] + lengths[width - 1 :]
    return np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)], np.uint64, n)


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """The fingerprint of a text: A-Z are lower-cased, words are split at ASCII white space, shingles are
    ``size`` words joined by blanks, repeats included, or all words where there are fewer; a bit is 1
    if it is set in over half of their XXH64 hashes (seed 42). Without words it is zero."""
    counts, n, last = np.zeros((8, 8), np.int64), 0, []
    for words in _pieces((text or b"").lower()):
        words = last + words
        last = words if len(words) < size else words[len(words) - size + 1 :]
        if len(words) >= size:
            own = _hashes(words, size)
            n += len(own)
            for k, column in enumerate(np.ascontiguousarray(own.astype("<u8").view(np.uint8).reshape(-1, 8).T)):
                counts[k] += np.bincount(column, minlength=256) @ _BIT_OF
    if not n and last:
        return xxhash.xxh64_intdigest(b" ".join(last), 42)
    return int(np.packbits(2 * counts.ravel() > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint (fp, 64 bits as a long) of each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])
        give_back()

    of = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return of.mapInArrow(make, "doc_id long, fp long")


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("fp")).view(np.uint64)


def bits_together(fps: DataFrame) -> np.ndarray:
    """(64, 64): in how many of the distinct ``fps`` (fp) each two bits are both set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 15):
                part = _numbers(batch.slice(at, 1 << 15))
                bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel().astype(np.int64))], names=["cell", "n"])

    rows = fps.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4096 at most
    out = np.zeros(4096)
    for cell, n in rows:
        out[cell] = n
    return out.reshape(64, 64)


def correlated_groups(together: np.ndarray, n: int) -> list[list[int]]:
    """The bits in ``GROUPS`` groups of ``WIDTH``: each starts with the two most correlated bits that
    are left and takes the one most correlated with its members, until it is full. Groups 0 and 1, and 2
    and 3, are the pairing whose two halves are the most correlated."""
    share = together / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.clip(p * (1 - p), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.nan_to_num(np.abs(share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(r, 0)
    left, groups = list(range(64)), []
    while left:
        own = list(max(combinations(left, 2), key=lambda x: (r[x], -x[0], -x[1])))
        while len(own) < WIDTH:
            own.append(max((b for b in left if b not in own), key=lambda b: (r[b, own].sum(), -b)))
        groups.append(sorted(own))
        left = [b for b in left if b not in own]
    across = lambda a, b: r[np.ix_(groups[a], groups[b])].sum()
    i = max((1, 2, 3), key=lambda i: across(0, i) + across(*[j for j in (1, 2, 3) if j != i]))
    j, k = (j for j in (1, 2, 3) if j != i)
    return [groups[0], groups[i], groups[j], groups[k]]


def values(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """The number that the given bits of each fingerprint make."""
    out = np.zeros(len(x), np.int64)
    for k, b in enumerate(bits):
        out |= ((x >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def value_counts(fps: DataFrame, groups: list[list[int]]) -> np.ndarray:
    """(GROUPS, 2 ** WIDTH): how many of ``fps`` have each value of each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GROUPS << WIDTH, np.int64)
        for batch in batches:
            x = _numbers(batch)
            for g, bits in enumerate(groups):
                np.add.at(total, values(x, bits) + (g << WIDTH), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    rows = fps.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # GROUPS << WIDTH at most
    out = np.zeros(GROUPS << WIDTH)
    out[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out.reshape(GROUPS, -1)


def _flips(width: int, most: int) -> list[np.ndarray]:
    """By number of flipped bits, 0 to ``most``: the masks that flip so many of ``width`` bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), k)], np.int64) for k in range(most + 1)]


def at_distance(counts: np.ndarray) -> np.ndarray:
    """(BITS + 1, GROUPS, 2 ** WIDTH): how many fingerprints have a value of exactly 0, 1, ... differing bits."""
    here = np.arange(1 << WIDTH)
    return np.stack([sum(counts[:, here ^ f] for f in masks.tolist()) for masks in _flips(WIDTH, BITS)])


class Layout:
    """Partitions of ``per`` groups each, and what thresholds on them let expect."""

    def __init__(self, groups: list[list[int]], near: np.ndarray, n: int, per: int):
        self.bits = [sum(groups[i : i + per], []) for i in range(0, GROUPS, per)]
        self.groups, self.near, self.n, self.per = groups, near, max(n, 1), per
        self.flips = _flips(WIDTH * per, BITS)

    def expected(self, x: np.ndarray) -> np.ndarray:
        """(partitions, BITS + 2, len(x)): what probing costs at thresholds -1, 0, ..."""
        at = np.stack([self.near[:, g, values(x, bits)] for g, bits in enumerate(self.groups)])  # (group, distance, x)
        out = np.zeros((len(self.bits), BITS + 2, len(x)))
        for p in range(len(self.bits)):
            own = at[p * self.per]
            for g in range(p * self.per + 1, (p + 1) * self.per):  # two groups: distances add up, shares multiply
                own = np.stack([sum(own[i] * at[g][k - i] for i in range(k + 1)) for k in range(BITS + 1)]) / self.n
            for t in range(BITS + 1):
                out[p, t + 1] = out[p, t] + own[t] + PROBE * len(self.flips[t])
        return out

    def thresholds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(partitions, len(x)) thresholds of least cost, and the cost. By dynamic programming over
        partitions: ``BITS + 1`` units are dealt out, and a partition of u units has threshold u - 1."""
        cost, units = self.expected(x), BITS + 1
        best = np.full((units + 1, len(x)), np.inf)
        best[0] = 0
        took = []
        for own in cost:
            ways = np.full((units + 1, units + 1, len(x)), np.inf)  # (units in all, units here)
            for total in range(units + 1):
                for here in range(total + 1):
                    ways[total, here] = best[total - here] + own[here]
            took.append(ways.argmin(axis=1))
            best = ways.min(axis=1)
        out, left = np.zeros((len(cost), len(x)), np.int64), np.full(len(x), units)
        for p in range(len(cost) - 1, -1, -1):
            here = took[p][left, np.arange(len(x))]
            out[p], left = here - 1, left - here
        return out, best[units]


def _arrays(pieces: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.ListArray:
    """Lists of keys of ``n`` rows from pieces of (rows, (rows, keys) array)."""
    row = np.concatenate([np.repeat(r, k.shape[1]) for r, k in pieces])
    key = np.concatenate([k.ravel() for _, k in pieces])
    order = np.argsort(row, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[order]))


def index_and_probes(fps: DataFrame, layout: Layout) -> DataFrame:
    """fp, its keys in the index, and the keys that it probes."""
    shared = fps.sparkSession.sparkContext.broadcast(layout)  # counts of a fixed number of values

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = _numbers(batch)
                t, _ = plan.thresholds(x)
                rows, own, probes = np.arange(len(x)), [], []
                for p, bits in enumerate(plan.bits):
                    v = values(x, bits)
                    own.append((rows, (v | p << 32).reshape(-1, 1)))
                    for k, masks in enumerate(plan.flips):
                        on = np.flatnonzero(t[p] >= k)
                        probes.append((on, (v[on].reshape(-1, 1) ^ masks) | p << 32))
                yield pa.RecordBatch.from_arrays([batch.column("fp"), _arrays(own, len(x)), _arrays(probes, len(x))], names=["fp", "own", "probes"])

    return fps.mapInArrow(make, "fp long, own array<long>, probes array<long>")


def chosen_layout(fps: DataFrame, groups: list[list[int]], n: int) -> Layout:
    """The layout of partitions that is expected to cost least over all ``fps``."""
    near = at_distance(value_counts(fps, groups))
    layouts = [Layout(groups, near, n, per) for per in (1, 2)]
    shared = fps.sparkSession.sparkContext.broadcast(layouts)

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0.0] * len(layouts)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                x = _numbers(whole.slice(at, 4096))
                total = [c + float(one.thresholds(x)[1].sum()) for c, one in zip(total, shared.value, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], names=["layout", "cost"])

    sums = dict(map(tuple, fps.mapInArrow(cost, "layout long, cost double").groupBy("layout").agg(F.sum("cost")).collect()))
    return layouts[min(sums, key=sums.get, default=0)]


def _midpoint_links(crowd: DataFrame) -> DataFrame:
    """Links of fingerprints (fp, distinct) within two bits of each other: each to the smallest of those that share a third
    within one bit of both."""
    flipped = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    rows = crowd.select("fp", F.explode(flipped).alias("z"))
    lead = rows.groupBy("z").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("z", "a")
    return rows.join(written(lead, "midpoints"), "z").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, crowd: int = CROWD, layout: Layout | None = None) -> DataFrame:
    """(a, b) of distinct fingerprints (fp): all pairs within ``BITS`` bits, but of those in keys
    of more than ``crowd`` fingerprints, enough of them to connect the same."""
    if layout is None:
        n = fps.agg(F.count(F.lit(1))).first()[0]
        layout = chosen_layout(fps, correlated_groups(bits_together(fps), n), n)
    planned = written(index_and_probes(fps, layout), "planned")
    index = planned.select("fp", F.explode("own").alias("key"))
    probes = planned.select("fp", F.explode("probes").alias("key"))
    full = written(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("key"), "crowds")
    if full.isEmpty():
        more = None
    else:
        there = index.unionByName(probes).join(full, "key", "left_semi").select("fp").distinct()
        more = _midpoint_links(written(there, "crowd"))
        index, probes = index.join(full, "key", "left_anti"), probes.join(full, "key", "left_anti")
    x, y = index.select("key", F.col("fp").alias("a")), probes.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    # both sides grow with the corpus: never a broadcast
    met = x.hint("merge").join(y, (x["key"] == y["key"]) & (F.col("a") != F.col("b")) & near)
    found = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return found.unionByName(more) if more is not None else found


def as_hex(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """A row for each row of ``docs``: doc_id, fingerprint (16 lowercase hex digits), component_id (the
    smallest doc_id that links of fingerprints at ``BITS`` or fewer differing bits reach).

    Null and empty texts and those without words have fingerprint zero and are linked as any. Rows that
    share a key are rows of their own; those with a null key are linked as any and have the smallest
    key of their component, null where there is none. Texts of any length are read whole, a piece at a time. An empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    signed = written(fingerprints(docs, key, text), "fingerprints")
    classes = written(signed.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "classes")
    found = written(links(classes.select("fp"), crowd), "links")
    components = connected_components(found).toDF("fp", "component")
    placed = written(classes.join(components, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "placed")
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = written(placed.select("fp", "component").join(smallest, "component").select("fp", "component_id"), "named")
    return signed.join(named, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
