"""Best-fit decreasing packing of whole documents into sequences, over all data at once.

Lengths are whole numbers from 1 to the capacity, so the packing needs the *number* of pieces of
each length only: at most ``capacity`` counts, however large the corpus. ``plan`` runs best-fit
decreasing on them. A segment tree over the remaining capacities 0 to ``capacity`` says which are
open; the tightest that fits is found in logarithmic time. Equal pieces that go to equally full
sequences are placed in one step, in runs: after the run's pieces ``a`` to ``b`` of their length
are known to be in sequences ``s`` to ``s + b - a`` at one offset. The result is the one that
taking the pieces one by one gives, up to the numbering of equally full sequences.

Spark cuts and counts the pieces, ranks those of one length (in hashed buckets, so that no length
is one task), and looks each rank up in the plan's runs, whose number the capacity bounds.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chainproof.llm.common import give_back, short_batches, sliced, written
from chainproof.llm.tokens import encoder, forget_pieces


class OpenBins:
    """Segment tree over remaining capacities: how many sequences are open at each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        at = self.size + remaining
        while at:
            self.tree[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of ``need`` or more with an open sequence."""
        at = self.size + need
        if self.tree[at]:
            return need
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """For each length its runs (rank of the first piece, first sequence, offset), ranks from 0
    ascending and each run up to the next one's rank; and the number of sequences."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    tree, pools, used = OpenBins(capacity), {}, 0
    for length in sorted(counts, reverse=True):
        left, rank, out = counts[length], 0, []
        while left:
            room = tree.tightest(length)
            if room is None:  # no open sequence fits: open as many as a full one's share of pieces needs
                new = -(-left // (capacity // length))
                pools.setdefault(capacity, deque()).append((used, new))
                tree.add(capacity, new)
                used += new
                continue
            pool = pools[room]
            first, n = pool.popleft()
            # best fit fills the sequence that has just got a piece again while it still fits
            times = min(room // length, left)
            take = min(n, left // times)
            for k in range(times):
                out.append((rank, first, capacity - room + k * length))
                rank += take
            left -= times * take
            tree.add(room, -take)
            after = room - times * length
            if after:
                pools.setdefault(after, deque()).append((first, take))
                tree.add(after, take)
            if take < n:
                pool.appendleft((first + take, n - take))
        runs[length] = out
    return runs, used


def pieces(docs: DataFrame, *, capacity: int = 4096, vocabulary: str = "word_bpe_49k.json", key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's token ids, with the end id, cut into pieces of ``capacity`` where longer:
    doc_id, piece, start, length, ids_crc32, tie (a hash of the whole document) and, if
    ``with_ids``, ids (binary, little-endian uint32)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, tie long" + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "tie", "ids"]
        for batch in sliced(batches, "text"):
            rows = []
            for doc, ids in zip(batch.column("key").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                whole = ids.tobytes()
                tie = zlib.crc32(whole) if len(ids) > capacity else None  # a single piece's own
                for i in range(0, len(ids), capacity):
                    part = whole[4 * i : 4 * (i + capacity)]
                    crc = zlib.crc32(part)
                    rows.append((doc, i // capacity, i, len(part) // 4, crc, crc if tie is None else tie) + ((part,) if with_ids else ()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[: len(columns)])
        del enc
        forget_pieces()
        give_back()

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(cut, schema)


def assign(cut: DataFrame, *, capacity: int = 4096, buckets: int = 256) -> DataFrame:
    """``cut`` (rows with doc_id, piece, length, tie, any others, and no column that begins with
    ``_``) with sequence_id (long) and offset (long): best-fit decreasing over all rows.

    ``cut`` is read twice, so hand in a written table. Lengths are 1 to ``capacity``.
    """
    spark = cut.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "tie"), F.lit(buckets)).cast("int")
    counts = written(cut.groupBy("length", bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(totals, capacity)

    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    rows = cut.withColumn("_bucket", bucket)
    rows = rows.withColumn("_in", F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "tie")) - 1)
    ranked = rows.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_in")).drop("_before", "_in", "_bucket")

    # the runs in flat arrays; the capacity bounds their number
    lengths = sorted(runs)
    starts = np.cumsum([0, *(len(runs[x]) for x in lengths)])
    flat = np.array([r for x in lengths for r in runs[x]], dtype=np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast((np.array(lengths), starts, flat))
    out = [*cut.dtypes, ("sequence_id", "bigint"), ("offset", "bigint")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, starts, flat = shared.value
        for batch in batches:
            at = np.searchsorted(lengths, np.asarray(batch.column("length")))
            rank = np.asarray(batch.column("_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(at):
                own = np.flatnonzero(at == x)
                table = flat[starts[x] : starts[x + 1]]
                run = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                sequence[own], offset[own] = run[:, 1] + rank[own] - run[:, 0], run[:, 2]
            columns = [batch.column(n) for n, _ in out[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[n for n, _ in out])

    return ranked.select(*cut.columns, "_rank").mapInArrow(place, ", ".join(f"`{n}` {t}" for n, t in out))


def pack(docs: DataFrame, *, capacity: int = 4096, vocabulary: str = "word_bpe_49k.json", key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset and, if ``with_ids``, ids. The texts are encoded once; what the packing
    reads is a written table of narrow rows.

    Null texts are packed as one end id; null and repeated keys are packed row by row, and equal
    rows in any order among themselves; an empty table gives no rows; other columns are ignored.
    """
    cut = written(pieces(docs, capacity=capacity, vocabulary=vocabulary, key=key, text=text, with_ids=with_ids), "pieces")
    return assign(cut, capacity=capacity).drop("tie")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences of ``pack(..., with_ids=True)``: sequence_id, ids (binary, uint32)
    and the (doc_id, piece, offset, length) spans in order. A sequence is of bounded size."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("p"))
    ids = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return rows.select("sequence_id", ids.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("spans"))
