"""Token ids as flat binary files that are memory-mapped.

Format of part P, three little-endian files:

- ``P.ids``      token ids, uint16 where the vocabulary has at most 65,536 ids, else uint32;
- ``P.offsets``  int64, one more than documents: where each document starts in ``P.ids``;
- ``P.docs``     int64 doc_id of each document, ascending over the parts; the first
                 ``null_docs`` of a part have no doc_id (stored as 0).

The manifest (a Parquet table beside them) has a row for each part with its number of documents,
tokens and null ids, and its ``base``: the tokens of all parts before it, a prefix sum. A token's
global position is ``base`` plus its place in the part.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chainproof.llm.common import give_back, short_batches, sliced
from chainproof.llm.tokens import encoder, forget_pieces

MANIFEST = "part int, n_docs long, n_tokens long, null_docs long, width int"


def _store(path: str):
    """(filesystem, path) of a folder all executors share; local or any store pyarrow opens."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _writer(path: str, vocabulary: str, key: str, text: str):
    """Writes one part for each partition, and yields its manifest row. A part is written under a
    name of its attempt and then renamed, so a task that runs twice leaves one whole part."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        where, folder = _store(path)
        enc = encoder(vocabulary)
        kind = np.dtype("<u2") if enc.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        names = {x: (f"{folder}/{part:06d}.{x}.{attempt}", f"{folder}/{part:06d}.{x}") for x in ("ids", "offsets", "docs")}
        out: dict = {}
        n_docs = n_tokens = nulls = 0
        for batch in sliced(batches, text):
            keys, texts = batch.column(key), batch.column(text).to_pylist()
            if not out:
                where.create_dir(folder, recursive=True)
                out = {x: where.open_output_stream(n[0]) for x, n in names.items()}
                out["offsets"].write(np.zeros(1, "<i8").tobytes())
            nulls += keys.null_count
            out["docs"].write(np.asarray(keys.cast(pa.int64()).fill_null(0)).astype("<i8").tobytes())
            ids = enc.encode(texts)
            ends = n_tokens + np.cumsum([len(x) for x in ids])
            out["offsets"].write(ends.astype("<i8").tobytes())
            for x in ids:
                out["ids"].write(x.astype(kind).tobytes())
            n_tokens = int(ends[-1])
            n_docs += batch.num_rows
        del enc
        forget_pieces()
        give_back()
        if out:
            for x, (own, final) in names.items():
                out[x].close()
                where.move(own, final)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens], "null_docs": [nulls], "width": pa.array([kind.itemsize], pa.int32())})

    return write


def write_token_files(docs: DataFrame, path: str, *, vocabulary: str = "word_bpe_49k.json", key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encodes every whole text in ascending ``key`` order into token files under ``path`` (a
    folder that all executors share), and returns the manifest with ``base``.

    Null texts count as empty and have the end id alone; rows with a null key come first; rows
    with the same key are all written, in order of a hash of their texts, which also deals a key that
    very many rows share out over several parts. An empty table gives an empty manifest. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    short_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "key", "h").sortWithinPartitions("key", "h").drop("h")
    ordered.mapInArrow(_writer(path, vocabulary, "key", "text"), MANIFEST).write.parquet(f"{path}/manifest")
    parts = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each part
    manifest = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    manifest.write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


class Mapped:
    """A file as an array that is read where it is sliced: memory-mapped where the store is a local
    folder, else by ranges of bytes."""

    def __init__(self, where, name: str, kind: str):
        from pyarrow import fs

        self.kind, self.file, self.array = np.dtype(kind), None, None
        if isinstance(where, fs.LocalFileSystem):
            self.array = np.memmap(name, dtype=kind, mode="r") if os.path.getsize(name) else np.zeros(0, kind)
        else:
            self.file = where.open_input_file(name)

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.file is None:
            return np.asarray(self.array[at])
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at(int(at.stop - at.start) * size, int(at.start) * size), self.kind)


def read_token_files(manifest: DataFrame, path: str, digests_only: bool = False) -> DataFrame:
    """Each document as the files under ``path`` have it: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of the ids as little-endian uint32) and, unless
    ``digests_only``, ids (array of long)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digests_only else ", ids array<long>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = _store(path)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{folder}/{row['part']:06d}"
                ids, offsets, keys = (Mapped(where, f"{name}.{x}", k) for x, k in (("ids", f"<u{row['width']}"), ("offsets", "<i8"), ("docs", "<i8")))
                for a in range(0, row["n_docs"], 2_000):
                    b = min(a + 2_000, row["n_docs"])
                    ends = offsets[a : b + 1].astype(np.int64)
                    each = [ids[x:y] for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                    columns = [
                        pa.array(keys[a:b], pa.int64(), mask=np.arange(a, b) < row["null_docs"]),
                        pa.array(row["base"] + ends[:-1], pa.int64()),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if not digests_only:
                        columns.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(n, "part").mapInArrow(read, schema)
