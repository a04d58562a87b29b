"""Tables in buckets of their key's hash, that a batch changes by writing only the buckets it touches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainproof.sources.io import first_per_key
from chainproof.sources.work import written

#: Versions name the folders of each bucket, and are read by the driver: so many buckets at most.
MOST_BUCKETS = 4096


class BucketedTable:
    """IO-7, IO-8, ST-2, ST-3 as a table at ``path`` with one row for each key.

    Rows are Parquet files in folders of one bucket. A version is a JSON file that names the folders of each
    bucket; it is written under another name and then renamed, so a reader sees a whole version, and a batch that
    fails half-way leaves the version before. Two writers that meet get an error, where the store's rename
    does not replace files; elsewhere let one write at a time.

    A batch with a ``writer`` and number is taken once: a repeated one, as streams send after a failure, changes nothing.
    ``upsert`` writes the buckets of its keys anew. ``insert`` adds files to the buckets of keys that are
    missing, and writes a bucket anew when it has ``most_folders``. Both read no other bucket.

    A null in a key is a value like any other. Of rows with one key and equal ``order``, any counts. Columns of
    a batch that the table lacks are left out; an empty batch changes no bucket.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        state = self._state()
        self.schema = T.StructType.fromJson(state["schema"])
        self.keys, self.buckets, self.parts, self.most_folders = state["keys"], state["buckets"], state["parts"], state["most_folders"]
        self._bucket = "_bucket"
        while self._bucket in {n.lower() for n in self.schema.names}:
            self._bucket += "_"

    @staticmethod
    def create(spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], buckets: int = 256, parts: int = 1, most_folders: int = 8) -> BucketedTable:
        """An empty table. A bucket written anew is ``parts`` files, so that buckets of any size are many tasks."""
        if not 1 <= buckets <= MOST_BUCKETS:
            raise ValueError(f"a table has 1 to {MOST_BUCKETS} buckets")
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        table = BucketedTable.__new__(BucketedTable)
        table.spark, table.path, table._hadoop = spark, path.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        table._fs = table._hadoop(table.path).getFileSystem(spark._jsc.hadoopConfiguration())
        table._publish({"version": 0, "schema": json.loads(schema.json()), "keys": keys, "buckets": buckets, "parts": parts, "most_folders": most_folders, "folders": {}, "writers": {}})
        return BucketedTable(spark, path)

    @property
    def version(self) -> int:
        return self._state()["version"]

    def folders(self) -> dict[int, list[str]]:
        """The folders of each bucket that has rows, in the order they were written."""
        return {int(k): v for k, v in self._state()["folders"].items()}

    def taken(self, writer: str, batch: int) -> bool:
        """Whether this batch, or a later one, of the writer is in the table."""
        return self._state()["writers"].get(writer, -1) >= batch

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets."""
        return self._rows(self._state(), buckets)

    def upsert(self, new: DataFrame, order: list, *, writer: str | None = None, batch: int = 0) -> bool:
        """IO-8: the first row of each key by ``order`` replaces the table's; False for a batch that was taken before."""
        state = self._state()
        if writer is not None and state["writers"].get(writer, -1) >= batch:
            return False
        fresh = written(self._keyed(first_per_key(new, self.keys, order)), "batch")
        touched = self._touched(fresh)
        old = self._keyed(self._rows(state, touched))
        both = fresh.withColumn("_old", F.lit(False)).unionByName(old.withColumn("_old", F.lit(True)))
        self._commit(state, both, len(touched), set(touched), writer, batch)
        return True

    def insert(self, new: DataFrame, order: list, *, fill: Callable[[DataFrame], DataFrame] | None = None, writer: str | None = None, batch: int = 0) -> bool:
        """IO-7: adds the first row by ``order`` of each key that the table lacks; False for a batch that was taken before.

        ``fill`` makes the table's rows of those (all columns of ``new``), so that what is costly is done for
        missing keys only, and once."""
        state = self._state()
        if writer is not None and state["writers"].get(writer, -1) >= batch:
            return False
        rows = written(first_per_key(new, self.keys, order).withColumn(self._bucket, self._hash()), "batch")
        touched = self._touched(rows)
        known = self._rows(state, touched).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)])
        same = [rows[k].eqNullSafe(known[f"_k{i}"]) for i, k in enumerate(self.keys)]
        fresh = written(rows.join(known, same, "left_anti"), "fresh")
        hit = self._touched(fresh)
        anew = {k for k in hit if len(state["folders"].get(str(k), [])) >= self.most_folders}
        made = self._keyed(fill(fresh.drop(self._bucket)) if fill else fresh)
        both = made.withColumn("_old", F.lit(True)).unionByName(self._keyed(self._rows(state, sorted(anew))).withColumn("_old", F.lit(False)))
        self._commit(state, both, len(hit), anew, writer, batch)
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the last ``keep`` versions and the folders that only those or failed batches had; gives how many
        folders went. No writer may be at work, and no reader on an older version."""
        for v in self._versions()[:-keep]:
            self._fs.delete(self._hadoop(self._file(v)), False)
        used = {f for v in self._versions() for fs in self._state(v)["folders"].values() for f in fs}
        gone = 0
        for commit in self._names(f"{self.path}/data"):
            own = [x for x in self._names(f"{self.path}/data/{commit}") if "=" in x]
            idle = [x for x in own if f"{commit}/{x}" not in used]
            for x in [""] if len(idle) == len(own) else idle:
                self._fs.delete(self._hadoop(f"{self.path}/data/{commit}/{x}".rstrip("/")), True)
            gone += len(idle)
        return gone

    def _hash(self):
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).withColumn(self._bucket, self._hash())

    def _touched(self, df: DataFrame) -> list[int]:
        return sorted(r[0] for r in df.select(self._bucket).distinct().collect())

    def _rows(self, state: dict, buckets: list[int] | None) -> DataFrame:
        wanted = state["folders"] if buckets is None else [str(b) for b in buckets]
        paths = [f"{self.path}/data/{f}" for b in wanted for f in state["folders"].get(b, [])]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _commit(self, state: dict, rows: DataFrame, n: int, anew: set[int], writer: str | None, batch: int) -> None:
        """Writes ``rows`` (one of each key: those that are not ``_old`` go first) and the version that has them: buckets in ``anew`` have
        them alone, others besides what they had."""
        folders = dict(state["folders"])
        if n:
            commit = uuid.uuid4().hex
            dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)))
            dealt = first_per_key(dealt.repartition(n * self.parts, self._bucket, "_part"), [self._bucket, "_part", *self.keys], ["_old"])
            dealt.drop("_old", "_part").write.partitionBy(self._bucket).parquet(f"{self.path}/data/{commit}")
            for name in self._names(f"{self.path}/data/{commit}"):
                if "=" in name:
                    k = name.partition("=")[2]
                    folders[k] = ([] if int(k) in anew else folders.get(k, [])) + [f"{commit}/{name}"]
        elif writer is None:
            return
        writers = state["writers"] | ({writer: batch} if writer is not None else {})
        self._publish(state | {"version": state["version"] + 1, "folders": folders, "writers": writers})

    def _publish(self, state: dict) -> None:
        to = self._hadoop(self._file(state["version"]))
        draft = self._hadoop(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(state).encode())
        out.close()
        self._fs.mkdirs(to.getParent())
        if self._fs.exists(to) or not self._fs.rename(draft, to):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {state['version']} of {self.path} exists: another writer was faster")

    def _file(self, version: int) -> str:
        return f"{self.path}/versions/{version:010d}.json"

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _versions(self) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self._names(f"{self.path}/versions") if x.endswith(".json")]

    def _state(self, version: int | None = None) -> dict:
        found = self._versions() if version is None else [version]
        if not found:
            raise FileNotFoundError(f"no table at {self.path}")
        return json.loads(self.spark.read.text(self._file(found[-1]), wholetext=True).first()[0])
