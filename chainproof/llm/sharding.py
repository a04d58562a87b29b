"""Sharding by proportional stratified interleaving, DataFrame functions only.

Rows are shuffled with a seed inside each stratum (source) and ranked there; the fractional rank
``(2 * rank - 1) / (2 * stratum rows)`` orders all rows of all strata together, and the order is
cut into shards of equal row counts. Any cut holds every stratum in proportion, within a row.

Neither ranking is a window over a whole stratum or a whole table. Each is made of a window over
a small bucket plus the number of rows in the buckets before it, so a stratum that holds most of
the rows is dealt over ``buckets`` tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _ranked(df: DataFrame, group: list[str], bucket: str, order: list, rank: str, total: str) -> DataFrame:
    """``rank`` (from 0) of each row inside ``group`` by (``bucket``, ``order``), and the group's
    ``total`` rows. The windows run over (group, bucket); only counts meet per group."""
    keys = [*group, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    within = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    counts = counts.withColumns({
        "_before": F.sum("_n").over(within.orderBy(bucket)) - F.col("_n"),
        total: F.sum("_n").over(within),
    }).drop("_n")
    rows = df.withColumn("_in", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    same = [rows[k].eqNullSafe(counts[k]) for k in keys]
    joined = rows.join(counts, same, "inner")
    for k in keys:
        joined = joined.drop(counts[k])
    return joined.withColumn(rank, F.col("_before") + F.col("_in")).drop("_before", "_in")


def interleave(docs: DataFrame, n_shards: int = 8, *, key: str = "doc_id", stratum: str = "source", seed: int = 17, buckets: int = 512, slices: int = 4096) -> DataFrame:
    """``docs`` with ``shard`` (int, 0 to ``n_shards`` - 1) and ``slot`` (long, gapless from 0 in
    its shard); row counts of shards differ by one at most, and each shard has each stratum's
    share of it within a row or two.

    All columns of ``docs`` are carried, so hand in only what the output needs. Null strata form
    a stratum; rows are shuffled by a hash of all their columns, so null and repeated keys are dealt
    out like any other; rows that are alike in all columns stand next to each other, with a slot each;
    ties are broken by key and then by a hash of the other columns; an empty table gives an empty
    result. Columns of ``docs`` named ``shard`` or ``slot`` are replaced; names that begin with
    ``_`` and clash with the working columns are not touched, as these live in a struct.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    rest = [c for c in docs.columns if c not in ("shard", "slot")]
    hashed = [F.col(f"`{c}`").cast("string") if t.startswith(("map", "variant")) else F.col(f"`{c}`") for c, t in docs.dtypes if c in rest]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"),
        F.col(f"`{stratum}`").alias("stratum"),
        F.col(f"`{key}`").alias("key"),
        F.xxhash64(*hashed).alias("tie"),
    )
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "key", "tie"))
    rows = rows.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) * buckets).cast("int"))
    # shiftrightunsigned keeps h's unsigned order, so the bucket order is the order of "u"
    rows = rows.withColumn("u", F.shiftrightunsigned("h", 1))
    ranked = _ranked(rows, ["stratum"], "bucket", ["u", "key", "tie"], "r", "n")
    ranked = ranked.withColumn("f", (2 * F.col("r") + 1) / (2.0 * F.col("n"))).withColumn("slice", F.floor(F.col("f") * slices).cast("int")).drop("bucket")
    placed = _ranked(ranked, [], "slice", ["f", "stratum", "key", "tie"], "pos", "total")
    shard = F.expr(f"cast((pos * {n_shards}L) div total as int)")
    # the first position of shard s is ceil(s * total / n_shards)
    return placed.withColumn("shard", shard).select("row.*", "shard", F.expr(f"pos - (shard * total + {n_shards - 1}L) div {n_shards}L").alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, **options) -> None:
    """The whole documents, all columns, as one folder of Parquet files for each shard, in slot
    order inside every file. Each shard is written by several tasks, split by range of slots."""
    out = interleave(docs, n_shards, **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
