"""Tables in buckets against a dictionary, and which files a batch writes."""

import random

import pytest
from pyspark.sql import functions as F

from chainproof.sources.tables import BucketedTable
from chainproof.streaming import state as ST

SCHEMA = "a long, b string, v long"


@pytest.fixture
def table(spark, tmp_path):
    return BucketedTable.create(spark, f"file://{tmp_path}/t", SCHEMA, ["a", "b"], buckets=8, most_folders=3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_batches_against_a_dictionary(spark, table):
    """Random upserts and inserts with repeated and null keys, among them enough inserts to write buckets anew."""
    rng, want = random.Random(5), {}
    for n in range(9):
        new = [(rng.choice([1, 2, 3, None, n]), rng.choice(["x", "", None]), 100 * n + i) for i in range(rng.choice([0, 1, 9]))]
        df = spark.createDataFrame(new, SCHEMA)
        if n % 3:
            table.insert(df, ["v"])
            want = {(a, b): v for a, b, v in reversed(new)} | want
        else:
            table.upsert(df, [F.desc("v")])
            want |= {(a, b): v for a, b, v in new}
        assert rows(table.read()) == sorted(((a, b, v) for (a, b), v in want.items()), key=str)
        assert all(len(f) <= 3 for f in table.folders().values())


def test_only_touched_buckets_are_written(spark, table):
    table.upsert(spark.range(100).select(F.col("id").alias("a"), F.lit("k").alias("b"), F.lit(0).alias("v")), ["v"])
    before = table.folders()
    assert len(before) == 8 and all(len(f) == 1 for f in before.values())
    assert table.upsert(spark.createDataFrame([(7, "k", 1)], SCHEMA), ["v"])
    after = table.folders()
    assert sum(after[k] != before[k] for k in before) == 1 and all(len(f) == 1 for f in after.values())
    assert table.insert(spark.createDataFrame([(7, "k", 2), (8, "k", 2), (700, "k", 3)], SCHEMA), ["v"])
    added = {k: f for k, f in table.folders().items() if f != after[k]}
    assert len(added) == 1 and all(f[:-1] == after[k] for k, f in added.items())
    got = {r["a"]: r["v"] for r in table.read().collect()}
    assert len(got) == 101 and (got[7], got[8], got[700]) == (1, 0, 3)
    assert table.vacuum() == 1 and table.vacuum() == 0 and table.read().count() == 101


def test_a_repeated_batch_changes_nothing(spark, table):
    one = spark.createDataFrame([(1, "x", 1)], SCHEMA)
    assert table.upsert(one, ["v"], writer="w", batch=4)
    version, folders = table.version, table.folders()
    for change in (table.upsert, table.insert):
        assert not change(spark.createDataFrame([(1, "x", 9), (2, "x", 9)], SCHEMA), ["v"], writer="w", batch=4)
    assert (table.version, table.folders()) == (version, folders) and rows(table.read()) == [(1, "x", 1)]
    assert table.insert(one, ["v"], writer="other", batch=0) and table.taken("other", 0) and table.folders() == folders


def test_a_failed_batch_leaves_the_version_before(spark, table):
    table.upsert(spark.createDataFrame([(1, "x", 1)], SCHEMA), ["v"])
    fails = lambda df: df.withColumn("v", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        table.insert(spark.createDataFrame([(2, "x", 2)], SCHEMA), ["v"], fill=fails, writer="w", batch=0)
    assert rows(table.read()) == [(1, "x", 1)] and not table.taken("w", 0)
    stale = table._state()
    table.upsert(spark.createDataFrame([(1, "x", 5)], SCHEMA), ["v"])
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish(stale | {"version": stale["version"] + 1})
    assert rows(table.read()) == [(1, "x", 5)]


def test_clashing_and_extra_columns_and_empty_tables(spark, tmp_path):
    table = BucketedTable.create(spark, f"file://{tmp_path}/t", "_bucket long, v long", ["_bucket"], buckets=2, parts=3)
    assert table.read().collect() == [] and table.read().columns == ["_bucket", "v"]
    table.upsert(spark.createDataFrame([], "_bucket long, v long"), ["v"])
    assert table.version == 0
    table.upsert(spark.range(20).select((F.col("id") % 10).alias("_bucket"), F.col("id").alias("v"), F.lit("x").alias("more")), [F.desc("v")])
    assert rows(table.read()) == [(k, k + 10) for k in range(10)]
    with pytest.raises(ValueError):
        BucketedTable.create(spark, f"file://{tmp_path}/u", "a long", ["a"], buckets=5000)


def test_stream_fills_a_cache_once(spark, tmp_path):
    """Three micro-batches with texts in common; then a micro-batch sent again under its number."""
    cache = BucketedTable.create(spark, f"file://{tmp_path}/c", "input_hash string, result long, created_at timestamp", ["input_hash"], buckets=4)
    for i, texts in enumerate((["a", "bb", "a"], ["bb", "ccc"], [None, "a"])):
        spark.createDataFrame([(t,) for t in texts], "text string").withColumn("created_at", F.current_timestamp()).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    seen = spark.sparkContext.accumulator(0)

    def compute(df):
        seen.add(df.count())
        return df.withColumn("result", F.length(F.coalesce("text", F.lit(""))))

    def run():
        stream = spark.readStream.schema("text string, created_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        ST.stream_incremental(stream, cache, "v1", compute, writer="q").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()

    run()
    assert sorted(r["result"] for r in cache.read().collect() if r["result"]) == [1, 2, 3]
    once, version = seen.value, cache.version
    assert cache.taken("q", 2) and once == cache.read().count()
    run()
    again = spark.createDataFrame([("new",)], "text string").withColumn("created_at", F.current_timestamp())
    assert not ST.cached(again, cache, "v1", compute, writer="q", batch=2)
    assert (seen.value, cache.version) == (once, version)
    assert ST.cached(again, cache, "v2", compute, writer="q", batch=3) and seen.value == once + 1


def test_parses_are_kept_with_their_failures(spark, tmp_path):
    table = BucketedTable.create(spark, f"file://{tmp_path}/p", "text_id long, names array<string>, segmented_at timestamp", ["text_id"], buckets=4)
    corpus = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "text_id long, text string")
    parse = lambda df: df.where("text <> ''").select("text_id", F.split("text", " ").alias("names"))
    ST.parsed_into(corpus, table, parse)
    want = [(1, ["a", "b"]), (2, []), (3, [])]
    assert rows(table.read().select("text_id", "names")) == want
    version = table.folders()
    ST.parsed_into(corpus, table, lambda df: df.select("text_id", F.array(F.lit("no")).alias("names")))
    assert rows(table.read().select("text_id", "names")) == want and table.folders() == version
