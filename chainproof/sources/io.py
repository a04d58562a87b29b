"""Sources, sinks and checks of loaded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

GRADE = "struct<entry_id: int, grade_en: string, grade_ar: string>"
PROFILE = (
    "struct<id: int, full_name: string, kunya: string, grade_en: string, grade_ar: string, color: string, death: string, tabaqat: string, city: string, laqab: string, "
    f"nasab: string, dhahabi: string, namings: array<string>, classical_sources: map<string, {GRADE}>, teachers: array<int>, students: array<int>, confidence: string, id_score: int, grade_score: int>"
)


def read_profiles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """IO-1: one profile for each row, from shards that are objects of profiles by id."""
    shards = spark.read.text(paths, wholetext=True)
    return shards.select(F.explode(F.from_json("value", f"map<string, {PROFILE}>")).alias("key", "p")).select("p.*")


def explode_profile(profiles: DataFrame) -> dict[str, DataFrame]:
    """IO-2: narrator, name_variant, source_grade and transmission rows of profiles."""
    nested = ("namings", "classical_sources", "teachers", "students", "color", "dhahabi")
    narrator = profiles.select(*[c for c in profiles.columns if c not in nested])
    variant = profiles.select(F.col("id").alias("narrator_id"), F.explode("namings").alias("variant"))
    grade = profiles.select(F.col("id").alias("narrator_id"), F.explode("classical_sources").alias("source_book", "g")).select("narrator_id", "source_book", "g.*")
    up = profiles.select(F.col("id").alias("student_id"), F.explode("teachers").alias("teacher_id"))
    down = profiles.select(F.explode("students").alias("student_id"), F.col("id").alias("teacher_id"))
    return {"narrator": narrator, "name_variant": variant, "source_grade": grade, "transmission": up.unionByName(down).distinct()}


def read_corpus(spark: SparkSession, root: str, files: str = "*/*.json", book_of: str = r"([^/]+)/[^/]+$", file_of: str = r"([^/]+)$") -> DataFrame:
    """IO-3: texts of a tree books.json, <book>/index.json, <book>/<chapter file>: book_id,
    book_name_ar, book_name_en, chapter_no (place in the index, from 1), chapter_name_ar, number,
    arabic, english_narrator, english_text, grade. Books without a folder are skipped. ``files`` finds the files
    under ``root``, the other two patterns the book and the file's name in a path, for trees of another layout."""
    book = "array<struct<id: string, name_ar: string, name_en: string>>"
    groups = spark.read.text(f"{root}/books.json", wholetext=True).select(F.from_json("value", f"sunni struct<the_9_books: {book}, forties: {book}, other_books: {book}>").alias("j"))
    none = F.from_json(F.lit("[]"), book)
    books = groups.select(F.explode(F.concat(*[F.coalesce(f"j.sunni.{g}", none) for g in ("the_9_books", "forties", "other_books")])).alias("b")).select(F.col("b.id").alias("book_id"), F.col("b.name_ar").alias("book_name_ar"), F.col("b.name_en").alias("book_name_en"))
    path = F.url_decode("_metadata.file_path")
    found = spark.read.text(f"{root}/{files}", wholetext=True).select("value", F.regexp_extract(path, book_of, 1).alias("book_id"), F.regexp_extract(path, file_of, 1).alias("file"))
    index = found.where("file = 'index.json'").select("book_id", F.posexplode(F.from_json("value", "array<struct<file: string, name_ar: string>>")).alias("i", "c"))
    index = index.select("book_id", (F.col("i") + 1).alias("chapter_no"), F.col("c.file").alias("file"), F.col("c.name_ar").alias("chapter_name_ar"))
    item = "array<struct<id: bigint, idInBook: int, arabic: string, english: struct<narrator: string, text: string>, grade: string>>"
    texts = found.where("file <> 'index.json'").select("book_id", "file", F.explode(F.from_json("value", item)).alias("t"))
    rows = texts.join(index, ["book_id", "file"]).join(books, "book_id")
    return rows.select("book_id", "book_name_ar", "book_name_en", "chapter_no", "chapter_name_ar", F.col("t.idInBook").alias("number"), F.col("t.arabic").alias("arabic"), F.col("t.english.narrator").alias("english_narrator"), F.col("t.english.text").alias("english_text"), F.col("t.grade").alias("grade"))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """WN-4: the first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def read_csv_overlay(spark: SparkSession, path: str, schema: str, name: str, payload: str) -> DataFrame:
    """IO-4: rows of a headed CSV with a payload, the first of each normalised name in file order."""
    from chainproof.functions.text import normalize

    rows = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True).withColumn("_n", F.monotonically_increasing_id())
    rows = rows.where((F.coalesce(F.trim(payload), F.lit("")) != "") & (F.trim(payload) != "-") & F.col(name).isNotNull()).withColumn("normalized", normalize(F.col(name)))
    return first_per_key(rows, ["normalized"], ["_n"]).drop("_n")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO-6."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """IO-6."""
    df.write.json(path)


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """IO-7: ``target`` and the rows of ``new`` whose key it lacks, the first of each key."""
    fresh = first_per_key(new, keys, order).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def insert_counts(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """IO-7: inserted and duplicate rows of ``new``."""
    per_key = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(target.select(*keys).distinct().withColumn("_t", F.lit(1)), keys, "left")
    inserted = F.count_if(F.col("_t").isNull())
    return per_key.agg(inserted.alias("inserted"), (F.coalesce(F.sum("n"), F.lit(0)) - inserted).alias("duplicate"))


def upsert(target: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """IO-8: ``new`` replaces; the last of ``new`` by ``order`` (descending columns) counts."""
    latest = first_per_key(new, keys, order)
    return target.join(latest.select(*keys), keys, "left_anti").select(*target.columns).unionByName(latest.select(*target.columns))


def replace_slice(path: str, new: DataFrame, slice_columns: list[str]) -> None:
    """IO-9: rewrites the slices (partitions) of ``new`` in the Parquet table at ``path``; others
    stay."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*slice_columns).parquet(path)


def replaced(target: DataFrame, new: DataFrame, slice_columns: list[str]) -> DataFrame:
    """IO-9 as a DataFrame: ``target`` with the slices of ``new`` replaced."""
    slices = new.select(*slice_columns).distinct()
    return target.join(slices, slice_columns, "left_anti").select(*target.columns).unionByName(new.select(*target.columns))


def import_log(results: DataFrame, by: str = "source_book") -> DataFrame:
    """IO-10: per source total, matched (inserted or duplicate), unmatched and last run."""
    matched = F.col("outcome").isin("inserted", "duplicate")
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("total_entries"), F.count_if(matched).alias("matched"), F.count_if(~matched).alias("unmatched"), F.max("run_at").alias("last_run_at"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """IO-11: (table_name, n_rows)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def expectations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """IO-12: (rule, violations): ``rules`` are conditions that every row has to meet, counted in
    one scan; a null condition is a violation."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"_{i}") for i, c in enumerate(rules.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("violations")) for i, n in enumerate(rules)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def unique_violations(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """IO-12: keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def foreign_violations(df: DataFrame, column: str, parent: DataFrame, parent_column: str, rule: str) -> DataFrame:
    """IO-12: rows whose value the parent lacks."""
    known = parent.select(F.col(parent_column).alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).join(known, column, "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def coverage_report(df: DataFrame, base: str, overlay: str) -> DataFrame:
    """IO-13: (measure, n): total, with base, with overlay, with either, in one scan."""
    has = lambda c: ~F.coalesce(F.trim(F.nullif(F.col(c), F.lit("-"))) == "", F.lit(True))
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(has(base)).alias("base"), F.count_if(has(overlay)).alias("overlay"), F.count_if(has(base) | has(overlay)).alias("either"))
    rows = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("n")) for n in ("total", "base", "overlay", "either")])
    return counts.select(F.explode(rows).alias("r")).select("r.*")
