"""The registered queries of the library's own operators, with DuckDB SQL of the same results.

Each query runs one operator, or a few that go together, over whole given tables or relations made
of them (``standins``). Nested results are spelt as text, so that both engines compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainproof.functions import lexicons as X
from chainproof.functions import rules
from chainproof.functions import similarity as S
from chainproof.functions import text as T
from chainproof.operators import chains as C
from chainproof.operators import evidence as E
from chainproof.operators import matching as M
from chainproof.operators import parse as P
from chainproof.operators import passages as A
from chainproof.plans.standins import Tables, duck
from chainproof.sources import io as IO
from chainproof.sources.tables import BucketedTable
from chainproof.sources.work import new_path
from chainproof.streaming import state as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of ``Tables`` under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return fn

    return add


def listed(c: Column | str, sep: str = "|") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("~"))), sep)


def _case(c: str, values: dict, default: str) -> str:
    lit = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    return f"case {c} " + " ".join(f"when '{k}' then {lit(v)}" for k, v in values.items()) + f" else {default} end"


TIER = lambda c: _case(c, X.GRADE_TIERS, "3")
_MARKS = "[" + "".join(f"{chr(a)}-{chr(b)}" if b else chr(a) for a, b in ((0x610, 0x61A), (0x64B, 0x65F), (0x670, 0), (0x640, 0))) + "]"
NORMAL = lambda c: f"trim(regexp_replace(translate(regexp_replace({c}, '{_MARKS}', '', 'g'), '{X.FOLD_FROM}', '{X.FOLD_TO}'), '\\s+', ' ', 'g'))"
GRAMS = lambda c: f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
WORDS = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"

# Sources, sinks and checks


@query("io02_explode_profile", duck(then="""
    select 'grade' as kind, o_custkey as a, o_orderkey as b, o_orderpriority as c from orders
    union all select 'variant', o_custkey, null, o_orderstatus from orders
    union all select distinct 'edge', o_custkey, o_orderkey % 100, null from orders"""))
def _(t: Tables) -> DataFrame:
    json = F.format_string('{"1": {"id": %d, "namings": ["%s"], "classical_sources": {"%s": {"entry_id": %d}}, "teachers": [%d], "students": []}}', "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey", F.col("o_orderkey") % 100)
    profiles = t.orders.select(F.explode(F.from_json(json, f"map<string, {IO.PROFILE}>")).alias("k", "p")).select("p.*")
    parts = IO.explode_profile(profiles)
    null = F.lit(None)
    row = lambda df, kind, a, b, c: df.select(F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("string").alias("c"))
    grade = row(parts["source_grade"], "grade", F.col("narrator_id"), F.col("entry_id"), F.col("source_book"))
    variant = row(parts["name_variant"], "variant", F.col("narrator_id"), null, F.col("variant"))
    return grade.unionByName(variant).unionByName(row(parts["transmission"], "edge", F.col("student_id"), F.col("teacher_id"), null))


@query("io01_read_profiles", duck(then="""
    select c_custkey as id, c_name as full_name, case when c_custkey % 4 = 0 then null else '-' end as death, [c_mktsegment, c_name][1] as naming, c_nationkey as teacher, c_custkey % 100 as entry_id from customer"""))
def _(t: Tables) -> DataFrame:
    """Shards of a hundred profiles each, written as JSON and read again."""
    c = F.col
    profile = F.struct(
        c("c_custkey").cast("int").alias("id"), c("c_name").alias("full_name"), F.when(c("c_custkey") % 4 > 0, "-").alias("death"), F.array("c_mktsegment", "c_name").alias("namings"),
        F.create_map(F.lit("m"), F.struct((c("c_custkey") % 100).cast("int").alias("entry_id"))).alias("classical_sources"), F.array(c("c_nationkey").cast("int")).alias("teachers"))
    shards = t.customer.groupBy(F.floor(c("c_custkey") / 100).alias("shard")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(c("c_custkey").cast("string"), profile)))).alias("value"))
    path = new_path(t.spark, "profiles")
    shards.write.partitionBy("shard").text(path)
    out = IO.read_profiles(t.spark, f"{path}/*")
    return out.select("id", "full_name", "death", c("namings")[0].alias("naming"), c("teachers")[0].alias("teacher"), c("classical_sources")["m"]["entry_id"].alias("entry_id"))


@query("io03_read_corpus", duck(then="""
    with d as (select *, doc_id // 200 as c from documents where text is not null and source <> 'src1'),
    n as (select source, c, row_number() over (partition by source order by c) as chapter_no from (select distinct source, c from d))
    select source as book_id, 'كتاب ' || source as book_name_ar, 'Book ' || source as book_name_en, cast(chapter_no as integer) as chapter_no, 'باب ' || c as chapter_name_ar, cast(doc_id % 200 as integer) as number,
        text as arabic, lang as english_narrator, case when doc_id % 3 = 0 then 'n ' || n_chars end as english_text, case doc_id % 4 when 0 then 'Sahih' when 1 then 'Hasan' end as grade from d join n using (source, c)"""))
def _(t: Tables) -> DataFrame:
    """Chapters of 200 documents at most, written as a tree of JSON files and read again; one book has no folder."""
    c, path = F.col, new_path(t.spark, "corpus")
    d = t.documents.where("text is not null").select("*", F.floor(c("doc_id") / 200).alias("c"), F.concat(F.lit("c"), F.floor(c("doc_id") / 200), F.lit(".json")).alias("file"))
    item = F.struct(
        c("doc_id").alias("id"), (c("doc_id") % 200).cast("int").alias("idInBook"), c("text").alias("arabic"), F.struct(c("lang").alias("narrator"), F.when(c("doc_id") % 3 == 0, F.concat(F.lit("n "), c("n_chars"))).alias("text")).alias("english"),
        F.when(c("doc_id") % 4 == 0, "Sahih").when(c("doc_id") % 4 == 1, "Hasan").alias("grade"))
    there = d.where("source <> 'src1'")
    chapters = there.groupBy(c("source").alias("book"), "file").agg(F.to_json(F.collect_list(item)).alias("value"))
    entry = F.struct("c", "file", F.concat(F.lit("باب "), c("c")).alias("name_ar"))
    index = there.select("source", "c", "file").distinct().groupBy(c("source").alias("book")).agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("value")).select("book", F.lit("index.json").alias("file"), "value")
    chapters.unionByName(index).write.partitionBy("book", "file").text(f"{path}/tree")
    book = F.struct(c("source").alias("id"), F.concat(F.lit("كتاب "), c("source")).alias("name_ar"), F.concat(F.lit("Book "), c("source")).alias("name_en"))
    books = d.select("source").distinct().agg(F.to_json(F.struct(F.struct(F.collect_list(book).alias("the_9_books")).alias("sunni"))).alias("value"))
    books.write.text(f"{path}/tree/books.json")
    return IO.read_corpus(t.spark, f"{path}/tree", "book=*/file=*/*.txt", r"/book=([^/]+)/", r"/file=([^/]+)/")


@query("io04_csv_overlay", duck(then=f"""
    with c as (select c_custkey as k, 'أَحمد "' || c_mktsegment || '", ' || c_custkey % 300 as name, case c_custkey % 7 when 0 then '-' when 1 then null when 2 then ' ' else cast(c_custkey as varchar) end as death from customer),
    r as (select *, row_number() over (partition by {NORMAL("name")} order by k) as r from c where trim(death) not in ('', '-'))
    select name, death, {NORMAL("name")} as normalized from r where r = 1"""))
def _(t: Tables) -> DataFrame:
    """One overlay file with quotes and commas in names, written and read again."""
    k = F.col("c_custkey")
    rows = t.customer.select(k, F.concat(F.lit('أَحمد "'), "c_mktsegment", F.lit('", '), (k % 300).cast("string")).alias("name"), F.when(k % 7 == 0, "-").when(k % 7 == 1, F.lit(None)).when(k % 7 == 2, " ").otherwise(k.cast("string")).alias("death"))
    path = new_path(t.spark, "overlay")
    rows.orderBy("c_custkey").drop("c_custkey").coalesce(1).write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return IO.read_csv_overlay(t.spark, path, "name string, death string", "name", "death")


@query("io06_jsonl", duck(then="select o_orderkey as k, o_orderpriority as name, case when o_orderstatus = 'F' then o_totalprice end as score from orders"))
def _(t: Tables) -> DataFrame:
    path = new_path(t.spark, "jsonl")
    IO.write_jsonl(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("score")), path)
    return IO.read_jsonl(t.spark, path, "k long, name string, score double")


@query("io05_paragraphs", duck(then="""
    with b as (select page_id, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) as b from pages),
    l as (select page_id, string_split(regexp_replace(regexp_replace(b, '\\n', ' ', 'g'), '</p>|<br\\s*/?>', chr(10), 'g'), chr(10)) as l from b),
    p as (select page_id, list_filter(list_transform(l, lambda x: trim(regexp_replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '\\s+', ' ', 'g'))), lambda x: x <> '') as p from l)
    select page_id, cast(unnest(range(len(p))) as integer) as para_no, unnest(p) as text from p"""))
def _paragraphs(t: Tables) -> DataFrame:
    return P.html_to_paragraphs(t.pages, block=r"(?s)<article[^>]*>(.*?)</article>")


@query("io07_insert_ignore", duck(then="""
    with t as (select o_custkey, o_orderpriority, o_orderkey from orders where o_orderdate < '1998-01-01'),
    f as (select o_custkey, o_orderpriority, min(o_orderkey) as o_orderkey from orders where o_orderdate >= '1998-01-01' group by 1, 2)
    select * from t union all select * from f where not exists (select 1 from t where t.o_custkey = f.o_custkey and t.o_orderpriority = f.o_orderpriority)"""))
def _(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")
    cut = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return IO.insert_ignore(o.where(cut).drop("o_orderdate"), o.where(~cut), ["o_custkey", "o_orderpriority"], ["o_orderkey"])


@query("io08_upsert", duck(then="""
    with t as (select o_custkey, o_orderpriority, o_orderkey from orders where o_orderdate < '1998-01-01'),
    f as (select o_custkey, o_orderpriority, max(o_orderkey) as o_orderkey from orders where o_orderdate >= '1998-01-01' group by 1, 2)
    select * from f union all select * from t where not exists (select 1 from f where t.o_custkey = f.o_custkey and t.o_orderpriority = f.o_orderpriority)"""))
def _(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")
    cut = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return IO.upsert(o.where(cut).drop("o_orderdate"), o.where(~cut), ["o_custkey", "o_orderpriority"], [F.desc("o_orderkey")])


_BATCHES = """
    with o as (select o_custkey, o_orderpriority, o_orderkey, case when o_orderdate < '1994-01-01' then 0 when o_orderdate < '1996-01-01' then 1 else 2 end as batch from orders)
    select o_custkey, o_orderpriority, o_orderkey, batch from (select *, row_number() over (partition by o_custkey, o_orderpriority order by {0}) as r from o) x where r = 1"""


def _in_batches(t: Tables, change: str, order: list) -> DataFrame:
    """Orders of three spans taken by a table in buckets, the second span twice."""
    since = lambda day: (F.col("o_orderdate") >= F.lit(day).cast("timestamp_ntz")).cast("int")
    o = t.orders.select("o_custkey", "o_orderpriority", "o_orderkey", (since("1994-01-01") + since("1996-01-01")).alias("batch"))
    table = BucketedTable.create(o.sparkSession, new_path(o.sparkSession, change), o.schema, ["o_custkey", "o_orderpriority"], buckets=16)
    for n in (0, 1, 1, 2):
        getattr(table, change)(o.where(F.col("batch") == n), order, writer="orders", batch=n)
    return table.read()


@query("io07_bucketed_insert", duck(then=_BATCHES.format("batch, o_orderkey")))
def _(t: Tables) -> DataFrame:
    return _in_batches(t, "insert", ["o_orderkey"])


@query("io08_bucketed_upsert", duck(then=_BATCHES.format("batch desc, o_orderkey desc")))
def _(t: Tables) -> DataFrame:
    return _in_batches(t, "upsert", [F.desc("o_orderkey")])


@query("io09_replace_slice", duck(then="""
    select o_orderpriority, o_orderkey, o_totalprice from orders where o_orderpriority <> '2-HIGH'
    union all select o_orderpriority, o_orderkey, 0 from orders where o_orderpriority = '2-HIGH' and o_orderstatus = 'F'"""))
def _(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.where("o_orderpriority = '2-HIGH' and o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0))
    return IO.replaced(o.drop("o_orderstatus"), new, ["o_orderpriority"])


@query("io10_import_log", duck(then="""
    select o_orderpriority as source_book, count(*) as total_entries, count(*) filter (o_orderstatus <> 'P') as matched, count(*) filter (o_orderstatus = 'P') as unmatched, cast(max(o_orderdate) as varchar) as last_run_at
    from orders group by 1"""))
def _(t: Tables) -> DataFrame:
    outcome = F.when(F.col("o_orderstatus") == "F", "inserted").when(F.col("o_orderstatus") == "O", "duplicate").otherwise("unmatched")
    out = IO.import_log(t.orders.select(F.col("o_orderpriority").alias("source_book"), outcome.alias("outcome"), F.col("o_orderdate").alias("run_at")))
    return out.withColumn("last_run_at", F.date_format("last_run_at", "yyyy-MM-dd HH:mm:ss"))


@query("io11_table_counts", duck(then=" union all ".join(f"select '{n}' as table_name, count(*) as n_rows from {n}" for n in ("orders", "lineitem", "part", "documents", "pages"))))
def _(t: Tables) -> DataFrame:
    return IO.table_counts({n: t.given(n) for n in ("orders", "lineitem", "part", "documents", "pages")})


@query("io12_expectations", duck(then="""
    select 'price over zero' as rule, count(*) filter (not coalesce(o_totalprice > 0, false)) as violations from orders
    union all select 'status known', count(*) filter (not coalesce(o_orderstatus in ('F', 'O'), false)) from orders
    union all select 'line number unique', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
    union all select 'customer known', count(*) from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer where c_custkey % 10 < 9)"""))
def _(t: Tables) -> DataFrame:
    rows = IO.expectations(t.orders, {"price over zero": F.col("o_totalprice") > 0, "status known": F.col("o_orderstatus").isin("F", "O")})
    unique = IO.unique_violations(t.lineitem, ["l_orderkey", "l_linenumber"], "line number unique")
    return rows.unionByName(unique).unionByName(IO.foreign_violations(t.orders, "o_custkey", t.customer.where("c_custkey % 10 < 9"), "c_custkey", "customer known"))


@query("io13_coverage", duck("graded_entities", then="""
    , x as (select coalesce(trim(nullif(death, '-')), '') <> '' as b, coalesce(trim(nullif(death_overlay, '-')), '') <> '' as o from graded_entities)
    select 'total' as measure, count(*) as n from x union all select 'base', count(*) filter (b) from x union all select 'overlay', count(*) filter (o) from x union all select 'either', count(*) filter (b or o) from x"""))
def _(t: Tables) -> DataFrame:
    return IO.coverage_report(t.graded_entities, "death", "death_overlay")


# Scalar functions

_RAW = "concat('أَحْمَدُ  بن ', c_name, ' الكوفيّ ', case c_custkey % 3 when 0 then 'رضي الله عنهما ثقة' when 1 then 'صلى الله عليه وسلم' else 'مكتبةٌ (٣٤) ' end)"


@query("sc01_normalize", duck(then=f"select c_custkey, {NORMAL(_RAW)} as normalized from customer"))
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.normalize(F.expr(_RAW)).alias("normalized"))


@query("sc02_sc04_clean", duck(then=f"""
    select c_custkey, trim(regexp_replace(regexp_replace({_RAW}, '\\s*(?:{X.HONORIFICS})\\s*', ' ', 'g'), '\\s+', ' ', 'g')) as plain,
        translate({_RAW}, '{X.EASTERN_DIGITS}', '0123456789') as digits,
        trim(regexp_replace(regexp_replace({_RAW}, '\\s*\\(\\s*[{X.EASTERN_DIGITS}0-9]+\\s*\\)\\s*', ' ', 'g'), '\\s+', ' ', 'g')) as unreferenced from customer"""))
def _(t: Tables) -> DataFrame:
    raw = F.expr(_RAW)
    return t.customer.select("c_custkey", T.strip_phrases(raw).alias("plain"), T.digits_to_ascii(raw).alias("digits"), T.strip_footnote_refs(raw).alias("unreferenced"))


@query("sc05_sc06_names", duck("registry", then=f"""
    , w as (select entity_id, {WORDS("regexp_replace(full_name, '[،:]', ' ', 'g')")} as w from registry)
    select entity_id, array_to_string(w[1:case when len(w) >= 3 and w[2] in ('ring', 'bolt') then 3 else 4 end], ' ') as short4,
        array_to_string(w[1:case when len(w) >= 3 and w[2] in ('ring', 'bolt') then 3 else 2 end], ' ') as short2,
        array_to_string(list_filter(w, lambda x: len(x) >= 2 and x not in ('red', 'blue', 'ECONOMY')), '|') as tokens from w"""))
def _(t: Tables) -> DataFrame:
    n = F.col("full_name")
    return t.registry.select("entity_id", T.short_name(n, 4, ("ring", "bolt")).alias("short4"), T.short_name(n, 2, ("ring", "bolt")).alias("short2"), listed(T.name_tokens(n, ["red", "blue"], ["ECONOMY"])).alias("tokens"))


@query("sc07_sc08_years", duck("chain_entities", then="""
    , y as (select entity_id, list_filter(list_transform(regexp_extract_all(coalesce(nullif(death, '-'), ''), '[0-9]+'), lambda x: cast(x as integer)), lambda y: y > 0 and y < 2000) as y from chain_entities)
    select entity_id, array_to_string(y, '|') as years, list_min(y) as first_year, case when len(y) > 0 then len(y) > 1 end as has_alternatives from y"""))
def _(t: Tables) -> DataFrame:
    one = T.primary_year(F.col("death"))
    return t.chain_entities.select("entity_id", listed(T.parse_years(F.col("death"))).alias("years"), one["year"].alias("first_year"), one["has_alternatives"].alias("has_alternatives"))


@query("sc09_sc12_labels", duck("graded_entities", "grades", then=f"""
    select e.entity_id, g.grade_id,
        case when regexp_extract(trim(nullif(tabaqat, '-')), '({"|".join(X.ORDINALS)})', 1) <> '' then '{X.ORDINAL_PREFIX}' || regexp_extract(trim(nullif(tabaqat, '-')), '({"|".join(X.ORDINALS)})', 1)
            when length(trim(tabaqat)) > 20 then substr(trim(tabaqat), 1, 18) || '…' else trim(nullif(tabaqat, '-')) end as generation,
        coalesce(nullif(death, '-'), death_overlay) as death,
        trim(coalesce(nullif(death, '-'), '') || '، ' || coalesce(death_overlay, ''), '، ') as deaths,
        coalesce(regexp_matches(trim(grade_text), '^({"|".join(X.MENTION_VERBS)})\\s'), false) as mention,
        {TIER("bucket")} as tier, {_case("bucket", X.GRADE_LABELS, f"'{X.UNKNOWN_LABEL}'")} as label,
        case {" ".join(f"when regexp_matches(grade_text, '{p}') then '{b}'" for p, b in X.SEVERITY)} end as severity,
        array_to_string(list_filter([{", ".join(f"case when regexp_matches(grade_text, '{p}') then '{r}' end" for p, r, _ in X.REASONS)}], lambda x: x is not null), '|') as reasons
    from grades g join graded_entities e on g.entity_id = e.entity_id"""))
def _(t: Tables) -> DataFrame:
    g = F.col("grade_text")
    rows = t.grades.join(t.graded_entities, "entity_id")
    return rows.select("entity_id", "grade_id", T.rank_label_short(F.col("tabaqat")).alias("generation"), T.coalesce_overlay(F.col("death"), F.col("death_overlay")).alias("death"), T.join_overlay(F.col("death"), F.col("death_overlay")).alias("deaths"), T.is_mention_only(g).alias("mention"), T.grade_tier(F.col("bucket")).alias("tier"), T.grade_label(F.col("bucket")).alias("label"), T.severity_from_text(g).alias("severity"), F.coalesce(listed(T.tag_reasons(g)), F.lit("")).alias("reasons"))


_GLOSSARY = [("منكر الحديث", "jarh", 3), ("ليس بثقة", "jarh", 2), ("صدوق", "tadil", 2), ("فلان", "tadil", 4), ("صدوق", "tadil", 3)]


@query("sc16_glossary", duck("grades", then=f"""
    , n as (select grade_id, {NORMAL("grade_text")} as n from grades where grade_text is not null),
    b as (select *, trim(regexp_replace(n, '{X.PREAMBLE}', '')) as b from n),
    g as (select * from (values (1, '{_GLOSSARY[0][0]}', 'jarh', 3), (2, 'ليس بثقه', 'jarh', 2), (3, 'صدوق', 'tadil', 3), (4, 'فلان', 'tadil', 4)) v(o, phrase, type, tier)),
    x as (select grade_id, g.*, row_number() over (partition by grade_id order by case when n = phrase then 0 when b = phrase then 1 else 2 end, o) as r from b join g on contains(n, phrase) or b = phrase)
    select grade_id, phrase, type, tier from x where r = 1"""))
def _(t: Tables) -> DataFrame:
    glossary = t.spark.createDataFrame([(i, *r) for i, r in enumerate(_GLOSSARY)], "ord int, phrase string, type string, tier int")
    return E.glossary_lookup(t.grades, glossary)


@query("sc17_sc23_verbs", duck("verbs", "positions", then="""
    select chain_id, pos, case when formula is null then 'unknown' when formula in ('haddathana', 'haddathani', 'akhbarana', 'akhbarani', 'anbaana', 'anbaani', 'samitu', 'qala-li', 'qala-lana') then 'explicit' else 'ambiguous' end as strength,
        sha256('v1:' || trim(regexp_replace(name, '\\s+', ' ', 'g'))) as key, case when pos % 2 = 0 then entity_id else pos end as student, case when pos % 2 = 0 then pos else entity_id end as teacher from positions"""))
def _(t: Tables) -> DataFrame:
    phrase = F.when(F.col("pos") % 2 == 0, F.lit("سمع منه")).otherwise(F.lit("روى عنه فلان"))
    student, teacher = T.edge_direction(F.col("entity_id"), F.col("pos"), phrase)
    return t.positions.select("chain_id", "pos", T.formula_strength(F.col("formula")).alias("strength"), T.cache_key("v1", F.col("name")).alias("key"), student.alias("student"), teacher.alias("teacher"))


@query("sc18_sc20_similarity", duck("registry", "mentions", then=f"""
    , x as (select entity_id, {GRAMS("lower(full_name)")} as a, {GRAMS("lower(name)")} as b from registry join mentions on entity_id = mention_id)
    select entity_id, len(a) as n_grams, array_to_string(list_sort(a), '|') as grams, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) as similarity,
        least(len(a), len(b)) >= 2 and len(list_intersect(a, b)) = least(len(a), len(b)) as subset from x"""))
def _(t: Tables) -> DataFrame:
    a, b = S.trigrams(F.lower("full_name")), S.trigrams(F.lower("name"))
    rows = t.registry.join(t.mentions, F.col("entity_id") == F.col("mention_id"))
    return rows.select("entity_id", F.size(a).cast("long").alias("n_grams"), listed(F.sort_array(a)).alias("grams"), F.round(S.trigram_similarity(F.lower("full_name"), F.lower("name")), 6).alias("similarity"), S.is_subset(a, b).alias("subset"))


@query("sc24_same_entity", duck("registry", "mentions", then=f"""
    , x as (select entity_id, full_name, name, list_distinct({WORDS("full_name")}) as a, list_distinct({WORDS("name")}) as b from registry join mentions on entity_id = mention_id)
    select entity_id, 2 * len(list_intersect(a, b)) >= len(a) + len(b) - len(list_intersect(a, b)) or (least(len(a), len(b)) >= 2 and len(list_intersect(a, b)) = least(len(a), len(b))) as same from x"""))
def _(t: Tables) -> DataFrame:
    rows = t.registry.join(t.mentions, F.col("entity_id") == F.col("mention_id"))
    return rows.select("entity_id", S.same_entity(F.col("full_name"), F.col("name"), T.name_tokens(F.col("full_name"), [], []), T.name_tokens(F.col("name"), [], [])).alias("same"))


@query("sc25_jn20_printed_grade", duck("grades", then="""
    , p as (select grade_id, case when o = 0 then 'sahih' when o = 1 then 'hasan' when o = 2 then 'daif' when o = 3 then 'sahih' when o = 4 then 'other' end as printed,
        case bucket when 'reliable' then 'sahih_candidate' when 'mostly_reliable' then 'hasan_candidate' when 'weak' then 'daif' when 'abandoned' then 'broken' else 'needs_review' end as verdict from (select *, grade_id % 6 as o from grades))
    select printed, verdict, count(*) as n, coalesce((printed = 'sahih' and verdict = 'sahih_candidate') or (printed = 'hasan' and verdict = 'hasan_candidate') or (printed = 'daif' and verdict in ('daif', 'broken')), false) as agree from p group by 1, 2"""))
def _(t: Tables) -> DataFrame:
    spelt = F.element_at(F.array(*[F.lit(x) for x in ("Sahih", "HASAN li", "Da'if jiddan", "صحيح", "غريب")], F.lit(None).cast("string")), (F.col("grade_id") % 6 + 1).cast("int"))
    verdict = F.expr("case bucket when 'reliable' then 'sahih_candidate' when 'mostly_reliable' then 'hasan_candidate' when 'weak' then 'daif' when 'abandoned' then 'broken' else 'needs_review' end")
    rows = t.grades.select(F.col("grade_id").alias("text_id"), spelt.alias("grade"), verdict.alias("verdict"))
    return E.book_vs_engine(rows, rows)


@query("sc26_book_titles", duck("grades", "books", then="select grade_id, source_book, coalesce(title, source_book) as title from grades left join books on book = source_book"))
def _(t: Tables) -> DataFrame:
    return E.book_titles(t.grades.select("grade_id", "source_book"), t.books, "source_book")


# Predicates

_PROTECTED = lambda p, tab, text, bucket: f"(regexp_matches(coalesce({tab}, ''), '{X.PROTECTED[p][0]}') or regexp_matches(coalesce({text}, ''), '{X.PROTECTED[p][1]}')" + (f" or coalesce({bucket} = 'companion', false)" if X.PROTECTED[p][2] else "") + ")"


@query("pf01_eligible", duck("graded_entities", "grades", then="""
    select entity_id from graded_entities where coalesce(trim(nullif(death, '-')), '') = '' and coalesce(trim(nullif(death_overlay, '-')), '') = '' and entity_id in (select entity_id from grades)"""))
def _(t: Tables) -> DataFrame:
    return E.eligible_targets(t.graded_entities, t.grades, "death", "death_overlay").select("entity_id")


@query("pf02_pf03_classes", duck("chain_entities", then="select entity_id, " + ", ".join(f"{_PROTECTED(p, 'tabaqat', 'grade_text', 'bucket')} as {p}" for p in X.PROTECTED) + f""",
    contains(coalesce(tabaqat, ''), '{X.SUCCESSOR}') or (regexp_matches(coalesce(tabaqat, ''), '{X.SUCCESSOR_GENERATIONS}') and not regexp_matches(coalesce(tabaqat, ''), '{X.NOT_SUCCESSOR}')) as successor from chain_entities"""))
def _(t: Tables) -> DataFrame:
    tab, g, b = F.col("tabaqat"), F.col("grade_text"), F.col("bucket")
    return t.chain_entities.select("entity_id", *[T.is_protected(tab, g, b, p).alias(p) for p in X.PROTECTED], T.is_successor(tab).alias("successor"))


@query("pf04_pf06_inputs", duck(then="select doc_id, coalesce(length(text) >= 6, false) as long_enough, case when text is null or trim(text) = '' then 'missing' when length(text) > 4000 then 'too_long' else 'ok' end as status from documents"))
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.min_length(F.col("text"), 6).alias("long_enough"), T.input_status(F.col("text")).alias("status"))


_GRADED = lambda profile: f"""
    , protected as (select entity_id from graded_entities where regexp_matches(coalesce(tabaqat, ''), '{X.PROTECTED["entity"][0]}')
        union select entity_id from grades where bucket = 'companion' or regexp_matches(coalesce(grade_text, ''), '{X.PROTECTED["entity"][1]}')),
    graded as (select * from grades where bucket is not null and bucket <> 'unknown' and not coalesce(regexp_matches(trim(grade_text), '^({"|".join(X.MENTION_VERBS)})\\s'), false)
        and not (bucket in {E.CRITICISM[profile]!r} and entity_id in (select entity_id from protected)))"""  # noqa: E731


def graded(t: Tables, profile: str) -> DataFrame:
    return E.graded_rows(t.grades, E.protected_entities(t.graded_entities, t.grades), profile)


@query("pf05_graded_rows", duck("graded_entities", "grades", then=_GRADED("summary") + " select entity_id, grade_id, bucket from graded"))
def _(t: Tables) -> DataFrame:
    return graded(t, "summary").select("entity_id", "grade_id", "bucket")


# Aggregations of grades


@query("ag01_harshest", duck("graded_entities", "grades", then=_GRADED("harshest") + f""",
    r as (select *, {TIER("bucket")} as tier from graded), w as (select *, row_number() over (partition by entity_id order by tier, length(grade_text) desc nulls first, grade_id) as r from r)
    select entity_id, bucket, grade_text, source_book, tier from w where r = 1"""))
def harshest(t: Tables) -> DataFrame:
    return E.harshest_grade(graded(t, "harshest"))


@query("ag02_ag03_disagreement", duck("graded_entities", "grades", then=_GRADED("summary") + f""",
    r as (select *, {TIER("bucket")} as tier from graded), w as (select *, row_number() over (partition by entity_id order by tier desc, grade_id) as h, row_number() over (partition by entity_id order by tier, grade_id) as l from r)
    select entity_id, count(distinct bucket) as distinct_grades, max(tier) - min(tier) as tier_spread, max(case when h = 1 then bucket end) as highest, max(case when l = 1 then bucket end) as lowest,
        case when max(tier) - min(tier) >= 3 then 'severe' when max(tier) - min(tier) = 2 then 'notable' when max(tier) - min(tier) = 1 then 'minor' else 'suppressed' end as severity from w group by 1"""))
def _(t: Tables) -> DataFrame:
    return E.disagreement(graded(t, "summary"))


@query("ag04_prominence", duck("grades", then="select entity_id, count(*) as prominence from grades group by 1"))
def _(t: Tables) -> DataFrame:
    return E.prominence(t.grades)


@query("ag07_verb_counts", duck("verbs", then="select verb, count(*) as n from verbs group by 1"))
def _(t: Tables) -> DataFrame:
    return E.verb_counts(t.verbs)


# Matching

_PAIRS = lambda a, an, b, bn, tau: f""", l as (select distinct {NORMAL(an)} as l from {a} where length({NORMAL(an)}) >= 3), r as (select distinct {NORMAL(bn)} as r from {b}),
    lg as (select l, unnest({GRAMS("l")}) as g, len({GRAMS("l")}) as n from l), rg as (select r, unnest({GRAMS("r")}) as g, len({GRAMS("r")}) as n from r),
    near as (select l, r, count(*) as c, any_value(lg.n) + any_value(rg.n) - count(*) as u from lg join rg on lg.g = rg.g group by l, r having count(*) * 1000 >= (any_value(lg.n) + any_value(rg.n) - count(*)) * {round(tau * 1000)})"""  # noqa: E731
_SCORED = lambda tau: _PAIRS("mentions", "name", "registry", "full_name", tau) + f""",
    s as (select m.mention_id, v.entity_id, max(n.c / n.u) as score from mentions m join near n on n.l = {NORMAL("m.name")} join registry v on {NORMAL("v.full_name")} = n.r group by 1, 2)"""  # noqa: E731
_PROMINENCE = "prominence as (select entity_id, count(*) as prominence from grades group by 1)"


@query("jn01_match_topk", duck("mentions", "registry", "grades", then=_SCORED(0.3) + f""", {_PROMINENCE},
    t as (select mention_id, s.entity_id, score, coalesce(prominence, 0) as prominence, cast(row_number() over (partition by mention_id order by score desc, coalesce(prominence, 0) desc, s.entity_id) as integer) as rank from s left join prominence p on p.entity_id = s.entity_id)
    select mention_id, entity_id, round(score, 6) as score, prominence, rank from t where rank <= 12"""))
def _(t: Tables) -> DataFrame:
    out = M.match_topk(t.mentions, t.registry, E.prominence(t.grades), variant="full_name")
    return out.withColumn("score", F.round("score", 6))


@query("jn02_match_best", duck("mentions", "registry", then=_SCORED(0.7) + """, b as (select *, row_number() over (partition by mention_id order by score desc, entity_id) as r from s)
    select mention_id, entity_id, round(score, 6) as score from b where r = 1"""))
def _(t: Tables) -> DataFrame:
    return M.match_best(t.mentions, t.registry, 0.7, variant="full_name").withColumn("score", F.round("score", 6))


@query("jn03_match_report", duck("mentions", "registry", then=_SCORED(0.5) + """, b as (select *, row_number() over (partition by mention_id order by score desc, entity_id) as r from s),
    t as (select mention_id, max(case when r = 1 then score end) as top, max(case when r = 1 then entity_id end) as e, string_agg(cast(entity_id as varchar), '|' order by r) as near from b where r <= 3 group by 1)
    select m.mention_id, case when top >= 0.85 then 'accepted' else 'unmatched' end as status, case when top >= 0.85 then e end as entity_id, case when coalesce(top, 0) < 0.85 then near end as near from mentions m left join t on t.mention_id = m.mention_id"""))
def _(t: Tables) -> DataFrame:
    out = M.match_report(t.mentions, t.registry, 0.85, floor=0.5, variant="full_name")
    return out.select("mention_id", "status", "entity_id", listed(F.transform("near_misses", lambda x: x["entity"])).alias("near"))


@query("jn04_resolve_pairs", duck("mentions", "registry", then=_SCORED(0.7) + f""", b as (select *, row_number() over (partition by mention_id order by score desc, entity_id) as r from s),
    names as (select {NORMAL("name")} as n, min(mention_id) as m from mentions group by 1), found as (select n, entity_id as e from names join b on b.mention_id = names.m and r = 1),
    facts as (select x.name as a, y.name as b, case when x.mention_id % 3 = 0 then 'taught' else 'heard' end as phrase from mentions x join mentions y on y.mention_id = x.mention_id + 1)
    select distinct case when phrase = 'taught' then q.e else p.e end as student_id, case when phrase = 'taught' then p.e else q.e end as teacher_id, phrase
    from facts join found p on p.n = {NORMAL("a")} join found q on q.n = {NORMAL("b")} where p.e <> q.e"""))
def _(t: Tables) -> DataFrame:
    m = t.mentions
    nxt = m.select((F.col("mention_id") - 1).alias("mention_id"), F.col("name").alias("other"))
    facts = m.join(nxt, "mention_id").select(F.col("name").alias("subject"), "other", F.when(F.col("mention_id") % 3 == 0, "taught").otherwise("heard").alias("phrase"))
    rows = facts.withColumn("mark", F.when(F.col("phrase") == "taught", F.lit(X.TEACHER_PHRASE)).otherwise(F.lit("")))
    return M.resolve_pairs(rows, t.registry, 0.7, phrase="mark", variant="full_name").drop("mark").distinct()


@query("jn05_assign_overlay", duck("mentions", "registry", then=_SCORED(0.85) + """, b as (select *, row_number() over (partition by mention_id order by score desc, entity_id) as r from s),
    t as (select entity_id, mention_id, score, row_number() over (partition by entity_id order by score desc, mention_id) as r from b where r = 1)
    select g.entity_id, t.mention_id % 977 as overlay, round(score, 6) as score from registry g left join t on t.entity_id = g.entity_id and t.r = 1"""))
def _(t: Tables) -> DataFrame:
    inputs = t.mentions.select(F.col("mention_id").alias("input_id"), "name", (F.col("mention_id") % 977).alias("value"))
    return M.assign_overlay(inputs, t.registry, 0.85).select("entity_id", "overlay", F.round("score", 6).alias("score"))


_NOISE, _AFFIXES = ["ring", "bolt", "anvil"], ["ECONOMY", "STANDARD"]
_IDENTITY = lambda c: f"list_distinct(list_filter({WORDS(NORMAL(c))}, lambda x: len(x) >= 2 and x not in {(*_NOISE, *_AFFIXES)!r}))"


@query("jn06_recover", duck("mentions", "registry", then=_SCORED(0.5) + f""", b as (select *, row_number() over (partition by mention_id order by score desc, entity_id) as r from s),
    k as (select b.mention_id, b.entity_id, b.r, {_IDENTITY("m.name")} as x, {_IDENTITY("g.full_name")} as y from b join mentions m on m.mention_id = b.mention_id join registry g on g.entity_id = b.entity_id where b.r <= 30 and len({_IDENTITY("m.name")}) > 0 and len({_IDENTITY("g.full_name")}) > 0),
    j as (select *, greatest(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), case when least(len(x), len(y)) >= 2 and len(list_intersect(x, y)) = least(len(x), len(y)) then 0.65 else 0 end) as score from k),
    o as (select *, row_number() over (partition by mention_id order by score desc, r) as o from j where score >= 0.5)
    select mention_id, entity_id, round(score, 6) as score from o where o = 1"""))
def _(t: Tables) -> DataFrame:
    return M.recover_by_tokens(t.mentions, t.registry, loose=0.5, noise=_NOISE, affixes=_AFFIXES).withColumn("score", F.round("score", 6))


@query("jn22_tag_from_list", duck("mentions", "registry", "grades", then=_SCORED(0.82) + f""", {_PROMINENCE},
    b as (select s.*, row_number() over (partition by mention_id order by score desc, coalesce(prominence, 0) desc, s.entity_id) as r from s left join prominence p on p.entity_id = s.entity_id)
    select entity_id, cast(max(mention_id % 5 + 1) as bigint) as tier, max(struct_pack(a := mention_id % 5 + 1, b := mention_id % 7 = 0)).b as flag, false as unmatched from b where r = 1 group by 1
    union all select mention_id, null, null, true from mentions where mention_id not in (select mention_id from b)"""))
def _(t: Tables) -> DataFrame:
    entries = t.mentions.select(F.col("mention_id").alias("entry_id"), "name", (F.col("mention_id") % 5 + 1).alias("tier"), (F.col("mention_id") % 7 == 0).alias("flag"))
    tags, rest = M.tag_from_list(entries, t.registry, E.prominence(t.grades), variant="full_name")
    missing = rest.select(F.col("entry_id").alias("entity_id"), F.lit(None).cast("long").alias("tier"), F.lit(None).cast("boolean").alias("flag"), F.lit(True).alias("unmatched"))
    return tags.withColumn("unmatched", F.lit(False)).unionByName(missing)
