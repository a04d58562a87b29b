"""Relations of the domain made from the given tables, as SQL that both Spark and DuckDB run.

Names in braces are given tables. Relations build on each other; ``with_clause`` gives those that
a query needs, in order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chainproof.sources.work import written

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: A name of two words for a key of up to five digits: each digit has letters of its place, so that no two
#: names have the same trigrams.
_LETTERS = ("abcdefghij", "klmnopqrst", "uvwxyzABCD", "EFGHIJKLMN", "OPQRSTUVWX")
_DIGITS = [f"translate(substr(lpad(cast({{key}} as string), 5, '0'), {i + 1}, 1), '0123456789', '{x}')" for i, x in enumerate(_LETTERS)]
_CODED = f"concat({', '.join([*_DIGITS, chr(39) + ' ' + chr(39), *_DIGITS[::-1]])})"

RELATIONS: dict[str, str] = {
    # a registry of names, and mentions of them with a word left out or a letter dropped
    "registry": "select p_partkey as entity_id, concat(p_name, ' ', p_brand, ' ', p_type) as full_name from {part}",
    "mentions": "select p_partkey as mention_id, case when p_partkey % 2 = 0 then concat(p_name, ' ', p_type) else concat(substr(p_name, 1, 2), substr(p_name, 4), ' ', p_brand, ' ', p_type) end as name from {part}",
    # graded entities
    "graded_entities": """select c_custkey as entity_id, c_name as full_name,
        case c_custkey % 9 when 0 then 'من العشرة' when 1 then 'تابعي' when 2 then 'الثانية' when 3 then null else 'العاشرة' end as tabaqat,
        case c_custkey % 5 when 0 then '-' when 1 then null else concat(cast(100 + c_custkey % 150 as string), ' هـ') end as death,
        case c_custkey % 7 when 0 then concat(cast(90 + c_custkey % 99 as string), ' هـ') end as death_overlay from {customer}""",
    "grades": """select o_orderkey as grade_id, o_custkey as entity_id, o_orderpriority as source_book,
        case cast(floor(o_totalprice) as bigint) % 8 when 0 then 'companion' when 1 then 'reliable' when 2 then 'mostly_reliable' when 3 then 'weak' when 4 then 'abandoned' when 5 then 'fabricator' when 6 then 'unknown' end as bucket,
        case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then ' ' when o_orderstatus = 'F' then concat('ذكره فلان في ', o_orderpriority) when o_orderstatus = 'O' then concat('ليس بثقة، ', case when o_orderkey % 3 = 0 then 'كثير الخطأ' else 'منكر الحديث' end) else 'صدوق' end as grade_text,
        o_orderdate as at from {orders}""",
    "quotes": """select grade_id as quote_id, entity_id, source_book, concat('critic ', cast(grade_id % 17 as string)) as author, concat('قال: ', coalesce(grade_text, 'لا بأس به')) as verdict
        from grades where grade_id % 3 = 0""",
    # chains: the lines of an order in their order
    "positions": """select chain_id, branch_no, pos, entity_id, name, case when pos + 1 < n then formula end as formula from (select l_orderkey as chain_id, 0 as branch_no,
        cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1 as bigint) as pos, count(*) over (partition by l_orderkey) as n,
        l_suppkey as entity_id, concat(case when (l_orderkey + l_linenumber) % 3 = 0 then 'abu ' else '' end, """ + _CODED.format(key="l_suppkey") + """) as name,
        case concat(l_returnflag, l_linestatus) when 'AF' then 'haddathana' when 'AO' then 'an' when 'NF' then 'samitu' when 'NO' then 'qala' when 'RF' then 'anna' else 'an' end as formula from {lineitem}) x""",
    "chain_entities": """select s_suppkey as entity_id, s_name as full_name,
        case s_suppkey % 11 when 0 then 'صحابي' when 1 then 'تابعي' when 2 then 'الثالثة' when 3 then null else 'السابعة' end as tabaqat,
        case s_suppkey % 6 when 0 then 'ثقة' when 1 then 'ضعيف' when 2 then 'صدوق يخطئ' when 3 then null when 4 then 'متروك' else 'مجهول' end as grade_text,
        case s_suppkey % 5 when 0 then 'reliable' when 1 then 'reliable' when 2 then 'mostly_reliable' when 3 then 'unknown' else null end as bucket,
        case when s_suppkey % 5 = 0 then null when s_suppkey % 7 = 0 then concat(cast(100 + (s_suppkey * 37) % 160 as string), ' هـ ، أو ', cast(108 + (s_suppkey * 37) % 160 as string), ' هـ') else concat(cast(100 + (s_suppkey * 37) % 160 as string), ' هـ') end as death,
        case when s_suppkey % 4 = 0 then s_suppkey % 5 + 1 end as tadlis_tier, s_suppkey % 10 = 3 as practices_taswiya,
        case when s_suppkey % 9 = 0 then null when s_suppkey % 2 = 0 then concat(n_name, '، ', 'NATION_', cast((n_nationkey + 1) % 25 as string)) else n_name end as cities
        from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "pairs": """select chain_id, branch_no, from_pos, student_id, teacher_id, formula from (
        select chain_id, branch_no, pos as from_pos, entity_id as student_id, lead(entity_id) over (partition by chain_id order by pos) as teacher_id, formula from positions) x where teacher_id is not null""",
    "edge_books": """select distinct student_id, teacher_id, o_orderpriority as book from pairs join {orders} on o_orderkey = chain_id
        where student_id <> teacher_id and (31 * student_id + 17 * teacher_id) % 10 < 4""",
    "edge_pairs": "select distinct student_id, teacher_id from edge_books",
    "denials": """select student_id * 1000000 + teacher_id as denial_id, student_id, teacher_id, case when (student_id + teacher_id) % 2 = 0 then 'jami_al_tahsil' else 'tahdhib' end as source_book, 'لم يسمع منه' as phrase
        from edge_pairs where (student_id * 7 + teacher_id * 3) % 23 = 0""",
    "verbs": """select student_id * 10000000 + teacher_id * 10 as attestation_id, student_id, teacher_id, case (student_id + 2 * teacher_id) % 6 when 0 then 'samaa' when 1 then 'liqa' when 2 then 'idraka' when 3 then 'rawa' when 4 then 'kataba' else 'other' end as verb, 'tarikh' as source_book, 'سمع منه' as phrase
        from edge_pairs where (student_id * 5 + teacher_id) % 6 < 4
        union all select student_id * 10000000 + teacher_id * 10 + 1, student_id, teacher_id, 'rawa', 'thiqat', null from edge_pairs where (student_id + teacher_id) % 3 = 0""",
    # the spellings of chain entities
    "chain_variants": "select s_suppkey as entity_id, " + _CODED.format(key="s_suppkey") + " as variant from {supplier} union all select s_suppkey, concat('abu ', " + _CODED.format(key="s_suppkey") + ") from {supplier}",
    # a corpus, and passages to look for
    "corpus": "select doc_id as text_id, source as book_id, text from {documents}",
    "passages": "select item_id as passage_id, text from {benchmark}",
    # the chains of the orders of a part
    "parsed": """select l_partkey as passage_id, l_orderkey as chain_id, min(l_quantity) as score from {lineitem} group by l_partkey, l_orderkey""",
    "books": """select 'daraqutni_mawsuah' as book, 'D' as title, '385 هـ' as author_death, 1 as ord union all select '1-URGENT', 'Urgent', '852 هـ', 2 union all select '2-HIGH', 'High', '327 هـ', 3
        union all select '3-MEDIUM', 'Medium', null, 4 union all select 'tahdhib', 'Tahdhib', '742 هـ', 5 union all select 'jami_al_tahsil', 'Jami', '761 هـ', 6""",
}

GIVEN_NAMES = {t: t for t in GIVEN}


#: Relations that many others build on: a query that uses one writes it and reads it from then on.
SHARED = ("positions", "edge_books")


def with_clause(*names: str, made: tuple[str, ...] = ()) -> str:
    """"with a as (...), b as (...)" of the relations and what they build on; braces are kept. Those in
    ``made`` are read as given tables of their own."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in order:
            return
        for m in RELATIONS if n not in made else ():
            if m != n and re.search(rf"\b(?:from|join)\s+{m}\b", RELATIONS[n]):
                add(m)
        order.append(n)

    for n in names:
        add(n)
    return "with " + ", ".join(f"{n} as (select * from {{{n}}})" if n in made else f"{n} as ({RELATIONS[n]})" for n in order)


def duck(*names: str, then: str) -> str:
    """DuckDB SQL: the relations, then a query over them (which may begin with further ones)."""
    head = with_clause(*names).format(**GIVEN_NAMES) if names else ""
    if then.lstrip().startswith("with "):
        then = then.lstrip()[5:]
        if head and then.startswith("recursive "):
            head, then = head.replace("with ", "with recursive ", 1), then[10:]
        return f"{head}, {then}" if head else f"with {then}"
    return f"{head} {then}"


class Tables:
    """The given tables and the relations made of them, as DataFrames. What a query uses more than once is
    written on its first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table ``name`` of this query, made and written on its first use."""
        if name not in self.made:
            self.made[name] = written(make(), name)
        return self.made[name]

    def _sql(self, name: str) -> DataFrame:
        # shared relations that this one builds on come first
        on = [m for m in SHARED if m != name and re.search(rf"\b{m} as \(", with_clause(name))]
        for m in on:
            getattr(self, m)
        made = tuple(m for m in self.made if m in on)
        sql = f"{with_clause(name, made=made)} select * from {name}"
        used = {t: self.given(t) for t in GIVEN if "{" + t + "}" in sql} | {m: self.made[m] for m in made if "{" + m + "}" in sql}
        return self.spark.sql(sql, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.given(name)
        if name not in RELATIONS:
            raise AttributeError(name)
        return self.once(name, lambda: self._sql(name)) if name in SHARED else self._sql(name)
