"""Further registered queries: joins of evidence, chains, passages, parsing, classifiers, state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chainproof.functions import lexicons as X
from chainproof.functions import rules
from chainproof.functions import similarity as S
from chainproof.functions import text as T
from chainproof.operators import chains as C
from chainproof.operators import evidence as E
from chainproof.operators import parse as P
from chainproof.operators import passages as A
from chainproof.plans.queries import _GRADED, _PROMINENCE, _PROTECTED, _paragraphs, GRAMS, NORMAL, SQL, TIER, WORDS, graded, harshest, listed, query
from chainproof.plans.standins import Tables, duck
from chainproof.sources.tables import BucketedTable
from chainproof.sources.work import new_path, written
from chainproof.streaming import state as ST

# Joins of evidence

_YEARS = "list_filter(list_transform(regexp_extract_all(coalesce(nullif({0}, '-'), ''), '[0-9]+'), lambda x: cast(x as integer)), lambda y: y > 0 and y < 2000)"
_LINKS = f"""
    , books_of as (select student_id, teacher_id, string_agg(book, '|' order by book) as source_books, count(*) as n_books from edge_books where student_id > 0 and teacher_id > 0 group by 1, 2),
    denied as (select student_id, teacher_id, arg_min(source_book, denial_id) as denial_book, arg_min(phrase, denial_id) as denial_phrase from denials group by 1, 2),
    ranked as (select *, row_number() over (partition by student_id, teacher_id order by case verb when 'samaa' then 5 when 'liqa' then 4 when 'idraka' then 3 when 'rawa' then 2 when 'kataba' then 1 end desc, attestation_id) as r from verbs where verb <> 'other'),
    strongest as (select student_id, teacher_id, verb, source_book as verb_book, phrase as verb_phrase from ranked where r = 1),
    y as (select *, {_YEARS.format("death")} as years from chain_entities),
    l0 as (select p.*, not (student_id = 7 and from_pos % 3 = 0) and not (teacher_id = 7 and (from_pos + 1) % 3 = 0) as resolved, source_books, n_books, n_books is not null as is_edge, denial_book, denial_phrase, verb, verb_book, verb_phrase,
        case when len(s.years) = 0 or len(t.years) = 0 then 'unknown' when list_min(s.years) - list_max(t.years) > 93 or list_min(t.years) - list_max(s.years) > 100 then 'impossible' else 'possible' end as dates,
        coalesce(s.tadlis_tier >= 3 and formula in ('an', 'anna', 'qala'), false) and not coalesce(verb = 'samaa', false) as tadlis_concern
        from pairs p left join books_of b using (student_id, teacher_id) left join denied d using (student_id, teacher_id) left join strongest v using (student_id, teacher_id)
        left join y s on s.entity_id = student_id left join y t on t.entity_id = teacher_id),
    links as (select *, case when not resolved then 'unknown' when dates = 'impossible' or denial_book is not null then 'impossible' when is_edge then 'attested' else dates end as status from l0)"""
_L = ("pairs", "edge_books", "denials", "verbs", "chain_entities")


def edges_with_books(t: Tables) -> DataFrame:
    return t.edge_books.groupBy("student_id", "teacher_id").agg(F.sort_array(F.collect_set("book")).alias("books"))


def links(t: Tables) -> DataFrame:
    """The links of all chains with their evidence and status, made once for a query."""
    return t.once("links", lambda: _links_of(t))


def _links_of(t: Tables) -> DataFrame:
    years = t.chain_entities.select("entity_id", T.parse_years(F.col("death")).alias("years"), "tadlis_tier")
    out = E.lookup_strongest_verb(E.lookup_negative(E.lookup_edges(C.chain_links(t.positions), edges_with_books(t)), t.denials), t.verbs)
    out = out.join(years.select(F.col("entity_id").alias("student_id"), F.col("years").alias("sy"), "tadlis_tier"), "student_id", "left").join(years.select(F.col("entity_id").alias("teacher_id"), F.col("years").alias("ty")), "teacher_id", "left")
    dates = rules.check_dates(F.col("sy"), F.col("ty"))
    unmatched = lambda who, pos: (F.col(who) == 7) & (pos % 3 == 0)  # noqa: E731  as in graded_positions
    resolved = ~unmatched("student_id", F.col("from_pos")) & ~unmatched("teacher_id", F.col("from_pos") + 1)
    status = rules.link_status(resolved, F.col("dates"), F.col("denial_book").isNotNull(), F.col("is_edge"))
    concern = rules.tadlis_concern(F.col("tadlis_tier"), T.formula_strength(F.col("formula")), F.col("verb"))
    return out.withColumn("dates", dates).withColumns({"status": status, "tadlis_concern": concern}).drop("sy", "ty", "tadlis_tier")


@query("jn09_cl03_links", duck(*_L, then=_LINKS + " select chain_id, from_pos, student_id, teacher_id, formula, source_books, denial_book, verb, verb_book, dates, status, tadlis_concern from links"))
def _(t: Tables) -> DataFrame:
    out = links(t).withColumn("source_books", listed("source_books"))
    return out.select("chain_id", "from_pos", "student_id", "teacher_id", "formula", "source_books", "denial_book", "verb", "verb_book", "dates", "status", "tadlis_concern")


@query("cl16_link_reason", duck(*_L, "books", then=_LINKS + f""",
    r as (select chain_id, from_pos, case when dates = 'impossible' then 'dates: impossible'
        when denial_book is not null then 'denied: ' || case denial_book when 'jami_al_tahsil' then '{X.DENIAL_AUTHORS["jami_al_tahsil"]}' when 'tahdhib' then '{X.DENIAL_AUTHORS["tahdhib"]}' end || ' | ' || coalesce(b.title, denial_book) || ' | ' || denial_phrase
        when is_edge then 'edge: ' || array_to_string(list_transform(string_split(source_books, '|')[1:3], lambda k: case k when '1-URGENT' then 'Urgent' when '2-HIGH' then 'High' when '3-MEDIUM' then 'Medium' else k end), '; ')
            || case when verb is not null then ' | ' || case verb {" ".join(f"when '{k}' then '{v}'" for k, v in X.VERB_LABELS.items())} end || ' | ' || verb_book || coalesce(' | ' || verb_phrase, '') else '' end
        else 'dates: ' || dates end || case when tadlis_concern then ' | ambiguous' else '' end as reason from links left join books b on b.book = denial_book)
    select * from r"""))
def _(t: Tables) -> DataFrame:
    return C.link_reason(links(t), t.books).select("chain_id", "from_pos", "reason")


@query("jn13_valid_edges", duck("edge_pairs", then="select distinct student_id, teacher_id from edge_pairs where student_id in (select s_suppkey from supplier where s_suppkey % 7 > 0) and teacher_id in (select s_suppkey from supplier where s_suppkey % 7 > 0)"))
def _(t: Tables) -> DataFrame:
    return E.valid_edges(t.edge_pairs, t.supplier.where("s_suppkey % 7 > 0"), "s_suppkey")


@query("jn14_edge_attestation", duck("edge_pairs", "grades", then="""
    , b as (select distinct entity_id, source_book from grades)
    select student_id, teacher_id, coalesce(string_agg(x.source_book, '|' order by x.source_book), '') as books from edge_pairs left join b x on x.entity_id = student_id and exists (select 1 from b y where y.entity_id = teacher_id and y.source_book = x.source_book) group by 1, 2"""))
def _(t: Tables) -> DataFrame:
    return E.edge_attestation(t.edge_pairs, t.grades).withColumn("books", listed("books"))


@query("jn15_top_neighbours", duck("edge_pairs", "grades", then=f""", {_PROMINENCE},
    r as (select student_id as entity_id, teacher_id, coalesce(prominence, 0) as p, row_number() over (partition by student_id order by coalesce(prominence, 0) desc, teacher_id) as r from edge_pairs left join prominence on entity_id = teacher_id)
    select entity_id, string_agg(teacher_id || ':' || p, '|' order by r) as neighbours from r where r <= 20 group by 1"""))
def _(t: Tables) -> DataFrame:
    out = E.top_neighbours(t.edge_pairs, E.prominence(t.grades))
    return out.withColumn("neighbours", listed(F.transform("neighbours", lambda x: F.concat_ws(":", x["id"].cast("string"), x["prominence"].cast("string")))))


@query("jn16_geo_overlap", duck("edge_pairs", "chain_entities", then="""
    , c as (select entity_id, list_filter(list_transform(string_split(coalesce(cities, ''), '،'), lambda x: trim(x)), lambda x: x <> '' and x <> '-') as c from chain_entities),
    x as (select student_id, teacher_id, a.c as a, b.c as b from edge_pairs join c a on a.entity_id = student_id join c b on b.entity_id = teacher_id)
    select student_id, teacher_id, case when len(a) = 0 or len(b) = 0 then 'unknown' when len(list_intersect(a, b)) > 0 then 'overlap' else 'no_overlap' end as status, array_to_string(list_sort(list_intersect(a, b)), '|') as shared,
        array_to_string(list_filter(a, lambda v: v <> ''), '، ') || case when len(a) > 0 and len(list_filter(b, lambda v: not list_contains(a, v))) > 0 then '، ' else '' end || array_to_string(list_filter(b, lambda v: not list_contains(a, v)), '، ') as together from x"""))
def _(t: Tables) -> DataFrame:
    e = t.chain_entities
    rows = t.edge_pairs.join(e.select(F.col("entity_id").alias("student_id"), F.col("cities").alias("a")), "student_id").join(e.select(F.col("entity_id").alias("teacher_id"), F.col("cities").alias("b")), "teacher_id")
    g = E.geo_overlap(F.col("a"), F.col("b"))
    return rows.select("student_id", "teacher_id", g["status"].alias("status"), listed(F.sort_array(g["shared"])).alias("shared"), F.coalesce(T.combine_cities(F.col("a"), F.col("b")), F.lit("")).alias("together"))


@query("jn17_entity_profile", duck("graded_entities", "grades", "edge_pairs", then=_GRADED("summary") + f""",
    v as (select entity_id, string_agg(distinct source_book, '|' order by source_book) as variants from grades group by 1),
    g as (select entity_id, string_agg(source_book || ':' || coalesce(bucket, '~'), '|' order by {TIER("bucket")} desc, grade_id) as grades from grades group by 1),
    a as (select student_id as entity_id, string_agg(teacher_id, '|' order by teacher_id) as teachers from edge_pairs group by 1), b as (select teacher_id as entity_id, string_agg(student_id, '|' order by student_id) as students from edge_pairs group by 1),
    d as (select entity_id, max({TIER("bucket")}) - min({TIER("bucket")}) as tier_spread from graded group by 1)
    select e.entity_id, variants, grades, teachers, students, tier_spread from graded_entities e left join v using (entity_id) left join g using (entity_id) left join a using (entity_id) left join b using (entity_id) left join d using (entity_id)"""))
def _(t: Tables) -> DataFrame:
    variants = t.grades.select("entity_id", F.col("source_book").alias("variant"))
    out = E.entity_profile(t.graded_entities.select("entity_id"), variants, t.grades, t.edge_pairs, graded(t, "summary"))
    spelt = listed(F.transform("grades", lambda x: F.concat_ws(":", x["source_book"], F.coalesce(x["bucket"], F.lit("~")))))
    return out.select("entity_id", listed("variants").alias("variants"), spelt.alias("grades"), listed("teachers").alias("teachers"), listed("students").alias("students"), "tier_spread")


_RULES = [(1, "%00000001%", "one"), (2, "Customer#0000000%5", "five"), (3, "%7%", "seven")]


@query("jn18_tag_by_rules", duck("graded_entities", then="select * from (select entity_id, case when full_name like '%00000001%' then 'one' when full_name like 'Customer#0000000%5' then 'five' when full_name like '%7%' then 'seven' end as reason from graded_entities) where reason is not null"))
def _(t: Tables) -> DataFrame:
    return E.tag_by_rules(t.graded_entities, t.spark.createDataFrame(_RULES, "ord int, pattern string, reason string"))


_ORDER = "case book when 'daraqutni_mawsuah' then 1 when '2-HIGH' then 2 when 'tahdhib' then 3 when 'jami_al_tahsil' then 4 when '1-URGENT' then 5 else 6 end"


def ordered_books(t: Tables) -> DataFrame:
    return E.display_order(t.books, ["daraqutni_mawsuah"]).select("book", "display_order")


@query("tk04_display_order", duck(then="""
    with b as (select n_name as book, n_nationkey as ord, case when n_nationkey % 6 > 0 then (n_nationkey * 37) % 900 end as year, list_position(['NATION_7', 'NATION_3', 'NATION_19'], n_name) as q from nation)
    select book, cast(row_number() over (order by coalesce(q, 4), case when q is null then coalesce(year, 9999) else 0 end, ord) as integer) as display_order from b"""))
def _(t: Tables) -> DataFrame:
    year = F.when(F.col("n_nationkey") % 6 > 0, F.concat((F.col("n_nationkey") * 37 % 900).cast("string"), F.lit(" هـ")))
    books = t.nation.select(F.col("n_name").alias("book"), year.alias("author_death"), F.col("n_nationkey").alias("ord"))
    return E.display_order(books, ["NATION_7", "NATION_3", "NATION_19"]).select("book", "display_order")


@query("jn19_book_grid", duck("graded_entities", "grades", "books", then=f"""
    , s as (select entity_id, source_book, min(grade_text) as text from grades where grade_text is not null group by 1, 2)
    select e.entity_id, string_agg(coalesce(s.text, '~'), '|' order by {_ORDER}) as grid, count(s.text) as filled, count(*) as total from graded_entities e cross join books left join s on s.entity_id = e.entity_id and s.source_book = book group by 1"""))
def _(t: Tables) -> DataFrame:
    said = t.grades.where("grade_text is not null").groupBy("entity_id", F.col("source_book").alias("book")).agg(F.min("grade_text").alias("text"))
    out = E.book_grid(t.graded_entities, said, ordered_books(t))
    return out.select("entity_id", listed(F.transform("grid", lambda x: x["text"])).alias("grid"), F.col("filled").cast("long").alias("filled"), F.col("total").cast("long").alias("total"))


_HARSH = _GRADED("harshest") + f""", w as (select *, row_number() over (partition by entity_id order by {TIER("bucket")}, length(grade_text) desc nulls first, grade_id) as r from graded), worst as (select * from w where r = 1)"""


@query("jn21_attribute_verdict", duck("graded_entities", "grades", "quotes", then=_HARSH + """,
    f as (select w.entity_id, q.author, row_number() over (partition by w.entity_id order by q.quote_id) as k from worst w join quotes q on q.entity_id = w.entity_id and q.source_book = w.source_book and length(trim(w.grade_text)) > 0 and contains(q.verdict, trim(w.grade_text)))
    select w.entity_id, f.author from worst w left join f on f.entity_id = w.entity_id and k = 1"""))
def _(t: Tables) -> DataFrame:
    return E.attribute_verdict(harshest(t), t.quotes)


@query("jn23_reasons_table", duck("graded_entities", "grades", "quotes", then=_HARSH + f""",
    q as (select entity_id, author, min(quote_id) as o from quotes group by 1, 2), k as (select *, row_number() over (partition by entity_id order by o) as r from q), c as (select entity_id, string_agg(author, '|' order by r) as critics from k where r <= 3 group by 1),
    p as (select entity_id, bucket, array_to_string(list_filter([{", ".join(f"case when regexp_matches(grade_text, '{p}') then '{r}' end" for p, r, _ in X.REASONS)}], lambda x: x is not null), '|') as reasons from worst)
    select p.entity_id, reasons, coalesce(critics, '') as critics, bucket in ('weak', 'abandoned', 'fabricator') as disqualifying from p left join c using (entity_id) where reasons <> ''"""))
def _(t: Tables) -> DataFrame:
    h = harshest(t)
    flagged = h.withColumn("reasons", T.tag_reasons(F.coalesce("grade_text", F.lit("")))).where("size(reasons) > 0")
    out = E.reasons_table(flagged.select("entity_id", "reasons"), t.quotes, h)
    return out.select("entity_id", listed("reasons").alias("reasons"), listed("critics").alias("critics"), "disqualifying")


@query("so01_all_verdicts", duck("grades", "quotes", then="""
    , u as (select entity_id, 0 as sort, quote_id as ord, verdict as text from quotes union all select entity_id, 1, grade_id, grade_text from grades where coalesce(trim(nullif(grade_text, '-')), '') <> '')
    select entity_id, string_agg(text, '|' order by sort, ord) as verdicts from u group by 1"""))
def _(t: Tables) -> DataFrame:
    return E.all_verdicts(t.quotes, t.grades).withColumn("verdicts", listed(F.transform("verdicts", lambda x: x["text"])))


@query("so02_edge_union", duck("edge_pairs", then="select student_id, teacher_id from edge_pairs union select teacher_id, student_id from edge_pairs where student_id % 2 = 0"))
def _(t: Tables) -> DataFrame:
    e = t.edge_pairs
    return E.edge_union(e, e.where("student_id % 2 = 0").select(F.col("teacher_id").alias("student_id"), F.col("student_id").alias("teacher_id")))


_SHORT = lambda c: f"array_to_string({WORDS(f"regexp_replace({c}, '[،:]', ' ', 'g')")}[1:3], ' ')"


@query("jn12_cooccurrence", duck(then=f"""
    with d as (select doc_id, source, {NORMAL("text")} as t from documents where text is not null), w as (select {WORDS("t")} as w from d),
    p as (select distinct {NORMAL(_SHORT("array_to_string(w[1:3], ' ')"))} as a, {NORMAL(_SHORT("array_to_string(w[4:6], ' ')"))} as b from w),
    q as (select * from p where length(a) >= 6 and length(b) >= 6), n as (select a as name from q union select b from q),
    f as (select name, doc_id, source from n join d on contains(t, name)),
    c as (select a as student_name, b as teacher_name, x.source as book_id, count(*) as n from q join f x on x.name = a join f y on y.name = b and y.doc_id = x.doc_id group by 1, 2, 3),
    r as (select *, row_number() over (partition by student_name, teacher_name order by n desc, book_id) as r from c)
    select student_name, teacher_name, book_id, n, cast(sum(n) over (partition by student_name, teacher_name) as bigint) as total from r where r <= 18"""))
def _(t: Tables) -> DataFrame:
    """The first three words of every text and the next three, as names of a pair."""
    # a text is normalised and its head cut off once, not again for each condition on a name
    heads = t.once("heads", lambda: t.documents.select(F.slice(F.split(T.normalize(F.col("text")), " ", 7), 1, 6).alias("w")))
    pairs = heads.select(F.array_join(F.slice("w", 1, 3), " ").alias("student_name"), F.array_join(F.slice("w", 4, 3), " ").alias("teacher_name"))
    return E.cooccurrence(pairs, t.documents, key="doc_id", book="source")


# Decisions


@query("jn07_apply_decisions", duck("positions", then="""
    select chain_id, cast(branch_no as integer) as branch_no, pos, case when pos % 4 <> 3 and entity_id % 5 = 0 then entity_id end as entity_id, case when pos % 4 = 3 then 'not_found' when entity_id % 5 = 0 then 'matched' else 'needs_review' end as status,
        case when pos % 4 <> 3 and entity_id % 5 = 0 then case entity_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end end as confidence from positions"""))
def _(t: Tables) -> DataFrame:
    p = t.positions
    candidates = p.where("pos % 4 <> 3").select("chain_id", "branch_no", "pos", "entity_id")
    chosen = F.when(F.col("entity_id") % 5 == 0, F.col("entity_id")).otherwise(-5)
    confidence = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("surely")), (F.col("entity_id") % 3 + 1).cast("int"))
    decisions = p.select("chain_id", "branch_no", "pos", chosen.alias("chosen_id"), confidence.alias("confidence"), F.lit(0).alias("ord"))
    return C.apply_decisions(p.select("chain_id", "branch_no", "pos"), candidates, decisions)


@query("jn08_disambiguate", duck("positions", "edge_pairs", "chain_entities", then=f"""
    with recursive y as (select entity_id, list_min({_YEARS.format("death")}) as year from chain_entities),
    c0 as (select chain_id, pos, entity_id, 900000 as m from positions union all select chain_id, pos, (entity_id + 1) % (select count(*) from supplier), 800000 + (chain_id + pos) % 3 * 100000 from positions),
    c as (select chain_id, pos, entity_id, max(m) as m, any_value(year) as year from c0 left join y using (entity_id) group by 1, 2, 3),
    w as (select c.chain_id, c.pos, c.entity_id as e, s.entity_id as s, max(case when e.student_id is not null then 2 else 0 end + case when e.student_id is not null and (e.student_id + e.teacher_id) % 4 = 0 then 4 else 0 end + case when abs(s.year - c.year) <= 80 then 1 else 0 end) as w
        from c join c s on s.chain_id = c.chain_id and s.pos = c.pos - 1 left join edge_pairs e on e.student_id = s.entity_id and e.teacher_id = c.entity_id group by 1, 2, 3, 4),
    t as (select chain_id, pos, list({{'s': s, 'e': e, 'w': w}}) as links from w group by 1, 2),
    n as (select chain_id, pos, list({{'e': entity_id, 'm': m}}) as nodes from c group by 1, 2),
    st as (
        select chain_id, pos, list_transform(nodes, lambda x: {{'w': cast(0 as bigint), 'm': cast(-x.m as bigint), 'path': [cast(x.e as bigint)], 'weights': [cast(0 as bigint)]}}) as ways from n where pos = 0
        union all
        select chain_id, pos, list_transform(nodes, lambda x: list_min(list_transform(ways, lambda a:
            {{'w': cast(a.w - coalesce(list_max(list_transform(list_filter(links, lambda k: k.s = a.path[len(a.path)] and k.e = x.e), lambda k: k.w)), 0) as bigint), 'm': cast(a.m - x.m as bigint), 'path': list_append(a.path, cast(x.e as bigint)),
              'weights': list_append(a.weights, cast(coalesce(list_max(list_transform(list_filter(links, lambda k: k.s = a.path[len(a.path)] and k.e = x.e), lambda k: k.w)), 0) as bigint))}})))
        from (select st.chain_id, n.pos, n.nodes, st.ways, t.links from st join n on n.chain_id = st.chain_id and n.pos = st.pos + 1 join t on t.chain_id = n.chain_id and t.pos = n.pos)),
    b as (select chain_id, list_min(arg_max(ways, pos)) as b from st group by 1),
    i as (select chain_id, b, unnest(range(len(b.path))) as pos from b)
    select chain_id, 0 as branch_no, pos, b.path[pos + 1] as entity_id, b.weights[pos + 1] + coalesce(b.weights[pos + 2], 0) as support from i"""))
def _(t: Tables) -> DataFrame:
    p, n = t.positions.select("chain_id", "branch_no", "pos", "entity_id"), t.supplier.count()
    other = p.withColumn("score", 0.8 + (F.col("chain_id") + F.col("pos")) % 3 * 0.1).withColumn("entity_id", (F.col("entity_id") + 1) % n)
    candidates = p.withColumn("score", F.lit(0.9)).unionByName(other)
    years = t.chain_entities.select("entity_id", F.array_min(T.parse_years(F.col("death"))).alias("year"))
    hints = t.edge_pairs.where("(student_id + teacher_id) % 4 = 0").select(F.col("teacher_id").alias("entity_id"), "student_id")
    return C.disambiguate(candidates, t.edge_pairs, years, hints)


# Chains and classifiers

_EFFECTIVE = f"""case when {_PROTECTED("grade", "e.tabaqat", "e.grade_text", "e.bucket")} then 'companion'
    when s is null or {TIER("coalesce(bucket, 'unknown')")} <= {TIER("s")} then coalesce(bucket, 'unknown') else s end"""
_GRADE = f""", said as (select *, case {" ".join(f"when regexp_matches(coalesce(grade_text, ''), '{p}') then '{b}'" for p, b in X.SEVERITY)} end as s from chain_entities),
    eg as (select entity_id, {_EFFECTIVE} as grade, tabaqat, grade_text, bucket from said e)"""


def entity_grades(t: Tables) -> DataFrame:
    c = F.col
    return t.chain_entities.withColumn("grade", rules.effective_grade(c("tabaqat"), c("grade_text"), c("bucket"), F.lit(None).cast("string")))


def graded_positions(t: Tables) -> DataFrame:
    """Positions with effective grade and status; every third position of entity 7 is unmatched."""
    grades = entity_grades(t).select("entity_id", "grade", "grade_text", "tabaqat", "bucket")
    status = F.when((F.col("entity_id") == 7) & (F.col("pos") % 3 == 0), "needs_review").otherwise("matched")
    return t.positions.join(grades, "entity_id", "left").withColumns({"status": status, "grade_book": F.lit("taqrib")})


_POSITIONS = _GRADE + """, gp as (select p.*, grade, tabaqat, grade_text, bucket, case when p.entity_id = 7 and pos % 3 = 0 then 'needs_review' else 'matched' end as status from positions p left join eg using (entity_id))"""
_VERDICT = _POSITIONS + """,
    pv as (select chain_id, bool_or(coalesce(grade in ('weak', 'abandoned', 'fabricator'), false)) as weak, bool_and(status = 'matched') as matched, bool_and(coalesce(grade in ('prophet', 'companion', 'reliable'), false)) as sound,
        count(*) filter (coalesce(grade, 'unknown') = 'unknown') as n_unknown, count(*) as n_positions from gp group by 1),
    lv as (select chain_id, bool_or(status = 'impossible') as broken, bool_and(status in ('attested', 'possible')) as known from links group by 1),
    verdicts as (select chain_id, case when coalesce(broken, false) then 'broken' when weak then 'daif' when not matched or not coalesce(known, true) then 'needs_review' when sound then 'sahih_candidate' else 'hasan_candidate' end as verdict, n_unknown, n_positions from pv left join lv using (chain_id))"""
_V = (*_L, "positions")


@query("cl04_effective_grade", duck("chain_entities", then=_GRADE + " select entity_id, grade from eg"))
def _(t: Tables) -> DataFrame:
    return entity_grades(t).select("entity_id", "grade")


@query("cl05_chain_verdicts", duck(*_V, then=_LINKS + _VERDICT + " select chain_id, 0 as branch_no, verdict, n_unknown, n_positions from verdicts"))
def chain_verdicts(t: Tables) -> DataFrame:
    return C.chain_verdicts(graded_positions(t), links(t))


@query("wn05_cl06_breaks", duck(*_L, then=_LINKS + """
    , b as (select chain_id, count(*) filter (status = 'impossible') as breaks, min(from_pos) filter (status = 'impossible') as first_break, max(from_pos) filter (status = 'impossible') as last_break from links group by 1)
    select *, case when breaks = 0 then 'none' when first_break = 0 then 'muallaq' when breaks > 1 and last_break - first_break + 1 = breaks then 'mudal' else 'munqati' end as break_type from b"""))
def _(t: Tables) -> DataFrame:
    return C.break_runs(links(t)).drop("branch_no")


@query("ag08_attestation", duck(*_L, then=_LINKS + """
    , a as (select chain_id, count(*) as links, count(*) filter (status = 'attested') as attested, count(*) filter (verb = 'samaa') as heard from links group by 1)
    select *, case when heard = links then 'all_heard' when heard > 0 then 'some_heard' when attested = links then 'all_attested' when attested > 0 then 'some_attested' else 'none' end as strength from a"""))
def _(t: Tables) -> DataFrame:
    return C.attestation_summary(links(t)).drop("branch_no")


_TADLIS = """, inst as (select chain_id, 'ambiguous' as kind, from_pos as pos from links where tadlis_concern union all select chain_id, 'taswiya', pos from positions join chain_entities using (entity_id) where practices_taswiya and formula in ('an', 'anna', 'qala')),
    ts as (select chain_id, string_agg(kind || ':' || pos, '|' order by kind, pos) as instances, bool_or(kind = 'ambiguous') as has_ambiguous, bool_or(kind = 'taswiya') as has_taswiya from inst group by 1)"""


def tadlis(t: Tables) -> DataFrame:
    return C.tadlis_summary(links(t), t.positions, t.chain_entities)


@query("ag09_tadlis", duck(*_V, then=_LINKS + _TADLIS + " select * from ts"))
def _(t: Tables) -> DataFrame:
    return tadlis(t).drop("branch_no").withColumn("instances", listed(F.transform("instances", lambda x: F.concat_ws(":", x["kind"], x["pos"].cast("string")))))


@query("ag10_reasons_by_position", duck("positions", "chain_entities", then=_POSITIONS + f""",
    r as (select chain_id, pos, list_filter([{", ".join(f"case when regexp_matches(coalesce(grade_text, ''), '{p}') then '{r}' end" for p, r, _ in X.REASONS)}], lambda x: x is not null) as r from gp)
    select chain_id, pos, array_to_string(r, '|') as reasons, len(list_intersect(r, ['kidhb', 'tuhmat_kidhb', 'fisq', 'jahala', 'bidaa'])) > 0 as against_probity from r where len(r) > 0"""))
def _(t: Tables) -> DataFrame:
    return C.reasons_by_position(graded_positions(t)).drop("branch_no").withColumn("reasons", listed("reasons"))


@query("cl13_conditions", duck(*_V, then=_LINKS + _VERDICT + _TADLIS + """,
    w as (select chain_id, verdict, weak, coalesce(has_ambiguous or has_taswiya, false) as risk, coalesce((select bool_or(verb = 'samaa') from links l where l.chain_id = v.chain_id), false) as heard from verdicts v join pv using (chain_id) left join ts using (chain_id))
    select chain_id, 1 as ord, 'connection' as condition, verdict <> 'broken' as ok from w union all select chain_id, 2, 'probity', not weak from w union all select chain_id, 3, 'clearance', heard from w where risk union all select chain_id, 4, 'disclaimer', true from w"""))
def _(t: Tables) -> DataFrame:
    return C.conditions(chain_verdicts(t), tadlis(t), links(t), graded_positions(t)).drop("branch_no")


@query("cl14_explain", duck(*_V, then=_LINKS + _VERDICT + """,
    w as (select chain_id, arg_min('weak | ' || entity_id || coalesce(' | ' || grade_text, '') || ' | taqrib', pos) as t from gp where grade in ('weak', 'abandoned', 'fabricator') group by 1),
    e as (select chain_id, arg_min('denied | ' || student_id || ' > ' || teacher_id || ' | ' || denial_phrase, from_pos) filter (denial_phrase is not null and status = 'impossible') as d, arg_min('dates | ' || student_id || ' > ' || teacher_id, from_pos) filter (status = 'impossible') as i,
        arg_min('heard | ' || student_id || ' > ' || teacher_id, from_pos) filter (verb = 'samaa') as h, arg_min('books | ' || n_books, from_pos) filter (n_books >= 2) as b from links group by 1)
    select chain_id, verdict, case when verdict = 'daif' then w.t when verdict = 'broken' then coalesce(d, i) when verdict like '%candidate' then coalesce(h, b) end as explanation from verdicts left join w using (chain_id) left join e using (chain_id)"""))
def _(t: Tables) -> DataFrame:
    return C.explain(chain_verdicts(t), graded_positions(t), links(t)).drop("branch_no")


@query("cl15_narrative", duck("positions", then="""
    , w as (select chain_id, pos, list_filter(regexp_split_to_array(name, '\\s+'), lambda x: x <> '') as w from positions where entity_id > 0),
    n as (select *, array_to_string(w[1:4], ' ') as a, count(*) over (partition by chain_id) as n from w), l as (select *, lag(a) over (partition by chain_id order by pos desc) as b, row_number() over (partition by chain_id order by pos desc) as k from n where n >= 2)
    select chain_id, string_agg(case when k = 1 then 'تفرَّد به ' || a || ' عن ' || coalesce(b, 'النبي ﷺ') else 'ثم تفرَّد به ' || a || ' عن ' || b end, '، ' order by k) as narrative from l group by 1"""))
def _(t: Tables) -> DataFrame:
    return C.solitary_narrative(t.positions).drop("branch_no")


@query("cl17_tadlis_ruling", duck(*_V, then=_LINKS + _TADLIS + """,
    m as (select p.chain_id, string_agg(p.pos || ':' || tadlis_tier || ':' || coalesce(l.verb = 'samaa', false), '|' order by p.pos) as listed from positions p join chain_entities e on e.entity_id = p.entity_id and tadlis_tier is not null left join links l on l.chain_id = p.chain_id and l.from_pos = p.pos group by 1)
    select c.chain_id, case when listed is null then 'clean' when has_taswiya then 'disqualifying' when has_ambiguous then 'suspended' else 'harmless' end as ruling, listed from (select distinct chain_id from positions) c left join m using (chain_id) left join ts using (chain_id)"""))
def _(t: Tables) -> DataFrame:
    out = C.tadlis_ruling(t.positions, links(t), tadlis(t), t.chain_entities).drop("branch_no")
    return out.withColumn("listed", listed(F.transform("listed", lambda x: F.concat_ws(":", x["pos"].cast("string"), x["tadlis_tier"].cast("string"), x["cleared"].cast("string")))))


_TEXT = "case chain_id % 5 when 0 then 'قال رسول الله صلى الله عليه وسلم' when 1 then 'قال الله تعالى فيما رواه النبي' when 2 then 'أُمرنا بذلك' else 'قال كذا' end"
_TERMINAL = f"""
    , te as (select chain_id, arg_max(entity_id, pos) as entity_id, max(pos) as pos from positions group by 1),
    ta as (select te.*, tabaqat, grade_text, bucket, e.entity_id is not null as known, {NORMAL(_TEXT)} as n from te left join chain_entities e using (entity_id)),
    attr as (select chain_id, entity_id, pos, tabaqat, grade_text, bucket, case when regexp_matches(n, '{X.DIVINE}') and regexp_matches(n, '{X.RAISED}') then 'qudsi' when regexp_matches(n, '{X.RAISED}') then 'marfu_sarih' when regexp_matches(n, '{X.RAISED_IN_EFFECT}') and {_PROTECTED("ascription", "tabaqat", "grade_text", "bucket")} then 'marfu_hukman'
        when not known then 'unknown' when {_PROTECTED("ascription", "tabaqat", "grade_text", "bucket")} then 'mawquf' when contains(coalesce(tabaqat, ''), '{X.SUCCESSOR}') or (regexp_matches(coalesce(tabaqat, ''), '{X.SUCCESSOR_GENERATIONS}') and not regexp_matches(coalesce(tabaqat, ''), '{X.NOT_SUCCESSOR}')) then 'maqtu' else 'unknown' end as attribution from ta)"""


def attributions(t: Tables) -> DataFrame:
    c = F.col
    rows = C.terminal_entity(t.positions).join(t.chain_entities.select(c("entity_id").alias("terminal_id"), "tabaqat", "grade_text", "bucket", F.lit(True).alias("known")), "terminal_id", "left")
    return rows.withColumn("attribution", rules.attribution(F.expr(_TEXT), F.coalesce("known", F.lit(False)), c("tabaqat"), c("grade_text"), c("bucket")))


@query("wn07_cl07_cl08_attribution", duck("positions", "chain_entities", then=_TERMINAL + f"""
    select chain_id, entity_id as terminal_id, attribution, attribution in ('marfu_sarih', 'marfu_hukman', 'qudsi') and contains(coalesce(tabaqat, ''), '{X.SUCCESSOR}') and not {_PROTECTED("ascription", "''", "grade_text", "bucket")} as mursal from attr"""))
def _(t: Tables) -> DataFrame:
    c = F.col
    out = attributions(t)
    raised = c("attribution").isin("marfu_sarih", "marfu_hukman", "qudsi")
    return out.select("chain_id", "terminal_id", "attribution", rules.is_mursal(raised, c("tabaqat"), c("grade_text"), c("bucket")).alias("mursal"))


@query("wn06_append_source", duck("positions", "chain_entities", then=_TERMINAL + f"""
    select chain_id, pos, entity_id, name from positions union all select chain_id, pos + 1, {X.SOURCE_ID}, '{X.SOURCE_NAME}' from attr where attribution in ('marfu_sarih', 'marfu_hukman', 'qudsi')"""))
def _(t: Tables) -> DataFrame:
    return C.append_source(t.positions, attributions(t)).select("chain_id", "pos", "entity_id", "name")


@query("tk03_cl12_branches", duck(*_V, "parsed", then=_LINKS + _VERDICT + """,
    b as (select o_custkey as chain_id, cast(row_number() over (partition by o_custkey order by v.chain_id) - 1 as integer) as branch_no, verdict, case verdict when 'sahih_candidate' then 0 when 'hasan_candidate' then 1 when 'daif' then 2 when 'needs_review' then 3 else 4 end as r from verdicts v join orders on o_orderkey = v.chain_id)
    select chain_id, arg_min(branch_no, r * 1000000 + branch_no) as primary_branch, arg_min(verdict, r) as verdict, count(*) as branches, case when count(*) >= 2 and min(r) <= 1 and count(*) filter (r <= 1) > 1 then count(*) filter (r <= 1) - 1 end as confirmed_by from b group by 1"""))
def _(t: Tables) -> DataFrame:
    v = chain_verdicts(t).select(F.col("chain_id").alias("o_orderkey"), "verdict").join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    branches = v.select(F.col("o_custkey").alias("chain_id"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("branch_no"), "verdict")
    return C.rank_branches(branches)


# names of one entity differ by a word, and fold into one
_LEVELS = """, ends as (select chain_id, max(pos) as last from positions group by 1),
    lv as (select passage_id, last - pos as level, count(distinct entity_id) as n from parsed join ends using (chain_id) join positions using (chain_id) group by 1, 2)"""


def parsed_chains(t: Tables) -> DataFrame:
    named = t.positions.groupBy("chain_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    return t.parsed.join(named, "chain_id")


def levels(t: Tables) -> DataFrame:
    return C.level_counts(parsed_chains(t), samples=0)


@query("ag05_level_counts", duck("parsed", "positions", then=_LEVELS + " select passage_id, cast(level as integer) as level, n from lv"))
def _(t: Tables) -> DataFrame:
    return levels(t).select("passage_id", "level", F.col("n").cast("long").alias("n"))


@query("ag06_cl09_bottleneck", duck("parsed", "positions", then=_LEVELS + """,
    b as (select passage_id, min(n) as min_count, cast(arg_min(level, n * 1000 + level) as integer) as narrowest_level from lv group by 1), c as (select passage_id, count(*) as total_chains, count(distinct chain_id % 7) as distinct_books from parsed group by 1)
    select b.*, total_chains, distinct_books, case when min_count >= 10 then 'mutawatir' when min_count >= 3 then 'mashhur' when min_count = 2 then 'aziz' when narrowest_level = 0 and passage_id % 2 = 0 then 'gharib_mutlaq' else 'gharib_nisbi' end as spread from b join c using (passage_id)"""))
def bottlenecks(t: Tables) -> DataFrame:
    matches = t.parsed.select("passage_id", (F.col("chain_id") % 7).alias("book_id"))
    out = C.bottleneck(levels(t), parsed_chains(t), matches).withColumn("min_count", F.col("min_count").cast("long"))
    return out.withColumn("spread", rules.spread_class(F.col("min_count"), F.col("narrowest_level"), F.col("passage_id") % 2 == 0))


@query("cl10_cl11_rank", duck(*_V, then=_LINKS + _VERDICT + """,
    k as (select chain_id, verdict, least(case when chain_id % 3 > 0 then chain_id % 5 end, chain_id % 6) as a, chain_id % 6 as m, case when chain_id % 3 > 0 then least(chain_id % 5, chain_id % 6) else chain_id % 6 end as ways from verdicts),
    r as (select chain_id, verdict, ways, case when verdict = 'sahih_candidate' then 'sahih_li_dhatih' when verdict = 'hasan_candidate' then case when ways >= 2 then 'sahih_li_ghayrih' else 'hasan_li_dhatih' end when verdict = 'daif' then case when ways >= 3 then 'hasan_li_ghayrih' else 'daif' end when verdict = 'broken' then 'broken' else 'needs_review' end as rank from k)
    select *, case when rank like '%li_%' then 'maqbul' when rank in ('daif', 'broken') then 'mardud' else 'indeterminate' end as acceptance from r"""))
def _(t: Tables) -> DataFrame:
    ways = rules.corroboration(F.when(F.col("chain_id") % 3 > 0, F.col("chain_id") % 5), F.col("chain_id") % 6)
    out = chain_verdicts(t).select("chain_id", "verdict", ways.alias("ways")).withColumn("rank", rules.refined_rank(F.col("verdict"), F.col("ways")))
    return out.withColumn("acceptance", rules.acceptance(F.col("rank")))


# Passages


@query("tk02_ag11_matches", duck("parsed", then="""
    , m as (select passage_id, chain_id % 9 as book_id, case when chain_id % 4 > 0 then chain_id % 13 end as number, chain_id as text_id, score from parsed),
    d as (select passage_id, book_id, coalesce(cast(number as varchar), '#' || text_id) as place, max(score) as score, arg_min(text_id, struct_pack(a := -score, b := text_id)) as text_id from m group by 1, 2, 3)
    select passage_id, count(*) as occurrences, count(distinct book_id) as distinct_books, case when count(*) >= 10 then 'famous' when count(*) >= 3 then 'known' else 'rare' end as note, cast(sum(text_id) as bigint) as texts from d group by 1"""))
def _(t: Tables) -> DataFrame:
    m = t.parsed.select("passage_id", (F.col("chain_id") % 9).alias("book_id"), F.when(F.col("chain_id") % 4 > 0, F.col("chain_id") % 13).alias("number"), F.col("chain_id").alias("text_id"), "score")
    d = A.dedupe_matches(m)
    out = A.passage_popularity(m.select("passage_id").distinct(), d)
    return out.join(d.groupBy("passage_id").agg(F.sum("text_id").alias("texts")), "passage_id")


@query("tk01_passage_match", duck(then=f"""
    with p as (select item_id as pid, {NORMAL("text")} as q from benchmark where length({NORMAL("text")}) >= 6),
    pg as (select pid, len({WORDS("q")}) as n, unnest({GRAMS("q")}) as g from p), ps as (select pid, count(*) as m from pg group by 1),
    t as (select doc_id as tid, {WORDS(NORMAL("text"))} as w from documents where text is not null),
    tw as (select tid, len(w) as len, unnest(range(len(w))) as pos, unnest(w) as word from t),
    dg as (select word, unnest({GRAMS("word")}) as g from (select distinct word from tw)),
    few as (select x.tid, x.pid from (select distinct tid, pid, g from (select distinct tid, word from tw) join dg using (word) join pg using (g)) x join ps using (pid) group by 1, 2 having count(*) * 1000 >= max(m) * 450),
    o as (select tid, len, pid, n, pos, lag(pos) over (partition by tid, pid, g order by pos) as prev from tw join dg using (word) join pg using (g) semi join few using (tid, pid)),
    ev as (select tid, pid, greatest(pos - n + 1, coalesce(prev + 1, 0), 0) as a, 1 as d, greatest(len - n, 0) as last from o union all select tid, pid, pos + 1, -1, greatest(len - n, 0) from o),
    s as (select tid, pid, a, max(last) as last, sum(sum(d)) over (partition by tid, pid order by a) as c from ev group by 1, 2, 3),
    b as (select pid, tid, max(c) as c from s where a <= last group by 1, 2),
    r as (select pid, tid, c / m as score, row_number() over (partition by pid order by c / m desc, tid) as rank from b join ps using (pid) where c * 1000 >= m * 450)
    select pid as passage_id, tid as text_id, round(score, 6) as score, cast(rank as integer) as rank from r where rank <= 10"""))
def _(t: Tables) -> DataFrame:
    return A.passage_match_topk(t.passages, t.corpus).withColumn("score", F.round("score", 6))


# the name of a part against the full name of the next
@query("sc21_word_similarity", duck("registry", then=f"""
    , q as (select p_partkey as id, {NORMAL("p_name")} as q, {NORMAL("full_name")} as t from part join registry on entity_id = p_partkey + 1),
    g as (select id, {GRAMS("q")} as q, {WORDS("q")} as qw, {WORDS("t")} as w from q),
    o as (select id, q, qw, w, flatten(list_transform(w, lambda x: list_transform(range(1, len(x) + 2), lambda i: substr('  ' || x || ' ', i, 3)))) as o from g),
    a as (select id, q, o, unnest(range(1, len(o) + 1)) as i from o),
    b as (select id, max(len(list_intersect(q, x)) / (len(q) + len(x) - len(list_intersect(q, x)))) as extent from (select id, q, list_distinct(o[i:j]) as x from (select *, unnest(range(i, len(o) + 1)) as j from a)) group by 1),
    s as (select id, q, qw, w, unnest(range(1, len(w) + 1)) as i from o),
    r as (select id, q, len(qw) as n, w, i, j, list_distinct(flatten(list_transform(w[i:j], lambda y: list_transform(range(1, len(y) + 2), lambda k: substr('  ' || y || ' ', k, 3))))) as x from (select *, unnest(range(i, len(w) + 1)) as j from s)),
    c as (select id, max(len(list_intersect(q, x)) / (len(q) + len(x) - len(list_intersect(q, x)))) as strict, max(case when j - i + 1 = least(n, len(w)) then len(list_intersect(q, x)) / len(q) end) as words from r group by 1)
    select id, round(extent, 6) as extent, round(strict, 6) as strict, round(words, 6) as words from b join c using (id)"""))
def _(t: Tables) -> DataFrame:
    both = t.part.select(F.col("p_partkey").alias("id"), T.normalize(F.col("p_name")).alias("q")).join(t.registry.select((F.col("entity_id") - 1).alias("id"), T.normalize(F.col("full_name")).alias("t")), "id")
    # equal pairs are compared once
    rows = written(both, "pairs")
    # few bytes but much work: as many tasks as shuffles have
    one = rows.select("q", "t").distinct().repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "q", "t")
    one = one.select("q", "t", S.trigrams(F.col("q")).alias("g"), F.size(T.words(F.col("q"))).alias("n"), S.ordered_trigrams(F.col("t")).alias("o"), T.words(F.col("t")).alias("w"))
    kinds = {"extent": S.extent_similarity(F.col("g"), F.col("o")), "strict": S.extent_similarity(F.col("g"), F.col("o"), strict=True), "words": S.word_similarity(F.col("g"), F.col("n"), F.col("w"))}
    one = written(one.select(F.col("q").alias("q1"), F.col("t").alias("t1"), *[F.round(c, 6).alias(n) for n, c in kinds.items()]), "compared")
    return rows.join(one, F.col("q").eqNullSafe(F.col("q1")) & F.col("t").eqNullSafe(F.col("t1"))).select("id", *kinds)


# Text to rows

_P = f"""with b as (select page_id, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) as b from pages),
    l as (select page_id, string_split(regexp_replace(regexp_replace(b, '\\n', ' ', 'g'), '</p>|<br\\s*/?>', chr(10), 'g'), chr(10)) as l from b),
    q as (select page_id, list_filter(list_transform(l, lambda x: trim(regexp_replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '\\s+', ' ', 'g'))), lambda x: x <> '') as p from l),
    p as (select page_id % 10 as book_id, page_id, unnest(range(len(p))) as para_no, unnest(p) as text from q)"""


def headed(t: Tables) -> DataFrame:
    """Paragraphs with a book for every tenth page; some begin with a number, as a header does."""
    p = _paragraphs(t).withColumn("book_id", F.col("page_id") % 10)
    number = F.when((F.col("para_no") == 0) & (F.col("page_id") % 3 > 0), F.concat(F.col("page_id").cast("string"), F.lit(" - "))).otherwise("")
    return p.withColumn("text", F.concat(number, F.col("text")))


_H = _P + ", h as (select book_id, page_id, para_no, case when para_no = 0 and page_id % 3 > 0 then page_id || ' - ' else '' end || text as text from p)"


@query("wn01_carry_header", duck(then=_H + """,
    o as (select *, para_no = 0 and regexp_matches(text, '^([0-9]+)\\s*-\\s*(.+)$') as o from h),
    c as (select *, max(case when o then page_id end) over (partition by book_id order by page_id, para_no) as s from o)
    select book_id, page_id, cast(para_no as integer) as para_no, text, cast(s as integer) as entry_num, s as entry_start from c where s is not null and not o"""))
def _(t: Tables) -> DataFrame:
    return P.carry_header(headed(t), r"^([0-9٠-٩]+)\s*-\s*(.+)$").drop("entry_name")


@query("wn02_entry_sections", duck(then=_H + """,
    o as (select *, regexp_matches(text, '^([0-9]+)\\s*-\\s*(.+)$') as o, regexp_matches(text, '(?i)^[ld]e') as stop from h),
    e as (select *, sum(o::int) over (partition by book_id order by page_id, para_no) as e from o), c as (select *, max((stop and not o)::int) over (partition by book_id, e order by page_id, para_no) as closed from e where e > 0),
    t as (select book_id, e as entry_no, max(case when o then text end) as header, trim(regexp_replace(trim(regexp_replace(regexp_replace(string_agg(case when not o then text end, ' ' order by page_id, para_no), '\\s*\\(\\s*[0-9]+\\s*\\)\\s*', ' ', 'g'), '\\s+', ' ', 'g')), '[.،\\s]+$', '')) as t from c where closed = 0 group by 1, 2)
    select book_id, cast(entry_no as bigint) as entry_no, header, substr(t, 1, 2000) as text from t where length(t) >= 4"""))
def _(t: Tables) -> DataFrame:
    return P.entry_sections(headed(t), r"^([0-9]+)\s*-\s*(.+)$", stop=r"(?i)^[ld]e", footnote=r"^\(\s*[0-9]+\s*\)$")


@query("wn04_px03_numbered", duck(then=_H + f""",
    n as (select book_id, cast(regexp_extract(text, '^([0-9]+)\\s*-', 1) as integer) % 17 as number, page_id, para_no, trim(regexp_extract(text, '^([0-9]+)\\s*-\\s*(.+)$', 2)) as text from h where regexp_matches(text, '^([0-9]+)\\s*-\\s*(.+)$')),
    f as (select *, row_number() over (partition by book_id, number order by page_id, para_no) as r from n where length(text) >= 20)
    select book_id, number, text, {NORMAL("text")} as normalized from f where r = 1 and length({NORMAL("text")}) >= 10"""))
def _(t: Tables) -> DataFrame:
    h = headed(t)
    number = F.nullif(F.regexp_extract("text", r"^([0-9]+)\s*-", 1), F.lit("")).cast("int")
    renumbered = h.withColumn("text", F.when(number.isNotNull(), F.concat((number % 17).cast("string"), F.lit(" - "), F.regexp_extract("text", r"^([0-9]+)\s*-\s*(.+)$", 2))).otherwise(F.col("text")))
    return P.numbered_records(renumbered)


@query("px01_extract_attributed", duck(then=_H + """,
    g as (select page_id, para_no, list_filter(list_transform(string_split(regexp_replace(text, '\\*', chr(1) || '*', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as g from h),
    s as (select page_id, para_no, unnest(range(len(g))) as seg_no, unnest(g) as seg from g),
    parts as (select *, string_split(regexp_replace(seg, '(?:que|de|la)[,.]?\\s', chr(2), 'g'), chr(2)) as p from s),
    v as (select page_id, para_no, seg_no, unnest(range(1, len(p))) as verdict_no, trim(unnest(p[2:])) as t, unnest(p[:len(p) - 1]) as before from parts),
    r as (select *, trim(regexp_replace(trim(regexp_replace(t, '^(.*?)\\([٠-٩0-9]+\\)', '\\1')), '[.،\\s]+$', '')) as verdict, trim(regexp_extract(before, 'le\\s+([^ ]{1,40})\\s*$', 1)) as relayed from v)
    select page_id, cast(para_no as integer) as para_no, cast(seg_no as integer) as seg_no, cast(verdict_no as integer) as verdict_no, verdict, nullif(relayed, '') as relayed_via from r where length(verdict) > 0 and length(verdict) < 1200"""))
def _(t: Tables) -> DataFrame:
    p = headed(t)
    out = P.extract_attributed(p, speaker=r"(?:que|de|la)[,.]?\s", relay=r"le\s+([^ ]{1,40})\s*$", bullet=r"\*")
    return out.select("page_id", "para_no", "seg_no", "verdict_no", "verdict", "relayed_via")


@query("px02_split_name_verdict", duck(then=_H + """,
    r as (select page_id, para_no, cast(regexp_extract(text, '^([0-9]+)\\s*-', 1) as integer) as entry_num, trim(regexp_extract(text, '^([0-9]+)\\s*-\\s*(.+)$', 2)) as b from h where regexp_matches(text, '^([0-9]+)\\s*-\\s*(.+)$')),
    k as (select *, list_min(list_filter([instr(b, ' the '), instr(b, ' of '), instr(b, ' der '), instr(b, ' de ')], lambda i: i > 0)) as k from r),
    c as (select *, coalesce(k - 1, length(b)) as cut from k),
    v as (select page_id, cast(para_no as integer) as para_no, entry_num, trim(regexp_replace(substr(b, 1, cast(cut as integer)), '[،.\\s]+$', '')) as name, trim(regexp_replace(regexp_replace(substr(b, cast(cut as integer) + 1), '^[،.\\s]+', ''), '[،.\\s]+$', '')) as v from c)
    select page_id, para_no, entry_num, name, case when length(v) >= 2 then v else 'none' end as verdict from v where length(name) between 2 and 250"""))
def _(t: Tables) -> DataFrame:
    return P.split_name_verdict(headed(t), [" the ", " of ", " der ", " de "], default="none").select("page_id", "para_no", "entry_num", "name", "verdict")


_CHAINS = "select conv_id * 100 + turn as chain_id, text from {conversations}"
_LEXICON = {"with": "haddathana", "from": "an", "that": "anna"}


@query("px04_segment_chain", duck(then="""
    with s as (select conv_id * 100 + turn as chain_id, regexp_extract(regexp_replace(' ' || regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[،,]\\s*', ' ', 'g') || ' ', '( (?:with|from|that))\\s*:', '\\1 ', 'g'), '^([^.:؛]*)', 1) || ' ' as t from conversations),
    m as (select chain_id, string_split(regexp_replace(replace(t, ' ', '  '), ' (with|from|that) ', ' ' || chr(1) || '\\1' || chr(1), 'g'), chr(1)) as p from s),
    i as (select chain_id, p, unnest(range(1, (len(p) - 1) // 2 + 1)) as i from m),
    n as (select chain_id, cast(i - 1 as integer) as pos, trim(regexp_replace(regexp_extract(p[2 * i + 1], '^([^.:؛]*)', 1), '\\s+', ' ', 'g')) as name, case p[2 * i + 2] when 'with' then 'haddathana' when 'from' then 'an' when 'that' then 'anna' end as formula from i)
    select chain_id, 0 as branch_no, pos, name, formula from n where name <> ''"""))
def _(t: Tables) -> DataFrame:
    return P.segment_chain(t.spark.sql(_CHAINS, conversations=t.conversations), _LEXICON)[0]


# Chains of four kinds of branching, spelt out; the SQL has the branches that they were spelt from.
_SPELT = """
    f as (select chain_id, entity_id, min(pos) as p from positions group by 1, 2),
    e as (select chain_id, list('م' || entity_id || ' بن ن' || entity_id order by p) as n, list('ن' || entity_id order by p) as fathers from f group by 1),
    k as (select *, case when len(n) >= 4 then chain_id % 5 else 0 end as kind, list_transform(n, lambda x: {'v': 'an', 'n': x}) as l from e),
    b as (
        select chain_id, 0 as branch_no, list_concat([{'v': 'haddathana', 'n': n[1]}], l[2:]) as b from k where kind = 0
        union all select chain_id, 0, list_concat([{'v': 'haddathana', 'n': n[1]}, {'v': 'haddathana', 'n': n[2]}], l[3:]) from k where kind = 1
        union all select chain_id, 1, list_concat([{'v': 'haddathani', 'n': 'ش' || chain_id}, {'v': 'haddathana', 'n': n[2] || ' البصري'}], l[3:]) from k where kind = 1
        union all select chain_id, 0, [{'v': 'haddathana', 'n': n[1]}, {'v': 'haddathana', 'n': n[2]}, l[3], {'v': 'an', 'n': fathers[3]}] from k where kind = 2
        union all select chain_id, 1, list_concat([{'v': 'haddathana', 'n': n[1]}, {'v': 'haddathana', 'n': n[2]}], l[4:]) from k where kind = 2
        union all select chain_id, 0, [{'v': 'haddathana', 'n': n[1]}, l[2]] from k where kind = 3
        union all select chain_id, 1, list_concat([{'v': 'haddathana', 'n': n[3]}], l[4:]) from k where kind = 3
        union all select chain_id, 0, list_concat([{'v': 'haddathani', 'n': n[1]}, {'v': 'akhbarana', 'n': n[2]}], l[3:]) from k where kind = 4),
    u as (select chain_id, cast(branch_no as integer) as branch_no, b, unnest(range(len(b))) as pos from b)
    select chain_id, branch_no, cast(pos as integer) as pos, b[pos + 1].n as name, b[pos + 2].v as formula from u"""


def spelt_branches(t: Tables) -> DataFrame:
    """(chain_id, text): chains of the tables in one of five spellings, four of which branch or name two speakers."""
    first = t.positions.groupBy("chain_id", "entity_id").agg(F.min("pos").alias("p"))
    ids = first.groupBy("chain_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "entity_id"))), lambda x: x["entity_id"].cast("string")).alias("ids"))
    rows = ids.withColumn("n", F.transform("ids", lambda x: F.concat(F.lit("م"), x, F.lit(" بن ن"), x)))
    name = lambda i: F.get("n", F.lit(i))
    rest = lambda i: F.array_join(F.slice("n", i + 1, F.greatest(F.size("n") - i, F.lit(0))), "، عن ")
    kind = F.when(F.size("n") >= 4, F.col("chain_id") % 5).otherwise(0)
    spelt = F.when(kind == 1, F.concat(F.lit("حدثنا "), name(0), F.lit("، حدثنا "), name(1), F.lit("، ح قال وحدثني ش"), F.col("chain_id"), F.lit("، حدثنا "), name(1), F.lit(" البصري، عن "), rest(2)))
    spelt = spelt.when(kind == 2, F.concat(F.lit("حدثنا "), name(0), F.lit("، حدثنا "), name(1), F.lit("، عن "), name(2), F.lit("، عن أبيه، وعن "), rest(3)))
    spelt = spelt.when(kind == 3, F.concat(F.lit("حدثنا "), name(0), F.lit("، عن "), name(1), F.lit("، وحدثنا "), rest(2)))
    spelt = spelt.when(kind == 4, F.concat(F.lit("حدثني "), name(0), F.lit("، وهارون بن سعيد، قالا أخبرنا "), rest(1)))
    return rows.select("chain_id", F.concat(spelt.otherwise(F.concat(F.lit("حدثنا "), rest(0))), F.lit("، أن النبي ﷺ قال: متن")).alias("text"))


@query("px05_px06_branches", duck("positions", then="with " + _SPELT))
def _(t: Tables) -> DataFrame:
    return P.segment_chain(P.split_branches(spelt_branches(t)))[0]


@query("px07_parse_replies", duck(then="""
    select o_orderkey as chain_id, case o_orderkey % 5 when 3 then 'bad_json' when 4 then 'no_list' else 'ok' end as status, case when o_orderkey % 5 < 3 then o_custkey || case o_orderkey % 5 when 0 then ':an' when 1 then '' else ':' end else null end as names from orders"""))
def _(t: Tables) -> DataFrame:
    o, c = t.orders, F.col
    shapes = [
        F.format_string('text {"branches": [{"narrators": [{"name": "%s", "formula": "an"}]}], "matn": "m"} more', c("o_custkey").cast("string")),
        F.format_string('```json\n{"narrators": ["%s"], "matn": ""}\n```', c("o_custkey").cast("string")),
        F.format_string('{"narrators": [{"name": "%s", "formula": "odd"}]}', c("o_custkey").cast("string")),
        F.lit("no object here"), F.lit('{"matn": "m"}'),
    ]
    replies = o.select(c("o_orderkey").alias("chain_id"), F.element_at(F.array(*shapes), (c("o_orderkey") % 5 + 1).cast("int")).alias("reply"))
    status, names = P.parse_replies(replies)
    named = names.groupBy("chain_id").agg(F.max(F.concat(c("name"), F.coalesce(F.concat(F.lit(":"), c("formula")), F.when(c("chain_id") % 5 == 2, F.lit(":")).otherwise(F.lit(""))))).alias("names"))
    return status.select("chain_id", "status").join(named, "chain_id", "left")


# State


@query("st01_sliding_quota", duck(then="""
    with recursive e as (select user_id as key, event_id as id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as r from events where user_id is not null and ts is not null),
    s as (select key, id, r, [us] as taken, true as allowed from e where r = 1
        union all select key, id, r, case when len(f) < 3 then list_append(f, us) else f end, len(f) < 3
        from (select e.*, list_filter(s.taken, lambda x: x > e.us - 86400000000) as f from s join e on e.key = s.key and e.r = s.r + 1))
    select key, id, allowed from s"""))
def _(t: Tables) -> DataFrame:
    return ST.sliding_quota(t.events, 3, 86_400).select("key", "id", "allowed")


@query("st02_incremental", duck(then=f"""
    with d as (select distinct sha256('v2:' || {NORMAL("coalesce(text, '')")}) as input_hash, length({NORMAL("coalesce(text, '')")}) as result from documents),
    c as (select distinct sha256('v2:' || {NORMAL("coalesce(text, '')")}) as input_hash from documents where doc_id % 3 = 0)
    select input_hash, case when input_hash in (select input_hash from c) then -1 else result end as result from d"""))
def _(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    cache = docs.where("doc_id % 3 = 0").select(T.cache_key("v2", F.col("text")).alias("input_hash"), F.lit(-1).cast("long").alias("result"), "created_at").distinct()
    _, out = ST.audit_incremental(docs, cache, "v2", lambda df: df.withColumn("result", F.length(T.normalize(F.coalesce("text", F.lit("")))).cast("long")))
    return out.select("input_hash", "result")


def stream_files(docs: DataFrame, path: str, batches: int = 3) -> int:
    """Writes ``docs`` as files for a stream, as many as it takes to keep tasks small; gives how many of them a micro-batch has to take
    so that there are about ``batches``."""
    parts = max(batches, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    docs.repartition(parts).write.parquet(path)
    return -(-parts // batches)


@query("st02_stream", SQL["st02_incremental"])
def _(t: Tables) -> DataFrame:
    """The same cache as a table in buckets, that a stream of several micro-batches fills."""
    spark = t.spark
    docs = t.documents.select("doc_id", "text").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    table = BucketedTable.create(spark, new_path(spark, "cache"), "input_hash string, result long, created_at timestamp", ["input_hash"], buckets=16)
    ST.cached(docs.where("doc_id % 3 = 0"), table, "v2", lambda df: df.withColumn("result", F.lit(-1)))
    source = new_path(spark, "stream")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", stream_files(docs, source)).parquet(source)
    compute = lambda df: df.withColumn("result", F.length(T.normalize(F.coalesce("text", F.lit("")))))
    run = ST.stream_incremental(stream, table, "v2", compute, writer="documents").option("checkpointLocation", new_path(spark, "progress")).trigger(availableNow=True).start()
    run.awaitTermination()
    return table.read().select("input_hash", "result")


@query("st03_parse_cache", duck(then="""
    select doc_id as text_id, case when doc_id % 4 = 0 then 0 else len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w = 'the' or w = 'de')) end as n from documents"""))
def _(t: Tables) -> DataFrame:
    corpus = t.corpus.select("text_id", "text")
    table = BucketedTable.create(t.spark, new_path(t.spark, "parses"), "text_id long, names array<string>, segmented_at timestamp", ["text_id"], buckets=16)
    ST.parsed_into(corpus.where("text_id % 4 = 0"), table, lambda df: df.where("false").withColumn("names", F.array().cast("array<string>")))
    parse = lambda df: df.select("text_id", F.filter(F.split("text", r"\s+"), lambda w: w.isin("the", "de")).alias("names")).where("size(names) > 0")
    ST.parsed_into(corpus, table, parse)
    return table.read().select("text_id", F.size("names").cast("long").alias("n"))


@query("st04_monthly_usage", duck(then="""
    with r as (select strftime(ts, '%Y-%m') as month, ts, row_number() over (partition by strftime(ts, '%Y-%m') order by ts, event_id) as i from events)
    select month, count(*) as calls, count(*) < 5000 as within_cap, cast(max(case when i = 5000 then ts end) as varchar) as capped_at from r group by 1"""))
def _(t: Tables) -> DataFrame:
    return ST.monthly_usage(t.events).withColumn("capped_at", F.regexp_replace(F.date_format("capped_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "[.]?0+$", ""))  # as DuckDB spells a time


@query("ud01_with_model", duck(then="select item_id, case when item_id % 7 = 3 then null else 'r' || item_id end as reply, case when item_id % 7 = 3 then 'error: no answer' else 'ok' end as status from benchmark"))
def _(t: Tables) -> DataFrame:
    def model(b):
        if (b["item_id"] % 7 == 3).any():
            raise ValueError("no answer")
        return "r" + b["item_id"].astype(str)

    return ST.with_model(t.benchmark.select("item_id"), model, ["item_id"])


# The composition


@query("cl18_audit", duck(*_V, then=_LINKS + _VERDICT + _TERMINAL + f""",
    b as (select chain_id, count(*) filter (status = 'impossible') as breaks, min(from_pos) filter (status = 'impossible') as f, max(from_pos) filter (status = 'impossible') as l, count(*) as links, count(*) filter (status = 'attested') as attested, count(*) filter (verb = 'samaa') as heard from links group by 1),
    x as (select v.chain_id, v.verdict, a.attribution, a.entity_id as terminal_id, case when coalesce(breaks, 0) > 0 then case when f = 0 then 'muallaq' when breaks > 1 and l - f + 1 = breaks then 'mudal' else 'munqati' end
        when a.attribution in ('marfu_sarih', 'marfu_hukman', 'qudsi') and contains(coalesce(tabaqat, ''), '{X.SUCCESSOR}') and not {_PROTECTED("ascription", "''", "grade_text", "bucket")} then 'mursal' else 'none' end as break_type,
        case when b.links is null then 'none' when heard = b.links then 'all_heard' when heard > 0 then 'some_heard' when attested = b.links then 'all_attested' when attested > 0 then 'some_attested' else 'none' end as strength
        from verdicts v join attr a using (chain_id) left join b using (chain_id)),
    levels as (select chain_id // 8 as g, level, count(distinct entity_id) as n from (select chain_id, max(pos) over (partition by chain_id) - pos as level, entity_id from positions) group by 1, 2),
    low as (select g, min(n) as min_count from levels group by 1), found as (select chain_id // 8 as g, count(*) as matches from verdicts group by 1),
    k as (select x.*, least(min_count, matches) as ways from x join low on low.g = x.chain_id // 8 join found on found.g = x.chain_id // 8),
    r as (select *, case when verdict = 'sahih_candidate' then 'sahih_li_dhatih' when verdict = 'hasan_candidate' then case when ways >= 2 then 'sahih_li_ghayrih' else 'hasan_li_dhatih' end when verdict = 'daif' then case when ways >= 3 then 'hasan_li_ghayrih' else 'daif' end when verdict = 'broken' then 'broken' else 'needs_review' end as rank from k)
    select chain_id, verdict, attribution, terminal_id, break_type, strength, rank, case when rank like '%li_%' then 'maqbul' when rank in ('daif', 'broken') then 'mardud' else 'indeterminate' end as acceptance from r"""))
def audit(t: Tables) -> DataFrame:
    """The flagship: verdict, attribution, break, strength, rank and acceptance of every chain."""
    c = F.col
    l, at = links(t), C.CHAIN
    out = C.chain_verdicts(graded_positions(t), l).join(attributions(t), at).join(C.break_runs(l).select(*at, "break_type"), at, "left").join(C.attestation_summary(l).select(*at, "strength"), at, "left")
    raised = c("attribution").isin("marfu_sarih", "marfu_hukman", "qudsi")
    broke = F.coalesce("break_type", F.lit("none"))
    kind = F.when((broke == "none") & rules.is_mursal(raised, c("tabaqat"), c("grade_text"), c("bucket")), "mursal").otherwise(broke)
    # the chains of eight orders tell one passage; as many ways as the level with the fewest entities has
    share = t.positions.select(F.floor(c("chain_id") / 8).alias("g"), (F.max("pos").over(W.partitionBy("chain_id")) - c("pos")).alias("level"), "entity_id", "chain_id")
    low = share.groupBy("g", "level").agg(F.count_distinct("entity_id").alias("n")).groupBy("g").agg(F.min("n").alias("min_count"))
    low = low.join(share.groupBy("g").agg(F.count_distinct("chain_id").alias("matches")), "g")
    out = out.withColumn("g", F.floor(c("chain_id") / 8)).join(low, "g")
    rank = rules.refined_rank(c("verdict"), rules.corroboration(c("min_count"), c("matches")))
    return out.select("chain_id", "verdict", "attribution", "terminal_id", kind.alias("break_type"), F.coalesce("strength", F.lit("none")).alias("strength"), rank.alias("rank"), rules.acceptance(rank).alias("acceptance"))
