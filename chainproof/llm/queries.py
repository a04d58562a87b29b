"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainproof.llm import chat, decontaminate, licences, neardup, packing, repair, sharding, simhash, tokenfile, topk, toxicity, urlfilter, whitening
from chainproof.llm.common import new_path, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into eight shards of row counts that differ by one at most (law ``rows``)."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    out = sharding.interleave(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and its evidence for every document, by a model of the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def url_lists(pages: DataFrame) -> DataFrame:
    """Dated list entries made from the hosts and URLs of ``pages``, as a stand-in for published
    lists: hosts that are listed and often cleared again, domains, sections of sites, single
    pages, and an allow list."""
    known = pages.select("page_id", urlfilter.host(F.col("url")).alias("host"), urlfilter.path(F.col("url")).alias("path")).where("host is not null")
    number = lambda c, a: F.conv(F.substring(F.md5(c), a, 6), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    hosts = known.select("host").distinct().withColumns({"h": number("host", 1), "g": number("host", 7)})
    domains = known.select(F.substring_index("host", ".", -3).alias("d")).distinct().withColumn("h", number("d", 13))
    entry = lambda df, name, verdict, kind, value, action, n: df.select(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), F.lit(kind).alias("kind"), F.expr(value).alias("value"), F.lit(action).alias("action"), day(n).alias("at"))
    h, g = F.col("h"), F.col("g")
    parts = [
        entry(hosts.where("h % 3 = 0"), "abuse", "block", "host", "host", "add", h % 300),
        entry(hosts.where("h % 3 = 0 and g % 2 = 0"), "abuse", "block", "host", "host", "remove", h % 300 + 30 + g % 97),
        entry(hosts.where("g % 7 = 0"), "partners", "allow", "host", "host", "add", g % 100),
        entry(hosts.where("g % 5 = 1"), "sections", "block", "prefix", "concat(host, '/de')", "add", g % 250),
        entry(domains.where("h % 4 = 0"), "spam", "block", "domain", "d", "add", h % 200),
        entry(known.where("page_id % 97 = 0"), "takedown", "block", "url", "concat(host, path)", "add", F.col("page_id") % 366),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deciding list entry at fetch time of every page's URL."""
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    captures = pages.select("page_id", "url", fetched.alias("fetched_at"))
    out = urlfilter.judge(captures, url_lists(pages))
    return out.select("page_id", "url", F.col("fetched_at").cast("string").alias("fetched_at"), "verdict", "list", "entry", F.col("since").cast("string").alias("since"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near-copies of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and a further one of control strings, read back from its examples."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.expand(turns.unionByName(extra)))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    return licences.scan(table(spark, sf_dir, "documents")).drop("spans")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as they are in the token files that are written for it."""
    path = new_path(spark, "tokens")
    manifest = tokenfile.write_token_files(table(spark, sf_dir, "documents"), path)
    return tokenfile.read_token_files(manifest, path, digests_only=True)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth vector, by integer inner products."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), topk.quantised(F.col("embedding")).alias("v"))
    return topk.exact_top_k(v.where("id % 50 = 0"), v, 5)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest edits that repair every conversation, after damage."""
    return repair.repair(table(spark, sf_dir, "conversations"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SimHash fingerprint and the component of near-copies of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 4)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_url_filter": op3_url_filter,
    "op4_near_dedup": op4_near_dedup,
    "op5_chat": op5_chat,
    "op6_licences": op6_licences,
    "op7_token_files": op7_token_files,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_top_k": op10_top_k,
    "op11_repair": op11_repair,
    "op12_simhash": op12_simhash,
    "op13_whitening": op13_whitening,
}

#: DuckDB SQL for the queries that SQL can express.
SQL: dict[str, str] = {
    "op3_url_filter": r"""
        with known as (
            select page_id, url, cast('2024-01-01' as date) + cast(page_id * 37 % 366 as integer) as fetched_at,
                nullif(rtrim(lower(regexp_extract(trim(url), '(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '.'), '') as host,
                rtrim(regexp_extract(trim(url), '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/') as path
            from pages),
        hosts as (
            select host, cast(('0x' || substr(md5(host), 1, 6)) as integer) as h, cast(('0x' || substr(md5(host), 7, 6)) as integer) as g
            from (select distinct host from known where host is not null)),
        domains as (
            select d, cast(('0x' || substr(md5(d), 13, 6)) as integer) as h
            from (select distinct array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') as d from known where host is not null)),
        events as (
            select 'abuse' as list, 'block' as verdict, 'host' as kind, host as value, 'add' as action, h % 300 as n from hosts where h % 3 = 0
            union all select 'abuse', 'block', 'host', host, 'remove', h % 300 + 30 + g % 97 from hosts where h % 3 = 0 and g % 2 = 0
            union all select 'partners', 'allow', 'host', host, 'add', g % 100 from hosts where g % 7 = 0
            union all select 'sections', 'block', 'prefix', host || '/de', 'add', g % 250 from hosts where g % 5 = 1
            union all select 'spam', 'block', 'domain', d, 'add', h % 200 from domains where h % 4 = 0
            union all select 'takedown', 'block', 'url', host || path, 'add', page_id % 366 from known where host is not null and page_id % 97 = 0),
        one as (
            select list, kind || '|' || lower(value) as key, cast('2024-01-01' as date) + cast(n as integer) as t0, max(action) as action, max(verdict) as verdict
            from events group by 1, 2, 3),
        valid as (
            select * from (select *, lead(t0) over (partition by list, key order by t0) as ended from one) where action = 'add'),
        labels as (select *, string_split(host, '.') as l, list_filter(string_split(path, '/'), lambda x: x <> '') as p from known),
        keys as (
            select page_id, url, fetched_at, 'url|' || lower(host || path) as key, 1000000 as rank from labels where host is not null
            union all select page_id, url, fetched_at, 'host|' || host, 10000 from labels where host is not null
            union all select page_id, url, fetched_at, 'prefix|' || lower(host || '/' || array_to_string(p[1:i], '/')), 100000 + i
                from (select *, unnest(range(1, len(p))) as i from labels where host is not null)
            union all select page_id, url, fetched_at, 'domain|' || array_to_string(l[len(l) - i + 1:], '.'), i
                from (select *, unnest(range(2, len(l) + 1)) as i from labels where host is not null)),
        best as (
            select k.page_id, v.verdict, v.list, v.key as entry, v.t0 as since,
                row_number() over (partition by k.page_id order by k.rank desc, v.verdict = 'allow' desc, v.t0 desc, v.list desc) as r
            from keys k join valid v on k.key = v.key and v.t0 <= k.fetched_at and (v.ended is null or k.fetched_at < v.ended))
        select k.page_id, k.url, cast(k.fetched_at as varchar) as fetched_at, coalesce(b.verdict, 'none') as verdict, b.list, b.entry, cast(b.since as varchar) as since
        from known k left join best b on k.page_id = b.page_id and b.r = 1""",
    "op10_top_k": """
        with v as (
            select row_number() over () as uid, vec_id as id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as hugeint)) as v
            from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        terms as (select uid, id, unnest(range(len(v))) as t, unnest(v) as w from v),
        s as (
            select q.uid, q.id as query_id, c.uid as other, c.id as vec_id, cast(sum(q.w * c.w) as bigint) as score
            from terms q join terms c on q.t = c.t and q.uid <> c.uid
            where q.id % 50 = 0 group by 1, 2, 3, 4),
        r as (select *, cast(row_number() over (partition by uid order by score desc, vec_id) as integer) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op11_repair": r"""
        with recursive bits as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                list_reduce(list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda c: cast(ord(c) as bigint)),
                    lambda crc, b: list_reduce(range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(crc, b)), cast(4294967295 as bigint)) as crc
            from conversations),
        kinds as (select *, xor(crc, 4294967295) % 20 as kind from bits),
        damaged as (
            select conv_id, turn, case when kind = 4 then 'user' else role end as role,
                case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
                unnest(case when kind = 3 then [0, 1] else [0] end) as copy
            from kinds where kind <> 0),
        placed_rows as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || text)) as i from damaged),
        seen as (select *, row_number() over (partition by conv_id, role, text order by i) as again, rtrim(text, E' \t\n\x0b\f\r') as trimmed from placed_rows),
        faults as (
            select conv_id, turn, i, role, text, substr(role, 1, 1) as initial,
                case when trimmed = '' then 1 when again > 1 then 2 when right(trimmed, 1) not in ('.', '!', '?') then 3 else 0 end as fault
            from seen),
        counts as (
            select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
                count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate, count(*) filter (where fault = 3) as truncated
            from faults group by 1),
        pairs as (select conv_id, lag(initial) over (partition by conv_id order by i) || initial as two from faults),
        wrong as (select conv_id, count(*) filter (where two not in ('su', 'ua', 'au')) as illegal from pairs group by 1),
        steps as (
            select conv_id, cast(0 as bigint) as i, {'c': cast(0 as bigint), 'w': ''} as s0, {'c': cast(null as bigint), 'w': ''} as s1, {'c': cast(null as bigint), 'w': ''} as s2, {'c': cast(null as bigint), 'w': ''} as s3
            from counts
            union all
            select conv_id, i, {'c': s0.c + 4, 'w': s0.w || 'D'} as s0,
                list_min([{'c': s1.c + 4, 'w': s1.w || 'D'}, {'c': case when initial = 's' then s0.c + k end, 'w': s0.w || 'K'}]) as s1,
                list_min([{'c': t2.c + 4, 'w': t2.w || 'D'}, {'c': s0.c + 3 + k, 'w': s0.w || 'R'}, {'c': s1.c + 3 + k, 'w': s1.w || 'R'}, {'c': t3.c + 3 + k, 'w': t3.w || 'R'},
                    {'c': case when initial = 'u' then s0.c + k end, 'w': s0.w || 'K'}, {'c': case when initial = 'u' then s1.c + k end, 'w': s1.w || 'K'}, {'c': case when initial = 'u' then t3.c + k end, 'w': t3.w || 'K'}]) as s2,
                list_min([{'c': t3.c + 4, 'w': t3.w || 'D'}, {'c': t2.c + 3 + k, 'w': t2.w || 'R'}, {'c': case when initial = 'a' then t2.c + k end, 'w': t2.w || 'K'}]) as s3
            from (
                select *, list_min([s3, {'c': t2.c + 3, 'w': t2.w || 'I'}]) as t3
                from (
                    select w.conv_id, f.i, s0, s1, s3, initial, case fault when 0 then 0 when 3 then 3 end as k,
                        list_min([s2, {'c': s0.c + 3, 'w': s0.w || 'I'}, {'c': s1.c + 3, 'w': s1.w || 'I'}, {'c': s3.c + 3, 'w': s3.w || 'I'}]) as t2
                    from steps w join faults f on w.conv_id is not distinct from f.conv_id and f.i = w.i + 1))),
        last as (
            select s.conv_id, list_min([s0, s3, {'c': t2.c + 3, 'w': t2.w || 'I'}]) as best
            from (select *, list_min([s2, {'c': s0.c + 3, 'w': s0.w || 'I'}, {'c': s1.c + 3, 'w': s1.w || 'I'}, {'c': s3.c + 3, 'w': s3.w || 'I'}]) as t2 from steps) s
            join counts c on s.conv_id is not distinct from c.conv_id and s.i = c.n),
        edits as (select conv_id, best.w as audit, unnest(string_split(best.w, '')) as edit, unnest(range(length(best.w))) as p, length(replace(best.w, 'D', '')) as kept from last where best.w <> ''),
        placed as (
            select *, sum(case when edit <> 'I' then 1 else 0 end) over o as i, sum(case when edit <> 'D' then 1 else 0 end) over o - 1 as nth
            from edits window o as (partition by conv_id order by p)),
        lines as (
            select e.conv_id, p, case when edit = 'K' then role when (nth + kept) % 2 = 0 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end as line
            from placed e join faults f on e.conv_id is not distinct from f.conv_id and f.i = greatest(e.i, 1)
            where edit <> 'D'),
        texts as (select conv_id, sha256(string_agg(line, chr(10) order by p)) as repaired_sha256 from lines group by 1)
        select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
            coalesce(illegal, 0) as illegal, coalesce(best.c, 0) as cost, coalesce(best.w, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
        from (select distinct conv_id from conversations) o
        left join counts c on o.conv_id is not distinct from c.conv_id
        left join wrong w on o.conv_id is not distinct from w.conv_id
        left join last l on o.conv_id is not distinct from l.conv_id
        left join texts t on o.conv_id is not distinct from t.conv_id""",
}
