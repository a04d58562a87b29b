"""URL filtering by a temporal list join, DataFrame functions only.

Dated list entries (an entry is added to or removed from a list at a time) become validity
intervals. Each different pair of URL and fetch time is looked up, by a join on the URL's keys and
the time, in the intervals that hold then, and the most specific entry decides.

A capture has a key for its URL, for each leading part of its path, its host, and each parent
domain. A host with a large share of all captures makes one hot key: the interval table is
written, so that the join reads both sides straight from shuffles that Spark can split, and is
broadcast where Spark measures it to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chainproof.llm.common import written

KINDS = ("url", "prefix", "host", "domain")


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where there is none."""
    h = F.rtrim(F.lower(F.regexp_extract(F.trim(url), r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit("."))
    return F.when(h != "", h)


def path(url: Column) -> Column:
    """Path without query, fragment and final slashes."""
    return F.rtrim(F.regexp_extract(F.trim(url), r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), F.lit("/"))


def keys(url: Column) -> Column:
    """Array of (key, rank) of a URL, rank being higher for what is more specific."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    whole = F.array(
        F.struct(F.concat(F.lit("url|"), h, p).alias("key"), F.lit(1_000_000).alias("rank")),
        F.struct(F.concat(F.lit("host|"), h).alias("key"), F.lit(10_000).alias("rank")),
    )
    n = F.size(parts)
    prefixes = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.concat(F.lit("prefix|"), h, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("key"), (100_000 + i).alias("rank"))))
    m = F.size(labels)
    domains = F.when(m > 1, F.transform(F.sequence(F.lit(2), m), lambda i: F.struct(F.concat(F.lit("domain|"), F.array_join(F.slice(labels, m - i + 1, i), ".")).alias("key"), i.alias("rank"))))
    none = F.slice(whole, 1, 0)
    return F.when(h.isNotNull(), F.concat(whole, F.coalesce(prefixes, none), F.coalesce(domains, none)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, key, since, until) from dated entries with list, verdict (block or allow),
    kind (of ``KINDS``), value, action (add or remove) and at. An entry holds from its addition up
    to, not at, the next event of its key in its list. Of events at one time removal wins. Rows
    with a null in any of these columns are left out."""
    value = F.lower(F.rtrim(F.trim("value"), F.lit("/")))
    e = entries.select("list", "verdict", F.concat_ws("|", "kind", value).alias("key"), "action", "at", *[c for c in ("kind", "value")])
    e = e.where(F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove") & F.col("verdict").isin("block", "allow")).dropna(subset=["list", "value", "at"])
    e = e.groupBy("list", "key", "at").agg(F.max("action").alias("action"), F.max("verdict").alias("verdict"))
    order = W.partitionBy("list", "key").orderBy("at")
    return e.withColumn("until", F.lead("at").over(order)).where(F.col("action") == "add").select("list", "verdict", "key", F.col("at").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, *, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with verdict (block, allow or none), list, entry and since of the deciding
    entry: the most specific one (url, longest path, host, longest domain) that was active at
    fetch time; of equals allow wins, then the latest, then the last list by name.

    Null or unparsable URLs, and null times, are ``none`` with a null list. Repeated rows are all
    returned; an empty list judges all ``none``. Columns of ``captures`` with the names of result
    columns are replaced; it has no columns named ``_u``, ``_t`` or ``_m``.
    """
    made = ("verdict", "list", "entry", "since")
    own = [F.col(f"`{c}`") for c in captures.columns if c not in made]
    # a verdict depends on URL and time alone, so each pair of them is looked up once
    pairs = captures.select(F.col(f"`{url}`").alias("_u"), F.col(f"`{at}`").alias("_t")).where("_u is not null and _t is not null").distinct()
    rows = pairs.withColumn("k", F.explode(keys(F.col("_u")))).select("_u", "_t", F.lower("k.key").alias("key"), F.col("k.rank").alias("rank"))
    valid = written(intervals(entries), "intervals").withColumnRenamed("key", "entry")
    holds = (rows["key"] == valid["entry"]) & (valid["since"] <= rows["_t"]) & (valid["until"].isNull() | (rows["_t"] < valid["until"]))
    found = F.struct("rank", (F.col("verdict") == "allow").alias("allow"), "since", "list", "entry", "verdict")
    best = rows.join(valid, holds).groupBy("_u", "_t").agg(F.max(found).alias("_m"))
    out = captures.select(*own, F.col(f"`{url}`").alias("_u"), F.col(f"`{at}`").alias("_t")).join(best, ["_u", "_t"], "left")
    return out.select(*own, F.coalesce("_m.verdict", F.lit("none")).alias("verdict"), F.col("_m.list").alias("list"), F.col("_m.entry").alias("entry"), F.col("_m.since").alias("since"))
