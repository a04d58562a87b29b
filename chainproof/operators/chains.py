"""Chains, their links, branches and alignment.

A chain position is a row (chain_id, branch_no, pos, name, formula, entity_id, ...), a link is a
row (chain_id, branch_no, from_pos, student_id, teacher_id, ...). A chain is a short unit: windows
and arrays over one chain are bounded by its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chainproof.functions import lexicons as X
from chainproof.functions import rules
from chainproof.functions.similarity import same_entity
from chainproof.functions.text import formula_strength, name_tokens, normalize, short_name
from chainproof.sources.work import written

CHAIN = ["chain_id", "branch_no"]


def chain_links(positions: DataFrame) -> DataFrame:
    """WN-3: consecutive pairs: from_pos, student_id, teacher_id and the student's formula."""
    order = W.partitionBy(*CHAIN).orderBy("pos")
    rows = positions.select(*CHAIN, F.col("pos").alias("from_pos"), F.col("entity_id").alias("student_id"), F.lead("entity_id").over(order).alias("teacher_id"), "formula", F.lead("pos").over(order).alias("_next"))
    return rows.where("_next is not null").drop("_next")


def terminal_entity(positions: DataFrame) -> DataFrame:
    """WN-7: the last resolved entity of each chain; the appended source does not count."""
    real = positions.where(F.col("entity_id").isNotNull() & (F.col("entity_id") != X.SOURCE_ID))
    return real.groupBy(*CHAIN).agg(F.max(F.struct("pos", "entity_id")).alias("t")).select(*CHAIN, F.col("t.pos").alias("terminal_pos"), F.col("t.entity_id").alias("terminal_id"))


def append_source(positions: DataFrame, attributions: DataFrame, raised: tuple[str, ...] = ("marfu_sarih", "marfu_hukman", "qudsi")) -> DataFrame:
    """WN-6: positions with the synthetic source after the last of each raised chain."""
    up = attributions.where(F.col("attribution").isin(*raised)).select(*CHAIN)
    last = positions.groupBy(*CHAIN).agg((F.max("pos") + 1).alias("pos")).join(up, CHAIN, "left_semi")
    source = last.withColumns({"name": F.lit(X.SOURCE_NAME), "formula": F.lit(None).cast("string"), "entity_id": F.lit(X.SOURCE_ID).cast("long")})
    return positions.select(*CHAIN, "pos", "name", "formula", "entity_id").unionByName(source)


def break_runs(links: DataFrame) -> DataFrame:
    """WN-5 and CL-6: of each chain's impossible links the number, first and last; break_type."""
    bad = F.col("status") == "impossible"
    out = links.groupBy(*CHAIN).agg(F.count_if(bad).alias("breaks"), F.min(F.when(bad, F.col("from_pos"))).alias("first_break"), F.max(F.when(bad, F.col("from_pos"))).alias("last_break"))
    return out.withColumn("break_type", rules.break_type(F.col("breaks"), F.col("first_break"), F.col("last_break")))


def attestation_summary(links: DataFrame) -> DataFrame:
    """AG-8, the link to the appended source left out."""
    real = links.where(F.coalesce(F.col("teacher_id") != X.SOURCE_ID, F.lit(True)))
    out = real.groupBy(*CHAIN).agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("status") == "attested").alias("attested"), F.count_if(F.col("verb") == "samaa").alias("heard"))
    return out.withColumn("strength", rules.attestation_label(F.col("links"), F.col("attested"), F.col("heard")))


def tadlis_summary(links: DataFrame, positions: DataFrame, entities: DataFrame, key: str = "entity_id") -> DataFrame:
    """AG-9: per chain the ordered (kind, pos) instances and whether there is one of each kind."""
    one = links.where("tadlis_concern").select(*CHAIN, F.lit("ambiguous").alias("kind"), F.col("from_pos").alias("pos"))
    who = entities.where("practices_taswiya").select(F.col(key).alias("entity_id"))
    two = positions.where(formula_strength(F.col("formula")) == "ambiguous").join(who, "entity_id", "left_semi").select(*CHAIN, F.lit("taswiya").alias("kind"), "pos")
    return one.unionByName(two).groupBy(*CHAIN).agg(
        F.sort_array(F.collect_list(F.struct("kind", "pos"))).alias("instances"), F.bool_or(F.col("kind") == "ambiguous").alias("has_ambiguous"), F.bool_or(F.col("kind") == "taswiya").alias("has_taswiya"))


def chain_verdicts(positions: DataFrame, links: DataFrame) -> DataFrame:
    """CL-5: a verdict for each chain. ``positions`` has grade (effective) and status, ``links``
    status. Also n_unknown, the entities without a known grade."""
    p = positions.groupBy(*CHAIN).agg(
        F.bool_or(F.coalesce(F.col("grade").isin(*rules.WEAK), F.lit(False))).alias("weak"), F.bool_and(F.coalesce(F.col("status") == "matched", F.lit(False))).alias("matched"),
        F.bool_and(F.coalesce(F.col("grade").isin(*rules.SOUND), F.lit(False))).alias("sound"), F.count_if(F.coalesce(F.col("grade"), F.lit("unknown")) == "unknown").alias("n_unknown"), F.count(F.lit(1)).alias("n_positions"))
    k = links.groupBy(*CHAIN).agg(F.bool_or(F.col("status") == "impossible").alias("broken"), F.bool_and(F.col("status").isin("attested", "possible")).alias("known"))
    out = p.join(k, CHAIN, "left")
    v = rules.verdict(F.coalesce("broken", F.lit(False)), F.col("weak"), F.col("matched"), F.coalesce("known", F.lit(True)), F.col("sound"))
    return out.select(*CHAIN, v.alias("verdict"), "n_unknown", "n_positions")


def rank_branches(branches: DataFrame) -> DataFrame:
    """TK-3 and CL-12: per chain the strongest branch, the first of equals, and how many further
    sound branches confirm it (null if the rule gives no note)."""
    ranks = {"sahih_candidate": 0, "hasan_candidate": 1, "daif": 2, "needs_review": 3, "broken": 4}
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("verdict"))
    out = branches.groupBy("chain_id").agg(F.min(F.struct(rank.alias("r"), "branch_no", "verdict")).alias("b"), F.count(F.lit(1)).alias("branches"), F.count_if(rank <= 1).alias("good"))
    note = F.when((F.col("branches") >= 2) & (F.col("b.r") <= 1) & (F.col("good") > 1), F.col("good") - 1)
    return out.select("chain_id", F.col("b.branch_no").alias("primary_branch"), F.col("b.verdict").alias("verdict"), "branches", note.alias("confirmed_by"))


def apply_decisions(positions: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """JN-7: positions (chain_id, branch_no, pos) with entity_id, status and confidence: a decision
    counts only if its id is among the position's candidates; the first of several counts."""
    at = [*CHAIN, "pos"]
    d = decisions.groupBy(*at).agg(F.min_by(F.struct("chosen_id", "confidence"), "ord").alias("d"))
    ids = candidates.groupBy(*at).agg(F.collect_set("entity_id").alias("ids"))
    out = positions.join(ids, at, "left").join(d, at, "left")
    good = F.coalesce(F.array_contains("ids", F.col("d.chosen_id")), F.lit(False))
    confidence = F.when(F.col("d.confidence").isin("high", "medium", "low"), F.col("d.confidence")).otherwise("low")
    status = F.when(F.col("ids").isNull(), "not_found").when(good, "matched").otherwise("needs_review")
    return out.select(*at, F.when(good, F.col("d.chosen_id")).alias("entity_id"), status.alias("status"), F.when(good, confidence).alias("confidence"))


def disambiguate(candidates: DataFrame, edges: DataFrame, years: DataFrame, hints: DataFrame | None = None, near: int = 80) -> DataFrame:
    """JN-8: per position one of its candidates (chain_id, branch_no, pos, entity_id, score), chosen for the chain as a whole:
    the path through the candidates whose links weigh most, of equal ones that of most score (in millionths), then of the
    smaller ids from the first position on. A link between candidates of neighbouring positions weighs 4 for a hint (entity_id, student_id), 2 for an
    edge and 1 for years within ``near``. ``support`` is what the links on either side weigh.

    A dynamic program in one fold over each chain keeps the best path to each candidate of the position reached.
    """
    at = [*CHAIN, "pos"]
    year = years.groupBy("entity_id").agg(F.min("year").cast("double").alias("year"))
    # dealt by chain once: what follows up to the table of chains is done where the rows lie
    own = candidates.join(year, "entity_id", "left").repartition(*CHAIN).groupBy(*at, "entity_id").agg(F.round(F.max("score") * 1_000_000).cast("long").alias("m"), F.first("year").alias("y"))
    nodes = own.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct(F.col("entity_id").cast("long").alias("e"), "m", "y"))).alias("nodes"))
    lattice = written(nodes.groupBy(*CHAIN).agg(F.sort_array(F.collect_list(F.struct("pos", "nodes"))).alias("l")), "chains")  # a chain
    follows = lambda i: (i > 0) & (F.get("l", i - 1)["pos"] + 1 == F.get("l", i)["pos"])
    met = lambda p, i: F.flatten(F.transform(F.when(follows(i), F.get("l", i - 1)["nodes"]).otherwise(F.array()), lambda s: F.transform(p["nodes"], lambda e: F.struct(p["pos"].alias("pos"), s["e"].alias("s"), e["e"].alias("e")))))
    pairs = lattice.select(*CHAIN, F.explode(F.flatten(F.transform("l", met))).alias("t")).select(*CHAIN, "t.*")
    known = edges.select(F.col("student_id").cast("long").alias("s"), F.col("teacher_id").cast("long").alias("e"), F.lit(2).alias("w")).distinct()
    if hints is not None:
        known = known.unionByName(hints.select(F.col("student_id").cast("long").alias("s"), F.col("entity_id").cast("long").alias("e"), F.lit(4).alias("w")).distinct())
    links = pairs.join(known.groupBy("s", "e").agg(F.sum("w").alias("w")), ["s", "e"]).groupBy(*CHAIN).agg(F.collect_list(F.struct("pos", "s", "e", "w")).alias("links"))  # a chain's
    linked = lambda p, i: F.struct(p["pos"].alias("pos"), p["nodes"].alias("nodes"), F.coalesce(F.filter("links", lambda t: t["pos"] == p["pos"]), F.array()).alias("links"), F.coalesce(follows(i), F.lit(False)).alias("follows"))
    chains = lattice.join(links, CHAIN, "left").select(*CHAIN, F.transform("l", linked).alias("l"))
    kind = "array<struct<w: bigint, m: bigint, path: array<bigint>, weights: array<bigint>, y: double>>"

    def step(ways: Column, p: Column) -> Column:
        def onto(x: Column) -> Column:
            links_of = lambda a: F.coalesce(F.array_max(F.transform(F.filter(p["links"], lambda t: (t["s"] == F.element_at(a["path"], -1)) & (t["e"] == x["e"])), lambda t: t["w"])), F.lit(0).cast("long"))
            weigh = lambda a: links_of(a) + F.when(p["follows"] & (F.abs(a["y"] - x["y"]) <= near), 1).otherwise(0)
            way = lambda a: F.get(F.transform(F.array(weigh(a)), lambda w: F.struct((a["w"] - w).alias("w"), (a["m"] - x["m"]).alias("m"), F.array_append(a["path"], x["e"]).alias("path"), F.array_append(a["weights"], w).alias("weights"), x["y"].alias("y"))), F.lit(0))
            return F.array_min(F.transform(ways, way))

        first = F.transform(p["nodes"], lambda x: F.struct(F.lit(0).cast("long").alias("w"), (-x["m"]).alias("m"), F.array(x["e"]).alias("path"), F.array(F.lit(0).cast("long")).alias("weights"), x["y"].alias("y")))
        return F.when(F.size(ways) == 0, first).otherwise(F.transform(p["nodes"], onto)).cast(kind)

    best = chains.select(*CHAIN, "l", F.array_min(F.aggregate("l", F.array().cast(kind), step)).alias("b"))
    rows = best.select(*CHAIN, "b", F.posexplode("l").alias("i", "p"))
    support = F.get("b.weights", F.col("i")) + F.coalesce(F.get("b.weights", F.col("i") + 1), F.lit(0))
    return rows.select(*CHAIN, F.col("p.pos").alias("pos"), F.get("b.path", F.col("i")).alias("entity_id"), support.alias("support"))


def _keys_of(t: Column) -> Column:
    """Keys of a sorted token set, one of which any other has that SC-24 takes for the same: two tokens in common, or, of
    sets of one or two, one."""
    pairs = F.flatten(F.transform(t, lambda x, i: F.transform(F.slice(t, i + 2, F.size(t)), lambda y: F.xxhash64(x, y))))
    return F.when(F.size(t) <= 2, F.concat(pairs, F.transform(t, lambda x: F.xxhash64(x)))).otherwise(pairs)


def folded_names(members: DataFrame, group: list[str], *, order: str = "o", name: str = "name", noise: list[str], affixes: list[str]) -> DataFrame:
    """``members`` (group, name, order; names of a group distinct) without those that SC-24 takes for the same as an earlier one that stays:
    what a fold over each group in its order leaves, without a fold.

    A name is settled once all earlier ones like it are: it stays if none of them does. In rounds, names with no earlier
    one like them left stay, and those like these go, so that a group takes as many rounds as its longest run of names
    that decide each other, a few, and is never one row. Names meet over an index of their tokens.
    """
    tokens = members.select(name).distinct().withColumn("t", F.array_sort(name_tokens(F.col(name), noise, affixes)))
    tokens = written(tokens.withColumn("keys", _keys_of(F.col("t"))), "tokens")
    keyed = members.join(tokens.where(F.size("keys") > 0), name).select(*group, F.col(order).alias("o"), F.col(name).alias("n"), "t", F.explode("keys").alias("k"))
    one = keyed.toDF(*group, "o1", "n1", "t1", "k")
    met = one.join(keyed, [*group, "k"]).where((F.col("o1") < F.col("o")) & same_entity(F.col("n1"), F.col("n"), F.col("t1"), F.col("t")))
    links = written(met.select(*group, "n1", "n").distinct(), "links")
    gone = None
    while not links.isEmpty():
        later = links.select(*group, F.col("n").alias("n1")).distinct()
        goes = written(links.join(later, [*group, "n1"], "left_anti").select(*group, "n").distinct(), "goes")
        gone = goes if gone is None else gone.unionByName(goes)
        links = links.join(goes, [*group, "n"], "left_anti").join(goes.withColumnRenamed("n", "n1"), [*group, "n1"], "left_anti")
        links = written(links, "links")
    return members if gone is None else members.join(gone.withColumnRenamed("n", name), [*group, name], "left_anti")


def _meeting(rows: DataFrame, group: list[str], name: str, noise: list[str], affixes: list[str], samples: int) -> DataFrame:
    """(group, meets, m, n), written: of the distinct names of each group, as ``m`` those that share a key with another one of
    their group, and of the others the first ``samples``; the rest is only counted.

    A key that one name alone has, of all groups, is left out. Rows are dealt by group once, and all else is done where they
    lie: distinct names, those that meet, and counts are sorts of a task's rows, which hold no group as a whole.
    """
    keys = rows.select(name).distinct().withColumn("k", F.explode(_keys_of(F.array_sort(name_tokens(F.col(name), noise, affixes)))))
    keys = written(keys, "keys")
    often = keys.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k")
    keyed = written(keys.join(often, "k").groupBy(name).agg(F.collect_list("k").alias("ks")), "keyed")
    own = rows.repartition(*group).groupBy(*group, name).agg(F.min("o").alias("o")).join(keyed, name, "left")
    own = own.select(*group, name, "o", F.explode_outer("ks").alias("k"))
    other = F.count(F.lit(1)).over(W.partitionBy(*group, "k")) > 1
    own = own.withColumn("meets", F.col("k").isNotNull() & other).groupBy(*group, name, "o").agg(F.bool_or("meets").alias("meets"))
    member = F.struct("o", name)
    kept = F.col("meets")
    if samples:
        own = own.withColumn("r", F.row_number().over(W.partitionBy(*group, "meets").orderBy("o", name)))
        kept = kept | (F.col("r") <= samples)
    return written(own.groupBy(*group, "meets", F.when(kept, member).alias("m")).agg(F.count(F.lit(1)).alias("n")), "meeting")


def level_counts(chains: DataFrame, key: str = "passage_id", *, noise: list[str] | None = None, affixes: list[str] | None = None, samples: int = 5) -> DataFrame:
    """AG-5: (key, level, n, samples) of ``chains`` (key, score, chain_id, names from compiler to
    source): names at each level from the source, in order of falling score and chain_id, folded
    into clusters by SC-24 against each cluster's first name; the ``samples`` first as samples (0: no such column).

    Only names that may be like another one of their level are folded; the others stay as they are.
    """
    noise = X.NAME_NOISE["align"] if noise is None else noise
    affixes = X.NAME_AFFIXES["align"] if affixes is None else affixes
    rows = chains.select(key, "score", "chain_id", F.posexplode(F.reverse("names")).alias("level", "name")).where("name is not null")
    rows = rows.select(key, "level", "name", F.struct((-F.col("score")).alias("s"), "chain_id").alias("o"))
    group = [key, "level"]
    all_names = _meeting(rows, group, "name", noise, affixes, samples)
    alone = all_names.where("not meets")
    some = all_names.where("meets").select(*group, F.col("m.name").alias("name"), F.struct("m.o.s", "m.o.chain_id", "m.name").alias("o"))
    stay = folded_names(some, group, noise=noise, affixes=affixes)
    counted = alone.select(*group, "n").unionByName(stay.select(*group, F.lit(1).cast("long").alias("n")))
    out = counted.groupBy(*group).agg(F.sum("n").cast("int").alias("n"))
    if not samples:
        return out
    first = alone.where("m is not null").select(*group, F.col("m.name").alias("name"), F.struct("m.o.s", "m.o.chain_id", "m.name").alias("o")).unionByName(stay.select(*group, "name", "o"))
    first = first.withColumn("r", F.row_number().over(W.partitionBy(*group).orderBy("o"))).where(F.col("r") <= samples)
    return out.join(first.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("samples")), group)


def bottleneck(levels: DataFrame, chains: DataFrame, matches: DataFrame, key: str = "passage_id") -> DataFrame:
    """AG-6: per passage the least count, its earliest level, the chains and the distinct books of
    the relevant matches."""
    low = levels.groupBy(key).agg(F.min(F.struct("n", "level")).alias("m"))
    c = chains.groupBy(key).agg(F.count(F.lit(1)).alias("total_chains"))
    b = matches.groupBy(key).agg(F.count_distinct("book_id").alias("distinct_books"))
    return low.join(c, key).join(b, key, "left").select(key, F.col("m.n").alias("min_count"), F.col("m.level").alias("narrowest_level"), "total_chains", "distinct_books")


def conditions(verdicts: DataFrame, tadlis: DataFrame, links: DataFrame, positions: DataFrame) -> DataFrame:
    """CL-13: (chain_id, branch_no, ord, condition, ok): connection, probity, clearance where a
    listed entity used an ambiguous verb, and the standing disclaimer."""
    weak = positions.groupBy(*CHAIN).agg(F.bool_or(F.coalesce(F.col("grade").isin(*rules.WEAK), F.lit(False))).alias("weak"))
    heard = links.groupBy(*CHAIN).agg(F.coalesce(F.bool_or(F.col("verb") == "samaa"), F.lit(False)).alias("heard"))
    rows = verdicts.join(weak, CHAIN, "left").join(heard, CHAIN, "left").join(tadlis.select(*CHAIN, (F.col("has_ambiguous") | F.col("has_taswiya")).alias("risk")), CHAIN, "left")
    item = lambda o, n, ok: F.struct(F.lit(o).alias("ord"), F.lit(n).alias("condition"), ok.alias("ok"))
    items = F.array(item(1, "connection", F.col("verdict") != "broken"), item(2, "probity", ~F.coalesce("weak", F.lit(False))), item(3, "clearance", F.coalesce("heard", F.lit(False))), item(4, "disclaimer", F.lit(True)))
    kept = F.filter(items, lambda x: (x["ord"] != 3) | F.coalesce("risk", F.lit(False)))
    return rows.select(*CHAIN, F.explode(kept).alias("i")).select(*CHAIN, "i.ord", "i.condition", "i.ok")


def solitary_narrative(positions: DataFrame, from_source: bool = True, *, first: str = "تفرَّد به {a} عن {b}", then: str = "ثم تفرَّد به {a} عن {b}", source: str = "النبي ﷺ", separator: str = "، ") -> DataFrame:
    """CL-15: (chain_id, branch_no, narrative), source first: who alone relayed from whom."""
    real = positions.where(F.col("entity_id").isNotNull() & (F.col("entity_id") > 0))
    order = W.partitionBy(*CHAIN).orderBy(F.desc("pos"))
    rows = real.select(*CHAIN, "pos", short_name(F.col("name")).alias("a"), F.lag(short_name(F.col("name"))).over(order).alias("b"), F.count(F.lit(1)).over(W.partitionBy(*CHAIN)).alias("n")).where("n >= 2")
    b = F.coalesce("b", F.lit(source)) if from_source else F.col("b")
    rows = rows.withColumn("b", b).where("b is not null")
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("pos")).alias("o"), "a", "b"))), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    parts = rows.groupBy(*CHAIN).agg(listed.alias("l"))

    def spelled(pattern: str, x: Column) -> Column:
        before, rest = pattern.split("{a}")
        middle, after = rest.split("{b}")
        return F.concat(F.lit(before), x["a"], F.lit(middle), x["b"], F.lit(after))

    text = F.array_join(F.transform("l", lambda x, i: F.when(i == 0, spelled(first, x)).otherwise(spelled(then, x))), separator)
    return parts.select(*CHAIN, text.alias("narrative"))


def link_reason(links: DataFrame, books: DataFrame, *, authors: dict[str, str] = X.DENIAL_AUTHORS, author: str = X.DENIAL_AUTHOR, verb_labels: dict[str, str] = X.VERB_LABELS) -> DataFrame:
    """CL-16: links with reason, made of the denial and its author, or the edge with up to three
    books and the verb, else the dates' status; and a warning of ambiguous transmission."""
    titles = F.map_from_entries(F.array(*[F.struct(F.lit(r["book"]), F.lit(r["title"])) for r in books.select("book", "title").orderBy("book").collect()]))  # a small fixed table
    title = lambda c: F.coalesce(F.try_element_at(titles, c), c)
    lookup = lambda m, c, d: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c), d)
    denial = F.concat(lookup(authors, F.col("denial_book"), F.lit(author)), F.lit(" | "), title(F.col("denial_book")), F.lit(" | "), F.col("denial_phrase"))
    known = F.array_join(F.transform(F.slice(F.coalesce("source_books", F.array().cast("array<string>")), 1, 3), lambda b: title(b)), "; ")
    verb = F.when(F.col("verb").isNotNull(), F.concat(F.lit(" | "), lookup(verb_labels, F.col("verb"), F.col("verb")), F.lit(" | "), title(F.col("verb_book")), F.coalesce(F.concat(F.lit(" | "), F.col("verb_phrase")), F.lit("")))).otherwise("")
    said = F.when(F.col("dates") == "impossible", F.lit("dates: impossible")).when(F.col("denial_book").isNotNull(), F.concat(F.lit("denied: "), denial)).when(F.col("is_edge"), F.concat(F.lit("edge: "), known, verb)).otherwise(F.concat(F.lit("dates: "), F.col("dates")))
    return links.withColumn("reason", F.concat(said, F.when(F.col("tadlis_concern"), F.lit(" | ambiguous")).otherwise("")))


def tadlis_ruling(positions: DataFrame, links: DataFrame, summary: DataFrame, entities: DataFrame, key: str = "entity_id") -> DataFrame:
    """CL-17: per chain clean, harmless, suspended or disqualifying, and the listed entities in
    order with tier and whether hearing clears them."""
    listed = positions.join(entities.where("tadlis_tier is not null").select(F.col(key).alias("entity_id"), "tadlis_tier"), "entity_id")
    heard = links.select(*CHAIN, F.col("from_pos").alias("pos"), F.coalesce(F.col("verb") == "samaa", F.lit(False)).alias("cleared"))
    rows = listed.join(heard, [*CHAIN, "pos"], "left").groupBy(*CHAIN).agg(F.sort_array(F.collect_list(F.struct("pos", "entity_id", "tadlis_tier", F.coalesce("cleared", F.lit(False)).alias("cleared")))).alias("listed"))
    out = positions.select(*CHAIN).distinct().join(rows, CHAIN, "left").join(summary.select(*CHAIN, "has_ambiguous", "has_taswiya"), CHAIN, "left")
    ruling = F.when(F.col("listed").isNull(), "clean").when(F.col("has_taswiya"), "disqualifying").when(F.col("has_ambiguous"), "suspended").otherwise("harmless")
    return out.select(*CHAIN, ruling.alias("ruling"), "listed")


def explain(verdicts: DataFrame, positions: DataFrame, links: DataFrame) -> DataFrame:
    """CL-14: per chain one line: daif: the first weak entity, its phrase and book; broken: the first
    denial, else the first impossible link; sound: a heard link, else one in two books or more."""
    weak = positions.where(F.col("grade").isin(*rules.WEAK)).groupBy(*CHAIN).agg(F.min(F.struct("pos", F.concat_ws(" | ", F.lit("weak"), F.col("entity_id").cast("string"), F.col("grade_text"), F.col("grade_book")).alias("t"))).alias("w"))
    two = F.size(F.coalesce("source_books", F.array().cast("array<string>")))
    pick = lambda order, t: F.min(F.when(order, F.struct("from_pos", t.alias("t"))))
    pair = F.concat_ws(" > ", F.col("student_id").cast("string"), F.col("teacher_id").cast("string"))
    ends = links.groupBy(*CHAIN).agg(
        pick(F.col("denial_phrase").isNotNull() & (F.col("status") == "impossible"), F.concat(F.lit("denied | "), pair, F.lit(" | "), F.col("denial_phrase"))).alias("d"),
        pick(F.col("status") == "impossible", F.concat(F.lit("dates | "), pair)).alias("i"),
        pick(F.col("verb") == "samaa", F.concat(F.lit("heard | "), pair)).alias("h"),
        pick(two >= 2, F.concat(F.lit("books | "), two.cast("string"))).alias("b"),
    )
    out = verdicts.select(*CHAIN, "verdict").join(weak, CHAIN, "left").join(ends, CHAIN, "left")
    v = F.col("verdict")
    return out.select(*CHAIN, "verdict", F.when(v == "daif", F.col("w.t")).when(v == "broken", F.coalesce("d.t", "i.t")).when(v.isin("sahih_candidate", "hasan_candidate"), F.coalesce("h.t", "b.t")).alias("explanation"))


def reasons_by_position(positions: DataFrame, patterns=X.REASONS, *, adala: tuple[str, ...] | None = None) -> DataFrame:
    """AG-10: positions with reasons (SC-15 on grade_text), and whether one is against probity."""
    from chainproof.functions.text import tag_reasons

    family = [r for _, r, f in patterns if f == "adala"] if adala is None else list(adala)
    rows = positions.withColumn("reasons", tag_reasons(F.coalesce("grade_text", F.lit("")), patterns)).where(F.size("reasons") > 0)
    return rows.select(*CHAIN, "pos", "reasons", F.arrays_overlap("reasons", F.array(*[F.lit(x) for x in family])).alias("against_probity"))


def normalised_names(positions: DataFrame) -> DataFrame:
    return positions.withColumn("name", normalize(F.col("name")))
