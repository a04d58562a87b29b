"""Evidence about entities and pairs: grades, edges, denials, verbs, places, books."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chainproof.functions import lexicons as X
from chainproof.functions.text import cities, city_set, grade_tier, is_mention_only, is_protected, min_length, normalize, nullable, printed_grade, short_name
from chainproof.sources.work import written

#: Buckets of criticism; the second profile removes one more for the protected class.
CRITICISM = {"summary": ("weak", "abandoned", "fabricator"), "harshest": ("weak", "abandoned", "fabricator", "mostly_reliable")}


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(nullable(c)) == "", F.lit(True))


def eligible_targets(entities: DataFrame, grades: DataFrame, base: str, overlay: str, key: str = "entity_id") -> DataFrame:
    """PF-1: entities without a value in either column that have a grade row."""
    return entities.where(blank(F.col(base)) & blank(F.col(overlay))).join(grades.select(key), key, "left_semi")


def protected_entities(entities: DataFrame, grades: DataFrame, key: str = "entity_id") -> DataFrame:
    """Ids of the protected class, by their own generation text or any grade row."""
    own = entities.where(is_protected(F.col("tabaqat"), F.lit(None).cast("string"), F.lit(None).cast("string"), "entity")).select(key)
    by_grade = grades.where(is_protected(F.lit(None).cast("string"), F.col("grade_text"), F.col("bucket"), "entity")).select(key)
    return own.unionByName(by_grade).distinct()


def graded_rows(grades: DataFrame, protected: DataFrame, profile: str = "summary", key: str = "entity_id", verbs: Sequence[str] = X.MENTION_VERBS) -> DataFrame:
    """PF-5: rows that hold an opinion: a known bucket, no mere mention, and for the protected
    class no criticism by the ``profile``."""
    rows = grades.where(F.col("bucket").isNotNull() & (F.col("bucket") != "unknown") & ~is_mention_only(F.col("grade_text"), verbs))
    critical = F.col("bucket").isin(*CRITICISM[profile])
    return rows.join(protected.select(key).withColumn("_p", F.lit(True)), key, "left").where(F.col("_p").isNull() | ~critical).drop("_p")


def harshest_grade(graded: DataFrame, key: str = "entity_id") -> DataFrame:
    """AG-1: the worst row of each entity: lowest tier, then longest text (null first), then id."""
    length = F.coalesce(F.length("grade_text"), F.lit(2**31 - 1))
    worst = F.min(F.struct(grade_tier(F.col("bucket")).alias("tier"), (-length).alias("l"), "grade_id", "bucket", "grade_text", "source_book"))
    return graded.groupBy(key).agg(worst.alias("w")).select(key, "w.bucket", "w.grade_text", "w.source_book", "w.tier")


def disagreement(graded: DataFrame, key: str = "entity_id") -> DataFrame:
    """AG-2 and AG-3: distinct buckets, spread of tiers, the first row of the highest and of the
    lowest tier, and the severity of the spread."""
    tier = grade_tier(F.col("bucket"))
    out = graded.groupBy(key).agg(
        F.count_distinct("bucket").alias("distinct_grades"), (F.max(tier) - F.min(tier)).alias("tier_spread"),
        F.min(F.struct((-tier).alias("t"), "grade_id", "bucket")).alias("h"), F.min(F.struct(tier.alias("t"), "grade_id", "bucket")).alias("l"),
    )
    return out.select(key, "distinct_grades", "tier_spread", F.col("h.bucket").alias("highest"), F.col("l.bucket").alias("lowest"), disagreement_severity(F.col("tier_spread")).alias("severity"))


def disagreement_severity(spread: Column) -> Column:
    """AG-3."""
    return F.when(spread >= 3, "severe").when(spread == 2, "notable").when(spread == 1, "minor").otherwise("suppressed")


def prominence(grades: DataFrame, key: str = "entity_id") -> DataFrame:
    """AG-4: grade rows of each entity."""
    return grades.groupBy(key).agg(F.count(F.lit(1)).alias("prominence"))


def verb_counts(verbs: DataFrame) -> DataFrame:
    """AG-7."""
    return verbs.groupBy("verb").agg(F.count(F.lit(1)).alias("n"))


def valid_edges(edges: DataFrame, nodes: DataFrame, key: str = "entity_id") -> DataFrame:
    """JN-13: distinct edges of which both ends exist."""
    ids = nodes.select(F.col(key).alias("_n")).distinct()
    out = edges
    for end in ("student_id", "teacher_id"):
        out = out.join(ids, out[end] == ids["_n"], "left_semi")
    return out.distinct()


def edge_union(as_teacher: DataFrame, as_student: DataFrame) -> DataFrame:
    """SO-2: distinct (student_id, teacher_id) of both kinds of adjacency."""
    cols = ["student_id", "teacher_id"]
    return as_teacher.select(*cols).unionByName(as_student.select(*cols)).distinct()


def edge_attestation(edges: DataFrame, grades: DataFrame, key: str = "entity_id") -> DataFrame:
    """JN-14: edges with the sorted books that know both ends; none if either end has none."""
    books = grades.where("source_book is not null").groupBy(key).agg(F.collect_set("source_book").alias("b"))
    s = books.select(F.col(key).alias("student_id"), F.col("b").alias("sb"))
    t = books.select(F.col(key).alias("teacher_id"), F.col("b").alias("tb"))
    none = F.array().cast("array<string>")
    both = F.sort_array(F.array_intersect(F.coalesce("sb", none), F.coalesce("tb", none)))
    return edges.select("student_id", "teacher_id").join(s, "student_id", "left").join(t, "teacher_id", "left").select("student_id", "teacher_id", both.alias("books"))


def top_neighbours(edges: DataFrame, prominent: DataFrame, role: str = "teacher", k: int = 20, key: str = "entity_id") -> DataFrame:
    """JN-15: each node's ``k`` most prominent teachers (or students), as an ordered array."""
    own, other = ("student_id", "teacher_id") if role == "teacher" else ("teacher_id", "student_id")
    rows = edges.select(F.col(own).alias(key), F.col(other).alias("n")).join(prominent.select(F.col(key).alias("n"), "prominence"), "n", "left").withColumn("p", F.coalesce("prominence", F.lit(0)))
    top = rows.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("p"), "n"))).where(F.col("r") <= k)
    return top.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "n", "p"))), lambda x: F.struct(x["n"].alias("id"), x["p"].alias("prominence"))).alias("neighbours"))


def lookup_edges(links: DataFrame, edges: DataFrame) -> DataFrame:
    """JN-9: links with is_edge and books; ids of 0 or less are never edges."""
    e = edges.select("student_id", "teacher_id", F.col("books").alias("source_books"), F.lit(True).alias("_e")).where("student_id > 0 and teacher_id > 0")
    return links.join(e, ["student_id", "teacher_id"], "left").withColumn("is_edge", F.coalesce("_e", F.lit(False))).drop("_e")


def lookup_negative(links: DataFrame, denials: DataFrame) -> DataFrame:
    """JN-10: links with denial_book and denial_phrase of the first recorded denial."""
    first = denials.groupBy("student_id", "teacher_id").agg(F.min_by(F.struct(F.col("source_book").alias("b"), F.col("phrase").alias("p")), "denial_id").alias("d"))
    return links.join(first, ["student_id", "teacher_id"], "left").withColumns({"denial_book": F.col("d.b"), "denial_phrase": F.col("d.p")}).drop("d")


def lookup_strongest_verb(links: DataFrame, verbs: DataFrame, ranks: dict[str, int] = X.VERB_RANKS) -> DataFrame:
    """JN-11: links with verb, verb_book and verb_phrase of the strongest known verb, the first of
    equals."""
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("verb"))
    known = verbs.withColumn("_r", rank).where("_r is not null")
    best = known.groupBy("student_id", "teacher_id").agg(F.min(F.struct((-F.col("_r")).alias("r"), "attestation_id", F.col("verb").alias("v"), F.col("source_book").alias("b"), F.col("phrase").alias("p"))).alias("d"))
    return links.join(best, ["student_id", "teacher_id"], "left").withColumns({"verb": F.col("d.v"), "verb_book": F.col("d.b"), "verb_phrase": F.col("d.p")}).drop("d")


#: Bits of a bitmap for each name, most of all, and how many a name sets; letters of a name's first (and third) word and of all of it that are looked for at once.
BITS, MOST_BITS, TIMES, HEAD, KEY = 16, 1 << 29, 3, 16, 64
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


class _Spelling:
    """Hashes of any stretches of a text: differences of sums of its letters times powers of an odd number, made comparable by inverse powers."""

    powers, inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, text: str):
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        cls = _Spelling
        while len(cls.powers) <= len(letters):
            n = max(2 * len(cls.powers), 1 << 14)
            cls.powers, cls.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.letters = letters
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((letters + np.uint64(1)) * cls.powers[: len(letters)], dtype=np.uint64)])

    def hashes(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[begins]) * _Spelling.inverse[begins]
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(32))


def _shape(name: str) -> tuple[int, int]:
    """How many letters of a name's key are before its first blank (-1: it has none), and in all."""
    a = name.find(" ")
    head = min(a, HEAD)
    return (-1, min(len(name), KEY)) if a < 0 else (head, min(head + len(name) - a, KEY))


def _key(name: str) -> str:
    head, n = _shape(name)
    begin = name.find(" ") - head if head >= 0 else 0
    return name[begin : begin + n]


def _anchor(head: int, n: int) -> tuple[int, int]:
    """The letters of a key, by its shape, that are looked for first: before its blank, and in all."""
    if head < 0:
        return -1, min(n, 6)
    if head == 0:
        return 0, min(n, 5)
    return (3, 11) if head >= 3 and n - head >= 8 else (1, 1 + min(n - head, 5))  # few shapes, as each is looked for at every blank


def _ends(name: str) -> tuple[int, int, int, int] | None:
    """Of a name with two blanks these, and the letters of its key before the first and after the second. None if it has fewer."""
    a = name.find(" ")
    b = name.find(" ", a + 1) if a >= 0 else -1
    if b < 0:
        return None
    c = name.find(" ", b + 1)
    return a, b, min(a, HEAD), min((len(name) if c < 0 else c) - b - 1, HEAD)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names with keys, their shapes and hashes of anchors and keys, and of what keys have before the third word.

    The second word of a name stands between blanks in a text too. So the key of a name of three words or more is that, and what is
    beside it (``head`` and ``rest`` letters); where it may stand is known from the blanks, and its length need not be tried.
    """
    for batch in batches:
        rows = []
        for name in batch.column("name").to_pylist():
            if ends := _ends(name):
                a, b, head, rest = ends
                key, n = name[a - head : b + 1 + rest], -1
                own = (head - min(head, 1), head + b - a + 1 + min(rest, 1)), (0, len(key)), (0, head + b - a + 1)
            else:
                key, (head, n), rest = _key(name), _shape(name), -1
                before, m = _anchor(head, n)
                begin = max(head, 0) - max(before, 0)
                own = (begin, begin + m), (0, n), (0, n)
            h = _Spelling(key).hashes(*np.array(own).T)
            rows.append((key, head, n, rest, *np.stack([_place(h, i) for i in range(TIMES)], axis=1).astype(np.int64).tolist()))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3)
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("nid"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["name", "nid", "key", "head", "n", "rest", "h1", "h2", "h3"])


def _place(h: np.ndarray, i: int) -> np.ndarray:
    """The ``i``-th bit of a hash, to be taken by the size of a bitmap."""
    return h + np.uint64(i) * (h >> np.uint64(32) | np.uint64(1)) if i else h


def _within(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes have all their bits set."""
    which = None
    for i in range(TIMES):
        at = _place(h if which is None else h[which], i) & np.uint64(8 * len(bitmap) - 1)
        good = np.flatnonzero(bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
        which = good if which is None else which[good]
    return which


def _bitmap(hashes: DataFrame, c: str, bits: int) -> np.ndarray:
    """``bits`` bits, those of the hashes set; made by Spark in buckets."""
    at, out = F.pmod(F.col("h"), F.lit(bits)) + 1, np.zeros(bits // 8, np.uint8)
    for bucket, part in hashes.select(F.explode(c).alias("h")).groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at))).collect():  # as many bytes as the bitmap
        part = np.frombuffer(part, np.uint8)[: len(out)]
        out[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(part)] = part
    return out


_Shapes = dict[tuple[int, int], list[tuple[int, int]]]
_Sides = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def _sought(shapes: list[tuple[int, int]], sides: list[tuple[int, int]]) -> tuple[_Shapes, _Sides]:
    """What is looked for at blanks: shapes of keys by their anchors, and the letters before and after second words, by whether there are any."""
    anchors: _Shapes = {}
    for shape in shapes:
        anchors.setdefault(_anchor(*shape), []).append(shape)
    around: _Sides = {}
    for at in {(min(a, 1), min(c, 1)) for a, c in sides}:
        own = [(a, c) for a, c in sides if (min(a, 1), min(c, 1)) == at]
        around[at] = np.unique([a for a, _ in own]), np.unique([c for _, c in own])
    return anchors, around


def _stretches(t: str, bitmaps: tuple[np.ndarray, np.ndarray, np.ndarray], anchors: _Shapes, around: _Sides) -> set[str]:
    """The stretches of a text that are in the bitmaps, so may be keys."""
    one, two, three = bitmaps
    spelt, found = _Spelling(t), set()
    blanks, size = np.flatnonzero(spelt.letters == 32), len(spelt.letters)
    for (before, m), own in anchors.items():
        begins = np.arange(size) if before < 0 else blanks - before
        begins = begins[(begins >= 0) & (begins + m <= size)]
        begins = begins[_within(one, spelt.hashes(begins, begins + m))]
        if not len(begins):
            continue
        own = np.array(own)
        b = (begins[:, None] + (max(before, 0) - np.maximum(own[:, 0], 0))[None, :]).ravel()
        e = b + np.tile(own[:, 1], len(begins))
        good = (b >= 0) & (e <= size)
        b, e = b[good], e[good]
        good = _within(two, spelt.hashes(b, e))
        found.update(t[x:y] for x, y in zip(b[good].tolist(), e[good].tolist(), strict=True))
    lengths = np.diff(blanks, prepend=-1, append=size) - 1  # of words
    for (a, c), (heads, rests) in around.items():
        w = np.flatnonzero((lengths[:-2] >= a) & (lengths[2:] >= c))  # words that have two neighbours, by the one before
        w = w[_within(one, spelt.hashes(blanks[w] - a, blanks[w + 1] + 1 + c))]
        j, k = np.nonzero(lengths[w][:, None] >= heads)
        w, b = w[j], blanks[w[j]] - heads[k]
        good = _within(three, spelt.hashes(b, blanks[w + 1] + 1))
        w, b = w[good], b[good]
        j, k = np.nonzero(lengths[w + 2][:, None] >= rests)
        b, e = b[j], blanks[w[j] + 1] + 1 + rests[k]
        good = _within(two, spelt.hashes(b, e))
        found.update(t[x:y] for x, y in zip(b[good].tolist(), e[good].tolist(), strict=True))
    return found


def _mentioned(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, book, nid): the texts (id, book, t) that contain each name (nid, name), anywhere.

    Each text is read once, whatever number of names there is. A name has a key, its first letters around its first blank, or its second word
    and letters on either side. At the blanks of a text stretches are held against bitmaps of hashes, of a few letters and then of keys, and
    only of shapes that keys have; what is in all of them is
    joined with the keys, letter by letter. Names that are longer than their keys are looked for in the texts found.
    """
    spark = texts.sparkSession
    texts = written(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    names = written(names.mapInArrow(_keyed, "name string, nid long, key string, head int, n int, rest int, h1 array<long>, h2 array<long>, h3 array<long>"), "keys")
    count = names.count()
    bits = min(MOST_BITS, 1 << max(16, (BITS * count - 1).bit_length()))
    shapes = sorted((r["head"], r["n"]) for r in names.where("rest < 0").select("head", "n").distinct().collect())  # HEAD + 2 times KEY at the most
    sides = sorted((r["head"], r["rest"]) for r in names.where("rest >= 0").select("head", "rest").distinct().collect())  # HEAD + 1 times as many
    shared = spark.sparkContext.broadcast((_bitmap(names, "h1", bits), _bitmap(names, "h2", bits), _bitmap(names.where("rest >= 0"), "h3", bits), shapes, sides))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *bitmaps, shapes, sides = shared.value
        anchors, around = _sought(shapes, sides)
        for batch in batches:
            at, keys = [], []
            for i, t in enumerate(batch.column("t").to_pylist()):
                found = _stretches(t, bitmaps, anchors, around)
                at += [i] * len(found)
                keys += found
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("row", "id", "book")], pa.array(keys, pa.string())], names=["row", "id", "book", "key"])

    found = texts.mapInArrow(look, "row long, id long, book string, key string")
    found = written(found.join(names.select("key", "nid", "name"), "key").select("row", "id", "book", "nid", F.when(F.col("name") != F.col("key"), F.col("name")).alias("name")), "keys_found")
    long = found.where("name is not null").join(texts.select("row", "t"), "row").where(F.contains("t", "name"))
    return found.where("name is null").select("id", "book", "nid").unionByName(long.select("id", "book", "nid"))


def cooccurrence(pairs: DataFrame, corpus: DataFrame, k: int = 18, least: int = 6, fallback: int = 3, *, text: str = "text", key: str = "text_id", book: str = "book_id") -> DataFrame:
    """JN-12: (student_name, teacher_name, book_id, n, total) of texts that contain both short
    names; the ``k`` books with most, and the sum over them.

    Names are found as substrings of the normalised text, as particles are written onto names. All
    distinct names are looked for in one reading of each text.
    """
    short = lambda c: normalize(short_name(F.col(c), fallback))
    p = pairs.select(short("student_name").alias("s"), short("teacher_name").alias("t")).where(min_length(F.col("s"), least) & min_length(F.col("t"), least)).distinct()
    p = written(p, "pairs")
    names = p.select(F.col("s").alias("name")).unionByName(p.select(F.col("t").alias("name"))).distinct()
    # keys are made by as many tasks as a shuffle has: names are a small file
    names = names.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = written(names.withColumn("nid", F.monotonically_increasing_id()), "names")
    texts = corpus.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(book).cast("string").alias("book"), normalize(F.col(text)).alias("t"))
    found = written(_mentioned(texts, names), "mentioned")
    ids = p.join(names.select(F.col("name").alias("s"), F.col("nid").alias("sid")), "s").join(names.select(F.col("name").alias("t"), F.col("nid").alias("tid")), "t")
    a, b = found.select("id", "book", F.col("nid").alias("sid")), found.select("id", F.col("nid").alias("tid"))
    both = ids.join(a, "sid").join(b, ["id", "tid"]).groupBy("s", "t", "book").agg(F.count(F.lit(1)).alias("n"))
    top = both.withColumn("r", F.row_number().over(W.partitionBy("s", "t").orderBy(F.desc("n"), "book"))).where(F.col("r") <= k)
    return top.select(F.col("s").alias("student_name"), F.col("t").alias("teacher_name"), F.col("book").alias("book_id"), "n", F.sum("n").over(W.partitionBy("s", "t")).alias("total"))


def geo_overlap(a: Column, b: Column) -> Column:
    """JN-16: struct of status (overlap, no_overlap or unknown) and the shared places."""
    x, y = city_set(a), city_set(b)
    shared = F.array_intersect(x, y)
    status = F.when((F.size(x) == 0) | (F.size(y) == 0), "unknown").when(F.size(shared) > 0, "overlap").otherwise("no_overlap")
    return F.struct(status.alias("status"), F.when(status != "unknown", shared).otherwise(F.array().cast("array<string>")).alias("shared"))


def entity_profile(entities: DataFrame, variants: DataFrame, grades: DataFrame, edges: DataFrame, graded: DataFrame, key: str = "entity_id") -> DataFrame:
    """JN-17: one row for each entity: sorted variants, grades by falling tier, sorted teacher and
    student ids, disagreement."""
    v = variants.groupBy(key).agg(F.sort_array(F.collect_set("variant")).alias("variants"))
    tier = grade_tier(F.col("bucket"))
    ordered = F.sort_array(F.collect_list(F.struct((-tier).alias("t"), "grade_id", "source_book", "bucket")))
    g = grades.groupBy(key).agg(F.transform(ordered, lambda x: F.struct(x["source_book"].alias("source_book"), x["bucket"].alias("bucket"))).alias("grades"))
    teachers = edges.groupBy(F.col("student_id").alias(key)).agg(F.sort_array(F.collect_set("teacher_id")).alias("teachers"))
    students = edges.groupBy(F.col("teacher_id").alias(key)).agg(F.sort_array(F.collect_set("student_id")).alias("students"))
    out = entities
    for part in (v, g, teachers, students, disagreement(graded, key)):
        out = out.join(part, key, "left")
    return out


def all_verdicts(quotes: DataFrame, grades: DataFrame, key: str = "entity_id") -> DataFrame:
    """SO-1: ordered array of each entity's quoted verdicts and then its non-blank book grades."""
    q = quotes.select(key, F.lit(0).alias("sort"), F.col("quote_id").alias("ord"), "source_book", "author", F.col("verdict").alias("text"))
    g = grades.where(~blank(F.col("grade_text"))).select(key, F.lit(1).alias("sort"), F.col("grade_id").alias("ord"), "source_book", F.lit(None).cast("string").alias("author"), F.col("grade_text").alias("text"))
    return q.unionByName(g).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("sort", "ord", "source_book", "author", "text"))).alias("verdicts"))


def tag_by_rules(entities: DataFrame, rules: DataFrame, key: str = "entity_id", name: str = "full_name") -> DataFrame:
    """JN-18: (key, reason) by the first matching rule (ord, pattern with %, reason). The rules are
    a small fixed table; each entity is held against all of them in one pass."""
    table = [(r["ord"], r["pattern"], r["reason"]) for r in rules.orderBy("ord").collect()]
    hit = F.coalesce(*[F.when(F.col(name).like(p), F.lit(reason)) for _, p, reason in table]) if table else F.lit(None).cast("string")
    return entities.select(key, hit.alias("reason")).where("reason is not null")


def display_order(books: DataFrame, quoted: Sequence[str]) -> DataFrame:
    """TK-4: books with display_order: ``quoted`` ones first and in that order, then by the year
    of the author's death (unknown last), then by their own order."""
    year = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("author_death", F.lit("")), r"^\s*([0-9]+)", 1), F.lit("")).cast("int"), F.lit(9999))
    place = F.array_position(F.array(*[F.lit(x) for x in quoted]), F.col("book")) if quoted else F.lit(0)
    first = F.when(place > 0, place).otherwise(F.lit(len(quoted) + 1))
    order = W.orderBy(first, F.when(place > 0, 0).otherwise(year), "ord")  # a dimension of tens of rows
    return books.withColumn("display_order", F.row_number().over(order))


def book_grid(entities: DataFrame, verdicts: DataFrame, books: DataFrame, key: str = "entity_id") -> DataFrame:
    """JN-19: each entity with one cell for every book in display order, empty where the book is
    silent, and the numbers of filled and all cells. ``books`` is a small fixed table."""
    order = [r["book"] for r in books.orderBy("display_order").select("book").collect()]
    said = verdicts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("book", "text"))).alias("m"))
    cell = lambda b: F.struct(F.lit(b).alias("book"), F.try_element_at("m", F.lit(b)).alias("text"))
    grid = F.array(*[cell(b) for b in order])
    out = entities.select(key).join(said, key, "left").select(key, grid.alias("grid"))
    return out.select(key, "grid", F.size(F.filter("grid", lambda x: x["text"].isNotNull())).alias("filled"), F.lit(len(order)).alias("total"))


def book_vs_engine(matches: DataFrame, verdicts: DataFrame, key: str = "text_id") -> DataFrame:
    """JN-20: (printed, verdict, n, agree): the text's own printed grade against our verdict."""
    rows = matches.select(key, printed_grade(F.col("grade")).alias("printed")).join(verdicts.select(key, "verdict"), key)
    agree = ((F.col("printed") == "sahih") & (F.col("verdict") == "sahih_candidate")) | ((F.col("printed") == "hasan") & (F.col("verdict") == "hasan_candidate")) | ((F.col("printed") == "daif") & F.col("verdict").isin("daif", "broken"))
    return rows.groupBy("printed", "verdict").agg(F.count(F.lit(1)).alias("n")).withColumn("agree", F.coalesce(agree, F.lit(False)))


def attribute_verdict(harshest: DataFrame, quotes: DataFrame, key: str = "entity_id") -> DataFrame:
    """JN-21: (key, author) of the first quote of the same book that equals or contains the harshest
    phrase; null where there is none."""
    h = harshest.select(key, F.trim("grade_text").alias("phrase"), F.col("source_book").alias("hb"))
    rows = h.join(quotes.select(key, "quote_id", "source_book", "author", "verdict"), key, "left")
    fits = (F.length("phrase") > 0) & (F.col("hb").isNull() | (F.col("source_book") == F.col("hb"))) & F.contains("verdict", "phrase")
    return rows.groupBy(key).agg(F.min(F.when(fits, F.struct("quote_id", "author"))).alias("a")).select(key, "a.author")


def reasons_table(reasons: DataFrame, quotes: DataFrame, harshest: DataFrame, key: str = "entity_id") -> DataFrame:
    """JN-23: per flagged entity its reasons, up to three distinct critics in order, and whether
    the harshest bucket disqualifies."""
    first = quotes.where("author is not null").groupBy(key, "author").agg(F.min("quote_id").alias("o"))
    critics = first.groupBy(key).agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("o", "author"))), lambda x: x["author"]), 1, 3).alias("critics"))
    worst = harshest.select(key, F.col("bucket").isin(*CRITICISM["summary"]).alias("disqualifying"))
    out = reasons.join(critics, key, "left").join(worst, key, "left")
    return out.select(key, "reasons", F.coalesce("critics", F.array().cast("array<string>")).alias("critics"), F.coalesce("disqualifying", F.lit(False)).alias("disqualifying"))


def glossary_lookup(rows: DataFrame, glossary: DataFrame, text: str = "grade_text", key: str = "grade_id", preamble: str = X.PREAMBLE) -> DataFrame:
    """SC-16: (key, phrase, type, tier) of the glossary term (ord, phrase, type, tier; a small fixed
    table): the whole text, else the text without its preamble, else the first phrase it contains,
    in glossary order. Of terms with one phrase the last counts, at the place of the first."""
    terms: dict[str, tuple] = {}
    for r in glossary.orderBy("ord").select(normalize(F.col("phrase")).alias("p"), "type", "tier").collect():
        terms[r["p"]] = (r["type"], r["tier"])
    struct = "struct<phrase: string, type: string, tier: int>"
    if not terms:
        return rows.select(key, F.lit(None).cast("string").alias("phrase"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("int").alias("tier")).limit(0)
    term = lambda p: F.struct(F.lit(p).alias("phrase"), F.lit(terms[p][0]).alias("type"), F.lit(terms[p][1]).cast("int").alias("tier"))
    exact = F.create_map(*[x for p in terms for x in (F.lit(p), term(p))])
    n = normalize(F.col(text))
    bare = F.trim(F.regexp_replace(n, preamble, ""))
    inside = F.coalesce(*[F.when(F.contains(n, F.lit(p)), term(p)) for p in terms]).cast(struct)
    hit = F.coalesce(F.try_element_at(exact, n).cast(struct), F.try_element_at(exact, bare).cast(struct), inside)
    return rows.where(F.col(text).isNotNull()).select(key, hit.alias("t")).where("t is not null").select(key, "t.phrase", "t.type", "t.tier")


def book_titles(rows: DataFrame, books: DataFrame, column: str) -> DataFrame:
    """SC-26: ``rows`` with title: the book's, or the key itself where it is unknown."""
    b = books.select(F.col("book").alias(column), F.col("title").alias("_t"))
    return rows.join(b, column, "left").withColumn("title", F.coalesce("_t", column)).drop("_t")
