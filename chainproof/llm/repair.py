"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

A legal order is an optional system row and then one or more pairs of user and assistant, or nothing at all. A dynamic
program over a conversation's rows keeps, for each state of that pattern, the cheapest string of edits so far, of equal ones
the least. The strings are persistent: a prefix is one node of a tree that all longer ones share, with its
ancestors at powers of two and rolling hashes of what leads to them. Two strings of one cost are told apart at their
longest common prefix, which is searched over the ancestors' hashes and then verified node by node, up to the first that
both share; where hashes lied, the strings themselves are compared.

Rows are dealt out by ranges of (conversation, turn, role, text), so a conversation of any size is cut into blocks of at
most ``ROWS`` rows, over as many tasks as it takes. A block gives, for each state before it, the cheapest edits into
each state after it, and blocks are joined in order. Only the digest of a repaired conversation has to read its rows in order;
those of conversations that lie in several tasks are streamed through one, which holds none of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainproof.llm.common import sliced, written

#: What edits cost, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Rows of a block of one dynamic program.
ROWS = 4096
#: Characters of a conversation that are held at most; those of longer ones are read once more, in order.
TEXTS = 1 << 23
#: States: nothing yet, after the system row, after a user row, after an assistant row. The last row may leave 0 or 3.
STATES, ENDS = 4, (0, 3)
_USER = {0: 2, 1: 2, 2: 3, 3: 2}  #: the state after a further row that is not the system row
_HASH = (1 << 61) - 1

#: Faults of a row; what counts is the first.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


class Prefixes:
    """Strings of edits as nodes that share their prefixes."""

    def __init__(self, modulus: int = _HASH):
        self.modulus = modulus
        self.edit, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, parent: int, edit: str) -> int:
        up = [parent]
        while len(self.up[up[-1]]) >= len(up):  # the ancestor at 2^k of the one at 2^k
            up.append(self.up[up[-1]][len(up) - 1])
        self.up.append(tuple(up))
        self.edit.append(edit)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * 1_000_003 + ord(edit)) % self.modulus)
        return len(self.edit) - 1

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def _same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth stand for one string."""
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self._ancestor(a, depth), self._ancestor(b, depth)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self.text(a) < self.text(b)
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self.edit[x] != self.edit[y] and self._same(self.up[x][0], self.up[y][0]):
            return self.edit[x] < self.edit[y]
        return self.text(a) < self.text(b)


Way = tuple[int, int]  # cost, node


def _cheaper(tree: Prefixes, a: Way | None, b: Way | None) -> Way | None:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return min(a, b)
    return a if tree.less(a[1], b[1]) else b


def _with_inserts(tree: Prefixes, at: list[Way | None]) -> list[Way | None]:
    """The states with rows put in: at most a user and an assistant row in turn ever pay."""
    out = list(at)
    for states, to in (((0, 1, 3), 2), ((2,), 3)):
        for s in states:
            if (way := out[s] if s == 2 else at[s]) is not None and (out[to] is None or way[0] + INSERT <= out[to][0]):
                out[to] = _cheaper(tree, out[to], (way[0] + INSERT, tree.add(way[1], "I")))
    return out


def edits(rows: Iterable[tuple[str, int]], start: int, tree: Prefixes) -> list[Way | None]:
    """The cheapest edits of rows (initial of the role, fault) from state ``start`` into each state, as nodes of ``tree``."""
    at: list[Way | None] = [None] * STATES
    at[start] = (0, 0)
    for initial, fault in rows:
        at, after = _with_inserts(tree, at), [None] * STATES
        more = CUT if fault == TRUNCATED else 0
        for s, way in enumerate(at):
            if way is None:
                continue
            cost, node = way
            ways = [(s, cost + DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                to = _USER[s]
                ways.append((to, cost + REROLE + more, "R"))
                if initial == " ua"[to - 1]:
                    ways.append((to, cost + more, "K"))
                if s == 0 and initial == "s":
                    ways.append((1, cost + more, "K"))
            for to, total, edit in ways:
                if after[to] is None or total <= after[to][0]:
                    after[to] = _cheaper(tree, after[to], (total, tree.add(node, edit)))
        at = after
    return _with_inserts(tree, at)


Block = list[list[tuple[int, str] | None]]  # by state before and after: cost and edits


def block(rows: list[tuple[str, int]], starts: Iterable[int] = range(STATES), modulus: int = _HASH) -> Block:
    """The cheapest edits of a run of rows between all states."""
    out: Block = [[None] * STATES for _ in range(STATES)]
    for s in starts:
        tree = Prefixes(modulus)
        out[s] = [way and (way[0], tree.text(way[1])) for way in edits(rows, s, tree)]
    return out


def joined(a: Block, b: Block) -> Block:
    """Two blocks, one after the other. Rows put in between are part of either, so equal strings may meet."""
    out: Block = []
    for row in a:
        ways = [[(x[0] + y[0], x[1] + y[1]) for x, y in zip(row, column, strict=True) if x and y] for column in zip(*b, strict=True)]
        out.append([min(w, default=None) for w in ways])
    return out


def best(ways: list[tuple[int, str] | None]) -> tuple[int, str]:
    """The cheapest cost and edits of those from the first state that end in a legal order."""
    return min(w for s in ENDS if (w := ways[s]))


def repaired(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) that edits leave of rows. The roles follow from their number: with an odd one, the first is the
    system row."""
    kept, rows, n = len(audit) - audit.count("D"), iter(rows), 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = ("user", "assistant")[(n - kept) % 2]
        n += 1
        yield role, text


def digest(lines: Iterable[tuple[str, str]]) -> str:
    """SHA-256 of role:text, joined by newlines."""
    out, between = hashlib.sha256(), b""
    for role, text in lines:
        out.update(between + role.encode() + b":" + text.encode())
        between = b"\n"
    return out.hexdigest()


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """What damage leaves of ``turns``: conv_id, turn, role, text, alike (a digest of role and text) and row (a number of its
    own)."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = turns.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), blank(F.col(f"`{role}`")).alias("role"), blank(F.col(f"`{text}`")).alias("text"))
    kind = F.crc32(F.concat(blank(F.col("conv_id")), F.lit(":"), blank(F.col("turn"))).cast("binary")) % 20
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")))
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    alike = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    # the numbers are written with the rows
    return written(rows.select("conv_id", "turn", "role", "text", alike.alias("alike")).withColumn("row", F.monotonically_increasing_id()), "damaged")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with the first fault of each. What was seen earlier is found by an aggregate over (conversation, role and
    text), so that many equal rows are no one task."""
    firsts = rows.groupBy("conv_id", "alike").agg(F.min(F.struct("turn", "row")).getField("row").alias("row")).select("row", F.lit(True).alias("first"))
    marked = rows.join(written(firsts, "firsts"), "row", "left")
    trimmed = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(trimmed == "", F.lit(BLANK)).when(F.col("first").isNull(), F.lit(DUPLICATE)).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), F.lit(TRUNCATED))
    return marked.withColumn("fault", F.coalesce(fault, F.lit(FINE))).drop("first")


class _Run:
    """The rows of one conversation, as far as they have come: counts, the block so far, and the texts while they are few."""

    def __init__(self, key: tuple, texts: bool):
        self.key, self.rows, self.before, self.size = key, [], None, 0
        self.texts: list[tuple[str, str]] | None = [] if texts else None
        self.low = self.high = self.first = self.last = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and (self.high is None or turn != self.high):
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        initial = role[:1]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.faults[fault] += 1
        self.rows.append((initial, fault))
        if len(self.rows) >= ROWS:
            self._close()
        self.size += len(text)
        if self.texts is not None:
            self.texts.append((role, text))
            if self.size > TEXTS:
                self.texts = None

    def _close(self) -> None:
        own = block(self.rows)
        self.before, self.rows = own if self.before is None else joined(self.before, own), []

    def counts(self) -> list:
        return [self.low, self.high, self.turns, self.illegal, self.first, self.last, *self.faults[1:]]

    def whole(self) -> list:
        """The row of a conversation that is complete, with its texts."""
        if self.before is None:
            tree = Prefixes()
            ways = [way and (way[0], tree.text(way[1])) for way in edits(self.rows, 0, tree)]
        else:
            ways = joined(self.before, block(self.rows))[0]
        cost, audit = best(ways)
        return [*self.key, *self.counts(), None, None, cost, audit, digest(repaired(audit, self.texts))]

    def part(self) -> list:
        """The row of a block that others may come before or after."""
        self._close()
        ways = [w for row in self.before for w in row]
        return [*self.key, *self.counts(), [w[0] if w else None for w in ways], [w[1] if w else None for w in ways], None, None, None]


_KEY = "conv_id long, turn long, alike string, row long"
_COUNTS = "low long, high long, turns long, illegal long, first string, last string, blank long, duplicate long, truncated long"
_BLOCK = f"{_KEY}, {_COUNTS}, costs array<long>, ways array<string>, cost long, audit string, repaired_sha256 string"
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _arrow(rows: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: each conversation that lies wholly inside, and blocks of the first and last, which may go on elsewhere."""
    names = ["conv_id", "turn", "alike", "row", "role", "text", "fault"]
    run, inside, out = None, False, []
    for batch in sliced(batches, "text"):
        for conv, turn, alike, row, role, text, fault in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if run is None or run.key[0] != conv:
                if run is not None:
                    out.append(run.whole() if inside and run.texts is not None else run.part())
                    inside = True
                run = _Run((conv, turn, alike, row), inside)
            run.add(turn, role, text, fault)
        if len(out) >= 2000:
            yield _arrow(out, _BLOCK)
            out = []
    if run is not None:
        out.append(run.part())
    yield _arrow(out, _BLOCK)


def _of_blocks(t: pa.Table) -> pa.Table:
    """The row of a conversation from its blocks, without the digest."""
    rows = sorted(t.to_pylist(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["alike"], r["row"]))
    out, before = dict(rows[0]), None
    for i, r in enumerate(rows):
        own = [[(c, w) if c is not None else None for c, w in zip(r["costs"][s : s + STATES], r["ways"][s : s + STATES], strict=True)] for s in range(0, STATES * STATES, STATES)]
        before = own if before is None else joined(before[:1], own)
        if i:
            out["turns"] += r["turns"] - (r["low"] is not None and r["low"] == out["high"])
            out["illegal"] += r["illegal"] + (out["last"] + r["first"] not in ("su", "ua", "au"))
            out |= {"low": r["low"] if out["low"] is None else out["low"], "high": out["high"] if r["high"] is None else r["high"], "last": r["last"]}
            out |= {k: out[k] + r[k] for k in ("blank", "duplicate", "truncated")}
    cost, audit = best(before[0])
    out |= {"cost": cost, "audit": audit, "costs": None, "ways": None}
    return pa.Table.from_batches([_arrow([list(out.values())], _BLOCK)])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and digest from sorted rows, before those of each conversation one of its audit. Holds no conversation."""

    def rows() -> Iterator[tuple]:
        for batch in sliced(batches, "text"):
            yield from zip(*(batch.column(n).to_pylist() for n in ("conv_id", "audit", "role", "text")), strict=True)

    def texts() -> Iterator[tuple[str, str]]:
        nonlocal ahead
        while (ahead := next(stream, None)) is not None and ahead[1] is None:
            yield ahead[2], ahead[3]

    stream = rows()
    ahead = next(stream, None)
    while ahead is not None:
        conv, audit = ahead[:2]
        own = texts()
        out = digest(repaired(audit, own))
        for _ in own:  # all rows are read, even deleted ones at the end
            pass
        yield _arrow([[conv, out]], "conv_id long, repaired_sha256 string")


def _results(blocks: DataFrame) -> DataFrame:
    gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.expr("cast(least(cast(high as decimal(38,0)) - low + 1 - turns, 9223372036854775807) as long)"))
    return blocks.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conv_id of ``turns``, nulls being one: gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of what damage leaves of it.

    Null roles and texts count as one blank. Rows come in the order of their turns, nulls first, those of one turn in the order of
    a digest of role and text. A conversation without rows after damage has zeros, an empty audit and the digest of nothing.
    Texts and conversations may have any length. An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    rows = written(with_faults(damaged(turns, conv, turn, role, text)), "faults")
    order = ["conv_id", "turn", "alike", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = written(dealt.select(*order, "role", "text", "fault").mapInArrow(_blocks, _BLOCK), "blocks")
    parts = written(blocks.where("audit is null").groupBy("conv_id").applyInArrow(_of_blocks, _BLOCK), "parts")
    heads = parts.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("alike"), F.lit(-1).cast("long").alias("row"), F.lit("").alias("role"), F.lit("").alias("text"))
    same = rows["conv_id"].eqNullSafe(parts["conv_id"])
    bodies = rows.join(parts.select("conv_id"), same, "left_semi").select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "alike", "row", "role", "text")
    lines = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions(*order)
    digests = lines.mapInArrow(_digests, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "conv")
    rest = parts.drop("repaired_sha256").join(digests, F.col("conv_id").eqNullSafe(F.col("conv")), "inner").drop("conv")
    found = written(_results(blocks.where("audit is not null")).unionByName(_results(rest)), "found")
    every = turns.select(F.col(f"`{conv}`").cast("long").alias("conv_id")).distinct()
    none = every.join(found.select(F.col("conv_id").alias("conv")), F.col("conv_id").eqNullSafe(F.col("conv")), "left_anti")
    zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.unionByName(none.select("conv_id", *zero, F.lit("").alias("audit"), F.lit(digest([])).alias("repaired_sha256")))
