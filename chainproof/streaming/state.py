"""State across inputs: quotas, caches, budgets; in batch and on streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

from chainproof.functions.text import cache_key
from chainproof.sources.io import insert_ignore, upsert
from chainproof.sources.tables import BucketedTable

QUOTA = "key long, id long, ts timestamp, allowed boolean"


def _decide(accepted: deque, at: int, most: int, window: int) -> bool:
    """Whether a hit at ``at`` (microseconds) is allowed; records it if so."""
    while accepted and accepted[0] <= at - window:
        accepted.popleft()
    if len(accepted) >= most:
        return False
    accepted.append(at)
    return True


def sliding_quota(events: DataFrame, most: int = 20, window_seconds: int = 600, *, key: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """ST-1 on a table: (key, id, ts, allowed): at most ``most`` accepted hits of a key within the
    window; a denied hit is not recorded. Equal times are taken by id.

    The hits of a key are read in order through the partition's rows, so what is held for a key is
    its accepted hits of one window, ``most`` at the most.
    """
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(event).cast("long").alias("id"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, accepted = None, deque()
        for b in batches:
            allowed = []
            for k, us in zip(b["key"], b["us"], strict=True):
                if k != own:
                    own, accepted = k, deque()
                allowed.append(_decide(accepted, us, most, window_seconds * 1_000_000))
            yield b[["key", "id", "ts"]].assign(allowed=allowed)

    return rows.where("key is not null and ts is not null").repartition("key").sortWithinPartitions("key", "us", "id").mapInPandas(run, QUOTA)


class _Quota(StatefulProcessor):
    """Per key: hits that wait for the watermark, and the accepted ones of a window."""

    def __init__(self, most: int, window: int):
        self.most, self.window = most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long")
        self.accepted = handle.getListState("accepted", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(us), int(i)) for b in rows for us, i in zip(b["us"], b["id"], strict=True)]
        yield self._settled(key[0], new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._settled(key[0], [], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    def _settled(self, key: int, new: list[tuple[int, int]], until: int) -> pd.DataFrame:
        """Decides all that are older than the watermark, in order; sets the timer for what is left to decide or forget."""
        held = lambda state: [tuple(x) for x in state.get()] if state.exists() else []
        waiting, accepted = sorted([*held(self.waiting), *new]), deque(x[0] for x in held(self.accepted))
        due = [x for x in waiting if x[0] < until]
        rest = waiting[len(due) :]
        allowed = [_decide(accepted, us, self.most, self.window) for us, _ in due]
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        while accepted and accepted[0] <= until - self.window:
            accepted.popleft()
        for state, left in ((self.waiting, rest), (self.accepted, [(us,) for us in accepted])):
            if left:
                state.put(left)
            elif state.exists():
                state.clear()
        if rest or accepted:
            self.handle.registerTimer((rest[0][0] if rest else accepted[-1] + self.window) // 1000 + 1)
        return pd.DataFrame({"key": [key] * len(due), "id": [i for _, i in due], "ts": pd.to_datetime([us for us, _ in due], unit="us"), "allowed": allowed})


def stream_quota(events: DataFrame, most: int = 20, window_seconds: int = 600, *, delay: str | None = None, key: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """ST-1 on a stream: the accepted times of each key, ``most`` at the most, are its state.

    Without ``delay``, hits are decided as they come, those of one micro-batch in order of time and id, and a key is
    never forgotten. With it (an interval, "10 minutes"), hits wait until the watermark has passed them and are then decided in order
    of time and id over all micro-batches, as on a table; hits that are later than that are dropped, and timers
    forget keys that have been idle for a window. This needs the state store
    ``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
    """
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(event).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    if delay is not None:
        known = rows.where("key is not null and ts is not null").withWatermark("ts", delay)
        return known.groupBy("key").transformWithStateInPandas(_Quota(most, window_seconds * 1_000_000), QUOTA, "append", "EventTime")

    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    window = window_seconds * 1_000_000

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(frames)).sort_values(["us", "id"])
        allowed = [_decide(accepted, int(us), most, window) for us in rows["us"]]
        state.update((list(accepted),))
        yield pd.DataFrame({"key": k[0], "id": rows["id"], "ts": rows["ts"], "allowed": allowed})

    return rows.groupBy("key").applyInPandasWithState(run, QUOTA, "accepted array<long>", "append", GroupStateTimeout.NoTimeout)


def audit_incremental(new: DataFrame, cache: DataFrame, version: str, compute: Callable[[DataFrame], DataFrame], *, text: str = "text", at: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """ST-2: (results computed now, the cache with them): inputs whose versioned key (cache_key of
    the text) is cached are skipped, each other key is computed once. ``compute`` adds result."""
    keyed = new.withColumn("input_hash", cache_key(version, F.col(text)))
    fresh = keyed.join(cache.select("input_hash"), "input_hash", "left_anti").dropDuplicates(["input_hash"])
    done = compute(fresh).select("input_hash", "result", at)
    return done, upsert(cache, done, ["input_hash"], [F.desc(at)])


def cached(new: DataFrame, table: BucketedTable, version: str, compute: Callable[[DataFrame], DataFrame], *, text: str = "text", at: str = "created_at", writer: str | None = None, batch: int = 0) -> bool:
    """ST-2 over a table (input_hash, result, ``at``) in buckets: ``compute`` runs for inputs that the buckets of
    the new keys lack; nothing else is read or written. A batch that was taken before is not computed again."""
    keyed = new.withColumn("input_hash", cache_key(version, F.col(text)))
    return table.insert(keyed, [at], fill=compute, writer=writer, batch=batch)


def stream_incremental(stream: DataFrame, table: BucketedTable, version: str, compute: Callable[[DataFrame], DataFrame], *, writer: str, text: str = "text", at: str = "created_at"):
    """ST-2 on a stream: a writer that adds what each micro-batch lacks to ``table``. ``writer`` names the
    query, the same at every start from its checkpoint: a micro-batch that is sent again changes nothing."""

    def take(df: DataFrame, n: int) -> None:
        cached(df, table, version, compute, text=text, at=at, writer=writer, batch=n)

    return stream.writeStream.foreachBatch(take)


def chain_parse_cache(corpus: DataFrame, cache: DataFrame, parse: Callable[[DataFrame], DataFrame], *, key: str = "text_id", at: str = "segmented_at") -> DataFrame:
    """ST-3: the cache (key, names, at) with every corpus text that it lacks: ``parse`` gives (key,
    names) of what it can parse; failures are kept as empty arrays and not tried again."""
    fresh = corpus.join(cache.select(key), key, "left_anti")
    parsed = fresh.select(key).join(parse(fresh), key, "left")
    rows = parsed.select(key, F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.current_timestamp().alias(at))
    good, failed = rows.where(F.size("names") > 0), rows.where(F.size("names") == 0)
    return insert_ignore(upsert(cache, good, [key], [F.desc(at)]), failed, [key], [at])


def parsed_into(corpus: DataFrame, table: BucketedTable, parse: Callable[[DataFrame], DataFrame], *, key: str = "text_id", at: str = "segmented_at", writer: str | None = None, batch: int = 0) -> bool:
    """ST-3 over a table (``key``, names, ``at``) in buckets: texts that it lacks are parsed; failures are kept as empty arrays."""

    def fill(fresh: DataFrame) -> DataFrame:
        rows = fresh.select(key).join(parse(fresh).select(key, "names"), key, "left")
        return rows.select(key, F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.current_timestamp().alias(at))

    return table.insert(corpus, [key], fill=fill, writer=writer, batch=batch)


def monthly_usage(calls: DataFrame, cap: int = 5000, *, ts: str = "ts", event: str = "event_id") -> DataFrame:
    """ST-4: (month, calls, within_cap, capped_at): calls of each month, and the time of the call
    that reaches the cap. Calls are first ranked within days, so no month is one task."""
    rows = calls.select(F.date_format(ts, "yyyy-MM").alias("month"), F.to_date(ts).alias("day"), F.col(ts).alias("ts"), F.col(event).alias("e"))
    days = rows.groupBy("month", "day").agg(F.count(F.lit(1)).alias("n"))
    days = days.withColumn("before", F.sum("n").over(W.partitionBy("month").orderBy("day")) - F.col("n"))
    at_cap = days.where((F.col("before") < cap) & (F.col("before") + F.col("n") >= cap))
    ranked = rows.join(at_cap.select("month", "day", "before"), ["month", "day"]).withColumn("i", F.row_number().over(W.partitionBy("month", "day").orderBy("ts", "e")) + F.col("before"))
    reached = ranked.where(F.col("i") == cap).select("month", F.col("ts").alias("capped_at"))
    total = days.groupBy("month").agg(F.sum("n").alias("calls"))
    return total.join(reached, "month", "left").select("month", "calls", (F.col("calls") < cap).alias("within_cap"), "capped_at")


def with_model(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], inputs: list[str], output: str = "reply") -> DataFrame:
    """UD-1: ``df`` with the text that a user's batch function makes of ``inputs``, and status ok or
    the error; a batch that fails is tried again row by row."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(output, T.StringType()), T.StructField("status", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield b.assign(**{output: fn(b[inputs]).to_numpy(), "status": "ok"})
            except Exception:
                got = []
                for i in range(len(b)):
                    try:
                        got.append((fn(b[inputs].iloc[[i]]).iloc[0], "ok"))
                    except Exception as e:
                        got.append((None, f"error: {e}"))
                yield b.assign(**{output: [x for x, _ in got], "status": [x for _, x in got]})

    return df.mapInPandas(run, schema)
