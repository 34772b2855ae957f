"""A response cache: which requests a store with time to live would answer, for a stream and for a table.

Each key (URL and method, or the whole request) keeps the moment at which its stored response ends. A request before
that moment is a hit; else the response is stored if its status may be, for as long as its rule says.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from sparkloom.operators.asof import as_of
from sparkloom.sources.shared import stored

OUTPUT = "key string, ts timestamp, status int, hit boolean"


def ttl_seconds(status: Column, rules: Sequence[tuple[int, int]] | None, default_ttl: int) -> Column:
    """Time to live of the first rule with that status, 0 if there is none; without rules the default for all."""
    out = F.lit(default_ttl if rules is None else 0)
    for match, ttl in reversed(rules or ()):
        out = F.when(status == match, F.lit(ttl)).otherwise(out)
    return out.cast("long")


def _keyed(requests: DataFrame, rules: Sequence[tuple[int, int]] | None, default_ttl: int, by: Sequence[str]) -> DataFrame:
    status = F.col("status").cast("int").alias("status")
    return requests.select(F.concat_ws(" ", *by).alias("key"), "ts", status, F.unix_millis("ts").alias("ms"), (ttl_seconds(F.col("status"), rules, default_ttl) * 1000).alias("ttl"))


def _answered(end: int, ms: Sequence[int], ttl: Sequence[int]) -> tuple[int, list[bool]]:
    """When the stored response ends after these requests in order, and which of them are hits."""
    hits = []
    for at, lasts in zip(ms, ttl, strict=True):
        hits.append(at < end)
        if at >= end and lasts:
            end = at + lasts
    return end, hits


def cached(requests: DataFrame, rules: Sequence[tuple[int, int]] | None = None, default_ttl: int = 0, by: Sequence[str] = ("url", "method"), lateness: str = "1 hour") -> DataFrame:
    """(key, ts, status, hit) of a stream of (ts, status, and the columns of `by`).

    With rules, the first with the response's status decides on storing; without, every status is stored for
    default_ttl seconds. Rows of one micro-batch are taken in the order of ts; rows later than `lateness` are dropped. A
    key's state goes when the watermark passes the end of its stored response."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([*frames]).sort_values(["ms", "status"], kind="stable")
        end, hits = _answered(state.get[0] if state.exists else 0, rows["ms"].tolist(), rows["ttl"].tolist())
        if end > state.getCurrentWatermarkMs():
            state.update((end,))
            state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"].values, "status": rows["status"].values, "hit": hits})

    keyed = _keyed(requests, rules, default_ttl, by).withWatermark("ts", lateness)
    return keyed.groupBy("key").applyInPandasWithState(step, OUTPUT, "until bigint", "append", GroupStateTimeout.EventTimeTimeout)


def cached_table(requests: DataFrame, rules: Sequence[tuple[int, int]] | None = None, default_ttl: int = 0, by: Sequence[str] = ("url", "method"), partitions: int | None = None) -> DataFrame:
    """cached() of a table: each key's requests by time in milliseconds, status and ts.

    What is stored follows from what was stored before, but not request by request: after a stored response the next is the
    first storable request from its end on (an as-of search), and which of these are reached from a key's first is found by
    pointer doubling, in the logarithm of a key's stored responses. So one key's requests are worked on by many tasks, in
    built-in expressions; rounds are written to the shared folder."""
    keyed = _keyed(requests, rules, default_ttl, by).groupBy("key", "ts", "status", "ms", "ttl").agg(F.count("*").alias("n"))
    keyed = stored(keyed.select("*", F.unix_micros("ts").alias("us")))
    best = keyed.where("ttl > 0").groupBy("key", "ms").agg(F.min(F.struct("status", "us", "ttl")).alias("b"))
    nodes = stored(best.select("key", "ms", F.struct("ms", "b.status", "b.us", (F.col("ms") + F.col("b.ttl")).alias("until")).alias("node")))
    marks = nodes.select("key", F.col("ms").alias("at"), F.col("ms").alias("value"))
    ahead = as_of(nodes.select("key", "ms", F.col("node.until").alias("at")), marks, forward=True, partitions=partitions)
    jumps = stored(ahead.where("found IS NOT NULL").select("key", "ms", F.col("found").alias("far")))
    known = [stored(nodes.groupBy("key").agg(F.min("ms").alias("ms")))]
    while True:
        more = stored(reduce(DataFrame.unionByName, known).join(jumps, ["key", "ms"]).select("key", F.col("far").alias("ms")))
        if more.isEmpty():
            break
        known.append(more)
        jumps = stored(jumps.join(jumps.select("key", F.col("ms").alias("far"), F.col("far").alias("farther")), ["key", "far"]).select("key", "ms", F.col("farther").alias("far")))
    held = reduce(DataFrame.unionByName, known).join(nodes, ["key", "ms"]).select("key", F.col("ms").alias("at"), F.col("node").alias("value"))
    seen = as_of(keyed.withColumn("at", F.col("ms")), held, partitions=partitions)
    least = F.lit(-(2**31))
    order = lambda status, us: F.struct(F.coalesce(status, least), us)
    mine, its = order(F.col("status"), F.col("us")), order(F.col("found.status"), F.col("found.us"))
    fresh = F.coalesce(F.col("ms") < F.col("found.until"), F.lit(False))
    same = F.coalesce((F.col("ms") == F.col("found.ms")) & (mine == its), F.lit(False))
    early = F.coalesce((F.col("ms") == F.col("found.ms")) & (mine < its), F.lit(False))
    each = seen.select("key", "ts", "status", (fresh & ~early).alias("fresh"), same.alias("same"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
    return each.select("key", "ts", "status", (F.col("fresh") & ~(F.col("same") & (F.col("i") == 1))).alias("hit"))


class _Store(StatefulProcessor):
    """One key's stored response: when it ends. A timer at its end drops it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat([*rows]).sort_values(["ms", "status", "ts"], kind="stable")
        before = self.until.get()[0] if self.until.exists() else 0
        end, hits = _answered(before, frame["ms"].tolist(), frame["ttl"].tolist())
        if end != before:
            if before:
                self.handle.deleteTimer(before)
            self.until.update((end,))
            self.handle.registerTimer(end)
        yield pd.DataFrame({"key": key[0], "ts": frame["ts"].values, "status": frame["status"].values, "hit": hits})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached_stream(requests: DataFrame, rules: Sequence[tuple[int, int]] | None = None, default_ttl: int = 0, by: Sequence[str] = ("url", "method"), lateness: str = "1 hour") -> DataFrame:
    """cached() with its state in typed variables and timers: the state of a key is one number, and goes when the watermark
    passes the end of the stored response, whether or not the key is asked for again.

    Needs RocksDB as the state store. Rows of one micro-batch are taken in the order of ts; rows later than `lateness` are
    dropped. On requests that arrive in order it answers as cached_table() does."""
    keyed = _keyed(requests, rules, default_ttl, by).withWatermark("ts", lateness)
    return keyed.groupBy("key").transformWithStateInPandas(_Store(), OUTPUT, "append", "eventTime")
