"""Gap sessionisation: each client's clicks in order through a state machine, in pieces that begin where a session must.

Rows are dealt by ranges of (client, time, click), so a client with a third of all clicks takes as many pieces as its
clicks need. A first pass over the sorted pieces finds, in each, the first row before which no session can go on, whatever
came earlier: another client's first row, or a click after a final one or after a gap. Rows before it go to the last piece
that has such a row. So every session lies in one piece, and in the second pass one task streams each piece through the
state machine, which carries the session across batches. A client with neither final clicks nor gaps over whole pieces
has those pieces joined: its task takes longer and holds no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import cut, table

MINUTE = 60_000_000
OUTPUT = "client_id {client}, session_id {click}, start_us bigint, end_us bigint, n_clicks bigint, n_late bigint, value_cents bigint, closed_by string, path_sha256 string"


@dataclass(frozen=True)
class Rules:
    """When sessions end. Times in microseconds."""

    gap: int = 30 * MINUTE  # so long after the last click, or longer, another session begins
    length: int = 120 * MINUTE  # more than so long after its first click, too
    late: int = 60 * MINUTE  # a click that arrives more than so long after it was made joins no session
    final_kind: str = "purchase"
    final_value: float = 60.0


class Machine:
    """The session that is open, and what closes it."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        self.client: object = None
        self.open = False

    def start(self, client: object, click: object, us: int) -> None:
        self.client, self.open, self.first, self.began = client, True, click, us
        self.n = self.late = self.cents = 0
        self.path = hashlib.sha256()

    def add(self, click: object, us: int, final: bool, cents: int) -> None:
        self.path.update(f",{click}".encode() if self.n else str(click).encode())
        self.last, self.final = us, final
        self.n += 1
        self.cents += cents

    def reason(self, us: int) -> str | None:
        """Why a timely click at that time can't continue the session; None if it can."""
        if self.final:
            return "end"
        if us - self.last >= self.rules.gap:
            return "gap"
        return "length" if us - self.began > self.rules.length else None

    def close(self, reason: str) -> tuple:
        self.open = False
        return self.client, self.first, self.began, self.last, self.n, self.late, self.cents, reason, self.path.hexdigest()

    def end(self) -> list[tuple]:
        """Close what is open, with no click after it."""
        return [self.close("end" if self.final else "none")] if self.open else []

    def step(self, client: object, click: object, us: int, late: bool, final: bool, cents: int, peek: bool) -> list[tuple]:
        """Sessions that a row closes. A peek only shows the next click of a client, which begins another piece."""
        out = self.end() if self.open and client != self.client else []
        if late:
            if self.open:
                self.late += 1
            return out
        if self.open and (why := self.reason(us)):
            out.append(self.close(why))
        if peek:
            return out
        if not self.open:
            self.start(client, click, us)
        self.add(click, us, final, cents)
        return out


def _marked(frames: Iterator[pd.DataFrame], gap: int) -> Iterator[pd.DataFrame]:
    """Sorted rows with their piece, whether they lie before its first sure start, and whether they are peeks."""
    piece = TaskContext.get().partitionId()
    found, client, us, final = False, None, 0, False  # of the last row: its client; of the client's last timely click: the rest
    timely_seen = False
    for rows in frames:
        rows = rows.assign(piece=np.int32(piece), head=False, peek=False)
        if not found and len(rows):
            at, same = None, False
            for i, (c, t, is_late, is_final) in enumerate(zip(rows["client"].tolist(), rows["us"].tolist(), rows["late"].tolist(), rows["final"].tolist(), strict=True)):
                if client is not None and c != client:
                    at, same = i, False
                    break
                if not is_late:
                    if timely_seen and (final or t - us >= gap):
                        at, same = i, True
                        break
                    timely_seen, us, final = True, t, is_final
                client = c
            head = rows.iloc[: len(rows) if at is None else at].assign(head=True)
            found = at is not None
            parts = [head]
            if found:
                if same:
                    parts.append(rows.iloc[at : at + 1].assign(head=True, peek=True))
                parts.append(rows.iloc[at:])
            rows = pd.concat(parts)
        yield rows


def _micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970; a time without a zone is in UTC, whatever the session's zone is."""
    t = F.col(column)
    if not isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.unix_micros(t.cast("timestamp"))
    since = t - F.lit("1970-01-01").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), since)
    return (((part("DAY").cast("long") * 24 + part("HOUR")) * 60 + part("MINUTE")) * MINUTE + part("SECOND") * 1_000_000).cast("long")


def sessions(clicks: DataFrame, rules: Rules = Rules(), pieces: int | None = None) -> DataFrame:
    """A row a session of clicks (click_id, ts, arrived_at, client_id, kind, value), whatever other columns there are.

    Clicks count once a click_id; rows without click_id, client_id or ts are left out. Copies with different contents
    count as the one with the least client, time and arrival. A click without arrived_at is timely, one without a kind or
    value is not final, a value that is null or no number is worth 0. Clicks with equal times follow their click_ids; late clicks at the time
    of a session's first click count to it. An empty table gives no rows.

    `pieces` is the number of ranges, by default spark.sql.shuffle.partitions; only one number a piece goes through the
    driver. Tables are written to the shared folder between passes."""
    spark = clicks.sparkSession
    n = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    us, arrived = _micros(clicks, "ts"), _micros(clicks, "arrived_at")
    value = F.nullif(F.col("value").cast("double"), F.lit(float("nan")))
    final = (F.col("kind") == rules.final_kind) & (value >= rules.final_value)
    cents = F.coalesce(F.floor(100 * value + 0.5), F.lit(0)).cast("long")
    known = clicks.where("click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL").select(
        "click_id", F.struct(F.col("client_id").alias("client"), us.alias("us"), F.coalesce(arrived - us > rules.late, F.lit(False)).alias("late"), F.coalesce(final, F.lit(False)).alias("final"), cents.alias("cents")).alias("c")
    )
    once = cut(known.groupBy("click_id").agg(F.min("c").alias("c")).select("click_id", "c.*"))
    order = ["client", "us", "late", "click_id"]
    kinds = {f.name: f.dataType.simpleString() for f in clicks.schema}
    shape = f"click_id {kinds['click_id']}, client {kinds['client_id']}, us bigint, late boolean, final boolean, cents bigint"
    marked = cut(once.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(lambda f: _marked(f, rules.gap), f"{shape}, piece int, head boolean, peek boolean"))
    found = sorted((r.piece, r.starts) for r in marked.groupBy("piece").agg(F.bool_or(~F.col("head")).alias("starts")).collect())
    last = [-1, *accumulate((p if starts else -1 for p, starts in found), max)]  # of the pieces before, the last with a sure start
    owners = F.broadcast(spark.createDataFrame([(p, before) for (p, _), before in zip(found, last, strict=False)], "piece int, before int"))  # a row a piece
    owned = marked.join(owners, "piece").withColumn("owner", F.when(F.col("head"), F.col("before")).otherwise(F.col("piece")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, owner = Machine(rules), None
        for rows in frames:
            out: list[tuple] = []
            for o, *row in zip(*(rows[c].tolist() for c in ("owner", "client", "click_id", "us", "late", "final", "cents", "peek")), strict=True):
                if o != owner:
                    out += machine.end()
                    owner = o
                out += machine.step(*row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if rest := machine.end():
            yield pd.DataFrame(rest, columns=names)

    schema = OUTPUT.format(client=kinds["client_id"], click=kinds["click_id"])
    names = [x.split()[0] for x in schema.split(", ")]
    streamed = owned.select("owner", "client", "click_id", "us", "late", "final", "cents", "peek")
    return streamed.repartition(n, "owner").sortWithinPartitions("owner", *order).mapInPandas(run, schema)


def op12_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "clicks"))


OP12_SQL = r"""
WITH RECURSIVE once AS (
  SELECT DISTINCT ON (click_id) click_id, client_id, epoch_us(ts) AS us, coalesce(epoch_us(arrived_at) - epoch_us(ts) > 3600000000, FALSE) AS late,
    coalesce(kind = 'purchase' AND value >= 60, FALSE) AS final, coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents
  FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL
  ORDER BY click_id, client_id, us, late, final, cents
), timely AS (
  SELECT *, row_number() OVER w AS k, lag(us) OVER w AS prev_us, lag(final) OVER w AS prev_final
  FROM once WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)
), walk AS (
  SELECT client_id, k, us AS began, CAST(NULL AS VARCHAR) AS why FROM timely WHERE k = 1
  UNION ALL
  SELECT t.client_id, t.k, CASE WHEN t.prev_final OR t.us - t.prev_us >= 1800000000 OR t.us - w.began > 7200000000 THEN t.us ELSE w.began END,
    CASE WHEN t.prev_final THEN 'end' WHEN t.us - t.prev_us >= 1800000000 THEN 'gap' WHEN t.us - w.began > 7200000000 THEN 'length' END
  FROM walk w JOIN timely t ON t.client_id = w.client_id AND t.k = w.k + 1
), numbered AS (
  SELECT t.*, w.why, sum(CASE WHEN w.why IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY t.client_id ORDER BY t.k) AS s
  FROM timely t JOIN walk w USING (client_id, k)
), grouped AS (
  SELECT client_id, s, arg_min(click_id, k) AS session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks, CAST(sum(cents) AS BIGINT) AS value_cents,
    arg_max(final, k) AS final, arg_min(coalesce(why, ''), k) AS why, sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY us, click_id)) AS path_sha256
  FROM numbered GROUP BY client_id, s
), closed AS (
  SELECT *, lead(why) OVER w AS next_why, lead(start_us) OVER w AS next_us FROM grouped WINDOW w AS (PARTITION BY client_id ORDER BY s)
)
SELECT c.client_id, session_id, start_us, end_us, n_clicks,
  (SELECT count(*) FROM once l WHERE l.late AND l.client_id = c.client_id AND l.us >= c.start_us AND (c.next_us IS NULL OR l.us < c.next_us)) AS n_late,
  value_cents, coalesce(next_why, CASE WHEN final THEN 'end' ELSE 'none' END) AS closed_by, path_sha256
FROM closed c
"""
