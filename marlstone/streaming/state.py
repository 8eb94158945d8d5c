"""Streams with state of a key: episodes, alerts, promises and appointments by event time, days that close, stale rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.dialect import frame
from .rules import DELAY, drained, scratch, stream_of, timed


def episodes(rows: DataFrame, delay: str = DELAY) -> DataFrame:
    """``rows`` (key, id, ts, level) of a stream: those at which a key's level is another than at its row before, once an
    episode. State is the last level and its time; rows older than that time are passed over."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, seen = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "id"]).itertuples(index=False):
            now = r.ts.value
            if seen is not None and now < seen:
                continue
            if r.level != level:
                out.append((key[0], r.id, r.level))
            level, seen = int(r.level), now
        if seen is not None:
            state.update((level, seen))
        yield pd.DataFrame(out, columns=["key", "id", "level"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, id long, level int", "level int, seen long", "append", GroupStateTimeout.NoTimeout)


@frame("""
WITH l AS (SELECT user_id, event_id, floor(value / 40)::INT AS level, lag(floor(value / 40)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT user_id, event_id, level FROM l WHERE was IS NULL OR was <> level""")
def stream_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the level of a user's events changes."""
    events = timed(stream_of(spark, sf_dir, "events.parquet")).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.floor(F.col("value") / 40).cast("int").alias("level"))
    to = scratch(spark, "episodes")
    drained(episodes(events), to, f"{to}-state")
    return spark.read.parquet(to).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "level")


def alerts(rows: DataFrame, quiet: str = "60 minutes", streak: int = 3, delay: str = DELAY) -> DataFrame:
    """``rows`` (key, id, ts, bad) of a stream: 'outage' at the row that makes ``streak`` bad ones in a row (once a streak), and
    'quiet' when no row came for a time after the last, as the watermark passes it."""
    span = pd.Timedelta(quiet).value // 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            bad, last, at = state.get
            state.remove()
            yield pd.DataFrame([(key[0], last, "quiet")], columns=["key", "id", "what"])
            return
        bad, last, at = state.get if state.exists else (0, 0, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "id"]).itertuples(index=False):
            bad = bad + 1 if r.bad else 0
            if bad == streak:
                out.append((key[0], r.id, "outage"))
            last, at = int(r.id), max(at, r.ts.value // 1_000_000)
        state.update((bad, last, at))
        state.setTimeoutTimestamp(max(at + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "id", "what"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(step, f"key {kind}, id long, what string", "bad int, last long, at long", "append", GroupStateTimeout.EventTimeTimeout)


@frame("""
WITH m AS (SELECT max(ts) AS m FROM events), e AS (SELECT *, event_type IN ('error', 'view') AS bad FROM events), g AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run, bad ORDER BY ts, event_id) AS n, bad FROM g), l AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id)
SELECT user_id, event_id, 'outage' AS what FROM s WHERE bad AND n = 3 UNION ALL SELECT user_id, event_id, 'quiet' FROM l, m WHERE ts + INTERVAL 60 MINUTE < m.m - INTERVAL 45 MINUTE""")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with three errors or views in a row, and users of whom nothing came for an hour when the stream ends."""
    events = timed(stream_of(spark, sf_dir, "events.parquet")).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.col("event_type").isin("error", "view").alias("bad"))
    to = scratch(spark, "alerts")
    drained(alerts(events), to, f"{to}-state")
    return spark.read.parquet(to).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "what")


def expired(appointments: DataFrame, acts: DataFrame, within: str, delay: str = DELAY) -> DataFrame:
    """Appointments (key, id, ts) with the acts (key, mark, at) that met each in time; one that none met comes with null, as
    missed, once the watermark has passed its end."""
    a, b = appointments.withWatermark("ts", delay).alias("a"), acts.withWatermark("at", delay).alias("b")
    met = F.expr(f"a.key = b.key AND b.at >= a.ts AND b.at <= a.ts + INTERVAL {within}")
    return a.join(b, met, "left").select("a.key", "a.id", "b.mark")


@frame("""
WITH m AS (SELECT max(ts) AS m FROM events), s AS (SELECT * FROM events WHERE event_type = 'signup'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
lim AS (SELECT least((SELECT max(ts) FROM s), (SELECT max(ts) FROM p)) - INTERVAL 45 MINUTE AS w)
SELECT s.event_id, p.event_id AS met FROM s JOIN p ON s.user_id = p.user_id AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL 12 HOUR
UNION ALL SELECT s.event_id, NULL FROM s, lim WHERE s.ts + INTERVAL 12 HOUR < lim.w AND NOT EXISTS (SELECT 1 FROM p WHERE s.user_id = p.user_id AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL 12 HOUR)""")
def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as appointments that a purchase within twelve hours meets."""
    events = timed(stream_of(spark, sf_dir, "events.parquet"))
    appointments = events.where("event_type = 'signup'").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts")
    acts = timed(stream_of(spark, sf_dir, "events.parquet")).where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("event_id").alias("mark"), F.col("ts").alias("at"))
    to = scratch(spark, "expiry")
    drained(expired(appointments, acts, "12 HOURS"), to, f"{to}-state")
    return spark.read.parquet(to).select(F.col("id").alias("event_id"), F.col("mark").alias("met"))


def closed_days(rows: DataFrame, hour: int = 3, delay: str = "0 minutes") -> DataFrame:
    """A row for each day of a stream's rows (ts, value), as it is closed: once the watermark is past ``hour`` of the next day."""
    late = f"{hour * 60 + pd.Timedelta(delay).seconds // 60} minutes"
    days = rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
    return days.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.to_date("w.start").alias("day"), "n", "total")


@frame("""
SELECT ts::DATE AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ts::DATE HAVING ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 3 HOUR FROM events)""")
def stream_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that are closed, each at three in the night after it."""
    to = scratch(spark, "days")
    drained(closed_days(timed(stream_of(spark, sf_dir, "events.parquet"))), to, f"{to}-state")
    return spark.read.parquet(to)


def guarded(rows: DataFrame, at: Column, now: Column, most_seconds: int, took: Column, limit: Column) -> DataFrame:
    """``rows``, or an error at the first that is older than ``most_seconds`` or took longer than its limit."""
    age = F.unix_timestamp(now) - F.unix_timestamp(at)
    wrong = F.when(age > most_seconds, F.concat(F.lit("stale by "), (age - most_seconds).cast("string"), F.lit(" s"))).when(took > limit, F.concat(F.lit("took "), took.cast("string")))
    return rows.where(F.when(wrong.isNull(), F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean")))
