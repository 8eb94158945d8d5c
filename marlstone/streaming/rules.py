"""Streaming rules: windows sealed by a watermark, sessions, late rows, publish-once and upsert sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import frame
from ..plans.storage import shared_dir

#: Rows later than this are dropped; a window or session is published once it ends before the newest row less this.
DELAY, GAP = "45 minutes", "30 minutes"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """The Parquet files of a folder (those of one name only, if given) as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}" if name else folder).schema)
    return (reader.option("pathGlobFilter", name) if name else reader).parquet(folder)


def timed(events: DataFrame) -> DataFrame:
    """Watermarks take instants: times without a zone are read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(out: DataFrame, to: str, state: str) -> None:
    """Runs the stream over all there is now, and appends what is sealed. A checkpoint in ``state`` makes each row come once."""
    out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).option("path", to).trigger(availableNow=True).start().awaitTermination()


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Counts and sums of each type by window."""
    windows = timed(events).withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = GAP, delay: str = DELAY) -> DataFrame:
    """A user's spans without a gap."""
    spans = timed(events).withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return spans.agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "first")


def upsert(spark: SparkSession, rows: DataFrame, path: str, key: str) -> None:
    """``rows`` replace the table's rows of the same key: a new version beside the old one, and then a pointer to it, so that readers never see half."""
    version = f"{path}/v-{uuid.uuid4().hex}"
    old = read_version(spark, path)
    merged = rows if old is None else old.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)
    merged.write.parquet(version)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that upsert() wrote last, none if there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        at = spark.read.schema("version string").json(f"{path}/current").first()
    except AnalysisException:
        return None
    return spark.read.parquet(at["version"]) if at else None


def append_once(spark: SparkSession, rows: DataFrame, path: str, key: str) -> None:
    """Rows whose key the table has not yet. Equal keys in one batch are an error."""
    if rows.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"a batch repeats a {key}")
    try:
        old = spark.read.parquet(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = rows.select(key).limit(0)
    rows.join(old, key, "left_anti").write.mode("append").parquet(path)


@frame("""
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 45 MINUTE FROM events)""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has sealed."""
    to = scratch(spark, "tumbling")
    drained(tumbling(stream_of(spark, sf_dir, "events.parquet")), to, f"{to}-state")
    return spark.read.parquet(to)


@frame("""
WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, min(event_id) AS first FROM s GROUP BY user_id, island HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 45 MINUTE FROM events)""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has sealed."""
    to = scratch(spark, "session")
    drained(sessions(stream_of(spark, sf_dir, "events.parquet")), to, f"{to}-state")
    return spark.read.parquet(to)


@frame("""
WITH m AS (SELECT max(ts) AS m FROM events), t AS (SELECT e.* FROM events e, m WHERE NOT (event_id % 50 = 0 AND ts < m.m - INTERVAL 1 DAY))
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM t
GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 45 MINUTE FROM events)""")
def stream_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fiftieth of the rows come a day late, after their windows were published: they change nothing."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    most = events.agg(F.max("ts").alias("m"))
    late = (F.col("event_id") % 50 == 0) & (F.col("ts") < F.col("m") - F.expr("INTERVAL 1 DAY"))
    split = events.join(F.broadcast(most)).withColumn("late", late).drop("m")  # one row
    into, to = scratch(spark, "late-in"), scratch(spark, "late")
    for part in (False, True):
        split.where(F.col("late") == part).drop("late").write.mode("append").parquet(into)
        drained(tumbling(stream_of(spark, into)), to, f"{to}-state")
    return spark.read.parquet(to)


@frame("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY CAST(ts AS DATE)")
def stream_upsert_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report row a day, published by batches that come twice, as after a crash: each day is there once."""
    to = scratch(spark, "once")
    events = stream_of(spark, sf_dir, "events.parquet")

    def publish(batch: DataFrame, _: int) -> None:
        days = batch.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
        append_once(batch.sparkSession, days, to, "day")

    for attempt in range(2):
        events.writeStream.foreachBatch(publish).option("checkpointLocation", f"{to}-state{attempt}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(to)
