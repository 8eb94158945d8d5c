"""Streams with state over several batches."""

import datetime as dt

from marlstone.streaming import rules, state


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def run(spark, tmp_path, batches, schema, build):
    """The output of a stream that gets each batch as new files and is drained after each."""
    into, to = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(into)
        rules.drained(build(rules.timed(rules.stream_of(spark, into))), to, str(tmp_path / "state"))
    return sorted((tuple(r) for r in spark.read.parquet(to).collect()), key=str)


def test_episodes_go_on_over_batches(spark, tmp_path):
    batches = [[("a", 1, at(0), 0), ("a", 2, at(1), 0), ("a", 3, at(2), 1), ("b", 4, at(0), 2)], [("a", 5, at(3), 1), ("a", 6, at(1), 9), ("b", 7, at(5), 0)], [("a", 8, at(9), 0)]]
    got = run(spark, tmp_path, batches, "key string, id long, ts timestamp_ntz, level int", state.episodes)
    assert got == sorted([("a", 1, 0), ("a", 3, 1), ("b", 4, 2), ("b", 7, 0), ("a", 8, 0)], key=str)  # 6 came late


def test_alerts_once_a_streak(spark, tmp_path):
    batches = [[("a", 1, at(0), True), ("a", 2, at(1), True)], [("a", 3, at(2), True), ("a", 4, at(3), True), ("a", 5, at(4), False)], [("b", 6, at(400), False)], [("b", 7, at(401), False)]]
    got = run(spark, tmp_path, batches, "key string, id long, ts timestamp_ntz, bad boolean", state.alerts)
    assert got == sorted([("a", 3, "outage"), ("a", 5, "quiet")], key=str)


def test_days_close_in_the_night_after(spark, tmp_path):
    batches = [[(at(60), 1.0), (at(1430), 2.0)], [(at(1500), 3.0)], [(at(1440 + 181), 4.0)], [(at(1440 + 200), 5.0)]]
    got = run(spark, tmp_path, batches, "ts timestamp_ntz, value double", state.closed_days)
    assert got == [(dt.date(2024, 1, 1), 2, 3.0)]
