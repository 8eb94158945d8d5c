"""Records, rules and ledgers against hand-made cases."""

import datetime as dt
import json
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.operators import draws, measures, money, records, rules, terms
from marlstone.plans.ordering import running

DAY = {
    "date": "2026-10-03", "complete": True, "segments": [{"from": "06:00", "to": "09:30", "at": "home"}, {"from": "09:30", "to": "24:00", "at": "office"}],
    "entries": [
        {"k": "said", "t": "07:00", "text": "Good morning", "to": "Anna"}, {"k": "said", "t": "07:00", "text": "Good morning", "to": "Anna"}, {"k": "writing", "t": "10:00", "text": "On rivers"},
        {"k": "expense", "t": "09:30", "item": "tea", "amount": 20.0}, {"k": "income", "t": "12:00", "item": "fee", "amount": 500.0, "cheque": True}, {"k": "bag", "t": "24:00", "item": "paper", "price": 90.0, "settles": False}, {"k": "world", "t": "13:00", "text": "Rain", "owe": {"to": "laundry", "amount": 300.0, "why": "washing"}},
    ],
    "steps": [{"t": "06:00", "decision": {"action": "eat", "place": "home", "minutes": 20}}, {"t": "09:00", "decision": {"action": "walk", "place": "office", "minutes": 30}}, {"t": "11:00"}],
    "state": {"imprest": 410.0, "until": "2026-10-03T24:00"},
}


def test_a_day_as_records(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(DAY))
    df = spark.read.schema(records.DAY).option("multiLine", True).json(str(tmp_path))
    rows = [r.asDict() for r in records.projected(df).collect()]
    by = lambda **k: [r for r in rows if all(r[a] == b for a, b in k.items())]
    assert len(rows) == 11 and len({r["id"] for r in rows}) == 11
    said = by(kind="statement")
    assert len(said) == 2 and {r["id"][-2:] for r in said} == {":1", ":2"} and {r["place"] for r in said} == {"home"} and {r["who"] for r in said} == {"self"}
    pay = {r["item"]: r for r in by(kind="payment")}
    assert {k: (r["amount"], r["direction"], r["settled"]) for k, r in pay.items()} == {"tea": (20, "out", True), "fee": (500, "in", False), "paper": (90, "out", False), "washing": (300, "out", False)}
    assert pay["tea"]["place"] == "office" and pay["paper"]["place"] is None and pay["washing"]["to"] == "laundry"
    assert [(r["text"], r["place"]) for r in sorted(by(type="action"), key=lambda r: r["time"])] == [("eat", "home"), ("walk", None)]
    assert [(r["time"], r["amount"]) for r in by(type="cash")] == [("24:00", 410.0)] and len(by(kind="work")) == 1


def test_days_without_parts(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 1), None, None, None, None, None)], records.DAY)
    assert records.projected(df).count() == 0


def test_places_are_of_the_first_segment_that_holds_the_time(spark):
    rng = random.Random(7)
    clock = lambda: rng.choice([f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}", f"{rng.randint(6, 9)}:30", "24:00", "25:10", "x", None])
    days = []
    for n in range(6):  # two documents a date, with segments that overlap, repeat, end before they begin or have no clock or place
        segments = [(clock(), clock(), rng.choice(["a", "b", "c", None])) for _ in range(30)] if n else None
        days.append((dt.date(2026, 1, 1 + n // 2), True, segments, [("said", clock(), f"{n} {i}", *[None] * 8) for i in range(80)], None, None))
    got = {r["text"]: r["place"] for r in records.projected(spark.createDataFrame(days, records.DAY)).collect()}

    def minutes(c):
        out = int(c[:-3]) * 60 + int(c[-2:]) if c and ":" in c else None
        return out if out is not None and out <= 1440 else None

    def plainly(segments, t):
        for a, b, place in segments or []:
            if None not in (minutes(a), minutes(b), minutes(t)) and minutes(a) <= minutes(t) < minutes(b):
                return place

    want = {e[2]: plainly(d[2], e[1]) for d in days for e in d[3]}
    assert len(want) == 480 and got == want and len(set(want.values())) == 4


@pytest.fixture
def crowded(spark, tmp_path):
    """Events of a table of which one day has 30,000, some of them equal but for their ids; jobs of over two minutes are stopped."""
    rng = random.Random(5)
    kinds = ["view", "click", "purchase", "signup", "error", "other"]
    rows = [(i, dt.datetime(2024, 1, 1 + (i % 40 == 0)) + dt.timedelta(seconds=rng.randrange(86400)), i % 50, rng.choice(kinds), rng.randrange(9) / 4, f'{{"k": {rng.randrange(9)}}}') for i in range(30_000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    stop = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    stop.start()
    yield rows, str(tmp_path)
    stop.cancel()


def test_records_of_a_crowded_day(spark, crowded):
    rows, path = crowded
    want = Counter()
    for _, ts, _, kind, value, props in rows:
        k = json.loads(props)["k"]
        if kind in ("purchase", "signup"):
            want[ts.date(), "payment", {"purchase": "expense", "signup": "income"}[kind], k % 2 == 1] += 1
        elif kind != "view":
            want[ts.date(), "statement" if kind == "click" else "event", "said" if kind == "click" else "world", None] += 1
        if kind == "error":
            want[ts.date(), "payment", "owe", False] += 1
        want[ts.date(), "event", "action", None] += 1
    want |= {(d, "event", "cash", None): 1 for d in {r[1].date() for r in rows}}
    got = records.evidence_records(spark, path).collect()
    assert {(r["date"], r["kind"], r["type"], r["settled"]): r["n"] for r in got} == want and all(r["ids"] == r["n"] for r in got)


def test_places_of_a_crowded_day(spark, crowded):
    rows, path = crowded
    rows, want = sorted(rows, key=lambda r: (r[1], r[0])), Counter()
    last = {(r[1].date(), r[1].strftime("%H:%M")): f"p{json.loads(r[5])['k'] % 4}" for r in rows if r[3] == "view"}
    for r in rows:
        if r[3] == "click":  # the last view of the minute, or else of the last minute with one
            want[r[1].date(), next((last[m] for m in sorted(last, reverse=True) if m[0] == r[1].date() and m[1] <= r[1].strftime("%H:%M")), None)] += 1
    got = {(r["date"], r["place"]): r["n"] for r in records.statement_places(spark, path).collect()}
    assert got == want


def test_clock(spark):
    df = spark.createDataFrame([("06:05",), ("24:00",), ("24:01",), ("7:5",), (None,), ("x",)], "c string")
    assert [r["m"] for r in df.select(records.minutes_of(F.col("c")).alias("m")).collect()] == [365, 1440, None, None, None, None]


def due(spark, rule, day):
    df = spark.createDataFrame([(dt.date.fromisoformat(day),)], "d date")
    r = df.select(money.last_due(F.col("d"), rule).alias("a"), money.next_due(F.col("d"), rule).alias("b")).first()
    return tuple(x and x.isoformat() for x in r)


def test_due_days(spark):
    assert due(spark, {"weekday": "Sat"}, "2026-10-03") == ("2026-10-03", "2026-10-10")
    assert due(spark, {"monthday": 5}, "2026-03-04") == ("2026-02-05", "2026-03-05")
    assert due(spark, {"monthday": 5, "from": "2026-04-01"}, "2026-03-04") == (None, "2026-04-05")
    assert due(spark, {"every": 30, "anchor": "2026-01-01"}, "2026-01-30") == (None, "2026-01-31")
    assert due(spark, {"every": 30, "anchor": "2026-01-01"}, "2026-03-02") == ("2026-03-02", "2026-04-01")
    assert due(spark, {"every": 100, "anchor": "2026-01-01"}, "2026-01-02") == (None, None)


def test_settlement(spark):
    charges = spark.createDataFrame([("a", 1, "x", 1, 60.0), ("a", 2, "y", 2, 50.0), ("a", 3, "x", 3, 10.0), ("a", 4, "z", 4, 40.0), ("b", 5, "x", 1, 1.0)], "key string, id int, charge string, at int, amount double")
    got = [tuple(r)[1:] for r in money.settled(charges, spark.createDataFrame([("a", 100.0), ("b", 0.5)], "key string, balance double")).orderBy("id").collect()]
    assert got == [(1, True, False, 40.0), (2, False, False, 40.0), (3, False, True, 40.0), (4, True, False, 0.0), (5, False, False, 0.5)]


def test_answers(spark):
    good = {"thought": "a thought of some length here", "action": "eat", "place": "home", "minutes": 20, "buys": [{"item": "tea", "price": 20}]}
    cases = {"fine": json.dumps(good), "late": json.dumps(good | {"minutes": 241}), "lacks": json.dumps({"action": "eat"}), "text": "no", "buys": json.dumps(good | {"buys": [{"item": "tea"}]}), "two": json.dumps(good | {"action": "fly", "thought": "short"}), "none": None}
    df = spark.createDataFrame(list(cases.items()), "k string, a string")
    listed = lambda *x: F.array(*map(F.lit, x))
    errors, warnings = rules.answer_errors(F.col("a"), listed("eat"), listed("home"))
    got = {r["k"]: r["e"] for r in df.select("k", errors.alias("e")).collect()}
    assert got == {"fine": [], "late": ["minutes out of range"], "lacks": ["missing 'thought'", "missing 'place'", "missing 'minutes'"], "text": ["not an object"], "buys": ["buys is malformed"], "two": ["unknown action", "thought is empty or too short"], "none": ["not an object"]}
    long = spark.createDataFrame([(json.dumps(good | {"thought": "x" * 701}),)], "a string")
    assert long.select(warnings.alias("w")).first()["w"] == ["thought is very long"]


def test_days_of():
    assert rules.days_of("daily") == list(range(7)) and rules.days_of("Mon-Fri") == [0, 1, 2, 3, 4]
    assert rules.days_of("Fri-Mon") == [0, 4, 5, 6] and rules.days_of("Tue, Thu") == [1, 3]
    with pytest.raises(ValueError):
        rules.days_of("Someday")


def test_ballots_must_cover_the_same_cases(spark):
    ballot = lambda rows: spark.createDataFrame(rows, "item string, mark string, text string")
    key = lambda rows: spark.createDataFrame(rows, "item string, case int")
    a, ka = ballot([("p", "A", "x"), ("q", "B", "y")]), key([("p", 1), ("q", 2)])
    b, kb = ballot([("m", "C", "y"), ("n", "A", "x")]), key([("n", 1), ("m", 2)])
    assert sorted(map(tuple, records.aligned([a, b], [ka, kb]).collect())) == [(1, "x", "A", "A"), (2, "y", "B", "C")]
    for wrong in (ballot([("n", "A", "x")]), ballot([("m", "C", "other"), ("n", "A", "x")])):
        with pytest.raises(ValueError):
            records.aligned([a, wrong], [ka, kb])


def test_roster_and_eligible(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    assert sorted(r["i"] for r in rules.roster(ids(1, 2, 3), ids(2), ids(2), "i").collect()) == [1, 3]
    with pytest.raises(ValueError):
        rules.roster(ids(1, 2, 3), ids(2), ids(3), "i")
    fit, others = draws.first_eligible_of(ids(*range(10)), "i", F.when(F.col("i") % 3 == 0, "third"), 4)
    assert sorted(map(tuple, fit.select("place", "i").collect())) == [(1, 1), (2, 2), (3, 4), (4, 5)] and sorted(r["i"] for r in others.collect()) == [0, 3]
    with pytest.raises(ValueError):
        draws.first_eligible_of(ids(1, 2), "i", F.lit(None).cast("string"), 3)


def test_running_places(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit(2).alias("n"))
    got = sorted(map(tuple, running(df, ["k"], "n").select("k", "place", "total").collect()))
    assert got == [(k, k + 1, 2 * k + 2) for k in range(1000)]
    assert running(df.limit(0), ["k"]).count() == 0


def test_sun_is_near_the_almanac(spark):
    df = spark.createDataFrame([(dt.date(2026, 6, 21),), (dt.date(2026, 10, 27),), (dt.date(2026, 12, 21),)], "d date")
    rise, sets = measures.sun(F.col("d"), 28.6139, 77.2090, 330)
    got = [(r["a"], r["b"]) for r in df.select(rise.alias("a"), sets.alias("b")).collect()]
    for (a, b), (x, y) in zip(got, [(324, 1162), (389, 1060), (430, 1049)], strict=True):  # 5:24-19:22, 6:29-17:40, 7:10-17:29
        assert abs(a - x) <= 2 and abs(b - y) <= 2


def test_slips(spark):
    w = lambda *x: spark.createDataFrame([(i,) for i in x], "word string")
    got = sorted(map(tuple, terms.slips(w("worlt", "word", "wrold", "worlds", "x"), w("world", "words")).collect()))
    assert got == [("word", "words"), ("word", "world"), ("worlds", "words"), ("worlds", "world"), ("worlt", "world")]


def test_provenance_in_order(spark):
    passages = spark.createDataFrame([("w", 0, "aa"), ("w", 1, "zz"), ("w", 2, "aa"), ("w", 3, "b")], "work string, no int, text string")
    sources = spark.createDataFrame([("w", "xaab aab")], "work string, text string")
    assert [(r["no"], r["at"]) for r in terms.provenance(passages, sources).orderBy("no").collect()] == [(0, 1), (1, None), (2, 5), (3, 7)]


def test_probabilities(spark):
    df = spark.createDataFrame([(-1.0, -2.0), (-1.0, None), (None, -1.0), (None, None), (-1000.0, 0.0)], "y double, n double")
    got = [r["p"] for r in df.select(measures.probability(measures.log_odds(F.col("y"), F.col("n"))).alias("p")).collect()]
    assert got[0] == pytest.approx(0.7310586, abs=1e-6) and got[1] > 0.999999 and got[2] < 1e-6 and got[3] is None and got[4] == 0.0
