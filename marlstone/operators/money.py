"""Ledgers: what falls due by rules of the calendar, what is charged, settled, received, admitted and earned, in order of time."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dialect import frame
from .corpus import table

WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
#: Days that are looked ahead for the next due one.
AHEAD = 62


def last_due(day: Column, rule: dict) -> Column:
    """The latest date up to ``day`` on which a cost falls due, by a rule of one kind: {"weekday": "Fri"}, {"monthday": 5,
    "from": date} or {"every": 5, "anchor": date} (from the first repetition on); null if there is none. Days of a month
    from 1 to 28."""
    if "weekday" in rule:
        return F.date_sub(day, F.pmod(F.weekday(day) - WEEKDAYS.index(rule["weekday"]), F.lit(7)))
    if "monthday" in rule:
        month = F.trunc(F.when(F.day(day) >= rule["monthday"], day).otherwise(F.add_months(day, -1)), "MM")
        due = F.date_add(month, rule["monthday"] - 1)
        return F.when(due >= F.lit(rule["from"]).cast("date"), due) if rule.get("from") else due
    anchor = F.lit(rule["anchor"]).cast("date")
    times = F.floor(F.date_diff(day, anchor) / rule["every"]).cast("int")
    return F.when(times >= 1, F.date_add(anchor, times * rule["every"]))


def next_due(day: Column, rule: dict) -> Column:
    """The first date after ``day`` on which a cost falls due, AHEAD days ahead at most; else null."""
    if "weekday" in rule:
        out = F.date_add(day, F.pmod(F.lit(WEEKDAYS.index(rule["weekday"])) - F.weekday(day) - 1, F.lit(7)) + 1)
    elif "monthday" in rule:
        begin = F.greatest(F.date_add(day, 1), F.lit(rule["from"]).cast("date")) if rule.get("from") else F.date_add(day, 1)
        month = F.trunc(F.when(F.day(begin) <= rule["monthday"], begin).otherwise(F.add_months(begin, 1)), "MM")
        # a month's end may be cut by add_months, but not into another month
        out = F.date_add(month, rule["monthday"] - 1)
    else:
        anchor = F.lit(rule["anchor"]).cast("date")
        out = F.date_add(anchor, F.greatest(F.floor(F.date_diff(day, anchor) / rule["every"]) + 1, F.lit(1)).cast("int") * rule["every"])
    return F.when(F.date_diff(out, day) <= AHEAD, out)


#: Costs for the queries on the test tables.
COSTS = (("wash", "laundry", 300, {"weekday": "Fri"}), ("rent", "landlord", 9000, {"monthday": 5, "from": "2024-01-10"}), ("data", "shop", 199, {"every": 5, "anchor": "2024-01-01"}))
DUE_SQL = """
cal AS (SELECT unnest(generate_series(DATE '2023-10-01', DATE '2024-06-30', INTERVAL 1 DAY))::DATE AS x),
due AS (SELECT 'wash' AS cost, x FROM cal WHERE isodow(x) = 5 UNION ALL SELECT 'rent', x FROM cal WHERE day(x) = 5 AND x >= DATE '2024-01-10' UNION ALL SELECT 'data', x FROM cal WHERE x > DATE '2024-01-01' AND date_diff('day', DATE '2024-01-01', x) % 5 = 0),
days AS (SELECT DISTINCT ts::DATE AS day FROM events)"""


@frame(f"""
WITH {DUE_SQL}, k AS (SELECT day, cost FROM days, (VALUES ('wash'), ('rent'), ('data')) c(cost))
SELECT day, k.cost, max(CASE WHEN x <= day THEN x END) AS last, min(CASE WHEN x > day AND date_diff('day', day, x) <= 62 THEN x END) AS next FROM k LEFT JOIN due ON k.cost = due.cost GROUP BY day, k.cost""")
def due_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each cost, the last due day up to each event day, and the next one."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    each = F.array(*[F.struct(F.lit(c).alias("cost"), last_due(F.col("day"), r).alias("last"), next_due(F.col("day"), r).alias("next")) for c, _, _, r in COSTS])
    return days.select("day", F.explode(each).alias("c")).select("day", "c.*")


def accrued(looks: DataFrame, costs: Sequence[tuple[str, str, float, dict]]) -> DataFrame:
    """(key, day, cost, to, amount, since, charge): what a key (key, day) owes anew each day it looks: a cost whose last due
    day is after the one charged before, or, at the first look, is that day. ``costs`` are (cost, to, amount, rule)."""
    each = F.array(*[F.struct(F.lit(c).alias("cost"), F.lit(to).alias("to"), F.lit(float(n)).alias("amount"), last_due(F.col("day"), r).alias("since")) for c, to, n, r in costs])
    days = looks.select("key", "day").distinct().select("key", "day", F.explode(each).alias("c")).select("key", "day", "c.*").where("since is not null")
    begin = looks.groupBy("key").agg(F.min("day").alias("begin"))
    before = F.lag("since").over(Window.partitionBy("key", "cost").orderBy("day"))
    found = days.withColumn("before", before).join(begin, "key").where((F.col("since") >= F.col("begin")) & (F.col("before").isNull() | (F.col("since") > F.col("before"))))
    return found.select("key", "day", "cost", "to", "amount", "since", F.concat_ws(":", F.lit("cost"), "cost", F.col("since").cast("string")).alias("charge"))


@frame(f"""
WITH {DUE_SQL}, look AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), first AS (SELECT user_id, min(day) AS begin FROM look GROUP BY user_id),
atday AS (SELECT l.user_id, l.day, d.cost, max(d.x) AS since FROM look l JOIN due d ON d.x <= l.day GROUP BY l.user_id, l.day, d.cost),
fresh AS (SELECT user_id, cost, since, min(day) AS day FROM atday GROUP BY user_id, cost, since)
SELECT f.user_id, f.day, f.cost, 'cost:' || f.cost || ':' || f.since AS charge FROM fresh f JOIN first USING (user_id) WHERE f.since >= begin""")
def accrued_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users owe anew on the days they have events."""
    looks = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.to_date("ts").alias("day"))
    return accrued(looks, COSTS).select(F.col("key").alias("user_id"), "day", "cost", "charge")


def settled(charges: DataFrame, balances: DataFrame) -> DataFrame:
    """(key, id, paid, repeated, balance) of ``charges`` (key, id, charge, at, amount) in order of (at, id) against
    ``balances`` (key, balance): paid if the balance covers it, else passed over, so that lesser ones may still be paid; a
    charge that was paid already is repeated, and not paid again. One task a key, as each payment changes the next."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        left, done, out = float(pdf["balance"].iloc[0]), set(), []
        for r in pdf.sort_values(["at", "id"]).itertuples(index=False):
            repeated = r.charge in done
            paid = not repeated and r.amount <= left
            if paid:
                left -= r.amount
                done.add(r.charge)
            out.append((r.key, r.id, paid, repeated, round(left, 2)))
        return pd.DataFrame(out, columns=["key", "id", "paid", "repeated", "balance"])

    kind = {f.name: f.dataType.simpleString() for f in charges.schema}
    return charges.join(balances, "key").groupBy("key").applyInPandas(fold, f"key {kind['key']}, id {kind['id']}, paid boolean, repeated boolean, balance double")


@frame("""
WITH RECURSIVE c AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderpriority || ':' || year(o_orderdate) AS charge, (round(o_totalprice))::BIGINT AS amount, (round(c_acctbal * 100))::BIGINT AS balance, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey),
walk AS (SELECT k, id, n, charge, amount <= balance AS paid, false AS repeated, CASE WHEN amount <= balance THEN balance - amount ELSE balance END AS rest, CASE WHEN amount <= balance THEN [charge] ELSE [] END AS done FROM c WHERE n = 1
  UNION ALL SELECT c.k, c.id, c.n, c.charge, NOT list_contains(w.done, c.charge) AND c.amount <= w.rest, list_contains(w.done, c.charge), CASE WHEN NOT list_contains(w.done, c.charge) AND c.amount <= w.rest THEN w.rest - c.amount ELSE w.rest END, CASE WHEN NOT list_contains(w.done, c.charge) AND c.amount <= w.rest THEN list_append(w.done, c.charge) ELSE w.done END
  FROM walk w JOIN c ON c.k = w.k AND c.n = w.n + 1)
SELECT k AS c_custkey, id AS o_orderkey, paid, repeated, round(rest, 2)::DOUBLE AS balance FROM walk""")
def settlement_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as debts against a hundred times the balance; one a priority and year is paid."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.concat_ws(":", "o_orderpriority", F.year("o_orderdate").cast("string")).alias("charge"), F.col("o_orderdate").alias("at"), F.round("o_totalprice").alias("amount"))
    cash = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.round(F.col("c_acctbal") * 100).alias("balance"))
    return settled(orders, cash).select(F.col("key").alias("c_custkey"), F.col("id").alias("o_orderkey"), "paid", "repeated", "balance")


def next_after(rows: DataFrame, marks: DataFrame, keys: Sequence[str], what: str = "mark") -> DataFrame:
    """``rows`` (keys, at, ...) with the first of ``marks`` (keys, at, mark) at or after them, null without any: one window
    over both instead of a join of ranges. Marks at the same time count."""
    own = rows.withColumns({"__row": F.lit(True), what: F.lit(None).cast(marks.schema[what].dataType), "__mark_at": F.lit(None).cast(marks.schema["at"].dataType)})
    other = marks.select(*keys, "at", what, F.col("at").alias("__mark_at"), F.lit(False).alias("__row"))
    both = own.unionByName(other, allowMissingColumns=True)
    ahead = Window.partitionBy(*keys).orderBy("at", F.desc("__row"), what).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("__n", F.first(F.when(~F.col("__row"), F.struct(what, "__mark_at")), True).over(ahead)).where("__row")
    return found.select(*rows.columns, F.col(f"__n.{what}").alias(what), F.col("__n.__mark_at").alias(f"{what}_at"))


def collected(receipts: DataFrame, visits: DataFrame) -> DataFrame:
    """``receipts`` (key, id, after, place, amount) with when and by which visit (key, at, place, mark) each is collected:
    the first one at its place from its time on; null while it is outstanding."""
    found = next_after(receipts.withColumnRenamed("after", "at"), visits, ["key", "place"])
    return found.select("key", "id", F.col("at").alias("after"), "place", "amount", "mark", "mark_at")


def event_k() -> Column:
    return F.get_json_object("props", "$.k").try_cast("int")


@frame("""
WITH r AS (SELECT user_id, event_id, ts + INTERVAL 2 HOUR AS after, json_extract_string(props, '$.k')::INT % 3 AS place FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, event_id, ts, json_extract_string(props, '$.k')::INT % 3 AS place FROM events WHERE event_type = 'click')
SELECT r.event_id, r.place, (SELECT arg_min(v.event_id, (v.ts, v.event_id)) FROM v WHERE v.user_id = r.user_id AND v.place = r.place AND v.ts >= r.after) AS collected_by FROM r""")
def collected_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases due two hours later at a place, and the click of the user there that collects them."""
    e = table(spark, sf_dir, "events").withColumn("place", event_k() % 3)
    receipts = e.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("after"), "place", F.col("value").alias("amount"))
    visits = e.where("event_type = 'click'").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), "place", F.col("event_id").alias("mark"))
    return collected(receipts, visits).select(F.col("id").alias("event_id"), "place", F.col("mark").alias("collected_by"))


def cleared(cheques: DataFrame, accounts: DataFrame, days: int = 3) -> DataFrame:
    """``cheques`` (key, id, day, amount) with the day each is paid in, when it came or when the account (key, opened) was
    opened, and the day it clears; null without an account."""
    found = cheques.join(accounts, "key", "left").withColumn("paid_in", F.when(F.col("opened").isNotNull(), F.greatest("day", "opened")))
    return found.select("key", "id", "day", "amount", "paid_in", F.date_add("paid_in", days).alias("clears"))


@frame("""
WITH a AS (SELECT user_id, min(ts)::DATE AS opened FROM events WHERE event_type = 'signup' GROUP BY user_id), c AS (SELECT user_id, event_id, ts::DATE AS day FROM events WHERE event_type = 'purchase')
SELECT c.event_id, CASE WHEN opened > day THEN opened WHEN opened IS NOT NULL THEN day END AS paid_in, (CASE WHEN opened > day THEN opened WHEN opened IS NOT NULL THEN day END + 3) AS clears FROM c LEFT JOIN a USING (user_id)""")
def cleared_cheques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as cheques, signups as the opening of an account."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.to_date("ts").alias("day"), F.col("value").alias("amount"), "event_type")
    accounts = e.where("event_type = 'signup'").groupBy("key").agg(F.min("day").alias("opened"))
    return cleared(e.where("event_type = 'purchase'"), accounts).select(F.col("id").alias("event_id"), "paid_in", "clears")


def recouped(vouchers: DataFrame, visits: DataFrame) -> DataFrame:
    """(key, visit, admitted, queried, vouchers): what each visit (key, at, mark) goes through of the vouchers (key, at,
    amount, office) since the one before: office ones are admitted, others queried. Vouchers after the last visit wait."""
    found = next_after(vouchers, visits, ["key"]).where("mark is not null")
    money = lambda c: F.round(F.sum(F.when(c, F.col("amount")).otherwise(0.0)), 2)
    return found.groupBy("key", F.col("mark").alias("visit")).agg(money(F.col("office")).alias("admitted"), money(~F.col("office")).alias("queried"), F.count(F.lit(1)).alias("vouchers"))


@frame("""
WITH v AS (SELECT p.user_id, p.value, json_extract_string(p.props, '$.k')::INT % 2 = 0 AS office, (SELECT arg_min(s.event_id, (s.ts, s.event_id)) FROM events s WHERE s.event_type = 'signup' AND s.user_id = p.user_id AND s.ts >= p.ts) AS visit FROM events p WHERE p.event_type = 'purchase')
SELECT visit, round(sum(CASE WHEN office THEN value ELSE 0 END), 2) AS admitted, round(sum(CASE WHEN office THEN 0 ELSE value END), 2) AS queried, count(*) AS vouchers FROM v WHERE visit IS NOT NULL GROUP BY visit""")
def recouped_vouchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as vouchers that the user's next signup goes through."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("value").alias("amount"), (event_k() % 2 == 0).alias("office"), F.col("event_id").alias("mark"), "event_type")
    return recouped(e.where("event_type = 'purchase'").select("key", "at", "amount", "office"), e.where("event_type = 'signup'").select("key", "at", "mark")).select("visit", "admitted", "queried", "vouchers")


def commissioned(sittings: DataFrame, words: int, every: int) -> DataFrame:
    """(key, id, piece): the sittings (key, id, day, words) that are paid as pieces of recurring work: one is asked for at a
    time, takes a sitting of ``words``, and the next is asked for ``every`` days after. One task a key, over long sittings only."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, out = None, []
        for r in pdf.sort_values(["day", "id"]).itertuples(index=False):
            if asked is None or r.day >= asked:
                out.append((r.key, r.id, len(out) + 1))
                asked = r.day + pd.Timedelta(days=every)
        return pd.DataFrame(out, columns=["key", "id", "piece"])

    kind = {f.name: f.dataType.simpleString() for f in sittings.schema}
    long = sittings.where(F.col("words") >= words).select("key", "id", "day")
    return long.groupBy("key").applyInPandas(fold, f"key {kind['key']}, id {kind['id']}, piece int")


@frame("""
WITH RECURSIVE s AS (SELECT user_id, event_id, ts::DATE AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE, event_id) AS n FROM events WHERE value >= 50),
walk AS (SELECT user_id, event_id, day, n, 1 AS piece FROM s WHERE n = 1
  UNION ALL SELECT t.user_id, t.event_id, t.day, t.n, w.piece + 1 FROM walk w, LATERAL (SELECT * FROM s WHERE s.user_id = w.user_id AND s.n > w.n AND s.day >= w.day + 4 ORDER BY s.n LIMIT 1) t)
SELECT user_id, event_id, piece::INT AS piece FROM walk""")
def commissioned_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of fifty minutes and more as sittings, paid every four days."""
    sittings = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.to_timestamp(F.to_date("ts")).alias("day"), F.col("value").alias("words"))
    return commissioned(sittings, 50, 4).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "piece")


EFFECT = "struct<effect:string,amount:double,days:int>"


def effects(choices: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, id, day, effect, amount): ledger facts of choices (key, id, day, answer) by what each answer does (answer,
    effects: array of effect, amount, days): in order, each some days later."""
    each = choices.join(F.broadcast(answers), "answer").select("key", "id", "day", F.posexplode("effects").alias("no", "e"))
    return each.select("key", "id", F.col("no").cast("int").alias("no"), F.date_add("day", F.col("e.days")).alias("day"), F.col("e.effect").alias("effect"), F.col("e.amount").alias("amount"))


@frame("""
WITH a(event_type, no, effect, amount, days) AS (VALUES ('purchase', 0, 'owe', 20.0, 7), ('purchase', 1, 'schedule', NULL, 1), ('signup', 0, 'pay', 100.0, 0), ('error', 0, 'reprice', -5.0, 0), ('error', 1, 'owe', 1.0, 30), ('error', 2, 'bank', NULL, 2))
SELECT e.event_type, a.no, a.effect, ts::DATE + a.days AS day, count(*) AS n, sum(a.amount)::DOUBLE AS amount FROM events e JOIN a USING (event_type) GROUP BY e.event_type, a.no, a.effect, ts::DATE + a.days""")
def ledger_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What event types do to a ledger, by day."""
    does = {"purchase": [("owe", 20.0, 7), ("schedule", None, 1)], "signup": [("pay", 100.0, 0)], "error": [("reprice", -5.0, 0), ("owe", 1.0, 30), ("bank", None, 2)]}
    answers = spark.createDataFrame(list(does.items()), f"answer string, effects array<{EFFECT}>")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.to_date("ts").alias("day"), F.col("event_type").alias("answer"))
    found = effects(e, answers).join(e.select("id", F.col("answer").alias("event_type")), "id")
    return found.groupBy("event_type", "no", "effect", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


def promises(made: DataFrame, acts: DataFrame, days: int, horizon: Column) -> DataFrame:
    """``made`` (key, id, at) with what became of each promise: kept by the first act (key, at, mark) after it within
    ``days``, broken if that time passed without, open while ``horizon`` is before its end."""
    found = next_after(made, acts, ["key"])
    due = F.col("at") + F.make_dt_interval(F.lit(days))
    kept = F.col("mark").isNotNull() & (F.col("mark_at") <= due)
    return found.select("key", "id", "at", F.when(kept, "kept").when(horizon > due, "broken").otherwise("open").alias("status"), F.when(kept, F.col("mark")).alias("by"))


@frame("""
WITH h AS (SELECT max(ts) AS now FROM events), p AS (SELECT s.event_id, s.ts, (SELECT arg_min((e.event_id, e.ts), (e.ts, e.event_id)) FROM events e WHERE e.event_type = 'purchase' AND e.user_id = s.user_id AND e.ts >= s.ts) AS m FROM events s WHERE s.event_type = 'signup')
SELECT event_id, CASE WHEN struct_extract(m, 2) <= ts + INTERVAL 3 DAY THEN 'kept' WHEN now > ts + INTERVAL 3 DAY THEN 'broken' ELSE 'open' END AS status, CASE WHEN struct_extract(m, 2) <= ts + INTERVAL 3 DAY THEN struct_extract(m, 1) END AS by_event FROM p, h""")
def kept_promises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as promises of a purchase within three days."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"), "event_type")
    made = e.where("event_type = 'signup'").drop("event_type")
    acts = e.where("event_type = 'purchase'").select("key", "at", F.col("id").alias("mark"))
    horizon = e.agg(F.max("at")).first()[0]
    found = promises(made, acts, 3, F.lit(horizon))
    return found.select(F.col("id").alias("event_id"), "status", F.col("by").alias("by_event"))


def attended(sessions: DataFrame, cancel_after: int = 2) -> DataFrame:
    """``sessions`` (key, no, came) up to the one at which an engagement ends: the first of ``cancel_after`` missed in a row.
    (key, no, came, missed: misses in a row so far, cancelled)."""
    w = Window.partitionBy("key").orderBy("no")
    each = sessions.withColumn("__run", F.sum(F.col("came").cast("int")).over(w))
    each = each.withColumn("missed", F.sum((~F.col("came")).cast("int")).over(Window.partitionBy("key", "__run").orderBy("no")))
    each = each.withColumn("cancelled", F.col("missed") >= cancel_after)
    before = F.coalesce(F.max(F.col("cancelled").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("__before", before).where("__before = 0").select("key", "no", "came", F.col("missed").cast("int").alias("missed"), "cancelled")


@frame("""
WITH RECURSIVE d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), span AS (SELECT user_id, min(day) AS a, max(day) AS b FROM d GROUP BY user_id),
s AS (SELECT user_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM span), w AS (SELECT s.user_id, s.day, d.day IS NOT NULL AS came, row_number() OVER (PARTITION BY s.user_id ORDER BY s.day) AS n FROM s LEFT JOIN d ON s.user_id = d.user_id AND s.day = d.day WHERE isodow(s.day) IN (2, 4)),
walk AS (SELECT user_id, n, came, CASE WHEN came THEN 0 ELSE 1 END AS missed FROM w WHERE n = 1 UNION ALL SELECT w.user_id, w.n, w.came, CASE WHEN w.came THEN 0 ELSE k.missed + 1 END FROM walk k JOIN w ON w.user_id = k.user_id AND w.n = k.n + 1 WHERE k.missed < 2)
SELECT user_id, count(*) AS sessions, count(*) FILTER (WHERE came) AS attended, max(missed) >= 2 AS cancelled FROM walk GROUP BY user_id""")
def standing_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions on Tuesdays and Thursdays between a user's first and last day, until two in a row are missed."""
    days = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.to_date("ts").alias("no")).distinct()
    span = days.groupBy("key").agg(F.min("no").alias("a"), F.max("no").alias("b"))
    due = span.select("key", F.explode(F.sequence("a", "b")).alias("no")).where(F.weekday("no").isin(1, 3))
    found = attended(due.join(days.withColumn("came", F.lit(True)), ["key", "no"], "left").select("key", "no", F.coalesce("came", F.lit(False)).alias("came")))
    return found.groupBy(F.col("key").alias("user_id")).agg(F.count(F.lit(1)).alias("sessions"), F.count_if("came").alias("attended"), F.bool_or("cancelled").alias("cancelled"))
