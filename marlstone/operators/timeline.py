"""Timelines: daily scoreboards, ordered windows, look-backs, calendars and clocks. Events stand in for steps: a user's day is a day, the event type the act, the value its minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dialect import DuckDB, frame, query
from ..plans.ordering import running

STEP = "SELECT event_id, user_id, CAST(ts AS DATE) AS day, ts, event_type AS act, value, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INTEGER) AS idx FROM {}"


def steps(d) -> str:
    return STEP.format(d.t("events"))


@query
def daily_scoreboard(d):
    """One row a day: steps, users, share of quiet views, the commonest error payload (ties by first seen) and whether it loops, meals (purchases), distinct places, and cash at its open and close."""
    return f"""
WITH s AS ({steps(d)}), e AS (SELECT CAST(ts AS DATE) AS day, {d.sub("props", "[0-9]+", "#")} AS kind, count(*) AS n, min(event_id) AS first FROM {d.t("events")} WHERE event_type = 'error' GROUP BY CAST(ts AS DATE), {d.sub("props", "[0-9]+", "#")}),
top AS (SELECT day, kind, n, row_number() OVER (PARTITION BY day ORDER BY n DESC, first) AS rn FROM e)
SELECT s.day, count(*) AS steps, count(DISTINCT s.user_id) AS users, count(CASE WHEN act = 'view' THEN 1 END) AS quiet, round(CAST(count(CASE WHEN act = 'view' THEN 1 END) AS DOUBLE) / count(*), 6) AS quiet_share,
  max(top.kind) AS top_error, coalesce(max(top.n), 0) AS top_errors, coalesce(max(top.n), 0) >= 4 AS loops, count(CASE WHEN act = 'purchase' THEN 1 END) AS meals, max(p.places) AS places, min_by(s.value, s.event_id) AS cash_open, max_by(s.value, s.event_id) AS cash
FROM s LEFT JOIN top ON s.day = top.day AND top.rn = 1 LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(DISTINCT TRY_CAST({d.field("props", "k")} AS INTEGER) % 4) AS places FROM {d.t("events")} GROUP BY CAST(ts AS DATE)) p ON s.day = p.day GROUP BY s.day"""


@query
def entropy_by_user(d):
    """Bits of a user's acts; null below twenty."""
    return f"""
WITH n AS (SELECT user_id, event_type, count(*) AS n FROM {d.t("events")} GROUP BY user_id, event_type), p AS (SELECT user_id, n, sum(n) OVER (PARTITION BY user_id) AS total FROM n)
SELECT user_id, CAST(max(total) AS BIGINT) AS acts, CASE WHEN max(total) >= 20 THEN round(-sum(CAST(n AS DOUBLE) / total * log2(CAST(n AS DOUBLE) / total)), 6) END AS bits FROM p GROUP BY user_id"""


@query
def jsd_day_over_day(d):
    """Jensen-Shannon divergence, in bits, between the minutes by act of a day and of the counted day before; null on the first."""
    return f"""
WITH m AS (SELECT CAST(ts AS DATE) AS day, event_type AS act, sum(value) AS minutes FROM {d.t("events")} GROUP BY CAST(ts AS DATE), event_type),
days AS (SELECT day, sum(minutes) AS total, lag(day) OVER (ORDER BY day) AS before, lag(sum(minutes)) OVER (ORDER BY day) AS total_before FROM m GROUP BY day HAVING sum(minutes) > 0),
acts AS (SELECT DISTINCT event_type AS act FROM {d.t("events")}),
pq AS (SELECT x.day, x.before, coalesce(a.minutes, 0) / x.total AS p, coalesce(b.minutes, 0) / x.total_before AS q FROM days x CROSS JOIN acts t LEFT JOIN m a ON a.day = x.day AND a.act = t.act LEFT JOIN m b ON b.day = x.before AND b.act = t.act)
SELECT day, CASE WHEN before IS NULL THEN NULL ELSE round(greatest(0.0, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)), 6) END AS variation FROM pq GROUP BY day, before"""


def islands(d) -> str:
    return f"s AS ({steps(d)}), f AS (SELECT *, CASE WHEN act = lag(act) OVER (PARTITION BY user_id, day ORDER BY idx) AND idx = lag(idx) OVER (PARTITION BY user_id, day ORDER BY idx) + 1 THEN 0 ELSE 1 END AS fresh FROM s WHERE act <> 'error'), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, day ORDER BY idx) AS island FROM f)"


@query
def runs_islands(d):
    """Unbroken runs of one act among adjacent steps; an error between breaks a run."""
    return f"WITH {islands(d)} SELECT user_id, day, act, min(idx) AS first_idx, count(*) AS steps, round(sum(value), 4) AS minutes FROM i GROUP BY user_id, day, island, act"


@query
def switches(d):
    """Adjacent steps with another act, by user and day."""
    return f"WITH s AS ({steps(d)}), l AS (SELECT *, lag(act) OVER (PARTITION BY user_id, day ORDER BY idx) AS was FROM s) SELECT user_id, day, count(CASE WHEN was IS NOT NULL AND was <> act THEN 1 END) AS switches, count(*) AS steps FROM l GROUP BY user_id, day"


@query
def median_dwell(d):
    """Median minutes of a user's runs, by act."""
    return f"WITH {islands(d)}, r AS (SELECT user_id, day, act, island, sum(value) AS minutes FROM i GROUP BY user_id, day, island, act) SELECT user_id, act, count(*) AS runs, round({d.quantile('minutes', 0.5)}, 4) AS dwell FROM r GROUP BY user_id, act"


@query
def seen_before_all_and_last5(d):
    """The share of a day's (user, act) pairs that any earlier day had, and that one of the five days before had; null on the first day."""
    return f"""
WITH p AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id, event_type FROM {d.t("events")}), days AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT day FROM p) x),
q AS (SELECT p.*, days.n, lag(days.n) OVER (PARTITION BY user_id, event_type ORDER BY days.n) AS last FROM p JOIN days ON p.day = days.day)
SELECT day, count(*) AS pairs, CASE WHEN n > 1 THEN round(CAST(count(last) AS DOUBLE) / count(*), 3) END AS seen, CASE WHEN n > 1 THEN round(CAST(count(CASE WHEN last >= n - 5 THEN 1 END) AS DOUBLE) / count(*), 3) END AS seen_5 FROM q GROUP BY day, n"""


@query
def trailing24_mean_index(d):
    """Hourly means, their mean over the last 24 rows, and the piecewise-linear index of it."""
    table = ((0, 30, 0, 50), (30, 60, 50, 100), (60, 90, 100, 200), (90, 120, 200, 300), (120, 250, 300, 400), (250, 500, 400, 500))  # fixed values: concentrations and indices between which the index is linear
    cases = " ".join(f"WHEN c <= {hi} THEN {ilo} + ({ihi} - {ilo}) * (greatest(c, {lo}) - {lo}) / ({hi} - {lo})" for lo, hi, ilo, ihi in table)
    return f"""
WITH h AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS v FROM {d.t("events")} GROUP BY date_trunc('hour', ts)), t AS (SELECT hour, avg(v) OVER (ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS c FROM h)
SELECT hour, round(c + 1e-7, 3) AS mean24, round(CAST(CASE WHEN c IS NULL THEN NULL {cases} ELSE 500 END AS DOUBLE) + 1e-7, 3) AS aqi FROM t"""


@query
def last3_per_key(d):
    """The three newest events of each user."""
    return f"SELECT user_id, event_id, n FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS n FROM {d.t('events')}) x WHERE n <= 3"


@query
def first_and_last_two(d):
    """The first and the last two events of each user and act."""
    return f"SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS b FROM {d.t('events')}) x WHERE a = 1 OR b <= 2"


@query
def last3_all_error(d):
    """Users whose last three waking steps (no views) are all errors while the newest step of all is a waking one; and minutes since it."""
    return f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM {d.t("events")}), w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {d.t("events")} WHERE event_type <> 'view'),
now AS (SELECT max(ts) AS now FROM {d.t("events")})
SELECT o.user_id, o.event_type <> 'view' AND coalesce(a.bad, 0) = 3 AS away, CAST(floor(({d.seconds("now.now")} - {d.seconds("o.ts")}) / 60.0) AS BIGINT) AS quiet_minutes, {d.seconds("now.now")} - {d.seconds("o.ts")} > 3600 AS quiet
FROM o CROSS JOIN now LEFT JOIN (SELECT user_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS bad FROM w WHERE k <= 3 GROUP BY user_id) a ON o.user_id = a.user_id WHERE o.n = 1"""


@query
def forward_fill_heading(d):
    """The last user turn's first words carried onto the turns after it, and whether a system turn stands within the forty turns before."""
    head = "CASE WHEN role = 'user' THEN substr(text, 1, 40) END"
    fill = f"last({head}, true) OVER w" if type(d).__name__ == "SparkSQL" else f"last_value({head} IGNORE NULLS) OVER w"
    return f"SELECT conv_id, turn, role, {fill} AS heading, coalesce(max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING), 0) = 1 AS within FROM {d.t('conversations')} WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def round_robin_interleave_sql(d) -> str:
    return f"SELECT doc_id, CAST(row_number() OVER (ORDER BY n, source) AS INTEGER) AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM {d.t('documents')}) x"


def every_kth_sql(d) -> str:
    return f"WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM {d.t('documents')}) SELECT doc_id, lang FROM r WHERE n <= 50 OR ceil(CAST(i AS DOUBLE) * 50 / n) < ceil(CAST(i + 1 AS DOUBLE) * 50 / n)"


@query
def moment_class(d):
    """A row's class from its own act and the act before it: brought, answered, empty or routine."""
    return f"""
WITH s AS ({steps(d)}), l AS (SELECT *, lag(act) OVER (PARTITION BY user_id, day ORDER BY idx) AS was FROM s),
c AS (SELECT user_id, day, CASE WHEN act IN ('signup', 'purchase') THEN 'brought' WHEN act = 'click' AND was = 'view' THEN 'answered' WHEN act = 'view' THEN 'empty' ELSE 'routine' END AS class FROM l)
SELECT day, class, count(*) AS n FROM c GROUP BY day, class"""


@query
def pooled_rows(d):
    """Shares as sums over sums, per-day measures as means of the days that have them."""
    return f"""
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, CASE WHEN count(*) >= 20 THEN avg(value) END AS mean FROM {d.t("events")} GROUP BY CAST(ts AS DATE))
SELECT CAST(sum(n) AS BIGINT) AS steps, round(CAST(sum(errors) AS DOUBLE) / sum(n), 6) AS error_share, round(avg(mean), 4) AS mean_of_days, count(mean) AS measured_days FROM d"""


@query
def last_six_in_budget(d):
    """The last six turns of a conversation that fit 1,500 characters, oldest dropped first."""
    return f"""
WITH o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {d.t("conversations")}),
r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM o WHERE back <= 6)
SELECT conv_id, count(*) AS turns, CAST(max(total) AS BIGINT) AS chars FROM r WHERE total <= 1500 GROUP BY conv_id"""


@query
def clock_fields(d):
    """Minute of the day, its spelling, weekday and day number."""
    h = "hour(ts) * 60 + minute(ts)"
    return f"""
SELECT event_id, CAST({h} AS INTEGER) AS minute, lpad(CAST(hour(ts) AS VARCHAR(2)), 2, '0') || ':' || lpad(CAST(minute(ts) AS VARCHAR(2)), 2, '0') AS hm, CAST({d.weekday("CAST(ts AS DATE)")} AS INTEGER) AS weekday, CAST({d.days("DATE '2024-01-01'", "CAST(ts AS DATE)")} + 1 AS INTEGER) AS day_number FROM {d.t("events")}"""


def sliding_rate_limit_sql(d) -> str:
    return f"SELECT event_id, n FROM (SELECT event_id, count(*) OVER (ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, {d.seconds('ts')} AS s FROM {d.t('events')} WHERE event_type = 'signup') x) y WHERE n > 1"


@query
def latest_on_or_before(d):
    """Each customer's newest order on or before mid-1996."""
    return f"SELECT o_custkey, max(o_orderdate) AS at, max_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderkey FROM {d.t('orders')} WHERE o_orderdate <= TIMESTAMP '1996-07-01 00:00:00' GROUP BY o_custkey".replace("struct_pack(a := o_orderdate, b := o_orderkey)", "struct(o_orderdate, o_orderkey)" if type(d).__name__ == "SparkSQL" else "struct_pack(a := o_orderdate, b := o_orderkey)")


@query
def trailing_staleness(d):
    """Gaps of more than an hour and three quarters between a user's events, which are resumed and never filled."""
    return f"SELECT user_id, event_id, gap FROM (SELECT user_id, event_id, {d.seconds('ts')} - lag({d.seconds('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM {d.t('events')}) x WHERE gap > 6300"


@query
def seasonal_words(d):
    """Hours as spans of the day, and how many events of each type fall in them."""
    return f"SELECT event_type, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS span, count(*) AS n FROM {d.t('events')} GROUP BY event_type, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END"


@frame(round_robin_interleave_sql(DuckDB()))
def round_robin_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken in turn from each source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    turn = docs.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    return running(turn, ["n", "source"]).select("doc_id", F.col("place").cast("int").alias("place"))


def recent(rows: DataFrame, seconds: int) -> DataFrame:
    """``rows`` (id, at in seconds) with how many there are within ``seconds`` up to each, itself included. Each row stands in
    its own span of that length and in the next, so that a span's window has all it looks back on."""
    spans = rows.select("id", "at", F.floor(F.col("at") / seconds).alias("own")).withColumn("span", F.explode(F.array("own", F.col("own") + 1)))
    n = F.count(F.lit(1)).over(Window.partitionBy("span").orderBy("at").rangeBetween(-seconds, 0))
    return spans.withColumn("n", n).where("span = own").select("id", "at", "n")


@frame(sliding_rate_limit_sql(DuckDB()))
def sliding_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups with another one within the hour before them."""
    signups = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return recent(signups, 3600).where("n > 1").select(F.col("id").alias("event_id"), "n")


# What a member's name may be made of, and the roles.
NAME, ROLES = r"^[A-Za-z0-9 _.'-]{2,40}$", ("reader", "writer", "guest")


def admitted(members: DataFrame, most: int = 300, seconds: int = 3600) -> DataFrame:
    """``members`` (id, at, name, role) with why each is not admitted: a bad name, no known role, too many within the hour."""
    seen = recent(members.select("id", "at"), seconds).select("id", "n")
    why = F.filter(F.array(F.when(~F.coalesce(F.col("name").rlike(NAME), F.lit(False)), "name"), F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "role"), F.when(F.col("n") > most, "rate")), lambda x: x.isNotNull())
    return members.join(seen, "id").select("id", "name", "role", why.alias("why"))


@frame("""
WITH s AS (SELECT event_id, floor(epoch(ts))::BIGINT AS s, 'u ' || props AS name, CASE event_type WHEN 'click' THEN 'reader' WHEN 'view' THEN 'guest' ELSE event_type END AS role FROM events),
n AS (SELECT *, count(*) OVER (ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM s)
SELECT array_to_string(list_filter([CASE WHEN NOT regexp_matches(name, '^[A-Za-z0-9 _.''-]{2,40}$') THEN 'name' END, CASE WHEN role NOT IN ('reader', 'writer', 'guest') THEN 'role' END, CASE WHEN n > 4 THEN 'rate' END], lambda x: x IS NOT NULL), ',') AS why, count(*) AS members FROM n GROUP BY 1""")
def admitted_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as members who join."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    role = F.when(F.col("event_type") == "click", "reader").when(F.col("event_type") == "view", "guest").otherwise(F.col("event_type"))
    members = e.select(F.col("event_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.concat(F.lit("u "), "props").alias("name"), role.alias("role"))
    return admitted(members, 4).groupBy(F.array_join("why", ",").alias("why")).agg(F.count(F.lit(1)).alias("members"))


def thinned(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """n rows of each group (by, order), evenly: those at which i * n / size passes a whole number; all of a group of n or fewer.
    Places come from one order over the whole table, less what stands before a group."""
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("size"))
    found = running(rows.select(by, order), [by, order]).join(sizes, by)
    first = found.groupBy(by).agg(F.min("place").alias("first"))
    i = F.col("place") - F.col("first")
    return found.join(first, by).where((F.col("size") <= n) | (F.ceil(i * n / F.col("size")) < F.ceil((i + 1) * n / F.col("size")))).select(by, order)


@frame(every_kth_sql(DuckDB()))
def every_kth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty rows of each language by index i * n / 50."""
    return thinned(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang", "doc_id", 50).select("doc_id", "lang")
