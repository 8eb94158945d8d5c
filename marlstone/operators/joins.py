"""Join shapes: intervals, as-of, full outer comparison, coverage, prior rows, sets, references, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dialect import frame, query
from .graph import components, shortest


@query
def interval_join_location(d):
    """Where each click falls among the half-open spans between a user's views; spans meet points by the hours they touch, so that the join has an equal key."""
    hours = d.span(f"CAST(floor({d.seconds('a')} / 3600) AS BIGINT)", f"CAST(floor(({d.seconds('b')} - 1) / 3600) AS BIGINT)")
    return f"""
WITH v AS (SELECT user_id, ts AS a, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, event_id AS span FROM {d.t("events")} WHERE event_type = 'view'),
w AS (SELECT user_id, a, b, span, {hours} AS h FROM v WHERE b IS NOT NULL AND {d.seconds("b")} > {d.seconds("a")}), s AS ({d.unnest("user_id, a, b, span", "w", "h", "pos", "hour")}),
p AS (SELECT event_id, user_id, ts, CAST(floor({d.seconds("ts")} / 3600) AS BIGINT) AS hour FROM {d.t("events")} WHERE event_type = 'click')
SELECT p.event_id, s.span FROM p JOIN s ON p.user_id = s.user_id AND p.hour = s.hour AND p.ts >= s.a AND p.ts < s.b"""


@query
def asof_last_state(d):
    """The last purchase strictly before each error of a user, by one pass over both instead of a range join."""
    last = "last(CASE WHEN event_type = 'purchase' THEN event_id END, true)" if type(d).__name__ == "SparkSQL" else "last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)"
    return f"SELECT event_id, state FROM (SELECT event_id, event_type, {last} OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM {d.t('events')} WHERE event_type IN ('purchase', 'error')) x WHERE event_type = 'error'"


@query
def full_outer_first_diff(d):
    """Two users' days side by side: in one only, in both, and the first place at which their acts differ."""
    return f"""
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS act, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM {d.t("events")}),
a AS (SELECT * FROM s WHERE user_id % 2 = 0), b AS (SELECT user_id - 1 AS user_id, day, act, rn FROM s WHERE user_id % 2 = 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, count(a.act) AS in_a, count(b.act) AS in_b, min(CASE WHEN a.act IS NULL OR b.act IS NULL OR a.act <> b.act THEN coalesce(a.rn, b.rn) END) AS first_diff
FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.day = b.day AND a.rn = b.rn GROUP BY coalesce(a.user_id, b.user_id), coalesce(a.day, b.day)""".replace("min(CASE WHEN a.act IS NULL", "CAST(min(CASE WHEN a.act IS NULL").replace("END) AS first_diff", "END) AS BIGINT) AS first_diff")


@query
def coverage_check(d):
    """Judgments against documents: missing, extra and repeated ids."""
    return f"""
SELECT count(CASE WHEN l.doc_id IS NULL THEN 1 END) AS missing, count(CASE WHEN t.doc_id IS NULL THEN 1 END) AS extra, count(CASE WHEN l.n > 1 THEN 1 END) AS repeated, count(CASE WHEN l.doc_id IS NOT NULL AND t.doc_id IS NOT NULL THEN 1 END) AS covered
FROM (SELECT doc_id, count(*) AS n FROM {d.t("labels")} GROUP BY doc_id) l FULL OUTER JOIN {d.t("documents")} t ON l.doc_id = t.doc_id"""


@query
def prior_events_last8(d):
    """Up to eight earlier events of a user's day before each error."""
    return f"""
WITH s AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM {d.t("events")})
SELECT e.event_id, p.event_id AS prior, CAST(e.n - p.n AS INTEGER) AS back FROM s e JOIN s p ON e.user_id = p.user_id AND e.day = p.day AND p.n < e.n AND p.n >= e.n - 8 WHERE e.event_type = 'error'"""


@query
def cited_time_join(d):
    """For minutes cited by an error's payload (k minutes before): the best kind in that minute, three results at most."""
    k = f"TRY_CAST({d.field('props', 'k')} AS INTEGER)"
    return f"""
WITH c AS (SELECT event_id, user_id, CAST(floor({d.seconds("ts")} / 60) AS BIGINT) - {k} AS m FROM {d.t("events")} WHERE event_type = 'error'),
e AS (SELECT event_id AS cited, CAST(floor({d.seconds("ts")} / 60) AS BIGINT) AS m, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS kind FROM {d.t("events")})
SELECT event_id, cited FROM (SELECT c.event_id, e.cited, row_number() OVER (PARTITION BY c.event_id ORDER BY e.kind, e.cited) AS rn FROM c JOIN e ON c.m = e.m) x WHERE rn <= 3"""


@query
def referential_integrity(d):
    """Rows that name a key that does not exist, by table."""
    return f"""
SELECT 'labels' AS rel, count(*) AS bad FROM {d.t("labels")} l LEFT JOIN {d.t("documents")} t ON l.doc_id = t.doc_id WHERE t.doc_id IS NULL
UNION ALL SELECT 'orders', count(*) FROM {d.t("orders")} o LEFT JOIN {d.t("customer")} c ON o.o_custkey = c.c_custkey WHERE c.c_custkey IS NULL
UNION ALL SELECT 'lineitem', count(*) FROM {d.t("lineitem")} l LEFT JOIN {d.t("part")} p ON l.l_partkey = p.p_partkey WHERE p.p_partkey IS NULL
UNION ALL SELECT 'nation', count(*) FROM {d.t("nation")} n LEFT JOIN {d.t("region")} r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey IS NULL"""


@query
def dimension_pairs(d):
    """Distances between all pairs of nations, looked up under a symmetric key."""
    return f"SELECT a.n_name AS first, b.n_name AS second, abs(a.n_regionkey - b.n_regionkey) * 10 + (a.n_nationkey + b.n_nationkey) % 7 AS minutes FROM {d.t('nation')} a JOIN {d.t('nation')} b ON a.n_nationkey < b.n_nationkey"


@query
def multiset_ops(d):
    """Sizes of union, intersection, differences and their multiset forms of two customers' segments of order priorities."""
    a = f"SELECT o_orderpriority AS x, o_orderstatus AS y FROM {d.t('orders')} WHERE o_totalprice > 200000"
    b = f"SELECT o_orderpriority AS x, o_orderstatus AS y FROM {d.t('orders')} WHERE o_totalprice <= 60000"
    ops = ("UNION", "INTERSECT", "EXCEPT", "UNION ALL", "INTERSECT ALL", "EXCEPT ALL")
    return " UNION ALL ".join(f"SELECT '{op}' AS op, count(*) AS n FROM (({a}) {op} ({b})) x{i}" for i, op in enumerate(ops))


@query
def state_keys(d):
    """Keys of two snapshots that are in one only or have other values."""
    return f"""
WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM {d.t("customer")} WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'BLOCKED' ELSE c_mktsegment END AS v FROM {d.t("customer")} WHERE c_custkey % 5 <> 0)
SELECT coalesce(a.k, b.k) AS k, a.v AS old, b.v AS new FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.v IS NULL OR b.v IS NULL OR a.v <> b.v"""


@query
def distinct_in_order(d):
    """A user's acts in order of their first use."""
    return f"SELECT user_id, {d.listed('act', ',', 'first')} AS acts FROM (SELECT user_id, event_type AS act, min(event_id) AS first FROM {d.t('events')} GROUP BY user_id, event_type) x GROUP BY user_id"


@query
def policy_comparison(d):
    """Rows that two routing rules send to different answers."""
    old, new = "CASE WHEN value > 50 THEN 'desk' ELSE 'self' END", "CASE WHEN value > 50 AND event_type <> 'view' THEN 'desk' WHEN event_type = 'error' THEN 'desk' ELSE 'self' END"
    return f"SELECT event_type, {old} AS old, {new} AS new, count(*) AS n FROM {d.t('events')} WHERE {old} <> {new} GROUP BY event_type, {old}, {new}"


@query
def seen_topics(d):
    """Words of benchmark items that no earlier item had, with the first item and all items that have them."""
    from ..functions.text import words

    return f"""
WITH t AS (SELECT item_id, {d.distinct(words(d, "text"))} AS w FROM {d.t("benchmark")}), one AS ({d.unnest("item_id", "t", "w", "pos", "word")})
SELECT word, min(item_id) AS first, {d.listed("CAST(item_id AS VARCHAR(20))", ",", "item_id")} AS items FROM one GROUP BY word"""


@query
def running_ledger(d):
    """Per supplier: sums, returns apart, and the greatest running balance."""
    return f"""
WITH b AS (SELECT l_suppkey, l_returnflag, l_extendedprice AS amount, sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance FROM {d.t("lineitem")})
SELECT l_suppkey, count(*) AS vouchers, round(sum(amount), 2) AS total, round(sum(CASE WHEN l_returnflag = 'R' THEN amount ELSE 0 END), 2) AS returned, round(max(balance), 2) AS peak FROM b GROUP BY l_suppkey"""


@query
def payment_duplicates(d):
    """Payments that repeat a canonical charge (customer, priority, day): the first and each later one."""
    return f"""
WITH p AS (SELECT o_orderkey, o_custkey || ':' || o_orderpriority || ':' || year(o_orderdate) AS charge FROM {d.t("orders")})
SELECT charge, first, o_orderkey AS duplicate FROM (SELECT charge, o_orderkey, min(o_orderkey) OVER (PARTITION BY charge) AS first FROM p) x WHERE o_orderkey <> first"""


@query
def run_length_codes(d):
    """A user's acts as runs (rle), and gaps between their event ids (delta)."""
    return f"""
WITH s AS (SELECT user_id, event_id, event_type, event_id - lag(event_id, 1, CAST(0 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS delta, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM {d.t("events")})
SELECT user_id, event_type, min(event_id) AS first, count(*) AS n, CAST(sum(delta) AS BIGINT) AS span FROM s GROUP BY user_id, event_type, island"""


EDGES = """edge AS (SELECT a.n_nationkey AS u, b.n_nationkey AS v, CAST(1 + (a.n_nationkey * 7 + b.n_nationkey * 3) % 5 AS INTEGER) AS cost FROM nation a JOIN nation b
  ON (a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey AND abs(a.n_nationkey - b.n_nationkey) < 12) OR abs(a.n_nationkey - b.n_nationkey) = 7)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as nodes (u, v, cost): neighbours by key in a region, and those seven keys apart."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    a, b = nation.alias("a"), nation.alias("b")
    gap = F.abs(F.col("a.n_nationkey") - F.col("b.n_nationkey"))
    same = a.join(b, F.col("a.n_regionkey") == F.col("b.n_regionkey")).where((gap > 0) & (gap < 12))
    sevens = [a.withColumn("to", F.col("a.n_nationkey") + step).join(b, F.col("to") == F.col("b.n_nationkey")) for step in (7, -7)]
    cost = (1 + (F.col("a.n_nationkey") * 7 + F.col("b.n_nationkey") * 3) % 5).cast("int")
    pick = lambda df: df.select(F.col("a.n_nationkey").alias("u"), F.col("b.n_nationkey").alias("v"), cost.alias("cost"))
    return pick(same).unionByName(pick(sevens[0])).unionByName(pick(sevens[1])).distinct()


@frame(f"""
WITH RECURSIVE {EDGES}, walk(node, cost, steps) AS (SELECT 0, 0, 0 UNION SELECT e.v, w.cost + e.cost, w.steps + 1 FROM walk w JOIN edge e ON e.u = w.node WHERE w.steps < 12 AND w.cost + e.cost <= 40)
SELECT CAST(node AS INTEGER) AS node, CAST(min(cost) AS INTEGER) AS cost FROM walk GROUP BY node""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least cost from node 0: relax the edges of nodes that got cheaper until none does. Each round is checkpointed; the driver sees a count."""
    return shortest(edges(spark, sf_dir), 0)


@frame(f"""
WITH RECURSIVE {EDGES}, walk(node, steps) AS (SELECT 0, 0 UNION SELECT e.v, w.steps + 1 FROM walk w JOIN edge e ON e.u = w.node WHERE w.steps < 12)
SELECT CAST(node AS INTEGER) AS node, CAST(min(steps) AS INTEGER) AS steps FROM walk GROUP BY node""")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from node 0 to each node that can be reached."""
    return shortest(edges(spark, sf_dir).withColumn("cost", F.lit(1)), 0).withColumnRenamed("cost", "steps")


@frame(f"""
WITH RECURSIVE {EDGES}, e AS (SELECT u, v FROM edge WHERE cost = 1 UNION SELECT v, u FROM edge WHERE cost = 1), walk(node, root, steps) AS (SELECT u, u, 0 FROM e UNION SELECT w.node, e.v, w.steps + 1 FROM walk w JOIN e ON e.u = w.root WHERE w.steps < 25)
SELECT CAST(node AS INTEGER) AS node, CAST(min(root) AS INTEGER) AS root FROM walk GROUP BY node""")
def connected_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least nation that each can be reached from over the cheapest edges."""
    return components(edges(spark, sf_dir).where("cost = 1").select(F.col("u").alias("a"), F.col("v").alias("b")))


@frame()
def group_isolated_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that share a text are one group; groups in hash order, the prefix nearest a fifth of the documents is held out (never all)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.xxhash64(F.sha2("text", 256)).alias("t"))
    firsts = docs.groupBy("t").agg(F.min("source").alias("a"), F.max("source").alias("m")).where("a <> m").drop("m")
    number = F.xxhash64
    pairs = docs.join(firsts, "t").where("source <> a").select(number("source").alias("a"), number("a").alias("b")).distinct()
    root = components(pairs)
    named = docs.select("source").distinct().withColumn("node", number("source"))
    groups = named.join(root, "node", "left").select("source", F.coalesce("root", "node").alias("grp"))
    n = docs.groupBy("source").count().join(groups, "source").groupBy("grp").agg(F.sum("count").alias("n"), F.sha2(F.concat(F.lit("seed|"), F.array_join(F.sort_array(F.collect_set("source")), ",")), 256).alias("k"))
    order = Window.orderBy("k")  # one row a group of sources
    cum = n.withColumn("cum", F.sum("n").over(order)).withColumn("rn", F.row_number().over(order)).withColumn("total", F.sum("n").over(Window.partitionBy())).withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy()))
    cut = cum.where("rn < groups or groups = 1").agg(F.min_by("rn", F.struct(F.abs(F.col("cum") - F.col("total") * 0.2), F.col("rn"))).alias("last"))
    held = cum.join(cut, F.col("rn") <= F.col("last"), "left_semi").select("grp", F.lit("held").alias("split"))
    return groups.join(held, "grp", "left").select("source", F.coalesce("split", F.lit("train")).alias("split"))
