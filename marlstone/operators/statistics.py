"""Statistics: rates and gates, spreads, agreement, calibration, resampling, overlap measures."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..plans.dialect import DuckDB, frame, query
from ..plans.ordering import running


def scored(d) -> str:
    """Labels with a probability that a hash of the id gives, and whether the row has a claim."""
    h = d.hexint(f"substr({d.sha('CAST(doc_id AS VARCHAR(20))')}, 1, 7)")
    return f"SELECT doc_id, quality AS y, CAST(least(0.999, greatest(0.001, CASE WHEN quality = 1 THEN 0.35 ELSE 0.0 END + 0.65 * {h} / 268435456.0)) AS DOUBLE) AS p, {h} % 3 > 0 AS claim FROM {d.t('labels')}"


@query
def rates_grouping_sets(d):
    """Returns per hundred lines by flag, with subtotals by year."""
    return f"SELECT l_returnflag AS flag, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS lines, round(CAST(100 * sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 3) AS per_100 FROM {d.t('lineitem')} GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, CAST(year(l_shipdate) AS INTEGER)))"


@query
def gates(d):
    """Differences between two priorities' rates against signed limits; all must pass, and an empty arm is undetermined."""
    return f"""
WITH m AS (SELECT o_orderpriority AS arm, count(*) AS n, round(CAST(100 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 3) AS f, round(CAST(100 * sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 3) AS dear FROM {d.t("orders")} GROUP BY o_orderpriority),
arms AS (SELECT min(arm) AS a, max(arm) AS b FROM m),
x AS (SELECT a.f AS fa, b.f AS fb, a.dear AS da, b.dear AS db FROM arms JOIN m a ON a.arm = arms.a JOIN m b ON b.arm = arms.b),
g AS (SELECT 'f' AS gate, round(fb - fa, 3) AS diff, 5.0 AS most FROM x UNION ALL SELECT 'dear', round(db - da, 3), -5.0 FROM x)
SELECT gate, diff, CASE WHEN diff IS NULL THEN 'UNDETERMINED' WHEN (most > 0 AND diff <= most + 1e-9) OR (most <= 0 AND diff >= most - 1e-9) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g"""


def quantile_spread_sql(d) -> str:
    q = lambda f: f"round({d.quantile('l_extendedprice', f)}, 4)"
    return f"SELECT l_returnflag, l_linestatus, count(*) AS n, {q(0.5)} AS median, {q(0.25)} AS q1, {q(0.75)} AS q3, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM {d.t('lineitem')} GROUP BY l_returnflag, l_linestatus"


@query
def kappa_and_tv(d):
    """Agreement of two codes beyond chance, and the total-variation distance of their shares."""
    return f"""
WITH c AS (SELECT quality AS a, 1 - toxic AS b FROM {d.t("labels")}), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS DOUBLE) AS same FROM c),
codes AS (SELECT a AS code FROM c UNION SELECT b FROM c),
p AS (SELECT code, (SELECT n FROM n) AS n, CAST((SELECT count(*) FROM c WHERE 1 = 1) AS DOUBLE) AS total FROM codes),
s AS (SELECT k.code, CAST(sum(CASE WHEN c.a = k.code THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS pa, CAST(sum(CASE WHEN c.b = k.code THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS pb FROM codes k CROSS JOIN c GROUP BY k.code),
e AS (SELECT sum(pa * pb) AS pe, sum(abs(pa - pb)) / 2 AS tv FROM s)
SELECT CAST(n.n AS BIGINT) AS n, round(CASE WHEN pe = 1 THEN 1.0 ELSE (same / n.n - pe) / (1 - pe) END, 3) AS kappa, round(tv, 6) AS tv FROM n CROSS JOIN e"""


@query
def calibration_ece_brier(d):
    """Expected calibration error over ten bins, Brier score and log loss."""
    return f"""
WITH s AS ({scored(d)}), b AS (SELECT least(9, CAST(floor(p * 10) AS INTEGER)) AS bin, sum(p) AS sp, sum(y) AS sy FROM s GROUP BY least(9, CAST(floor(p * 10) AS INTEGER))), n AS (SELECT count(*) AS n, avg((p - y) * (p - y)) AS brier, avg(-(y * ln(greatest(p, 1e-12)) + (1 - y) * ln(greatest(1 - p, 1e-12)))) AS loss FROM s)
SELECT max(n.n) AS n, round(sum(abs(b.sp - b.sy)) / max(n.n), 6) AS ece, round(max(n.brier), 6) AS brier, round(max(n.loss), 6) AS log_loss FROM b CROSS JOIN n"""


@query
def confusion(d):
    """Counts, recall and retention at one half."""
    return f"""
WITH s AS ({scored(d)})
SELECT count(CASE WHEN p >= 0.5 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN p >= 0.5 AND y = 0 THEN 1 END) AS fp, count(CASE WHEN p < 0.5 AND y = 1 THEN 1 END) AS fn, count(CASE WHEN p < 0.5 AND y = 0 THEN 1 END) AS tn,
  round(CAST(count(CASE WHEN p < 0.5 AND y = 0 THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN y = 0 THEN 1 END), 0), 6) AS recall, round(CAST(count(CASE WHEN p >= 0.5 AND y = 1 THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN y = 1 THEN 1 END), 0), 6) AS retention FROM s"""


@query
def threshold_grid(d):
    """Of thresholds 0.05 to 0.95 that keep four fifths of good rows, the one of best balanced accuracy, then most rejections, then greatest; rows without a claim are kept."""
    grid = " UNION ALL ".join(f"SELECT {i} AS c" for i in range(5, 96))
    return f"""
WITH s AS (SELECT CAST(floor(p * 100) AS INTEGER) AS b, y, claim, count(*) AS n FROM ({scored(d)}) q GROUP BY CAST(floor(p * 100) AS INTEGER), y, claim), g AS ({grid}),
m AS (SELECT g.c, CAST(sum(CASE WHEN y = 1 AND (NOT claim OR b >= c) THEN n ELSE 0 END) AS DOUBLE) / sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS keep, CAST(sum(CASE WHEN y = 0 AND claim AND b < c THEN n ELSE 0 END) AS DOUBLE) / sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS reject FROM s CROSS JOIN g GROUP BY g.c)
SELECT c / 100.0 AS threshold, round(keep, 6) AS retention, round(reject, 6) AS rejected FROM m WHERE keep >= 0.8 ORDER BY round((keep + reject) / 2, 9) DESC, reject DESC, c DESC LIMIT 1""".replace("c / 100.0 AS threshold", "CAST(c AS DOUBLE) / 100 AS threshold")


#: Lots that a case's rows are dealt into by hash; a halving is one of lots.
LOTS = 512


@query
def chance_gate_failure(d):
    """How often a gate fails if each case's rows are halved by chance: all rows are dealt into lots by hash and summed, and two
    hundred halvings of the lots by hash give the failure rate and the middle ninety per cent."""
    lot = f"{d.hexint('substr(' + d.sha(chr(39) + 'lot:' + chr(39) + ' || l_orderkey || ' + chr(39) + ':' + chr(39) + ' || l_linenumber') + ', 1, 7)')} % {LOTS}"
    return f"""
WITH s AS (SELECT l_returnflag, {lot} AS lot, sum(l_discount) AS discount, count(*) AS n FROM {d.t("lineitem")} GROUP BY l_returnflag, {lot}), runs AS (SELECT CAST(run AS INTEGER) AS run FROM (SELECT {"explode(sequence(1, 200))" if type(d).__name__ == "SparkSQL" else "unnest(range(1, 201))"} AS run) x),
h AS (SELECT run, discount, n, row_number() OVER (PARTITION BY run, l_returnflag ORDER BY {d.sha("run || ':' || l_returnflag || ':' || lot")}) AS rn, count(*) OVER (PARTITION BY run, l_returnflag) AS total FROM s CROSS JOIN runs),
m AS (SELECT run, round(100 * (sum(CASE WHEN 2 * rn <= total THEN discount ELSE 0 END) / sum(CASE WHEN 2 * rn <= total THEN n ELSE 0 END) - sum(CASE WHEN 2 * rn > total THEN discount ELSE 0 END) / sum(CASE WHEN 2 * rn > total THEN n ELSE 0 END)), 9) AS diff FROM h GROUP BY run),
o AS (SELECT diff, row_number() OVER (ORDER BY diff) AS rn FROM m)
SELECT round(CAST(count(CASE WHEN diff > 0.05 THEN 1 END) AS DOUBLE) / count(*), 6) AS failed, round(max(CASE WHEN rn = 11 THEN diff END), 6) AS low, round(max(CASE WHEN rn = 190 THEN diff END), 6) AS high FROM o"""


def prob_greater_pairs_sql(d) -> str:
    return f"""
WITH x AS (SELECT o_orderstatus AS stratum, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS arm, o_totalprice AS v FROM {d.t("orders")} WHERE o_orderpriority IN ('1-URGENT', '5-LOW')),
r AS (SELECT *, rank() OVER (PARTITION BY stratum ORDER BY v) + (count(*) OVER (PARTITION BY stratum, v) - 1) / 2.0 AS rk FROM x)
SELECT stratum, count(CASE WHEN arm = 1 THEN 1 END) AS n_on, count(CASE WHEN arm = 0 THEN 1 END) AS n_off, round(CAST(sum(CASE WHEN arm = 1 THEN rk END) - count(CASE WHEN arm = 1 THEN 1 END) * (count(CASE WHEN arm = 1 THEN 1 END) + 1) / 2.0 AS DOUBLE) / nullif(CAST(count(CASE WHEN arm = 1 THEN 1 END) AS DOUBLE) * count(CASE WHEN arm = 0 THEN 1 END), 0), 6) AS p_greater FROM r GROUP BY stratum"""


def turn_words(d) -> str:
    return f"""t AS (SELECT conv_id, turn, {words(d, "text")} AS w FROM {d.t("conversations")}), one AS ({d.unnest("conv_id, turn", "t", "w", "pos", "word")})"""


@query
def unigram_f1(d):
    """Multiset word overlap of each turn with the next, as F1."""
    return f"""
WITH {turn_words(d)}, n AS (SELECT conv_id, turn, word, count(*) AS n FROM one GROUP BY conv_id, turn, word), s AS (SELECT conv_id, turn, sum(n) AS total FROM n GROUP BY conv_id, turn),
c AS (SELECT a.conv_id, a.turn, sum(least(a.n, b.n)) AS common FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.word = b.word GROUP BY a.conv_id, a.turn)
SELECT x.conv_id, x.turn, round(2 * CAST(coalesce(c.common, 0) AS DOUBLE) / (x.total + y.total), 6) AS f1 FROM s x JOIN s y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 LEFT JOIN c ON c.conv_id = x.conv_id AND c.turn = x.turn"""


@query
def kendall_tau(d):
    """Order agreement of the words that a turn shares with the next, each occurrence matched to the first unused one; 0 below two matches."""
    return f"""
WITH {turn_words(d)}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, word ORDER BY pos) AS n FROM one),
m AS (SELECT a.conv_id, a.turn, a.pos AS p, b.pos AS q FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.word = b.word AND a.n = b.n),
i AS (SELECT x.conv_id, x.turn, count(*) AS inversions FROM m x JOIN m y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.p < y.p AND x.q > y.q GROUP BY x.conv_id, x.turn),
c AS (SELECT conv_id, turn, count(*) AS n FROM m GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, c.n AS matched, CASE WHEN c.n < 2 THEN 0.0 ELSE round(1 - 4 * CAST(coalesce(i.inversions, 0) AS DOUBLE) / (CAST(c.n AS DOUBLE) * (c.n - 1)), 6) END AS tau FROM c LEFT JOIN i ON c.conv_id = i.conv_id AND c.turn = i.turn""".replace("THEN 0.0 ELSE", "THEN CAST(0 AS DOUBLE) ELSE")


@query
def burrows_delta(d):
    """Mean distance, in deviations, of each work's word shares from the segments' means, over the 50 commonest words. A work is a
    language's texts of a source; it has a segment for each thousand words, all of equal size, and what is left over has none."""
    return f"""
WITH t AS (SELECT doc_id, source || ':' || lang AS work, {words(d, "text")} AS w FROM {d.t("documents")}), z AS (SELECT doc_id, work, w, coalesce(sum({d.size("w")}) OVER (PARTITION BY work ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum({d.size("w")}) OVER (PARTITION BY work) AS n FROM t),
k AS (SELECT doc_id, work, w, before, n, greatest(1, CAST(floor(n / 1000.0 + 0.5) AS BIGINT)) AS k FROM z), one AS ({d.unnest("work, before, n, k", "k", "w", "pos", "word")}),
placed AS (SELECT work, word, k, n, CAST(floor((before + pos) / floor(n * 1.0 / k)) AS BIGINT) AS seg FROM one), seg AS (SELECT work, word, work || ':' || seg AS seg FROM placed WHERE seg < k),
g AS (SELECT seg, work, word, count(*) AS n FROM seg GROUP BY seg, work, word), top AS (SELECT word FROM (SELECT word, row_number() OVER (ORDER BY sum(n) DESC, word) AS rn FROM g GROUP BY word) x WHERE rn <= 50),
size AS (SELECT seg, work, sum(n) AS n FROM g GROUP BY seg, work), share AS (SELECT s.seg, s.work, top.word, coalesce(CAST(g.n AS DOUBLE), 0) / s.n AS share FROM size s CROSS JOIN top LEFT JOIN g ON g.seg = s.seg AND g.word = top.word),
ref AS (SELECT word, avg(share) AS mean, stddev_pop(share) AS sd FROM share GROUP BY word HAVING stddev_pop(share) > 0),
mine AS (SELECT work, word, avg(share) AS share FROM share GROUP BY work, word)
SELECT m.work, round(avg(abs((m.share - r.mean) / r.sd)), 4) AS delta FROM mine m JOIN ref r ON m.word = r.word GROUP BY m.work"""


@query
def offer_funnel(d):
    """Per act and day: live once, moments eligible, shown, taken; totals by act."""
    return f"""
WITH x AS (SELECT event_type AS offer, CAST(ts AS DATE) AS day, 1 AS live, count(*) AS eligible, count(CASE WHEN value > 20 THEN 1 END) AS shown, count(CASE WHEN value > 60 THEN 1 END) AS yes FROM {d.t("events")} GROUP BY event_type, CAST(ts AS DATE))
SELECT offer, CAST(sum(live) AS BIGINT) AS live, CAST(sum(eligible) AS BIGINT) AS eligible, CAST(sum(shown) AS BIGINT) AS shown, CAST(sum(yes) AS BIGINT) AS yes, CAST(sum(shown) - sum(yes) AS BIGINT) AS refused FROM x GROUP BY offer"""


@query
def build_statistics(d):
    """Rows by label and language with a row for all."""
    return f"SELECT t.lang, l.quality, count(*) AS n FROM {d.t('labels')} l JOIN {d.t('documents')} t ON l.doc_id = t.doc_id GROUP BY ROLLUP (t.lang, l.quality)"


@frame()
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature of least loss: eighty bisections of the slope over 1/T in [0.05, 20]. Rows are first summed by log-odds in thousandths, so that the driver gets a bounded table."""
    p = (F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 7), 16, 10).cast("double") / 268435456.0) * 0.9 + 0.05
    z = F.round(F.log(p / (1 - p)) + 1.5 * F.col("quality") - 0.5, 3)
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(z.alias("z")).agg(F.sum("quality").alias("y"), F.count(F.lit(1)).alias("n")).toPandas()
    if not 0 < rows["y"].sum() < rows["n"].sum():
        raise ValueError("both classes are needed")
    low, high = 0.05, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        slope = float((rows["z"] * (rows["n"] / (1 + np.exp(-mid * rows["z"])) - rows["y"])).sum())
        low, high = (mid, high) if slope < 0 else (low, mid)
    return spark.createDataFrame([(round(2 / (low + high), 6), int(rows["n"].sum()))], "temperature double, n long")


@frame()
def bootstrap_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over strata of the difference between arms, with a 95 % interval from two thousand resamples within stratum and arm. A stratum's rows are reduced to counts by value first; strata with one arm are left out."""
    arm = F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.year("l_shipdate").alias("stratum"), arm.alias("arm"), F.col("l_discount").alias("v")).count()

    def resample(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(int(key[0]))
        means = {}
        for a, part in pdf.groupby("arm"):
            n, v = part.sort_values("v")["count"].to_numpy(), part.sort_values("v")["v"].to_numpy()
            draws = rng.multinomial(n.sum(), n / n.sum(), size=2000) @ v / n.sum()
            means[a] = (float(n @ v / n.sum()), draws)
        if len(means) < 2:
            return pd.DataFrame({"run": [], "diff": []})
        diff = np.concatenate([[means[1][0] - means[0][0]], means[1][1] - means[0][1]])
        return pd.DataFrame({"run": np.arange(len(diff)), "diff": diff})

    runs = rows.groupBy("stratum").applyInPandas(resample, "run int, diff double").groupBy("run").agg(F.avg("diff").alias("effect"))
    q = F.percentile(F.when(F.col("run") > 0, F.col("effect")), F.array(F.lit(0.025), F.lit(0.975)))
    return runs.agg(F.max(F.when(F.col("run") == 0, F.col("effect"))).alias("effect"), q.alias("q")).select("effect", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def cumulated(rows: DataFrame, by: Sequence[str], value: str, *sums: Column) -> DataFrame:
    """(by, value, n, sums, upto, size): distinct values of each group with how many rows have them, how many have them or a
    lesser one, and the group's size. Rows are counted by value first, and running counts go over the whole table."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *sums)
    found = running(counts, [*by, value], "n").drop("place")
    groups = found.groupBy(*by).agg(F.max("total").alias("__last"), F.sum("n").alias("size"))
    return found.join(groups, list(by)).withColumn("upto", F.col("total") - F.col("__last") + F.col("size")).drop("total", "__last")


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, least, most, and a column for each share): quantiles with linear interpolation between neighbours."""
    each = cumulated(rows, by, value)
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    picks = []
    for name, q in shares.items():
        place = F.lit(q) * (F.col("size") - 1)
        picks += [at(F.floor(place)).alias(f"__{name}0"), at(F.ceil(place)).alias(f"__{name}1")]
    found = each.groupBy(*by, "size").agg(F.min(value).alias("least"), F.max(value).alias("most"), *picks)
    between = lambda name, q: (F.col(f"__{name}0") + (F.col(f"__{name}1") - F.col(f"__{name}0")) * (F.lit(q) * (F.col("size") - 1) - F.floor(F.lit(q) * (F.col("size") - 1)))).alias(name)
    return found.select(*by, F.col("size").alias("n"), "least", "most", *[between(name, q) for name, q in shares.items()])


@frame(quantile_spread_sql(DuckDB()))
def quantile_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, median, quartiles and range of prices by flag and status."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_extendedprice")
    found = quantiles(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice", {"median": 0.5, "q1": 0.25, "q3": 0.75})
    return found.select("l_returnflag", "l_linestatus", "n", "least", "most", *[F.round(c, 4).alias(c) for c in ("median", "q1", "q3")])


def chance_greater(rows: DataFrame, by: str) -> DataFrame:
    """(by, n_on, n_off, p_greater) of rows (by, on, value): the chance that a value of one arm is greater than one of the other,
    ties half, from the sum of ranks; equal values share their middle rank."""
    each = cumulated(rows, [by], "value", F.count_if("on").alias("k"))
    rank = F.col("upto") - (F.col("n") - 1) / 2
    found = each.groupBy(by).agg(F.sum("k").alias("n_on"), (F.sum("n") - F.sum("k")).alias("n_off"), F.sum(rank * F.col("k")).alias("ranks"))
    p = (F.col("ranks") - F.col("n_on") * (F.col("n_on") + 1) / 2) / F.nullif(F.col("n_on").cast("double") * F.col("n_off"), F.lit(0.0))
    return found.select(by, "n_on", "n_off", p.alias("p_greater"))


@frame(prob_greater_pairs_sql(DuckDB()))
def prob_greater_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that an urgent order is dearer than a low one of its status."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    found = chance_greater(orders.select(F.col("o_orderstatus").alias("stratum"), (F.col("o_orderpriority") == "1-URGENT").alias("on"), F.col("o_totalprice").alias("value")), "stratum")
    return found.withColumn("p_greater", F.round("p_greater", 6))
