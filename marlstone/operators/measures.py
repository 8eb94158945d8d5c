"""Measures of runs, arms, days and texts; clocks, curves and vectors; picks by several keys; callbacks as parameters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS
from ..plans.dialect import frame
from .corpus import table
from .money import event_k
from .records import clock_of

STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
#: Words that deny, and words for numbers.
NEGATIONS = ("no", "not", "never", "none", "nothing", "nobody", "neither", "nor", "cannot", "without")
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def distinct_names(rows: DataFrame, key: str, text: str, leave: Sequence[str] = ()) -> DataFrame:
    """(key, names): everyone named in lists ('A and B, C'), once in any case, in the first spelling with a capital, sorted."""
    each = rows.select(key, F.posexplode(F.split(text, r",\s*|\s+and\s+")).alias("pos", "name"), F.col(text).alias("__t")).withColumn("name", F.trim("name")).where(F.col("name") != "")
    if leave:
        each = each.where(~F.col("name").isin(*leave))
    firsts = each.groupBy(key, F.lower("name").alias("low")).agg(F.min_by("name", F.struct("pos", "__t")).alias("name"))
    return firsts.groupBy(key).agg(F.sort_array(F.collect_list(F.concat(F.upper(F.substring("name", 1, 1)), F.substring(F.col("name"), F.lit(2), F.length("name"))))).alias("names"))


@frame("""
WITH p AS (SELECT c_nationkey, unnest(['shri ' || c_mktsegment, 'Shri ' || c_mktsegment, n_name]) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT DISTINCT c_nationkey, CASE WHEN starts_with(lower(name), 'shri ') THEN 'Shri ' || substr(name, 6) ELSE name END AS name FROM p)
SELECT c_nationkey, string_agg(name, '|' ORDER BY name) AS names FROM f GROUP BY c_nationkey""")
def people_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in customers' lists of their nation and segment."""
    who = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = who.select("c_nationkey", F.concat(F.lit("shri "), "c_mktsegment", F.lit(" and Shri "), "c_mktsegment", F.lit(", "), "n_name").alias("people"))
    return distinct_names(rows, "c_nationkey", "people").select("c_nationkey", F.array_join("names", "|").alias("names"))


def health(steps: DataFrame, home: str, floor: int = 20, pattern: str | None = None) -> DataFrame:
    """One row a day of steps (day, idx, act, place, who, minutes, text): how many, the share at home, distinct places and
    people, entropy of places in bits, changes of act between neighbours, the middle length of unbroken runs of an act, and
    the share of texts that match a pattern, if one is given; measures are null below ``floor`` steps."""
    w = Window.partitionBy("day").orderBy("idx")
    was = F.lag("act").over(w)
    next_to = F.lag("idx").over(w) == F.col("idx") - 1
    each = steps.withColumn("new", F.when(next_to & (was == F.col("act")), 0).otherwise(1)).withColumn("switch", F.when(next_to & (was != F.col("act")), 1).otherwise(0))
    runs = each.withColumn("run", F.sum("new").over(w)).groupBy("day", "run").agg(F.sum("minutes").alias("m")).groupBy("day").agg(F.percentile("m", 0.5).alias("dwell"))
    place = each.groupBy("day", "place").agg(F.count(F.lit(1)).alias("k"))
    share = F.col("k") / F.sum("k").over(Window.partitionBy("day"))
    bits = place.withColumn("p", share).groupBy("day").agg((-F.sum(F.col("p") * F.log2("p"))).alias("bits"), F.count(F.lit(1)).alias("places"))
    n = F.count(F.lit(1))
    sums = each.groupBy("day").agg(n.alias("n"), (F.count_if(F.col("place") == home) / n).alias("home"), F.countDistinct("who").alias("voices"), F.sum("switch").alias("switches"), (F.count_if(F.col("text").rlike(pattern)) / n if pattern else F.lit(None).cast("double")).alias("hits"))
    told = lambda c: F.when(F.col("n") >= floor, F.col(c))
    return sums.join(bits, "day").join(runs, "day").select("day", "n", *[told(c).alias(c) for c in ("home", "places", "bits", "voices", "switches", "dwell", "hits")])


@frame("""
WITH s AS (SELECT ts::DATE AS day, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS idx, event_type AS act, 'p' || json_extract_string(props, '$.k')::INT % 4 AS place, user_id, value, props FROM events),
l AS (SELECT *, lag(act) OVER (PARTITION BY day ORDER BY idx) AS was FROM s), g AS (SELECT *, sum(CASE WHEN was = act THEN 0 ELSE 1 END) OVER (PARTITION BY day ORDER BY idx) AS run FROM l),
d AS (SELECT day, median(m) AS dwell FROM (SELECT day, run, sum(value) AS m FROM g GROUP BY day, run) x GROUP BY day),
p AS (SELECT day, -sum(q * log2(q)) AS bits, count(*) AS places FROM (SELECT day, place, count(*) / sum(count(*)) OVER (PARTITION BY day) AS q FROM s GROUP BY day, place) y GROUP BY day),
t AS (SELECT day, count(*) AS n, count(*) FILTER (WHERE place = 'p0') / count(*) AS home, count(DISTINCT user_id) AS voices, count(*) FILTER (WHERE was <> act) AS switches, count(*) FILTER (WHERE regexp_matches(props, '7')) / count(*) AS hits FROM l GROUP BY day)
SELECT day, n, CASE WHEN n >= 20 THEN round(home, 6) END AS home, CASE WHEN n >= 20 THEN places END AS places, CASE WHEN n >= 20 THEN round(bits, 6) END AS bits, CASE WHEN n >= 20 THEN voices END AS voices, CASE WHEN n >= 20 THEN switches::BIGINT END AS switches, CASE WHEN n >= 20 THEN round(dwell, 4) END AS dwell, CASE WHEN n >= 20 THEN round(hits, 6) END AS hits FROM t JOIN p USING (day) JOIN d USING (day)""")
def daily_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a day as steps."""
    idx = F.row_number().over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id"))
    steps = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), idx.alias("idx"), F.col("event_type").alias("act"), F.concat(F.lit("p"), (event_k() % 4).cast("string")).alias("place"), F.col("user_id").alias("who"), F.col("value").alias("minutes"), F.col("props").alias("text"))
    found = health(steps, "p0", pattern="7")
    return found.select("day", "n", F.round("home", 6).alias("home"), "places", F.round("bits", 6).alias("bits"), "voices", "switches", F.round("dwell", 4).alias("dwell"), F.round("hits", 6).alias("hits"))


def arm_measures(rows: DataFrame, term: str) -> DataFrame:
    """(arm, rows, accepted, words, rate): of rows (arm, accepted, text), the share accepted, mean words, and a term's uses per
    hundred words."""
    words, hits = F.size(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0))), F.size(F.regexp_extract_all("text", F.lit(term), F.lit(0)))
    return rows.groupBy("arm").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("accepted").cast("int")).alias("accepted"), F.avg(words).alias("words"), (100 * F.sum(hits) / F.greatest(F.sum(words), F.lit(1))).alias("rate"))


def divergence(rows: DataFrame, arm: str, code: str, base: str) -> DataFrame:
    """(arm, jsd): Jensen-Shannon divergence, base 2, of an arm's codes from those of the arm ``base``."""
    n = rows.groupBy(arm, code).agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(arm)))
    arms = n.select(arm).distinct()
    q = n.where(F.col(arm) == base).select(code, F.col("p").alias("q"))
    every = arms.join(F.broadcast(n.select(code).distinct())).join(n.select(arm, code, "p"), [arm, code], "left").join(q, code, "left").na.fill(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    return every.groupBy(arm).agg(F.greatest(F.sum(part("p") + part("q")) / 2, F.lit(0.0)).alias("jsd"))


@frame("""
WITH a AS (SELECT source AS arm, count(*) AS rows, avg(quality) AS accepted, avg(len(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS words, 100.0 * sum(len(regexp_extract_all(text, 'the'))) / greatest(sum(len(regexp_extract_all(text, '[A-Za-z0-9_]+'))), 1) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source),
n AS (SELECT source, lang, count(*) / sum(count(*)) OVER (PARTITION BY source) AS p FROM documents JOIN labels USING (doc_id) GROUP BY source, lang),
e AS (SELECT s.source, l.lang, coalesce(n.p, 0) AS p, coalesce(b.p, 0) AS q FROM (SELECT DISTINCT source FROM n) s CROSS JOIN (SELECT DISTINCT lang FROM n) l LEFT JOIN n ON n.source = s.source AND n.lang = l.lang LEFT JOIN n b ON b.source = 'src0' AND b.lang = l.lang),
j AS (SELECT source, greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0) AS jsd FROM e GROUP BY source)
SELECT arm, rows, round(accepted, 6) AS accepted, round(words, 4) AS words, round(rate, 4) AS rate, round(jsd, 6) AS jsd FROM a JOIN j ON arm = source""")
def arms_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as arms: labelled documents, quality as acceptance, languages as codes against the first source's."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("arm"), (F.col("quality") == 1).alias("accepted"), "text", "lang")
    found = arm_measures(rows, "the").join(divergence(rows, "arm", "lang", "src0"), "arm")
    return found.select("arm", "rows", F.round("accepted", 6).alias("accepted"), F.round("words", 4).alias("words"), F.round("rate", 4).alias("rate"), F.round("jsd", 6).alias("jsd"))


def retained(pairs: DataFrame, names: Column) -> DataFrame:
    """(id, kind, required, retained, extra) of pairs (id, plain, output): how many names (those of ``names``), numbers and
    negations the plain text has, as a multiset, how many of them the output has, too, and how many it has besides."""
    words = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"[\p{L}]+(?:['’][\p{L}]+)*"), F.lit(0)), lambda w: F.replace(F.lower(w), F.lit("’"), F.lit("'")))
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"(?<!\w)[+-]?[0-9]+(?:[.,][0-9]+)*%?(?!\w)"), F.lit(0))

    def bag(c):
        kinds = [("names", F.filter(words(c), lambda w: F.array_contains(names, w))), ("numbers", F.concat(numbers(c), F.filter(words(c), lambda w: w.isin(*NUMBER_WORDS)))), ("negations", F.filter(words(c), lambda w: w.isin(*NEGATIONS)))]
        named = lambda k, a: F.transform(a, lambda w: F.struct(F.lit(k).alias("kind"), w.alias("w")))
        return F.flatten(F.array(*[named(k, a) for k, a in kinds]))

    each = pairs.select("id", F.explode(bag(F.col("plain"))).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(pairs.select("id", F.explode(bag(F.col("output"))).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    n = each.groupBy("id", "x.kind", "x.w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return n.groupBy("id", "kind").agg(F.sum("a").alias("required"), F.sum(F.least("a", "b")).alias("retained"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("extra"))


@frame(f"""
WITH p AS (SELECT conv_id * 1000 + turn AS id, text AS output, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS plain FROM conversations), q AS (SELECT id, plain || ' 12 and 3.5%, not one' AS plain, output || ' 12, never 7' AS output FROM p WHERE plain IS NOT NULL),
s AS (SELECT id, 1 AS a, 0 AS b, plain AS t FROM q UNION ALL SELECT id, 0, 1, output FROM q),
w AS (SELECT id, a, b, unnest(regexp_extract_all(lower(t), '\\p{{L}}+(?:[''’]\\p{{L}}+)*')) AS w FROM s), m AS (SELECT id, a, b, trim(trim(unnest(regexp_extract_all(t, '(?:^|[^\\w.,])[+-]?[0-9]+(?:[.,][0-9]+)*%?')), ' '), ',') AS w FROM s),
x AS (SELECT id, 'names' AS kind, w, a, b FROM w WHERE w IN ('the', 'der', 'und') UNION ALL SELECT id, 'numbers', w, a, b FROM w WHERE w IN {NUMBER_WORDS} UNION ALL SELECT id, 'negations', w, a, b FROM w WHERE w IN {NEGATIONS} UNION ALL SELECT id, 'numbers', w, a, b FROM m),
n AS (SELECT id, kind, w, sum(a) AS a, sum(b) AS b FROM x GROUP BY id, kind, w)
SELECT id, kind, sum(a)::BIGINT AS required, sum(least(a, b))::BIGINT AS retained, sum(greatest(b - a, 0))::BIGINT AS extra FROM n GROUP BY id, kind""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn keeps of the turn before."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("output"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("plain")).where("plain is not null")
    pairs = turns.select("id", F.concat("plain", F.lit(" 12 and 3.5%, not one")).alias("plain"), F.concat("output", F.lit(" 12, never 7")).alias("output"))
    return retained(pairs, F.array(*map(F.lit, ("the", "der", "und"))))


@frame("""
SELECT event_type, count(*) AS total, count(*) FILTER (WHERE json_extract_string(props, '$.k')::INT >= 10) AS ok, round(median(value), 4) AS median_s, max(value) AS most_s FROM events GROUP BY event_type""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that went well of all, and the middle and longest time they took."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(event_k() >= 10).alias("ok"), F.round(F.percentile("value", 0.5), 4).alias("median_s"), F.max("value").alias("most_s"))


def by_position(rows: DataFrame, key: str, answers: str, metric: Callable[[Column], Column]) -> DataFrame:
    """(position, value, mean): the i-th answers of all rows as one text in order of the key, a metric of each, and the mean
    over positions."""
    each = rows.select(key, F.posexplode(answers).alias("position", "answer"))
    texts = each.groupBy("position").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "answer"))), lambda s: s["answer"]), " ").alias("text"))
    found = texts.select("position", metric(F.col("text")).alias("value"))
    return found.join(F.broadcast(found.agg(F.avg("value").alias("mean"))))


@frame("""
WITH c AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations),
t AS (SELECT position, string_agg(text, ' ' ORDER BY conv_id) AS x FROM c GROUP BY position), v AS (SELECT position, len(list_distinct(regexp_extract_all(lower(x), '[a-z]+'))) / len(regexp_extract_all(lower(x), '[a-z]+')) AS value FROM t)
SELECT position::INT AS position, round(value, 6) AS value, round((SELECT avg(value) FROM v), 6) AS mean FROM v""")
def positions_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of distinct words of the i-th turns of all conversations."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("answers"))
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0))
    found = by_position(rows, "conv_id", "answers", lambda t: F.size(F.array_distinct(words(t))) / F.size(words(t)))
    return found.select("position", F.round("value", 6).alias("value"), F.round("mean", 6).alias("mean"))


@frame("""
SELECT quality AS label, count(*) AS answered, count(*) FILTER (WHERE toxic = quality) AS judge_toxic, count(*) FILTER (WHERE (doc_id % 3 = 0)::INT = quality) AS judge_third, count(*) FILTER (WHERE length(text) > 500 AND quality = 1 OR length(text) <= 500 AND quality = 0) AS judge_length FROM labels JOIN documents USING (doc_id) GROUP BY quality""")
def judges_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of three judges hits each label, side by side."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    said = F.array(*[F.struct(F.lit(k).alias("judge"), v.alias("says")) for k, v in (("judge_toxic", F.col("toxic")), ("judge_third", (F.col("doc_id") % 3 == 0).cast("int")), ("judge_length", (F.col("n") > 500).cast("int")))])
    each = rows.select("doc_id", F.col("quality").alias("label"), F.explode(said).alias("s")).select("doc_id", "label", "s.*")
    hits = each.groupBy("label").pivot("judge", ["judge_toxic", "judge_third", "judge_length"]).agg(F.count_if(F.col("says") == F.col("label")))
    return hits.join(rows.groupBy(F.col("quality").alias("label")).agg(F.count(F.lit(1)).alias("answered")), "label")


def regime(share: Column, high: float = 0.8, low: float = 0.2) -> Column:
    return F.when(share >= high, "steady").when(share <= low, "free").otherwise("mixed")


def run_measures(runs: DataFrame) -> DataFrame:
    """Measures of runs (run, steps: array of act, minutes, buys: array of prices): steps, minutes, spending over nested
    arrays, the commonest act's share and what regime that is, whether any act is missing from a set of three."""
    acts = F.transform("steps", lambda s: s["act"])
    counts = F.transform(F.array_distinct(acts), lambda a: F.size(F.filter(acts, lambda x: x == a)))
    share = F.array_max(counts) / F.size(acts)
    minutes = F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["minutes"])
    spent = F.aggregate("steps", F.lit(0.0), lambda a, s: a + F.aggregate(F.coalesce(s["buys"], F.array().cast("array<double>")), F.lit(0.0), lambda b, x: b + x))
    lacks = F.size(F.array_except(F.array(*map(F.lit, ("click", "purchase", "view"))), acts)) > 0
    return runs.select("run", F.size("steps").alias("n"), F.round(minutes, 4).alias("minutes"), F.round(spent, 4).alias("spent"), F.round(share, 6).alias("top_share"), regime(share).alias("regime"), lacks.alias("lacks")).withColumnRenamed("n", "steps")


@frame("""
WITH n AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY user_id, event_type), m AS (SELECT user_id, max(k) / sum(k) AS s, count(*) FILTER (WHERE event_type IN ('click', 'purchase', 'view')) < 3 AS lacks FROM n GROUP BY user_id)
SELECT e.user_id, count(*)::INT AS steps, round(sum(value), 4) AS minutes, round(sum(CASE WHEN event_type = 'purchase' THEN 1.5 * value ELSE 0 END), 4) AS spent, round(any_value(s), 6) AS top_share, CASE WHEN any_value(s) >= 0.8 THEN 'steady' WHEN any_value(s) <= 0.2 THEN 'free' ELSE 'mixed' END AS regime, any_value(lacks) AS lacks FROM events e JOIN m ON e.user_id = m.user_id GROUP BY e.user_id""")
def runs_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs of their events."""
    buys = F.when(F.col("event_type") == "purchase", F.array("value", F.col("value") / 2))
    runs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.collect_list(F.struct(F.col("event_type").alias("act"), F.col("value").alias("minutes"), buys.alias("buys"))).alias("steps"))
    return run_measures(runs).withColumnRenamed("run", "user_id")


def least_by(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each group that is least by several measures, one after the other."""
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


@frame("""
SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_tax, l_quantity, l_orderkey, l_linenumber) AS n FROM lineitem) x WHERE n = 1""")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's line of the highest discount, then the least tax, quantity and key."""
    order = [-F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")]
    return least_by(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order).select("l_suppkey", "l_orderkey", "l_linenumber")


def shrunk(size: Column, fixed: Column, limit: int, floor: int, a_token: float = 4.0) -> Column:
    """The greatest length up to ``size`` whose cost, ``fixed`` tokens and one for each ``a_token`` characters begun, fits
    ``limit``; null if that is below ``floor`` characters, which a caller is to treat as an error."""
    room = F.floor((F.lit(limit) - fixed) * a_token).cast("int")
    out = F.least(size, room)
    return F.when((out >= size) | (out >= floor), out)


@frame("""
WITH t AS (SELECT doc_id, length(text) AS n, doc_id % 900 AS fixed FROM documents), c AS (SELECT doc_id, n, max(k) AS fits FROM (SELECT doc_id, n, fixed, unnest(range(0, least(n, 4200) + 1)) AS k FROM t) x WHERE fixed + ceil(k / 4.0) <= 1000 GROUP BY doc_id, n)
SELECT t.doc_id, CASE WHEN fits >= t.n OR fits >= 300 THEN fits::INT END AS chars FROM t LEFT JOIN c ON t.doc_id = c.doc_id""")
def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document fits 1,000 tokens beside what else is there, not below 300 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", shrunk(F.length("text"), (F.col("doc_id") % 900).cast("int"), 1000, 300).alias("chars"))


def weather(rain: Column, cloud: Column, fog: Column, temperature: Column) -> Column:
    """The class of an hour's weather, the first that holds."""
    return F.when(fog, "fog").when(rain >= 10, "downpour").when(rain > 0.2, "rain").when(cloud >= 80, "overcast").when(temperature >= 40, "heat").when(cloud >= 30, "clouds").otherwise("clear")


def usual(hour: Column, low: float, high: float, warmest: int = 15) -> Column:
    """A day's usual curve between its low and high."""
    return F.lit((low + high) / 2) + F.lit((high - low) / 2) * F.cos((hour - warmest) * (2 * math.pi / 24))


@frame("""
SELECT sky, count(*) AS hours, round(avg(30 + 8 * cos((hour(ts) - 15) * 2 * pi() / 24)), 4) AS usual FROM (SELECT ts, CASE WHEN k % 17 = 0 THEN 'fog' WHEN value / 8 >= 10 THEN 'downpour' WHEN value / 8 > 8 THEN 'rain' WHEN k >= 80 THEN 'overcast' WHEN value >= 60 THEN 'heat' WHEN k >= 30 THEN 'clouds' ELSE 'clear' END AS sky FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) e) x GROUP BY sky""")
def weather_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hours of weather, and the usual temperature of their times."""
    k = event_k()
    rain = F.when(F.col("value") / 8 > 8, F.col("value") / 8).otherwise(0.0)
    e = table(spark, sf_dir, "events").withColumn("sky", weather(rain, k, k % 17 == 0, F.col("value") - 20))
    return e.groupBy("sky").agg(F.count(F.lit(1)).alias("hours"), F.round(F.avg(usual(F.hour("ts"), 22, 38)), 4).alias("usual"))


def log_odds(yes: Column, no: Column) -> Column:
    """Of two log-probabilities; null if both are missing, and one that is missing is far below the other."""
    return F.when(yes.isNotNull() | no.isNotNull(), F.coalesce(yes, no - 20) - F.coalesce(no, yes - 20))


def probability(odds: Column, temperature: float = 1.0) -> Column:
    """The sigmoid of scaled log-odds, without overflow."""
    x = odds / temperature
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


@frame("""
SELECT doc_id, round(1 / (1 + exp(-((CASE WHEN doc_id % 7 = 0 THEN no - 20 ELSE yes END) - no) / 2.5)), 9) AS p FROM (SELECT doc_id, -(doc_id % 11) / 3.0 AS yes, -(doc_id % 13) / 2.0 AS no FROM labels) x""")
def claim_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled probabilities from two log-probabilities, of which one is sometimes missing."""
    yes, no = F.when(F.col("doc_id") % 7 != 0, -(F.col("doc_id") % 11) / 3.0), -(F.col("doc_id") % 13) / 2.0
    return table(spark, sf_dir, "labels").select("doc_id", F.round(probability(log_odds(yes, no), 2.5), 9).alias("p"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cross(a: Column, b: Column) -> Column:
    """Of vectors of three components."""
    at = lambda v, i: F.get(v, F.lit(i % 3)).cast("double")
    return F.array(*[at(a, i + 1) * at(b, i + 2) - at(a, i + 2) * at(b, i + 1) for i in range(3)])


def plane_normal(a: Column, b: Column, c: Column) -> Column:
    """The unit normal of the plane through three points; null if they are on a line."""
    less = lambda p, q: F.zip_with(p, q, lambda x, y: x.cast("double") - y)
    n = cross(less(b, a), less(c, a))
    size = F.sqrt(dot(n, n))
    return F.when(size > 1e-12, F.transform(n, lambda x: x / size))


def angle(a: Column, b: Column) -> Column:
    """Degrees between two vectors; null for one without a length."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))))))


@frame("""
WITH v AS (SELECT vec_id, embedding[1:3]::DOUBLE[] AS a, embedding[4:6]::DOUBLE[] AS b, embedding[7:9]::DOUBLE[] AS c FROM embeddings), d AS (SELECT *, list_transform(list_zip(b, a), lambda p: p[1] - p[2]) AS u, list_transform(list_zip(c, a), lambda p: p[1] - p[2]) AS w FROM v),
n AS (SELECT *, array_cross_product([u[1], u[2], u[3]]::DOUBLE[3], [w[1], w[2], w[3]]::DOUBLE[3]) AS n FROM d)
SELECT vec_id, round(degrees(acos(list_cosine_similarity(u, w))), 4) AS angle, round(n[1] / sqrt(n[1] ** 2 + n[2] ** 2 + n[3] ** 2), 6) AS nx, round(list_dot_product(a, b), 6) AS dot FROM n""")
def plane_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's first nine components as three points: the angle at the first, the plane's normal, a product."""
    a, b, c = (F.slice("embedding", i, 3) for i in (1, 4, 7))
    less = lambda p, q: F.zip_with(p, q, lambda x, y: x.cast("double") - y)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(angle(less(b, a), less(c, a)), 4).alias("angle"), F.round(F.get(plane_normal(a, b, c), F.lit(0)), 6).alias("nx"), F.round(dot(a, b), 6).alias("dot"))


def commonest(rows: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """(by, counts): the k commonest values with their counts as a map, commonest first, ties in order of the value."""
    n = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))
    return n.withColumn("r", rank).where(F.col("r") <= k).groupBy(by).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("r", value, "n"))), lambda s: F.struct(s[value], s["n"]))).alias("counts"))


@frame("""
SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY n DESC, event_type) AS counts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) x) y WHERE r <= 3 GROUP BY user_id""")
def commonest_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's three commonest kinds of events."""
    found = commonest(table(spark, sf_dir, "events"), "user_id", "event_type", 3)
    return found.select("user_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


def local_clock(at: Column, offset_minutes: int = 330, shift_minutes: int = 0) -> Column:
    """A UTC time without a zone in a zone of fixed offset, shifted."""
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(offset_minutes + shift_minutes), F.lit(0))


def long_date(day: Column) -> Column:
    return F.date_format(day, "EEEE, d MMMM yyyy")


def ago(minutes: Column) -> Column:
    """Words for how long ago something was."""
    hours = F.round(minutes / 60).cast("int")
    return F.when(minutes < 15, "just now").when(minutes < 45, "half an hour ago").when(hours <= 1, "an hour ago").when(hours < 24, F.concat(hours.cast("string"), F.lit(" hours ago"))).when(hours < 48, "yesterday").otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit(" days ago")))


@frame("""
WITH l AS (SELECT event_id, ts + INTERVAL 340 MINUTE AS at_local, date_diff('second', ts, (SELECT max(ts) FROM events)) / 60.0 AS m FROM events)
SELECT event_id, strftime(at_local, '%H:%M') AS clock, dayname(at_local) || ', ' || day(at_local) || ' ' || monthname(at_local) || ' ' || year(at_local) AS long_day, CASE WHEN m < 15 THEN 'just now' WHEN m < 45 THEN 'half an hour ago' WHEN round(m / 60) <= 1 THEN 'an hour ago' WHEN round(m / 60) < 24 THEN round(m / 60)::INT || ' hours ago' WHEN round(m / 60) < 48 THEN 'yesterday' ELSE floor(round(m / 60) / 24)::INT || ' days ago' END AS ago FROM l""")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on a clock five and a half hours and ten minutes ahead, and how long before the last one they were."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    at = local_clock(F.col("ts"), 330, 10)
    minutes = (F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 60
    return e.join(F.broadcast(now)).select("event_id", clock_of(F.hour(at) * 60 + F.minute(at)).alias("clock"), long_date(at).alias("long_day"), ago(minutes).alias("ago"))


def sun(day: Column, lat: float, lon: float, offset_minutes: int) -> tuple[Column, Column]:
    """Sunrise and sunset in minutes of the local day, by NOAA's approximation: the year's angle gives the equation of time and
    the declination; the sun rises and sets 90.833 degrees from the zenith."""
    g = (F.dayofyear(day) - 1) * (2 * math.pi / 365)
    # The approximation's coefficients.
    eqt = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    phi = math.radians(lat)
    cos_ha = math.cos(math.radians(90.833)) / (math.cos(phi) * F.cos(decl)) - math.tan(phi) * F.tan(decl)
    half = 4 * F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_ha))))
    noon = 720 - 4 * lon - eqt + offset_minutes
    whole = lambda x: F.bround(x).cast("int")
    return whole(noon - half), whole(noon + half)


@frame("""
WITH t AS (SELECT DISTINCT ts::DATE AS day, 2 * pi() * (dayofyear(ts) - 1) / 365 AS g FROM events),
s AS (SELECT day, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eqt, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS d FROM t),
h AS (SELECT day, eqt, degrees(acos(cos(radians(90.833)) / (cos(radians(28.6)) * cos(d)) - tan(radians(28.6)) * tan(d))) AS ha FROM s)
SELECT day, round_even(720 - 4 * (77.2 + ha) - eqt + 330, 0)::INT AS rise, round_even(720 - 4 * (77.2 - ha) - eqt + 330, 0)::INT AS sets FROM h""")
def sun_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sunrise and sunset of event days at 28.6° N 77.2° E, five and a half hours ahead."""
    rise, sets = sun(F.col("day"), 28.6, 77.2, 330)
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct().select("day", rise.alias("rise"), sets.alias("sets"))


def sub_pieces(units: DataFrame, seed: str, least: int = 40, most: int = 120) -> DataFrame:
    """(unit, first, n, text) of the third of the units (unit, text, which are in hash order by the seed): runs of one to three
    whole sentences of 40 to 120 words, in order and apart: each begins after the last."""
    from .sentences import sentences, squeezed

    key = F.sha2(F.concat_ws("|", F.lit(seed), F.col("unit").cast("string")), 256)
    # the first third in hash order, by how many there are up to each first byte; no row is ranked against all
    ranked = units.withColumn("k", key).withColumn("b", F.substring("k", 1, 3))
    sums = ranked.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 4,096 rows at most
    total = F.sum("n").over(Window.partitionBy())
    place = ranked.join(F.broadcast(sums.withColumn("total", total)), "b").withColumn("rn", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("k", "unit")))
    third = place.where(F.col("rn") <= F.ceil(F.col("total") / 3)).select("unit", sentences(squeezed(F.col("text"))).alias("s"))
    counts = F.transform("s", lambda x: F.size(F.split(x, " ")))

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for unit, n in zip(pdf["unit"], pdf["n"], strict=True):
                at = 0
                while at < len(n):
                    fits = [k for k in (1, 2, 3) if at + k <= len(n) and least <= sum(n[at : at + k]) <= most]
                    if fits:
                        rows.append((unit, at, fits[0]))
                    at += fits[0] if fits else 1
            yield pd.DataFrame(rows, columns=["unit", "first", "n"])

    found = third.select("unit", counts.alias("n")).mapInPandas(fold, f"unit {units.schema['unit'].dataType.simpleString()}, first int, n int")
    return found.join(third, "unit").select("unit", "first", "n", F.array_join(F.slice("s", F.col("first") + 1, F.col("n")), " ").alias("text"))


@frame()
def short_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short pieces of a third of the documents."""
    found = sub_pieces(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit"), "text"), "seed")
    return found.select(F.col("unit").alias("doc_id"), "first", "n", F.size(F.split("text", " ")).alias("words"))


def row_score(thought: Column, seen: Column, names: Column, earlier: Column, warnings: Column, generic: Sequence[str] = ("it seems", "the spirit"), least: int = 20, most: int = 60) -> Column:
    """How much a row is worth as an example, to two decimals: its length, words and names it shares with what was seen, less
    generic phrases, warnings, and an opening that an earlier text (array) has."""
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(r"[a-z0-9']+"), F.lit(0))
    told = lambda t: F.array_except(F.array_distinct(words(t)), F.array(*map(F.lit, STOPWORDS)))
    n = F.size(F.regexp_extract_all(thought, F.lit(r"\S+"), F.lit(0)))
    off = F.when(n < least, least - n).otherwise(F.greatest(F.lit(0), n - most))
    length = 2.0 - F.least(F.lit(2.0), off / 20)
    shared = 0.5 * F.least(F.lit(6), F.size(F.array_intersect(told(thought), told(seen))))
    named = 0.5 * F.least(F.lit(3), F.size(F.array_intersect(names, F.array_distinct(words(thought)))))
    stale = F.least(F.lit(3.0), 0.75 * sum((F.contains(F.lower(thought), F.lit(g)).cast("int") for g in generic), F.lit(0)))
    first = lambda t: F.array_join(F.slice(words(t), 1, 3), " ")
    opening = F.when(F.exists(earlier, lambda e: first(e) == first(thought)), 1.5).otherwise(0.0)
    return F.round(length + shared + named - stale - 0.5 * warnings - opening, 2)


@frame(f"""
WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), q AS (SELECT * FROM p WHERE before IS NOT NULL),
w AS (SELECT *, len(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\v]+')) AS n, regexp_extract_all(lower(text), '[a-z0-9'']+') AS a, regexp_extract_all(lower(before), '[a-z0-9'']+') AS b FROM q),
s AS (SELECT *, list_filter(list_distinct(a), lambda x: x NOT IN ({STOP_SQL})) AS ta, list_filter(list_distinct(b), lambda x: x NOT IN ({STOP_SQL})) AS tb FROM w)
SELECT conv_id, turn, round(2.0 - least(2.0, (CASE WHEN n < 20 THEN 20 - n ELSE greatest(0, n - 60) END) / 20) + 0.5 * least(6, len(list_intersect(ta, tb))) + 0.5 * least(3, len(list_intersect(['the', 'of'], list_distinct(a)))) - 0.5 * (turn % 2) - CASE WHEN a[1:3] = b[1:3] THEN 1.5 ELSE 0 END, 2) AS score FROM s""")
def training_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns scored against the turn before."""
    turns = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return turns.select("conv_id", "turn", row_score(F.col("text"), F.col("before"), F.array(F.lit("the"), F.lit("of")), F.array("before"), F.col("turn") % 2).alias("score"))


def rendered(kind: Column, time: Column, who: Column, text: Column, amount: Column) -> Column:
    """An entry as a line, by its kind; null for kinds that are not shown."""
    money = F.concat(F.lit("₹"), F.format_number(amount, 0))
    line = F.when(kind == "said", F.concat(who, F.lit(": “"), text, F.lit("”"))).when(kind == "expense", F.concat(F.lit("paid "), money, F.lit(" for "), text)).when(kind == "income", F.concat(F.lit("got "), money, F.lit(" from "), who)).when(kind == "world", text)
    return F.concat(time, F.lit(" "), line)


@frame("""
WITH e AS (SELECT event_id, event_type, strftime(ts, '%H:%M') AS t, 'user ' || user_id AS who, props, value FROM events)
SELECT event_id, CASE event_type WHEN 'click' THEN t || ' ' || who || ': “' || props || '”' WHEN 'purchase' THEN t || ' paid ₹' || format('{:,}', round_even(value, 0)::INT) || ' for ' || props WHEN 'signup' THEN t || ' got ₹' || format('{:,}', round_even(value, 0)::INT) || ' from ' || who WHEN 'error' THEN t || ' ' || props END AS line FROM e""")
def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a day."""
    kind = F.when(F.col("event_type") == "click", "said").when(F.col("event_type") == "purchase", "expense").when(F.col("event_type") == "signup", "income").when(F.col("event_type") == "error", "world")
    return table(spark, sf_dir, "events").select("event_id", rendered(kind, F.date_format("ts", "HH:mm"), F.concat(F.lit("user "), F.col("user_id").cast("string")), F.col("props"), F.col("value")).alias("line"))


def by_group(rows: DataFrame, by: str, value: str, metric: Callable[[pd.Series], float]) -> DataFrame:
    """(by, value): a caller's metric over each group's values, which one task holds: for groups of bounded size."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [pdf[by].iloc[0]], "value": [float(metric(pdf[value]))]})

    return rows.select(by, value).groupBy(by).applyInPandas(one, f"`{by}` {rows.schema[by].dataType.simpleString()}, value double")


def first_passing(rows: DataFrame, key: str, draw: Callable[[object, int], object], check: Callable[[object], bool], most: int, kind: str) -> DataFrame:
    """(key, drawn, calls): draws for each row until one passes the check, ``most`` times at most; null if none does. Draws are
    functions of the row's key and the attempt, so that a task that runs again draws the same."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for k in pdf[key]:
                tried = 0
                found = None
                while found is None and tried < most:
                    x = draw(k, tried)
                    tried += 1
                    found = x if check(x) else None
                out.append((k, found, tried))
            yield pd.DataFrame(out, columns=[key, "drawn", "calls"])

    return rows.select(key).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, drawn {kind}, calls int")


def mapped(rows: DataFrame, column: str, work: Callable[[object], object], kind: str, at_once: int = 8) -> DataFrame:
    """``rows`` with ``result``: a caller's slow function of a column, ``at_once`` calls in flight in each task, in the order of
    the rows; the first that raises fails the task."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in it:
                pdf["result"] = list(pool.map(work, pdf[column]))
                yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", result {kind}"
    return rows.mapInPandas(run, schema)


def by_rules(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """``docs`` (source, text, ...) with each source's own rules (source, no, pattern, put) applied to the text in order.
    Sources without rules are left as they are."""
    own = rules.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("no", "pattern", "put"))).alias("__rules"))
    found = docs.join(F.broadcast(own), "source", "left")  # a table that a user wrote
    text = F.aggregate("__rules", F.col("text"), lambda t, r: F.call_function("regexp_replace", t, r["pattern"], r["put"]))
    return found.withColumn("text", F.when(F.col("__rules").isNotNull(), text).otherwise(F.col("text"))).drop("__rules")


@frame("""
WITH d AS (SELECT doc_id, source, CASE source WHEN 'src0' THEN replace(regexp_replace(text, '[0-9]', '', 'g'), 'e', 'E') WHEN 'src1' THEN regexp_replace(text, '\\n.*$', '', 's') ELSE text END AS text FROM documents)
SELECT doc_id, sha256(text) AS sha FROM d""")
def source_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two sources' own rules applied."""
    rules = spark.createDataFrame([("src0", 1, "[0-9]", ""), ("src0", 2, "e", "E"), ("src1", 1, r"(?s)\n.*", "")], "source string, no int, pattern string, put string")
    return by_rules(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), rules).select("doc_id", F.sha2("text", 256).alias("sha"))


@frame("""
SELECT o_custkey, round(var_pop(o_totalprice) / avg(o_totalprice), 2) AS value FROM orders GROUP BY o_custkey""")
def metric_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's metric of each customer's prices: their variance over their mean."""
    return by_group(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", lambda x: x.var(ddof=0) / x.mean()).select("o_custkey", F.round("value", 2).alias("value"))


@frame("""
WITH d AS (SELECT n_nationkey, i, n_nationkey * 7 + i * 13 AS x FROM nation, (SELECT unnest(range(5)) AS i) r), f AS (SELECT n_nationkey, min(i) FILTER (WHERE x % 5 = 0) AS i FROM d GROUP BY n_nationkey)
SELECT n_nationkey, CASE WHEN i IS NOT NULL THEN n_nationkey * 7 + i * 13 END::BIGINT AS drawn, (coalesce(i, 4) + 1)::INT AS calls FROM f""")
def drawn_until_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws until one is divisible by five."""
    return first_passing(table(spark, sf_dir, "nation"), "n_nationkey", lambda k, i: int(k) * 7 + i * 13, lambda x: x % 5 == 0, 5, "long")


@frame("SELECT n_nationkey, length(n_name) * 2 AS result FROM nation")
def mapped_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of nations' names, called a few at a time."""
    return mapped(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name", lambda x: 2 * len(x), "long").select("n_nationkey", "result")
