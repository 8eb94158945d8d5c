"""Picks among candidates: policies and what they cost, pairs with checks, best of several, first eligible with reasons, gates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dialect import frame
from ..plans.ordering import running
from .corpus import table
from .rules import found_errors


def policies(candidates: DataFrame) -> DataFrame:
    """One row for each of five policies over candidates (case, idx, value, usable, fresh): the first; the first usable; the
    first fresh and usable (else the first usable, else the first); the best usable; the last. With the mean value of
    what is picked, and mean calls: the first policies stop at what they pick, the best and the last draw all."""
    w = Window.partitionBy("case")
    first = lambda c: F.min(F.when(c, F.col("idx"))).over(w)
    each = candidates.withColumns({"n": F.count(F.lit(1)).over(w), "one": F.min("idx").over(w), "ok": first(F.col("usable")), "hit": first(F.col("usable") & F.col("fresh")), "last": F.max("idx").over(w)})
    each = each.withColumn("top", F.max(F.when(F.col("usable"), F.struct("value", -F.col("idx")))).over(w))
    best = F.coalesce(-F.col("top.col2"), F.col("one"))
    picks = {"first": (F.col("one"), F.lit(1)), "usable": (F.coalesce("ok", "one"), F.coalesce("ok", "n")), "fresh": (F.coalesce("hit", "ok", "one"), F.coalesce("hit", "n")), "best": (best, F.col("n")), "last": (F.col("last"), F.col("n"))}
    rows = F.array(*[F.struct(F.lit(k).alias("policy"), p.alias("pick"), c.cast("double").alias("calls")) for k, (p, c) in picks.items()])
    chosen = each.select("idx", "value", F.explode(rows).alias("p")).where("idx = p.pick")
    return chosen.groupBy("p.policy").agg(F.count(F.lit(1)).alias("cases"), F.avg("value").alias("value"), F.avg("p.calls").alias("calls"))


@frame("""
WITH s AS (SELECT user_id, ts::DATE AS day, value, event_type <> 'error' AS usable, event_type = 'click' AS fresh, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS idx FROM events),
c AS (SELECT user_id, day, count(*) AS n, min(idx) FILTER (WHERE usable) AS ok, min(idx) FILTER (WHERE usable AND fresh) AS hit, arg_max(idx, (value, -idx)) FILTER (WHERE usable) AS best FROM s GROUP BY user_id, day),
p AS (SELECT user_id, day, 'first' AS policy, 1 AS pick, 1 AS calls FROM c UNION ALL SELECT user_id, day, 'usable', coalesce(ok, 1), coalesce(ok, n) FROM c UNION ALL SELECT user_id, day, 'fresh', coalesce(hit, ok, 1), coalesce(hit, n) FROM c UNION ALL SELECT user_id, day, 'best', coalesce(best, 1), n FROM c UNION ALL SELECT user_id, day, 'last', n, n FROM c)
SELECT policy, count(*) AS cases, round(avg(value), 6) AS value, round(avg(calls), 6) AS calls FROM p JOIN s ON p.user_id = s.user_id AND p.day = s.day AND p.pick = s.idx GROUP BY policy""")
def selection_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user's day as candidates."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    idx = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    found = policies(e.select(F.struct("user_id", "day").alias("case"), idx.alias("idx"), "value", (F.col("event_type") != "error").alias("usable"), (F.col("event_type") == "click").alias("fresh")))
    return found.select("policy", "cases", F.round("value", 6).alias("value"), F.round("calls", 6).alias("calls"))


def candidate_errors(rows: DataFrame) -> DataFrame:
    """(case, id, errors) of candidates (case, id, seed, text, accepted, errors) that can't be what they say: accepted with
    errors or refused without, a seed drawn twice in a case, an id that is there twice, no text."""
    seeds = rows.groupBy("case", "seed").agg(F.count(F.lit(1)).alias("__s"))
    ids = rows.groupBy("id").agg(F.count(F.lit(1)).alias("__i"))
    why = found_errors([("accepted with errors", F.col("accepted") & (F.size("errors") > 0)), ("refused without errors", ~F.col("accepted") & (F.size("errors") == 0)), ("repeated seed", F.col("__s") > 1), ("repeated id", F.col("__i") > 1), ("no text", F.trim(F.coalesce("text", F.lit(""))) == "")])
    return rows.join(seeds, ["case", "seed"]).join(ids, "id").select("case", "id", why.alias("errors")).where("size(errors) > 0")


@frame("""
WITH c AS (SELECT doc_id, source, doc_id % 9 AS seed, trim(text) = '' AS bare, quality = 1 AS accepted, toxic = 1 AS err FROM documents JOIN labels USING (doc_id)), s AS (SELECT source, seed, count(*) AS n FROM c GROUP BY source, seed)
SELECT array_to_string(list_filter([CASE WHEN accepted AND err THEN 'accepted with errors' END, CASE WHEN NOT accepted AND NOT err THEN 'refused without errors' END, CASE WHEN n > 1 THEN 'repeated seed' END, CASE WHEN bare THEN 'no text' END], lambda x: x IS NOT NULL), '; ') AS errors, count(*) AS n FROM c JOIN s USING (source, seed) WHERE (accepted AND err) OR (NOT accepted AND NOT err) OR n > 1 OR bare GROUP BY 1""")
def checked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as candidates of their source."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    errors = F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>"))
    found = candidate_errors(rows.select(F.col("source").alias("case"), F.col("doc_id").alias("id"), (F.col("doc_id") % 9).alias("seed"), "text", (F.col("quality") == 1).alias("accepted"), errors.alias("errors")))
    return found.groupBy(F.array_join("errors", "; ").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


def length_matched(rows: DataFrame, ratio: float, first_only: bool = True) -> DataFrame:
    """(case, chosen, rejected) of rows (case, id, ord, size, good): good rows with bad ones of a like size (the lesser at least
    ``ratio`` of the greater); the first good one that has any, with the first of these, or all pairs. Rows ask for each
    other by classes of size a ratio wide, so that a row is compared with what may fit only; sizes are above zero."""
    kind = F.floor(F.log(F.col("size")) / F.lit(-math.log(ratio))).cast("int")
    placed = rows.where("size > 0").withColumn("c", kind)
    good = placed.where("good").select("case", F.col("id").alias("chosen"), F.col("ord").alias("o1"), F.col("size").alias("n1"), F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"))
    bad = placed.where("not good").select("case", F.col("id").alias("rejected"), F.col("ord").alias("o2"), F.col("size").alias("n2"), "c")
    found = good.join(bad, ["case", "c"]).where(F.least("n1", "n2") >= ratio * F.greatest("n1", "n2"))
    if not first_only:
        return found.select("case", "chosen", "rejected")
    return found.groupBy("case").agg(F.min(F.struct("o1", "o2", "chosen", "rejected")).alias("b")).select("case", "b.chosen", "b.rejected")


PAIR_SQL = "c AS (SELECT t.doc_id, t.source, t.lang, l.quality, length(t.text) AS n, sha256('pair:' || t.doc_id) AS seed FROM documents t JOIN labels l ON t.doc_id = l.doc_id)"


def labelled(spark: SparkSession, sf_dir: str, case: Sequence[str]) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(F.struct(*case).alias("case"), F.col("doc_id").alias("id"), F.sha2(F.concat_ws(":", F.lit("pair"), F.col("doc_id").cast("string")), 256).alias("ord"), F.length("text").alias("size"), (F.col("quality") == 1).alias("good"))


@frame(f"""
WITH {PAIR_SQL}, p AS (SELECT a.source, a.doc_id AS chosen, b.doc_id AS rejected, row_number() OVER (PARTITION BY a.source ORDER BY a.seed, b.seed) AS rn FROM c a JOIN c b ON a.source = b.source AND a.quality = 1 AND b.quality = 0 WHERE least(a.n, b.n) >= 0.8 * greatest(a.n, b.n))
SELECT source, chosen, rejected FROM p WHERE rn = 1""")
def first_pair_length_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a source, in seeded order: the first good document that a bad one of four fifths of its length goes with, and the first of these."""
    return length_matched(labelled(spark, sf_dir, ["source"]), 0.8).select("case.source", "chosen", "rejected")


@frame(f"""
WITH {PAIR_SQL} SELECT a.source, a.doc_id AS chosen, b.doc_id AS rejected FROM c a JOIN c b ON a.source = b.source AND a.lang = b.lang AND a.quality = 1 AND b.quality = 0 AND least(a.n, b.n) >= 0.9 * greatest(a.n, b.n)""")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a good and a bad document of a source and language whose lengths are within nine tenths."""
    return length_matched(labelled(spark, sf_dir, ["source", "lang"]), 0.9, False).select("case.source", "chosen", "rejected")


def best_of(rows: DataFrame) -> DataFrame:
    """(case, id) of rows (case, id, idx, text, valid, score, errors): of each case's valid texts, each counted once at its
    first place, the highest score, ties to the first; where none is valid, the fewest errors, ties to the first."""
    once = rows.groupBy("case", "text", "valid").agg(F.min_by(F.struct("id", "idx", "score", "errors"), "idx").alias("r")).select("case", "valid", "r.*")
    rank = F.struct((~F.col("valid")).alias("o"), F.when(F.col("valid"), -F.col("score")).otherwise(F.col("errors").cast("double")).alias("s"), "idx")
    return once.groupBy("case").agg(F.min_by("id", rank).alias("id"))


@frame("""
WITH c AS (SELECT user_id, ts::DATE AS day, event_id, props, event_type <> 'error' AS valid, value, json_extract_string(props, '$.k')::INT AS e, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS idx FROM events),
o AS (SELECT user_id, day, props, valid, min(idx) AS idx FROM c GROUP BY user_id, day, props, valid)
SELECT user_id, day, event_id FROM (SELECT c.*, row_number() OVER (PARTITION BY c.user_id, c.day ORDER BY c.valid DESC, CASE WHEN c.valid THEN -value ELSE e END, c.idx) AS rn FROM c JOIN o ON c.user_id = o.user_id AND c.day = o.day AND c.idx = o.idx) x WHERE rn = 1""")
def best_of_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a user's events on a day, equal payloads once: the highest value that is no error; where all are, the least number."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    idx = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    rows = e.select(F.struct("user_id", "day").alias("case"), F.col("event_id").alias("id"), idx.alias("idx"), F.col("props").alias("text"), (F.col("event_type") != "error").alias("valid"), F.col("value").alias("score"), F.get_json_object("props", "$.k").try_cast("int").alias("errors"))
    return best_of(rows).select("case.user_id", "case.day", F.col("id").alias("event_id"))


def first_eligible_of(rows: DataFrame, key: str, reason: Column, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n rows, in order of the key, that have no reason against them, with their places; and all rows up to the last
    of them that have one, with it. Fewer than n is an error."""
    each = rows.withColumn("reason", reason)
    fit = running(each.where("reason is null").select(key), [key]).where(F.col("place") <= n)
    last = fit.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("last")).first()
    if last["n"] < n:
        raise ValueError(f"only {last['n']} of {n} rows are eligible")
    return fit, each.where(F.col("reason").isNotNull() & (F.col(key) <= F.lit(last["last"]))).select(key, "reason")


@frame("""
WITH r AS (SELECT doc_id, CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) > 4000 THEN 'long' WHEN NOT regexp_matches(text, '[.!?]$') THEN 'ending' END AS reason FROM documents), f AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM r WHERE reason IS NULL)
SELECT doc_id, place::INT AS place, NULL::VARCHAR AS reason FROM f WHERE place <= 40 UNION ALL SELECT doc_id, NULL, reason FROM r WHERE reason IS NOT NULL AND doc_id <= (SELECT doc_id FROM f WHERE place = 40)""")
def first_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty documents, in order, that are of fair length and end a sentence, and why those between are not."""
    why = F.when(F.length("text") < 500, "short").when(F.length("text") > 4000, "long").when(~F.col("text").rlike(r"[.!?]\z"), "ending")
    fit, others = first_eligible_of(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", why, 40)
    return fit.select("doc_id", F.col("place").cast("int").alias("place"), F.lit(None).cast("string").alias("reason")).unionByName(others.select("doc_id", F.lit(None).cast("int").alias("place"), "reason"))


def gate(rows: DataFrame, most_failed: float = 0.1, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """One row: the share of rows (failed, pending, plain, original) that failed, the mean ratio of words, rows that wait, and
    whether the gate is passed."""
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("failed").cast("int")).alias("failed"), F.avg(F.when(~F.col("failed") & ~F.col("pending"), words(F.col("plain")) / F.nullif(words(F.col("original")), F.lit(0)))).alias("ratio"), F.count_if("pending").alias("pending"))
    return found.withColumn("pass", F.coalesce((F.col("failed") < most_failed) & F.col("ratio").between(low, high) & (F.col("pending") == 0), F.lit(False)))


@frame("""
WITH p AS (SELECT text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, turn FROM conversations), q AS (SELECT *, length(text) > 900 AS failed, trim(text) = '' AS pending, len(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\v]+')) AS a, len(regexp_extract_all(before, '[^ \\t\\r\\n\\f\\v]+')) AS b FROM p WHERE before IS NOT NULL)
SELECT count(*) AS n, round(avg(failed::INT), 6) AS failed, round(avg(CASE WHEN NOT failed AND NOT pending THEN a / nullif(b, 0) END), 6) AS ratio, count(*) FILTER (WHERE pending) AS pending, coalesce(avg(failed::INT) < 0.1 AND avg(CASE WHEN NOT failed AND NOT pending THEN a / nullif(b, 0) END) BETWEEN 0.8 AND 1.2 AND count(*) FILTER (WHERE pending) = 0, false) AS pass FROM q""")
def corpus_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as versions of the turn before."""
    rows = table(spark, sf_dir, "conversations").select("text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before")).where("before is not null")
    found = gate(rows.select((F.length("text") > 900).alias("failed"), (F.trim("text") == "").alias("pending"), F.col("text").alias("plain"), F.col("before").alias("original")))
    return found.select("n", F.round("failed", 6).alias("failed"), F.round("ratio", 6).alias("ratio"), "pending", "pass")


def joint_marks(rows: DataFrame, by: Sequence[str], notion: str) -> DataFrame:
    """By groups and with a row for all, of rows (by, first, second, text): defects that both readers mark, that either marks,
    and a notion's uses per hundred words."""
    words, hits = F.size(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0))), F.size(F.regexp_extract_all("text", F.lit(notion), F.lit(0)))
    each = rows.withColumns({"__w": words, "__h": hits})
    return each.rollup(*by).agg(F.count(F.lit(1)).alias("rated"), F.count_if(F.col("first") & F.col("second")).alias("joint"), F.count_if("first").alias("first"), F.count_if("second").alias("second"), (100 * F.sum("__h") / F.greatest(F.sum("__w"), F.lit(1))).alias("per_100"))


@frame("""
WITH r AS (SELECT lang, source, quality = 0 AS a, toxic = 1 AS b, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w, len(regexp_extract_all(text, 'the')) AS h FROM labels JOIN documents USING (doc_id))
SELECT lang, source, count(*) AS rated, count(*) FILTER (WHERE a AND b) AS joint, count(*) FILTER (WHERE a) AS first, count(*) FILTER (WHERE b) AS second, round(100.0 * sum(h) / greatest(sum(w), 1), 6) AS per_100 FROM r GROUP BY ROLLUP (lang, source)""")
def joint_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters' marks by language and source."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("lang", "source", (F.col("quality") == 0).alias("first"), (F.col("toxic") == 1).alias("second"), "text")
    return joint_marks(rows, ["lang", "source"], "the").withColumn("per_100", F.round("per_100", 6))
