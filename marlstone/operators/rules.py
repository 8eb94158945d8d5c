"""Rules on rows: checks that give lists of errors, calendars, eligibility, labels, screens, matching of variants, pools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, folded
from ..plans.dialect import frame
from .corpus import NEEDLES, benchmark_runs, table
from .money import WEEKDAYS, event_k


def found_errors(rules: Sequence[tuple[str | Column, Column]]) -> Column:
    """The messages of the rules (message, wrong) that are wrong, in order; a rule that can't be decided is not."""
    return F.filter(F.array(*[F.when(wrong, F.lit(m) if isinstance(m, str) else m) for m, wrong in rules]), lambda x: x.isNotNull())


def answer_errors(answer: Column, actions: Column, places: Column, required: Sequence[str] = ("thought", "action", "place", "minutes")) -> tuple[Column, Column]:
    """Errors and warnings of an answer, a JSON object of thought, action, place, minutes and buys, given the allowed actions
    and places of its row: not an object, missing fields (these end the list), then values out of what is allowed."""
    got = {k: F.get_json_object(answer, f"$.{k}") for k in ("thought", "action", "place", "minutes", "says")}
    minutes = got["minutes"].try_cast("int")
    buys = F.from_json(F.get_json_object(answer, "$.buys"), "array<struct<item:string,price:int>>")
    missing = found_errors([(f"missing '{k}'", F.get_json_object(answer, f"$.{k}").isNull()) for k in required])
    malformed = F.exists(buys, lambda b: b["item"].isNull() | b["price"].isNull() | (b["price"] < 0))
    values = found_errors([
        ("unknown action", ~F.array_contains(actions, got["action"])), ("unknown place", ~F.array_contains(places, got["place"])), ("minutes out of range", minutes.isNull() | ~minutes.between(5, 240)),
        ("buys is malformed", F.get_json_object(answer, "$.buys").isNotNull() & (buys.isNull() | malformed)), ("thought is empty or too short", F.length(F.trim(got["thought"])) < 20),
    ])
    errors = F.when(answer.isNull() | ~F.coalesce(answer.rlike(r"(?s)^\s*\{.*\}\s*$"), F.lit(False)), F.array(F.lit("not an object"))).when(F.size(missing) > 0, missing).otherwise(values)
    return errors, found_errors([("thought is very long", F.length(got["thought"]) > 700)])


def answers_of(events: DataFrame) -> DataFrame:
    """Events told as answers: the kind is the action, the payload's number picks the place and what is wrong."""
    k = event_k()
    text = F.when(k % 11 == 0, F.lit("no object")).otherwise(
        F.concat(F.lit('{"thought":"'), F.repeat(F.lit("thinking "), F.pmod(k, F.lit(5))), F.lit('","action":"'), "event_type", F.lit('","place":"p'), (k % 4).cast("string"), F.lit('"'), F.when(k % 7 != 0, F.concat(F.lit(',"minutes":'), (k * 4).cast("string"))).otherwise(""), F.lit(',"buys":[{"item":"tea","price":'), F.when(k % 13 == 0, "-1").otherwise("10"), F.lit("}]}"))
    )
    return events.select("event_id", "user_id", "ts", "event_type", "value", k.alias("k"), text.alias("answer"))


@frame("""
WITH a AS (SELECT event_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events),
e AS (SELECT event_type, CASE WHEN k % 11 = 0 THEN ['not an object'] WHEN k % 7 = 0 THEN ['missing ''minutes'''] ELSE list_filter([CASE WHEN event_type = 'error' THEN 'unknown action' END, CASE WHEN k % 4 = 3 THEN 'unknown place' END, CASE WHEN k * 4 NOT BETWEEN 5 AND 240 THEN 'minutes out of range' END, CASE WHEN k % 13 = 0 THEN 'buys is malformed' END, CASE WHEN k % 5 * 9 - 1 < 20 THEN 'thought is empty or too short' END], lambda x: x IS NOT NULL) END AS errors FROM a)
SELECT event_type, array_to_string(errors, '; ') AS errors, count(*) AS n FROM e GROUP BY event_type, array_to_string(errors, '; ')""")
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of events told as answers, by kind."""
    rows = answers_of(table(spark, sf_dir, "events"))
    text = lambda *x: F.array(*map(F.lit, x))
    errors, _ = answer_errors(F.col("answer"), text("click", "view", "purchase", "signup"), text("p0", "p1", "p2"))
    return rows.select("event_type", F.array_join(errors, "; ").alias("errors")).groupBy("event_type", "errors").agg(F.count(F.lit(1)).alias("n"))


def widened(base: Sequence[str], more: Column, wanted: Column) -> Column:
    """The places a row allows: the base, and its own more where its situation asks for them."""
    own = F.array(*map(F.lit, base))
    return F.when(wanted & more.isNotNull(), F.array_union(own, more)).otherwise(own)


@frame("""
SELECT user_id % 2 = 0 AS wide, count(*) AS answers, count(*) FILTER (WHERE k % 4 = 3 AND user_id % 2 = 1) AS unknown FROM (SELECT user_id, json_extract_string(props, '$.k')::INT AS k FROM events) x WHERE k % 11 <> 0 AND k % 7 <> 0 GROUP BY user_id % 2 = 0""")
def widened_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers checked against a list of places that is wider for every second user."""
    rows = answers_of(table(spark, sf_dir, "events")).where("k % 11 <> 0 AND k % 7 <> 0").withColumn("wide", F.col("user_id") % 2 == 0)
    places = widened(("p0", "p1", "p2"), F.array(F.lit("p3")), F.col("wide"))
    errors, _ = answer_errors(F.col("answer"), F.array(F.col("event_type")), places)
    return rows.groupBy("wide").agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.array_contains(errors, "unknown place")).alias("unknown"))


def days_of(spec: str) -> list[int]:
    """Weekdays from 0 (Monday) of 'daily', 'Mon-Fri', 'Fri-Mon' (over the week's end) or 'Tue,Thu', in any mixture."""
    out = set()
    for part in map(str.strip, spec.split(",")):
        first, _, last = ("Mon-Sun" if part == "daily" else part).partition("-")
        a, b = WEEKDAYS.index(first), WEEKDAYS.index(last or first)
        out |= {(a + i) % 7 for i in range((b - a) % 7 + 1)}
    return sorted(out)


def days_match(day: Column, spec: str) -> Column:
    return F.weekday(day).isin(days_of(spec))


SPECS = {"daily": "daily", "week": "Mon-Fri", "over": "Fri-Mon", "two": "Tue,Thu", "mixed": "Sat-Sun, Wed"}


@frame("""
WITH d AS (SELECT DISTINCT ts::DATE AS day, isodow(ts) AS w FROM events), s(spec, days) AS (VALUES ('daily', [1,2,3,4,5,6,7]), ('week', [1,2,3,4,5]), ('over', [5,6,7,1]), ('two', [2,4]), ('mixed', [6,7,3]))
SELECT day, spec FROM d, s WHERE list_contains(days, w)""")
def calendar_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event days that specifications of weekdays name."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    named = found_errors([(k, days_match(F.col("day"), v)) for k, v in SPECS.items()])
    return days.select("day", F.explode(named).alias("spec"))


def is_open(at: Column, hours: Sequence[tuple[str, int, int]], margin: int = 0, closed: Sequence[str] = (), sun: tuple[Column, Column] | None = None) -> Column:
    """Whether a place is open at a time, for ``margin`` minutes more: ``hours`` are (days, from, to) in minutes of the day,
    ``closed`` dates it is closed on; with ``sun`` (rise, set) it is open between them only."""
    minute, day = F.hour(at) * 60 + F.minute(at), F.to_date(at)
    out = F.lit(False)
    for spec, a, b in hours:
        out = out | (days_match(day, spec) & (minute >= a) & (minute + margin < b))
    if closed:
        out = out & ~day.isin(*[F.lit(x).cast("date") for x in closed])
    return out & minute.between(*sun) if sun else out


@frame("""
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE ts::DATE <> DATE '2024-01-26' AND ((isodow(ts) <= 5 AND hour(ts) * 60 + minute(ts) >= 540 AND hour(ts) * 60 + minute(ts) + 10 < 1020) OR (isodow(ts) = 6 AND hour(ts) * 60 + minute(ts) >= 540 AND hour(ts) * 60 + minute(ts) + 10 < 780))) AS open FROM events GROUP BY event_type""")
def opening_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside hours: weekdays from nine to five with ten minutes to spare, Saturdays till one, never on a holiday."""
    fine = is_open(F.col("ts"), [("Mon-Fri", 540, 1020), ("Sat", 540, 780)], 10, ["2024-01-26"])
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(fine).alias("open"))


def action_errors(hours: dict[str, Sequence[tuple[str, int, int]]], dry: Sequence[str], place: Column, at: Column, spent: Column, cash: Column, drinks: Column, repeats: Column, unmet: Column) -> Column:
    """What speaks against an action: its place is unknown or closed on arrival, it costs more than there is, it buys drink
    on a dry day, it repeats the one before, or it names what was not met yet."""
    opened = F.lit(None).cast("boolean")
    for name, spec in hours.items():
        opened = F.when(place == name, is_open(at, spec)).otherwise(opened)
    return found_errors([
        ("unknown place", opened.isNull()), ("closed", ~opened), ("not enough cash", spent > cash), ("dry day", drinks & F.to_date(at).isin(*[F.lit(x).cast("date") for x in dry])), ("repeats itself", repeats), ("not met yet", F.size(unmet) > 0),
    ])


@frame("""
WITH e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k, hour(ts) * 60 + minute(ts) AS m, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events),
x AS (SELECT e.*, list_filter([CASE WHEN k % 4 = 3 THEN 'unknown place' END, CASE WHEN (k % 4 = 0 AND NOT (isodow(ts) <= 5 AND m BETWEEN 540 AND 1019)) OR (k % 4 = 1 AND NOT m BETWEEN 600 AND 1259) THEN 'closed' END, CASE WHEN event_type = 'purchase' AND value > greatest(c_acctbal, 0) / 50 THEN 'not enough cash' END, CASE WHEN event_type = 'purchase' AND ts::DATE IN (DATE '2024-01-26', DATE '2024-01-30') THEN 'dry day' END, CASE WHEN event_type = was AND event_type <> 'view' THEN 'repeats itself' END], lambda y: y IS NOT NULL) AS errors FROM e JOIN customer c ON c_custkey = user_id + 1)
SELECT array_to_string(errors, '; ') AS errors, count(*) AS n FROM x GROUP BY array_to_string(errors, '; ')""")
def action_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions at four places, one of them unknown, with cash from a customer's balance."""
    e = table(spark, sf_dir, "events").withColumn("k", event_k()).withColumn("was", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    rows = e.join(table(spark, sf_dir, "customer").select((F.col("c_custkey") - 1).alias("user_id"), "c_acctbal"), "user_id")
    hours = {"p0": [("Mon-Fri", 540, 1020)], "p1": [("daily", 600, 1260)], "p2": [("daily", 0, 1441)]}
    buys = F.col("event_type") == "purchase"
    repeats = (F.col("event_type") == F.col("was")) & (F.col("event_type") != "view")
    errors = action_errors(hours, ["2024-01-26", "2024-01-30"], F.concat(F.lit("p"), (F.col("k") % 4).cast("string")), F.col("ts"), F.when(buys, F.col("value")), F.greatest("c_acctbal", F.lit(0.0)) / 50, buys, repeats, F.array())
    return rows.select(F.array_join(errors, "; ").alias("errors")).groupBy("errors").agg(F.count(F.lit(1)).alias("n"))


def eligible(offers: DataFrame, state: DataFrame) -> DataFrame:
    """(key, at, offer) of the moments in ``state`` (key, at, place, people, fired, missed, refused: map of offer to date) at
    which an offer (offer, from_day, again_days, after, if_missed, window_from, window_to, place, needs) may come: not fired
    or missed, not before its day, some days after a refusal, after what it needs to have fired or been missed, inside
    its window, at its place, and with the people it needs. Null conditions ask for nothing."""
    both = state.join(F.broadcast(offers.withColumnRenamed("place", "wanted")))  # offers are a table that a user wrote
    day, minute, back = F.to_date("at"), F.hour("at") * 60 + F.minute("at"), F.try_element_at("refused", F.col("offer"))
    asked = lambda c, holds: F.col(c).isNull() | holds
    fine = ~F.array_contains("fired", F.col("offer")) & ~F.array_contains("missed", F.col("offer")) & asked("from_day", day >= F.col("from_day")) & (back.isNull() | (F.date_diff(day, back) >= F.coalesce("again_days", F.lit(0))))
    fine = fine & asked("after", F.size(F.array_except("after", "fired")) == 0) & asked("if_missed", F.array_contains("missed", F.col("if_missed"))) & asked("window_from", (minute >= F.col("window_from")) & (minute < F.col("window_to")))
    fine = fine & asked("wanted", F.col("wanted") == F.col("place")) & asked("needs", F.size(F.array_except("needs", "people")) == 0)
    return both.where(fine).select("key", "at", "offer")


OFFER = "offer string, from_day date, again_days int, after array<string>, if_missed string, window_from int, window_to int, place string, needs array<string>"


@frame("""
WITH s AS (SELECT event_id, ts, json_extract_string(props, '$.k')::INT AS k, event_type, user_id FROM events),
x AS (SELECT *, CASE WHEN k % 3 = 0 THEN ['a'] WHEN k % 3 = 1 THEN ['a', 'b'] ELSE [] END AS fired, CASE WHEN k % 5 = 0 THEN ['c'] ELSE [] END AS missed FROM s)
SELECT event_id, 'a' AS offer FROM x WHERE NOT list_contains(fired, 'a') AND ts::DATE >= DATE '2024-01-10'
UNION ALL SELECT event_id, 'b' FROM x WHERE NOT list_contains(fired, 'b') AND list_contains(fired, 'a') AND event_type = 'click' AND NOT (k % 2 = 0 AND date_diff('day', DATE '2024-01-15', ts::DATE) < 7)
UNION ALL SELECT event_id, 'd' FROM x WHERE list_contains(missed, 'c') AND hour(ts) BETWEEN 9 AND 11 AND user_id % 2 = 0""")
def eligible_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers at the moments of events."""
    k, text = event_k(), lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    state = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("at"), F.col("event_type").alias("place"), F.when(F.col("user_id") % 2 == 0, text("even")).otherwise(text()).alias("people"), F.when(k % 3 == 0, text("a")).when(k % 3 == 1, text("a", "b")).otherwise(text()).alias("fired"), F.when(k % 5 == 0, text("c")).otherwise(text()).alias("missed"), F.when(k % 2 == 0, F.create_map(F.lit("b"), F.lit("2024-01-15").cast("date"))).otherwise(F.create_map().cast("map<string,date>")).alias("refused"))
    import datetime

    offers = spark.createDataFrame([("a", datetime.date(2024, 1, 10), None, None, None, None, None, None, None), ("b", None, 7, ["a"], None, None, None, "click", None), ("d", None, None, None, "c", 540, 720, None, ["even"])], OFFER)
    return eligible(offers, state).select(F.col("key").alias("event_id"), "offer")


def cooled(shown: DataFrame, days: int) -> DataFrame:
    """``shown`` (key, card, day) with whether the card may be shown: ``days`` after it came up for the key before, at least."""
    before = F.lag("day").over(Window.partitionBy("key", "card").orderBy("day"))
    return shown.withColumn("fits", before.isNull() | (F.date_diff("day", before) >= days))


@frame("""
WITH c AS (SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events WHERE month(ts) IN (1, 2) AND hour(ts) BETWEEN 8 AND 19 AND isodow(ts) <> 7)
SELECT event_type, count(*) AS shown, count(*) FILTER (WHERE fits) AS fit FROM (SELECT event_type, coalesce(day - lag(day) OVER (PARTITION BY user_id, event_type ORDER BY day) >= 3, true) AS fits FROM c) x GROUP BY event_type""")
def cool_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards (kinds of events) by months, hours and weekdays, three days after they last came up."""
    e = table(spark, sf_dir, "events").where(F.month("ts").isin(1, 2) & F.hour("ts").between(8, 19) & days_match(F.to_date("ts"), "Mon-Sat"))
    shown = e.select(F.col("user_id").alias("key"), F.col("event_type").alias("card"), F.to_date("ts").alias("day")).distinct()
    return cooled(shown, 3).groupBy(F.col("card").alias("event_type")).agg(F.count(F.lit(1)).alias("shown"), F.count_if("fits").alias("fit"))


def label(accepted: Column, errors: Column, finished: Column, loops: Column, shown: Column) -> Column:
    """What a candidate is, the first that holds: truncated, hidden (nothing is shown), invalid (errors other than refusals),
    refused, loop, clean."""
    refusals = F.filter(errors, lambda x: x.startswith("refused"))
    return F.when(~finished, "truncated").when(F.trim(F.coalesce(shown, F.lit(""))) == "", "hidden").when(F.size(errors) > F.size(refusals), "invalid").when(~accepted | (F.size(refusals) > 0), "refused").when(loops, "loop").otherwise("clean")


@frame("""
WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before FROM conversations),
x AS (SELECT role, CASE WHEN NOT regexp_matches(text, '[.!?]["”’)]?[ \\n]*$') THEN 'truncated' WHEN trim(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) = '' THEN 'hidden' WHEN length(text) > 1000 THEN 'invalid' WHEN turn > 8 THEN 'refused' WHEN before IS NOT NULL AND substr(text, 1, 12) = substr(before, 1, 12) THEN 'loop' ELSE 'clean' END AS label FROM t)
SELECT role, label, count(*) AS n FROM x GROUP BY role, label""")
def candidate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as candidates: what each is."""
    t = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id", "role").orderBy("turn")))
    errors = found_errors([("too long", F.length("text") > 1000), ("refused: late", F.col("turn") > 8)])
    loops = F.coalesce(F.substring("text", 1, 12) == F.substring("before", 1, 12), F.lit(False))
    what = label(F.lit(True), errors, F.col("text").rlike(r'[.!?]["”’)]?[ \n]*\z'), loops, F.regexp_replace("text", "[^A-Za-z0-9]", ""))
    return t.groupBy("role", what.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def variants_met(reply: Column, groups: Sequence[Sequence[str]]) -> Column:
    """How many groups have a variant in the folded reply; a variant of digits must stand alone."""
    text = folded(reply)
    met = [F.lit(0)]
    for group in groups:
        one = F.lit(False)
        for v in group:
            one = one | (text.rlike(rf"(?<![0-9]){v}(?![0-9])") if v.isdigit() else F.contains(text, F.lit(v.lower())))
        met.append(one.cast("int"))
    return sum(met[1:], met[0])


@frame("""
WITH f AS (SELECT doc_id, replace(strip_accents(lower(text)), 'ß', 'ss') AS t FROM documents)
SELECT doc_id, ((contains(t, 'license') OR contains(t, 'copyright'))::INT + regexp_matches(t, '(^|[^0-9])20(24|00)([^0-9]|$)')::INT + (contains(t, 'elle') OR contains(t, 'keit'))::INT)::INT AS met FROM f""")
def accepted_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of variants that documents have."""
    return table(spark, sf_dir, "documents").select("doc_id", variants_met(F.col("text"), [("license", "copyright"), ("2024", "2000"), ("elle", "keit")]).alias("met"))


def families(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The first row of each family of a key: texts that are alike but for digits. Texts with quotes, and stubs, are left out."""
    family = F.regexp_replace(text, r"[0-9]+", "#")
    kept = rows.where(~F.contains(text, F.lit('"')) & (F.length(F.trim(text)) >= 12)).withColumn("family", family)
    return kept.withColumn("__n", F.row_number().over(Window.partitionBy(key, "family").orderBy(order))).where("__n = 1").drop("__n")


@frame("""
SELECT c_mktsegment, min(c_custkey) AS c_custkey, regexp_replace(c_name, '[0-9]+', '#', 'g') AS family FROM customer WHERE length(trim(c_name)) >= 12 GROUP BY c_mktsegment, regexp_replace(c_name, '[0-9]+', '#', 'g')""")
def scene_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customer of each segment and kind of name."""
    return families(table(spark, sf_dir, "customer"), "c_mktsegment", "c_name", "c_custkey").select("c_mktsegment", "c_custkey", "family")


def screened(text: Column, finish: Column, copied: Column, forbidden: str, least: int, most: int) -> Column:
    """Why an output is not used: it did not end by itself, is too short or long, copies a run, or names a request."""
    n = F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))
    return found_errors([("unfinished", finish != "stop"), ("length", ~n.between(least, most)), ("copied", copied), ("request wording", text.rlike(forbidden))])


@frame("""
WITH RECURSIVE b AS (SELECT DISTINCT gram FROM (SELECT unnest(list_transform(range(0, greatest(len(w) - 7, 0)), lambda i: array_to_string(w[i + 1:i + 8], ' '))) AS gram FROM (SELECT regexp_extract_all(replace(strip_accents(lower(text)), 'ß', 'ss'), '[a-z0-9]+') AS w FROM benchmark) x) y),
t AS (SELECT doc_id, text, regexp_extract_all(replace(strip_accents(lower(text)), 'ß', 'ss'), '[a-z0-9]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(list_transform(range(0, greatest(len(w) - 7, 0)), lambda i: array_to_string(w[i + 1:i + 8], ' '))) AS gram FROM t) z WHERE gram IN (SELECT gram FROM b)),
s AS (SELECT list_filter([CASE WHEN NOT regexp_matches(text, '[.!?]$') THEN 'unfinished' END, CASE WHEN len(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\v]+')) NOT BETWEEN 20 AND 400 THEN 'length' END, CASE WHEN g.doc_id IS NOT NULL THEN 'copied' END, CASE WHEN regexp_matches(text, '(?i)license|password') THEN 'request wording' END], lambda x: x IS NOT NULL) AS why FROM t LEFT JOIN g USING (doc_id))
SELECT array_to_string(why, '; ') AS why, count(*) AS n FROM s GROUP BY array_to_string(why, '; ')""")
def output_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as outputs: why they are not used."""
    hit = benchmark_runs(spark, sf_dir, 8, "doc_id").select("doc_id").distinct().withColumn("hit", F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(hit, "doc_id", "left")
    why = screened(F.col("text"), F.when(F.col("text").rlike(r"[.!?]\z"), "stop").otherwise("length"), F.coalesce("hit", F.lit(False)), "(?i)license|password", 20, 400)
    return docs.groupBy(F.array_join(why, "; ").alias("why")).agg(F.count(F.lit(1)).alias("n"))


def control_pool(docs: DataFrame, hit: DataFrame, most: int = 2, least_words: int = 150, most_words: int = 300) -> DataFrame:
    """``docs`` (doc_id, work, text) fit as controls: so many words, an ending, no overlap (``hit``: doc_id), distinct texts,
    and ``most`` of a work in hash order."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    fit = docs.where(n.between(least_words, most_words) & F.col("text").rlike(r'[.!?]["”’)]?\z')).join(hit, "doc_id", "left_anti").withColumn("k", F.sha2("text", 256))
    once = fit.groupBy("k").agg(F.min_by(F.struct("doc_id", "work"), "doc_id").alias("d")).select("k", "d.*")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("work").orderBy("k"))).where(F.col("place") <= most).select("doc_id", "work", "place")


@frame("""
WITH b AS (SELECT DISTINCT gram FROM (SELECT unnest(list_transform(range(0, greatest(len(w) - 7, 0)), lambda i: array_to_string(w[i + 1:i + 8], ' '))) AS gram FROM (SELECT regexp_extract_all(replace(strip_accents(lower(text)), 'ß', 'ss'), '[a-z0-9]+') AS w FROM benchmark) x) y),
g AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(list_transform(range(0, greatest(len(w) - 7, 0)), lambda i: array_to_string(w[i + 1:i + 8], ' '))) AS gram FROM (SELECT doc_id, regexp_extract_all(replace(strip_accents(lower(text)), 'ß', 'ss'), '[a-z0-9]+') AS w FROM documents) q) z WHERE gram IN (SELECT gram FROM b)),
f AS (SELECT doc_id, source, sha256(text) AS k FROM documents WHERE len(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\v]+')) BETWEEN 150 AND 300 AND regexp_matches(text, '[.!?]["”’)]?$') AND doc_id NOT IN (SELECT doc_id FROM g)),
o AS (SELECT k, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM f GROUP BY k)
SELECT doc_id, source, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) AS place FROM o) x WHERE place <= 2""")
def control_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two controls of each source."""
    hit = benchmark_runs(spark, sf_dir, 8, "doc_id").select("doc_id").distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("work"), "text")
    return control_pool(docs, hit).select("doc_id", F.col("work").alias("source"), "place")


def grouped_errors(lines: DataFrame) -> DataFrame:
    """(kind, first, n) of error lines (no, line: 'file:number: message'): messages without what stands in quotes or is a
    number are a kind; its first line and how many there are."""
    message = F.regexp_extract("line", r"^[^:]*:[0-9]+: (.*)$", 1)
    kind = F.regexp_replace(F.regexp_replace(message, "'[^']*'", "'…'"), "[0-9]+", "#")
    return lines.where(message != "").groupBy(kind.alias("kind")).agg(F.min_by("line", "no").alias("first"), F.count(F.lit(1)).alias("n"))


@frame("""
WITH l AS (SELECT event_id, event_type || ':' || user_id || ': ''' || props || ''' at ' || floor(value)::INT AS line, CASE WHEN event_type = 'error' THEN '''…'' at #' ELSE '''…'' at #' END AS kind FROM events WHERE event_type IN ('error', 'view'))
SELECT kind, arg_min(line, event_id) AS first, count(*) AS n FROM l GROUP BY kind""")
def error_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as error lines, grouped."""
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'view')")
    line = F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"), F.lit(": '"), "props", F.lit("' at "), F.floor("value").cast("string"))
    return grouped_errors(e.select(F.col("event_id").alias("no"), line.alias("line")))


def concerning(entries: DataFrame, names: DataFrame) -> DataFrame:
    """(entry, person) of entries (entry, text) that name a person (person, name) in full or by surname, as whole words in
    any case. Names are met by their words, so that only entries with all words of a name are searched."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_#]+"), F.lit(0)))
    surname = F.element_at(F.split("name", " "), -1)
    asked = names.select("person", F.explode(F.array_distinct(F.array("name", surname))).alias("n")).withColumn("last", F.element_at(words(F.col("n")), -1)).distinct()
    one = entries.select("entry", "text", F.explode(words(F.col("text"))).alias("last"))
    near = one.join(F.broadcast(asked) if asked.count() <= NEEDLES else asked, "last")
    whole = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])\Q"), F.col("n"), F.lit(r"\E(?![\p{L}\p{N}_])"))
    return near.where(F.call_function("rlike", F.col("text"), whole)).select("entry", "person").distinct()


@frame("""
WITH n AS (SELECT n_nationkey AS person, n_name AS name FROM nation), c AS (SELECT c_custkey AS entry, 'met ' || lower(n_name) || ', and ' || c_name AS text FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT entry, person FROM c JOIN n ON regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])' || name || '([^A-Za-z0-9_]|$)')""")
def named_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' notes and the nations they name."""
    nation = table(spark, sf_dir, "nation")
    notes = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("entry"), F.concat(F.lit("met "), F.lower("n_name"), F.lit(", and "), "c_name").alias("text"))
    return concerning(notes, nation.select(F.col("n_nationkey").alias("person"), F.col("n_name").alias("name")))


def linted(rows: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(key, errors) of rows with any: rules of a row, and repeated keys."""
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__copies"))
    found = rows.join(repeated, key)
    return found.select(key, F.concat(found_errors(rules), found_errors([("repeated id", F.col("__copies") > 1)])).alias("errors")).where("size(errors) > 0")


@frame("""
SELECT l_orderkey, array_to_string(list_filter([CASE WHEN l_discount > 0.09 THEN 'discount out of range' END, CASE WHEN p_partkey IS NULL THEN 'unknown part' END, CASE WHEN l_quantity > 49 THEN 'too many' END, CASE WHEN p_name LIKE '%1%' AND l_tax > 0.07 THEN 'banned wording' END, CASE WHEN n > 1 THEN 'repeated id' END], lambda x: x IS NOT NULL), '; ') AS errors, count(*) AS rows
FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS n FROM lineitem LEFT JOIN part ON l_partkey = p_partkey) x
WHERE l_discount > 0.09 OR p_partkey IS NULL OR l_quantity > 49 OR (p_name LIKE '%1%' AND l_tax > 0.07) OR n > 1 GROUP BY 1, 2""")
def linted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with what is wrong about them."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").withColumn("id", F.struct("l_orderkey", "l_partkey"))
    rules = [("discount out of range", F.col("l_discount") > 0.09), ("unknown part", F.col("p_partkey").isNull()), ("too many", F.col("l_quantity") > 49), ("banned wording", F.contains("p_name", F.lit("1")) & (F.col("l_tax") > 0.07))]
    return linted(lines, "id", rules).groupBy("id.l_orderkey", F.array_join("errors", "; ").alias("errors")).agg(F.count(F.lit(1)).alias("rows"))


def accepted_by_kind(kind: Column, text: Column, items: Column, banned: str) -> Column:
    """Plans need three to six items, voices 2 to 420 characters, writing an ending and no banned term; other kinds are not accepted."""
    n = F.length(F.trim(text))
    return F.when(kind == "plan", F.size(items).between(3, 6)).when(kind == "voice", n.between(2, 420)).when(kind == "writing", text.rlike(r"[.!?]\z") & ~text.rlike(banned)).otherwise(F.lit(False))


@frame("""
WITH k AS (SELECT CASE role WHEN 'user' THEN 'plan' WHEN 'assistant' THEN 'voice' ELSE 'writing' END AS kind, text, regexp_extract_all(text, '[^.!?]+[.!?]') AS items FROM conversations)
SELECT kind, count(*) AS n, count(*) FILTER (WHERE CASE kind WHEN 'plan' THEN len(items) BETWEEN 3 AND 6 WHEN 'voice' THEN length(trim(text)) BETWEEN 2 AND 420 ELSE regexp_matches(text, '[.!?]$') AND NOT regexp_matches(text, 'helpful') END) AS accepted FROM k GROUP BY kind""")
def accepted_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as plans, voices and writing."""
    kind = F.when(F.col("role") == "user", "plan").when(F.col("role") == "assistant", "voice").otherwise("writing")
    fine = accepted_by_kind(F.col("kind"), F.col("text"), F.regexp_extract_all("text", F.lit("[^.!?]+[.!?]"), F.lit(0)), "helpful")
    return table(spark, sf_dir, "conversations").withColumn("kind", kind).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(fine).alias("accepted"))


def roster(rows: DataFrame, excluded: DataFrame, frozen: DataFrame, key: str) -> DataFrame:
    """``rows`` without the excluded keys; raises unless these are exactly the frozen ones."""
    wrong = excluded.select(key).exceptAll(frozen.select(key)).unionAll(frozen.select(key).exceptAll(excluded.select(key)))
    if wrong.limit(1).count():
        raise ValueError("the excluded rows are not the frozen ones")
    return rows.join(excluded.select(key), key, "left_anti")


@frame("SELECT doc_id FROM labels WHERE toxic = 0")
def eligible_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents without the toxic ones, which must be those of the frozen list."""
    labels = table(spark, sf_dir, "labels")
    return roster(labels.select("doc_id"), labels.where("toxic = 1"), labels.where("toxic > 0"), "doc_id")


def claim_evidence(claims: DataFrame, records: DataFrame) -> DataFrame:
    """(claim, record, text) of claims (claim, kind, cites) and records (record, kind, text, verified): facts may not cite
    statements, drafts or intentions, other claims may; of records that are not verified the words in quotes are cut."""
    cited = claims.select("claim", F.col("kind").alias("claimed"), F.explode("cites").alias("record")).join(records, "record")
    fine = (F.col("claimed") != "fact") | ~F.col("kind").isin("statement", "draft", "intention")
    return cited.where(fine).select("claim", "record", F.when(F.col("verified"), F.col("text")).otherwise(F.regexp_replace("text", '"[^"]*"', '"…"')).alias("text"))


@frame("""
WITH c AS (SELECT event_id AS claim, CASE WHEN event_type = 'error' THEN 'fact' ELSE 'guess' END AS kind, unnest([event_id - 1, event_id - json_extract_string(props, '$.k')::INT]) AS record FROM events WHERE event_type IN ('error', 'signup')),
r AS (SELECT event_id AS record, CASE event_type WHEN 'view' THEN 'statement' WHEN 'click' THEN 'intention' ELSE 'event' END AS kind, regexp_replace(props, '"[^"]*"', '"…"', 'g') AS text FROM events)
SELECT c.claim, c.record, r.text FROM c JOIN r ON c.record = r.record WHERE c.kind <> 'fact' OR r.kind NOT IN ('statement', 'draft', 'intention')""")
def cited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as facts and signups as guesses that cite earlier events."""
    e = table(spark, sf_dir, "events")
    claims = e.where("event_type in ('error', 'signup')").select(F.col("event_id").alias("claim"), F.when(F.col("event_type") == "error", "fact").otherwise("guess").alias("kind"), F.array(F.col("event_id") - 1, F.col("event_id") - event_k()).alias("cites"))
    records = e.select(F.col("event_id").alias("record"), F.when(F.col("event_type") == "view", "statement").when(F.col("event_type") == "click", "intention").otherwise("event").alias("kind"), F.col("props").alias("text"), F.lit(False).alias("verified"))
    return claim_evidence(claims, records)


def is_english(text: Column, words: int = 15, stop_share: float = 0.30, foreign: float = 0.02) -> Column:
    """Of the first 200 words in letters A to Z: at least so many, and that share of stop words; and few characters beyond ASCII."""
    low = F.slice(F.regexp_extract_all(F.replace(F.lower(text), F.lit("’"), F.lit("'")), F.lit("[a-z']+"), F.lit(0)), 1, 200)
    stops = F.size(F.filter(low, lambda w: w.isin(*STOPWORDS)))
    beyond = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return (F.size(low) >= words) & (beyond <= foreign * F.length(text)) & (stops >= stop_share * F.size(low))


def usable_chats(turns: DataFrame, sources: Sequence[str]) -> DataFrame:
    """(conv, why) of turns (conv, turn, source, role, text): why a conversation is no use: another source than allowed, not
    two to six turns from user to assistant in turn, an empty one, over 3,000 characters, a last one under forty, not English."""
    chats = turns.groupBy("conv", "source").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.trim("text").alias("text")))).alias("m"))
    wanted = lambda x, i: F.when(i % 2 == 0, "user").otherwise("assistant") != x["role"]
    text = F.array_join(F.transform("m", lambda x: x["text"]), " ")
    why = found_errors([("source", ~F.col("source").isin(*sources)), ("turns", ~F.size("m").between(2, 6) | (F.size("m") % 2 == 1) | F.exists(F.transform("m", wanted), lambda x: x)), ("empty", F.exists("m", lambda x: x["text"] == "")), ("long", F.length(text) > 3000), ("short", F.length(F.element_at("m", -1)["text"]) < 40), ("language", ~is_english(text))])
    return chats.select("conv", why.alias("why"))


STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)


@frame(rf"""
WITH o AS (SELECT conv_id, turn, role, trim(text) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations),
c AS (SELECT conv_id, any_value(k) AS k, bool_or(role <> CASE WHEN n % 2 = 1 THEN 'user' ELSE 'assistant' END) AS bad, bool_or(text = '') AS bare, string_agg(text, ' ' ORDER BY turn) AS t, max(CASE WHEN n = k THEN length(text) END) AS last FROM o GROUP BY conv_id),
w AS (SELECT *, regexp_extract_all(replace(lower(t), '’', ''''), '[a-z'']+')[1:200] AS w FROM c), e AS (SELECT *, len(w) >= 15 AND length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) <= 0.02 * length(t) AND len(list_filter(w, lambda x: x IN ({STOP_SQL}))) >= 0.30 * len(w) AS english FROM w)
SELECT conv_id, array_to_string(list_filter([CASE WHEN conv_id % 7 = 0 THEN 'source' END, CASE WHEN k NOT BETWEEN 2 AND 6 OR k % 2 = 1 OR bad THEN 'turns' END, CASE WHEN bare THEN 'empty' END, CASE WHEN length(t) > 3000 THEN 'long' END, CASE WHEN last < 40 THEN 'short' END, CASE WHEN NOT english THEN 'language' END], lambda x: x IS NOT NULL), ',') AS why FROM e""")
def chat_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why conversations are no use; every seventh is of another source."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", F.when(F.col("conv_id") % 7 == 0, "other").otherwise("own").alias("source"), "role", "text")
    return usable_chats(turns, ["own"]).select(F.col("conv").alias("conv_id"), F.array_join("why", ",").alias("why"))
