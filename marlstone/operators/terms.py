"""Term lists on texts: flags with headings, gates by what was met before, topical filters, rates; words one slip apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dialect import frame
from ..sources import files
from .corpus import table, word_rows

#: Lists for the queries on the test tables, in the form that term files have.
SENSITIVE = "# rights\nlicense\n# access\ntoken\npassword\nsecret*\n"
LATER = "# made\nversion\ncopyright\napache\nreserved\nthe\n"
CRIME, STRIFE = ("kill", "death", "shot", "arrest", "fire", "thing"), ("war", "border", "protest", "that")


def marked(rows: DataFrame, texts: Sequence[str], groups: Sequence[tuple[str | None, str]]) -> DataFrame:
    """``rows`` with sensitive, why (the first flagged term of the first text that has one) and topic (its heading)."""
    found = F.coalesce(*[files.flag(F.col(c), list(groups)) for c in texts])
    return rows.withColumn("__f", found).withColumns({"sensitive": F.col("__f").isNotNull(), "why": F.col("__f.term"), "topic": F.col("__f.heading")}).drop("__f")


@frame(r"""
WITH f AS (SELECT regexp_extract(text, '(?i)\b(license)s?\b') AS a, regexp_extract(text, '(?i)\b(token|password|secret\w*)s?\b') AS b FROM documents)
SELECT CASE WHEN a <> '' THEN 'rights' ELSE 'access' END AS heading, lower(CASE WHEN a <> '' THEN a ELSE b END) AS term, count(*) AS documents FROM f WHERE a <> '' OR b <> '' GROUP BY 1, 2""")
def flagged_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first term of a list in each text, whole word in any case with an optional plural, and its heading."""
    found = marked(table(spark, sf_dir, "documents").select("text"), ["text"], files.terms(SENSITIVE)).where("sensitive")
    return found.groupBy(F.col("topic").alias("heading"), F.lower("why").alias("term")).agg(F.count(F.lit(1)).alias("documents"))


def any_of(text: Column, prefixes: Sequence[str]) -> Column:
    """Whether a word begins with one of these, in any case."""
    return text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(prefixes)})")


def topical(text: Column, out: Sequence[str] = CRIME, unless: Sequence[str] = STRIFE) -> Column:
    return ~any_of(text, out) | any_of(text, unless)


@frame(r"""
SELECT lang, count(*) AS documents, count(*) FILTER (WHERE NOT regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(kill|death|shot|arrest|fire|thing)') OR regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(war|border|protest|that)')) AS fit FROM documents GROUP BY lang""")
def topical_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name a crime word are dropped unless they name strife, too; word lists by prefix."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if(topical(F.col("text"))).alias("fit"))


def unmet(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(key, doc, terms) of docs (key, doc, w: words): those of the terms that a text uses and no earlier one of its key did."""
    each = docs.select("key", "doc", F.explode(F.array_intersect(F.array_distinct("w"), F.array(*map(F.lit, terms)))).alias("term"))
    first = each.groupBy("key", "term").agg(F.min("doc").alias("doc"))
    return first.groupBy("key", "doc").agg(F.sort_array(F.collect_list("term")).alias("terms"))


@frame("""
WITH w AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(replace(strip_accents(lower(text)), 'ß', 'ss'), '[a-z0-9]+'))) AS term FROM documents),
f AS (SELECT source, term, min(doc_id) AS doc_id FROM w WHERE term IN ('version', 'copyright', 'apache', 'reserved', 'the') GROUP BY source, term)
SELECT doc_id, string_agg(term, ',' ORDER BY term) AS terms FROM f GROUP BY doc_id""")
def knowledge_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a list that a document is the first of its source to use."""
    rows = word_rows(table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("doc"), "text"), "key", "doc")
    found = unmet(rows, [t for t in files.words_of(LATER)])
    return found.select(F.col("doc").alias("doc_id"), F.array_join("terms", ",").alias("terms"))


def term_rates(docs: DataFrame, by: str, terms: Sequence[str]) -> DataFrame:
    """(by, hits, per_100, sentences): uses of whole terms, uses per hundred words, and sentences with one."""
    from .sentences import sentences, squeezed

    pattern = rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(terms)})(?![\p{{L}}\p{{N}}_])"
    hits, words = F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))), F.size(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))
    told = F.size(F.filter(sentences(squeezed(F.col("text"))), lambda s: s.rlike(pattern)))
    n = docs.select(by, hits.alias("h"), words.alias("w"), F.when(hits > 0, told).otherwise(0).alias("s"))
    return n.groupBy(by).agg(F.sum("h").alias("hits"), (100 * F.sum("h") / F.greatest(F.sum("w"), F.lit(1))).alias("per_100"), F.sum("s").alias("sentences"))


@frame(r"""
WITH p AS (SELECT source, text, len(regexp_extract_all(' ' || regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g') || ' ', '(?i)[^\p{L}\p{N}_](license|token|state|that|und|que)[^\p{L}\p{N}_]')) AS hits, len(regexp_extract_all(text, '\w+')) AS words FROM documents)
SELECT source, sum(hits)::BIGINT AS hits, round(100.0 * sum(hits) / greatest(sum(words), 1), 6) AS per_100 FROM p GROUP BY source""")
def term_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of some terms per hundred words, by source."""
    found = term_rates(table(spark, sf_dir, "documents"), "source", ("license", "token", "state", "that", "und", "que"))
    return found.select("source", "hits", F.round("per_100", 6).alias("per_100"))


def slips(rare: DataFrame, common: DataFrame) -> DataFrame:
    """(rare, common) of words (word) that are one letter changed, left out or put in apart. Both ask for each other by the
    word with one letter left out, at each place."""
    keys = lambda df, name: df.select(F.col("word").alias(name), F.explode(F.array_distinct(F.concat(F.array("word"), F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.length("word"))))))).alias("k"))
    met = keys(rare.where("word <> ''"), "rare").join(keys(common.where("word <> ''"), "common"), "k").select("rare", "common").distinct()
    return met.where(F.levenshtein("rare", "common") == 1)


def digits_off(numbers: DataFrame) -> DataFrame:
    """(a, b) of numbers (n) of equal length that differ in one digit: by the number with that digit blanked."""
    text = F.col("n").cast("string")
    keys = numbers.distinct().select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.lit("?"), F.substring(text, i + 1, F.length(text))))).alias("k"))
    return keys.select(F.col("n").alias("a"), "k").join(keys.select(F.col("n").alias("b"), "k"), "k").where("a < b").select("a", "b")


@frame("""
WITH k AS (SELECT DISTINCT c_custkey::VARCHAR AS t, c_custkey AS n FROM customer)
SELECT x.n AS a, y.n AS b FROM k x JOIN k y ON length(x.t) = length(y.t) AND x.n < y.n AND hamming(x.t, y.t) = 1""")
def one_digit_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers' numbers that a slip of one digit confuses."""
    return digits_off(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n")))


def new_items(items: DataFrame, known: DataFrame) -> DataFrame:
    """(id, topic, topics) of items (id, topic, ord) whose id is not ``known`` (id): the topic that comes first, and all."""
    fresh = items.join(known.select("id").distinct(), "id", "left_anti")
    return fresh.groupBy("id").agg(F.min_by("topic", F.struct("ord", "topic")).alias("topic"), F.sort_array(F.collect_set("topic")).alias("topics"))


@frame("""
WITH i AS (SELECT l_partkey AS id, l_returnflag || l_linestatus AS topic, l_linenumber AS ord FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45))
SELECT id, arg_min(topic, (ord, topic)) AS topic, array_to_string(list_sort(list_distinct(list(topic))), ',') AS topics FROM i GROUP BY id""")
def unseen_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no large line has, with the first of their flags and all."""
    lines = table(spark, sf_dir, "lineitem")
    items = lines.select(F.col("l_partkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("topic"), F.col("l_linenumber").alias("ord"))
    found = new_items(items, lines.where("l_quantity >= 45").select(F.col("l_partkey").alias("id")))
    return found.select("id", "topic", F.array_join("topics", ",").alias("topics"))


def provenance(passages: DataFrame, sources: DataFrame) -> DataFrame:
    """(work, no, at): where each passage (work, no, text) begins in its work's source (work, text), from 0: the first exact
    match after the one before; null for one that is not found, which the next does not wait for. One task a work."""
    import pandas as pd

    def walk(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, pointer = [], 0
        whole = b["text"].iloc[0] if len(b) else ""
        for r in a.sort_values("no").itertuples(index=False):
            at = whole.find(r.text, pointer)
            out.append((r.work, r.no, at if at >= 0 else None))
            pointer = at + len(r.text) if at >= 0 else pointer
        return pd.DataFrame(out, columns=["work", "no", "at"]).astype({"at": "Int64"})

    kind = passages.schema["work"].dataType.simpleString()
    return passages.groupBy("work").cogroup(sources.groupBy("work")).applyInPandas(walk, f"work {kind}, no int, at long")


@frame(r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT doc_id, unnest(range(len(ls)))::INT AS no, unnest(ls) AS line, ls FROM l)
SELECT doc_id, no, (length(array_to_string(ls[1:no], chr(10))) + CASE WHEN no > 0 THEN 1 ELSE 0 END)::BIGINT AS place FROM p WHERE line <> '' AND len(list_filter(ls, lambda x: contains(x, line))) = 1""")
def passage_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where lines that a document has once stand in it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("work"), "text")
    lines = docs.select("work", F.split("text", "\n").alias("ls")).select("work", F.posexplode("ls").alias("no", "text"), "ls").where(F.col("text") != "")
    once = lines.where(F.size(F.filter("ls", lambda x: F.contains(x, F.col("text")))) == 1).drop("ls")
    return provenance(once, docs).select(F.col("work").alias("doc_id"), "no", F.col("at").alias("place"))


def newest_moments(moments: DataFrame, k: int = 3) -> DataFrame:
    """(person, moment, at): the k newest moments (person, moment, at) of each person; a moment that several people share
    goes to the first of them by name."""
    own = moments.groupBy("moment", "at").agg(F.min("person").alias("person"))
    rank = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("at"), F.desc("moment")))
    return own.withColumn("n", rank).where(F.col("n") <= k).select("person", "moment", "at")


@frame("""
WITH m AS (SELECT event_id AS moment, unnest([user_id, user_id % 7]) AS person FROM events), o AS (SELECT moment, min(person) AS person FROM m GROUP BY moment)
SELECT person, moment FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY moment DESC) AS n FROM o) x WHERE n <= 3""")
def shared_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three events of people, of which each event has two."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("moment"), F.col("event_id").alias("at"), F.explode(F.array("user_id", F.col("user_id") % 7)).alias("person"))
    return newest_moments(e).select("person", "moment")
