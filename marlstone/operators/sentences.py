"""Sentences of texts as column expressions: no Python touches the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dialect import frame

# Abbreviations that end no sentence.
ABBREVIATIONS = "mr mrs dr st cf vol pp no fr hr hrn bzw usw ibid viz etc ch sect bd ed".split()
#: What may stand before a word, after a stop, and at the start of the next sentence.
OPENERS, CLOSERS, STARTS = r"(“\"‘'\[", r"\"”’)\]", r"A-ZÄÖÜ“\"‘'(§\["
#: Ends a sentence where text is cut; texts that hold it get a space for it.
CUT = "\x01"


def stop_pattern(abbreviations=tuple(ABBREVIATIONS)) -> str:
    """A run of stops that doesn't begin with a semicolon, what closes after it, and the space before a sentence's start;
    not after an abbreviation or a single letter."""
    known = "|".join([*abbreviations, r"\p{L}"])
    return rf"(?<![.!?;])(?<!(?:^|\s)[{OPENERS}]{{0,9}}(?iu:{known}))([.!?][.!?;]*[{CLOSERS}]*)\s+(?=[{STARTS}])"


def sentences(text: Column, abbreviations=tuple(ABBREVIATIONS)) -> Column:
    """The sentences in order, without white space around them; empty for texts without any."""
    cut = F.regexp_replace(F.translate(text, CUT, " "), stop_pattern(abbreviations), f"$1{CUT}")
    return F.filter(F.transform(F.split(cut, CUT), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")


def spans(docs: DataFrame, id_col: str, text_col: str, abbreviations=tuple(ABBREVIATIONS)) -> DataFrame:
    """(id, no, begin, end, sentence): places in the squeezed text, from 0, of which substring(text, begin + 1, end - begin)
    is the sentence. Rows with equal ids are told apart by their text."""
    each = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h"), F.posexplode(sentences(squeezed(docs[text_col]), abbreviations)).alias("no", "sentence"))
    before = Window.partitionBy("id", "h").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("sentence") + 1).over(before), F.lit(0)).cast("int")
    return each.withColumn("begin", begin).select("id", "no", "begin", (F.col("begin") + F.length("sentence")).alias("end"), "sentence")


NEXT_SQL = r"""
t AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\v]+') AS w FROM documents),
word AS (SELECT doc_id, w, i, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM t) x),
stop AS (SELECT doc_id, i, w, regexp_matches(w, '(^|[^.!?;])[.!?][.!?;]*["”’)\]]*$') AND coalesce(regexp_matches(next, '^[A-ZÄÖÜ“"‘''(§\[]'), false)
  AND NOT regexp_matches(lower(w), '^[(“"‘''\[]*(ABBREVIATIONS|\p{L})[.!?][.!?;]*["”’)\]]*$') AS ends FROM word),
part AS (SELECT doc_id, w, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM stop),
sentence AS (SELECT doc_id, s, sum(length(w)) + count(*) - 1 AS chars FROM part GROUP BY doc_id, s)""".replace("ABBREVIATIONS", "|".join(ABBREVIATIONS))


@frame(f"WITH {NEXT_SQL} SELECT o.doc_id, count(s.s)::INT AS sentences, coalesce(max(s.chars), 0)::INT AS longest FROM documents o LEFT JOIN sentence s ON o.doc_id = s.doc_id GROUP BY o.doc_id")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document, abbreviations and initials guarded, and the longest one's characters."""
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.transform(sentences(squeezed(F.col("text"))), F.length).alias("n"))
    return found.select("doc_id", F.coalesce(F.size("n"), F.lit(0)).alias("sentences"), F.coalesce(F.array_max("n"), F.lit(0)).alias("longest"))
