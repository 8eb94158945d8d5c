"""Corpus operators: vocabulary, phrase repetition, copies and decontamination, cleaning and row checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, phrase_words, quoted, telling, words
from ..plans.dialect import DuckDB, SparkSQL, frame, query
from ..plans.storage import stored
from .overlap import half_alike


def runs(d, table: str, key: str, n: int) -> str:
    """Distinct n-word runs of a table's texts, by key."""
    return d.unnest(key, f"(SELECT {key}, {d.distinct(d.grams('w', n))} AS g FROM (SELECT {key}, {words(d, 'text')} AS w FROM {d.t(table)}) q) r", "g", "pos", "gram")


def word_rows(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """(kept columns, w): the words of each text, as the engine's SQL has them."""
    return docs.select(*keep, F.expr(words(SparkSQL(""), text)).alias("w"))


def places(rows: DataFrame, n: int, *keep: str, w: str = "w") -> DataFrame:
    """(kept columns, w, i, h): where each run of ``n`` words begins, from 0, and its hash. The hash is worked out after
    the explode, in generated code; with OUTER, as an inferred filter would be pushed below and find the words again."""
    at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    each = rows.select(*keep, F.col(w).alias("w"), F.explode_outer(at).alias("i")).where("i is not null")
    return each.withColumn("h", F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(n)]))


def run_at(n: int) -> Column:
    return F.array_join(F.slice("w", F.col("i") + 1, n), " ")


#: Runs of a query table that are broadcast (some 200 bytes each); beyond, runs are joined.
NEEDLES = 500_000


def shared_runs(docs: DataFrame, needles: DataFrame, n: int, *keep: str) -> DataFrame:
    """(kept columns, i, gram) of each place in ``docs`` (kept columns, w) whose run of ``n`` words one of ``needles`` (w)
    has, too. Hashes are compared first, so that only runs that are found become text."""
    grams = stored(places(needles, n).select("h", run_at(n).alias("gram")).distinct(), "corpus-needles")
    found = places(docs, n, *keep).join(F.broadcast(grams) if grams.count() <= NEEDLES else grams, "h")
    return found.where(run_at(n) == F.col("gram")).select(*keep, "i", "gram")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def benchmark_runs(spark: SparkSession, sf_dir: str, n: int, *keep: str) -> DataFrame:
    """Runs that documents share with the benchmark."""
    return shared_runs(word_rows(table(spark, sf_dir, "documents"), *keep), word_rows(table(spark, sf_dir, "benchmark")), n, *keep)


@query
def vocab_spread(d):
    """Uses of each word, and the sources and documents that have it."""
    return f"""
WITH tok AS (SELECT doc_id, source, {words(d, "text")} AS w FROM {d.t("documents")}), one AS ({d.unnest("doc_id, source", "tok", "w", "pos", "word")})
SELECT word, CAST(sum(uses) AS BIGINT) AS uses, CAST(sum(docs) AS BIGINT) AS docs, count(*) AS sources FROM (SELECT word, source, sum(n) AS uses, count(*) AS docs FROM (SELECT word, source, doc_id, count(*) AS n FROM one GROUP BY word, source, doc_id) a GROUP BY word, source) b GROUP BY word"""


@query
def unknown_word_ratio(d):
    """The share of a document's words that the corpus uses three times or more; null for fewer than twenty words."""
    return f"""
WITH tok AS (SELECT doc_id, {words(d, "text")} AS w FROM {d.t("documents")}), one AS ({d.unnest("doc_id", "tok", "w", "pos", "word")}),
per AS (SELECT doc_id, word, count(*) AS n FROM one GROUP BY doc_id, word), known AS (SELECT word FROM per GROUP BY word HAVING sum(n) >= 3)
SELECT t.doc_id, CASE WHEN sum(p.n) >= 20 THEN round(CAST(sum(CASE WHEN k.word IS NOT NULL THEN p.n ELSE 0 END) AS DOUBLE) / sum(p.n), 6) END AS known_ratio
FROM {d.t("documents")} t LEFT JOIN per p ON t.doc_id = p.doc_id LEFT JOIN known k ON p.word = k.word GROUP BY t.doc_id"""


def ngram_repetition_by_source_sql(d) -> str:
    return f"""
WITH w AS (SELECT doc_id, source, {phrase_words("text", d)} AS w FROM {d.t("documents")}), g AS (SELECT doc_id, source, {d.distinct(d.grams("w", 4))} AS p FROM w), one AS (SELECT * FROM ({d.unnest("doc_id, source", "g", "p", "pos", "phrase")}) u WHERE {telling(d, "phrase")}),
firsts AS (SELECT *, min(doc_id) OVER (PARTITION BY source, phrase) AS first FROM one),
marked AS (SELECT source, doc_id FROM firsts GROUP BY source, doc_id HAVING max(CASE WHEN first < doc_id THEN 1 ELSE 0 END) = 1),
n AS (SELECT source, count(*) AS documents FROM {d.t("documents")} GROUP BY source),
m AS (SELECT source, count(*) AS marked FROM marked GROUP BY source)
SELECT n.source, n.documents, CASE WHEN n.documents >= 20 THEN coalesce(m.marked, 0) END AS marked, CASE WHEN n.documents >= 20 THEN round(CAST(coalesce(m.marked, 0) AS DOUBLE) / n.documents, 6) END AS share
FROM n LEFT JOIN m ON n.source = m.source"""


@frame(ngram_repetition_by_source_sql(DuckDB()))
def ngram_repetition_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is marked if it has a phrase of an earlier one of its source; the share is null below twenty documents.

    Phrases are two hashes of 64 bits until they are known to repeat; a numeral or four stop words make no phrase."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(phrase_words("text", SparkSQL(""))).alias("w"))
    stop = [y.replace(chr(39), "’") for y in STOPWORDS]
    word = [F.get("w", F.col("i") + k) for k in range(4)]
    told = places(docs, 4, "doc_id", "source").where(~reduce(or_, (x < ":" for x in word)))  # a word below the colon begins with a digit
    told = told.where(~reduce(and_, (x.isin(*stop) for x in word)))
    keyed = stored(told.select("doc_id", "source", "h", F.hash(*word).alias("h2")).distinct(), "corpus-phrases")
    firsts = keyed.groupBy("source", "h", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    marked = keyed.join(firsts, ["source", "h", "h2"]).where("doc_id > first").select("source", "doc_id").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("m"))
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents")).join(marked, "source", "left")
    share = lambda x: F.when(F.col("documents") >= 20, x)
    m = F.coalesce("m", F.lit(0))
    return n.select("source", "documents", share(m).alias("marked"), share(F.round(m / F.col("documents"), 6)).alias("share"))


def phrases_by_use(d, by: str, k: int) -> str:
    """The k phrases of each group that most of its documents use, of those that several do; ties by phrase."""
    return f"""
WITH w AS (SELECT doc_id, {by}, {phrase_words("text", d)} AS w FROM {d.t("documents")}), g AS (SELECT doc_id, {by}, {d.distinct(d.grams("w", 4))} AS p FROM w), one AS (SELECT * FROM ({d.unnest(f"doc_id, {by}", "g", "p", "pos", "phrase")}) u WHERE {telling(d, "phrase")}),
n AS (SELECT {by}, phrase, count(*) AS uses FROM one GROUP BY {by}, phrase HAVING count(*) > 1)
SELECT {by}, phrase, uses, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY uses DESC, phrase) AS INTEGER) AS rank FROM n) r WHERE rank <= {k}"""


@query
def echo_phrases(d):
    """Phrases that more than one document of a language uses: the five most used, ties by phrase."""
    return phrases_by_use(d, "lang", 5)


@query
def repeated_phrases(d):
    """The three phrases of each source that most of its documents share."""
    return phrases_by_use(d, "source", 3)


def decontaminate_8gram_sql(d) -> str:
    return f"""
WITH b AS ({runs(d, "benchmark", "item_id", 8)}), t AS ({runs(d, "documents", "doc_id", 8)}),
hit AS (SELECT DISTINCT t.doc_id FROM t WHERE t.gram IN (SELECT gram FROM b))
SELECT o.source, count(*) AS documents, sum(CASE WHEN h.doc_id IS NULL THEN 1 ELSE 0 END) AS kept, sum(CASE WHEN h.doc_id IS NULL THEN 0 ELSE 1 END) AS dropped
FROM {d.t("documents")} o LEFT JOIN hit h ON o.doc_id = h.doc_id GROUP BY o.source""".replace("sum(CASE", "CAST(sum(CASE").replace("END) AS kept", "END) AS BIGINT) AS kept").replace("END) AS dropped", "END) AS BIGINT) AS dropped")


def leaked_items_12gram_hashed_sql(d) -> str:
    key = f"substr({d.sha('gram')}, 1, 16)"
    return f"""
WITH b AS (SELECT DISTINCT item_id, {key} AS k FROM ({runs(d, "benchmark", "item_id", 12)}) x), t AS (SELECT DISTINCT doc_id, {key} AS k FROM ({runs(d, "documents", "doc_id", 12)}) y)
SELECT b.item_id, count(DISTINCT t.doc_id) AS documents, count(DISTINCT b.k) AS runs FROM b JOIN t ON b.k = t.k GROUP BY b.item_id"""


def copied_stretches_sql(d) -> str:
    return f"""
WITH b AS (SELECT DISTINCT gram FROM ({runs(d, "benchmark", "item_id", 8)}) x),
w AS (SELECT doc_id, {words(d, "text")} AS w FROM {d.t("documents")}), g AS (SELECT doc_id, {d.grams("w", 8)} AS g FROM w), t AS ({d.unnest("doc_id", "g", "g", "pos", "gram")}),
hit AS (SELECT doc_id, pos, pos - CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS island FROM t WHERE gram IN (SELECT gram FROM b))
SELECT doc_id, min(pos) AS first_word, max(pos) + 7 AS last_word, max(pos) - min(pos) + 8 AS n_words FROM hit GROUP BY doc_id, island"""


def recall_beyond_input_sql(d) -> str:
    w = words(d, "text")
    return f"""
WITH src AS (SELECT DISTINCT gram FROM ({runs(d, "benchmark", "item_id", 8)}) x),
a AS (SELECT doc_id, {w} AS w FROM {d.t("documents")}),
h AS (SELECT doc_id, w, {d.part("w", 1, f"CAST(floor({d.size('w')} / 2) AS INTEGER)")} AS half FROM a),
g AS (SELECT doc_id, {d.distinct(d.grams("w", 8))} AS g, {d.distinct(d.grams("half", 8))} AS k FROM h),
one AS ({d.unnest("doc_id", "g", "g", "pos", "gram")}), had AS ({d.unnest("doc_id", "g", "k", "pos", "gram")})
SELECT o.doc_id, count(*) AS recalled FROM one o LEFT JOIN had ON o.doc_id = had.doc_id AND o.gram = had.gram WHERE had.gram IS NULL AND o.gram IN (SELECT gram FROM src) GROUP BY o.doc_id"""


@frame(decontaminate_8gram_sql(DuckDB()))
def decontaminate_8gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without an eight-word run of the benchmark, and how many of each source go."""
    hit = benchmark_runs(spark, sf_dir, 8, "doc_id").select("doc_id").distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(hit.withColumn("hit", F.lit(1)), "doc_id", "left")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("hit").isNull()).alias("kept"), F.count_if(F.col("hit").isNotNull()).alias("dropped"))


@frame(leaked_items_12gram_hashed_sql(DuckDB()))
def leaked_items_12gram_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which a document has a twelve-word run, by hashed keys."""
    key = F.left(F.sha2("gram", 256), F.lit(16)).alias("k")
    found = benchmark_runs(spark, sf_dir, 12, "doc_id").select("doc_id", key).distinct()
    items = places(word_rows(table(spark, sf_dir, "benchmark"), "item_id"), 12, "item_id").select("item_id", run_at(12).alias("gram")).select("item_id", key).distinct()
    return items.join(found, "k").groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("k").alias("runs"))


@frame(copied_stretches_sql(DuckDB()))
def copied_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal stretches of a document that are runs of eight words from the benchmark, merged where they touch."""
    hit = benchmark_runs(spark, sf_dir, 8, "doc_id")
    islands = hit.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("doc_id").orderBy("i")))
    found = islands.groupBy("doc_id", "island").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    return found.select("doc_id", F.col("a").alias("first_word"), (F.col("b") + 7).alias("last_word"), (F.col("b") - F.col("a") + 8).alias("n_words"))


@frame(recall_beyond_input_sql(DuckDB()))
def recall_beyond_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-word runs that a document shares with any benchmark text and that the document's first half lacks."""
    docs = word_rows(table(spark, sf_dir, "documents"), "doc_id").withColumn("n", F.size("w"))
    hit = shared_runs(docs, word_rows(table(spark, sf_dir, "benchmark")), 8, "doc_id", "n")
    each = hit.groupBy("doc_id", "n", "gram").agg(F.min("i").alias("first"))
    return each.where(F.col("first") + 8 > F.floor(F.col("n") / 2)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("recalled"))


def near_dup_sql(d) -> str:
    """near_dup_trigram_jaccard plainly."""
    return f"""
WITH t AS (SELECT lang, source, {d.text("w", " ")} AS joined, min(doc_id) AS doc_id FROM (SELECT doc_id, lang, source, {words(d, "text")} AS w FROM {d.t("documents")}) x GROUP BY lang, source, {d.text("w", " ")}),
w AS (SELECT doc_id, lang, source, {d.split("joined", " ")} AS w FROM t),
g AS (SELECT doc_id, lang, source, {d.text(d.part("w", 1, 6), " ")} AS six, {d.size("w")} AS n, {d.distinct(d.grams("w", 3))} AS g FROM w),
one AS ({d.unnest("doc_id, lang, source", "g", "g", "pos", "gram")}),
sizes AS (SELECT doc_id, {d.size("g")} AS n FROM g),
freq AS (SELECT lang, source, gram, count(*) AS f FROM one GROUP BY lang, source, gram),
placed AS (SELECT o.doc_id, o.lang, o.source, o.gram, f.f, row_number() OVER (PARTITION BY o.doc_id ORDER BY f.f, o.gram) AS rn FROM one o JOIN freq f ON o.gram = f.gram AND o.lang = f.lang AND o.source = f.source),
pre AS (SELECT p.* FROM placed p JOIN sizes s ON p.doc_id = s.doc_id WHERE p.f > 1 AND p.rn <= s.n - ceil(s.n / 2.0) + 1),
cand AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM pre a JOIN pre b ON a.gram = b.gram AND a.lang = b.lang AND a.source = b.source AND a.doc_id < b.doc_id),
common AS (SELECT c.x, c.y, count(*) AS n FROM cand c JOIN one a ON a.doc_id = c.x JOIN one b ON b.doc_id = c.y AND a.gram = b.gram GROUP BY c.x, c.y),
near AS (SELECT c.x, c.y FROM common c JOIN sizes s ON c.x = s.doc_id JOIN sizes u ON c.y = u.doc_id WHERE 2 * c.n >= s.n + u.n - c.n),
opens AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.six = b.six AND a.lang = b.lang AND a.source = b.source AND a.doc_id < b.doc_id WHERE a.n >= 6 AND b.n >= 6)
SELECT x AS first_id, y AS doc_id FROM near UNION SELECT x, y FROM opens"""


@frame(check=near_dup_sql(DuckDB()))
def near_dup_trigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat an earlier one of their language and source: equal first six words, or half of all word trigrams in common (``overlap``). Copies count once, for the least.

    Texts are written once; copies are found by hashes of 256 bits and left out where the texts are read. Hashes of
    trigrams hold language and source, so that a group of any size is dealt out by trigram."""
    d = SparkSQL(sf_dir)
    worded = spark.sql(f"SELECT doc_id, lang, source, {words(d, 'text')} AS w FROM {d.t('documents')} WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
    six = F.when(F.size("w") >= 6, F.array_join(F.slice("w", 1, 6), " ")).alias("six")
    joined = worded.select("doc_id", "lang", "source", F.size("w").alias("n"), six, F.array_join("w", " ").alias("joined"))
    every = stored(joined.withColumn("node", F.monotonically_increasing_id()).withColumn("key", F.xxhash64("lang", "source")).withColumn("sha", F.sha2("joined", 256)), "corpus")
    firsts = every.groupBy("lang", "source", "sha").agg(F.min(F.struct("doc_id", "node")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = stored(every.select("node", "lang", "source", "sha").join(firsts, ["lang", "source", "sha"]).where("node <> first.node").select("node"), "corpus-copies")
    docs = every.join(F.broadcast(copies) if copies.count() <= NEEDLES else copies, "node", "left_anti")
    near = half_alike(docs, "doc_id", "six").where("NOT coalesce(x_six = y_six, false)")  # those are among what opens alike
    starts = docs.where("six IS NOT NULL").select("doc_id", "lang", "source", "six")
    opens = starts.alias("x").join(starts.alias("y"), ["lang", "source", "six"]).where("x.doc_id < y.doc_id").select("x.doc_id", "y.doc_id")
    found = near.where("x_doc_id <> y_doc_id").select(F.least("x_doc_id", "y_doc_id"), F.greatest("x_doc_id", "y_doc_id")).union(opens).toDF("first_id", "doc_id")
    again = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return found.distinct() if again else found  # each pair of documents comes once, if their ids do


@query
def exact_dup_groups(d):
    """Texts that several documents have."""
    return f"SELECT {d.sha('text')} AS sha, count(*) AS copies, min(doc_id) AS first_id, max(doc_id) AS last_id FROM {d.t('documents')} GROUP BY {d.sha('text')} HAVING count(*) > 1"


@query
def dup_vs_first(d):
    """Each repeated document beside the first of its text, and a stable id: source, hash, occurrence."""
    return f"""
SELECT doc_id, first_id, source || ':' || substr(sha, 1, 16) || ':' || n AS stable_id FROM (
  SELECT doc_id, source, sha, min(doc_id) OVER (PARTITION BY sha) AS first_id, CAST(row_number() OVER (PARTITION BY source, sha ORDER BY doc_id) AS INTEGER) AS n FROM (SELECT doc_id, source, {d.sha("text")} AS sha FROM {d.t("documents")}) a) b
WHERE doc_id <> first_id"""


@query
def line_and_sentence_dedupe(d):
    """Sentences of a source in order, without those whose letters an earlier one of the source has; documents left empty vanish."""
    key = d.text(words(d, "s"), " ")
    return f"""
WITH a AS (SELECT doc_id, source, {d.find("text", "[^.!?\n]+[.!?]*")} AS found FROM {d.t("documents")}), one AS ({d.unnest("doc_id, source", "a", "found", "pos", "s")}),
keyed AS (SELECT doc_id, source, pos, trim(s) AS s, {key} AS k FROM one),
fresh AS (SELECT *, CAST(row_number() OVER (PARTITION BY source, k ORDER BY doc_id, pos) AS INTEGER) AS n FROM keyed WHERE k <> '')
SELECT doc_id, count(*) AS sentences, {d.sha(d.listed("s", " ", "pos"))} AS sha FROM fresh WHERE n = 1 GROUP BY doc_id"""


@query
def edit1_rare_words(d):
    """Words used once that are one edit from a word of a hundred uses and more, through keys with one letter left out."""
    cut = d.each(d.span("1", "length(word)"), "substr(word, 1, x - 1) || substr(word, x + 1)")
    concat = lambda a: f"concat({a}, {arr('word')})" if spark else f"list_concat({a}, {arr('word')})"
    spark = type(d).__name__ == "SparkSQL"
    arr = (lambda x: f"array({x})") if spark else (lambda x: f"[{x}]")
    return f"""
WITH tok AS (SELECT {words(d, "text")} AS w FROM {d.t("documents")}), one AS ({d.unnest("1 AS u", "tok", "w", "pos", "word")}),
n AS (SELECT word, count(*) AS uses FROM one GROUP BY word HAVING length(word) >= 5),
rare AS (SELECT word, {concat(cut)} AS keys FROM n WHERE uses = 1), common AS (SELECT word, uses, {concat(cut)} AS keys FROM n WHERE uses >= 100),
r AS ({d.unnest("word", "rare", "keys", "pos", "k")}), c AS ({d.unnest("word, uses", "common", "keys", "pos", "k")})
SELECT DISTINCT r.word AS rare, c.word AS common, c.uses FROM r JOIN c ON r.k = c.k WHERE levenshtein(r.word, c.word) = 1"""


def reason_cascade_sql(d) -> str:
    quoted_chars = f"length(text) - length({d.sub('text', chr(34) + '[^' + chr(34) + chr(92) + 'n]*' + chr(34), '')})"
    return f"""
WITH b AS (SELECT DISTINCT gram FROM ({runs(d, "benchmark", "item_id", 8)}) x), t AS ({runs(d, "documents", "doc_id", 8)}),
hit AS (SELECT DISTINCT doc_id FROM t WHERE gram IN (SELECT gram FROM b)),
r AS (SELECT o.doc_id, CASE
  WHEN {d.size(d.find("text", "[^ \t\r\n]+"))} NOT BETWEEN 180 AND 440 THEN 'outside length bounds'
  WHEN NOT {d.like("text", "[.!?][" + chr(34) + "”’)]?$")} THEN 'incomplete ending'
  WHEN h.doc_id IS NOT NULL THEN 'benchmark overlap'
  WHEN {d.like("text", "[#*$%&|<>]{3}")} THEN 'possible editorial residue'
  WHEN ({quoted_chars}) > 0.35 * length(text) THEN 'dominated by quoted speech' END AS reason
  FROM {d.t("documents")} o LEFT JOIN hit h ON o.doc_id = h.doc_id)
SELECT doc_id, reason, count(*) OVER (PARTITION BY reason) AS of_reason FROM r"""


def first_reason(docs: DataFrame, hit: DataFrame, least: int = 180, most: int = 440, quoted_share: float = 0.35, rules: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the first reason against each, null if it is kept. ``hit`` (doc_id, reason) comes
    after the length and the ending, such as overlaps with texts held back; ``rules`` are more (pattern, reason) of texts,
    such as anachronisms, in order."""
    n_words, marked = F.size(F.regexp_extract_all("text", F.lit("[^ \t\r\n]+"), F.lit(0))), F.length("text") - F.length(F.regexp_replace("text", '"[^"\\n]*"', ""))
    found = docs.join(hit.groupBy("doc_id").agg(F.min("reason").alias("__hit")), "doc_id", "left")
    reason = F.when(~n_words.between(least, most), "outside length bounds").when(~F.col("text").rlike('[.!?]["”’)]?$'), "incomplete ending").when(F.col("__hit").isNotNull(), F.col("__hit"))
    for pattern, why in rules:
        reason = reason.when(F.col("text").rlike(pattern), why)
    return found.withColumn("reason", reason.when(marked > quoted_share * F.length("text"), "dominated by quoted speech")).drop("__hit")


@frame(reason_cascade_sql(DuckDB()))
def reason_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason against each document, null if it is kept, and how many have it."""
    hit = benchmark_runs(spark, sf_dir, 8, "doc_id").select("doc_id", F.lit("benchmark overlap").alias("reason")).distinct()
    found = first_reason(table(spark, sf_dir, "documents").select("doc_id", "text"), hit, rules=[("[#*$%&|<>]{3}", "possible editorial residue")]).select("doc_id", "reason")
    of_reason = found.groupBy("reason").agg(F.count(F.lit(1)).alias("of_reason"))  # a row for each reason
    return found.join(F.broadcast(of_reason.withColumnRenamed("reason", "r")), F.col("reason").eqNullSafe(F.col("r"))).select("doc_id", "reason", "of_reason")


@query
def is_english_heuristic(d):
    """Fifteen words, at most 2 % of characters beyond ASCII, three in ten of the first 200 words stop words."""
    listed = quoted(w.replace(chr(39), "’") for w in STOPWORDS)
    return f"""
WITH w AS (SELECT doc_id, {d.part(d.find("replace(lower(text), chr(39), '’')", "[a-z’]+"), 1, 200)} AS w FROM {d.t("documents")}), one AS ({d.unnest("doc_id", "w", "w", "pos", "word")}),
n AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN word IN ({listed}) THEN 1 ELSE 0 END) AS stop FROM one GROUP BY doc_id)
SELECT t.doc_id, t.lang, coalesce(n.n >= 15 AND length({d.sub("text", "[ -~\t\r\n]", "")}) <= 0.02 * length(text) AND n.stop >= 0.30 * n.n, false) AS english FROM {d.t("documents")} t LEFT JOIN n ON t.doc_id = n.doc_id"""


@query
def url_redaction(d):
    """Addresses in markup as an ellipsis, and how many there were."""
    p = "https?://[^ \"<>]+"
    return f"SELECT page_id, {d.sub('url', p, '…')} AS url, CAST({d.size(d.find('html', p))} AS BIGINT) AS links, {d.sha(d.sub('html', p, '…'))} AS sha FROM {d.t('pages')}"


@query
def refusal_template_key(d):
    """Payloads with digits as #, cut to eighty characters, by event type."""
    return f"SELECT event_type, substr(trim({d.sub('props', '[0-9]+', '#')}), 1, 80) AS template, count(*) AS n FROM {d.t('events')} GROUP BY event_type, substr(trim({d.sub('props', '[0-9]+', '#')}), 1, 80)"


@query
def html_to_text(d):
    """Pages without scripts, styles, comments, navigation and tags; entities resolved, white space squeezed."""
    x = "html"
    for p in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "(?s)<!--.*?-->", "(?is)<nav.*?</nav>", "(?is)<footer.*?</footer>", "<[^>]*>"):
        x = d.sub(x, p, " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    x = f"trim({d.sub(x, '[ \t\r\n]+', ' ')})"
    return f"SELECT page_id, CAST(length({x}) AS BIGINT) AS n_chars, {d.sha(x)} AS sha, substr({x}, 1, 80) AS head FROM {d.t('pages')}"


@query
def chat_usable(d):
    """Conversations of two to six alternating turns from user to assistant, 3,000 characters at most, forty in the last."""
    return f"""
WITH o AS (SELECT conv_id, turn, role, trim(text) AS text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS n, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS back FROM {d.t("conversations")}),
c AS (SELECT conv_id, count(*) AS n, sum(length(text)) + count(*) - 1 AS chars, min(CASE WHEN role = CASE WHEN n % 2 = 1 THEN 'user' ELSE 'assistant' END AND text <> '' THEN 1 ELSE 0 END) AS fine, max(CASE WHEN back = 1 THEN length(text) END) AS last FROM o GROUP BY conv_id)
SELECT conv_id, n AS turns, CAST(chars AS BIGINT) AS chars, n BETWEEN 2 AND 6 AND n % 2 = 0 AND fine = 1 AND chars <= 3000 AND last >= 40 AS usable FROM c"""


@query
def chat_prompt_completion(d):
    """Prompt (all turns but the last) and completion of conversations that end on the assistant; over-long ones go whole."""
    line = "'<' || role || '> ' || trim(text)"
    return f"""
WITH o AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS back FROM {d.t("conversations")}),
p AS (SELECT conv_id, {d.listed(line, chr(10), "turn")} AS prompt FROM o WHERE back > 1 GROUP BY conv_id),
c AS (SELECT conv_id, trim(text) AS completion FROM o WHERE back = 1 AND role = 'assistant')
SELECT c.conv_id, {d.sha("p.prompt")} AS prompt_sha, CAST(length(p.prompt) AS BIGINT) AS prompt_chars, CAST(length(completion) AS BIGINT) AS completion_chars FROM c JOIN p ON c.conv_id = p.conv_id WHERE length(p.prompt) + length(completion) <= 8000"""


@query
def json_field_validation(d):
    """Payload problems as a list: not an object, no k, k out of range; and how many rows have each list."""
    k = f"TRY_CAST({d.field('props', 'k')} AS INTEGER)"
    return f"""
WITH v AS (SELECT event_type, CASE WHEN NOT {d.like("trim(props)", "^[{].*[}]$")} THEN 'not an object' WHEN {d.field("props", "k")} IS NULL THEN 'k is missing' WHEN {k} IS NULL THEN 'k is not a number' WHEN {k} NOT BETWEEN 5 AND 90 THEN 'k is out of range' ELSE '' END AS error FROM {d.t("events")})
SELECT event_type, error, count(*) AS n FROM v GROUP BY event_type, error"""


@query
def lenient_json(d):
    """The widest object in a text with thinking and fences around it, and its field."""
    wrapped = "'<think>no {' || event_type || '</think>```json ' || props || ' ``` end'"
    bare = d.sub(d.sub(wrapped, "(?s)<think>.*?</think>", ""), "```(json)?", "")
    whole = f"regexp_extract({bare}, '[{{].*[}}]', 0)"
    return f"SELECT event_id, TRY_CAST({d.field(whole, 'k')} AS BIGINT) AS k FROM {d.t('events')}"


def length_statistics_sql(d) -> str:
    pick = lambda f: f"max(CASE WHEN rn = CAST(floor({f} * (n - 1)) AS BIGINT) + 1 THEN len END)"
    return f"""
WITH l AS (SELECT source, CAST(length(text) AS BIGINT) AS len, row_number() OVER (PARTITION BY source ORDER BY length(text)) AS rn, count(*) OVER (PARTITION BY source) AS n FROM {d.t("documents")})
SELECT source, n, min(len) AS least, {pick(0.1)} AS p10, {pick(0.5)} AS median, {pick(0.9)} AS p90, max(len) AS most FROM l GROUP BY source, n"""


@frame(length_statistics_sql(DuckDB()))
def length_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, tenth, middle, ninetieth and greatest length of each source's documents, by place floor(f * (n - 1)): lengths
    are counted first, so that places are sums over lengths, not rows."""
    counts = table(spark, sf_dir, "documents").groupBy("source", F.length("text").cast("long").alias("len")).agg(F.count(F.lit(1)).alias("k"))
    upto = Window.partitionBy("source").orderBy("len")
    each = counts.withColumn("cum", F.sum("k").over(upto)).withColumn("n", F.sum("k").over(Window.partitionBy("source")))
    at = lambda f: F.min(F.when(F.col("cum") > F.floor(F.lit(f) * (F.col("n") - 1)), F.col("len")))
    return each.groupBy("source", "n").agg(F.min("len").alias("least"), at(0.1).alias("p10"), at(0.5).alias("median"), at(0.9).alias("p90"), F.max("len").alias("most"))


@query
def titles_and_slugs(d):
    """A document's first line as slug and header key, cut at a word."""
    first = d.at(d.split("text", chr(92) + "n"), 1)
    return f"""
WITH f AS (SELECT doc_id, trim({first}) AS line FROM {d.t("documents")})
SELECT doc_id, {d.sub(d.sub("lower(line)", "[^a-z0-9]+", "-"), "^-|-$", "")} AS slug, upper({d.sub("line", "[^A-Za-z]+", "")}) AS header_key,
  CASE WHEN length(line) <= 40 THEN line ELSE {d.sub("substr(line, 1, 40)", " [^ ]*$", "")} || ' …' END AS cut FROM f"""


@query
def tidy_text(d):
    """Ligatures, soft hyphens, long s, words split at line ends, spaces before marks, white space."""
    x = "replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ſ', 's'), '­', '')"
    x = d.sub(x, "[*#$%&]{3}", "")
    x = d.sub(x, " +([,.;:!?])", "$1" if type(d).__name__ == "SparkSQL" else chr(92) + "1")
    x = f"trim({d.sub(x, '[ \t\r\n]+', ' ')})"
    return f"SELECT doc_id, CAST(length({x}) AS BIGINT) AS n_chars, {d.sha(x)} AS sha FROM {d.t('documents')}"


@query
def line_kinds(d):
    """Lines by kind: numbered, rule, table, shouted, junk (few letters), text."""
    letters = f"length({d.sub('line', '[^A-Za-zÀ-ÿ]', '')})"
    return f"""
WITH l AS (SELECT doc_id, source, {d.split("text", chr(92) + "n")} AS lines FROM {d.t("documents")}), one AS ({d.unnest("doc_id, source", "l", "lines", "pos", "line")}),
k AS (SELECT source, CASE WHEN {d.like("line", "^ *[0-9]+ *$")} THEN 'numbered' WHEN {d.like("line", "^[-=_* ]{3,}$")} THEN 'rule' WHEN {d.like("line", " [|] .* [|] ")} THEN 'table' WHEN {letters} < 3 OR {letters} < 0.4 * length(line) THEN 'junk' WHEN upper(line) = line THEN 'shouted' ELSE 'text' END AS kind FROM one)
SELECT source, kind, count(*) AS lines FROM k GROUP BY source, kind"""


@query
def capitalised_names(d):
    """Capitalised words inside sentences, and the documents that have them."""
    return f"""
WITH s AS (SELECT doc_id, {d.find("text", "[a-z,] [A-Z][a-z]+")} AS n FROM {d.t("documents")}), one AS ({d.unnest("doc_id", "s", "n", "pos", "found")})
SELECT substr(found, 3) AS name, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM one GROUP BY substr(found, 3)"""


@query
def paraphrase_judge(d):
    """An assistant turn against the user turn before it: empty, cut off, markup, length ratio, copied run, or accepted."""
    return f"""
WITH p AS (SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS original FROM {d.t("conversations")}),
w AS (SELECT conv_id, turn, text, {words(d, "text")} AS a, {words(d, "original")} AS b FROM p WHERE role = 'assistant' AND was = 'user'),
g AS (SELECT conv_id, turn, text, {d.size("a")} AS n, {d.size("b")} AS m, {d.grams("a", 8)} AS ga, {d.grams("b", 8)} AS gb FROM w)
SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN NOT {d.like("text", "[.!?]$")} THEN 'cut off' WHEN {d.like("text", "[*#`|]")} THEN 'markup'
  WHEN n < 0.6 * m OR n > 1.4 * m THEN 'length' WHEN {d.size(d.both("ga", "gb"))} > 0 THEN 'copied' ELSE 'accepted' END AS verdict
FROM g"""


@query
def clean_answers(d):
    """Turns without thinking, fences, speaker labels and wrapping quotes."""
    x = d.sub(d.sub(d.sub("'Assistant: ' || chr(34) || text || chr(34)", "(?s)<think>.*?</think>", ""), "```[a-z]*", ""), "^(Assistant|User): ", "")
    x = d.sub(f"trim({x})", '^"(.*)"$', "$1" if type(d).__name__ == "SparkSQL" else chr(92) + "1")
    return f"SELECT conv_id, turn, {d.sha(x)} AS sha, CAST(length({x}) AS BIGINT) AS n_chars FROM {d.t('conversations')}"
