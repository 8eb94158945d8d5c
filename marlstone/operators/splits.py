"""Hold-outs, draws, pairs and training rows. Orders come from SHA-256 of a seed and the row's key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import DuckDB, frame, query
from ..plans.ordering import running


def key(d, seed: str, x: str) -> str:
    """A row's place in a seeded order."""
    return d.sha(f"'{seed}:' || {x}")


@query
def holdout_by_hash(d):
    """A tenth of each source's documents, one at least where there are two."""
    return f"""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {key(d, "hold", "doc_id")}) AS rn, count(*) OVER (PARTITION BY source) AS n FROM {d.t("documents")})
SELECT doc_id, source, CASE WHEN n > 1 AND rn <= greatest(1, floor(n * 0.1 + 0.5)) THEN 'held' ELSE 'train' END AS split FROM r"""


@query
def quota_draw(d):
    """Twelve of each language: up to six of good quality, the rest others; each fills in for the other."""
    return f"""
WITH r AS (SELECT t.doc_id, t.lang, l.quality, row_number() OVER (PARTITION BY t.lang, l.quality ORDER BY {key(d, "draw", "t.doc_id")}) AS rn FROM {d.t("documents")} t JOIN {d.t("labels")} l ON t.doc_id = l.doc_id),
n AS (SELECT lang, count(CASE WHEN quality = 1 THEN 1 END) AS good, count(CASE WHEN quality = 0 THEN 1 END) AS other FROM r GROUP BY lang),
q AS (SELECT lang, good, other, least(greatest(12 - other, least(6, good)), good) AS want_good FROM n)
SELECT r.doc_id, r.lang, r.quality FROM r JOIN q ON r.lang = q.lang WHERE (r.quality = 1 AND r.rn <= q.want_good) OR (r.quality = 0 AND r.rn <= least(q.other, 12 - q.want_good))"""


@query
def seeded_sample(d):
    """A hundred documents in seeded order, blind names, and which side of a pair each is shown on."""
    return f"""
SELECT doc_id, 'item-' || substr({key(d, "blind", "doc_id")}, 1, 10) AS blind, CASE WHEN {d.hexint("substr(" + key(d, "side", "doc_id") + ", 1, 8)")} % 2 = 0 THEN 'X' ELSE 'Y' END AS side
FROM (SELECT doc_id, row_number() OVER (ORDER BY {key(d, "sample", "doc_id")}) AS rn FROM {d.t("documents")}) x WHERE rn <= 100"""


def balanced_mix_sql(d) -> str:
    return f"""
WITH u AS (SELECT t.doc_id, row_number() OVER (ORDER BY {key(d, "mix", "t.doc_id")}) AS rn FROM {d.t("documents")} t LEFT JOIN {d.t("labels")} l ON t.doc_id = l.doc_id WHERE l.doc_id IS NULL)
SELECT doc_id, 'format' AS part FROM {d.t("labels")} UNION ALL SELECT doc_id, 'general' FROM u WHERE rn <= (SELECT count(*) FROM {d.t("labels")})"""


def budget_roster_sql(d) -> str:
    return f"""
WITH r AS (SELECT doc_id, 2.0 + ceil(length(text) / 500.0) AS cost, {key(d, "roster", "doc_id")} AS k FROM {d.t("documents")}), s AS (SELECT doc_id, sum(cost) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent, row_number() OVER (ORDER BY k) AS place FROM r)
SELECT doc_id, CAST(place AS INTEGER) AS place, CAST(spent AS DOUBLE) AS spent FROM s WHERE spent <= 1800"""


@query
def goldfish_mask(d):
    """Words of a turn whose thirteen predecessors hash to a multiple of four, which a loss would leave out."""
    from ..functions.text import words

    return f"""
WITH t AS (SELECT conv_id, turn, {words(d, "text")} AS w FROM {d.t("conversations")}), g AS (SELECT conv_id, turn, {d.size("w")} AS n, {d.grams("w", 13)} AS g FROM t), one AS ({d.unnest("conv_id, turn, n", "g", "g", "pos", "gram")})
SELECT conv_id, turn, n AS n_words, CAST(sum(CASE WHEN pos + 13 < n AND {d.hexint("substr(" + d.sha("gram") + ", 1, 8)")} % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS dropped FROM one GROUP BY conv_id, turn, n""".replace("n AS n_words", "CAST(n AS BIGINT) AS n_words")


@query
def blind_packet(d):
    """Items in shuffled order with opaque ids, apart from the key that names them."""
    return f"""
WITH x AS (SELECT item_id, row_number() OVER (ORDER BY {key(d, "packet", "item_id")}) AS place, {d.sha("text")} AS sha FROM {d.t("benchmark")})
SELECT CAST(place AS INTEGER) AS place, 'p' || lpad(CAST(place AS VARCHAR(9)), 4, '0') AS opaque, item_id, sha FROM x"""


def ordered(spark: SparkSession, sf_dir: str, seed: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumn("k", F.sha2(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")), 256))


def mixed(special: DataFrame, general: DataFrame, order: str) -> DataFrame:
    """Both as one table with ``part``: all of the special rows, and as many general ones, in order."""
    n = special.count()
    some = running(general, [order]).where(F.col("place") <= n).drop("place", order)
    return special.withColumn("part", F.lit("format")).unionByName(some.withColumn("part", F.lit("general")))


@frame(balanced_mix_sql(DuckDB()))
def balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many unlabelled documents as labelled ones, in seeded order."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    return mixed(labels, ordered(spark, sf_dir, "mix").select("doc_id", "k").join(labels, "doc_id", "left_anti"), "k")


@frame(budget_roster_sql(DuckDB()))
def budget_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most documents, in seeded order, whose projected cost (two seconds and a second for 500 characters each) fits half an hour."""
    rows = ordered(spark, sf_dir, "roster").select("doc_id", "k", (2.0 + F.ceil(F.length("text") / 500)).alias("cost"))
    found = running(rows, ["k"], "cost").where("total <= 1800")
    return found.select("doc_id", F.col("place").cast("int").alias("place"), F.col("total").cast("double").alias("spent"))


def packed_in_order(docs: DataFrame, by: str, order: str, size: str, limit: int) -> DataFrame:
    """(by, order, block): rows joined in order up to ``limit``; a larger one has a block of its own. One task a group, which
    holds keys and sizes only, as each block begins where the last one ended."""
    from itertools import accumulate

    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        step = lambda s, n: (s[0], s[1] + n) if not s[1] or s[1] + n <= limit else (s[0] + 1, n)
        blocks = [b for b, _ in accumulate(pdf[size].tolist(), step, initial=(0, 0))][1:]
        return pd.DataFrame({by: pdf[by], order: pdf[order], "block": blocks})

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(by, order, size).groupBy(by).applyInPandas(fold, f"{by} {kinds[by]}, {order} {kinds[order]}, block int")


@frame("""
WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
w AS (SELECT source, doc_id, n, 0 AS block, n_chars AS used FROM d WHERE n = 1 UNION ALL SELECT d.source, d.doc_id, d.n, CASE WHEN w.used > 0 AND w.used + d.n_chars > 6000 THEN w.block + 1 ELSE w.block END, CASE WHEN w.used > 0 AND w.used + d.n_chars > 6000 THEN d.n_chars ELSE w.used + d.n_chars END FROM w JOIN d ON d.source = w.source AND d.n = w.n + 1)
SELECT source, doc_id, block::INT AS block FROM w""")
def greedy_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source joined in order up to 6,000 characters."""
    return packed_in_order(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source", "doc_id", "n_chars", 6000)


@frame("""
WITH c AS (SELECT lang, doc_id, sha256('cover:' || doc_id) AS k, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('cover:' || doc_id)) AS n FROM documents)
SELECT lang, doc_id, place::INT AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n, k) AS place FROM c) x WHERE place <= 40""")
def coverage_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language, forty documents drawn so that each pick's source was used least so far, ties by hash. Candidates are first cut to forty a source, beyond which no draw can reach."""
    import pandas as pd
    from pyspark.sql import Window

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "doc_id", F.sha2(F.concat(F.lit("cover:"), F.col("doc_id").cast("string")), 256).alias("k"))
    cut = docs.withColumn("n", F.row_number().over(Window.partitionBy("lang", "source").orderBy("k"))).where("n <= 40")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "k"]).head(40)  # the n-th of a source is drawn once all others had n - 1
        return pd.DataFrame({"lang": pdf["lang"], "doc_id": pdf["doc_id"], "place": range(1, len(pdf) + 1)})

    return cut.groupBy("lang").applyInPandas(draw, "lang string, doc_id long, place int")
