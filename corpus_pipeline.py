"""The training-data pipeline: documents without toxic ones, repeated lines, near copies and personal data, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder as Parquet and
reads again for the next. All but the last return the columns of documents, with n_chars brought up to date.

For every stage: null texts are kept as they are and empty ones, too (packing takes both as texts of the end token alone);
texts of any length are taken whole; repeated rows are rows like others, of which the near-copy stage keeps one; rows
without an id are kept unless they are toxic or copies; ties fall by id and then by the hash of the text; other columns of
``docs``, whatever their names, are left out; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import lines, neardup, packing, privacy, toxicity
from marlstone.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't express learned scores, sketches and tokens; tests/llm/test_pipeline.py holds run() against plain versions.
ORACLE_SQL = None


def of_documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go. The model is learned from the labelled documents of ``sf_dir``."""
    model = toxicity.fitted(spark, sf_dir)
    text = F.col("text").alias("kept_text")
    scored = toxicity.score(docs.select(*COLUMNS, text), model, "doc_id", "kept_text", carry=COLUMNS[1:])
    return scored.where("score < 0.5").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go, and documents that lost lines and of which only white space is left."""
    found = lines.dedup(docs.select(*COLUMNS))
    return of_documents(found.where((F.size("gone") == 0) | F.col("text").rlike(r"\S")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more stays, that of the least id; texts without words all stay."""
    return neardup.keep_one(docs.select(*COLUMNS))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by surrogates; no document goes."""
    return of_documents(privacy.pseudonymise(docs.select(*COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4,096 tokens: a row for each piece of a document, with its sequence and place."""
    import public_tokenizers as P

    return packing.pack_documents(docs, P.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near-dedup", without_near_copies),
    ("privacy", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
