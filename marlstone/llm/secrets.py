"""Secret scans with an incremental blob ledger.

Every version of a text is a blob, named by the SHA-256 of its bytes. The ledger is a Parquet table that scans append to:
a row holds a blob, the rule versions (``name@version``) it was scanned with, and what they found. A scan takes the
blobs of the given versions, drops the pairs of blob and rule version that the ledger has, reads the text of one
version of each blob that is left, appends the findings, and joins the ledger back to all paths. So a copy, an
unchanged version or a rule that stays costs no scanning.

Nulls count as empty texts; an empty text has no findings and is a blob like others. Rows with equal or null ids are
kept as they are. Texts of any length are read whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches from left to right without overlap; a match counts if ``group`` has ``least`` characters.
    ``needs``: a text without any of these (case as it is, or lower-cased if ``fold``) is not searched."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False
    needs: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    def finder(self):
        find = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0)).finditer
        group, least = self.group, self.least
        return lambda text: [m.span() for m in find(text) if m.end(group) - m.start(group) >= least]


BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, needs=("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", needs=("PRIVATE KEY-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", needs=("eyJ",)),
    Rule("forge", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", needs=("gh", "glpat-")),
    Rule("chat", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("cloud", 1, r"\bAIza[A-Za-z0-9_-]{35}", needs=("AIza",)),
    Rule("login", 1, r"\b[a-z][a-z0-9+.-]*://[^\s/:@]{1,256}:[^\s/:@]{1,256}@", needs=("://",)),
)
RULES = BASE + ADDED

FINDING = "array<struct<rule:string,start:int,end:int>>"
LEDGER = f"blob binary, rules array<string>, findings {FINDING}"


def find_all(text: str, rules: list[Rule], finders: list) -> list[dict]:
    low, out = None, []
    for rule, find in zip(rules, finders, strict=True):
        if rule.needs:
            if rule.fold and low is None:
                low = text.lower()
            if not any(x in (low if rule.fold else text) for x in rule.needs):
                continue
        out += [{"rule": rule.key, "start": a, "end": b} for a, b in find(text)]
    return out


def scan_blobs(todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``todo``: blob, text, pending (rule versions). Gives ledger rows."""
    by_key = {r.key: r for r in rules}
    item = pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("blob", pa.binary()), ("rules", pa.list_(pa.string())), ("findings", pa.list_(item))])

    def run(it):
        finders = {k: r.finder() for k, r in by_key.items()}
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                blobs, texts, pending = (batch.column(i).slice(at, 256).to_pylist() for i in range(3))
                found = [find_all(t or "", [by_key[k] for k in p], [finders[k] for k in p]) for t, p in zip(texts, pending, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(pending, pa.list_(pa.string())), pa.array(found, pa.list_(item))], schema=schema)

    return todo.select("blob", "text", "pending").mapInArrow(run, LEDGER)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan(spark: SparkSession, versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scans what the ledger lacks and returns (path, blob, findings) for each row of ``versions``, findings in order of
    start and then of ``rules``. Findings of rule versions that are not in ``rules`` stay in the ledger and are left out."""
    texts = versions.select(versions[path_col].alias("path"), F.coalesce(versions[text_col], F.lit("")).alias("text"))
    blob = F.unhex(F.sha2(F.col("text"), 256))
    paths = stored(texts.select("path", blob.alias("blob")), "secret-paths")
    keys = F.array(*[F.lit(r.key) for r in rules])
    seen = read_ledger(spark, ledger).select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    first = paths.groupBy("blob").agg(F.min("path").alias("path"))
    first = first.join(seen, "blob", "left").select("blob", "path", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))).alias("pending")).where(F.size("pending") > 0)
    a, b = texts.withColumn("blob", blob).alias("a"), first.hint("shuffle_hash").alias("b")
    todo = a.join(b, F.col("a.path").eqNullSafe(F.col("b.path")) & (F.col("a.blob") == F.col("b.blob"))).select("a.blob", "a.text", "b.pending")
    scan_blobs(todo, rules).write.mode("append").option("compression", "zstd").parquet(ledger)
    order = {r.key: i for i, r in enumerate(rules)}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    found = read_ledger(spark, ledger).where(F.size("findings") > 0).select("blob", F.explode("findings").alias("f")).where(F.col("f.rule").isin(list(order)))
    found = found.select("blob", F.struct(F.col("f.start").alias("start"), rank[F.col("f.rule")].alias("rank"), F.col("f.end").alias("end"), F.col("f.rule").alias("rule")).alias("f"))
    found = found.groupBy("blob").agg(F.array_sort(F.collect_set("f")).alias("findings"))
    return paths.join(found, "blob", "left").select(F.col("path").alias(path_col), "blob", F.coalesce("findings", F.array().cast("array<struct<start:int,rank:int,end:int,rule:string>>")).alias("findings"))


def spelled(findings, rules: tuple[Rule, ...] | None = None):
    """``kind:start:end`` of the findings, of some rules only if given, comma-joined."""
    if rules is not None:
        findings = F.filter(findings, lambda f: f["rule"].isin([r.key for r in rules]))
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", F.substring_index(f["rule"], "@", 1), f["start"], f["end"])), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark, table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    of = lambda key: F.filter("findings", lambda f: f["rule"] == key)
    n = [F.size(of(r.key)).cast("long").alias(f"n_{r.name}") for r in BASE]
    return found.select("doc_id", *n, F.sha2(spelled(F.col("findings"), BASE), 256).alias("base_sha256"), spelled(F.col("findings")).alias("spans"))
