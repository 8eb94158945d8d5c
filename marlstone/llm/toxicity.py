"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Words become symbols: insult, threat, target (the second person), negation, reporting verb, quotation mark, other. Five
small transducers read the symbols of a clause: one counts insults, one threats, one sees whether somebody is addressed,
one whether what comes next is negated, one whether it is reported or quoted. They are composed: a state of the whole is
a state of each, made when first needed. Its outputs sort the weights of a clause's matches into kinds (plain, addressed,
negated, reported, and threats with and without a target), and FACTORS says what a kind counts: an insult at somebody
more than one about somebody, a negated or reported one little, a threat nothing without a target. A text's score is a
logistic function that grows with the sum over its clauses, and with that sum for each word; so negating or quoting a
clause always lowers the score.

The insult lexicon is learned: of a bounded sample of labelled texts (FIT_ROWS rows, in hash order), words and word
beginnings are counted by document and label; those that toxic documents hold far more often become stems weighted by
their log-odds. Function-word lists (targets, negations, reporting and threatening verbs) are fixed for four languages.
Neither ids nor language, source or labels enter a score.

Nulls count as empty; an empty text has no clauses and a score like other texts without any; texts of any length are
read whole. Labels that are null are not used; several labels of a row count as toxic if one does. Without any labels of
both kinds nothing is toxic. Repeated rows are scored each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored, table, takes_turn

#: Labelled rows of either label that a fit reads at most, least toxic documents of a stem, least log-odds.
FIT_ROWS, SUPPORT, ODDS = 10_000, 4, 2.0
PREFIXES = range(4, 9)

# Function words of English, German, French and Spanish.
TARGETS = "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
NEGATIONS = "not no never nobody none isn't aren't don't doesn't nicht kein keine keinen nie niemals ne pas jamais aucun aucune nunca jamás ningún ninguna".split()
REPORTS = "said says say saying claimed claims wrote writes reported reports quoted called sagte sagt sagen schrieb behauptet behauptete nannte dit disait écrit affirme appelé dijo dice decía escribió afirma llamó".split()
THREATS = "kill hurt destroy murder stab shoot beat burn töten umbringen verletzen schlagen verbrennen tuer frapper détruire brûler matar golpear destruir quemar".split()
QUOTES = "\"'“”„«»‘’"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
FIXED = {w: s for s, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in words}
KINDS = ("plain", "addressed", "negated", "reported", "threat", "soft_threat")
#: The weights of the grammar: what a match of each kind counts.
FACTORS = (1.0, 1.5, 0.15, 0.15, 3.0, 0.0)
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”„«»]")
CLAUSE = re.compile(r"[.;:!?\n\r]+|,(?=\s)")
#: Words that a negation reaches.
REACH = 3


class Machine:
    """A deterministic transducer over symbols: arcs (state, symbol) to (state, output); a missing arc stays, with no output."""

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, int]]):
        self.arcs = arcs

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), (state, 0))


def machines() -> tuple[Machine, ...]:
    insults = Machine({(0, INSULT): (0, 1)})
    threats = Machine({(0, THREAT): (0, 1)})
    target = Machine({(0, TARGET): (1, 1), (1, TARGET): (1, 1)} | {(1, s): (1, 1) for s in (OTHER, INSULT, THREAT, NEGATION, REPORT, QUOTE)})
    negation = {(0, NEGATION): (REACH, 0)}
    for left in range(1, REACH + 1):
        negation |= {(left, s): (left - 1, 1) for s in (OTHER, INSULT, THREAT, TARGET, REPORT, QUOTE)} | {(left, NEGATION): (REACH, 1)}
    reported = {(0, REPORT): (1, 0), (0, QUOTE): (2, 0), (2, QUOTE): (0, 1), (1, QUOTE): (1, 1)}
    reported |= {(q, s): (q, 1) for q in (1, 2) for s in (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT)}
    return insults, threats, target, Machine(negation), Machine(reported)


class Composed:
    """All machines on one input; states are made lazily. Output of a step: (insult, threat, addressed, negated, reported)."""

    def __init__(self, parts: tuple[Machine, ...]):
        self.parts, self.known = parts, {}
        self.start = (0,) * len(parts)

    def step(self, state: tuple, symbol: int) -> tuple[tuple, tuple]:
        got = self.known.get((state, symbol))
        if got is None:
            each = [m.step(q, symbol) for m, q in zip(self.parts, state, strict=True)]
            got = self.known[state, symbol] = tuple(q for q, _ in each), tuple(o for _, o in each)
        return got


class Grammar:
    def __init__(self, stems: dict[str, float]):
        self.stems, self.composed = stems, Composed(machines())
        self.longest = max(map(len, stems), default=0)
        self.seen: dict[str, tuple[int, float]] = {}

    def cue(self, word: str) -> tuple[int, float]:
        """Symbol and weight of a lower-cased word."""
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            bare = word.replace("’", "'")
            weight = max((w for n in PREFIXES if n < len(bare) and (w := self.stems.get(bare[:n] + "*"))), default=0.0)
            weight = max(weight, self.stems.get(bare, 0.0))
            got = self.seen[word] = (INSULT, weight) if weight else (FIXED.get(bare, QUOTE if bare in QUOTES else OTHER), 1.0)
        return got

    def clause(self, words: list[str]) -> list[float]:
        """Weights by kind of one clause; nothing if no insult or threat is in it."""
        cues = [self.cue(w) for w in words]
        out = [0.0] * len(KINDS)
        if not any(s in (INSULT, THREAT) for s, _ in cues):
            return out
        state, marks, addressed = self.composed.start, [], False
        for symbol, weight in cues:
            state, (insult, threat, target, negated, reported) = self.composed.step(state, symbol)
            addressed = addressed or bool(target)
            if insult or threat:
                marks.append((insult, weight, negated, reported))
        for insult, weight, negated, reported in marks:
            if insult:
                out[2 if negated else 3 if reported else 1 if addressed else 0] += weight
            else:
                out[4 if addressed and not negated and not reported else 5] += 1.0
        return out

    def kinds(self, text: str) -> list[float]:
        """Weights by kind of all clauses, and the number of words."""
        low = text.lower()
        words = low.split()
        out = [0.0] * len(KINDS)
        own = self.cue
        if any(own(w)[0] in (INSULT, THREAT) for w in set(WORD.findall(" ".join(set(words))))):
            for part in CLAUSE.split(low):
                for i, x in enumerate(self.clause(WORD.findall(part))):
                    out[i] += x
        return [*out, float(len(words))]


def vector(kinds: list[float]) -> list[float]:
    """What the regression sees; all but the constant grow with the weight of the matched clauses."""
    weight = sum(f * x for f, x in zip(FACTORS, kinds, strict=False))
    return [1.0, math.log1p(weight), math.sqrt(weight / max(kinds[-1], 1.0))]


def rising(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic weights, none but the constant below zero: columns that would get such are left out one by one."""
    use = list(range(x.shape[1]))
    while True:
        w = logistic(x[:, use], y)
        low = min(range(1, len(use)), key=lambda i: w[i], default=0)
        if not low or w[low] >= 0:
            break
        del use[low]
    out = [0.0] * x.shape[1]
    for i, v in zip(use, w.tolist(), strict=True):
        out[i] = v
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1.0, len(y) / 1000))
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def features_of(text: str) -> set[str]:
    """Words and word beginnings of a document."""
    words = {w for w in WORD.findall(text.lower()) if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if n < len(w)}


def sample(labelled: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``labelled`` (id, toxic): at most ``rows`` of each label, in an order that a hash of the id gives."""
    each = [labelled.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(rows) for k in (0, 1)]
    return each[0].unionByName(each[1])


def fit(texts: DataFrame, labelled: DataFrame, rows: int = FIT_ROWS) -> tuple[dict[str, float], list[float]]:
    """Stems and regression weights from ``texts`` (id, text) and ``labelled`` (id, toxic 0/1)."""
    chosen = F.broadcast(sample(labelled, rows))  # 2 * rows ids and labels at most
    own = stored(texts.join(chosen, "id").select("text", "toxic"), "toxicity-sample")

    def count(it):
        met = {0: Counter(), 1: Counter()}
        takes_turn("toxicity", lambda: None)
        for batch in it:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                met[toxic].update(features_of(text or ""))
                if len(met[0]) + len(met[1]) > 300_000:
                    yield from flushed(met)
        yield from flushed(met)

    def flushed(met):
        keys = list(met[1].keys() | met[0].keys())
        for at in range(0, len(keys), 20_000):
            part = keys[at : at + 20_000]
            yield pa.RecordBatch.from_pydict({"stem": part, "n1": pa.array([met[1][k] for k in part], pa.int64()), "n0": pa.array([met[0][k] for k in part], pa.int64())})
        met[0].clear()
        met[1].clear()

    totals = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return {}, []
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    each = own.mapInArrow(count, "stem string, n1 long, n0 long").groupBy("stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    best = each.where(F.col("n1") >= SUPPORT).withColumn("odds", odds).where(F.col("odds") >= ODDS)  # of 2 * rows texts
    stems = {r["stem"]: r["odds"] for r in best.collect()}
    shape = len(vector([0.0] * (len(KINDS) + 1)))

    def see(it):
        g = Grammar(stems)
        takes_turn("toxicity", g.seen.clear)
        for batch in it:
            xs = [vector(g.kinds(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    seen = own.mapInArrow(see, "x array<double>, y int").toPandas()  # 2 * rows short vectors at most
    x, y = np.array(seen["x"].tolist(), float).reshape(-1, shape), seen["y"].to_numpy(float)
    return stems, rising(x, y)


def score(df: DataFrame, model: tuple[dict[str, float], list[float]], id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, [carried columns,] score) of each row. A model without weights scores 0."""
    stems, weights = model
    shared = df.sparkSession.sparkContext.broadcast((stems, weights))  # stems of a bounded sample
    cols = df.select(df[id_col], *[df[c] for c in carry], df[text_col].alias("__text"))
    fields = cols.schema.fields[:-1]
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields] + [("score", pa.float64())])

    def run(it):
        stems, weights = shared.value
        g, w = Grammar(stems), np.array(weights)
        takes_turn("toxicity", g.seen.clear)
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(part.num_columns - 1).to_pylist()
                z = np.array([vector(g.kinds(t or "")) for t in texts]) @ w if len(w) else np.full(len(texts), -np.inf)
                with np.errstate(over="ignore"):
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(1 / (1 + np.exp(-z)))], schema=schema)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    return cols.mapInArrow(run, ddl)


def held_out(column):
    """Rows that no fit sees."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(spark: SparkSession, sf_dir: str) -> tuple[dict[str, float], list[float]]:
    """The model from the labelled documents that are not held out."""
    labels = table(spark, sf_dir, "labels").where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return fit(texts, labels.where(~held_out(F.col("id"))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), fitted(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
