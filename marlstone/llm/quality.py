"""Quality rules: fixed base rules, and robust multivariate outliers by language and source.

One pass over the texts counts words, characters and repeats. Documents that pass the base rules get a vector of
transformed statistics. Minimum-covariance-determinant estimates of its centre and spread are made for each language and
source, each language, and all documents: of all halves of a group's rows, the one whose covariance has the least
determinant, searched for from several deterministic starts by concentration steps until none lowers it, and weighed by
a quantile afterwards. A group of up to UNIT rows is searched in one task. A larger one is dealt out into units of that
size: the best of up to SUBSETS units are the starts, and further steps sum over all of its units, so that a group that
holds a third of all rows is never in one task.

A document is rejected if its Mahalanobis distance under its own group is beyond the group's cut: the distance that one
sound document of a million exceeds in normal data, widened by as much as the lower quarter of the group's own distances
is wider than in normal data. Up to half of a group may be junk. A group of fewer than SMALL rows takes its language's
estimates, and a small language those of all documents.

Nulls in text count as empty; null language or source is a group like another; an empty text has no words and fails the
base rules; texts of any length are counted whole. Ties at a quantile stay in. Repeated rows count each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored, table, takes_turn

#: The share of rows that a concentration step keeps; the tail that the cut leaves of normal data; rows of a unit, and units that give starts.
H, TAIL, UNIT, SUBSETS = 0.5, 1e-6, 2_500, 10
#: Standard deviations below this say nothing: most features are zero in most documents. A sound document may repeat a line.
FLOOR, FLOORS = 0.04, {"dup_lines": 0.15, "repeats": 0.15}
#: Groups that are broadcast (some 500 bytes each); beyond, rows are joined with them.
GROUPS = 100_000
#: Distances are counted in bins of a 32nd of a doubling.
BINS, ZERO = 2_560, 40
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "variety", "capitals", "marks")
#: Least rows of a group: ten for each feature.
SMALL = 10 * len(FEATURES)
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
CAPITALS = bytes(range(65, 91))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def chi2_quantile(p: float, k: int) -> float:
    """The value that a chi-squared variable of ``k`` degrees exceeds with chance 1 - p, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def chi2_cdf(x: float, k: int) -> float:
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    if z < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= z / n
            total += term
        return total * math.exp(-z + a * math.log(z) - math.lgamma(a))
    return 1 - chi2_tail(x, k)


def chi2_tail(x: float, k: int) -> float:
    """1 - chi2_cdf for large x, by a continued fraction."""
    a, z = k / 2, x / 2
    b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return math.exp(-z + a * math.log(z) - math.lgamma(a)) * h


def counts(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the features."""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, SPACES)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    dup = len(lines) - len(set(lines))
    repeats = 0
    if n >= 3:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(grams)) < len(grams):
            often = {g for g, c in Counter(grams).items() if c > 1}
            last = -1  # the last word counted so far
            for i, g in enumerate(grams):
                if g in often:
                    repeats += i + 2 - max(last, i - 1)
                    last = i + 2
    if not n:
        return (0, 0, symbols, dup, 0, *[0.0] * len(FEATURES))
    capitals = len(data) - len(data.translate(None, CAPITALS))
    marks = len(data) - len(data.translate(None, MARKS))
    variety = math.log(len(set(words))) / math.log(n) if n > 1 else 1.0
    return n, chars, symbols, dup, repeats, math.log(chars / n), math.sqrt(symbols / n), math.sqrt(dup / len(lines)), math.sqrt(repeats / n), variety, math.sqrt(capitals / n), math.sqrt(marks / n)


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each document: (id, lang, source, counts, base_failed, features)."""
    kind = df.schema[id_col].dataType
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("lang", pa.string()), ("source", pa.string()), *((c, pa.int64()) for c in names), *((c, pa.float64()) for c in FEATURES)])

    def run(it):
        takes_turn("quality", lambda: None)
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [counts(t or "") for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), list(schema)[3:], strict=True))], schema=schema)

    ddl = f"{id_col} {kind.simpleString()}, lang string, source string, {', '.join(f'{c} long' for c in names)}, {', '.join(f'{c} double' for c in FEATURES)}"
    own = df.select(df[id_col], df[lang_col].cast("string"), df[source_col].cast("string"), df[text_col]).mapInArrow(run, ddl)
    return own.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


GROUP = ["level", "g_lang", "g_source"]


def levels(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Each row once for its source, its language and all; (level, g_lang, g_source) name the group, null-safe. ``row`` is a number."""
    text = lambda c: F.concat(F.lit("="), F.col(c))
    lang, source = F.coalesce(text("lang"), F.lit("null")), F.coalesce(text("source"), F.lit("null"))
    group = lambda n, a, b: F.struct(F.lit(n).alias("level"), a.alias("g_lang"), b.alias("g_source"))
    every = F.array(group(0, lang, source), group(1, lang, F.lit("")), group(2, F.lit(""), F.lit("")))
    return rows.withColumn("row", F.monotonically_increasing_id()).select(F.explode(every).alias("g"), "row", *features).select("g.*", "row", *features)


def floors(features: tuple[str, ...]) -> np.ndarray:
    return np.array([FLOORS.get(c, FLOOR) for c in features])


def squared(x: np.ndarray, centre: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances."""
    z = np.linalg.solve(np.linalg.cholesky(cov), (x - centre).T)
    return (z * z).sum(axis=0)


def starts(x: np.ndarray, least: np.ndarray):
    """Distances by rough robust estimates: medians, spatial signs, the inner half, and ranks."""
    p = x.shape[1]
    centre = np.median(x, axis=0)
    z = (x - centre) / np.maximum(1.4826 * np.median(np.abs(x - centre), axis=0), least)
    length = np.linalg.norm(z, axis=1)
    yield length**2
    signs = z / np.maximum(length, 1e-9)[:, None]
    yield squared(z, np.zeros(p), signs.T @ signs / len(z) * p + 1e-3 * np.eye(p))
    inner = x[np.argsort(length, kind="stable")[: len(x) // 2 + 1]]
    yield squared(x, inner.mean(axis=0), np.cov(inner.T, bias=True).reshape(p, p) + np.diag(least**2))
    ranks = np.stack([(np.searchsorted(s := np.sort(c), c, "left") + np.searchsorted(s, c, "right")) / 2 for c in x.T], axis=1) - len(x) / 2
    ranks = ranks / np.maximum(ranks.std(axis=0), 1e-9)
    yield squared(z, np.zeros(p), 0.9 * ranks.T @ ranks / len(x) + 0.1 * np.eye(p))


def half(n: int) -> int:
    return n // 2 + 1 if n > 1 else n


def moments(x: np.ndarray, least: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Logarithm of the determinant, centre and covariance with floors."""
    centre = x.mean(axis=0)
    cov = (x - centre).T @ (x - centre) / len(x) + np.diag(least**2)
    return float(np.linalg.slogdet(cov)[1]), centre, cov


def search(x: np.ndarray, least: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """What concentration steps come to from each start, the least determinant first."""
    k, out = half(len(x)), []
    for d in starts(x, least):
        now = (math.inf, None, None)
        while True:
            new = moments(x[d <= np.partition(d, k - 1)[k - 1]], least)
            if not new[0] < now[0] - 1e-9:
                break
            now, d = new, squared(x, new[1], new[2])
        out.append(now)
    return sorted(out, key=lambda e: e[0])


def consistent(cov: np.ndarray, least: np.ndarray, share: float) -> np.ndarray:
    """The covariance of the rows within a quantile of the distances, made that of all in normal data; floors are left as they are."""
    p = len(least)
    return (cov - np.diag(least**2)) * (share / chi2_cdf(chi2_quantile(share, p), p + 2)) + np.diag(least**2)


WEIGHED = 0.975


def cut_of(quarter: float, p: int) -> float:
    """The cut for the lower quartile of a group's squared distances."""
    return math.sqrt(chi2_quantile(1 - TAIL, p) * max(1.0, quarter / chi2_quantile(0.25, p)))


def finished(x: np.ndarray, least: np.ndarray, best: tuple) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, covariance and cut after weighing, for a group in one unit."""
    p = len(least)
    d = squared(x, best[1], consistent(best[2], least, H))
    _, centre, cov = moments(x[(d <= chi2_quantile(WEIGHED, p)) | (d <= np.partition(d, half(len(x)) - 1)[half(len(x)) - 1])], least)
    cov = consistent(cov, least, WEIGHED)
    return centre, cov, cut_of(float(np.quantile(squared(x, centre, cov), 0.25)), p)


def bins_of(d: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.floor((np.log2(d) + ZERO) * 32), 0, BINS - 1).astype(np.int64)


def edge_of(b: int) -> float:
    """The upper end of a bin."""
    return 2.0 ** ((b + 1) / 32 - ZERO)


def sized(df: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """``df`` joined with its groups' rows, of which there are ``n``; null-free keys."""
    return df.join(F.broadcast(groups) if n <= GROUPS else groups, GROUP)


def dealt(rows: DataFrame, features: tuple[str, ...]) -> tuple[DataFrame, int]:
    """(group, unit, units, size, x, found): the rows of each unit as one value, what a search in it finds if it is one
    of the first, and centre, covariance and cut if the unit is the whole group; and the number of groups."""
    p, least = len(features), floors(features)
    each = levels(rows, features)
    sizes = stored(each.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("size")), "mcd-sizes")
    n = sizes.count()
    units = sized(each, sizes.withColumn("units", F.ceil(F.col("size") / UNIT).cast("int")), n).withColumn("unit", F.pmod(F.xxhash64("row"), F.col("units")).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[list(features)].to_numpy(float)
        first = pdf.iloc[0]
        found = search(x, least) if first["unit"] < SUBSETS else []
        last = finished(x, least, found[0]) if first["units"] == 1 else None
        flat = [[e[0], *e[1].tolist(), *e[2].ravel().tolist()] for e in found[:1]]
        return pd.DataFrame([(*(first[c] for c in GROUP), first["unit"], first["units"], first["size"], x.tobytes() if last is None else b"", flat, None if last is None else [*last[0].tolist(), *last[1].ravel().tolist(), last[2]])], columns=[*GROUP, "unit", "units", "size", "x", "found", "last"])

    schema = "level int, g_lang string, g_source string, unit int, units int, size long, x binary, found array<array<double>>, last array<double>"
    return stored(units.groupBy(*GROUP, "unit").applyInPandas(run, schema), "mcd-units"), n


def counted(units: DataFrame, now: DataFrame, n: int, p: int, shares: dict[int, float]) -> DataFrame:
    """``now`` (group, c, e, ...) with ``edge``: the end of the bin within which each estimate has a share of the group's rows."""

    def run(it):
        for pdf in it:
            rows = []
            for r in pdf.itertuples(index=False):
                x, e = np.frombuffer(r.x).reshape(-1, p), np.asarray(r.e)
                b, k = np.unique(bins_of(squared(x, e[:p], e[p : p + p * p].reshape(p, p))), return_counts=True)
                rows += [(r.level, r.g_lang, r.g_source, r.c, int(i), int(j)) for i, j in zip(b, k, strict=True)]
            yield pd.DataFrame(rows, columns=[*GROUP, "c", "bin", "k"])

    found = sized(units, now.select(*GROUP, "c", "e"), n).select(*GROUP, "c", "x", "e").mapInPandas(run, "level int, g_lang string, g_source string, c int, bin int, k long")
    each = found.groupBy(*GROUP, "c", "bin").agg(F.sum("k").alias("k"))
    below = Window.partitionBy(*GROUP, "c").orderBy("bin")  # BINS rows at most
    cum = each.withColumn("cum", F.sum("k").over(below)).withColumn("all", F.sum("k").over(Window.partitionBy(*GROUP, "c")))
    ends = [F.min(F.when(F.col("cum") >= F.col("all") * share, F.col("bin"))).alias(f"bin{i}") for i, share in shares.items()]
    return now.join(cum.groupBy(*GROUP, "c").agg(*ends), [*GROUP, "c"])


def summed(units: DataFrame, now: DataFrame, n: int, least: np.ndarray, most) -> DataFrame:
    """(group, c, e): determinant, centre and covariance of the rows whose squared distance is up to ``most`` (a column of ``now``)."""
    p = len(least)

    def run(it):
        for pdf in it:
            rows = []
            for r in pdf.itertuples(index=False):
                x, e = np.frombuffer(r.x).reshape(-1, p), np.asarray(r.e)
                x = x[squared(x, e[:p], e[p : p + p * p].reshape(p, p)) <= r.most] - e[:p]  # about the centre, for precision
                rows.append((r.level, r.g_lang, r.g_source, r.c, len(x), *x.sum(axis=0), *(x.T @ x).ravel()))
            yield pd.DataFrame(rows, columns=[*GROUP, "c", "k", *names])

    names = [f"s{i}" for i in range(p + p * p)]
    schema = "level int, g_lang string, g_source string, c int, k long, " + ", ".join(f"{c} double" for c in names)
    found = sized(units, now.select(*GROUP, "c", "e", most.alias("most")), n).select(*GROUP, "c", "x", "e", "most").mapInPandas(run, schema)
    sums = found.groupBy(*GROUP, "c").agg(F.sum("k").alias("k"), F.array(*[F.sum(c) for c in names]).alias("sums")).join(now.select(*GROUP, "c", F.col("e").alias("old")), [*GROUP, "c"])

    def solve(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                k, sums = max(r.k, 1), np.asarray(r.sums)
                mean = sums[:p] / k
                cov = sums[p:].reshape(p, p) / k - np.outer(mean, mean) + np.diag(least**2)
                out.append((r.level, r.g_lang, r.g_source, r.c, [*(mean + np.asarray(r.old)[:p]).tolist(), *cov.ravel().tolist(), float(np.linalg.slogdet(cov)[1])]))
            yield pd.DataFrame(out, columns=[*GROUP, "c", "e"])

    return sums.mapInPandas(solve, "level int, g_lang string, g_source string, c int, e array<double>")


def scaled(df: DataFrame, least: np.ndarray, share: float) -> DataFrame:
    """Estimates made consistent for the share of rows they were made of."""
    p = len(least)

    def run(it):
        for pdf in it:
            pdf["e"] = [[*e[:p], *consistent(np.asarray(e[p : p + p * p]).reshape(p, p), least, share).ravel().tolist()] for e in pdf["e"]]
            yield pdf

    return df.mapInPandas(run, df.schema)


def fit(rows: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Estimates (level, g_lang, g_source, size, centre, white, cut) of all groups of ``rows`` (lang, source, features);
    white is a whitening matrix, flat. ``rows`` is to be a stored table: it is numbered."""
    p, least = len(features), floors(features)
    dealt_units, n = dealt(rows, features)
    large = dealt_units.where("units > 1")
    small = dealt_units.where("units = 1").select(*GROUP, "size", F.col("last").alias("e"))
    if not large.limit(1).count():
        return whitened(small, p)
    units = large.select(*GROUP, "x")
    first = F.array_sort(F.collect_list(F.struct(F.col("found")[0][0].alias("det"), F.col("unit").alias("c"), F.col("found")[0].alias("e"))))
    firsts = large.where(F.size("found") > 0).groupBy(*GROUP).agg(first.alias("all")).select(*GROUP, F.explode(F.slice("all", 1, SUBSETS // 2)).alias("s"))
    rest = F.slice("s.e", 2, p + p * p)
    now = stored(firsts.select(*GROUP, "s.c", rest.alias("e"), F.lit(math.inf).alias("det")), "mcd-starts")
    best = None
    while True:  # determinants fall with every step, by a thousandth at least
        step = summed(units, counted(units, now, n, p, {0: H}), n, least, F.pow(F.lit(2.0), (F.col("bin0") + 1) / F.lit(32.0) - ZERO))
        new = step.select(*GROUP, "c", F.slice("e", 1, p + p * p).alias("e"), F.element_at("e", -1).alias("new"))
        new = stored(now.select(*GROUP, "c", "det").join(new, [*GROUP, "c"]).where("new < det - 0.001").select(*GROUP, "c", "e", F.col("new").alias("det")), "mcd-step")
        best = new if best is None else stored(best.unionByName(new).groupBy(*GROUP).agg(F.min_by(F.struct("c", "e", "det"), F.struct("det", "c")).alias("b")).select(*GROUP, "b.*"), "mcd-best")
        if not new.limit(1).count():
            break
        now = new
    raw = scaled(best.groupBy(*GROUP).agg(F.min_by("e", F.struct("det", "c")).alias("e")).withColumn("c", F.lit(0)), least, H)
    raw = stored(raw, "mcd-raw")
    near = counted(units, raw, n, p, {0: H})
    most = F.greatest(F.lit(chi2_quantile(WEIGHED, p)), F.pow(F.lit(2.0), (F.col("bin0") + 1) / F.lit(32.0) - ZERO))
    weighed = stored(scaled(summed(units, near, n, least, most).select(*GROUP, "c", "e"), least, WEIGHED), "mcd-weighed")
    quarter = F.pow(F.lit(2.0), (F.col("bin0") + F.lit(0.5)) / F.lit(32.0) - ZERO)
    cut = F.sqrt(F.lit(chi2_quantile(1 - TAIL, p)) * F.greatest(F.lit(1.0), quarter / F.lit(chi2_quantile(0.25, p))))
    done = counted(units, weighed, n, p, {0: 0.25}).select(*GROUP, F.concat("e", F.array(cut)).alias("e"))
    sizes = large.groupBy(*GROUP).agg(F.max("size").alias("size"))
    return whitened(small.unionByName(done.join(sizes, GROUP).select(*GROUP, "size", "e")), p)


def whitened(df: DataFrame, p: int) -> DataFrame:
    def run(it):
        for pdf in it:
            e = [np.asarray(x) for x in pdf["e"]]
            pdf["centre"] = [x[:p].tolist() for x in e]
            pdf["white"] = [np.linalg.inv(np.linalg.cholesky(x[p : p + p * p].reshape(p, p))).ravel().tolist() for x in e]
            pdf["cut"] = [float(x[-1]) for x in e]
            yield pdf.drop(columns="e")

    return df.mapInPandas(run, "level int, g_lang string, g_source string, size long, centre array<double>, white array<double>, cut double")


def distance(features: tuple[str, ...]):
    """Squared Mahalanobis distance by the columns centre (array) and white (rows of a whitening matrix, flat)."""
    p = len(features)
    diff = [F.col(c) - F.col("centre")[i] for i, c in enumerate(features)]
    total = F.lit(0.0)
    for i in range(p):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col("white")[i * p + j] * diff[j]
        total = total + part * part
    return total


def verdicts(stats: DataFrame, small: int = SMALL, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """``stats`` (stored) with distance (null if base_failed) and kept."""
    fitted = stored(fit(stats.where(~F.col("base_failed")), features), "mcd-fitted")
    few = fitted.count() <= GROUPS
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    part = lambda n: fitted.where((F.col("level") == n) & ((F.col("size") >= small) | (F.lit(n) == 2))).select(F.col("g_lang").alias(f"l{n}"), F.col("g_source").alias(f"s{n}"), F.struct("centre", "white", "cut").alias(f"e{n}"))
    found = stats.withColumn("l", text("lang")).withColumn("s", text("source")).withColumn("none", F.lit(""))
    a, b, c = (F.broadcast(part(k)) if few or k == 2 else part(k) for k in range(3))  # the last is one row
    found = found.join(a, (found["l"] == a["l0"]) & (found["s"] == a["s0"]), "left")
    found = found.join(b, found["l"] == b["l1"], "left").join(c, found["none"] == c["l2"], "left")
    found = found.withColumn("e", F.coalesce("e0", "e1", "e2")).withColumn("centre", F.col("e.centre")).withColumn("white", F.col("e.white"))
    found = found.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(distance(features))))
    return found.select(*stats.columns, "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("e.cut"), F.lit(True))).alias("kept"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    return verdicts(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
