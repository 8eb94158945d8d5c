"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists, in blocks that bounds rule out.

Candidates are dealt into blocks around centres, which k-means finds on a bounded sample (SAMPLE rows in hash order; every
candidate is then put to its nearest centre). For a query q and a block of centre c and radius r, no score in the block is
above q.c + |q| r. Each query is first searched in the block of the greatest bound, which gives it a score that k
candidates reach; then it is sent, with that score, to the other blocks whose bounds reach it, and to no others.

In a block, one list a dimension is sorted by that component. A query walks all its lists at once, from the end that
raises its score; candidates met get their exact score by random access; the sum of what the lists offer at the depth
reached bounds all candidates not met. The walk ends when that bound is below the kth score, the one brought along
included, so that nothing unseen could win or tie. The best of all blocks are then ranked again.

Vectors that are null or hold null or non-finite components take no part. Vectors of different length are not compared.
Ties go to the smaller id; rows that share the query's id are not its candidates; repeated rows count each. With fewer
than k candidates all are returned; an empty table gives an empty result; null ids take no part; other columns are ignored.
Scores are exact for components up to 2**24 in size: sums are made in single, double or whole numbers as they need.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Candidates and queries that a task is meant to hold, rows that centres are found on, centres at most.
CANDIDATES, QUERIES, SAMPLE, CENTRES = 32_768, 1_024, 20_000, 256


class SortedLists:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.whole = ids[order], vectors[order].astype(np.int64)
        self.most = int(np.abs(self.whole).max(initial=0))
        self.order = np.argsort(self.whole, axis=0, kind="stable").astype(np.int32).T.copy()
        self.forms = {}
        self.use(np.float32)

    def use(self, kind: type) -> None:
        """Vectors and lists in this kind of number; each kind is made once."""
        if kind not in self.forms:
            vectors = self.whole.astype(kind)
            self.forms[kind] = vectors, np.take_along_axis(vectors, self.order.T, axis=0).T.copy(), np.empty((2048, vectors.shape[1]), kind)
        self.kind = kind
        self.vectors, self.sorted, self.buffer = self.forms[kind]

    def kind_for(self, query: np.ndarray) -> type:
        """Sums of whole numbers are exact in single precision below 2**24, in double below 2**53."""
        most = int(np.abs(query.astype(np.int64)).max(initial=0)) * self.most * len(query)
        return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64

    def score(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Random access, through a buffer that stays in the processor's cache."""
        out = np.empty(len(at), self.kind)
        for i in range(0, len(at), len(self.buffer)):
            part = at[i : i + len(self.buffer)]
            out[i : i + len(part)] = np.take(self.vectors, part, axis=0, out=self.buffer[: len(part)], mode="clip") @ query
        return out

    def top(self, own: int, query: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best (ties by id) that reach ``floor``, and how many candidates got a score."""
        self.use(self.kind_for(query))
        n, query = len(self.ids), query.astype(self.kind)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, bool)
        found, scores, kth = [], [], floor
        depth, step = 0, 16
        while depth < n:
            to = min(n, depth + step)
            now = seen.copy() if len(up) + len(down) else np.ones(n, bool)
            now[self.order[up, n - to : n - depth]] = True
            now[self.order[down, depth:to]] = True
            met = np.flatnonzero(now ^ seen)
            seen = now
            met = met[self.ids[met] != own]
            found.append(met)
            scores.append(self.score(met, query))
            depth, step = to, step * 2
            every = np.concatenate(scores)
            if len(every) >= k:  # the kth best so far
                kth = max(floor, np.partition(every, len(every) - k)[len(every) - k])
            bound = self.sorted[up, n - to] @ query[up] + self.sorted[down, to - 1] @ query[down]
            if kth > bound or seen.all():
                break
        at, every = np.concatenate(found or [np.empty(0, int)]), np.concatenate(scores or [np.empty(0)])
        best = np.lexsort((self.ids[at], -every))[:k]
        best = best[every[best] >= floor]
        return self.ids[at[best]], every[best], len(at)


def quantised(df: DataFrame, factor: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): whole components floor(factor * x) of vectors that take part."""
    x = df[vector_col]
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(factor)) * c.cast("double")).cast("long"))
    return df.where(x.isNotNull() & fine & df[id_col].isNotNull()).select(df[id_col].cast("long").alias("id"), whole.alias("v"))


def centres(vectors: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    """Centres by k-means from the first vectors; the same for the same vectors."""
    out = vectors[:k].copy()
    for _ in range(steps):
        near = nearest(vectors, out)[0]
        sums = np.zeros_like(out)
        np.add.at(sums, near, vectors)
        n = np.bincount(near, minlength=len(out))
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def nearest(vectors: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and how far it is."""
    d = (vectors * vectors).sum(axis=1)[:, None] - 2 * vectors @ middle.T + (middle * middle).sum(axis=1)
    near = d.argmin(axis=1)
    return near, np.linalg.norm(vectors - middle[near], axis=1)


def bounds(query: np.ndarray, middle: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """What no inner product with a block's vectors exceeds, with room for rounding."""
    out = middle @ query + np.linalg.norm(query) * radius
    return out + 1e-9 * np.abs(out) + 1e-6


def placed(candidates: DataFrame, block: int, centres_most: int, sample: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(id, v, dim, near, far) and the centres of each length of vectors."""
    n = candidates.count()
    some = candidates.orderBy(F.xxhash64("id"), "id").limit(sample).collect() if n else []  # SAMPLE rows at most
    kinds: dict[int, list] = {}
    for r in some:
        if r["v"]:
            kinds.setdefault(len(r["v"]), []).append(r["v"])
    middle = {dim: centres(np.array(v, float), max(1, min(centres_most, -(-n // block), len(v)))) for dim, v in kinds.items()}

    def run(it):
        for pdf in it:
            dims = pdf["v"].map(len).to_numpy()
            near, far = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                v = np.stack(pdf["v"].to_numpy()[at]).astype(float) if dim else np.zeros((len(at), 0))
                if dim in middle:
                    near[at], far[at] = nearest(v, middle[dim])
                else:  # a length that the sample has not: one block around nothing
                    far[at] = np.linalg.norm(v, axis=1)
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "dim": dims.astype(np.int32), "near": near, "far": far})

    return stored(candidates.mapInPandas(run, "id long, v array<long>, dim int, near int, far double"), "topk-placed"), middle


def top_k(candidates: DataFrame, queries: DataFrame, k: int, candidate_block: int = CANDIDATES, query_block: int = QUERIES, centres_most: int = CENTRES, sample: int = SAMPLE) -> DataFrame:
    """Both (id long, v array<long>). Rows (query_id, rank, vec_id, score)."""
    spark = candidates.sparkSession
    dealt, middle = placed(candidates, candidate_block, centres_most, sample)
    blocks = F.ceil(F.count(F.lit(1)) / candidate_block).cast("int")
    sizes = dealt.groupBy("dim", "near").agg(blocks.alias("blocks"), F.max("far").alias("far")).collect()  # a row for each centre
    known: dict[int, tuple] = {}
    for dim in {r["dim"] for r in sizes}:
        own = sorted((r for r in sizes if r["dim"] == dim), key=lambda r: r["near"])
        ids = np.array([r["near"] for r in own])
        known[dim] = ids, np.array([r["blocks"] for r in own]), middle[dim][ids] if dim in middle else np.zeros((len(own), dim)), np.array([r["far"] for r in own])
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1) * 64
    keys = ["dim", "near", "block", "chunk"]
    many = {(r["dim"], r["near"]): r["blocks"] for r in sizes}
    split = spark.createDataFrame([(*key, n) for key, n in many.items()] or [(-1, -1, 1)], "dim int, near int, blocks int")
    spread = dealt.join(F.broadcast(split), ["dim", "near"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def sent(first: bool):
        """Each query with the blocks it is to be searched in: the one of the greatest bound, or then all others that reach its floor."""

        def run(it):
            for pdf in it:
                out = {"id": [], "v": [], "floor": [], "dim": [], "near": [], "block": []}
                for r in pdf.itertuples(index=False):
                    if len(r.v) not in known or not len(r.v):
                        continue
                    ids, parts, mid, far = known[len(r.v)]
                    high = bounds(np.asarray(r.v, float), mid, far)
                    top = int(high.argmax())
                    for i in [top] if first else range(len(ids)):
                        for b in range(1 if first else parts[i]):
                            if first or (high[i] >= r.floor and not (i == top and b == 0)):
                                for name, x in (("id", r.id), ("v", r.v), ("floor", r.floor), ("dim", len(r.v)), ("near", ids[i]), ("block", b)):
                                    out[name].append(x)
                if out["id"]:  # an empty column of arrays has no type
                    yield pd.DataFrame(out)

        return run

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(a) and len(b):
            lists = SortedLists(a["id"].to_numpy(np.int64), np.stack(a["v"].to_numpy()))
            for own, v, floor in zip(b["id"], b["v"], b["floor"], strict=True):
                ids, scores, _ = lists.top(own, np.asarray(v), k, floor)
                out["query_id"] += [own] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.astype(np.int64).tolist()
        return pd.DataFrame(out)

    def searched(asked: DataFrame, first: bool) -> DataFrame:
        cells = stored(asked.mapInPandas(sent(first), "id long, v array<long>, floor double, dim int, near int, block int"), "topk-asked")
        chunks = cells.groupBy("dim", "near", "block").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("chunks"))
        right = cells.join(chunks, ["dim", "near", "block"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        copies = chunks.select(*[F.col(c).alias(c) for c in ("dim", "near", "block")], F.sequence(F.lit(0), F.col("chunks") - 1).alias("copies"))
        left = spread.join(F.broadcast(copies), ["dim", "near", "block"]).withColumn("chunk", F.explode("copies")).select(*keys, "id", "v")  # a row for each block
        left, right = left.repartition(width, *keys), right.select(*keys, "id", "v", "floor").repartition(width, *keys)
        return stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long"), "topk-found")

    once = searched(queries.select("id", "v", F.lit(float("-inf")).alias("floor")), True)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    floors = once.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("id"), (F.col("score") - F.abs("score") * 1e-12).cast("double").alias("floor"))
    again = queries.join(floors, "id", "left").select("id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    found = once.unionByName(searched(again, False))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(quantised(table(spark, sf_dir, "embeddings"), 64, "vec_id", "embedding"), "topk-vectors")
    return top_k(vectors, vectors.where(F.col("id") % 20 == 0), 20)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
