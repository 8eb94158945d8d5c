"""Near-duplicate documents: fast similarity sketches, banding, and exact verification on full sets.

1. One pass sketches every text's set of word shingles. Equal sets are one node; all that follows is about nodes.
2. Nodes that share a band key meet in a bucket. Linking each to its bucket's least node, without any check, gives
   groups outside of which no two nodes share a bucket.
3. Each node is verified against one head, the least node of the buckets it shares most with: a row for each node, however
   large its group. What these links connect is one part of its group. A group of one part is done.
4. Of other groups, only pairs of different parts are left. The nodes of the largest part are dealt in blocks, and those of
   all others, too; a task holds one block of the others, and one more of either kind, so that a large group of near copies
   is sent once for each block of what is not yet part of it, not once for each block of itself. Blocks are dealt by hash,
   so that they are of equal size but for chance and for single large sets. There, pairs of a common bucket whose sizes
   allow it are verified on full sets in order of their sketches' agreement, and pairs that are connected already are left
   out: a task gives at most one link less than it has nodes, however many pairs are alike.
5. Components over all links; a document's class is the least id in its component.

Null and empty texts, and texts without words, have empty sets and are linked with nothing. Texts shorter than a shingle
are one shingle of all their words. Texts of any length are taken whole. Repeated rows are copies of each other; rows
without an id belong to a class like others but are never its name; keep_one keeps one of them only where no row of the
class has an id, and the query, which keeps by id, none. Ids are whole numbers. An empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from . import sketch
from .common import Members, fresh, stored, table

#: Nodes, and shingles, that a block is meant to hold.
BLOCK_NODES, BLOCK_ITEMS = 2_000, 1_500_000


def keyed(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, n, key, bands): a hash of the text, and the set's key, null for empty sets."""
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, keys, bands = [], [], []
                for t in part.column(2).to_pylist():
                    s = sketch.shingles(t)
                    n.append(len(s))
                    keys.append(keyed(s) if len(s) else None)
                    bands.append(sketch.bands(sketch.sketch(s)) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    text = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("h"), docs[text_col].alias("text"))
    return text.mapInArrow(run, "id long, h long, n long, key binary, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The full sets of ``wanted`` (node, id, h, key), read again from one document each: that of the least id and text hash."""
    text = docs.select(docs[id_col].cast("long").alias("t_id"), F.xxhash64(docs[text_col]).alias("t_h"), docs[text_col].alias("text"))
    may = Members(stored(wanted.select(F.xxhash64("id", "h").alias("k")), "neardup-places"))  # only documents that may be wanted are dealt out
    text = text.where(may.maybe(F.xxhash64("t_id", "t_h")))
    chosen = wanted.select("node", "id", "h", "key").hint("shuffle_hash")
    found = text.join(chosen, F.col("t_id").eqNullSafe(F.col("id")) & (F.col("t_h") == F.col("h"))).select("node", "key", "text")
    schema = pa.schema([("node", pa.int64()), ("items", pa.binary())])

    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                nodes, out = [], []
                for node, key, t in zip(*(batch.column(i).slice(at, 512).to_pylist() for i in range(3)), strict=True):
                    s = sketch.shingles(t)
                    if keyed(s) == key:  # texts may share a hash
                        nodes.append(node)
                        out.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], schema=schema)

    return found.mapInArrow(run, "node long, items binary")


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets are of that similarity."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def links_among(items: list[np.ndarray], percent: int, first: int | None = None, parts: Sequence | None = None) -> list[tuple[int, int]]:
    """Links that connect all that is connected by pairs of similarity ``percent`` or more. With ``first``, only pairs of
    one of the first so many and one of the others; with ``parts``, sets of equal part are connected already. Pairs that
    share no band key are not verified."""
    n = len(items)
    sketches = np.stack([sketch.sketch(s) for s in items])
    sizes = np.array([len(s) for s in items])
    keys = np.stack([sketch.bands(x) for x in sketches])
    forest, out = Forest(n), []

    for own in pd.Series(range(n)).groupby(pd.Series(parts)).indices.values() if parts is not None else ():
        for b in own[1:]:
            forest.join(int(own[0]), int(b))

    for a in range(n if first is None else first):
        others = np.arange(a + 1 if first is None else first, n)
        small, large = np.minimum(sizes[others], sizes[a]), np.maximum(sizes[others], sizes[a])
        others = others[100 * small >= percent * large]
        if not len(others):
            continue
        others = others[(keys[others] == keys[a]).any(axis=1)]
        root = forest.root(a)
        others = np.array([b for b in others if forest.root(b) != root], int)
        if not len(others):
            continue
        agree = (sketches[others] == sketches[a]).sum(axis=1)
        for i in np.argsort(-agree, kind="stable"):
            b = int(others[i])
            if forest.root(a) != forest.root(b) and alike(items[a], items[b], percent):
                forest.join(a, b)
                out.append((a, b))
    return out


def headed(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of ``stars`` (a, b, n: buckets that both share) of each node with the one head it shares most buckets with."""
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    one, two = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = best.join(two.hint("merge"), "b").join(one.hint("merge"), "a").select("a", "b", "x", "y")

    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fine = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def links(grouped: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``grouped`` (node, grp, part, n): links (a, b) that connect what is connected in each group, besides its parts."""
    blocks = lambda nodes, items: F.greatest(F.ceil(F.col(nodes) / BLOCK_NODES), F.ceil(F.col(items) / BLOCK_ITEMS)).cast("long")
    each = grouped.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("items"))
    largest = each.groupBy("grp").agg(F.max(F.struct("nodes", -F.col("part"), "items")).alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("nodes").alias("nodes"), F.sum("items").alias("items")).where("parts > 1")
    sizes = largest.select("grp", (-F.col("m.col2")).alias("main"), F.col("m.nodes").alias("m_nodes"), F.col("m.items").alias("m_items"), (F.col("nodes") - F.col("m.nodes")).alias("o_nodes"), (F.col("items") - F.col("m.items")).alias("o_items"), "nodes", "items")
    sizes = sizes.withColumns({"o": blocks("o_nodes", "o_items"), "k": blocks("m_nodes", "m_items"), "all": blocks("nodes", "items")})
    inside, whole = F.col("part") == F.col("main"), F.col("all") == 1
    h = F.xxhash64("node")
    dealt = grouped.join(sizes, "grp").withColumn("own", F.when(whole, F.lit(0)).when(inside, F.col("o") + F.pmod(h, F.col("k"))).otherwise(F.pmod(h, F.col("o"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    cell = lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j"))
    met = F.when(whole, F.array(F.lit(0).cast("long"))).when(inside, upto(F.col("o"))).otherwise(upto(F.col("o") + F.col("k")))
    sent = dealt.select("node", "grp", "part", "own", F.explode(F.transform(met, cell)).alias("p")).select("node", "grp", "part", "own", "p.i", "p.j").join(sets, "node")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").drop_duplicates("node")
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            pdf = pdf.sort_values(["own", "node"])
            first = int((pdf["own"] == pdf["i"]).sum())
        else:
            first = None
        nodes = pdf["node"].to_numpy()
        found = links_among([np.frombuffer(x, np.uint64) for x in pdf["items"]], percent, first, pdf["part"].to_numpy()) if len(pdf) > 1 else []
        return pd.DataFrame({"a": [nodes[a] for a, _ in found], "b": [nodes[b] for _, b in found]}, dtype="int64")

    return sent.groupBy("grp", "i", "j").applyInPandas(search, "a long, b long")


def classes(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, n, component, root): a hash of the text, the set's size, the least id of the document's class (null if no
    row of it has one), and a number of the class (null for empty sets)."""
    own = stored(signatures(docs, id_col, text_col), "neardup-signatures")
    each = own.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("at"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    each = each.select("key", "at.id", "at.h", "n", "bands")
    nodes = stored(each.withColumn("node", F.monotonically_increasing_id()), "neardup-nodes")
    keys = nodes.select("node", F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("band", "least")
    stars = stored(keys.join(buckets, "band").where("node <> least").groupBy(F.col("node").alias("a"), F.col("least").alias("b")).agg(F.count(F.lit(1)).alias("n")), "neardup-stars")
    grouped = stored(components(stars.select("a", "b")).select("node", F.col("root").alias("grp")).join(nodes.select("node", "id", "h", "key", "n"), "node"), "neardup-groups")
    sets = stored(sets_of(docs, grouped, id_col, text_col), "neardup-sets")
    sure = stored(headed(stars, sets, percent), "neardup-headed")
    parts = stored(components(sure), "neardup-parts")
    split = grouped.select("node", "grp", "n").join(parts.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    found = components(sure.unionByName(links(stored(split, "neardup-split"), sets, percent)))
    labelled = nodes.select("key", "node", "id").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = stored(labelled.select("key", "root", "id"), "neardup-roots")
    least = labelled.groupBy("root").agg(F.min("id").alias("component"))
    names = labelled.join(least, "root").select("key", "component", "root")
    return own.select("id", "h", "n", "key").join(names, "key", "left").select("id", "h", "n", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"), "root")


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with all columns: one of each class, of the least id, and all rows with empty sets."""
    found = stored(classes(docs, percent, id_col, text_col), "neardup-classes")
    t_col, id_key, h_key = (fresh(docs, c) for c in ("__t", "__id", "__h"))
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("h"))
    kept = found.where("root is not null").groupBy("root").agg(F.min(rank).alias("r")).select(F.col("r.id").alias(id_key), F.col("r.h").alias(h_key))
    keyed = docs.withColumn(t_col, F.xxhash64(docs[text_col]))
    own = keyed.join(kept.hint("shuffle_hash"), keyed[id_col].eqNullSafe(F.col(id_key)) & (F.col(t_col) == F.col(h_key)), "left_semi")
    many = found.where("root is not null").groupBy("id", "h").count().where("count > 1").limit(1).count()
    own = own.dropDuplicates([id_col, t_col]) if many else own  # rows that agree in id and text
    empty = found.where("root is null").select(F.col("id").alias(id_key), F.col("h").alias(h_key)).distinct()
    rest = keyed.join(empty.hint("shuffle_hash"), keyed[id_col].eqNullSafe(F.col(id_key)) & F.col(t_col).eqNullSafe(F.col(h_key)), "left_semi") if empty.limit(1).count() else None
    return (own.unionByName(rest) if rest is not None else own).select(*docs.columns)


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
