"""Texts whose sets of word trigrams have half of all trigrams in common: an exact join that shuffles few bytes a trigram.

1. Each trigram is a hash; its upper part names a bucket, of its lower part 32 bits are sent there, packed by bucket with
   the texts' numbers. A bucket counts them exactly and sends on only those that several texts have: of prose, few.
2. A text is left out unless half of its trigrams come back. Trigrams of one text alone are its rarest, so that of the
   others only c - ceil(m / 2) + 1, the rarest, are looked up (c of m came back).
3. Texts that meet there within the bounds of size and place are verified on whole sets, which are made again for them.
   Pairs are dealt by the least text that their first one meets, so that the set of a text in a cluster is sent to one
   block, or to as many as share the cluster's pairs, but not once for each pair.

Labels of two trigrams may be equal: that sends a trigram on, or a pair to be verified, that need not be, and loses none,
as labels stand for elements of a multiset. Nothing is capped; what is sent does not depend on how texts are grouped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored

#: Bytes of text that are hashed at once, and trigrams that are packed at once.
TEXT_BYTES, PACKED = 1_000_000, 600_000
#: Trigrams that a bucket is meant to hold, and the fewest and most buckets.
BUCKET, FEWEST, MOST = 500_000, 64, 4096
#: Sets, and pairs, that are meant to be verified by one task at once.
SETS, PAIRS = 2_000, 50_000
#: Rows that are broadcast to where the texts are (some 16 bytes each); beyond, texts are joined with them.
SENT = 500_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def trigram_sets(texts: list[bytes], keys: np.ndarray) -> list[np.ndarray]:
    """The distinct trigrams of each text, whose words are parted by single blanks, as hashes in order; each text's key
    enters all of its hashes."""
    out = [np.empty(0, np.uint64)] * len(texts)
    own = [i for i, t in enumerate(texts) if t.count(b" ") >= 2]
    if not own:
        return out
    data = np.frombuffer(b" ".join(texts[i] for i in own), np.uint8)
    blank = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], blank + 1])
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data) + 1)))[: len(data)]
    value = (data.astype(np.uint64) + np.uint64(1)) * mix(np.arange(1, int(place.max()) + 2, dtype=np.uint64) * _GOLD)[place]
    value[blank] = 0
    h = mix(np.add.reduceat(value, starts))
    n = np.array([texts[i].count(b" ") + 1 for i in own])
    key = np.repeat(keys[own].astype(np.int64).view(np.uint64), n)
    t = mix(mix(mix(h[:-2] + key[:-2]) * _GOLD + h[1:-1]) * _GOLD + h[2:])
    at = np.concatenate([[0], np.cumsum(n)])
    for i, a, b in zip(own, at, at[1:]):
        out[i] = np.unique(t[a : b - 2])
    return out


def sliced(it) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of (node, key, joined, ...), some bytes at a time, with their trigrams."""
    for batch in it:
        ends = np.cumsum(pc.binary_length(batch.column("joined")).to_numpy(zero_copy_only=False).astype(np.int64)) // TEXT_BYTES
        for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(ends)) + 1) if batch.num_rows else ():
            part = batch.slice(int(at[0]), len(at))
            yield part, trigram_sets([t.encode() for t in part.column("joined").to_pylist()], part.column("key").to_numpy())


def packed(nodes: np.ndarray) -> bytes:
    """Numbers in order, by their steps."""
    steps = np.diff(nodes, prepend=nodes[0])
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if steps.max() <= np.iinfo(k).max)
    return np.array([nodes[0], kind().itemsize], np.int64).tobytes() + zlib.compress(steps.astype(kind).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    first, width = np.frombuffer(data[:16], np.int64)
    return first + np.cumsum(np.frombuffer(zlib.decompress(data[16:]), {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[int(width)]).astype(np.int64))


def dealt(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, size, nodes, items): lower halves of trigrams by bucket with the texts they are of; or, with ``size``, texts' numbers of trigrams."""
    schema = pa.schema([("bucket", pa.int32()), ("size", pa.bool_()), ("nodes", pa.binary()), ("items", pa.binary())])

    def flushed(held):
        nodes, sizes = np.concatenate([n for n, _ in held]), np.array([len(s) for _, sets in held for s in sets])
        t, node = np.concatenate([s for _, sets in held for s in sets]), np.repeat(nodes, sizes)
        if not len(t):
            return
        bucket = ((t >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((node, bucket))
        t, node, bucket = t[order].astype(np.uint32), node[order], bucket[order]
        rows = [(int(bucket[at[0]]), False, packed(node[at[0] : at[-1] + 1]), t[at[0] : at[-1] + 1].tobytes()) for at in np.split(np.arange(len(t)), np.flatnonzero(np.diff(bucket)) + 1)]
        by = np.argsort(nodes, kind="stable")
        rows.append((int(nodes[0] % buckets), True, packed(nodes[by]), sizes[by].astype(np.uint32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)

    def run(it):
        held, n = [], 0
        for part, sets in sliced(it):
            held.append((part.column("node").to_numpy(), sets))
            n += sum(map(len, sets))
            if n >= PACKED:
                yield from flushed(held)
                held, n = [], 0
        if held:
            yield from flushed(held)

    return docs.select("node", "key", "joined").mapInArrow(run, "bucket int, size boolean, nodes binary, items binary")


def counted(rows: DataFrame) -> DataFrame:
    """(node, label, f) of trigrams that f texts have, f > 1; with the label -1, f is the text's number of trigrams."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, np.int64),) * 3]
        for size, own in pdf.groupby("size"):
            nodes = np.concatenate([unpacked(x) for x in own["nodes"]])
            items = np.concatenate([np.frombuffer(x, np.uint32) for x in own["items"]]).astype(np.int64)
            if size:
                out.append((nodes, np.full(len(nodes), -1), items))
            else:
                _, at, n = np.unique(items, return_inverse=True, return_counts=True)
                many = n[at] > 1
                out.append((nodes[many], items[many] | int(own["bucket"].iloc[0]) << 32, n[at][many]))
        return pd.DataFrame({c: np.concatenate([x[i] for x in out]) for i, c in enumerate(("node", "label", "f"))})

    return rows.groupBy("bucket").applyInPandas(count, "node long, label long, f long")


def half_alike(docs: DataFrame, *keep: str) -> DataFrame:
    """Pairs (x, y) of the nodes of ``docs`` (node, key, joined: words parted by blanks, n: their number) of equal key with half of all trigrams in common, with the kept columns of both as x_ and y_."""
    words = docs.agg(F.sum("n")).first()[0] or 0
    each = counted(dealt(docs, min(MOST, max(FEWEST, words // BUCKET))))
    each = each.groupBy("node").agg(F.max(F.when(F.col("label") < 0, F.col("f"))).alias("m"), F.sort_array(F.collect_list(F.when(F.col("label") >= 0, F.struct("f", "label")))).alias("r"))
    m, c = F.col("m"), F.size("r")
    look = F.slice("r", 1, (c - F.ceil(m / 2) + 1).cast("int"))
    rows = each.where(2 * c >= m).select("node", "m", (m - c).alias("lone"), F.posexplode_outer(look).alias("i", "r")).where("i is not null").select("node", "m", (F.col("lone") + F.col("i")).alias("i"), F.col("r.label").alias("token"))
    # of a pair, the smaller set (a trigrams) has one of the common ones among its first a - ceil(2a / 3) + 1
    rows = rows.withColumn("short", F.col("i") < m - F.ceil(F.lit(2) * m / 3) + 1)
    token = Window.partitionBy("token")
    shared = rows.withColumn("several", F.count(F.lit(1)).over(token)).withColumn("some", F.max("short").over(token)).where("several > 1 AND some")
    shared = stored(shared.select("token", "node", "m", "i", "short"), "overlap-shared")
    # x is the smaller; what both have from their first common trigram on is bounded by what is left of either
    left = 1 + F.least(F.col("x.m") - F.col("x.i") - 1, F.col("y.m") - F.col("y.i") - 1)
    order = F.struct("x.m", "x.node") < F.struct("y.m", "y.node")
    cond = (F.col("x.token") == F.col("y.token")) & order & (2 * F.col("x.m") >= F.col("y.m")) & (3 * left >= F.col("x.m") + F.col("y.m"))
    pairs = stored(shared.where("short").alias("x").join(shared.alias("y").hint("merge"), cond).select(F.col("x.node").alias("x"), F.col("y.node").alias("y")).distinct(), "overlap-pairs")
    least = F.least("x", "y")
    met = pairs.select("x", least.alias("r")).union(pairs.select("y", least)).groupBy("x").agg(F.min("r").alias("r"))
    led = pairs.join(met, "x")
    shares = led.groupBy("r").agg(F.ceil(F.count(F.lit(1)) / PAIRS).alias("shares"))
    led = stored(led.join(shares, "r").select("x", "y", F.xxhash64("r", F.pmod(F.xxhash64("x"), "shares")).alias("h")), "overlap-led")
    blocks = max(1, led.select(F.explode(F.array("x", "y")).alias("node"), "h").distinct().count() // SETS)
    led = led.select("x", "y", F.pmod("h", F.lit(blocks)).alias("block"))
    wanted = stored(led.select(F.explode(F.array("x", "y")).alias("node"), "block").distinct(), "overlap-wanted")
    kinds = {k.name: k.dataType.simpleString() for k in docs.select(*keep).schema}

    def whole(it):
        for part, sets in sliced(it):
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("block", "node", *keep)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["block", "node", *keep, "items"])

    def verified(sets: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        sets = sets.set_index("node")
        items = {i: np.frombuffer(t, np.uint64) for i, t in sets["items"].items()}
        fine = [3 * len(np.intersect1d(items[a], items[b], assume_unique=True)) >= len(items[a]) + len(items[b]) for a, b in zip(own["x"], own["y"])]
        own = own[np.array(fine, bool)]
        return pd.DataFrame({"x": own["x"], "y": own["y"]} | {f"{i}_{k}": sets[k].loc[own[i]].to_numpy() for i in ("x", "y") for k in keep})

    found = docs.join(F.broadcast(wanted) if wanted.count() <= SENT else wanted, "node")
    sets = found.select("block", "node", *keep, "key", "joined").mapInArrow(whole, ", ".join(["block long, node long", *(f"{k} {t}" for k, t in kinds.items()), "items binary"]))
    return sets.groupBy("block").cogroup(led.groupBy("block")).applyInPandas(verified, ", ".join(["x long, y long", *(f"{i}_{k} {t}" for i in ("x", "y") for k, t in kinds.items())]))
