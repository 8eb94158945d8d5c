import itertools
import math
import random

import pytest

from pyspark.sql import functions as F

from marlstone.operators.folds import LEAST, MOST, PIECE, clauses, passages, rising
from marlstone.operators.geometry import clipped, closed_rings, edges_of, ring_cells, segment_cells


def test_passages(spark):
    rng = random.Random(1)
    text = "\n".join(" ".join(f"W{'o' * rng.randint(1, 9)}rd {'x' * rng.randint(5, 150)}." for _ in range(rng.randint(1, 9))) for _ in range(30))
    long = "Word " + "and more words, " * 200 + "end."
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, long), (5, "y" * 2000)], "doc_id int, text string")
    out = {}
    for r in passages(df).orderBy("id", "place").collect():
        out.setdefault(r["id"], []).append(r["passage"])
    assert set(out) == {1, 4, 5} and " ".join(out[1]).split() == text.split() and " ".join(out[4]).split() == long.split()
    for own in out.values():
        assert all(len(p) >= LEAST for p in own[:-1]) and all(len(p) <= MOST + PIECE for p in own)
    assert "".join(out[5]).replace(" ", "") == "y" * 2000
    (r,) = spark.createDataFrame([(long,)], "t string").select(clauses(F.col("t")).alias("c")).collect()
    assert all(len(x) <= PIECE and x.endswith((",", ".")) for x in r["c"]) and " ".join(r["c"]) == long


@pytest.mark.parametrize("seed", range(20))
def test_increasing(seed):
    rng = random.Random(seed)
    v = [rng.randint(0, 9) for _ in range(rng.randint(0, 9))]
    got = rising(v)
    assert all(a < b and v[a] < v[b] for a, b in zip(got, got[1:]))
    best = max((len(c) for n in range(len(v) + 1) for c in itertools.combinations(v, n) if all(a < b for a, b in zip(c, c[1:]))), default=0)
    assert len(got) == best


def test_cells(spark):
    rng = random.Random(5)
    rows = [(i, *[rng.uniform(-5, 5) for _ in range(4)]) for i in range(60)] + [(60, 1.5, 1.5, 1.5, 4.5), (61, 2.5, 2.5, 2.5, 2.5), (62, 3.5, 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, d double")
    for r, own in zip(df.select("i", segment_cells(*map(F.col, "abcd")).alias("cells")).orderBy("i").collect(), rows, strict=True):
        cells = [tuple(c) for c in r["cells"]]
        assert cells[0] == (math.floor(own[1]), math.floor(own[2])) and cells[-1] == (math.floor(own[3]), math.floor(own[4]))
        assert all(abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for p, q in zip(cells, cells[1:]))


def test_clipping(spark):
    rows = [(-1.0, 1.0, 3.0, 1.0), (5.0, 5.0, 6.0, 6.0), (1.0, 1.0, 1.0, 1.0), (1.0, -1.0, 1.0, 3.0), (3.0, 0.0, 3.0, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, c double, d double")
    got = [r["p"] and tuple(r["p"]) for r in df.select("i", clipped(*map(F.col, "abcd"), (0.0, 0.0, 2.0, 2.0)).alias("p")).orderBy("i").collect()]
    assert got == [(0.25, 0.75), None, (0.0, 1.0), (0.25, 0.75), None]


def test_fill(spark):
    outer = [(0.0, 0.0), (5.0, 0.0), (5.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(outer)] + [(2, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)])], "ring int, n int, x double, y double")
    got = sorted(tuple(r) for r in ring_cells(edges_of(df, "ring", "n"), "ring").collect())
    assert got == sorted([(1, x, y) for x in range(5) for y in range(4)] + [(2, x, y) for x in range(4) for y in range(4) if x + y + 1 < 4])


def test_rings():
    assert closed_rings([[1, 2, 3], [5, 4, 3], [5, 1], [7, 8]]) == [[1, 2, 3, 4, 5, 1]]
    assert closed_rings([[1, 2], [3, 4]]) == closed_rings([]) == closed_rings([[1, 2, 1]]) == []
    assert closed_rings([[9, 8, 7, 9], [1, 2], [3, 2], [1, 3]]) == [[9, 8, 7, 9], [1, 2, 3, 1]]
