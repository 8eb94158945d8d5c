import numpy as np
import pytest

from marlstone.llm import topk
from marlstone.llm.topk import SortedLists, bounds, centres, nearest, quantised, top_k


def brute(ids, v, own, q, k):
    s = v.astype(np.int64) @ q.astype(np.int64)
    return [(int(ids[i]), int(s[i])) for i in np.lexsort((ids, -s)) if ids[i] != own][:k]


@pytest.mark.parametrize("seed", range(25))
def test_threshold_algorithm(seed):
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(1, 300)), int(rng.integers(1, 9))
    v = rng.integers(-5, 6, size=(n, d)) * (rng.random((n, d)) < 0.7)
    if seed % 3 == 0:
        v[: n // 2] = v[0]
    if seed % 7 == 0:
        v = v * 1_000_000
    ids = rng.permutation(n * 2)[:n]
    lists = SortedLists(ids, v)
    for i in range(min(n, 20)):
        a, s, _ = lists.top(int(ids[i]), v[i], 20)
        assert list(zip(a.tolist(), s.astype(int).tolist())) == brute(ids, v, ids[i], v[i], 20)


@pytest.mark.parametrize("large", [100_000, 16_000_000])
def test_query_of_larger_norm_than_its_block(large):
    rng = np.random.default_rng(1)
    v, queries = rng.integers(-40, 41, size=(400, 64)), rng.integers(-large, large + 1, size=(20, 64))
    lists = SortedLists(np.arange(400), v)
    for q in queries:
        a, s, _ = lists.top(-1, q, 50)
        assert list(zip(a.tolist(), s.astype(int).tolist())) == brute(np.arange(400), v, -1, q, 50)


def test_stops_early_where_the_bound_allows():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 3, size=(5000, 4))
    v[:30] = 60
    lists = SortedLists(np.arange(5000), v)
    assert lists.top(-1, np.array([5, 4, 3, 2]), 20)[2] < 1000


def test_frames(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "clash") for i in range(90)]
    rows += [(100, None, ""), (120, [1.0, None, 1.0, 1.0, 1.0, 1.0], ""), (140, [inf] * 6, ""), (160, [nan] * 6, ""), (None, [1.0] * 6, ""), (180, [9.0], ""), (7, rows[7][1], ""), (200, [], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    q = quantised(df, 64, "vec_id", "embedding")
    found = {}
    for r in top_k(q, q.where("id % 20 = 0"), 5, candidate_block=16, query_block=2).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.floor(64 * np.float32(e).astype(np.float64)).astype(np.int64)) for i, e, _ in rows if i is not None and e and len(e) == 6 and all(x is not None and np.isfinite(x) for x in e)]
    ids, v = np.array([i for i, _ in good]), np.stack([x for _, x in good])
    assert set(found) == {0, 20, 40, 60, 80}
    for own, got in found.items():
        assert [(b, c) for _, b, c in sorted(got)] == brute(ids, v, own, v[list(ids).index(own)], 5)
        assert [a for a, _, _ in sorted(got)] == [1, 2, 3, 4, 5]
    assert top_k(q.limit(0), q.limit(0), 5).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_blocks_around_centres(spark, seed, monkeypatch):
    """Vectors in clumps: every score is right, and blocks that can't reach a query's floor aren't searched."""
    rng = np.random.default_rng(seed)
    middle = rng.integers(-60, 61, size=(12, 8))
    v = middle[rng.integers(0, 12, 600)] + rng.integers(-3, 4, size=(600, 8))
    v[:40] = v[0]
    df = spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(v)], "id long, v array<long>")
    asked = []
    own = topk.stored
    monkeypatch.setattr(topk, "stored", lambda d, label, *a: (lambda t: (asked.append(t.count()) if label == "topk-asked" else None, t)[1])(own(d, label, *a)))
    found = {}
    for r in top_k(df, df.where("id % 10 = 0"), 7, candidate_block=50, query_block=16, sample=300).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 600, 10):
        assert [(b, c) for _, b, c in sorted(found[q])] == brute(np.arange(600), v, q, v[q], 7)
    assert asked[0] == 60 and sum(asked) < 60 * 12 / 2


def test_bounds_hold():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(500, 5)) * 30
    mid = centres(v, 9)
    near, far = nearest(v, mid)
    radius = np.array([far[near == i].max(initial=0) for i in range(9)])
    for q in rng.normal(size=(50, 5)) * 100:
        high = bounds(q, mid, radius)
        assert all((v[near == i] @ q <= high[i]).all() for i in range(9))


def test_floor_keeps_ties():
    lists = SortedLists(np.arange(6), np.array([[1], [3], [3], [2], [3], [0]]))
    assert lists.top(-1, np.array([2]), 2, 6.0)[0].tolist() == [1, 2] and lists.top(-1, np.array([2]), 2, 7.0)[0].tolist() == []


def test_query_is_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(topk.OP5_SQL).fetchall()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.op5_topk(spark, sf).collect()) == sorted(want)
