import random
import re

import numpy as np
import pytest

from marlstone.llm import neardup, sketch
from marlstone.llm.neardup import classes, keep_one, links_among, op9_neardup
from marlstone.operators.graph import components


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_classes(sets, percent):
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = root(a), root(b)
                    up[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


def varied(rng, words, change):
    return [rng.choice("pqrstuvw") * 2 if rng.random() < change else w for w in words]


def corpus(seed, groups=6, size=25):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(rng.choice([3, 6, 40, 120, 400]))]
        texts += [" ".join(varied(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.05]))) for _ in range(rng.randint(1, size))]
    texts += [None, "", " \n\t", "a", "A", "one two three", "ONE  two\nthree"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_classes_are_those_of_all_pairs(spark, seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(neardup, "BLOCK_NODES", 7)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n long")
    sets = {i: plain_set(t) for i, t in enumerate(texts)}
    found = classes(df, 85).collect()
    assert {r["id"]: r["component"] for r in found} == plain_classes(sets, 85)
    assert {r["id"]: r["n"] for r in found} == {i: len(s) for i, s in sets.items()}


def test_ids(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (7, text + " i j"), (7, text), (None, "x y"), (None, None)], "doc_id long, text string")
    found = sorted((r["id"] or -1, r["n"], r["component"] or -1) for r in classes(df).collect())
    assert found == sorted([(-1, 4, 5), (5, 4, 5), (5, 4, 5), (7, 6, 7), (7, 4, 5), (-1, 1, -1), (-1, 0, -1)])
    assert classes(df.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 3, 20, 200, 5000):
        x = sketch.mix(rng.integers(0, 2**63, n).astype(np.uint64))
        assert sketch.sketch(x).max() < 2**64 - 1
        y = x.copy()
        y[: n // 10] = sketch.mix(rng.integers(0, 2**63, n // 10).astype(np.uint64))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((sketch.sketch(x) == sketch.sketch(y)).mean() - true) < 0.2
        assert (sketch.sketch(x) == sketch.sketch(rng.permutation(x))).all()


def test_links_of_a_hub_whose_spokes_are_far_apart():
    rng = np.random.default_rng(2)
    hub = np.unique(sketch.mix(np.arange(200, dtype=np.uint64)))
    spokes = []
    for i in range(60):
        out = rng.permutation(hub)[:185]
        spokes.append(np.unique(np.concatenate([out, sketch.mix(np.arange(1000 + 20 * i, 1010 + 20 * i, dtype=np.uint64))])))
    found = links_among([*spokes, hub], 85)
    assert len(found) == 60


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(1000, i) for i in range(1001, 1100)]
    up = {i: i for p in pairs for i in p}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: root(i) for p in pairs if p[0] != p[1] for i in p}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = plain_classes({i: plain_set(t) for i, t in texts.items()}, 85)
    assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in op9_neardup(spark, sf).collect()} == {i: (c, i == c) for i, c in want.items()}


def test_many_rows_without_an_id(spark):
    texts = [f"w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4} w{i + 5}" for i in range(0, 900, 3)] * 2
    df = spark.createDataFrame([(None, t, 1, 2, 3) for t in texts], "doc_id long, text string, `__t` int, `__id` int, h int")
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(r["text"] for r in kept.collect()) == sorted(set(texts))
