import math
import random
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import quality
from marlstone.llm.quality import FEATURES, chi2_cdf, counts, fit, op4_quality, statistics, verdicts


def plainly(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    marked = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


@pytest.mark.parametrize("seed", range(20))
def test_counts(seed):
    rng = random.Random(seed)
    for _ in range(100):
        text = "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "\x85", " ", "\x0b", "🙂|"]) for _ in range(rng.randint(0, 60)))
        assert counts(text)[:5] == plainly(text), repr(text)


def test_chi2():
    assert chi2_cdf(16.0128, 7) == pytest.approx(0.975, abs=1e-5)
    assert chi2_cdf(3.8415, 1) == pytest.approx(0.95, abs=1e-5)


def plain_distances(x, centre, cov):
    return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)


def plain_estimates(x, floors, tries=200):
    """The half of least determinant that concentration steps find from many random starts; centre, covariance and cut."""
    n, p = x.shape
    rng, k, best = np.random.default_rng(0), n // 2 + 1, (math.inf,)
    factor = lambda share: share / chi2_cdf(quality.chi2_quantile(share, p), p + 2)
    for _ in range(tries):
        some = x[rng.choice(n, p + 1, replace=False)]
        for _ in range(60):
            centre, cov = some.mean(0), np.cov(some.T, bias=True)
            d = plain_distances(x, centre, cov + np.diag(floors**2))
            new = x[d <= np.sort(d)[k - 1]]
            if len(new) == len(some) and (new == some).all():
                break
            some = new
        det = np.linalg.slogdet(np.cov(some.T, bias=True) + np.diag(floors**2))[1]
        if det < best[0]:
            best = det, some.mean(0), np.cov(some.T, bias=True)
    d = plain_distances(x, best[1], best[2] * factor(0.5) + np.diag(floors**2))
    kept = x[(d <= quality.chi2_quantile(0.975, p)) | (d <= np.sort(d)[k - 1])]
    centre, cov = kept.mean(0), np.cov(kept.T, bias=True) * factor(0.975) + np.diag(floors**2)
    quarter = np.quantile(plain_distances(x, centre, cov), 0.25)
    return centre, cov, math.sqrt(quality.chi2_quantile(1 - 1e-6, p) * max(1, quarter / quality.chi2_quantile(0.25, p))), best[0]


def mixed(seed, n, share):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 0.3]])
    x[: int(n * share)] = rng.normal(size=(int(n * share), 3)) * 0.5 + 30
    return x


@pytest.mark.parametrize("share", [0, 0.15, 0.3, 0.45])
def test_estimates_are_those_of_many_random_starts(spark, share):
    x = mixed(1, 400, share)
    df = spark.createDataFrame([("en", "s", *map(float, r)) for r in x], "lang string, source string, a double, b double, c double")
    got = {r["level"]: r for r in fit(df, ("a", "b", "c")).collect()}
    centre, cov, cut, _ = plain_estimates(x, np.full(3, quality.FLOOR))
    for level in (0, 1, 2):
        assert got[level]["size"] == 400
        white = np.array(got[level]["white"]).reshape(3, 3)
        assert np.allclose(got[level]["centre"], centre, atol=0.05) and np.allclose(np.linalg.inv(white.T @ white), cov, atol=0.1)
        assert got[level]["cut"] == pytest.approx(cut, rel=0.02)
        assert (plain_distances(x, np.array(got[level]["centre"]), np.linalg.inv(white.T @ white)) > got[level]["cut"] ** 2).tolist() == [True] * int(400 * share) + [False] * (400 - int(400 * share))
    assert np.abs(centre).max() < 0.3


@pytest.mark.parametrize("share", [0.1, 0.45])
def test_large_groups_are_searched_over_all_their_units(spark, monkeypatch, share):
    x = mixed(2, 3000, share)
    names = ("a", "b", "c")
    df = spark.createDataFrame([("en", "s", *map(float, r)) for r in x] + [("de", "t", *map(float, r)) for r in mixed(3, 90, 0)], "lang string, source string, a double, b double, c double")
    monkeypatch.setattr(quality, "UNIT", 250)
    got = {(r["level"], r["g_lang"]): r for r in fit(df, names).collect()}
    assert {k: r["size"] for k, r in got.items()} == {(0, "=en"): 3000, (1, "=en"): 3000, (2, ""): 3090, (0, "=de"): 90, (1, "=de"): 90}
    centre, cov, cut, _ = plain_estimates(x, np.full(3, quality.FLOOR), 20)
    r = got[0, "=en"]
    white = np.array(r["white"]).reshape(3, 3)
    assert np.allclose(r["centre"], centre, atol=0.1) and np.allclose(np.linalg.inv(white.T @ white), cov, atol=0.2) and r["cut"] == pytest.approx(cut, rel=0.03)
    assert (plain_distances(x, np.array(r["centre"]), np.linalg.inv(white.T @ white)) > r["cut"] ** 2).tolist() == [True] * int(3000 * share) + [False] * (3000 - int(3000 * share))


def test_cases(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    sound = lambda: " ".join(word() for _ in range(120))
    texts = [None, "", "a b c", "x y " * 200, *[sound() for _ in range(150)], " ".join(w + "###" for w in sound().split())]
    rows = [(i, t, None if i % 7 == 0 else "en", "s", 1.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, distance double")
    stats = statistics(df).cache()
    found = {r["doc_id"]: r for r in verdicts(stats).collect()}
    assert len(found) == len(texts)
    assert all(found[i]["base_failed"] and not found[i]["kept"] and found[i]["distance"] is None for i in range(4))
    assert all(found[i]["kept"] for i in range(4, 154))
    assert not found[154]["kept"] and not found[154]["base_failed"]
    assert verdicts(statistics(df.limit(0))).count() == 0
    assert set(FEATURES) < set(stats.columns)


def plain_kept(rows):
    """(id, lang, source, text) to kept, by plain loops."""
    stats = {r[0]: counts(r[3] or "") for r in rows}
    passed = [r for r in rows if stats[r[0]][0] >= 50 and 100 * stats[r[0]][4] <= 50 * stats[r[0]][0]]
    floors = np.array([quality.FLOORS.get(c, quality.FLOOR) for c in FEATURES])
    groups = {}
    for i, lang, source, _ in passed:
        for key in ((lang, source), (lang,), ()):
            groups.setdefault(key, []).append(stats[i][5:])
    known = {}

    def estimates(key):
        if key not in known:
            known[key] = plain_estimates(np.array(groups[key]), floors, 30)
        return known[key]

    out = dict.fromkeys(stats, False)
    for i, lang, source, _ in passed:
        key = next(k for k in ((lang, source), (lang,), ()) if len(groups[k]) >= quality.SMALL or not k)
        centre, cov, cut, _ = estimates(key)
        out[i] = plain_distances(np.array([stats[i][5:]]), centre, cov)[0] <= cut * cut
    return out


def test_query_is_the_plain_one_and_rejects_junk(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", "text").collect()]
    found = {r["doc_id"]: r["kept"] for r in op4_quality(spark, sf).collect()}
    assert found == plain_kept(rows)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stats = {i: counts(t or "") for i, _, _, t in rows}
    passed = [i for i in labels if i in stats and stats[i][0] >= 50 and 100 * stats[i][4] <= 50 * stats[i][0]]
    assert {found[i] for i in passed if labels[i] == 0} == {False} and {found[i] for i in passed if labels[i] == 1} == {True}


def test_a_source_that_is_nearly_half_junk(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    texts = [" ".join(word() + ("#$" if i % 20 < 9 and k % 2 else "") for k in range(120)) for i in range(300)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r["kept"] for r in verdicts(statistics(df).cache()).collect()}
    assert found == {i: i % 20 >= 9 for i in range(300)}
