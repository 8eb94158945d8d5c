from marlstone.llm import toxicity
from marlstone.llm.toxicity import KINDS, Grammar, fit, logistic, op7_toxicity, score


def test_clauses_not_words():
    g = Grammar({"fool": 2.0, "nitw*": 1.0})
    kinds = lambda t: dict(zip(KINDS, g.kinds(t)))
    assert kinds("A fool came.")["plain"] == 2
    assert kinds("You are a fool, and a Nitwitted one.")["addressed"] == 2 and kinds("You are a fool, and a Nitwitted one.")["plain"] == 1
    assert kinds("He is not a fool")["negated"] == 2
    assert kinds("he said fool")["reported"] == 2 and kinds("the word “fool” is old")["reported"] == 2
    assert kinds("I kill you; I kill time")["threat"] == kinds("I kill you; I kill time")["soft_threat"] == 1 and kinds("you I kill")["threat"] == 1
    assert not any(kinds("no such words here").values()) and g.kinds("") == [0.0] * len(KINDS) + [0.0]


def test_composition_is_the_product_of_its_parts():
    import itertools

    c = toxicity.Composed(toxicity.machines())
    for symbols in itertools.product(range(7), repeat=4):
        state, each = c.start, [0] * 5
        for s in symbols:
            state, out = c.step(state, s)
            for i, m in enumerate(toxicity.machines()):
                each[i], o = m.step(each[i], s)
                assert out[i] == o
        assert state == tuple(each)


def test_learns_from_labels_alone(spark):
    rows = [(i, ("a b c " * 20) + ("vile vilest " if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(None, "x", "y"), (1000, None, "z"), (1001, "", "z"), (1002, "a " * 50_000 + "vile", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "id long, toxic int")
    model = fit(df.selectExpr("doc_id id", "text"), labels)
    assert "vile" in model[0] and "a" not in model[0]
    found = {r["doc_id"]: r["score"] for r in score(df, model).collect()}
    assert len(found) == 94 and all(0 <= s <= 1 for s in found.values())
    assert all((found[i] >= 0.5) == bool(y) for i, _, y in rows)
    assert found[1000] == found[1001] < 0.5
    assert score(df.limit(0), model).count() == 0
    none = fit(df.selectExpr("doc_id id", "text"), labels.where("toxic = 0"))
    assert {r["score"] for r in score(df, none).collect()} == {0.0}


def test_logistic():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.c_[np.ones(500), rng.normal(size=500)]
    y = (x[:, 1] + rng.normal(size=500) * 0.5 > 0).astype(float)
    assert ((x @ logistic(x, y) > 0) == y).mean() > 0.8


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in found}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.9
    assert n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.99


def test_negating_or_quoting_lowers_a_score(spark):
    sf = "/root/testdata/sf0.1"
    model = toxicity.fitted(spark, sf)
    stem = max((k for k in model[0] if not k.endswith("*")), key=model[0].get)
    about, at, negated, said, quoted = texts = [f"He is a {stem}.", f"You are a {stem}.", f"You are not a {stem}.", f"He said you are a {stem}.", f"The word “{stem}” is old."]
    none = ["You are a friend.", "I kill time.", "Nothing here."]
    threat = "I will kill you."
    found = {r["doc_id"]: r["score"] for r in score(spark.createDataFrame(list(zip([*texts, *none, threat], [*texts, *none, threat])), "doc_id string, text string"), model).collect()}
    assert found[at] >= found[about] > max(found[negated], found[said], found[quoted]) > found[none[0]] == found[none[1]] == found[none[2]]
    assert found[threat] > found[none[1]]
    assert found[at] >= 0.5 > found[none[0]]


def test_weights_never_fall():
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.c_[np.ones(400), rng.random(400), rng.random(400)]
    y = (x[:, 1] - x[:, 2] + rng.normal(size=400) * 0.3 > 0).astype(float)
    w = toxicity.rising(x, y)
    assert w[1] > 0 == w[2]
