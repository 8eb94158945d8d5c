import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.llm import lines
from marlstone.llm.lines import dedup, op10_lines


def tokens(line):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def plainly(rows):
    """(id, text) to kept text by comparing each line with all lines of other documents or places before it."""
    last = 1 << 62
    every = sorted({(last if i is None else i, no, t, line) for i, t in rows if t is not None for no, line in enumerate(t.split("\n")) if tokens(line)}, key=lambda x: x[:2])
    sets = [tokens(x[3]) for x in every]
    gone = set()
    for k, (i, no, t, _) in enumerate(every):
        for q in range(k):
            j, other, u, _ = every[q]
            if (j, other) >= (i, no) or (j == i and i == last and u != t and False):
                continue
            both = len(sets[q] & sets[k])
            if 100 * both >= 80 * (len(sets[q]) + len(sets[k]) - both):
                gone.add((i, no, t))
                break
    return [(i, None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (last if i is None else i, no, t) not in gone)) for i, t in rows]


def varied(rng, line, change):
    return " ".join(rng.choice("xyz") * 3 if rng.random() < change else w for w in line.split(" "))


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcde", k=rng.choice([1, 2, 4])))
    pool = [" ".join(word() for _ in range(rng.choice([2, 4, 5, 6, 9, 20, 45]))) for _ in range(12)]
    texts = []
    for _ in range(n):
        own = [varied(rng, rng.choice(pool), rng.choice([0, 0, 0.01, 0.03, 0.1])) if rng.random() < 0.7 else " ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        texts.append("\n".join(own))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_is_the_join_of_all_pairs(spark, seed):
    rows = list(enumerate(corpus(seed)))
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = dedup(df).collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == sorted(plainly(rows))
    assert any(r["gone"] for r in found)


def test_cases(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, f"{a}\n{b}"), (2, None), (3, ""), (4, "\n\n"), (5, f"  {a.replace(' ', chr(9))}  \nshort line"), (6, "short line\nshort line"), (6, f"{b}"), (7, f"{b}\n{a}"), (7, f"{b}\n{a}"), (None, f"{a}\nnew words that nobody else has"), (8, "x " * 60_000)]
    df = spark.createDataFrame([(*r, 5, "c") for r in rows], "doc_id long, text string, n_lines int, t string")
    found = dedup(df)
    assert found.columns == df.columns
    got = sorted(((r["doc_id"] or 99, r["text"]) for r in found.collect()), key=str)
    want = [(1, f"{a}\n{b}"), (2, None), (3, ""), (4, "\n\n"), (5, "short line"), (6, ""), (6, ""), (7, ""), (7, ""), (99, "new words that nobody else has"), (8, "x " * 60_000)]
    assert got == sorted(want, key=str)
    assert dedup(df.limit(0)).count() == 0


def test_one_line_that_a_third_of_all_rows_hold(spark, monkeypatch):
    monkeypatch.setattr(lines, "MANY", 3)
    texts = [t + "\nAll rights reserved.\nthis one line of seven words stands everywhere" * (i % 3 == 0) for i, t in enumerate(corpus(4))]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in dedup(df).collect()) == sorted(plainly(rows))


def test_columns_may_be_called_anything(spark):
    cols = ["doc_id", "text", "__i", "__t", "__id", "__h", "__gone", "s", "h", "no", "line"]
    df = spark.createDataFrame([(1, "a\nb", *range(9)), (2, "b\nc", *range(9))], ", ".join(f"`{c}` {'string' if c == 'text' else 'long'}" for c in cols))
    found = dedup(df, count_col="how_many", gone_col="went")
    assert found.columns == [*cols, "how_many", "went"]
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a\nb", *range(9), 2, []), (2, "c", *range(9), 2, [0])]


def test_runs_no_python_on_executors(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(corpus(9, 20))), "doc_id long, text string")
    plans = []
    own = lines.stored
    monkeypatch.setattr(lines, "stored", lambda d, *a: (plans.append(d._jdf.queryExecution().toString()), own(d, *a))[1])
    d = dedup(df)
    plans.append(d._jdf.queryExecution().toString())
    assert len(plans) > 4 and not any(re.search("Python|Pandas|ArrowEval", p) for p in plans)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((r["doc_id"], r["text"]) for r in op10_lines(spark, sf).collect()) == sorted(plainly(rows))


def test_filters_do_not_stand_in_plans(spark):
    """200,000 keys take 333 KB, which in a plan would be as many hex digits in each of its forms, and kept by the driver."""
    few = lines.Members(lines.stored(spark.range(200_000).select((F.col("id") * 3).alias("k")), "keys"))
    df = spark.range(600_000).where(few.maybe(F.col("id")))
    assert df.where("id % 3 = 0").count() == 200_000 and df.count() < 250_000
    assert len(df._jdf.queryExecution().toString()) < 20_000
