"""Near-duplicate documents against all pairs, on a fixture of which one group holds most rows."""

import random
import re

import numpy as np
import pyarrow as pa

from marlstone import catalog
from marlstone.operators import overlap
from marlstone.operators.overlap import packed, trigram_sets, unpacked


def plainly(rows):
    least = {}
    for i, text, lang, source in rows:
        if text is not None and lang is not None and source is not None:
            key = (lang, source, tuple(re.findall("[a-z0-9]+", text.lower())))
            least[key] = min(i, least.get(key, i))
    every = [(i, lang, source, w, {w[k : k + 3] for k in range(len(w) - 2)}) for (lang, source, w), i in least.items()]
    out = set()
    for i, lang, source, w, g in every:
        for j, other, place, v, h in every:
            if i < j and (lang, source) == (other, place) and (len(w) >= 6 and w[:6] == v[:6] or g & h and 2 * len(g & h) >= len(g | h)):
                out.add((i, j))
    return out


def test_near_dup_trigram_jaccard_reads_documents(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcd", k=rng.choice([1, 2, 3])))
    pool = [[word() for _ in range(rng.choice([2, 5, 6, 9, 30, 80]))] for _ in range(25)]
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "one two three four", None, "a"), (4, "one two three four", None, "a")]
    for i in range(5, 320):
        change = rng.choice([0, 0.03, 0.1, 0.2])
        w = [word() if rng.random() < change else x for x in rng.choice(pool)] if rng.random() < 0.8 else [word() for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(w).title(), "en" if i % 5 else "de", "a" if i % 7 else "b"))
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()["near_dup_trigram_jaccard"](spark, str(tmp_path))
    got = [(r["first_id"], r["doc_id"]) for r in found.collect()]
    want = plainly(rows)
    assert len(want) > 40 and sorted(got) == sorted(want)


def sent(spark):
    """Bytes written for shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    jvm, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_near_dup_trigram_jaccard_sends_few_bytes(spark, tmp_path):
    rng = random.Random(4)
    texts = [[f"w{rng.randrange(30_000)}" for _ in range(600)] for _ in range(500)]
    texts += [[w if rng.random() < 0.95 else "x" for w in t] for t in texts[:20]]
    rows = [(i, " ".join(w), "en", "a") for i, w in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    before = sent(spark)
    found = [tuple(r) for r in catalog.queries()["near_dup_trigram_jaccard"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(plainly(rows)) and len(found) > 15
    assert sum(n for k, n in sent(spark).items() if k not in before) < 8 * sum(len(w) - 2 for w in texts)


def test_trigrams_by_bytes(monkeypatch):
    texts = ["", "a", "a b", "a b c", "a b c a b c", "b c a", "aa b c", "a a b c", "c b a", "long" * 40 + " b c", "a b c d"]
    sets = trigram_sets([t.encode() for t in texts], np.zeros(len(texts), np.int64))
    plain = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    assert all(len(np.intersect1d(s, t)) == len(p & q) for s, p in zip(sets, plain) for t, q in zip(sets, plain))
    other = trigram_sets([b"a b c"], np.array([-7]))[0]
    assert len(other) == 1 and not len(np.intersect1d(other, sets[3]))
    monkeypatch.setattr(overlap, "TEXT_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"key": np.zeros(len(texts), np.int64), "joined": texts})
    parts = list(overlap.sliced([batch, batch.slice(2, 0), batch.slice(3)]))
    assert len(parts) > 6 and [s.tolist() for _, x in parts for s in x] == [s.tolist() for s in sets + sets[3:]]
    assert [t for part, _ in parts for t in part.column("joined").to_pylist()] == texts + texts[3:]
    for nodes in ([5], [0, 0, 255], [3, 300, 70_000], [1, 1 << 33], [-4, -4, 2]):
        assert unpacked(packed(np.array(nodes))).tolist() == nodes


def test_pairs_of_large_clusters_in_several_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(overlap, "SETS", 5)
    monkeypatch.setattr(overlap, "PAIRS", 20)
    rng = random.Random(6)
    bases = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(4)]
    rows = [(i, " ".join(f"v{rng.randrange(9)}" if rng.random() < 0.06 else w for w in bases[i % 4]), "en", "a") for i in range(100)]
    rows += [(7, "one of two rows of an id and some more words", "en", "a"), (200, "one of two rows of an id and other words", "en", "b"), (7, "one of two rows of an id and other words", "en", "b")]
    rows += [(None, rows[0][1] + " more", "en", "a"), (200, "one of two rows of an id and some words more", "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in catalog.queries()["near_dup_trigram_jaccard"](spark, str(tmp_path)).collect()]
    want = plainly([r for r in rows if r[0] is not None])
    assert sorted(found) == sorted(want) and len(want) > 300
