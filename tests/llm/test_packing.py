import random
from collections import defaultdict

import pytest

from marlstone.llm import packing
from marlstone.llm.packing import pack, pack_documents, plan


def one_by_one(lengths, capacity):
    """Best-fit decreasing as defined: each piece into the open bin with the least room that holds it."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64, 100])
    lengths = [min(capacity, max(1, int(rng.expovariate(3 / capacity)))) for _ in range(rng.randint(1, 300))]
    histogram = defaultdict(int)
    for n in lengths:
        histogram[n] += 1
    used, ranks = defaultdict(list), defaultdict(set)
    for length, rank, count, first, offset in plan(histogram, capacity):
        for k in range(count):
            used[first + k].append((offset, length))
            ranks[length].add(rank + k)
    assert {n: set(range(c)) for n, c in histogram.items()} == ranks
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in x) for x in used.values()) == one_by_one(lengths, capacity)


def rows(df):
    return [r.asDict() for r in df.collect()]


def check(found, capacity):
    places = defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_documents(spark):
    import zlib

    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [None, "", "a", "The  quick\tbrown\nfox's", "x " * 100, "café   café   1234 <|endoftext|>", "x " * 100, "ΣΣ \U0001f642", "a<|endoftext|>b <|startoftext|><|EndOfText|>, the<|endoftext|>."]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)] + [(None, "b", "c")], "doc_id long, text string, length string")
    found = rows(pack_documents(df, path, 16))
    check(found, 16)
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in found if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == [(a, len(ids[a : a + 16])) for a in range(0, len(ids), 16)]
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(np.asarray(ids[a : a + 16], "<u4").tobytes()) for a in range(0, len(ids), 16)]
    assert sum(r["doc_id"] is None for r in found) == 1
    assert pack_documents(df.limit(0), path, 16).count() == 0


def test_without_broadcast(spark):
    """The two ways of looking up the plan agree, also with a length that most pieces have."""
    rng = random.Random(3)
    lengths = [9] * 200 + [rng.randint(0, 40) for _ in range(300)]
    met = defaultdict(int)
    data = []
    for i, n in enumerate(lengths):
        task = i % 5
        data.append((i, n, task, met[task, n]))
        met[task, n] += 1
    cut = spark.createDataFrame(data, "doc_id long, length long, task int, place long")
    a, b = (sorted(map(tuple, pack(cut, 40, most).collect())) for most in (packing.BROADCAST_ROWS, 0))
    assert a == b
    found = [dict(zip(("doc_id", "length", "sequence_id", "offset"), r, strict=True)) for r in a]
    full = [r for r in found if r["length"]]
    assert check(full, 40) == len(one_by_one([n for n in lengths if n], 40))


def test_words_beyond_the_cache(monkeypatch):
    import public_tokenizers as P

    path = P.path("word_bpe_49k.json")
    texts = [" ".join(f"w{i % 97}x{i}" for i in range(j, j + 30)) for j in range(0, 300, 7)]
    whole = packing.encode_all(path, texts)
    monkeypatch.setattr(packing, "MAX_WORDS", 20)
    packing.words_of(path)[1].clear()
    assert [packing.encode_all(path, [x])[0] for x in texts] == whole


def test_words_are_encoded_as_in_the_whole_text():
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(8)
    some = list("abcÀéßÅİΣςK0129٣½ \t\n\r\x0b\x0c\x1c\x1f\x85  　'’.,;:!?%$#*&|()<>-_̸́̊‍漢🙂") + ["'s", "'ll", " ", " ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    for x, got in zip(texts, packing.encode_all(path, texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_query_packs_as_piece_by_piece(spark):
    """Whole query: pieces are those of the library, and there are as many sequences as best-fit decreasing over single pieces makes."""
    import zlib

    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    sf, t = "/root/testdata/sf0.001", Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want, lengths = set(), []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want.add((r["doc_id"], k, a, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
            lengths.append(len(part))
    found = rows(packing.op1_packing(spark, sf))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found} == want and len(found) == len(want)
    assert check(found, 4096) == len(one_by_one(lengths, 4096))


def test_plain_words_go_to_the_model_alone(monkeypatch):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path, rng, sent = P.path("word_bpe_49k.json"), random.Random(5), []
    library, known, special, model = packing.words_of(path)
    known.clear()

    class Seen:
        def encode_batch_fast(self, words, **k):
            sent.extend(words)
            return library.encode_batch_fast(words, **k)

    monkeypatch.setitem(packing._TOKENIZERS, path, (Seen(), known, special, model))
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
    plain = ["".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(5000)] + ["x" * 5000, "schön", "íß"]
    odd = ["it's", "a1b", "e\u0301", "ĳ", "Ünder", "ÉTÉ", "x÷y", "漢字", "\u0130x", "ſ"]
    whole = Tokenizer.from_file(path)
    for x, got in zip(plain + odd, packing.encode_all(path, plain + odd), strict=True):
        assert got == b"".join(i.to_bytes(4, "little") for i in whole.encode(x, add_special_tokens=False).ids), x
    assert sent and not set(sent) & set(plain)
