import base64
import hashlib
import random

import pytest

from marlstone.llm import bpe
from marlstone.llm.bpe import Codec, StreamDecoder, Transducer, load_ranks, merge, op2_bpe


@pytest.fixture(scope="module")
def own():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    return Codec(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


def test_as_the_library(own):
    codec, library = own
    rng = random.Random(1)
    words = list(codec.fst.ranks)
    for _ in range(3000):
        x = b"".join(rng.choices(words, k=rng.randint(1, 6))).decode("utf-8", "ignore")
        y = "".join(rng.choice("abcdeéßñ漢字🙂ا \n\t'1290!?ש") for _ in range(rng.randint(0, 60)))
        for text in (x, y):
            ids = codec.encode(text)
            assert ids == library.encode_ordinary(text)
            assert codec.decode(ids) == text


def test_few_states_and_pieces(own, monkeypatch):
    codec, library = own
    monkeypatch.setattr(codec.fst, "max_states", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 10)
    codec.pieces.clear()
    text = " ".join(f"wörd{i}ing" for i in range(300))
    assert codec.encode(text) == library.encode_ordinary(text)


def test_few_states_serve_many_words(own):
    """A state holds what may still be open, not all that came before: new words soon meet states that are there."""
    rng = random.Random(3)
    syllables = sorted({rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice(["", "n", "r", "s"]) for _ in range(200)})
    words = list(dict.fromkeys(" " + "".join(rng.choices(syllables, k=rng.randint(2, 5))) for _ in range(20_000)))
    fst = Transducer(own[0].fst.ranks)
    for w in words:
        assert list(fst.encode(w.encode())) == own[1].encode_ordinary(w)
    assert len(fst.keys) < 2.8 * len(words)  # with all open tokens in a state: 3.7


@pytest.mark.parametrize("seed", range(10))
def test_random_vocabularies(seed, tmp_path):
    """Merges learned from random text by joining the commonest pair, as any byte-level vocabulary is made."""
    rng = random.Random(seed)
    ranks = {bytes([b]): i for i, b in enumerate(range(256))}
    text = "".join(rng.choices("abc", weights=[5, 3, 1], k=400)).encode()
    parts = [text[i : i + 1] for i in range(len(text))]
    for _ in range(60):
        pairs = {}
        for a, b in zip(parts, parts[1:]):
            pairs[a + b] = pairs.get(a + b, 0) + 1
        best = max((p for p in pairs if p not in ranks), key=lambda p: (pairs[p], p), default=None)
        if best is None:
            break
        ranks[best] = len(ranks)
        done, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and parts[i] + parts[i + 1] == best:
                done.append(best)
                i += 2
            else:
                done.append(parts[i])
                i += 1
        parts = done
    fst = Transducer(ranks)
    for _ in range(400):
        piece = bytes(rng.choices(b"abc", weights=[5, 3, 1], k=rng.randint(1, 40)))
        want = [ranks[piece]] if piece in ranks else merge(ranks, piece)
        assert list(fst.encode(piece)) == want
    (tmp_path / "v").write_bytes(b"\n".join(base64.b64encode(k) + b" " + str(i).encode() for k, i in ranks.items()))
    assert load_ranks(str(tmp_path / "v")) == ranks


def test_streams_of_any_cut():
    data = "aé漢🙂z".encode()
    decoder = StreamDecoder({i: bytes([i]) for i in range(256)})
    out = [decoder.feed([b]) for b in data]
    assert "".join(out) + decoder.finish() == "aé漢🙂z" and out[1] == ""
    assert decoder.feed([0xE6, 0xBC]) + decoder.finish() == "�"


def test_frames(spark, own):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    texts = [None, "", "Schöne Grüße", "word " * 30_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "x", "y")], "doc_id long, text string, ids string")
    coded = bpe.encode(df, path, P.PATTERN)
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {i: own[1].encode_ordinary(t or "") for i, t in enumerate(texts)} | {None: own[1].encode_ordinary("x")}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(coded, path, P.PATTERN).collect()} == {i: t or "" for i, t in enumerate(texts)} | {None: "x"}
    assert bpe.digests(df.limit(0), path, P.PATTERN).count() == 0


def test_query(spark, own):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op2_bpe(spark, sf).collect():
        ids = own[1].encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
