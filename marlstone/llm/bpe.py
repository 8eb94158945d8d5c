"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The merges of a rank file are compiled into a transducer that reads one byte at a time. Before the determinisation it
has one thread for each place at which a token may still be open: the vocabulary trie node reached since that place,
and the token before it. A token may follow another only if merging their bytes gives those two again, which makes the
tokens of every prefix unique. A deterministic state is the set of live threads; states and their moves are built when
first needed and dropped together when there are too many. A move tells the last token of the prefix read so far: what
came before that is no part of a state, so that few states serve nearly all pieces, and the tokens are followed back from
a piece's end.

Decoding runs a state machine over tokens whose states are the bytes of an unfinished character; text comes out as soon
as its last byte has come.

Nulls count as empty texts, empty texts give no tokens, and texts of any length are taken whole. Repeated rows are
encoded each; an empty table gives an empty result; columns besides the two named ones are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from .common import table, takes_turn

#: So many states, and so many pieces of text, are remembered by a worker before it starts anew.
MAX_STATES, MAX_PIECES = 400_000, 1_200_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """The definition: join the adjacent pair of lowest rank, the leftmost first, until none is in the ranks."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for word, i in ranks.items():
            node = 0
            for b in word:
                after = self.children[node].get(b)
                if after is None:
                    after = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = after
            self.token_at[node] = i
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, tuple[list, list] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self.start = self.state(((0, -1),))

    def state(self, key: tuple) -> int:
        i = self.ids.get(key)
        if i is None:
            i = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        return i

    def spine(self, token: int) -> tuple[list, list] | None:
        """What stands at the token's left and at its right edge while it is being merged, each with the rank at which a
        merge takes it away (none for the token itself); null if merging its bytes doesn't give it."""
        if token in self.spines:
            return self.spines[token]
        word, last = self.bytes_of[token], None
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(((self.ranks[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            last = parts[i : i + 2]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        never = len(self.ranks) + 1
        if len(parts) > 1:
            out = None
        elif last is None:
            out = [(word, token, never)], [(word, token, never)]
        else:
            edges = self.spine(self.ranks[last[0]]), self.spine(self.ranks[last[1]])
            out = tuple([(word, token, never), *((w, r, min(gone, token)) for w, r, gone in side[k])] for k, side in enumerate(edges))
        self.spines[token] = out
        return out

    def follows(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives these two: nothing at ``left``'s right edge ever joins with
        anything at ``right``'s left edge, as what would join is taken away before."""
        if (after := self.spine(right)) is None:
            return False
        if left < 0:
            return True
        rank = self.ranks.get
        for a, made_a, gone_a in self.spine(left)[1]:
            for b, made_b, gone_b in after[0]:
                joined = rank(a + b)
                if joined is not None and joined < gone_a and joined <= gone_b and made_a < gone_b and made_b < gone_a:
                    return False
        return True

    def move(self, i: int, byte: int) -> tuple[int, int]:
        """The last token of what is read with this byte, and the state after it."""
        children, token_at, pairs = self.children, self.token_at, self.pairs
        going, ended = [], -1
        for node, left in self.keys[i]:
            after = children[node].get(byte)
            if after is None:
                continue
            if ended < 0:
                token = token_at[after]
                if token >= 0:
                    pair = left << 32 | token
                    ok = pairs.get(pair)
                    if ok is None:
                        if len(pairs) > 500_000:
                            pairs.clear()
                        ok = pairs[pair] = self.follows(left, token)
                    if ok:
                        ended = token
            if children[after]:
                going.append((after, left))
        if ended < 0:
            raise ValueError("no token ends here: the ranks lack a byte")
        going.append((0, ended))
        found = self.moves[i][byte] = ended, self.state(tuple(going))
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one piece; a piece that is itself a token is that token, as in the tiktoken library."""
        if (i := self.ranks.get(piece)) is not None:
            return (i,)
        if len(self.keys) > self.max_states:
            self.reset()
        last: list[int] = []
        at, moves = self.start, self.moves
        for b in piece:
            token, at = moves[at].get(b) or self.move(at, b)
            last.append(token)
        out, size_of, i = [], self.size_of, len(last)
        while i:
            token = last[i - 1]
            out.append(token)
            i -= size_of[token]
        out.reverse()
        return tuple(out)


class StreamDecoder:
    """Tokens to text, whatever way the tokens are cut into calls. An unfinished character waits for its next bytes."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        self.held = b""

    @staticmethod
    def split(data: bytes) -> tuple[str, bytes]:
        """Text that is complete, and the bytes of a character that isn't. Bytes that can't be become U+FFFD."""
        need, i = 0, len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                need = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2
                if need > back:
                    i = len(data) - back
                break
            if b < 0x80:
                break
        return data[:i].decode("utf-8", "replace"), data[i:]

    def feed(self, ids: Iterable[int]) -> str:
        held, out = self.held, []
        moves = self.moves[held]
        for i in ids:
            got = moves.get(i)
            if got is None:
                if len(moves) > 100_000:
                    moves.clear()
                got = moves[i] = self.split(held + self.bytes_of[i])
                self.moves.setdefault(got[1], {})
            text, after = got
            if after is not held:
                held, moves = after, self.moves[after]
            out.append(text)
        self.held = held
        return "".join(out)

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


class Codec:
    """Splits text by a pattern, encodes each match, and remembers the pieces seen."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.fst = Transducer(load_ranks(path))
        self.decoder = StreamDecoder(self.fst.bytes_of)
        self.pieces: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        pieces = self.pieces
        for p in self.split(text):
            ids = pieces.get(p)
            if ids is None:
                ids = self.fst.encode(p.encode())
                if len(pieces) >= MAX_PIECES:
                    self.halve()
                pieces[p] = ids
            out += ids
        return out

    def halve(self) -> None:
        """Forgets the later half: frequent pieces come early and stay."""
        for p in list(islice(reversed(self.pieces), len(self.pieces) // 2)):
            del self.pieces[p]

    def decode(self, ids: list[int]) -> str:
        return self.decoder.feed(ids) + self.decoder.finish()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each file in a worker, kept between its tasks."""
    takes_turn("bpe", _CODECS.clear)
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _batches(it: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[list, list]]:
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int), one row for each row of ``df``."""
    kind = df.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("ids", pa.list_(pa.int32()))])

    def run(it):
        c = codec(path, pattern)
        for keys, texts in _batches(it):
            yield pa.RecordBatch.from_pydict({id_col: keys, "ids": [c.encode(t or "") for t in texts]}, schema=schema)

    return df.select(df[id_col], df[text_col]).mapInArrow(run, f"{id_col} {kind.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text``; null or empty ids give an empty text."""
    kind = df.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("text", pa.string())])

    def run(it):
        c = codec(path, pattern)
        for keys, ids in _batches(it):
            yield pa.RecordBatch.from_pydict({id_col: keys, "text": [c.decode(x or []) for x in ids]}, schema=schema)

    return df.select(df[id_col], df[ids_col]).mapInArrow(run, f"{id_col} {kind.simpleString()}, text string")


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A round trip for each row in one pass: number of tokens, digest of the ids, digest of the bytes decoded from them."""
    kind = df.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(it):
        c = codec(path, pattern)
        names = {i: str(i) for i in c.fst.bytes_of}
        for keys, texts in _batches(it):
            n, a, b = [], [], []
            for t in texts:
                ids = c.encode(t or "")
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], schema=schema)

    return df.select(df[id_col], df[text_col]).mapInArrow(run, f"{id_col} {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents")
    return digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
