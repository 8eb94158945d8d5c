"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length.

Best-fit decreasing looks at pieces only by length, and there are no more lengths than tokens in a sequence. So the
driver packs the histogram: from the longest length down, a segment tree over remaining capacities finds the tightest
open one in logarithmic time, and all bins of that capacity are filled at once with equal pieces. The outcome is the one
of placing the pieces one by one, over all of them, and its plan has a row for each run of equal pieces in equal bins.
Executors then only rank the pieces of each length: inside a task while tokenising, between tasks by a sum over the
tasks' counts, so that a length that a third of all pieces have is spread over as many tasks as it came from.

Null texts count as empty. An empty document is its end token. Ties (equal lengths) fall in the order of the stored
pieces; repeated rows are packed each; an empty table gives an empty result; null ids are kept; other columns are ignored.
Texts of any length are tokenised whole and cut. Ids are those of the plain library call: special tokens that stand in a
text become their ids.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections import defaultdict, deque
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored, table, takes_turn

#: Words remembered by a worker.
MAX_WORDS = 1_000_000
#: Rows of a plan that are broadcast (40 bytes each); beyond, pieces are joined with the plan.
BROADCAST_ROWS = 1_000_000


class Capacities:
    """A segment tree over remaining capacities 0 to ``top``; a node says whether a bin below it is open."""

    def __init__(self, top: int):
        self.size = 1 << max(1, top).bit_length()
        self.open = bytearray(2 * self.size)
        self.runs: dict[int, deque] = defaultdict(deque)

    def add(self, capacity: int, first: int, count: int) -> None:
        runs = self.runs[capacity]
        if runs and runs[-1][0] + runs[-1][1] == first:
            runs[-1] = (runs[-1][0], runs[-1][1] + count)
        else:
            runs.append((first, count))
        i = self.size + capacity
        while i and not self.open[i]:
            self.open[i] = 1
            i >>= 1

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins of the first run."""
        runs = self.runs[capacity]
        first, count = runs.popleft()
        if count > most:
            runs.appendleft((first + most, count - most))
            return first, most
        if not runs:
            i = self.size + capacity
            self.open[i] = 0
            i >>= 1
            while i and not (self.open[2 * i] or self.open[2 * i + 1]):
                self.open[i] = 0
                i >>= 1
        return first, count

    def tightest(self, length: int) -> int:
        """The least open capacity of ``length`` or more, -1 if there is none."""
        i = self.size + length
        if self.open[i]:
            return length
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, rank, count, sequence, offset): pieces of that length ranked ``rank`` to ``rank + count - 1`` start
    at ``offset`` of the sequences from ``sequence`` on."""
    bins, made, rows = Capacities(capacity), 0, []
    for length in sorted((x for x in histogram if x), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            fresh = room < 0
            room = capacity if fresh else room
            each = room // length
            if left >= each:
                if fresh:
                    first, n = made, left // each
                    made += n
                else:
                    first, n = bins.take(room, left // each)
            else:
                each, n = left, 1
                if fresh:
                    first = made
                    made += 1
                else:
                    first, _ = bins.take(room, 1)
            for k in range(each):
                rows.append((length, rank, n, first, capacity - room + k * length))
                rank += n
            left -= each * n
            bins.add(room - each * length, first, n)
    rank = histogram.get(0, 0)
    if rank:  # pieces without tokens share a sequence
        rows.append((0, 0, rank, 0 if made else -1, 0))
    return rows


class Marks:
    """Tells whether a word holds a special token, in letters of any case; most words are told by what all of them begin with."""

    def __init__(self, marks: tuple[bytes, ...]):
        self.begin = re.match(rb"[^A-Za-z]*", os.path.commonprefix(marks))[0] if marks else None
        self.any = re.compile(b"|".join(map(re.escape, marks)), re.IGNORECASE)

    def within(self, word: bytes) -> bool:
        return self.begin is not None and self.begin in word and self.any.search(word) is not None


#: Words of these letters alone are what the normalisers below leave as it is and the pattern takes in one match.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The letters that stand for bytes in a byte-level vocabulary.
_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def model_of(t):
    """The call of the tokenizer's model for a word of PLAIN letters, or null where the steps before it may change or cut
    such a word."""
    spec = json.loads(t.to_str())
    steps = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
    if not steps or spec["post_processor"] or spec["truncation"] or spec["padding"] or spec["model"]["type"] != "BPE" or spec["model"]["dropout"]:
        return None
    return None if any(PLAIN.fullmatch(x["content"].lower()) for x in spec["added_tokens"]) else t.model.tokenize


_TOKENIZERS: dict[str, tuple] = {}


def words_of(path: str):
    """The tokenizer, the ids of words met so far (little-endian, 4 bytes an id), kept in a worker between tasks, a pattern of its special tokens, and its model_of()."""
    takes_turn("packing", _TOKENIZERS.clear)
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are kept as little-endian 4-byte numbers")
        t = Tokenizer.from_file(path)
        marks = tuple(x.content.encode() for x in t.get_added_tokens_decoder().values())
        _TOKENIZERS[path] = t, {}, Marks(marks), model_of(t)
    return _TOKENIZERS[path]


#: Cut off the end of a word where they follow a letter or digit: the tokenizer splits there anyway, and words without them repeat more.
MARKS = b".,;:!?%$#*&|()"


def parts_of(word: bytes, special: Marks) -> tuple[bytes, ...]:
    """What may be encoded for itself. A word that holds a special token, in letters of any case, stays as it is: only its
    own spelling is one, and it has an id of its own."""
    if special.within(word):
        return (word,)
    base = word.rstrip(MARKS)
    if base and len(base) < len(word) and base.decode()[-1].lower()[-1].isalpha():  # one letter becomes a letter and a mark
        return base.lower(), word[len(base) :]
    return (word.lower(),)


def encode_all(path: str, texts: list[str]) -> list[bytes]:
    """The ids of each text. The vocabulary drops white space and never looks across it, so that words are encoded once."""
    t, known, special, model = words_of(path)
    split = [x.encode().split() if x else [] for x in texts]
    if len(known) > MAX_WORDS:
        for w in list(islice(reversed(known), len(known) // 2)):  # frequent words come early and stay
            del known[w]
    new = set().union(*split).difference(known)
    cut = {w: parts_of(w, special) for w in new}
    parts = list({p for x in cut.values() for p in x}.difference(known))
    others = []
    for p in parts:
        x = p.decode()
        if model and PLAIN.fullmatch(x):
            known[p] = array("I", [k.id for k in model(x if x.isascii() else p.decode("latin-1").translate(_LETTERS))]).tobytes()
        else:
            others.append(x)
    for x, e in zip(others, t.encode_batch_fast(others, add_special_tokens=False), strict=True):
        known[x.encode()] = array("I", e.ids).tobytes()
    for w, x in cut.items():
        if w not in known:
            known[w] = known[x[0]] if len(x) == 1 else known[x[0]] + known[x[1]]
    return [b"".join(map(known.__getitem__, words)) for words in split]


def pieces(df: DataFrame, path: str, limit: int, end: int | None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, task, place[, ids]): each document's ids, with ``end`` after them, cut
    only where they exceed ``limit``. ``place`` counts the pieces of that length that the task had before."""
    kind = df.schema[id_col].dataType
    fields = [(id_col, to_arrow_type(kind)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("place", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * keep_ids)
    tail = b"" if end is None else np.asarray([end], "<u4").tobytes()

    def run(it):
        from pyspark import TaskContext

        task, met = TaskContext.get().partitionId(), defaultdict(int)
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for key, ids in zip(part.column(0).to_pylist(), encode_all(path, part.column(1).to_pylist()), strict=True):
                    ids += tail
                    for k, i in enumerate(range(0, max(len(ids), 1), 4 * limit)):
                        own = ids[i : i + 4 * limit]
                        n = len(own) // 4
                        rows.append((key, k, i // 4, n, zlib.crc32(own), task, met[n], *[own] * keep_ids))
                        met[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ddl = f"{id_col} {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, place long" + ", ids binary" * keep_ids
    return df.select(df[id_col], df[text_col]).mapInArrow(run, ddl)


def pack(cut: DataFrame, capacity: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``cut`` (a stored table with length, task, place as pieces() gives them) with ``sequence_id`` and ``offset`` instead of task and place."""
    spark = cut.sparkSession
    counts = stored(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length: capacity + 1 at most
    rows = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases.hint("merge"), ["length", "task"])  # a row for each length and task: not to be broadcast
    ranked = ranked.withColumn("rank", F.col("base") + F.col("place")).drop("base", "place", "task")
    kept = [c for c in cut.columns if c not in ("task", "place")]
    if len(rows) > broadcast_rows:
        steps = spark.createDataFrame(rows, "p_length long, p_rank long, p_count long, p_first long, offset long")
        found = ranked.join(steps, (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_rank")) & (F.col("rank") < F.col("p_rank") + F.col("p_count")))
        return found.select(*kept, F.when(F.col("length") > 0, F.col("p_first") + F.col("rank") - F.col("p_rank")).otherwise(F.col("p_first")).alias("sequence_id"), "offset")
    steps = np.asarray(sorted(rows), np.int64).reshape(-1, 5)
    wide = int(max(histogram.values(), default=0)) + 1
    shared = spark.sparkContext.broadcast((steps[:, 0] * wide + steps[:, 1], steps))
    schema = [(f.name, to_arrow_type(f.dataType)) for f in cut.select(*kept).schema] + [("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(schema)

    def run(it):
        starts, steps = shared.value
        for batch in it:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = steps[np.searchsorted(starts, length * wide + rank, "right") - 1]
            sequence = row[:, 3] + np.where(length > 0, rank - row[:, 1], 0)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(sequence), pa.array(row[:, 4])], schema=schema)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(*kept).schema) + ", sequence_id long, offset long"
    return ranked.select(*kept, "rank").mapInArrow(run, ddl)


def pack_documents(df: DataFrame, path: str, capacity: int = 4096, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, [ids,] sequence_id, offset), one for each piece."""
    return pack(stored(pieces(df, path, capacity, end, id_col, text_col, keep_ids), "packing-pieces"), capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack_documents(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))
