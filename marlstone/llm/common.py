"""What the operators of this folder share: inputs, cut lineage, executors' hashing."""

from __future__ import annotations

import gc
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import shared_dir, stored

__all__ = ["Members", "fresh", "shared_dir", "stored", "table", "takes_turn"]

#: Bits that a member filter has for each key, and bits it has at most: 4 MB. Fuller filters let more through, which the exact join behind them sorts out.
BITS_EACH, BITS_MOST = 10, 24_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores after it, so that no column of ``df`` is called so (in any case of letters)."""
    met = {c.lower() for c in df.columns}
    while name.lower() in met:
        name += "_"
    return name


class Members:
    """A filter of 64-bit keys, sized by their number: true for each member, and for few others. Six bits a byte, so that
    bytes are ASCII and can be looked up as a string. They are stored, and a scalar subquery reads them where the filter is
    used: in a literal they would stand in each text and copy that the driver makes and keeps of a plan, as hex digits."""

    def __init__(self, keys: DataFrame):
        """``keys``: one long column, stored; repeated keys do no harm."""
        word = 60
        wanted = min(max(keys.count() * BITS_EACH, 6 * word), BITS_MOST)
        self.places = -(-wanted // word) * word
        place = self.place(F.col(keys.columns[0]))
        words = keys.select(F.floor(place / word).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % word).cast("int")).alias("b"))
        found = words.groupBy("w").agg(F.bit_or("b").alias("b")).where("w is not null").toArrow()  # a row for each 60 places at most
        bits = np.zeros((self.places // word, word // 6), np.uint8)
        b = found.column("b").to_numpy()
        bits[found.column("w").to_numpy()] = (b[:, None] >> np.arange(0, word, 6)) & 63
        spark = keys.sparkSession
        row = spark.createDataFrame([(bytearray(bits.ravel() + np.uint8(64)),)], "bits binary").coalesce(1)
        self.table = stored(row, "members")

    def place(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.places))

    def maybe(self, key: Column) -> Column:
        """False for keys that are surely no members; null keys are none."""
        place = self.place(key)
        byte = F.ascii(F.substring(self.table.scalar(), F.floor(place / 6).cast("int") + 1, 1).cast("string"))
        return key.isNotNull() & (F.floor(byte / F.pow(F.lit(2), place % 6)).cast("int") % 2 == 1)


_CACHES: dict[str, Callable[[], None]] = {}


def takes_turn(name: str, clear: Callable[[], None]) -> None:
    """To be called where a task begins to fill a cache that its worker keeps. The caches of other operators that ran in
    this worker before are emptied, so that a pipeline's stages don't add up; and the collector of cycles, of which
    caches have none, looks at them less often."""
    for other, empty in _CACHES.items():
        if other != name:
            empty()
    if name not in _CACHES:
        gc.set_threshold(100_000, 50, 1000)
    _CACHES[name] = clear
