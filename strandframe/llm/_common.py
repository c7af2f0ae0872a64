"""Helpers shared by the training-data operators: shared tables, Arrow slices, word caches, hash tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Text handled at once by a Python worker; a longer single text is handled alone.
SLICE_BYTES = 2 << 20
#: Distinct strings a worker remembers before it starts its cache anew.
CACHE_ENTRIES = 300_000
#: Rows of an Arrow batch at most: a batch of whole documents is held several times over, in the JVM and in Python.
BATCH_ROWS = 1000


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it again: lineage ends there, and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strandframe_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_strandframe_path", None)
    if path:
        jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows sent to a Python worker at once, unless the session has a lower bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a sieve at most: its broadcast has one row of two longs for each 64 of them.
SIEVE_BITS = 1 << 25


def sieve(keys: DataFrame, *cols: str) -> Callable[[DataFrame], DataFrame]:
    """A function that adds `maybe` to a table with the same columns: false only where keys surely lacks the row's values.

    A bitmap of hashes of bounded size, so that rows without a partner needn't be shuffled to find that out.
    """
    bits = 1 << min(SIEVE_BITS.bit_length() - 1, max(12, (16 * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64(*cols), F.lit(bits))
    word, bit = F.shiftright(slot, 6).alias("sieve_word"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = materialize(keys.select(word, bit.alias("bit")).groupBy("sieve_word").agg(F.bit_or("bit").alias("sieve_bits")), "sieve")

    def mark(df: DataFrame) -> DataFrame:
        out = df.withColumn("sieve_word", word).join(F.broadcast(words), "sieve_word", "left")
        return out.withColumn("maybe", F.coalesce(F.col("sieve_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("sieve_word", "sieve_bits")

    return mark


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts batches into runs of rows of about `limit` bytes of text; nulls become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
        size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right"))
            end = max(at + 1, end)
            yield batch.slice(at, end - at), [x or b"" for x in col.slice(at, end - at).to_pylist()]
            at = end


class Numbered(dict):
    """Numbers strings as they are first looked up; `new` holds those not yet taken by fresh()."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.new.append(key)
        return n

    def fresh(self) -> list:
        out, self.new = self.new, []
        return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def run_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of rows; 0 for an empty run."""
    cum = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=cum[1:])
    ends = np.cumsum(lengths)
    return cum[ends] - cum[ends - lengths]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, so that polynomial sums order like random numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class HashTable:
    """Open-addressed numpy table from distinct uint64 keys to int64 values; absent keys give `default`."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: int = -1):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask, self.default = np.uint64(64 - bits), (1 << bits) - 1, default
        self.keys = np.full(1 << bits, self.EMPTY)
        self.values = np.full(1 << bits, default, np.int64)
        keys, values = np.asarray(keys, np.uint64), np.asarray(values, np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == self.EMPTY
            first = np.unique(np.where(free, at, -1), return_index=True)
            own = first[1][first[0] >= 0]
            self.keys[at[own]], self.values[at[own]] = keys[own], values[own]
            left = np.ones(len(keys), bool)
            left[own] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], self.default)
        open_ = np.flatnonzero((found != keys) & (found != self.EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != self.EMPTY)]
        return out
