"""Hashes of k-mers in numpy, and bitmaps of bounded size that tell which of them can meet anything at all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15
#: Bits of a bitmap at most, 16 MB.
MOST_BITS = 1 << 27


def codes_of(text: str | None) -> np.ndarray:
    """Code points plus one, so that no hash starts from zero."""
    return np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k codes, put together from runs of powers of two."""
    if not 0 < k <= len(codes):
        return np.zeros(0, np.uint64)
    out, have, run, size = None, 0, codes, 1
    left = k
    while left:
        if left & 1:
            out = run if out is None else out[: len(out) - size] * np.uint64(pow(BASE, size, 1 << 64)) + run[have:]
            have += size
        left >>= 1
        if left:
            run = run[: len(run) - size] * np.uint64(pow(BASE, size, 1 << 64)) + run[size:]
            size *= 2
    return mixed(out * np.uint64(BASE) + np.uint64(k))


def block_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """What window_hashes gives for the runs at places 0, k, 2k and so on; of less than k codes, for all of them."""
    k = min(k, len(codes))
    if not k:
        return np.zeros(0, np.uint64)
    powers = np.array([pow(BASE, k - 1 - i, 1 << 64) for i in range(k)], np.uint64)
    return mixed((codes[: len(codes) // k * k].reshape(-1, k) * powers).sum(axis=1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(k))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Bitmap:
    """Which hashes a set of them may hold: surely none of those it denies."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        at = h & self.mask
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmap(keys: DataFrame, column: str = "kmer", most: int | None = None) -> Broadcast:
    """A broadcast Bitmap of the column's values, 16 bits for each but MOST_BITS at most; `most` says how many there may be, where that is known."""
    bits = min(MOST_BITS, 1 << max(12, (16 * (keys.count() if most is None else most)).bit_length()))
    at = F.col(column).bitwiseAND(F.lit(bits - 1).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    rows = keys.select(F.shiftright(at, 6).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # a row for 64 bits
    words = np.zeros(bits // 64, np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(Bitmap(words.view(np.uint64)))


def kmer_hashes(df: DataFrame, sizes: list[int], only: Broadcast | None = None) -> DataFrame:
    """df's first column and kmer: hashes of the distinct k-mers of its second, of each size; with `only`, those a Bitmap may hold.

    Strings are indexed as code points in numpy; substrings of long texts cost their place in the JVM.
    """

    def hashes(text: str | None) -> np.ndarray:
        codes = codes_of(text)
        found = [window_hashes(codes, k) for k in sizes]
        return np.unique(np.concatenate([h if only is None else h[only.value.may_hold(h)] for h in found]))

    return _hashed(df, hashes)


def anchor_hashes(df: DataFrame, k: int, every: Broadcast | None = None) -> DataFrame:
    """df's first column and kmer: hashes of the distinct k-mers of its second at places 0, k, 2k and so on; a text shorter than k is one itself.

    With `every`, a text that has a k-mer which the Bitmap denies gives none.
    """

    def hashes(text: str | None) -> np.ndarray:
        h = block_hashes(codes_of(text), k)
        return np.unique(h) if every is None or every.value.may_hold(h).all() else h[:0]

    return _hashed(df, hashes)


def _hashed(df: DataFrame, hashes: Callable[[str | None], np.ndarray]) -> DataFrame:
    name = df.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = np.asarray(batch.column(0).to_pylist(), np.int64), [hashes(text) for text in batch.column(1).to_pylist()]
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(h) for h in found])), pa.array(flat)], names=[name, "kmer"])

    return df.mapInArrow(run, f"{name} long, kmer long")
