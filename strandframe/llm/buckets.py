"""Pairs within buckets: hot buckets are cut into blocks, and no task holds more than two blocks of one bucket.

Rows meet in the bucket of their key. Keys are counted first, with map-side sums. A bucket of more than
`block` rows is dealt into blocks by a hash of the row's id, and each pair of blocks becomes a bucket of
its own, so every pair of rows still meets, once. Workers read rows sorted by bucket as a stream and
compare them by offset with numpy; pairs are never written out, only what the kernel makes of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, partitions

#: Rows of a block of a hot bucket.
BLOCK = 2048


def in_buckets(rows: DataFrame, kernel: Callable[[pa.Table, Iterator], Iterator[pa.RecordBatch]], schema: str, key: str = "key", node: str = "node", order: list[str] | None = None, block: int = BLOCK, counts: DataFrame | None = None) -> DataFrame:
    """kernel(table, pairs) for runs of whole buckets; pairs yields (left, right) index arrays, each pair once.

    counts(key, n) may come from elsewhere if that is cheaper than reading the rows once more.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    hot = materialize(counts.where(F.col("n") > block).select(key, F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot-buckets")
    dealt = rows.join(hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    dealt = dealt.select(*rows.columns, "own", F.explode(others).alias("of")).select(*rows.columns, "own", F.col("of.i").alias("bi"), F.col("of.j").alias("bj"))
    n = partitions(rows.sparkSession)
    dealt = dealt.repartition(n, key, "bi", "bj").sortWithinPartitions(key, "bi", "bj", *(order or []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            ids = [np.asarray(batch.column(batch.schema.names.index(c))) for c in (key, "bi", "bj")]
            last = (ids[0] == ids[0][-1]) & (ids[1] == ids[1][-1]) & (ids[2] == ids[2][-1])
            cut = int(np.argmax(last))  # rows from here on may go on in the next batch
            if cut:
                held[-1] = batch.slice(0, cut)
                yield from kernel(t := pa.Table.from_batches(held), offsets(t, key))
                held = [batch.slice(cut)]
        if held:
            yield from kernel(t := pa.Table.from_batches(held), offsets(t, key))

    return dealt.mapInArrow(run, schema)


def offsets(table: pa.Table, key: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows in the same bucket, one offset at a time; in a bucket of two blocks only across them."""
    k, bi, bj, own = (table.column(c).to_numpy() for c in (key, "bi", "bj", "own"))
    run = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1]))]) if len(k) else k
    end = np.searchsorted(run, run, side="right")
    left = np.flatnonzero(end - np.arange(len(run)) > 1)
    d = 1
    while len(left):
        right = left + d
        fit = right < end[left]
        left, right = left[fit], right[fit]
        ok = (bi[left] == bj[left]) | (own[left] != own[right])
        if ok.any():
            yield left[ok], right[ok]
        d += 1


class Forest:
    """Union-find over numbers, taking whole arrays of links; keeps a spanning forest instead of all links."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[np.ndarray] = []

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                return r
            r = s

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            go = x != y
            a, b, x, y = a[go], b[go], x[go], y[go]
            if not len(a):
                return
            hi, lo = np.maximum(x, y), np.minimum(x, y)
            # one link for each root that loses its place; the rest come round again
            top, first = np.unique(hi, return_index=True)
            self.up[top] = lo[first]
            self.links.append(np.stack([a[first], b[first]]))

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(self.links, axis=1)) if self.links else (np.zeros(0, np.int64), np.zeros(0, np.int64))
