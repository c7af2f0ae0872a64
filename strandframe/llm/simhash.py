"""SimHash near-duplicates with a pigeonring filter.

Fingerprints are 64 bits. They form a ring of five segments. If two fingerprints differ in at most four
bits, some segment starts a chain in which every prefix of l segments has at most l * 4/5 differences,
rounded down: none in the first, one in two, two in three, three in four. So rows meet on the first two
segments: each fingerprint is listed under its own two segments, and probes those whose second segment
lacks one of its set bits (of two fingerprints one bit apart there, just one has it). Longer chains prune
what meets, then the full distance decides.

Equal fingerprints are one node from the start. Buckets give spanning forests, not pairs, and components
of the forests are found by star steps, so no bucket's pairs and no list of all fingerprints is gathered.

Null text is an empty one: fingerprint zero, linked like any other. A long text is one row, whole in a worker's
memory; its shingles are hashed in runs. Rows without doc_id get a fingerprint, take no part in linking, and have a
null component. Repeated rows each come back; rows of one doc_id with different texts are one node. Empty tables
give no rows. Other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, slices, small_batches
from .buckets import Forest, in_buckets
from .components import components

BITS = 64


def fingerprint(raw: bytes, shingle: int, seed: int = 42) -> int:
    """SimHash of a text's shingles of words, each counted as often as it occurs."""
    words = raw.lower().split()
    if not words:
        return 0
    flat, hashed = b" ".join(words), xxhash.xxh64_intdigest
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 1) - 1
    starts = ends - n
    k = min(shingle, len(words))
    votes = np.zeros(BITS, np.int64)
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    for at in range(0, len(starts), 1 << 16):
        h = np.fromiter((hashed(flat[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist())), np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id long and fp long, the fingerprint's bits as a signed number."""

    small_batches(df.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, 1):
            fp = np.array([fingerprint(x, shingle) for x in raw], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


class Ring:
    """Segments of a fingerprint and the budgets of chains of them."""

    def __init__(self, distance: int):
        self.distance, self.segments = distance, distance + 1
        edges = [round(BITS * i / self.segments) for i in range(self.segments + 1)]
        self.shifts, self.widths = edges[:-1], np.diff(edges).tolist()

    def part(self, fp: np.ndarray, i: int) -> np.ndarray:
        i %= self.segments
        return (fp >> np.uint64(self.shifts[i])) & np.uint64((1 << self.widths[i]) - 1)

    def budget(self, length: int) -> int:
        return length * self.distance // self.segments

    def keys(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, keys, probe) for each ring position: the own key, then those one set bit less in the second segment."""
        rows = np.arange(len(fp))
        for i in range(self.segments):
            w = self.widths[(i + 1) % self.segments]
            first, second = (np.uint64(i) << np.uint64(56)) | (self.part(fp, i) << np.uint64(w)), self.part(fp, i + 1)
            yield rows, first | second, False
            if self.budget(2) > 0:
                for b in range(w):
                    has = np.flatnonzero((second >> np.uint64(b)) & np.uint64(1))
                    yield has, first[has] | (second[has] ^ np.uint64(1 << b)), True

    def linked(self, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Chains of three and more within budget, then the full distance."""
        x = a ^ b
        live = np.arange(len(x))
        for i in range(self.segments):
            own = live[start[live] == i]
            if not len(own):
                continue
            seen = np.bitwise_count(self.part(x[own], i)).astype(np.int64) + np.bitwise_count(self.part(x[own], i + 1))
            bad = seen > self.budget(2)
            for l in range(3, self.segments):
                seen += np.bitwise_count(self.part(x[own], i + l - 1))
                bad |= seen > self.budget(l)
            live = live[~np.isin(live, own[bad])] if bad.any() else live
        out = np.zeros(len(x), bool)
        out[live] = np.bitwise_count(x[live]) <= self.distance
        return out


def link_forest(nodes: DataFrame, distance: int) -> DataFrame:
    """Edges u, v that span every component of nodes(node, fp), fp distinct, under Hamming distance <= distance."""
    ring = Ring(distance)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                node, fp = (part.column(i).to_numpy() for i in (0, 1))
                rows, keys, probe = zip(*((r, k, np.full(len(r), p)) for r, k, p in ring.keys(fp.view(np.uint64))))
                rows = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(node[rows]), pa.array(fp[rows]), pa.array(np.concatenate(probe))], names=["key", "node", "fp", "probe"])

    def kernel(table: pa.Table, pairs) -> Iterator[pa.RecordBatch]:
        key, node, fp, probe = (table.column(c).to_numpy() for c in ("key", "node", "fp", "probe"))
        start, fp = key.view(np.uint64) >> np.uint64(56), fp.view(np.uint64)
        forest, held, size = Forest(len(node)), [], 0

        def flush() -> None:
            a, b = (np.concatenate(x) for x in zip(*held))
            ok = ring.linked(fp[a], fp[b], start[a])
            forest.add(a[ok], b[ok])
            held.clear()

        for a, b in pairs:
            ok = ~(probe[a] & probe[b])
            held.append((a[ok], b[ok]))
            size += len(a)
            if size > 1 << 20:
                flush()
                size = 0
        if held:
            flush()
        a, b = forest.kept()
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["u", "v"])

    rows = nodes.select("node", "fp").mapInArrow(spell, "key long, node long, fp long, probe boolean")
    return in_buckets(rows, kernel, "u long, v long")


def near_duplicates(df: DataFrame, distance: int = 3, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links reach, for every row."""
    marked = materialize(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    nodes = materialize(marked.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")), "fingerprint-classes")
    found = components(link_forest(nodes, distance)).withColumnRenamed("component", "c")
    classes = materialize(nodes.join(found, "node", "left").select("fp", F.coalesce("c", "node").alias("component_id")), "fingerprint-components")
    return marked.join(classes, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    )
