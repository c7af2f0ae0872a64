"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A filter direction is one codeword from each of a few blocks of a rotated space, for several rotations. A vector passes the filters whose
direction it is close to: cosine at or above a threshold that a fixed number of vectors, BUCKET, reach for a filter, so
a filter holds about as many at any size. List decoding finds them block by block among each block's sorted scores,
and looks at nothing that can't reach the threshold any more; a vector that passes none has its best. The number of
filters is such that a pair just at the cosine sought shares LINKS of them on average at any size, and closer pairs
more: that is the recall. What is linked is always verified.

Vectors meet in their filters as 16-bit numbers with a bound of the rounding error. That decides nearly every pair
there; the few pairs within the bound of the cosine sought are looked up and compared in double precision. A pair found in
several filters counts in the first of those it shares. Tasks give counts and spanning forests, not pairs. Vectors
equal in every component are one class from the start, so copies aren't paired. A crowded filter is cut into blocks.

Null and zero vectors and those with null or non-finite components link with nothing; vectors of different
lengths don't link. `exact` gives all vectors of a length one more filter, the last, so that pairs that share no other are found there: nothing is
missed, at the cost of comparing all pairs, block by block. Rows without vec_id have no links and a null component. vec_ids are taken as unique; of repeated
rows with one vector each counts, and rows of one vec_id with different vectors give a row each. Empty tables give no
rows; other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize, ragged
from .buckets import Forest, in_buckets
from .components import components

SEED = 20240229
#: Vectors of a filter, and filters that a pair at the cosine sought shares, on average.
BUCKET, LINKS = 2048, 3.0
#: Rows of a block of a crowded filter, and of a tile of comparisons.
BLOCK, TILE = 8192, 512
#: Components beyond which a rotation is a product of sparse ones instead of a matrix, which would grow with their square.
WIDE = 1024


def tail(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A grid of cosines, and the share of uniform directions that reach each with a fixed one."""
    x = np.linspace(-1, 1, 400_001)
    density = np.maximum(1 - x * x, 0) ** ((dim - 3) / 2) if dim > 3 else np.ones_like(x)
    sums = np.cumsum(density[::-1])[::-1]
    return x, sums / sums[0]


def cap_threshold(dim: int, share: float) -> float:
    """The cosine that this share of uniform directions reaches with a fixed one."""
    x, reached = tail(dim)
    return float(x[np.searchsorted(-reached, -share)])


def also_passed(dim: int, threshold: float, cosine: float) -> float:
    """The share of a vector's filters that another at this cosine passes too."""
    if dim < 5 or cosine >= 1:
        return 0.5
    at = np.linspace(threshold, 1, 2001)[:-1]
    weight = (1 - at * at) ** ((dim - 3) / 2)
    x, reached = tail(dim - 1)
    need = (threshold - cosine * at) / np.sqrt((1 - cosine * cosine) * (1 - at * at))
    return float((weight * np.interp(need, x, reached)).sum() / weight.sum())


class ProductCode:
    """One code's random codewords for each block of its randomly rotated space."""

    def __init__(self, dim: int, words: int, blocks: int, threshold: float, seed: int):
        rng = np.random.default_rng(seed)
        self.words, self.threshold = words, threshold
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0] if dim <= WIDE else None
        self.signs = None if dim <= WIDE else rng.choice([-1.0, 1.0], size=(3, dim))
        self.cuts = [round(dim * i / blocks) for i in range(blocks + 1)]
        self.code = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            w = rng.normal(size=(words, b - a))
            self.code.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(blocks))

    def rotate(self, unit: np.ndarray) -> np.ndarray:
        """Rotated unit vectors; wide ones by three rounds of random signs and a Hadamard transform, filled up with zeros to its width."""
        if self.rotation is not None:
            return unit @ self.rotation
        x = np.zeros((len(unit), self.signs.shape[1]))
        x[:, : unit.shape[1]] = unit
        for signs in self.signs:
            x *= signs
            half = 1
            while half < x.shape[1]:
                y = x.reshape(len(x), -1, 2, half)
                x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(x.shape)
                half *= 2
            x /= np.sqrt(x.shape[1])
        return x

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) for every filter that a unit vector passes, or its best."""
        x, n, w = self.rotate(unit), len(unit), self.words
        scores = [x[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.code)]
        best = [s.max(axis=1) for s in scores]
        row, name, total = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
        for k, s in enumerate(scores):
            others = sum(best[:k] + best[k + 1 :], np.zeros(n))
            at, word = np.nonzero(s >= (self.threshold - others)[:, None] - 1e-9)  # words that can reach the threshold at all
            order = np.lexsort((-s[at, word], at))
            at, word = at[order], word[order]
            falling, start = 4.0 * at - s[at, word], np.searchsorted(at, np.arange(n))  # rows one after another, each ascending
            need = self.threshold - total - sum(best[k + 1 :], np.zeros(n))[row]
            count = np.searchsorted(falling, 4.0 * row + np.clip(-need, -1.5, 1.5), side="right") - start[row]
            word = word[ragged(start[row], count)]
            row, name, total = np.repeat(row, count), np.repeat(name, count) * w + word, np.repeat(total, count)
            total = total + s[row, word]
        lone = np.setdiff1d(np.arange(n), row)
        if len(lone):
            first = np.zeros(len(lone), np.int64)
            for s in scores:
                first = first * w + s[lone].argmax(axis=1)
            row, name = np.concatenate([row, lone]), np.concatenate([name, first])
        return row, name


class Filters:
    """The codes for so many vectors and a least cosine of pairs. One code's passed filters come in clumps; more codes than one even that out."""

    def __init__(self, dim: int, vectors: int, least: float, exact: bool = False):
        dim = dim if dim <= WIDE else 1 << (dim - 1).bit_length()
        share = min(0.3, BUCKET / max(1, vectors))
        threshold = cap_threshold(dim, share)
        codes = max(2, int(np.ceil(np.log2(max(2, vectors)) / 4.5)))
        each = LINKS / also_passed(dim, threshold, least) / share / codes
        blocks = max(1, min(dim, 2 if each < 1 << 22 else 3 if each < 1 << 33 else 4))
        words = max(2, round(each ** (1 / blocks)))
        self.codes = [ProductCode(dim, words, blocks, threshold, SEED + dim + 100_003 * k) for k in range(codes)]
        self.size, self.exact = words**blocks, exact
        self.kind = "<i4" if self.size * codes < 1 << 31 else "<i8"

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) of all codes, filters ascending within a vector."""
        found = [(row, name + k * self.size) for k, (row, name) in enumerate(c.decode(unit) for c in self.codes)]
        if self.exact:
            found.append((np.arange(len(unit)), np.full(len(unit), len(self.codes) * self.size)))
        row, name = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((name, row))
        return row[order], name[order]


@lru_cache(maxsize=4)
def filters_of(dim: int, vectors: int, least: float, exact: bool) -> Filters:
    return Filters(dim, vectors, least, exact)


def unit_of(raw: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int16, their scales, and bounds of the distance from what they stand for."""
    scale = np.abs(unit).max(axis=1) / 32767
    q = np.rint(unit / scale[:, None]).astype(np.int16)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1) * (1 + 1e-9) + 1e-14


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec (its components' bytes; null if it can't link) and h, a digest of them."""
    kind = df.schema[vector_col].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    x = F.col(vector_col) if kind == "float" else F.col(vector_col).cast("array<double>")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                v = v.values if v.is_valid else None
                v = None if v is None or v.null_count or not len(v) else v.to_numpy() + 0.0
                out.append(v.astype(dtype).tobytes() if v is not None and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vec"])

    return df.select(F.col(id_col).cast("long").alias("id"), x.alias("v")).mapInArrow(pack, "id long, vec binary").withColumn("h", F.md5("vec"))


def near_vectors(df: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", exact: bool = False) -> DataFrame:
    """id_col, n_links, component_id (least id that links reach) and kept (id is the component's) of every row; exact: by all links, not by those that filters find."""
    kind = df.schema[vector_col].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    size = np.dtype(dtype).itemsize
    rows = vectors(df, id_col, vector_col)
    named = materialize(rows.select("id", F.when(F.col("id").isNotNull(), F.col("h")).alias("h")), "vector-digests")
    classes = materialize(rows.where("id is not null and vec is not null").groupBy("h").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "vector-classes")
    many, widest = classes.agg(F.count("*"), F.coalesce(F.max(F.octet_length("vec")), F.lit(0))).first()
    stride = widest // size + 1  # above any number of components, so that a key tells filter and width
    meta = np.dtype([("copies", "<i8"), ("scale", "<f8"), ("error", "<f8"), ("dim", "<i4")])

    def decoded(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """dim, rows of the batch, their unit vectors, and their filters as (place, filter)."""
        raw = batch.column(batch.schema.names.index("vec")).to_pylist()
        dims = np.fromiter(map(len, raw), np.int64, len(raw)) // size
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            unit = unit_of([raw[i] for i in own], dtype)
            yield dim, own, unit, *filters_of(dim, many, least, exact).decode(unit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for dim, _, _, _, f in decoded(batch.slice(at, 256)):
                    key, n = np.unique(f * stride + dim, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                node, copies = part.column(0).to_numpy(), part.column(1).to_numpy()
                for dim, own, unit, r, f in decoded(part):
                    q, scale, error = rounded(unit)
                    about = np.zeros(len(own), meta)
                    about["copies"], about["scale"], about["error"], about["dim"] = copies[own], scale, error, dim
                    ends = np.cumsum(np.bincount(r, minlength=len(own)))
                    lists = f.astype(filters_of(dim, many, least, exact).kind)
                    packed = [about[i].tobytes() + q[i].tobytes() + lists[a:b].tobytes() for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist()))]
                    yield pa.RecordBatch.from_arrays([pa.array(f * stride + dim), pa.array(node[own[r]]), pa.array([packed[i] for i in r.tolist()], pa.binary())], names=["key", "node", "packed"])

    def kernel(table: pa.Table, _) -> Iterator[pa.RecordBatch]:
        key, node, bi, bj, own = (table.column(c).to_numpy() for c in ("key", "node", "bi", "bj", "own"))
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1]), [True]]))
        links, forest, unsure = np.zeros(len(node), np.int64), Forest(len(node)), []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a < 2:
                continue
            packed = table.column("packed").slice(a, b - a).to_pylist()
            about = np.frombuffer(b"".join(x[: meta.itemsize] for x in packed), meta)
            dim = int(about["dim"][0])
            q = np.frombuffer(b"".join(x[meta.itemsize : meta.itemsize + 2 * dim] for x in packed), "<i2").reshape(-1, dim)
            lists = [np.frombuffer(x[meta.itemsize + 2 * dim :], filters_of(dim, many, least, exact).kind) for x in packed]
            filters = np.full((b - a, max(map(len, lists))), np.iinfo(np.int64).max)
            for i, x in enumerate(lists):
                filters[i, : len(x)] = x
            here, scale, error = int(key[a]) // stride, about["scale"], about["error"]
            near = (q * scale[:, None]).astype(np.float32)
            floor = np.float32(least - 2.1 * error.max() - 1e-5 - 1e-7 * dim)
            across = own[a:b] != own[a] if bi[a] != bj[a] else None  # of two blocks only pairs across
            for top in range(0, b - a, TILE):
                x, y = np.nonzero(near[top : top + TILE] @ near[top:].T >= floor)
                x, y = x + top, y + top
                go = x < y if across is None else (x < y) & (across[x] != across[y])
                x, y = x[go], y[go]
                for k in range(0, len(x), 1 << 16):
                    i, j = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                    cosine = np.einsum("ij,ij->i", q[i].astype(np.float64), q[j].astype(np.float64)) * scale[i] * scale[j]
                    bound = error[i] + error[j] + error[i] * error[j] + 1e-12
                    go = cosine + bound >= least
                    i, j, sure = i[go], j[go], (cosine - bound >= least)[go]
                    first = np.ones(len(i), bool)
                    for c in range(filters.shape[1]):
                        f = filters[i, c]
                        left = np.flatnonzero(first & (f < here))
                        if not len(left):
                            break
                        first[left] = ~(filters[j[left]] == f[left][:, None]).any(axis=1)
                    i, j, sure = i[first], j[first], sure[first]
                    unsure.append(np.stack([node[a + i[~sure]], node[a + j[~sure]]]))
                    i, j = i[sure], j[sure]
                    np.add.at(links, a + i, about["copies"][j])
                    np.add.at(links, a + j, about["copies"][i])
                    forest.add(a + i, a + j)
        u, v = forest.kept()
        some, open_ = np.flatnonzero(links), np.concatenate(unsure, axis=1) if unsure else np.zeros((2, 0), np.int64)
        n = np.concatenate([links[some], np.zeros(len(u) + open_.shape[1], np.int64)])
        undecided = np.arange(len(n)) >= len(some) + len(u)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[some], node[u], open_[0]])), pa.array(np.concatenate([node[some], node[v], open_[1]])), pa.array(n, mask=undecided)], names=["u", "v", "n"])

    counts = classes.select("vec").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    spelt = classes.select("node", "copies", "vec").mapInArrow(spell, "key long, node long, packed binary")
    found = materialize(in_buckets(spelt, kernel, "u long, v long, n long", block=BLOCK, counts=counts), "vector-links")
    close = verified(found.where("n is null").select("u", "v"), classes, dtype, least)
    links = found.where("n > 0").select(F.col("u").alias("node"), "n").unionByName(close.select(F.col("u").alias("node"), F.col("copies_v").alias("n"))).unionByName(close.select(F.col("v").alias("node"), F.col("copies_u").alias("n")))
    links = links.groupBy("node").agg(F.sum("n").alias("links"))
    parts = components(found.where("n is not null and u <> v").select("u", "v").unionByName(close.select("u", "v")))
    about = classes.select("h", "node", "copies").join(links, "node", "left").join(parts, "node", "left")
    about = materialize(about.select("h", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "vector-components")
    for x in (found, classes, close):
        discard(x)
    return named.join(about, "h", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept")
    )


def verified(pairs: DataFrame, classes: DataFrame, dtype: str, least: float) -> DataFrame:
    """u, v, copies_u, copies_v of the pairs whose cosine in double precision is enough; both vectors are joined to each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype) for c in ("vec_u", "vec_v"))
            n = [len(b) // np.dtype(dtype).itemsize for b in batch.column("vec_u").to_pylist()]
            cuts = np.cumsum(n)[:-1]
            cosine = lambda a, b: float((a := a.astype(np.float64) / np.abs(a).max().astype(np.float64)) @ (b := b.astype(np.float64) / np.abs(b).max().astype(np.float64)) / (np.linalg.norm(a) * np.linalg.norm(b)))
            good = [cosine(a, b) >= least for a, b in zip(np.split(x, cuts), np.split(y, cuts))]
            yield batch.select(["u", "v", "copies_u", "copies_v"]).filter(pa.array(good))

    for side in ("u", "v"):
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("copies").alias(f"copies_{side}"), F.col("vec").alias(f"vec_{side}")), side)
    return materialize(pairs.mapInArrow(run, "u long, v long, copies_u long, copies_v long"), "vectors-compared")
