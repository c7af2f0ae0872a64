"""Exact nearest binary codes by incremental multi-index hashing.

A code has a bit for each component, in words of 64. Distinct codes are dealt by hash into shards of bounded size, and queries into
blocks of bounded size; a block meets a shard in a task of its own. A shard cuts each word into segments, no longer than the
logarithm of the number of its codes, and lists the codes in order of each segment's value. A search grows the m segments' radii one
after another: radius r looks up the values r bits from the query's own. With radius r in the first a + 1 segments and
r - 1 in the others, every code within m * r + a bits has been met, so the search ends once its k-th best verified
distance is no more than that, or once it has met every code. A query first meets one shard; its k-th distance there
bounds the search in all others, which give only codes that are no farther.

Copies of a code are one entry with the k least ids of its rows, which is all a top k can need. Ties go to
the lesser id. Codes of different lengths are filled up with zeros. Rows or queries without id or code take no part; repeated rows
count as rows, and so do repeated queries: each has a result. Empty tables give no rows. Other columns aren't read, so their
names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, partitions, ragged

WORD = 64
#: Codes of a shard: at least, but for a single one, while there are no more shards than partitions; and at most, about.
SHARD, FULL = 1 << 14, 1 << 20
#: Queries of a block, about.
QUERIES = 1 << 17


def sign_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and code, words of 64 bits: bit i % 64 of word i / 64 says whether component i is above zero; null for vectors that are null or hold null or non-finite components."""
    x = F.col(vector_col).cast("array<double>")
    bits = lambda v: F.transform(v, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    words = F.greatest(F.lit(1), F.ceil(F.size(x) / WORD)).cast("int")
    code = F.transform(F.sequence(F.lit(0), words - 1), lambda w: F.aggregate(bits(F.slice(x, w * WORD + 1, F.lit(WORD))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), F.when(F.coalesce(whole, F.lit(False)), code).alias("code"))


def segments(n: int, words: int = 1) -> list[tuple[int, int, int]]:
    """(word, shift, width) of each segment for n codes: no wider than log2(n), so that a probe meets a code on average."""
    m = max(2, min(8, ceil(WORD / max(1.0, log2(max(2, n))))))
    cuts = [WORD * i // m for i in range(m + 1)]
    return [(w, a, b - a) for w in range(words) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=256)
def masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.uint64)


class Shard:
    """Codes of one shard, a row of words each, listed by each segment's value."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.codes, self.ids = codes[order].view(np.uint64), ids[order]
        self.cut = segments(*self.codes.shape)
        values = [self.part(self.codes[:, w], s, n) for w, s, n in self.cut]
        self.order = [np.argsort(v, kind="stable") for v in values]
        self.values = [v[o] for v, o in zip(values, self.order)]

    @staticmethod
    def part(code: np.ndarray, shift: int, width: int) -> np.ndarray:
        return (code >> np.uint64(shift)) & np.uint64((1 << width) - 1)

    def nearest(self, code: np.ndarray, k: int, within: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the k nearest codes, of those no farther than within, ties by id, and their distances."""
        q, m, n = code.view(np.uint64), len(self.cut), len(self.codes)
        seen, at, distance = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for radius in range(max(w for _, _, w in self.cut) + 1):
            for a, (word, shift, width) in enumerate(self.cut):
                probe = self.part(q[word], shift, width) ^ masks(width, radius) if radius <= width else np.zeros(0, np.uint64)
                low, high = np.searchsorted(self.values[a], probe), np.searchsorted(self.values[a], probe, side="right")
                met = self.order[a][ragged(low, high - low)]
                met = met[~seen[met]]
                seen[met] = True
                at = np.concatenate([at, met])
                distance = np.concatenate([distance, np.bitwise_count(self.codes[met] ^ q).sum(axis=1, dtype=np.int64)])
                covered = m * radius + a
                if len(at) == n or within is not None and within <= covered or len(at) >= k and np.partition(distance, k - 1)[k - 1] <= covered:
                    break
            else:
                continue
            break
        if within is not None:
            at, distance = at[distance <= within], distance[distance <= within]
        best = np.lexsort((at, distance))[:k]
        return at[best], distance[best]


def as_words(df: DataFrame) -> DataFrame:
    """id and code, a single word becoming an array of it."""
    code = F.col("code")
    return df.select("id", (code if df.schema["code"].dataType.simpleString().startswith("array") else F.when(code.isNotNull(), F.array(code.cast("long")))).alias("code")).where("id is not null and code is not null")


def nearest_codes(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), neighbour_id and distance, from rows(id, code) and queries(id, code); a query meets its own row, too."""
    spark = rows.sparkSession
    rows, queries = as_words(rows), as_words(queries)
    words = rows.select("code").unionByName(queries.select("code")).agg(F.coalesce(F.max(F.size("code")), F.lit(1))).first()[0]
    rows, queries = (df.withColumn("code", F.concat("code", F.array_repeat(F.lit(0).cast("long"), words - F.size("code")))) for df in (rows, queries))
    by_code = Window.partitionBy("code").orderBy("id")
    ids = materialize(rows.withColumn("r", F.row_number().over(by_code)).where(F.col("r") <= k).select("code", "id", "r"), "code-ids")
    codes = ids.where("r = 1").select("code", "id")
    many = codes.count()
    shards = max(1, -(-many // FULL), min(partitions(spark), -(-many // SHARD)))
    # several rows may ask with one id: each query row has a number of its own
    asked = queries.select(F.col("id").alias("qid"), "code", F.expr("uuid()").alias("q")).withColumn("home", F.pmod(F.xxhash64("q"), F.lit(shards)).cast("int"))
    asked = materialize(asked, "queries")
    blocks = max(1, -(-asked.count() // QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    listed = codes.select(F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int").alias("s"), each(blocks).alias("b"), F.lit(None).cast("string").alias("q"), "code", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard, its codes before its queries; of a query `id` is how far its codes may be, if that is known."""
        now, held, shard = None, [], None
        for batch in batches:
            number, ask = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            out: list[list] = [[], [], [], []]
            for i in np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (ask[1:] != ask[:-1])]) if len(number) else number).tolist():
                same = batch.filter(pa.array((number == number[i]) & (ask == ask[i])))
                code = same.column(2).flatten().to_numpy().reshape(-1, words)
                if number[i] != shard:
                    now, held, shard = None, [], number[i]
                if not ask[i]:
                    held.append((code, same.column(3).to_numpy()))
                elif held or now:
                    if held:
                        now, held = Shard(*(np.concatenate(x) for x in zip(*held))), []
                    for q, c, within in zip(same.column(1).to_pylist(), code, same.column(3).to_pylist()):
                        at, d = now.nearest(c, k, within)
                        for x, y in zip(out, ([q] * len(at), now.codes[at].view(np.int64).tolist(), now.ids[at], d)):
                            x.extend(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int32()))], names=["q", "code", "id", "distance"])

    def searched(sent: DataFrame) -> DataFrame:
        both = listed.unionByName(sent.select("s", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("b"), "q", "code", F.col("within").cast("long").alias("id")))
        both = both.select((F.col("s") * blocks + F.col("b")).alias("shard"), "q", "code", "id")
        return both.repartition(shards * blocks, "shard").sortWithinPartitions("shard", F.col("q").asc_nulls_first()).mapInArrow(search, "q string, code array<long>, id long, distance int")

    found = searched(asked.select(F.col("home").alias("s"), "q", "code", F.lit(None).alias("within")))
    if shards > 1:
        found = materialize(found, "nearest-at-home")
        far = found.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("within")).where(F.col("n") >= k)
        others = asked.join(far, "q", "left").select(each(shards).alias("s"), "home", "q", "code", "within").where("s <> home")
        found = found.unionByName(searched(others))
    by_query = Window.partitionBy("q").orderBy("distance", "id")
    # of one order by distance and id, k codes hold the k best rows
    few = materialize(found.withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= k).select("q", "code", "distance"), "nearest-codes")
    full = few.join(ids.select("code", "id"), "code").withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return full.join(asked.select("q", "qid"), "q").select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("neighbour_id"), F.col("distance").cast("int").alias("distance"))
