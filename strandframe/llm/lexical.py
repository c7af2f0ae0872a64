"""Ranked lexical search: the best documents for each query by a saturated term weight, through trees of maxima.

The index has a shard for each run of documents that a task reads, ordered by doc_id, and in it each term's documents and counts.
A tree over a shard's documents in that order has, for each term, the most that the term gives any document of a node's range. A
query goes through it best first: of all open nodes the one whose terms' maxima have the highest sum is opened next, of equal
ones the one with the least doc_id, until what is open can't change the k best; nodes as high as the k-th are opened while they
may hold a smaller doc_id. The same bound stands above the shards: the roots' maxima come from the index without its postings,
each query is first searched in its highest shard, and then only in shards that may better its k-th score.

A term is a run of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. With N documents that have terms, L terms in
all of them, n in one, and df documents with the term, its weight w is floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is
10 + (90 n N) div L, and its score the sum of w ((10^9 tf) div (1000 tf + 8 m)) over the query's distinct terms, in 64-bit integers.

Null and empty texts have no terms: such documents aren't found and such queries find nothing. Query rows that share an id are one
query with the terms of all of them; documents that share a doc_id are each ranked. Equal scores go by ascending doc_id, null first. A
long text is one row in a worker's memory. An empty table gives no rows; only the columns named are read, so further ones can't clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Numbered, materialize, sieve, slices, small_batches

#: Documents of a shard at most, and bytes of text after which it is closed.
SHARD_DOCS, SHARD_BYTES = 1 << 16, 32 << 20
#: Terms of all queries that are searched together in a shard, about.
BLOCK_TERMS = 1 << 13
#: Children of a node, and documents of a lowest one.
FAN = 16
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Each byte of a term in lower case, any other as a space.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "shard long, term string, df long, docs binary, counts binary, best_tf array<long>, best_n array<long>, ids binary, lengths binary, total long"


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Parts of an array, up to each of the ends, as binary values."""
    offsets = np.concatenate([[0], ends * data.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _lists(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(data, pa.int64()))


class _Shard:
    """Documents gathered for one shard."""

    def __init__(self):
        self.terms, self.keys, self.tfs, self.lengths, self.ids, self.bytes = Numbered(), [], [], [], [], 0

    def add(self, ids: list, texts: list[bytes]) -> None:
        look, parts = self.terms.__getitem__, []
        for i, text in zip(ids, texts):
            words = text.translate(BYTES).split(b" ")
            found = np.fromiter(map(look, filter(None, words)), np.int64)
            parts.append(found | len(self.ids) << 32)
            self.ids.append(i), self.lengths.append(len(found))
            self.bytes += len(text)
        keys, tfs = np.unique(np.concatenate(parts), return_counts=True)
        self.keys.append(keys), self.tfs.append(tfs)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """The shard's row of documents, then a row for each term."""
        null = np.array([i is None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, ~null))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths, np.int64)
        names = list(self.terms)
        yield self._batch(number, pa.array([None], pa.string()), {
            "df": pa.array([int((lengths > 0).sum())], pa.int64()), "ids": pa.array([ids[order][int(null.sum()) :].astype("<i8").tobytes()], pa.binary()),
            "lengths": pa.array([lengths[order].astype("<i8").tobytes()], pa.binary()), "total": pa.array([int(lengths.sum())], pa.int64()),
        })
        keys, tfs = np.concatenate(self.keys), np.concatenate(self.tfs)
        term, doc = keys & 0xFFFFFFFF, place[keys >> 32]
        order = np.argsort(term << 16 | doc)
        term, doc, tf, n = term[order], doc[order], tfs[order], lengths[keys[order] >> 32]
        ends = np.cumsum(np.bincount(term, minlength=len(names)))
        # of a term's documents only those that none beats in both count and length can give its maximum
        rank = np.lexsort((n, -tf, term))
        least = np.minimum.accumulate(n[rank] - (term[rank] << 40))
        new = np.concatenate([[True], least[1:] < least[:-1]]) if len(least) else np.zeros(0, bool)
        best, best_ends = rank[new], np.cumsum(np.bincount(term[rank[new]], minlength=len(names)))
        wide = "<u1" if not len(tf) or tf.max() < 1 << 8 else "<u4"
        for a in range(0, len(names), 1 << 16):
            b = min(a + (1 << 16), len(names))
            lo, best_lo = (int(ends[a - 1]), int(best_ends[a - 1])) if a else (0, 0)
            hi, best_hi = int(ends[b - 1]), int(best_ends[b - 1])
            e, be, pick = ends[a:b] - lo, best_ends[a:b] - best_lo, best[best_lo:best_hi]
            yield self._batch(number, pa.array([x.decode("utf-8", "replace") for x in names[a:b]], pa.string()), {
                "df": pa.array(np.diff(e, prepend=0), pa.int64()), "docs": _binaries(doc[lo:hi].astype("<u2"), e), "counts": _binaries(tf[lo:hi].astype(wide), e),
                "best_tf": _lists(tf[pick], be), "best_n": _lists(n[pick], be),
            })

    @staticmethod
    def _batch(number: int, term: pa.Array, cols: dict[str, pa.Array]) -> pa.RecordBatch:
        n, kinds = len(term), {"df": pa.int64(), "docs": pa.binary(), "counts": pa.binary(), "best_tf": pa.list_(pa.int64()), "best_n": pa.list_(pa.int64()), "ids": pa.binary(), "lengths": pa.binary(), "total": pa.int64()}
        return pa.RecordBatch.from_pydict({"shard": pa.array(np.full(n, number), pa.int64()), "term": term} | {k: cols.get(k, pa.nulls(n, kind)) for k, kind in kinds.items()})


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of every document, written below the shared folder: for each shard a row of documents (null term) and one for each term.

    A map without a shuffle. best_tf and best_n are the counts and document lengths one of which gives the term's maximum in the shard.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch, raw in slices(batches, 1):
            ids = batch.column(0).to_pylist()
            for a in range(0, len(ids), SHARD_DOCS):
                if shard.ids and (shard.bytes >= SHARD_BYTES or len(shard.ids) + len(ids[a : a + SHARD_DOCS]) > SHARD_DOCS):
                    yield from shard.rows(number)
                    number, shard = number + 1, _Shard()
                shard.add(ids[a : a + SHARD_DOCS], raw[a : a + SHARD_DOCS])
        if shard.ids:
            yield from shard.rows(number)

    return materialize(src.mapInArrow(build, INDEX), "lexical-index")


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query (a text that tells null from any id), id_col and term: the distinct terms of each query."""
    own = F.col(id_col)
    key = F.when(own.isNull(), "-").otherwise(F.concat(F.lit("+"), own.cast("string"))).alias("query")
    terms = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return queries.select(key, own.alias("id"), F.explode(F.array_distinct(terms)).alias("term")).distinct()


class _Trees:
    """A shard's documents and, for some terms, their scores and the trees of maxima over document ranges."""

    def __init__(self, head: dict, rows: list[dict], n_all: int, l_all: int):
        n = np.frombuffer(head["lengths"], "<i8")
        self.m = 10 + (90 * n * n_all) // l_all
        self.ids = np.frombuffer(head["ids"], "<i8")
        self.nulls = len(n) - len(self.ids)
        self.number = {r["term"]: i for i, r in enumerate(rows)}
        term = np.repeat(np.arange(len(rows)), [r["df"] for r in rows])
        doc = np.concatenate([np.frombuffer(r["docs"], "<u2") for r in rows]).astype(np.int64)
        tf = np.concatenate([np.frombuffer(r["counts"], f"<u{len(r['counts']) // r['df']}").astype(np.int64) for r in rows])
        give = (10**9 * tf) // (1000 * tf + 8 * self.m[doc])
        nodes = -(-len(n) // FAN)
        lowest = np.zeros((len(rows), nodes), np.int32)
        np.maximum.at(lowest, (term, doc // FAN), give.astype(np.int32))
        self.levels = [lowest]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            starts = np.arange(0, below.shape[1], FAN)
            self.levels.append(np.maximum.reduceat(below, starts, axis=1))
        order = np.argsort(doc, kind="stable")
        self.doc, self.term, self.give = doc[order], term[order], give[order]
        self.at = np.searchsorted(self.doc, np.arange(0, (nodes + 1) * FAN, FAN))
        self.weight = np.zeros(len(rows), np.int64)

    def id_of(self, doc: int) -> int | None:
        return None if doc < self.nulls else int(self.ids[doc - self.nulls])

    def _late(self, doc: int, bar: tuple) -> bool:
        """Whether a document's id comes after the bar's, which has (has an id, id)."""
        own = self.id_of(doc)
        return (own is not None, own or 0) > bar

    def best(self, terms: list[str], weights: list[int], k: int, bar: tuple[int, tuple] | None) -> list[tuple[int, int]]:
        """(score, document) of the k best documents with a score above 0; those that come after bar (score, id) needn't be among them."""
        use = np.array([self.number[t] for t in terms if t in self.number], np.int64)
        w = np.array([x for t, x in zip(terms, weights) if t in self.number], np.int64)
        self.weight[use] = w
        top = len(self.levels)
        open_ = [(-int((w * self.levels[-1][use, 0]).sum()), 0, top - 1, 0)] if len(use) else []
        found: list[tuple[int, int]] = []  # the worst first
        while open_:
            bound, first, level, node = heapq.heappop(open_)
            bound = -bound
            if bound <= 0 or bar and (bound < bar[0] or bound == bar[0] and self._late(first, bar[1])):
                break
            if len(found) == k and (bound < found[0][0] or bound == found[0][0] and first > -found[0][1]):
                break
            if level:
                a = node * FAN
                below = w @ self.levels[level - 1][use, a : a + FAN].astype(np.int64)
                step = FAN**level
                for i in np.flatnonzero(below > 0).tolist():
                    heapq.heappush(open_, (-int(below[i]), (a + i) * step, level - 1, a + i))
                continue
            lo, hi = self.at[node], self.at[node + 1]
            score = np.zeros(FAN, np.int64)
            np.add.at(score, self.doc[lo:hi] - node * FAN, self.weight[self.term[lo:hi]] * self.give[lo:hi])
            for i in np.flatnonzero(score > 0).tolist():
                entry = (int(score[i]), -(node * FAN + i))
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
        self.weight[use] = 0
        return [(score, -doc) for score, doc in found]


def _search(index: DataFrame, postings: DataFrame, pairs: DataFrame, wanted: DataFrame, k: int, n_all: int, l_all: int) -> DataFrame:
    """query, doc_id, score: up to k documents of each pair (query, shard, bar_score, bar_id), searched shard by shard.

    wanted has block, query, terms, weights. A group has one shard's rows for the terms of one block of queries.
    """
    asked = pairs.join(wanted, "query").select("shard", "block", "query", "bar_score", "bar_has_id", "bar_id", "terms", "weights")
    needs = asked.select("shard", F.col("block").alias("in_block"), F.explode("terms").alias("term")).distinct()
    heads = index.where("term is null").join(asked.select("shard", F.col("block").alias("in_block")).distinct(), "shard")
    cols = [F.col("shard").alias("of_shard"), "in_block", "term", "df", "docs", "counts", "ids", "lengths"]
    have = heads.select(cols).unionByName(postings.join(needs, ["shard", "term"]).select(cols))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        terms = [r for r in rows if r["term"] is not None]
        out: list[tuple] = []
        if terms:
            trees = _Trees(next(r for r in rows if r["term"] is None), terms, n_all, l_all)
            for q in right.to_pylist():
                bar = None if q["bar_score"] is None else (q["bar_score"], (q["bar_has_id"], q["bar_id"] or 0))
                out += [(q["query"], trees.id_of(doc), score) for score, doc in trees.best(q["terms"], q["weights"], k, bar)]
        return pa.table({"query": pa.array([x[0] for x in out], pa.string()), "doc_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.int64())})

    return have.groupBy("of_shard", "in_block").cogroup(asked.groupBy("shard", "block")).applyInArrow(search, "query string, doc_id long, score long")


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """id_col, rank int, doc_id, score: each query's k best documents with a score above 0, equal scores by ascending doc_id.

    Postings of terms that no query has aren't shuffled. Small tables are written below the shared folder: the queries' terms, the
    roots' maxima, the sums of these for each query and shard, and what each query finds in its highest shard.
    """
    spark, kind = queries.sparkSession, queries.schema[id_col].dataType.simpleString()
    terms = materialize(query_terms(queries, id_col, text_col), "lexical-terms")
    stats = index.where("term is null").agg(F.sum("df").alias("n"), F.sum("total").alias("l")).first()
    if not stats["n"] or terms.isEmpty():
        return spark.createDataFrame([], f"{id_col} {kind}, rank int, doc_id long, score long")
    n_all, l_all = stats["n"], stats["l"]
    asked = sieve(terms.select("term").distinct(), "term")
    postings = asked(index.where("term is not null")).where("maybe")
    most = F.expr(f"array_max(transform(arrays_zip(best_tf, best_n), x -> (1000000000L * x.best_tf) div (1000L * x.best_tf + 8L * (10L + (90L * x.best_n * {n_all}L) div {l_all}L))))")
    tops = materialize(postings.select("shard", "term", "df", most.alias("most")), "lexical-tops")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_all + 2) / (2 * F.sum("df") + 1).cast("double"))).cast("long")
    weighed = terms.join(tops.groupBy("term").agg(weight.alias("weight")), "term")
    blocks = -(-terms.count() // BLOCK_TERMS)
    own = weighed.groupBy("query").agg(F.first("id").alias("id"), F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    wanted = materialize(own.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")), "lexical-queries")
    bounds = weighed.join(tops, "term").groupBy("query", "shard").agg(F.sum(F.col("weight") * F.col("most")).alias("bound")).where("bound > 0")
    bounds = materialize(bounds, "lexical-bounds")
    first = bounds.groupBy("query").agg(F.max_by("shard", F.struct("bound", -F.col("shard"))).alias("shard"))
    none = {"bar_score": F.lit(None).cast("long"), "bar_has_id": F.lit(None).cast("boolean"), "bar_id": F.lit(None).cast("long")}
    early = materialize(_search(index, postings, first.withColumns(none), wanted, k, n_all, l_all), "lexical-first")
    worst = F.min(F.struct("score", F.col("doc_id").isNull().alias("no_id"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("id"))).alias("w")
    bars = early.groupBy("query").agg(F.count("*").alias("n"), worst).where(F.col("n") >= k)
    bars = bars.select("query", F.col("w.score").alias("bar_score"), (~F.col("w.no_id")).alias("bar_has_id"), F.bitwise_not("w.id").alias("bar_id"))
    rest = bounds.join(first, ["query", "shard"], "left_anti").join(bars, "query", "left").where("bar_score is null or bound >= bar_score")
    late = _search(index, postings, rest.select("query", "shard", *none), wanted, k, n_all, l_all)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = early.unionByName(late).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(wanted.select("query", F.col("id").alias(id_col)), "query").select(id_col, "rank", "doc_id", "score")
