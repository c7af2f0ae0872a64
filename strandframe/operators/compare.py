"""Sequence comparison: equality, reverse complement, containment, shared k-mers, local alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import revcomp
from ..sources.shared import stored
from .align import align
from .bounds import Grams
from .classes import digested
from .kmers import anchor_hashes, bitmap, kmer_hashes

#: Sequences of a block of a, and letters of one of b, that are aligned with each other in one go, about.
BLOCK, LETTERS = 256, 1 << 17
#: Partitions for pairs of blocks, at most.
SPREAD = 10_000


def _sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    return a.select(F.col("name").alias("a_name"), F.col("seq").alias("a_seq")), b.select(F.col("name").alias("b_name"), F.col("seq").alias("b_seq"))


def _same(a: DataFrame, b: DataFrame) -> DataFrame:
    x = digested(a, F.col("name").alias("a_name")).withColumnRenamed("check", "a_check")
    y = digested(b, F.col("name").alias("b_name")).withColumnRenamed("check", "b_check")
    return x.join(y, "digest").where("a_check = b_check").select("a_name", "b_name", F.col("digest.size").alias("a_len"), F.col("digest.size").alias("b_len"))


def exact(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_name, b_name, a_len, b_len of equal sequences, by their digests."""
    return _same(a, b)


def reverse_complement(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same of sequences of a whose reverse complement is one of b."""
    return _same(a.withColumn("seq", revcomp(F.col("seq"))), b)


def containment(a: DataFrame, b: DataFrame, k: int = 20, min_len: int = 0) -> DataFrame:
    """Pairs with one sequence inside the other, relation b_in_a before a_in_b, with the length of the inner one.

    An inner sequence meets the outer ones that have its rarest k-mer, of those at its places 0, k, 2k and so on, so a stock
    phrase or a run of one letter that many sequences have isn't what they meet by. Inner sequences shorter than k meet on all
    their bases. b below min_len takes no part.

    In each direction the outer texts are read once for their k-mers: those that a bitmap of the inner ones' lets through (all, if
    the outer texts are the smaller side) are written to the shared folder with the rows that have them, and counted from there.
    Only inner sequences all of whose k-mers a bitmap of these may hold go on. Measures, bitmaps and what is written are made when
    this is called; the rest is lazy.
    """
    x, y = _sides(a, b)
    y = y.where(F.length("b_seq") >= max(1, min_len))
    x = x.where(F.length("a_seq") >= 1)

    def measured(df: DataFrame, c: str) -> tuple[list[int], int, int]:
        """The lengths below k that there are, less than k; how many k-mers are met by at most; and letters."""
        size = F.length(c)
        sizes, most, letters = df.agg(F.collect_set(F.when(size < k, size)), F.sum(F.greatest(F.lit(1), F.floor(size / k))), F.sum(size.cast("long"))).first()
        return sorted(sizes), most or 0, letters or 0

    measures = {"a_seq": measured(x, "a_seq"), "b_seq": measured(y, "b_seq")}

    def inside(inner: DataFrame, i: str, outer: DataFrame, o: str) -> DataFrame:
        """Meets on hashes of k-mers by row ids; sequences come back for the pairs that met."""
        inner, outer = (df.withColumn(f"{c}_id", F.xxhash64(*df.columns)) for df, c in ((inner, i), (outer, o)))
        sizes, most, _ = measures[i]
        mine = inner.select(f"{i}_id", i)
        held = bitmap(anchor_hashes(mine, k), most=most) if most < measures[o][2] else None  # few outer letters need no sieve
        found = stored(kmer_hashes(outer.select(f"{o}_id", o), [*sizes, k], only=held), "containment-kmers")
        often = found.groupBy("kmer").agg(F.count("*").alias("n"))
        anchors = anchor_hashes(mine, k, every=bitmap(found, most=found.count()))
        rarest = anchors.join(often, "kmer", "left").groupBy(f"{i}_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "kmer")).alias("m"))
        met = rarest.where("m.n > 0").select(f"{i}_id", F.col("m.kmer").alias("kmer")).join(found, "kmer").select(f"{i}_id", f"{o}_id").distinct()
        return met.join(inner, f"{i}_id").join(outer, f"{o}_id").where(F.contains(F.col(o), F.col(i)))

    first = inside(y, "b_seq", x, "a_seq").select("a_name", "a_seq", "b_name", "b_seq", F.lit("b_in_a").alias("relation"), F.length("b_seq").alias("overlap_len"))
    other = inside(x, "a_seq", y, "b_seq").where("a_seq <> b_seq").select("a_name", "a_seq", "b_name", "b_seq", F.lit("a_in_b").alias("relation"), F.length("a_seq").alias("overlap_len"))
    return first.unionByName(other)


def first_containing(sno: DataFrame, union: DataFrame, k: int = 20) -> DataFrame:
    """For each sno (name, seq, ord) the identical union record, or else the first in order that holds or is held by it."""
    pairs = containment(union, sno.withColumn("name", F.struct("name", "ord")), k)
    order = union.select(F.col("name").alias("a_name"), F.col("seq").alias("a_seq"), F.col("ord").alias("u_ord"))
    pairs = pairs.join(order, ["a_name", "a_seq"])
    w = Window.partitionBy("b_name").orderBy((F.col("a_seq") != F.col("b_seq")).cast("int"), "u_ord")
    return pairs.withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("b_name.name").alias("sno_name"), F.col("b_name.ord").alias("sno_ord"), F.col("b_seq").alias("sno_seq"), F.col("a_name").alias("union_name"), F.col("a_seq").alias("union_seq"))


def sharing_kmer(a: DataFrame, b: DataFrame, k: int = 20) -> DataFrame:
    """Rows of b with a k-mer of any a, told by a 64-bit hash."""
    ids = b.withColumn("b_id", F.xxhash64("name", "seq"))
    keys = kmer_hashes(a.select(F.lit(0).cast("long").alias("a_id"), "seq"), [k]).select("kmer").distinct()
    hits = kmer_hashes(ids.select("b_id", "seq"), [k], only=bitmap(keys)).join(keys, "kmer", "left_semi").select("b_id").distinct()
    return ids.join(hits, "b_id", "left_semi").drop("b_id")


def align_best(a: DataFrame, b: DataFrame, k: int = 20, min_cov: float = 0.8, gap_open: float = 10.0, gap_extend: float = 0.5) -> DataFrame:
    """For each b that shares a k-mer with any a its best a by identity, then length, then a's order, among alignments that cover min_cov of the shorter.

    A kept b competes for every a, also those that it shares no k-mer with: blocks of b meet blocks of a, and a task gives the
    best of a block for each b, so pairs are never written out. With several blocks of a, each b is first aligned with the a that
    its q-grams make the likeliest. Then, likeliest first, those are aligned that the q-gram lemma (bounds.py) lets reach the best
    identity so far; the others can't be better or equal, so no cell of theirs is computed.
    """
    order = F.col("ord") if "ord" in a.columns else F.lit(0)
    x = a.select(F.col("name").alias("a_name"), F.col("seq").alias("a_seq"), order.cast("long").alias("a_ord")).where(F.length("seq") > 0).distinct()
    y = sharing_kmer(a, b, k).select(F.col("name").alias("b_name"), F.col("seq").alias("b_seq")).distinct()
    x, y = stored(x, "align-a"), stored(y, "align-b")
    n = max(1, -(-x.count() // BLOCK))
    # a b block has sequences of about one length: a batch has as many steps as its longest asks for
    kind = F.floor(2 * F.log2(F.length("b_seq") + 1)).cast("int")
    sizes = {r["kind"]: max(1, -(-r["letters"] // LETTERS)) for r in y.groupBy(kind.alias("kind")).agg(F.sum(F.length("b_seq").cast("long")).alias("letters")).collect()}  # a row for each power of the root of 2
    m = sum(sizes.values())
    blocks = F.create_map(*[F.lit(v) for kv in sizes.items() for v in kv])[kind] if sizes else F.lit(1)
    dealt = lambda df, *of: df.groupBy(*of).agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
    a_blocks = dealt(x, F.pmod(F.xxhash64(*x.columns), F.lit(n)).cast("int").alias("block")).select("block", F.col("rows").alias("a_rows"))

    def met(y: DataFrame) -> DataFrame:
        b_blocks = dealt(y, kind.alias("kind"), F.pmod(F.xxhash64("b_name", "b_seq"), blocks).alias("of")).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.col("rows").alias("b_rows"))
        return b_blocks.join(a_blocks, "block").select("a_rows", "b_rows").repartition(max(1, min(n * m, SPREAD)))

    def likeliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for xs, ys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = Grams([r["a_seq"] for r in xs], min_cov)
                for y in ys:
                    near = grams.guess(y["b_seq"], grams.places(y["b_seq"]))
                    out.append((y["b_name"], y["b_seq"], float(near.max()), xs[int(near.argmax())]["a_seq"]))
            kinds = {"b_name": pa.string(), "b_seq": pa.string(), "near": pa.float64(), "a_seq": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b_seq, a_seq = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            same, columns, _ = align(a_seq, b_seq, gap_open, gap_extend)
            covers = [bool(c) and c / min(len(u), len(v)) >= min_cov for u, v, c in zip(a_seq, b_seq, columns.tolist())]
            known = [pa.array(np.where(covers, v, 0), pa.int64()) for v in (same, columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *known], names=["b_name", "b_seq", "same", "columns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for xs, ys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = Grams([r["a_seq"] for r in xs], min_cov)
                for y, best in zip(ys, _best(xs, grams, ys, min_cov, gap_open, gap_extend)):
                    if best:
                        out.append({"b_name": y["b_name"], "b_seq": y["b_seq"], **dict(zip(("key", "less", "a_ord", "a_name", "a_seq", "identical"), best))})
            names = {"b_name": pa.string(), "b_seq": pa.string(), "key": pa.float64(), "less": pa.int64(), "a_ord": pa.int64(), "a_name": pa.string(), "a_seq": pa.string(), "identical": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in names.items()], names=list(names))

    y = y.select("b_name", "b_seq", F.lit(0).cast("long").alias("same"), F.lit(0).cast("long").alias("columns"))
    if n > 1:
        guesses = met(y.select("b_name", "b_seq")).mapInArrow(likeliest, "b_name string, b_seq string, near double, a_seq string")
        guesses = guesses.groupBy("b_name", "b_seq").agg(F.max(F.struct("near", "a_seq")).alias("m")).select("b_name", "b_seq", F.col("m.a_seq").alias("a_seq"))
        y = stored(guesses.mapInArrow(first, "b_name string, b_seq string, same long, columns long"), "align-first")
    done = met(y).mapInArrow(run, "b_name string, b_seq string, key double, less long, a_ord long, a_name string, a_seq string, identical long")
    best = done.groupBy("b_name").agg(F.min(F.struct("key", "less", "a_ord", "a_name", "a_seq", "identical", "b_seq")).alias("m")).select("b_name", "m.*").withColumn("columns", -F.col("less"))
    return best.select("a_name", "a_seq", "b_name", "b_seq", "identical", "columns", (-F.col("key")).alias("identity_pct"), (F.col("columns") / F.least(F.length("a_seq"), F.length("b_seq"))).alias("coverage"))


def _best(xs: list[dict], grams: Grams, ys: list[dict], min_cov: float, gap_open: float, gap_extend: float) -> list[tuple | None]:
    """For each of ys (b_seq; same and columns of an alignment that it has, or 0) the key of the best of xs, if any covers enough.

    All ys go on together, so that a batch of alignments has pairs of many.
    """
    texts, known, best = [y["b_seq"] for y in ys], [(y["same"], y["columns"]) for y in ys], [None] * len(ys)
    places = [grams.places(t) for t in texts]
    left = [grams.likeliest_first(t, p) for t, p in zip(texts, places)]
    step = 1
    while any(map(len, left)):
        pairs: list[tuple[int, dict]] = []
        for j, own in enumerate(left):
            if len(own) and known[j][0]:
                among = np.zeros(len(xs), bool)
                among[own] = True
                own = own[grams.can_reach(texts[j], places[j], *known[j], among)[own]]
            pairs += [(j, xs[i]) for i in own[:step].tolist()]
            left[j] = own[step:]
        step *= 2
        for (j, r), i, c in zip(pairs, *(v.tolist() for v in align([r["a_seq"] for _, r in pairs], [texts[j] for j, _ in pairs], gap_open, gap_extend)[:2])):
            if c and c / min(len(r["a_seq"]), len(texts[j])) >= min_cov:
                key = (-100.0 * i / c, -c, r["a_ord"], r["a_name"], r["a_seq"], i)
                best[j] = key if best[j] is None or key < best[j] else best[j]
                same, columns = known[j]
                if not same or i * columns > same * c:
                    known[j] = i, c
    return best


def overlap_report(a: DataFrame, b: DataFrame, align: bool = False, k: int = 20, min_cov: float = 0.8, min_len: int = 40, gap_open: float = 10.0, gap_extend: float = 0.5) -> DataFrame:
    """a_name, b_name, relation, a_len, b_len, overlap_len, identity_pct, coverage; cheapest relation first, and no pair twice in exact, containment and alignment."""
    kinds = {"exact": 0, "revcomp": 1, "b_in_a": 2, "a_in_b": 2, "align": 3}
    cols = ["a_name", "b_name", "a_len", "b_len", "relation", "overlap_len"]
    sized = lambda df: df.withColumn("a_len", F.length("a_seq")).withColumn("b_len", F.length("b_seq"))
    same = exact(a, b).withColumn("relation", F.lit("exact")).withColumn("overlap_len", F.col("a_len"))
    turned = reverse_complement(a, b).withColumn("relation", F.lit("revcomp")).withColumn("overlap_len", F.col("a_len"))
    inner = sized(containment(a, b, k, min_len)).join(same.select("a_name", "b_name"), ["a_name", "b_name"], "left_anti")
    out = same.select(cols).unionByName(turned.select(cols)).unionByName(inner.select(cols))
    out = out.withColumn("identity_pct", F.lit(100.0)).withColumn("coverage", F.lit(1.0))
    if align:
        best = sized(align_best(a, b, k, min_cov, gap_open, gap_extend)).withColumn("relation", F.lit("align")).withColumn("overlap_len", F.col("columns").cast("int"))
        seen = out.where("relation <> 'revcomp'").select("a_name", "b_name")
        out = out.unionByName(best.join(seen, ["a_name", "b_name"], "left_anti").select(*out.columns))
    rank = F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv])[F.col("relation")]
    return out.select("a_name", "b_name", "relation", "a_len", "b_len", "overlap_len", "identity_pct", "coverage", rank.alias("kind_rank"))


def ordered_report(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("identity_pct"), F.desc("overlap_len"), "kind_rank", "a_name", "b_name").drop("kind_rank")
