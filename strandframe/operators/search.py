"""Exact placement of sequences on a tiled genome or within gene spans, and extraction of sequence.

A genome is a table of tiles (chrom, tile_start, seq): tile i starts at i * stride and holds the `reach` bases after its stride,
too, so what starts in a stride is whole in its tile if it is no longer than reach + 1. Longer patterns are found by their heads,
and the rest of them is compared with what the next tiles hold; no pattern is too long.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import find_all, revcomp
from . import kmers

#: Bases of a seed by which patterns and tiles meet.
SEED = 16
#: Bytes of patterns that an automaton may be made of.
AUTOMATON_BYTES = 32 << 20
HITS = "name string, chrom string, start long, end long, strand string"


@dataclass(frozen=True)
class Genome:
    """Tiles with what is known of them: every tile but a chromosome's last ones has stride + reach bases."""

    tiles: DataFrame
    stride: int
    reach: int


def tile(genome: DataFrame, stride: int = 4096, reach: int = 255) -> Genome:
    """genome(chrom, seq) in upper case; for sequences that fit a row. Files of whole chromosomes are tiled by the reader."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chrom, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seq = (seq or "").upper()
                for a in range(0, len(seq), stride << 10):  # a thousand tiles at once
                    at = range(a, min(len(seq), a + (stride << 10)), stride)
                    yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array([seq[i : i + stride + reach] for i in at], pa.string())], names=["chrom", "tile_start", "seq"])

    return Genome(genome.select(F.col("chrom").cast("string"), "seq").mapInArrow(cut, "chrom string, tile_start long, seq string"), stride, reach)


def patterns(seqs: DataFrame) -> DataFrame:
    """seqs' columns but seq, with pattern and strand: each sequence and its reverse complement; empty ones match nothing."""
    both = F.array(F.struct(F.col("seq").alias("pattern"), F.lit("+").alias("strand")), F.struct(revcomp(F.col("seq")).alias("pattern"), F.lit("-").alias("strand")))
    return seqs.where(F.length("seq") > 0).withColumn("p", F.explode(both)).select(*[c for c in seqs.columns if c != "seq"], "p.*")


_AUTOMATA: dict = {}


def _automaton(key: str, rows: list[tuple]):
    """The automaton of a broadcast's patterns; a worker keeps the last one it made."""
    if key not in _AUTOMATA:
        import ahocorasick

        by: dict[str, list] = {}
        for name, head, tail, strand in rows:
            by.setdefault(head, []).append((name, tail, strand))
        auto = ahocorasick.Automaton()
        for head, own in by.items():
            auto.add_word(head, (len(head), own))
        auto.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = auto
    return _AUTOMATA[key]


def _hits(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["name", "chrom", "start", "end", "strand", "tail"])


def _by_automaton(pats: DataFrame, genome: Genome) -> DataFrame:
    """Hits of the patterns' heads with their tails, from one automaton for all; `pats` is of bounded size."""
    rows = [tuple(r) for r in pats.select("name", "head", "tail", "strand").collect()]
    sent, key, stride = pats.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex, genome.stride

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for chrom, first, seq in zip(*(batch.column(i).to_pylist() for i in range(3))) if sent.value else ():
                for end, (size, own) in _automaton(key, sent.value).iter(seq or ""):
                    at = end - size + 1
                    if at < stride:
                        out += [(name, chrom, first + at, first + at + size + len(tail or ""), strand, tail) for name, tail, strand in own]
                if len(out) > 1 << 16:
                    yield _hits(out)
                    out = []
            yield _hits(out)

    return genome.tiles.select("chrom", "tile_start", "seq").mapInArrow(run, f"{HITS}, tail string")


def _by_seeds(pats: DataFrame, genome: Genome) -> DataFrame:
    """The same for any number of patterns: places whose seed some pattern may start with, told by a bitmap of bounded size, are joined to the patterns."""
    stride, reach = genome.stride, genome.reach

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = batch.column(1).to_pylist()
            h = [kmers.window_hashes(kmers.codes_of(x[:SEED]), min(SEED, len(x)))[0] for x in heads]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(h, np.uint64).view(np.int64))], names=["name", "head", "tail", "strand", "kmer"])

    keyed = pats.select("name", "head", "tail", "strand").mapInArrow(seeded, "name string, head string, tail string, strand string, kmer long")
    sizes = [r[0] for r in pats.select(F.least(F.length("head"), F.lit(SEED))).distinct().collect()]  # SEED values at most
    only = kmers.bitmap(keyed.select("kmer").distinct())

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chrom, first, seq in zip(*(batch.column(i).to_pylist() for i in range(3))):
                codes, out = kmers.codes_of(seq), []
                for k in sizes:
                    h = kmers.window_hashes(codes, k)[:stride]
                    at = np.flatnonzero(only.value.may_hold(h))
                    out += list(zip(h[at].view(np.int64).tolist(), at.tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([chrom] * len(out), pa.string()), pa.array([first + i for _, i in out], pa.int64()), pa.array([seq[i : i + reach + 1] for _, i in out], pa.string())], names=["kmer", "chrom", "start", "ahead"])

    met = genome.tiles.select("chrom", "tile_start", "seq").mapInArrow(spots, "kmer long, chrom string, start long, ahead string").join(keyed, "kmer").where(F.startswith("ahead", "head"))
    return met.select("name", "chrom", "start", (F.col("start") + F.length("head") + F.length(F.coalesce("tail", F.lit("")))).alias("end"), "strand", "tail")


def place(seqs: DataFrame, genome: Genome, bound: int = 100_000) -> DataFrame:
    """name, chrom, start, end, strand of every occurrence of each sequence on either strand, overlapping ones too.

    Up to `bound` patterns, and AUTOMATON_BYTES of them, are searched together by one automaton; more than that meet tiles by seeds.
    """
    reach = genome.reach
    pats = patterns(seqs.select("name", "seq"))
    pats = pats.select("name", "pattern", "strand", F.substring("pattern", 1, reach + 1).alias("head"), F.when(F.length("pattern") > reach + 1, F.expr(f"substring(pattern, {reach + 2})")).alias("tail"))
    n, size, longest = pats.agg(F.count("*"), F.sum(F.octet_length("pattern")), F.max(F.length("pattern"))).first()
    search = _by_automaton if n <= bound and (size or 0) <= AUTOMATON_BYTES else _by_seeds
    found = search(pats.where("tail is null"), genome).drop("tail")
    if (longest or 0) > reach + 1:
        rest = search(pats.where("tail is not null"), genome).withColumn("whole_start", F.col("start")).withColumn("start", F.col("start") + reach + 1)
        rest = extract(rest, genome, stranded=False).where("seq = tail")
        found = found.unionByName(rest.select("name", "chrom", F.col("whole_start").alias("start"), "end", "strand"))
    return found


def with_hit_counts(seqs: DataFrame, hits: DataFrame) -> DataFrame:
    """Every hit with its sequence's number of hits; a sequence without any keeps a row with 0."""
    counts = hits.groupBy("name").agg(F.count("*").alias("n_hits"))
    own = seqs.select("name").distinct().join(counts, "name", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("long")))
    return own.join(hits, "name", "left").select("name", *[c for c in hits.columns if c != "name"], "n_hits")


def locate_in_genes(seqs: DataFrame, id_gene: DataFrame, spans: DataFrame) -> DataFrame:
    """Every hit of seqs(name, accession, seq) in the spans(gene, chrom, start, end, seq) of its gene, by id_gene(name, gene, source).

    name, accession, gene, source, chrom, start, end, strand, seq_len, n_hits, status: unique, multi_in_gene, not_found_in_gene or
    no_gene. A record is a name with an accession; of repeated records the last counts (by `ord`, if there is one), and so of
    repeated rows of id_gene.
    """
    last = F.max_by("seq", "ord") if "ord" in seqs.columns else F.max("seq")
    records = seqs.groupBy("name", "accession").agg(last.alias("seq"))
    row = F.struct("gene", "source")
    genes = id_gene.groupBy("name").agg((F.max_by(row, "ord") if "ord" in id_gene.columns else F.max(row)).alias("g")).select("name", "g.*")
    known = records.join(genes, "name", "left").withColumn("gene", F.coalesce("gene", F.lit("NA"))).withColumn("source", F.coalesce("source", F.lit("missing")))
    known = known.withColumn("key", F.struct("name", "accession"))
    g = spans.select("gene", F.col("chrom"), F.col("start").alias("g_start"), F.upper("seq").alias("g_seq"))
    at = patterns(known.select("key", "gene", "seq")).join(g, "gene").where(F.contains("g_seq", "pattern")).withColumn("at", F.explode(find_all(F.col("g_seq"), F.col("pattern"))))
    hits = at.select("key", "chrom", (F.col("g_start") + F.col("at")).alias("start"), (F.col("g_start") + F.col("at") + F.length("pattern")).alias("end"), "strand")
    counts = hits.groupBy(F.col("key").alias("c_key")).agg(F.count("*").alias("n_hits"))
    out = known.join(counts, F.col("key").eqNullSafe(F.col("c_key")), "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("long")))
    out = out.join(hits.withColumnRenamed("key", "h_key"), F.col("key").eqNullSafe(F.col("h_key")), "left")
    none = (F.col("gene") == "NA") | (F.col("source") == "UNRESOLVED")
    status = F.when(F.col("n_hits") == 1, "unique").when(F.col("n_hits") > 1, "multi_in_gene").when(none, "no_gene").otherwise("not_found_in_gene")
    return out.select("name", "accession", "gene", "source", "chrom", "start", "end", "strand", F.length(known["seq"]).alias("seq_len"), "n_hits", status.alias("status"))


def extract(bed: DataFrame, genome: Genome, stranded: bool = True) -> DataFrame:
    """bed's columns and seq: the bases of each interval, joined from its tiles, turned on the minus strand if stranded; null for an empty one.

    Each place is put together once, however many rows ask for it.
    """
    stride = genome.stride
    places = bed.where("start < end and chrom is not null").select(F.col("chrom"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct()
    cut = places.withColumn("k", F.explode(F.sequence(F.floor(F.col("start") / stride), F.floor((F.col("end") - 1) / stride))))
    t = genome.tiles.select("chrom", F.floor(F.col("tile_start") / stride).alias("k"), "tile_start", F.substring("seq", 1, stride).alias("t_seq"))
    a, b = F.greatest(F.col("start"), F.col("tile_start")), F.least(F.col("end"), F.col("tile_start") + stride)
    parts = cut.join(t, ["chrom", "k"]).select("chrom", "start", "end", "k", F.substring(F.col("t_seq"), (a - F.col("tile_start") + 1).cast("int"), (b - a).cast("int")).alias("part"))
    whole = parts.groupBy("chrom", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "").alias("seq"))  # a place's own tiles
    out = bed.join(whole, ["chrom", "start", "end"], "left").select(*bed.columns, "seq")
    return out.withColumn("seq", F.when(F.col("strand") == "-", revcomp(F.col("seq"))).otherwise(F.col("seq"))) if stranded else out
