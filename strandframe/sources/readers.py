"""Readers of FASTA, BED, GTF, TSV and CSV files; gzip by suffix. Order, where it matters, is a column `ord`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import gtf_attribute
from ..operators.intervals import to_zero_based
from ..operators.search import Genome

BED_SCHEMA = "chrom string, start long, end long, name string, score string, strand string"


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, seq (upper case), ord: every record in file order; a file is read at record borders."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.monotonically_increasing_id().alias("ord"))
    body = F.regexp_replace("value", "^>", "")
    cut = F.split(body, "\n", 2)
    out = raw.select(F.trim(F.regexp_replace(cut[0], "\r", "")).alias("header"), F.upper(F.regexp_replace(F.coalesce(F.try_element_at(cut, F.lit(2)), F.lit("")), r"\s", "")).alias("seq"), "ord")
    return out.where("header <> '' or seq <> ''")


def fasta_named(spark: SparkSession, path: str, prefix: str = "", last_wins: bool = True) -> DataFrame:
    """name (first word of the header), seq, ord; of repeated names the last, unless last_wins is off."""
    rows = fasta(spark, path).select(F.split("header", r"\s+")[0].alias("name"), "seq", "ord").where(F.col("name").startswith(prefix))
    return rows.groupBy("name").agg(F.max_by("seq", "ord").alias("seq"), F.max("ord").alias("ord")) if last_wins else rows


def fasta_ids(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """name (first word that starts AluACA, else the accession), accession, seq, ord; only names in wanted(name) if given.

    Of records with one name and accession the last counts, in the first one's place.
    """
    words = F.split("header", r"\s+")
    own = F.try_element_at(F.filter(words, lambda w: w.startswith("AluACA")), F.lit(1))
    rows = fasta(spark, path).select(F.coalesce(own, words[0]).alias("name"), words[0].alias("accession"), "seq", "ord")
    rows = rows.groupBy("name", "accession").agg(F.max_by("seq", "ord").alias("seq"), F.min("ord").alias("ord"))
    return rows if wanted is None else rows.join(wanted.select("name").distinct(), "name", "left_semi")


def fasta_accessions(spark: SparkSession, path: str) -> DataFrame:
    """accession with version and the last AluACA id of each header, ord."""
    rows = fasta(spark, path)
    return rows.select(F.split("header", r"\s+")[0].alias("accession"), F.regexp_extract("header", r"^.*(AluACA\d+)", 1).alias("name"), "ord").where("name <> ''")


def genome_tiles(spark: SparkSession, path: str, stride: int = 4096, reach: int = 255) -> Genome:
    """Overlapping upper-case tiles of genome FASTA files, read by lines: a chromosome may lie in any number of file splits, and none is held whole.

    One pass notes the headers and bases of each split, from which every split's first place follows; a second cuts tiles. What
    a split's border cuts comes as parts, which are put together by tile. Chromosomes have names of their own.
    """
    lines = spark.read.text(path).select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, list[str]]]:
        """(split, whether it is new, lines) of each batch."""
        now = None
        for batch in batches:
            at = np.stack([np.asarray(batch.column(1)), np.asarray(batch.column(2))])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    split = (int(at[0, a]), int(at[1, a]))
                    yield split, split != now, batch.column(0).slice(a, b - a).to_pylist()
                    now = split

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[int, int], list] = {}
        for split, _, rows in runs(batches):
            own = out.setdefault(split, [None, 0])
            for line in rows:
                if line.startswith(">"):
                    own[:] = [(line[1:].split() or [""])[0], 0]
                else:
                    own[1] += len(line.strip())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64()), pa.array([v[0] for v in out.values()], pa.string()), pa.array([v[1] for v in out.values()], pa.int64())], names=["file", "block", "header", "bases"])

    # a row for each split, as the driver has them for its tasks, too
    noted = sorted(map(tuple, lines.mapInArrow(note, "file long, block long, header string, bases long").collect()), key=lambda r: r[:2])
    first: dict[tuple[int, int], tuple[str | None, int]] = {}
    now: tuple = (None, None, 0)
    for file, block, header, bases in noted:
        chrom, place = (None, 0) if file != now[0] else now[1:]
        first[file, block] = (chrom, place)
        now = (file, header, bases) if header is not None else (file, chrom, place + bases)
    sent, size = spark.sparkContext.broadcast(first), stride + reach

    def cutter(border: bool):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Parts of tiles that a split's borders cut, or else whole tiles."""
            out: list[tuple] = []
            chrom, begin, at, held = None, 0, 0, ""  # held starts at place `at`; the split's part of the chromosome at `begin`

            def flush(closed: bool, all_: bool) -> None:
                """Tiles that held has whole; at a run's end all that it has a part of."""
                nonlocal at, held
                end, k = at + len(held), at // stride
                if at == begin:  # tiles from before may reach into this part
                    k = max(0, -(-(at - size + 1) // stride))
                while k * stride < end and (all_ or k * stride + size <= end):
                    a, b = max(at, k * stride), min(end, k * stride + size)
                    whole = a == k * stride and (b == k * stride + size or closed)
                    if b > a and whole != border:
                        out.append((chrom, k * stride, a - k * stride, held[a - at : b - at]))
                    k += 1
                if not all_ and k * stride > at:
                    held, at = held[k * stride - at :], k * stride

            def batch_of() -> pa.RecordBatch:
                rows, kinds = out[:], (pa.string(), pa.int64(), pa.int64(), pa.string())
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["chrom", "tile_start", "at", "seq"])

            for split, new, rows in runs(batches):
                if new:
                    flush(False, True)
                    chrom, at = sent.value[split]
                    begin, held = at, ""
                part: list[str] = []
                for line in rows:
                    if line.startswith(">"):
                        held += "".join(part).upper()
                        part.clear()
                        flush(True, True)
                        chrom, begin, at, held = (line[1:].split() or [""])[0], 0, 0, ""
                    else:
                        part.append(line.strip())
                held += "".join(part).upper()
                if at != begin or len(held) > 2 * size:
                    flush(False, False)
                yield batch_of()
            flush(False, True)
            yield batch_of()

        return cut

    kinds = "chrom string, tile_start long, at long, seq string"
    parts = lines.mapInArrow(cutter(True), kinds).groupBy("chrom", "tile_start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    tiles = lines.mapInArrow(cutter(False), kinds).drop("at").unionByName(parts)
    return Genome(tiles.where("chrom is not null and seq <> ''"), stride, reach)


def gtf_genes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start (0-based), end, gene_name, gene_type, strand of gene features on chr*."""
    rows = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema("chrom string, src string, feature string, start long, end long, dot string, strand string, frame string, attributes string").csv(path)
    rows = rows.where("feature = 'gene' and chrom like 'chr%'")
    return rows.select("chrom", to_zero_based(F.col("start")).alias("start"), "end", gtf_attribute(F.col("attributes"), "gene_name").alias("gene_name"), gtf_attribute(F.col("attributes"), "gene_type").alias("gene_type"), "strand").distinct()


def catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    """The 12-column catalogue as BED, its length as score."""
    cols = "browser string, id string, chrom string, start long, end long, coverage string, strand string, length long, gene string, region string, conservation string, pubmed string"
    return spark.read.schema(cols).option("header", True).option("quote", "").csv(path).select("chrom", "start", "end", F.col("id").alias("name"), F.col("length").alias("score"), "strand")


def repeat_table(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name, score (class;family), strand of a repeat table with a header line."""
    cols = ", ".join(f"c{i} string" for i in range(1, 18))
    rows = spark.read.schema(cols).option("sep", "\t").option("header", True).option("enforceSchema", True).option("quote", "").csv(path)
    return rows.select(F.col("c6").alias("chrom"), F.col("c7").cast("long").alias("start"), F.col("c8").cast("long").alias("end"), F.col("c11").alias("name"), F.concat_ws(";", "c12", "c13").alias("score"), F.col("c10").alias("strand"))


def catalogue_tsv(spark: SparkSession, path: str) -> DataFrame:
    """id, chrom, start (1-based), end, strand, gene_name, box_type, seq of the 23-column catalogue."""
    cols = ", ".join(f"c{i} string" for i in range(1, 24))
    rows = spark.read.schema(cols).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return rows.select(F.col("c1").alias("id"), F.col("c13").alias("chrom"), F.col("c14").try_cast("long").alias("start"), F.col("c15").try_cast("long").alias("end"), F.col("c16").alias("strand"), F.col("c17").alias("gene_name"), F.col("c19").alias("box_type"), F.upper("c23").alias("seq"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """BED rows; those with less than six fields go."""
    return spark.read.schema(BED_SCHEMA).option("sep", "\t").option("quote", "").csv(path).where("strand is not null")


def table_lines(lines: DataFrame, caption: str) -> DataFrame:
    """value, ord of the lines after the first that holds the caption; fails if none does. lines(value, ord)."""
    at = lines.where(F.contains("value", F.lit(caption))).agg(F.min("ord")).first()[0]
    if at is None:
        raise ValueError(f"no line holds {caption!r}")
    return lines.where(F.col("ord") > at)


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """old, current from a two-column table; stands for remote lookups, which are out of scope."""
    return spark.read.schema("old string, current string").option("sep", "\t").option("quote", "").csv(path)


def gene_info(spark: SparkSession, path: str, tax_id: str = "9606") -> DataFrame:
    """old, current from a published gene-information file, for aliases(): each symbol and synonym of a species' genes, once.

    A gene's current symbol is the nomenclature authority's or, without one, its own. Of the genes that have a name, those whose
    symbol it is come before those whose authority calls them so, and these before synonyms; of equals the least gene number
    counts. A dash stands for no value, a line that begins with # is a header.
    """
    cols = "tax_id string, gene_id string, symbol string, locus_tag string, synonyms string, refs string, chrom string, place string, about string, kind string, official string"
    raw = spark.read.schema(cols).option("sep", "\t").option("quote", "").option("comment", "#").csv(path).where(F.col("tax_id") == tax_id)
    given = lambda c: F.when((F.col(c) != "-") & (F.col(c) != ""), F.col(c))
    named = lambda rank, name: F.struct(F.lit(rank).alias("rank"), name.alias("old"))
    names = F.concat(F.array(named(0, given("symbol")), named(1, given("official"))), F.transform(F.coalesce(F.split(given("synonyms"), r"\|"), F.array().cast("array<string>")), lambda v: named(2, v)))
    rows = raw.select(F.col("gene_id").try_cast("long").alias("gene_id"), F.coalesce(given("official"), given("symbol")).alias("current"), F.explode(names).alias("n")).where("current is not null and n.old <> ''")
    return rows.groupBy(F.col("n.old").alias("old")).agg(F.min_by("current", F.struct("n.rank", F.coalesce("gene_id", F.lit((1 << 63) - 1)).alias("gene_id"), "current")).alias("current"))
