"""The locus pipeline, from records and host genes to a verified catalogue with one tier replaced.

What several deliverables need is written to the shared folder once (genes, tiles, hits in genes and in the genome, the union), so that
nothing is computed twice; the rest are lazy plans over those tables. Only what the genes leave over is sought in the genome.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import catalog, fm_index, intervals, resolve, search
from ..sources import writers
from ..sources.shared import stored


@dataclass
class Inputs:
    """seqs(name, accession, seq, ord), lines(value), genes, genome, catalogue BED, and small tables of hand-given values.

    headers(name, accession, ord) gives accessions by the names that headers end in, if those differ from seqs' names; index takes the
    place of a search of the genome; repeats (BED) and tiers (id, chrom, start 1-based, end, strand, gene_name, box_type, seq) ask
    for the deliverables that need them.
    """

    seqs: DataFrame
    lines: DataFrame
    genes: DataFrame
    genome: search.Genome
    catalogue: DataFrame
    alias: DataFrame
    before: DataFrame
    after: DataFrame
    overrides: DataFrame
    headers: DataFrame | None = None
    index: fm_index.Index | None = None
    repeats: DataFrame | None = None
    tiers: DataFrame | None = None
    tier: str = "AluACA"


def sought(seqs: DataFrame, located: DataFrame) -> DataFrame:
    """name and seq of what no gene holds: of the records of a name that one of them leaves over, the last."""
    left = located.where("status in ('no_gene', 'not_found_in_gene')").select("name").distinct()
    return seqs.join(left, "name", "left_semi").groupBy("name").agg(F.max_by("seq", "ord").alias("seq"))


def deliverables(i: Inputs, config: EngineConfig | None = None) -> dict[str, DataFrame]:
    """id_gene, located, placed, final, unresolved, union, union_fasta; with repeats annotated and repeat_strands; with tiers replaced, replaced_fasta, dropped, verified, differing."""
    c = config or EngineConfig.resolve(spark=i.seqs.sparkSession)
    genome = replace(i.genome, tiles=stored(i.genome.tiles, "tiles"))
    id_gene = stored(resolve.resolve_symbols(i.lines, i.genes, i.alias, i.before, i.after), "id-gene")
    spans = resolve.needed_spans(i.genes, id_gene).withColumn("name", F.col("gene_name")).withColumn("score", F.lit(0))
    spans = search.extract(spans, genome, stranded=False).withColumn("gene", F.col("gene_name"))
    located = stored(search.locate_in_genes(i.seqs, id_gene, spans), "located")
    left = stored(sought(i.seqs, located), "left")
    found = fm_index.place_indexed(left, i.index) if i.index else search.place(left, genome)
    hits = stored(search.with_hit_counts(left, found), "genome-hits")
    placed = stored(catalog.assemble(located, hits, i.overrides), "placed")
    bed = intervals.merge(placed, True, width=c.bin_width).select("chrom", "start", "end", "name", F.lit(0).cast("long").alias("score"), "strand")
    union = stored(intervals.longest_wins(bed, i.catalogue.withColumn("score", F.col("score").cast("long")), c.max_len, width=c.bin_width), "union")
    out = {
        "id_gene": id_gene,
        "located": located,
        "placed": placed,
        "final": catalog.match_catalogue(placed, i.catalogue, (i.headers or i.seqs).select("name", "accession", "ord"), id_gene),
        "unresolved": catalog.unresolved(hits, id_gene, i.overrides),
        "union": union,
        "union_fasta": writers.numbered_headers(search.extract(union, genome), c.fasta_base),
    }
    if i.repeats is not None:
        out["annotated"] = catalog.annotate_repeats(union, i.repeats)
        out["repeat_strands"] = catalog.strand_concordance(union, i.repeats)
    if i.tiers is not None:
        replaced = stored(catalog.replace_tier(i.tiers, union, i.tier), "replaced")
        fasta = stored(search.extract(replaced, genome), "replaced-sequences")
        out |= {"replaced": replaced, "replaced_fasta": fasta.withColumn("header", writers.locus_header()), "dropped": catalog.dropped_rows(i.tiers, i.tier)}
        out["verified"], out["differing"] = catalog.verify(fasta.select("name", "seq"), catalog.shipped_sequences(i.tiers, i.tier))
    return out
