"""Catalogue operators: tiers, naming, replacement, collapse, annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import canonical, first_index, id_number, locus
from .compare import first_containing
from .intervals import overlap_anti, overlap_left, to_zero_based


#: Why a sequence has no single place. Fixed values.
REASONS = ("no exact match anywhere in hg38 (likely SNP/assembly diff vs deposited seq)", "multi-mapping paralog family; exact match at >1 locus")


def assemble(located: DataFrame, genome_hits: DataFrame, overrides: DataFrame) -> DataFrame:
    """chrom, start, end, name, score, strand, located_by: unique in the gene, unique in the genome, or named by overrides(name, chrom, start, label).

    score is the gene of what was found in one, and - for others.
    """
    cols = lambda score: ["chrom", "start", "end", "name", score.alias("score"), "strand"]
    gene = located.where("chrom is not null and status in ('unique', 'multi_in_gene')").select(*cols(F.col("gene")), F.lit("gene_anchored").alias("located_by")).distinct()
    unique = genome_hits.where("n_hits = 1").select(*cols(F.lit("-")), F.lit("genome_unique").alias("located_by"))
    chosen = genome_hits.join(overrides, ["name", "chrom", "start"]).select(*cols(F.lit("-")), F.col("label").alias("located_by"))
    return gene.unionByName(unique).unionByName(chosen)


def unresolved(genome_hits: DataFrame, id_gene: DataFrame, overrides: DataFrame) -> DataFrame:
    """name, gene, reason, candidate_loci of sequences that have no single place; overrides take only those with several places out. Genes unknown are empty."""
    settled = overrides.select(F.col("name").alias("o_name")).distinct()
    left = genome_hits.where("n_hits <> 1").join(settled, (F.col("name") == F.col("o_name")) & (F.col("n_hits") > 1), "left_anti")
    spot = F.when(F.col("chrom").isNotNull(), F.struct("chrom", "start", F.concat(locus(F.col("chrom"), F.col("start"), F.col("end"), F.col("strand")), F.lit(";")).alias("text")))
    per = left.groupBy("name").agg(F.max("n_hits").alias("n_hits"), F.array_join(F.transform(F.array_sort(F.collect_list(spot)), lambda x: x["text"]), "").alias("loci"))
    genes = id_gene.groupBy("name").agg(F.max("gene").alias("gene"))
    none = F.col("n_hits") == 0
    return per.join(genes, "name", "left").select("name", F.coalesce("gene", F.lit("")).alias("gene"), F.when(none, REASONS[0]).otherwise(REASONS[1]).alias("reason"), F.when(none, "-").otherwise(F.col("loci")).alias("candidate_loci"))


def match_catalogue(placed: DataFrame, catalogue: DataFrame, accessions: DataFrame, id_gene: DataFrame, stranded: bool = False) -> DataFrame:
    """The ten-column deliverable, in numeric order of ids; - where nothing matches."""
    pairs = overlap_left(placed, catalogue, stranded)
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    out = pairs.join(accessions.groupBy(F.col("name").alias("a_name")).agg(F.max_by("accession", "ord").alias("accession")), "a_name", "left").join(id_gene.groupBy(F.col("name").alias("a_name")).agg(F.max("gene").alias("gene")), "a_name", "left")
    where = F.when(F.col("b_chrom").isNotNull(), locus(F.col("b_chrom"), F.col("b_start"), F.col("b_end"))).otherwise("-")
    out = out.select(F.col("a_name").alias("id"), none("accession").alias("accession"), none("gene").alias("table_gene"), F.col("a_chrom").alias("chrom"), F.col("a_start").alias("start"), F.col("a_end").alias("end"), F.col("a_strand").alias("strand"), F.col("a_located_by").alias("located_by"), none("b_name").alias("match_id"), where.alias("match_locus"))
    return out.distinct().orderBy(id_number(F.col("id")), "id", "chrom", "start", "match_id")


def annotate_repeats(loci: DataFrame, repeats: DataFrame) -> DataFrame:
    """loci's columns and repeat_family: names of overlapping repeats by summed bases, then by name; `none` for none."""
    pairs = overlap_left(loci, repeats, False)
    keys = [f"a_{c}" for c in loci.columns]
    per = pairs.groupBy(*keys, "b_name").agg(F.sum("bp").alias("bp"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("b_name").isNotNull(), F.struct((-F.col("bp")).alias("bp"), F.col("b_name").alias("n"))))), lambda x: x["n"]), "|")
    return per.groupBy(*keys).agg(names.alias("f")).select(*[F.col(k).alias(c) for k, c in zip(keys, loci.columns)], F.when(F.col("f") == "", "none").otherwise(F.col("f")).alias("repeat_family"))


def strand_concordance(loci: DataFrame, repeats: DataFrame) -> DataFrame:
    """Overlaps and how many of them are on the repeat's strand."""
    return overlap_left(loci, repeats, False).where("b_name is not null").agg(F.count("*").alias("overlaps"), F.count_if(F.col("a_strand") == F.col("b_strand")).alias("concordant"))


def unique_names(rows: DataFrame) -> DataFrame:
    """rows(id, gene_name, ...) and name: the gene name where it is the only one, gene_id where it repeats, else the id.

    Rows without a gene name may be many: they go into the join by their ids, where nothing meets them.
    """
    has = F.length(F.coalesce("gene_name", F.lit(""))) > 0
    n = rows.where(has).groupBy(F.col("gene_name").alias("_key")).agg(F.count("*").alias("_n")).withColumn("_has", F.lit(True))
    out = rows.withColumn("_has", has).withColumn("_key", F.when(has, F.col("gene_name")).otherwise(F.col("id"))).join(n, ["_has", "_key"], "left")
    return out.withColumn("name", F.when(~has, F.col("id")).when(F.col("_n") == 1, F.col("gene_name")).otherwise(F.concat_ws("_", "gene_name", "id"))).drop("_has", "_key", "_n")


def located(catalogue: DataFrame) -> DataFrame:
    """Rows with a chromosome and a start."""
    return catalogue.where("chrom is not null and chrom <> '' and start is not null")


def dropped_rows(catalogue: DataFrame, tier: str) -> DataFrame:
    """One row: how many rows are of the tier, and how many of the others have no location."""
    own = F.col("box_type").eqNullSafe(F.lit(tier))
    placed = F.coalesce(F.col("chrom") != "", F.lit(False)) & F.col("start").isNotNull()
    return catalogue.agg(F.count_if(own).alias("of_tier"), F.count_if(~own & ~placed).alias("without_location"), F.count_if(~own & placed).alias("kept"))


def replace_tier(catalogue: DataFrame, union: DataFrame, tier: str, new_tier: str = "Alu-ACA") -> DataFrame:
    """catalogue(id, chrom, start 1-based, end, strand, gene_name, box_type) without a tier and without what overlaps the union on its strand, then the union.

    chrom, start, end, name, score, strand, origin, box_type, 0-based.
    """
    kept = located(catalogue.where(~F.col("box_type").eqNullSafe(F.lit(tier))))
    named = unique_names(kept).select("chrom", to_zero_based(F.col("start")).alias("start"), "end", "name", F.lit(0).cast("long").alias("score"), "strand", F.lit("catalogue").alias("origin"), F.coalesce("box_type", F.lit("")).alias("box_type"))
    rest = overlap_anti(named, union.select("chrom", "start", "end", "name", "score", "strand"), True)
    return rest.unionByName(union.select("chrom", "start", "end", "name", F.lit(0).cast("long").alias("score"), "strand", F.lit("union").alias("origin"), F.lit(new_tier).alias("box_type")))


def shipped_sequences(catalogue: DataFrame, tier: str) -> DataFrame:
    """name and seq of the rows that a replaced catalogue takes over, as the catalogue gives them."""
    return unique_names(located(catalogue.where(~F.col("box_type").eqNullSafe(F.lit(tier))))).select("name", "seq")


def winner(sno: Column, uni: Column, tol: int = 1) -> tuple[Column, Column]:
    """Which of two sequences stays and by which rule."""
    short, long_ = F.when(F.length(sno) < F.length(uni), sno).otherwise(uni), F.when(F.length(sno) < F.length(uni), uni).otherwise(sno)
    near = first_index(long_, short) <= tol
    rule = F.when(sno == uni, "identical").when(canonical(uni) & ~canonical(sno), "union-ACA-canonical").when(canonical(sno) & ~canonical(uni), "snodb-ACA-canonical").when(near, "5prime-offset").otherwise("longer-5prime-hairpin")
    union_wins = F.when(rule.isin("identical", "union-ACA-canonical", "5prime-offset"), True).when(rule == "snodb-ACA-canonical", False).otherwise(F.length(uni) > F.length(sno))
    return F.when(union_wins, "union").otherwise("snodb"), rule


def collapse(sno: DataFrame, union: DataFrame, tol: int = 1, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """(merged name, seq, ord; report of seven columns) of two ordered sequence tables: paired snos go, union sequences may be replaced by them."""
    pairs = first_containing(sno, union, k)
    who, rule = winner(F.col("sno_seq"), F.col("union_seq"), tol)
    report = pairs.select("union_name", "sno_name", "sno_ord", F.length("union_seq").alias("union_len"), F.length("sno_seq").alias("snodb_len"), rule.alias("rule"), who.alias("kept"), "sno_seq", "union_seq")
    report = report.withColumn("kept_len", F.when(F.col("kept") == "union", F.col("union_len")).otherwise(F.col("snodb_len")))
    new = report.where("kept = 'snodb'").groupBy(F.col("union_name").alias("name")).agg(F.max_by("sno_seq", "sno_ord").alias("new_seq"))
    lone = sno.join(report.select(F.col("sno_name").alias("name")).distinct(), "name", "left_anti").select(F.lit(0).alias("part"), "name", "seq", "ord")
    rest = union.join(new, "name", "left").select(F.lit(1).alias("part"), "name", F.coalesce("new_seq", "seq").alias("seq"), "ord")
    return lone.unionByName(rest), report.select("union_name", F.col("sno_name").alias("snodb_name"), "union_len", "snodb_len", "rule", "kept", "kept_len")


def corrected_intervals(bed: DataFrame, replaced: DataFrame) -> DataFrame:
    """bed grown or cut at its 5' end to its new sequence's length: the end moves on the minus strand, else the start. replaced(name, seq).

    A new sequence's name, without .idN, is the row's with _ for |; of several for one name the last counts, by `ord` if there is one.
    """
    n = F.length("seq")
    key = F.replace(F.regexp_replace("name", r"\.id[0-9]+$", ""), F.lit("|"), F.lit("_")).alias("key")
    new = replaced.groupBy(key).agg((F.max_by(n, "ord") if "ord" in replaced.columns else F.max(n)).alias("new_len"))
    grow = F.coalesce(F.col("new_len") - (F.col("end") - F.col("start")), F.lit(0))
    out = bed.withColumn("key", F.replace("name", F.lit("|"), F.lit("_"))).join(new, "key", "left")
    minus = F.col("strand").eqNullSafe(F.lit("-"))
    return out.select("chrom", F.when(minus, F.col("start")).otherwise(F.col("start") - grow).alias("start"), F.when(minus, F.col("end") + grow).otherwise(F.col("end")).alias("end"), "name", "score", "strand")


def verify(extracted: DataFrame, shipped: DataFrame, examples: int = 5) -> tuple[DataFrame, DataFrame]:
    """Counts compared, identical, differ; and the first few differing names. Both have name and seq."""
    both = shipped.where(F.length("seq") > 0).select("name", F.upper("seq").alias("s")).join(extracted.select("name", F.upper("seq").alias("e")), "name")
    same = F.col("s") == F.col("e")
    return both.agg(F.count("*").alias("compared"), F.count_if(same).alias("identical"), F.count_if(~same).alias("differ")), both.where(~same).select("name").orderBy("name").limit(examples)
