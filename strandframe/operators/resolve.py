"""Gene symbols of host-gene lines, by one cascade of small lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import field, no_host, repair_table_line


def resolve_symbols(lines: DataFrame, genes: DataFrame, alias: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """name, gene, source for lines(value) "id, symbol, description".

    after(name, symbol) overrides all. Lines without host get NA, also those that before(name, symbol) has; it replaces the symbols
    of others. Then: in genes(gene_name); an alias(old, current) in genes; an alias outside; unresolved with the symbol as it is.
    Empty current symbols are none.
    """
    fixed = repair_table_line(F.col("value"))
    rows = lines.where(F.rlike(fixed, F.lit("(?i)^AluACA[0-9]+,"))).select(fixed.alias("line"), field(fixed, 1).alias("name"), field(fixed, 2).alias("raw"))
    rows = rows.join(before.groupBy("name").agg(F.max("symbol").alias("b")), "name", "left").withColumn("symbol", F.coalesce("b", "raw"))
    own = genes.select(F.col("gene_name").alias("symbol")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(own, "symbol", "left").join(alias.where("current <> ''").groupBy(F.col("old").alias("symbol")).agg(F.max("current").alias("current")), "symbol", "left")
    rows = rows.join(own.select(F.col("symbol").alias("current"), F.col("known").alias("current_known")), "current", "left")
    rows = rows.join(after.groupBy("name").agg(F.max("symbol").alias("a")), "name", "left")
    by_hand, none = F.col("a").isNotNull(), no_host(F.col("line"))
    gene = F.when(by_hand, F.col("a")).when(none, "NA").when(F.col("known"), F.col("symbol")).when(F.col("current").isNotNull(), F.col("current")).otherwise(F.col("symbol"))
    source = F.when(by_hand, "manual_desc").when(none, "none").when(F.col("known"), "gencode_direct").when(F.col("current_known"), F.concat(F.lit("ncbi_alias:"), F.col("symbol")))
    source = source.when(F.col("current").isNotNull(), F.concat(F.lit("ncbi_notin_gencode:"), F.col("symbol"))).otherwise("UNRESOLVED")
    return rows.select("name", gene.alias("gene"), source.alias("source"))


def needed_spans(genes: DataFrame, id_gene: DataFrame) -> DataFrame:
    """All spans of the symbols that are resolved, repeated loci too."""
    wanted = id_gene.where("gene <> 'NA' and source <> 'UNRESOLVED'").select(F.col("gene").alias("gene_name")).distinct()
    return genes.join(wanted, "gene_name", "left_semi")
