"""Sources and sinks as queries: whole tables written as files below the shared folder and read back, with the SQL for the same rows.

Documents stand for sequence records, parts for gene and repeat tables, events for catalogues.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import seq as S
from .operators import catalog, report, resolve
from .queries import DNA, EV, ORACLE_SQL, QUERIES, dna, docs, ev, query, t
from .queries_locus import DNA_OF, text
from .sources import readers, writers
from .sources.shared import shared_dir

__all__ = ["ORACLE_SQL", "QUERIES"]


def written(spark: SparkSession, rows: DataFrame, line: Column, *order: str) -> str:
    """The path of one text file with a line, or a few, for each row in order."""
    path = shared_dir(spark, "text")
    rows.orderBy(*order).select(line.alias("value")).coalesce(1).write.text(path)
    return path


def records(spark: SparkSession, d: str) -> str:
    """FASTA: headers with an accession that repeats, an id with a comma and the document's number; wrapped lines, some of small letters."""
    x = dna(docs(spark, d))
    bases = F.when(F.col("ord") % 2 == 0, F.col("seq")).otherwise(F.lower("seq"))
    header = text(">AB", F.col("ord") % 50, ".1 some AluACA", F.col("ord") % 20, ", then AluACA", F.col("ord") % 30, " n", F.col("ord"))
    return written(spark, x, text(header, "\n", F.regexp_replace(bases, "(.{60})", "$1\n")), "ord")


FASTA = DNA_OF + "r AS (SELECT 'AB' || (ord % 50) || '.1' AS accession, 'AluACA' || (ord % 20) || ',' AS id, 'AluACA' || (ord % 30) AS last_id, seq, ord FROM dd) "


@query(FASTA + "SELECT id AS name, accession, md5(arg_max(seq, ord)) AS h FROM r GROUP BY 1, 2")
def s1_fasta_ids(spark, d):
    return readers.fasta_ids(spark, records(spark, d)).select("name", "accession", F.md5("seq").alias("h"))


@query(FASTA + "SELECT id AS name, accession, md5(arg_max(seq, ord)) AS h FROM r WHERE ord % 20 % 3 = 0 GROUP BY 1, 2")
def s2_wanted_ids(spark, d):
    wanted = spark.range(20).where("id % 3 = 0").select(text("AluACA", F.col("id"), ",").alias("name"))
    return readers.fasta_ids(spark, records(spark, d), wanted).select("name", "accession", F.md5("seq").alias("h"))


@query(FASTA + "SELECT accession AS name, md5(arg_max(seq, ord)) AS h FROM r GROUP BY 1")
def s3_last_record_wins(spark, d):
    return readers.fasta_named(spark, records(spark, d)).select("name", F.md5("seq").alias("h"))


@query(FASTA + "SELECT accession AS name, md5(arg_max(seq, ord)) AS h FROM r WHERE accession LIKE 'AB1%' GROUP BY 1")
def s4_name_prefix(spark, d):
    return readers.fasta_named(spark, records(spark, d), "AB1").select("name", F.md5("seq").alias("h"))


@query(FASTA + "SELECT accession AS name, md5(seq) AS h, row_number() OVER (PARTITION BY accession ORDER BY ord)::INT AS nth FROM r")
def s5_records_in_order(spark, d):
    rows = readers.fasta_named(spark, records(spark, d), last_wins=False)
    return rows.select("name", F.md5("seq").alias("h"), F.row_number().over(Window.partitionBy("name").orderBy("ord")).alias("nth"))


@query(DNA_OF + "x AS (SELECT 'chr' || name AS chrom, seq FROM dd WHERE length(seq) > 0) SELECT chrom, tile_start, md5(substr(seq, tile_start + 1, 575)) AS h FROM (SELECT chrom, seq, unnest(range(0, length(seq), 512)) AS tile_start FROM x)")
def s6_genome_tiles(spark, d):
    x = dna(docs(spark, d))
    path = written(spark, x, text(">chr", F.col("name"), " about\n", F.regexp_replace(F.lower("seq"), "(.{50})", "$1\n")), "ord")
    return readers.genome_tiles(spark, path, 512, 63).tiles.select("chrom", "tile_start", F.md5("seq").alias("h"))


@query(FASTA + "SELECT accession, last_id AS name FROM r")
def s7_header_ids(spark, d):
    return readers.fasta_accessions(spark, records(spark, d)).select("accession", "name")


@query("SELECT DISTINCT 'chr' || (p_size % 25) AS chrom, p_partkey - 1 AS start, p_partkey + p_size AS \"end\", p_brand AS gene_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'protein_coding' END AS gene_type, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part WHERE p_partkey % 5 <> 0 AND p_size % 7 <> 0")
def s8_gtf_genes(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(key % 3 == 0, text('gene_id "x"; gene_name "', F.col("p_brand"), '";')).otherwise(text('gene_type "protein_coding"; gene_name "', F.col("p_brand"), '";'))
    chrom = F.when(size % 7 == 0, text("GL", size)).otherwise(text("chr", size % 25))
    line = F.concat_ws("\t", chrom, F.lit("src"), F.when(key % 5 == 0, "exon").otherwise("gene"), key.cast("string"), (key + size).cast("string"), F.lit("."), F.when(key % 2 == 0, "+").otherwise("-"), F.lit("."), kind)
    parts = t(spark, d, "part")
    return readers.gtf_genes(spark, written(spark, parts, F.when(key == 1, text("#a comment\n", line)).otherwise(line), "p_partkey"))


def catalogue_lines(name: Column) -> Column:
    """A line of the 12-column catalogue, the header before the first."""
    line = F.concat_ws(",", F.lit("b"), name, "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("1"), "strand", (F.col("end") - F.col("start")).cast("string"), F.lit("g"), F.lit("r"), F.lit("c"), F.lit(""))
    return F.when(F.col("name") == "0", text("Browser,napRNAID,Chrom,Start,End,Coverage,Strand,Length,Gene,Region,Conservation,Pubmed\n", line)).otherwise(line)


@query(EV + "SELECT chrom, s AS start, t AS \"end\", 'N' || name AS name, t - s AS score, strand FROM e")
def s9_catalogue_csv(spark, d):
    x = ev(spark, d).withColumn("n", F.col("name").cast("long"))
    least = x.agg(F.min("n")).first()[0]
    x = x.withColumn("name", F.when(F.col("n") == least, "0").otherwise(F.col("name")))
    return readers.catalogue_csv(spark, written(spark, x, catalogue_lines(text("N", F.col("n"))), "n"))


@query("SELECT 'chr' || (p_size % 25) AS chrom, p_partkey AS start, p_partkey + p_size AS \"end\", CASE WHEN p_partkey % 7 = 0 THEN chr(34) ELSE '' END || p_brand AS name, 'SINE;' || split_part(p_type, ' ', 1) AS score, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part")
def s10_repeat_table(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    line = F.concat_ws("\t", *[F.lit("x")] * 5, text("chr", size % 25), key.cast("string"), (key + size).cast("string"), F.lit("-5"), F.when(key % 2 == 0, "+").otherwise("-"), F.when(key % 7 == 0, text('"', F.col("p_brand"))).otherwise(F.col("p_brand")), F.lit("SINE"), F.split("p_type", " ")[0], *[F.lit("y")] * 4)
    parts = t(spark, d, "part")
    least = parts.agg(F.min("p_partkey")).first()[0]
    return readers.repeat_table(spark, written(spark, parts, F.when(key == least, text("#bin\tand more\n", line)).otherwise(line), "p_partkey"))


@query("SELECT 'sno' || p_partkey AS id, 'chr1' AS chrom, p_partkey AS start, p_partkey + p_size AS \"end\", '-' AS strand, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS gene_name, 'HACA' AS box_type, upper(replace(p_name, ' ', '')) AS seq FROM part")
def s11_catalogue_tsv(spark, d):
    key = F.col("p_partkey")
    line = F.concat_ws("\t", text("sno", key), *[F.lit("x")] * 11, F.lit("chr1"), key.cast("string"), (key + F.col("p_size")).cast("string"), F.lit("-"), F.when(key % 3 == 0, "").otherwise(F.col("p_brand")), F.lit("x"), F.lit("HACA"), *[F.lit("x")] * 3, F.replace("p_name", F.lit(" "), F.lit("")))
    parts = t(spark, d, "part")
    least = parts.agg(F.min("p_partkey")).first()[0]
    return readers.catalogue_tsv(spark, written(spark, parts, F.when(key == least, text("\t".join(f"c{i}" for i in range(1, 24)), "\n", line)).otherwise(line), "p_partkey"))


@query("SELECT p_name AS value FROM part WHERE p_partkey > 77")
def s12_lines_after_caption(spark, d):
    lines = t(spark, d, "part").select(F.when(F.col("p_partkey").isin(77, 90), text("See Supplemental Table 3 of ", F.col("p_name"))).otherwise(F.col("p_name")).alias("value"), F.col("p_partkey").alias("ord"))
    return readers.table_lines(lines, "Supplemental Table 3").select(F.regexp_replace("value", "^See Supplemental Table 3 of ", "").alias("value"))


@query("SELECT CASE WHEN p_partkey % 7 = 0 THEN chr(34) ELSE '' END || 'S' || p_partkey AS old, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS current FROM part")
def s14_aliases(spark, d):
    line = F.concat_ws("\t", text(F.when(F.col("p_partkey") % 7 == 0, '"').otherwise(""), "S", F.col("p_partkey")), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_brand")))
    return readers.aliases(spark, written(spark, t(spark, d, "part"), line, "p_partkey"))


INFO = "g AS (SELECT p_partkey AS id, 'S' || p_partkey AS symbol, CASE WHEN p_partkey % 5 <> 0 THEN 'S' || (p_partkey + 1) || '|A' || (p_partkey % 97) END AS synonyms, CASE WHEN p_partkey % 4 <> 0 THEN p_brand || p_partkey % 50 END AS official FROM part WHERE p_partkey % 11 <> 0), "


@query("WITH " + INFO + "n AS (SELECT id, coalesce(official, symbol) AS current, symbol AS old, 0 AS rank FROM g UNION ALL SELECT id, official, official, 1 FROM g WHERE official IS NOT NULL UNION ALL SELECT id, coalesce(official, symbol), unnest(string_split(synonyms, '|')), 2 FROM g WHERE synonyms IS NOT NULL) SELECT old, arg_min(current, rank::HUGEINT * 1000000000000 + id) AS current FROM n GROUP BY 1")
def s14_gene_info(spark, d):
    """Symbols, authority's symbols and synonyms that several genes share, another species' genes, and dashes."""
    n = F.col("p_partkey")
    synonyms = F.when(n % 5 != 0, text("S", n + 1, "|A", n % 97)).otherwise("-")
    official = F.when(n % 4 != 0, text(F.col("p_brand"), n % 50)).otherwise("-")
    line = F.concat_ws("\t", F.when(n % 11 == 0, "10090").otherwise("9606"), n.cast("string"), text("S", n), F.lit("-"), synonyms, *[F.lit("-")] * 5, official, F.lit("rest"))
    return readers.gene_info(spark, written(spark, t(spark, d, "part"), line, "p_partkey"))


@query(EV + "SELECT chrom, s AS start, t AS \"end\", name, '0' AS score, strand FROM e WHERE event_id % 3 <> 0")
def s15_bed(spark, d):
    six = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "name", F.lit("0"), "strand")
    short = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "name")
    return readers.bed(spark, written(spark, ev(spark, d), F.when(F.col("name").cast("long") % 3 == 0, short).otherwise(six), "name"))


@query(DNA + "SELECT CASE WHEN n = 0 THEN '>' || name ELSE seq END AS value FROM dd, range(2) v(n)")
def k1_write_fasta(spark, d):
    path = shared_dir(spark, "fasta")
    writers.write_fasta(dna(docs(spark, d)), path)
    return spark.read.text(path)


@query(EV + "SELECT '>' || name || ' ' || chrom || ':' || s || '-' || t || '(' || strand || ')' AS value FROM e")
def k3_locus_headers(spark, d):
    path = shared_dir(spark, "fasta")
    writers.write_fasta(ev(spark, d).withColumn("seq", F.lit("acgt")), path, writers.locus_header())
    return spark.read.text(path).where("value like '>%'")


@query(EV + "SELECT chrom || chr(9) || s || chr(9) || t || chr(9) || name || chr(9) || coalesce(NULLIF(event_id % 4, 0)::VARCHAR, '.') || chr(9) || strand || chr(9) || 'naprnadb' AS value FROM e")
def k4_write_bed(spark, d):
    path, n = shared_dir(spark, "bed"), F.col("name").cast("long") % 4
    writers.write_bed(ev(spark, d).withColumn("score", F.when(n != 0, n)).withColumn("source", F.lit("naprnadb")), path, ["chrom", "start", "end", "name", "score", "strand", "source"])
    return spark.read.text(path)


@query("SELECT 'id' || chr(9) || 'name' || chr(9) || 'size' AS value UNION ALL SELECT p_partkey || chr(9) || p_name || chr(9) || CASE WHEN p_size % 2 = 0 THEN '-' ELSE p_size::VARCHAR END FROM part")
def k5_write_tsv(spark, d):
    path = shared_dir(spark, "tsv")
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 != 0, F.col("p_size")).alias("size"))
    writers.write_tsv(rows, path, ["id"])
    return spark.read.text(path)


@query(EV + "SELECT chrom || chr(9) || s || chr(9) || t || chr(9) || name || chr(9) || '0' || chr(9) || strand AS value FROM e")
def k6_write_placements(spark, d):
    path = shared_dir(spark, "bed")
    writers.write_placements(ev(spark, d).drop("score"), path)
    return spark.read.text(path)


@query(EV + "SELECT chrom || chr(9) || s || chr(9) || t || chr(9) || name || chr(9) || '0' || chr(9) || strand || chr(9) || CASE WHEN event_id % 2 = 0 THEN 'AluY' ELSE 'none' END AS value FROM e")
def k7_rewrite(spark, d):
    path, cols = shared_dir(spark, "bed"), ["chrom", "start", "end", "name", "score", "strand"]
    writers.write_bed(ev(spark, d), path, cols)
    more = readers.bed(spark, path).withColumn("repeat_family", F.when(F.col("name").cast("long") % 2 == 0, "AluY").otherwise("none"))
    writers.rewrite(more, path, lambda df, p: writers.write_bed(df, p, [*cols, "repeat_family"]))
    return spark.read.text(path)


@query(EV + "SELECT 'bed' AS sink, 1 AS files, count(*) AS lines FROM e UNION ALL SELECT 'tsv', 1, count(*) + 1 FROM e UNION ALL SELECT 'fasta', 1, 2 * count(*) FROM e")
def k8_single_files(spark, d):
    """How many files each sink leaves, written by eight tasks, and how many lines they have."""
    bed = ev(spark, d).repartition(8, "name")
    paths = {k: shared_dir(spark, k) for k in ("bed", "tsv", "fasta")}
    writers.write_bed(bed, paths["bed"])
    writers.write_tsv(bed, paths["tsv"])
    writers.write_fasta(bed.withColumn("seq", F.lit("a")), paths["fasta"])
    lines = [spark.read.text(p).select(F.lit(k).alias("sink"), F.col("_metadata.file_path").alias("f")) for k, p in paths.items()]
    return reduce(DataFrame.unionByName, lines).groupBy("sink").agg(F.count_distinct("f").cast("int").alias("files"), F.count("*").alias("lines"))


@query("SELECT count(*) FILTER (WHERE p_size % 5 = 0) AS of_tier, count(*) FILTER (WHERE p_size % 5 <> 0 AND (p_partkey % 7 = 0 OR p_partkey % 11 = 0)) AS without_location, count(*) FILTER (WHERE p_size % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0) AS kept FROM part")
def p12_dropped_rows(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = t(spark, d, "part").select(F.when(key % 7 == 0, "").otherwise("chr1").alias("chrom"), F.when(key % 11 != 0, key).alias("start"), F.when(size % 5 == 0, "AluACA").when(size % 5 == 1, "HACA").alias("box_type"))
    return catalog.dropped_rows(rows, "AluACA")


@query("SELECT split_part(p_type, ' ', 1) AS source, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, source")
def o5_counts_descending(spark, d):
    return report.group_counts(t(spark, d, "part").withColumn("source", F.replace("p_type", F.lit(" "), F.lit(":"))), S.source_tag(F.col("source")), "source", ordered=True)


@query("SELECT p_partkey, p_brand AS gene_name FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 50 = 1) AND p_brand NOT IN ('NA')")
def p6_needed_spans(spark, d):
    parts = t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("gene_name"))
    key = F.col("p_partkey") % 50
    source = F.when(key == 1, "gencode_direct").when(key == 2, "UNRESOLVED").otherwise("none")
    id_gene = parts.select(F.when(key > 2, "NA").otherwise(F.col("gene_name")).alias("gene"), source.alias("source")).where("source <> 'none' or gene = 'NA'")
    return resolve.needed_spans(parts, id_gene).select("p_partkey", "gene_name")
