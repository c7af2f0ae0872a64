"""Queries of symbols, placement, catalogues, reports and scalar functions over the driver's tables, added to those of `queries`.

Users, parts and documents stand for sequences, symbols and genes; each query's SQL spells out the same stand-ins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import seq as S
from .operators import catalog, compare, intervals, report, resolve, search, tables
from .queries import DNA, DOC, EV, ON, ORACLE_SQL, PLACES, QUERIES, RC, ab, dna, docs, ev, id_bounds, items, query, t
from .sources import writers

__all__ = ["ORACLE_SQL", "QUERIES"]

DNA_OF = DNA.rstrip() + ", "


def text(*parts: str | Column) -> Column:
    """Columns as text, one after another."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def table_lines(spark: SparkSession, d: str) -> DataFrame:
    """value: an id, a symbol and a description for each part, every tenth without host."""
    key = F.col("p_partkey")
    about = F.when(key % 10 == 0, "No apparent host gene").otherwise(F.col("p_name"))
    return t(spark, d, "part").select(F.concat_ws(", ", text("AluACA", key), text("S", key % 100), about).alias("value"))


LINES = "ln AS (SELECT 'AluACA' || p_partkey AS name, p_partkey, 'S' || (p_partkey % 100) AS raw, p_partkey % 10 = 0 AS nohost FROM part)"


@query(f"""WITH {LINES}, b AS (SELECT 'AluACA' || (r_regionkey + 1) * 5 AS name, 'S3' AS b FROM region), a AS (SELECT 'AluACA' || (r_regionkey * 3 + 11) AS name, 'M' || r_regionkey AS a FROM region),
g AS (SELECT 'S' || n_nationkey AS symbol FROM nation), al AS (SELECT 'S' || (25 + s_suppkey % 50) AS symbol, max('S' || (s_suppkey % 40)) AS current FROM supplier GROUP BY 1),
r AS (SELECT ln.name, ln.nohost, b.b, a.a, coalesce(b.b, ln.raw) AS symbol FROM ln LEFT JOIN b ON ln.name = b.name LEFT JOIN a ON ln.name = a.name),
x AS (SELECT r.*, g.symbol IS NOT NULL AS known, al.current, h.symbol IS NOT NULL AS ck FROM r LEFT JOIN g ON r.symbol = g.symbol LEFT JOIN al ON al.symbol = r.symbol LEFT JOIN g h ON h.symbol = al.current)
SELECT name, CASE WHEN a IS NOT NULL THEN a WHEN nohost THEN 'NA' WHEN known THEN symbol WHEN current IS NOT NULL THEN current ELSE symbol END AS gene,
CASE WHEN a IS NOT NULL THEN 'manual_desc' WHEN nohost THEN 'none' WHEN known THEN 'gencode_direct' WHEN ck THEN 'ncbi_alias:' || symbol WHEN current IS NOT NULL THEN 'ncbi_notin_gencode:' || symbol ELSE 'UNRESOLVED' END AS source FROM x""")
def c1_resolve_symbols(spark, d):
    region, supplier = t(spark, d, "region"), t(spark, d, "supplier")
    genes = t(spark, d, "nation").select(text("S", F.col("n_nationkey")).alias("gene_name"))
    alias = supplier.select(text("S", 25 + F.col("s_suppkey") % 50).alias("old"), text("S", F.col("s_suppkey") % 40).alias("current"))
    before = region.select(text("AluACA", (F.col("r_regionkey") + 1) * 5).alias("name"), F.lit("S3").alias("symbol"))
    after = region.select(text("AluACA", F.col("r_regionkey") * 3 + 11).alias("name"), text("M", F.col("r_regionkey")).alias("symbol"))
    return resolve.resolve_symbols(table_lines(spark, d), genes, alias, before, after)


RECORDS = PLACES.replace("z AS (SELECT name, seq FROM di WHERE length(seq) > 0)", "z AS (SELECT name || '/' || k AS name, CASE WHEN k = 0 THEN seq ELSE seq || 'ACA' END AS seq FROM di, range(2) v(k) WHERE length(seq) > 0)")


@query(DNA_OF + RECORDS + """, h AS (SELECT pats.name, w.chrom, w.chrom::BIGINT * 1000 + w.start AS start, length(pats.p) AS n, pats.strand FROM w JOIN pats USING (p) WHERE split_part(pats.name, '/', 1)::BIGINT % 7 <> 0 AND split_part(pats.name, '/', 1)::BIGINT % 5 = w.chrom::BIGINT % 5),
x AS (SELECT z.name AS r, h.chrom, h.start, h.start + h.n AS e, h.strand, count(h.chrom) OVER (PARTITION BY z.name) AS n_hits FROM z LEFT JOIN h ON z.name = h.name)
SELECT split_part(r, '/', 1) AS name, 'AC' || split_part(r, '/', 2) AS accession, chrom, start, e AS "end", strand, n_hits, CASE n_hits WHEN 0 THEN (CASE WHEN split_part(r, '/', 1)::BIGINT % 7 = 0 THEN 'no_gene' ELSE 'not_found_in_gene' END) WHEN 1 THEN 'unique' ELSE 'multi_in_gene' END AS status FROM x""")
def c2_locate_in_genes(spark, d):
    """Two records of each name: an item, and one that goes on by three letters."""
    own = dna(items(spark, d)).where("length(seq) > 0")
    seqs = own.select("name", F.lit("AC0").alias("accession"), "seq").unionByName(own.select("name", F.lit("AC1").alias("accession"), text(F.col("seq"), "ACA").alias("seq")))
    key = F.col("name").cast("long")
    id_gene = own.select("name", F.when(key % 7 == 0, "NA").otherwise(text("G", key % 5)).alias("gene"), F.lit("gencode_direct").alias("source"))
    spans = dna(docs(spark, d)).select(text("G", key % 5).alias("gene"), F.col("name").alias("chrom"), (key * 1000).alias("start"), "seq")
    return search.locate_in_genes(seqs, id_gene, spans).select("name", "accession", "chrom", "start", "end", "strand", "n_hits", "status")


def user_hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits of customers as sequences where their errors happened, with overrides for every tenth, and their genes."""
    e = ev(spark, d).join(t(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").cast("string").alias("name")), "name", "left_semi")
    hits = e.select(F.col("chrom").alias("name"), text("c", F.col("name").cast("long") % 3).alias("chrom"), "start", "end", "strand")
    seqs = t(spark, d, "customer").select(text("u", F.col("c_custkey")).alias("name"), F.col("c_mktsegment").alias("gene"))
    chosen = hits.where("cast(substring(name, 2) as long) % 10 = 3").groupBy("name").agg(F.min(F.struct("chrom", "start")).alias("m")).select("name", "m.*", F.lit("override").alias("label"))
    return search.with_hit_counts(seqs, hits), chosen, seqs


HITS = EV + """, hh AS (SELECT e.chrom AS name, 'c' || (e.event_id % 3) AS chrom, e.s, e.t, e.strand FROM e JOIN events USING (event_id) WHERE event_type = 'error'), q AS (SELECT 'u' || c_custkey AS name, c_mktsegment AS gene FROM customer),
hits AS (SELECT q.name, hh.chrom, hh.s, hh.t, hh.strand, count(hh.chrom) OVER (PARTITION BY q.name) AS n_hits FROM q LEFT JOIN hh ON q.name = hh.name),
ov AS (SELECT name, min({'c': chrom, 's': s}) AS m FROM hh WHERE substr(name, 2)::BIGINT % 10 = 3 GROUP BY 1) """


@query(HITS + "SELECT name, chrom, s AS start, strand, n_hits FROM hits")
def c3_hit_counts(spark, d):
    return user_hits(spark, d)[0].select("name", "chrom", "start", "strand", "n_hits")


@query(HITS + """SELECT DISTINCT 'c' AS chrom, s AS start, t AS "end", name, 'G' || (event_id % 3) AS score, strand, 'gene_anchored' AS located_by FROM e WHERE event_id % 4 < 2
UNION ALL SELECT chrom, s, t, name, '-', strand, 'genome_unique' FROM hits WHERE n_hits = 1 UNION ALL SELECT hits.chrom, s, t, hits.name, '-', strand, 'override' FROM hits JOIN ov ON hits.name = ov.name AND hits.chrom = ov.m.c AND hits.s = ov.m.s""")
def c5_assemble_tiers(spark, d):
    hits, chosen, _ = user_hits(spark, d)
    k = F.col("name").cast("long") % 4
    status = F.when(k == 0, "unique").when(k == 1, "multi_in_gene").when(k == 2, "no_gene").otherwise("not_found_in_gene")
    located = ev(spark, d).withColumn("status", status).withColumn("chrom", F.lit("c")).withColumn("gene", text("G", F.col("name").cast("long") % 3))
    return catalog.assemble(located.unionByName(located), hits, chosen).select("chrom", "start", "end", "name", "score", "strand", "located_by")


@query(HITS + """SELECT x.name, CASE WHEN substr(x.name, 2)::BIGINT % 10 = 5 THEN '' ELSE q.gene END AS gene, CASE WHEN n = 0 THEN 'no exact match anywhere in hg38 (likely SNP/assembly diff vs deposited seq)' ELSE 'multi-mapping paralog family; exact match at >1 locus' END AS reason, CASE WHEN n = 0 THEN '-' ELSE loci END AS candidate_loci FROM (
SELECT name, max(n_hits) AS n, string_agg(chrom || ':' || s || '-' || t || '(' || strand || ');', '' ORDER BY chrom, s, t, strand) AS loci FROM hits WHERE n_hits = 0 OR n_hits > 1 AND substr(name, 2)::BIGINT % 10 NOT IN (3, 4) GROUP BY 1) x JOIN q ON x.name = q.name""")
def c6_unresolved(spark, d):
    """Every name that ends in 4 has an override, also those without a hit, which it doesn't help; names that end in 5 have no gene."""
    hits, chosen, seqs = user_hits(spark, d)
    more = seqs.where("cast(substring(name, 2) as long) % 10 = 4").select("name", F.lit("c0").alias("chrom"), F.lit(0).cast("long").alias("start"), F.lit("override").alias("label"))
    return catalog.unresolved(hits, seqs.where("cast(substring(name, 2) as long) % 10 <> 5"), chosen.unionByName(more))


@query(EV + f"""SELECT a.name AS id, CASE WHEN a.event_id % 3 = 0 THEN '-' ELSE 'AC' || a.name END AS accession, CASE WHEN a.event_id % 5 = 0 THEN '-' ELSE 'G' || (a.event_id % 5) END AS table_gene, a.chrom, a.s AS start, a.t AS "end", a.strand, 'gene_anchored' AS located_by,
coalesce(b.name, '-') AS match_id, CASE WHEN b.name IS NULL THEN '-' ELSE b.chrom || ':' || b.s || '-' || b.t END AS match_locus FROM a LEFT JOIN b ON {ON}""")
def c7_match_catalogue(spark, d):
    a, b = ab(spark, d)
    key = F.col("name").cast("long")
    accessions = a.where(key % 3 != 0).select("name", text("AC", F.col("name")).alias("accession"), key.alias("ord"))
    genes = a.where(key % 5 != 0).select("name", text("G", key % 5).alias("gene"))
    return catalog.match_catalogue(a.withColumn("located_by", F.lit("gene_anchored")), b, accessions, genes)


SHIPPED = DOC + "v AS (SELECT name, upper(CASE WHEN ord % 7 = 0 THEN seq || 'A' ELSE seq END) AS s, upper(seq) AS e FROM d WHERE length(seq) > 0) "


def shipped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = docs(spark, d).where("length(seq) > 0")
    return catalog.verify(x, x.withColumn("seq", F.when(F.col("ord") % 7 == 0, text(F.col("seq"), "A")).otherwise(F.col("seq"))))


@query(SHIPPED + "SELECT count(*) AS compared, count(*) FILTER (WHERE s = e) AS identical, count(*) FILTER (WHERE s <> e) AS differ FROM v")
def c13_verify(spark, d):
    return shipped(spark, d)[0]


@query(SHIPPED + "SELECT name FROM v WHERE s <> e ORDER BY name LIMIT 5")
def o7_first_mismatches(spark, d):
    return shipped(spark, d)[1]


PAIRED = DNA_OF + """p AS (SELECT i.name AS sno, i.ord AS so, i.seq AS ss, u.name AS un, u.seq AS us, row_number() OVER (PARTITION BY i.name ORDER BY (u.seq <> i.seq)::INT, u.ord) AS n FROM di i, dd u WHERE length(i.seq) > 0 AND length(u.seq) > 0 AND (contains(u.seq, i.seq) OR contains(i.seq, u.seq))),
c AS (SELECT *, length(ss) >= 6 AND substr(ss, -6, 3) = 'ACA' AS sc, length(us) >= 6 AND substr(us, -6, 3) = 'ACA' AS uc, CASE WHEN length(ss) < length(us) THEN instr(us, ss) ELSE instr(ss, us) END - 1 AS off FROM p WHERE n = 1),
r AS (SELECT *, CASE WHEN ss = us THEN 'identical' WHEN uc AND NOT sc THEN 'union-ACA-canonical' WHEN sc AND NOT uc THEN 'snodb-ACA-canonical' WHEN off <= 1 THEN '5prime-offset' ELSE 'longer-5prime-hairpin' END AS rule FROM c),
k AS (SELECT *, CASE WHEN rule IN ('identical', 'union-ACA-canonical', '5prime-offset') THEN 'union' WHEN rule = 'snodb-ACA-canonical' THEN 'snodb' WHEN length(us) > length(ss) THEN 'union' ELSE 'snodb' END AS kept FROM r) """


@query(PAIRED + "SELECT un AS union_name, sno AS snodb_name, length(us)::INT AS union_len, length(ss)::INT AS snodb_len, rule, kept, (CASE WHEN kept = 'union' THEN length(us) ELSE length(ss) END)::INT AS kept_len FROM k")
def c16_winner(spark, d):
    return catalog.collapse(dna(items(spark, d)), dna(docs(spark, d)))[1]


@query(PAIRED + "SELECT 0 AS part, name, md5(seq) AS h FROM di WHERE name NOT IN (SELECT sno FROM k) UNION ALL SELECT 1, d.name, md5(coalesce(x.s, d.seq)) FROM dd d LEFT JOIN (SELECT un, arg_max(ss, so) AS s FROM k WHERE kept = 'snodb' GROUP BY 1) x ON x.un = d.name")
def c17_collapse(spark, d):
    return catalog.collapse(dna(items(spark, d)), dna(docs(spark, d)))[0].select("part", "name", F.md5("seq").alias("h"))


@query(EV + """, n AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN name || '|x' WHEN event_id % 7 = 0 THEN name || '.id7' ELSE name END AS bed_name, CASE WHEN event_id % 5 = 0 THEN '.' ELSE strand END AS st FROM e),
g AS (SELECT *, CASE WHEN event_id % 3 = 0 AND bed_name NOT LIKE '%.id7' THEN 100 + event_id % 900 - (t - s) ELSE 0 END AS grow FROM n)
SELECT chrom, CASE WHEN st = '-' THEN s ELSE s - grow END AS start, CASE WHEN st = '-' THEN t + grow ELSE t END AS "end", bed_name AS name FROM g""")
def c18_corrected_intervals(spark, d):
    """Names with |, names that end in .idN themselves, rows without strand, and two new sequences for a name, of which the last counts."""
    key = F.col("name").cast("long")
    e = ev(spark, d)
    fasta = F.when(key % 4 == 0, text(F.col("name"), "_x.id", key + 3000)).otherwise(text(F.col("name"), ".id", key + 3000))
    new = e.where(key % 3 == 0).select(fasta.alias("name"), F.repeat(F.lit("A"), (100 + key % 900).cast("int")).alias("seq"), F.lit(2).alias("ord"))
    old = new.select("name", F.concat("seq", F.lit("ACGT")).alias("seq"), F.lit(1).alias("ord"))
    bed = e.withColumn("strand", F.when(key % 5 == 0, ".").otherwise(F.col("strand"))).withColumn("name", F.when(key % 4 == 0, text(F.col("name"), "|x")).when(key % 7 == 0, text(F.col("name"), ".id7")).otherwise(F.col("name")))
    return catalog.corrected_intervals(bed, new.unionByName(old)).select("chrom", "start", "end", "name")


def islands(rows: str, keys: str) -> str:
    return f"(SELECT count(*) FROM (SELECT CASE WHEN s <= max(t) OVER (PARTITION BY {keys} ORDER BY s, t, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM {rows}) WHERE n = 1)"


@query(EV + f"""SELECT 'overlap_either_strand' AS measure, (SELECT count(*) FROM a JOIN b ON {ON}) AS n UNION ALL SELECT 'overlap_same_strand', (SELECT count(*) FROM a JOIN b ON {ON} AND a.strand = b.strand)
UNION ALL SELECT 'identical_place', (SELECT count(*) FROM a JOIN b ON a.chrom = b.chrom AND a.s = b.s AND a.t = b.t) UNION ALL SELECT 'a_with_identical_place', (SELECT count(*) FROM a SEMI JOIN b ON a.chrom = b.chrom AND a.s = b.s AND a.t = b.t)
UNION ALL SELECT 'a_merged_stranded', {islands('a', 'chrom, strand')} UNION ALL SELECT 'a_merged_unstranded', {islands('a', 'chrom')}""")
def c19_catalogue_check(spark, d):
    return report.catalogue_check(*ab(spark, d))


@query("SELECT (SELECT count(*) FROM documents) AS records, (SELECT count(*) FROM documents WHERE coalesce(text, '') = '') AS empty, (SELECT min(doc_id) FROM documents) AS least, (SELECT max(doc_id) FROM documents) AS greatest, (SELECT count(*) = max(doc_id) - min(doc_id) + 1 FROM documents) AS complete, (SELECT max(doc_id) - min(doc_id) + 1 - count(DISTINCT doc_id) FROM documents) AS missing")
def c21_accession_check(spark, d):
    seqs = t(spark, d, "documents").select(text("AB", F.col("doc_id"), ".1").alias("accession"), F.coalesce("text", F.lit("")).alias("seq"))
    return report.accession_check(seqs, *id_bounds(t(spark, d, "documents"), F.col("doc_id")))


@query("SELECT (SELECT count(*) FROM part) AS entries, (SELECT count(*) FROM part WHERE p_partkey % 10 = 0) AS no_host, (SELECT max(p_partkey) - count(DISTINCT p_partkey) FILTER (WHERE p_partkey >= 1) FROM part) AS missing, (SELECT count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)) AS repeated")
def c22_table_check(spark, d):
    return report.table_check(table_lines(spark, d), S.id_number(S.field(F.col("value"), 1)), id_bounds(t(spark, d, "part"), F.col("p_partkey"))[1])


@query(EV + "SELECT chrom, strand, s AS start, t AS \"end\", string_agg(DISTINCT name, '|' ORDER BY name) AS name FROM e GROUP BY 1, 2, 3, 4")
def g3_identical_names(spark, d):
    return intervals.merge(ev(spark, d), True, identical_only=True)


@query(EV + f"SELECT a.name AS locus, 'r' || (b.event_id % 5) AS repeat, sum(least(a.t, b.t) - greatest(a.s, b.s))::BIGINT AS bp FROM a JOIN b ON {ON} GROUP BY 1, 2")
def g4_summed_bp(spark, d):
    a, b = ab(spark, d)
    return intervals.overlap_left(a, b).where("b_name is not null").groupBy(F.col("a_name").alias("locus"), text("r", F.col("b_name").cast("long") % 5).alias("repeat")).agg(F.sum("bp").alias("bp"))


@query("SELECT count(*) AS records, count(DISTINCT upper(text)) AS distinct_seqs, count(*) FILTER (WHERE regexp_replace(upper(text), '[ACGT]', '', 'g') <> '') AS non_acgt, count(*) FILTER (WHERE contains(upper(text), 'U')) AS rna FROM documents WHERE text IS NOT NULL")
def g12_alphabet_summary(spark, d):
    return report.alphabet_summary(docs(spark, d).withColumn("seq", F.upper("seq")))


REPORT = DOC + f"""ex AS (SELECT d.name AS a, i.name AS b, 'exact' AS relation, d.seq AS x, i.seq AS y, length(d.seq) AS n FROM d JOIN i ON d.seq = i.seq), rv AS (SELECT d.name, i.name, 'revcomp', d.seq, i.seq, length(d.seq) FROM d JOIN i ON {RC.format('d.seq')} = i.seq),
co AS (SELECT d.name AS a, i.name AS b, CASE WHEN contains(d.seq, i.seq) THEN 'b_in_a' ELSE 'a_in_b' END, d.seq, i.seq, least(length(d.seq), length(i.seq)) FROM d, i WHERE length(i.seq) >= 40 AND length(d.seq) > 0 AND (contains(d.seq, i.seq) OR contains(i.seq, d.seq)) AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.a = d.name AND ex.b = i.name)),
rep AS (SELECT * FROM ex UNION ALL SELECT * FROM rv UNION ALL SELECT * FROM co) """
ORACLE_SQL["c14_overlap_report"] = REPORT + "SELECT a AS a_name, b AS b_name, relation, length(x)::INT AS a_len, length(y)::INT AS b_len, n::INT AS overlap_len, 100.0::DOUBLE AS identity_pct, 1.0::DOUBLE AS coverage FROM rep"


@query(REPORT + "SELECT count(DISTINCT (a, b)) FILTER (WHERE relation = 'exact') AS exact, count(DISTINCT (a, b)) FILTER (WHERE relation = 'revcomp') AS revcomp, count(DISTINCT (a, b)) FILTER (WHERE relation IN ('b_in_a', 'a_in_b')) AS contained, count(DISTINCT (a, b)) FILTER (WHERE relation <> 'revcomp') AS exact_or_contained FROM rep")
def g20_relation_sizes(spark, d):
    return report.relation_sizes(compare.overlap_report(docs(spark, d), items(spark, d)))


@query(REPORT + "SELECT a AS a_name, b AS b_name, relation, n::INT AS overlap_len FROM rep ORDER BY n DESC, a, b")
def o3_ordered_report(spark, d):
    return compare.ordered_report(compare.overlap_report(docs(spark, d), items(spark, d))).select("a_name", "b_name", "relation", "overlap_len")


@query("SELECT count(*) AS rows, '5' AS field_counts, count(DISTINCT l_orderkey) AS ids, count(DISTINCT (l_partkey, l_suppkey, l_linenumber)) AS places FROM lineitem")
def g21_csv_profile(spark, d):
    lines = t(spark, d, "lineitem").select(F.concat_ws(",", F.lit("b"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]).alias("value"))
    return report.csv_profile(lines).withColumn("field_counts", F.array_join(F.col("field_counts").cast("array<string>"), "|"))


@query("SELECT p_partkey, 'AluACA' || p_partkey AS name FROM part ORDER BY p_partkey")
def o2_numeric_id_order(spark, d):
    rows = t(spark, d, "part").select("p_partkey", text("AluACA", F.col("p_partkey")).alias("name"))
    return tables.by_id_number(rows)


@query(EV + "SELECT chrom, s AS start, t AS \"end\", name, strand FROM e ORDER BY chrom, s, t, name, strand")
def o1_coordinate_order(spark, d):
    return ev(spark, d).select(*intervals.coordinate_order()).orderBy(*intervals.coordinate_order())


@query(EV + f"SELECT b, a, bp FROM (SELECT b.name AS b, a.name AS a, least(a.t, b.t) - greatest(a.s, b.s) AS bp, row_number() OVER (PARTITION BY b.name ORDER BY least(a.t, b.t) - greatest(a.s, b.s) DESC, a.name) AS n FROM a JOIN b ON {ON}) WHERE n = 1")
def o8_best_hit(spark, d):
    pairs = intervals.overlap_left(*ab(spark, d)).where("b_name is not null")
    return tables.best_per_key(pairs.select(F.col("b_name").alias("b"), F.col("a_name").alias("a"), "bp"), "b", -F.col("bp"), F.col("a"))


@query(EV + f"SELECT a.name AS a, b.name AS b FROM a JOIN b ON {ON} AND a.strand = b.strand UNION SELECT a.name, b.name FROM a JOIN b ON a.chrom = b.chrom AND a.s = b.s AND a.t = b.t")
def u8_pair_set_union(spark, d):
    a, b = ab(spark, d)
    return tables.pair_union(intervals.overlap(a, b, True), intervals.reciprocal(a, b, 1.0)).toDF("a", "b")


@query("SELECT DISTINCT user_id, event_type FROM events")
def u5_distinct_rows(spark, d):
    return t(spark, d, "events").select("user_id", "event_type").distinct()


@query(EV + "SELECT a.chrom || '_' || a.s || '_' || a.t AS key, a.name AS a, b.name AS b FROM e a JOIN e b ON a.chrom || '_' || a.s || '_' || a.t = b.chrom || '_' || b.s || '_' || b.t")
def j12_text_key(spark, d):
    x = ev(spark, d)
    return tables.text_key_join(x, x).select("key", F.col("a_name").alias("a"), F.col("b_name").alias("b"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m][a-z]* ', 'i')")
def p13_pattern_filter(spark, d):
    return tables.matching(t(spark, d, "part"), "p_name", "^[a-m][a-z]* ").select("p_partkey", "p_name")


@query(EV + "SELECT name FROM e WHERE t - s < 3000")
def p10_keep_short(spark, d):
    return intervals.keep_short(ev(spark, d), 3000).select("name")


@query(DNA + f"SELECT name, upper(trim(name || 'a ')) AS f2, (instr(seq, 'ACA') - 1)::INT AS f6, CASE WHEN length(seq) % 3 = 0 THEN 'x' ELSE '' END AS tag, contains(seq, 'GATTA') OR contains('GATTA', seq) AS f5, length(seq) % 2 = 1 AS f22 FROM dd")
def f5_substring_tests(spark, d):
    s = F.col("seq")
    return dna(docs(spark, d)).select("name", S.normalise(text(F.col("name"), "a ")).alias("f2"), S.first_index(s, F.lit("ACA")).alias("f6"), F.when(F.length(s) % 3 == 0, "x").otherwise("").alias("tag"), S.contains_either(s, F.lit("GATTA")).alias("f5"), S.is_rna(F.when(F.length(s) % 2 == 1, text(s, "GU")).otherwise(s)).alias("f22"))


@query("SELECT item_id, pos FROM (SELECT item_id, text, unnest(range(1, length(text) - 1)) AS pos FROM benchmark) WHERE substr(text, pos, 3) = 'ing'")
def f3_find_all(spark, d):
    return t(spark, d, "benchmark").select("item_id", F.explode(S.find_all(F.col("text"), F.lit("ing"))).alias("i")).select("item_id", (F.col("i") + 1).cast("long").alias("pos"))


@query("SELECT item_id, k AS kmer, count(*) AS n FROM (SELECT item_id, substr(text, i, 20) AS k FROM (SELECT item_id, text, unnest(range(1, length(text) - 18)) AS i FROM benchmark)) GROUP BY 1, 2")
def f21_kmers(spark, d):
    return t(spark, d, "benchmark").select("item_id", F.explode(S.kmers(F.col("text"), 20)).alias("kmer")).groupBy("item_id", "kmer").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_name AS f8, '' AS f8_missing, p_brand AS f9, '' AS f9_missing, 'AluACA' || p_partkey || ', x' AS f10, p_partkey % 10 = 0 AS f11, replace(p_brand, '#', '_') AS f13, p_partkey AS f14, split_part(p_type, ' ', 1) AS f15,
'Alu' || p_size AS f17, CASE WHEN p_size % 2 = 0 THEN 'Alu' ELSE 'other' END AS f17_class, p_brand || '|' || p_size AS f19, replace(url_encode(p_name || '[Gene/Name]*~+'), '%2F', '/') AS f20 FROM part""")
def f8_text_functions(spark, d):
    key, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    families = text(F.when(F.col("p_size") % 2 == 0, "Alu").otherwise("L"), F.col("p_size"), "|MIR")
    return t(spark, d, "part").select(
        "p_partkey",
        S.gtf_attribute(text('gene_id "g1"; gene_name "', name, '";'), "gene_name").alias("f8"),
        S.gtf_attribute(text('gene_id "g1";'), "gene_name").alias("f8_missing"),
        S.field(text("a,  ", brand, " ,c"), 2).alias("f9"),
        S.field(name, 2).alias("f9_missing"),
        S.repair_table_line(text("ALuACA", key, ", x\f, AluACA106,")).alias("f10"),
        S.no_host(F.when(key % 10 == 0, "has No Apparent Host Gene").otherwise(name)).alias("f11"),
        S.header_name(text(F.replace(brand, F.lit("#"), F.lit("|")), ".id3001::chr1:5-9(+)")).alias("f13"),
        S.accession_number(text("AB", key, ".1")).alias("f14"),
        S.source_tag(text(F.split("p_type", " ")[0], ":", name)).alias("f15"),
        S.dominant(text("Alu", F.col("p_size"), "|L1")).alias("f17"),
        S.repeat_class(families).alias("f17_class"),
        S.alternatives(text(brand, ",", F.col("p_size"))).alias("f19"),
        S.url_quote(text(name, "[Gene/Name]*~+")).alias("f20"),
    )


@query("SELECT l_orderkey, l_linenumber, printf('%.1f', 100.0::DOUBLE * l_partkey / nullif(l_partkey + l_suppkey, 0)) AS identity, printf('%.2f', l_suppkey::DOUBLE / nullif(least(l_partkey, l_orderkey), 0)) AS coverage, l_suppkey::DOUBLE / nullif(least(l_partkey, l_orderkey), 0) >= 0.8 AS covered FROM lineitem")
def f16_percent_text(spark, d):
    a, b, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    cov = S.coverage(b, a, o)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", writers.fixed(S.percent_identity(a, a + b), 1).alias("identity"), writers.fixed(cov, 2).alias("coverage"), (cov >= 0.8).alias("covered"))


@query(EV + f"SELECT a.name AS a, b.name AS b, greatest(0, least(a.t, b.t) - greatest(a.s, b.s)) AS bp FROM e a JOIN e b ON b.event_id = a.event_id + 1 AND a.chrom = b.chrom")
def f7_overlap_bp(spark, d):
    x = ev(spark, d).withColumn("key", F.col("name").cast("long"))
    a, b = intervals.prefixed(x, "a_"), intervals.prefixed(x, "b_")
    pairs = a.join(b, (F.col("b_key") == F.col("a_key") + 1) & (F.col("a_chrom") == F.col("b_chrom")))
    return pairs.select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), S.overlap_bp(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")).alias("bp"))


@query(EV + f", o AS (SELECT a.strand = b.strand AS same FROM a JOIN b ON {ON}) SELECT count(*) AS overlaps, count(*) FILTER (WHERE same) AS concordant FROM o")
def c10_strand_concordance(spark, d):
    return catalog.strand_concordance(*ab(spark, d))


@query(EV + ", n AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN name || '|b.id7' ELSE name END AS own FROM e) SELECT replace(own, '|', '_') || '.id' || (3000 + row_number() OVER (ORDER BY chrom, s, t, own, strand)) AS name, s AS start FROM n")
def k2_numbered_headers(spark, d):
    own = F.when(F.col("name").cast("long") % 9 == 0, text(F.col("name"), "|b.id7")).otherwise(F.col("name"))
    return writers.numbered_headers(ev(spark, d).withColumn("name", own).withColumn("seq", F.lit("a")), width=1 << 14).select("name", "start")
