import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.config import EngineConfig, validate
from strandframe.functions import seq as S
from strandframe.operators import align, bounds, catalog, classes, compare, fm_index, intervals, kmers, report, resolve, search, tables
from strandframe.plans import comparison, locus
from strandframe.sources import readers, writers
from strandframe.streaming import lookup

BED = "chrom string, start long, end long, name string, score long, strand string"
SEQ = "name string, seq string, ord long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def rc(s):
    return s.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]


def some_bed(rng, n):
    out = []
    for i in range(n):
        a = rng.randrange(0, 300)
        out.append((rng.choice(["c1", "c2"]), a, a + rng.randrange(1, 40), f"n{i}", 0, rng.choice("+-")))
    return out


@pytest.mark.parametrize("stranded", [True, False])
def test_overlaps_match_all_pairs(spark, stranded):
    rng = random.Random(1)
    a, b = some_bed(rng, 80), some_bed(rng, 80)
    hit = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and (not stranded or x[5] == y[5])
    x, y = spark.createDataFrame(a, BED), spark.createDataFrame(b, BED)
    expected = sorted((p[3], q[3]) for p in a for q in b if hit(p, q))
    for width in (7, 1000):
        assert sorted(map(tuple, intervals.overlap(x, y, stranded, width).select("a_name", "b_name").collect())) == expected
    assert {r[0] for r in intervals.overlap_anti(x, y, stranded, 7).select("name").collect()} == {p[3] for p in a} - {e[0] for e in expected}
    assert {r[0] for r in intervals.overlap_semi(x, y, stranded, 7).select("name").collect()} == {e[0] for e in expected}


def test_left_join_by_overlap_keeps_every_row(spark):
    """Equal rows, rows of very unlike lengths, empty ones and nulls; semi and anti joins agree with it."""
    rng = random.Random(7)
    a = some_bed(rng, 60) + [("c1", 10, 290, "long", 0, "+"), ("c1", 10, 290, "long", 0, "+"), ("c1", 9, 9, "empty", 0, "+"), (None, 1, 5, "none", 0, "+"), ("c3", 1, 5, "alone", 0, "+"), ("c1", 40, 41, "one", 0, None)]
    b = some_bed(rng, 40) + [("c2", 0, 300, "all", 0, "-"), ("c1", 9, 9, "empty", 0, "+"), (None, 1, 5, "none", 0, "+")]
    hit = lambda x, y, stranded: x[0] is not None and x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2] and (not stranded or x[5] == y[5] and x[5] is not None)
    x, y = spark.createDataFrame(a, BED), spark.createDataFrame(b, BED)
    for stranded in (False, True):
        want = []
        for p in a:
            own = [(p[3], q[3], min(p[2], q[2]) - max(p[1], q[1])) for q in b if hit(p, q, stranded)]
            want += own or [(p[3], None, 0)]
        for width in (1, 16, 1000):
            assert rows(intervals.overlap_left(x, y, stranded, width).select("a_name", "b_name", "bp")) == sorted(want, key=repr)
            assert rows(intervals.overlap(x, y, stranded, width, home="b").select("a_name", "b_name")) == sorted([w[:2] for w in want if w[1]], key=repr)
            lone = sorted(w[0] for w in want if w[1] is None)
            assert sorted(r["name"] for r in intervals.overlap_anti(x, y, stranded, width).collect()) == lone
            assert sorted(r["name"] for r in intervals.overlap_semi(x, y, stranded, width).collect()) == sorted(p[3] for p in a if any(hit(p, q, stranded) for q in b))
    assert intervals.overlap_left(x, y.where("false"), True).count() == len(a) and intervals.overlap_left(x.where("false"), y, True).count() == 0


def test_pairs_of_very_unlike_lengths(spark):
    """Lengths from 1 to 250 Mb on both sides, either at home: all pairs once, and no row listed more than some 64 times."""
    rng = random.Random(11)
    some = lambda p, n: [(rng.choice(["c1", "c2"]), s, s + size, f"{p}{i}", 0, rng.choice("+-")) for i in range(n) for s, size in [(rng.randrange(0, 3_000_000), int(10 ** rng.uniform(0, 8.4)))]]
    a, b = some("a", 150), some("b", 150) + [("c1", 0, 250_000_000, "all", 0, "+"), ("c2", 5, 5, "empty", 0, "+"), (None, 0, 9, "none", 0, "+")]
    a += a[:3]  # equal rows stay apart
    x, y = spark.createDataFrame(a, BED), spark.createDataFrame(b, BED)
    for stranded in (False, True):
        want = sorted((p[3], q[3]) for p in a for q in b if p[0] == q[0] and max(p[1], q[1]) < min(p[2], q[2]) and (not stranded or p[5] == q[5]))
        for home in ("a", "b"):
            assert sorted(map(tuple, intervals.overlap(x, y, stranded, home=home).select("a_name", "b_name").collect())) == want
    long = spark.createDataFrame([("c1", 7, 250_000_007, "x", 0, "+")], BED)
    classes = F.filter(F.sequence(F.lit(0), F.lit(14)), lambda k: k >= intervals._length_class("", 16384) - intervals.NEAR)
    assert long.select(F.size(intervals._bins("", classes, 16384))).first()[0] <= 64
    tiny = spark.createDataFrame([("c1", i, i + 1, str(i), 0, "+") for i in range(0, 10_000_000, 200_000)], BED)
    assert intervals.overlap(tiny, long, True).count() == 49


def test_overlap_joins_once(spark):
    x = spark.createDataFrame(some_bed(random.Random(1), 20), BED)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString().count("Join ") - df._jdf.queryExecution().analyzed().toString().count("Join Inner, true")
    assert plan(intervals.overlap_left(x, x)) == 1 and plan(intervals.longest_wins(x, x)) == 2 and plan(catalog.annotate_repeats(x, x)) == 1 and plan(report.catalogue_check(x, x)) == 1


def test_book_ended_merge_but_not_overlap(spark):
    x = spark.createDataFrame([("c", 0, 10, "a", 0, "+"), ("c", 10, 20, "b", 0, "+"), ("c", 5, 8, "c", 0, "-"), ("c", 9, 9, "bad", 0, "+")], BED)
    assert rows(intervals.merge(x, True)) == [("c", "+", 0, 20, "a|b"), ("c", "-", 5, 8, "c")]
    assert intervals.overlap(x, x, True).where("a_name < b_name").count() == 0
    assert tuple(intervals.redundancy(x, False).first()) == (4, 1, 3)


@pytest.mark.parametrize("stranded", [True, False])
def test_merge_over_bins_matches_a_scan(spark, stranded):
    rng = random.Random(3)
    bed = some_bed(rng, 60) + [("c1", 40, 250, "long", 0, "+"), ("c1", 40, 250, "copy", 0, "+")]
    expected = {}
    for row in sorted(bed, key=lambda r: (r[0], r[5] if stranded else "", r[1], r[2])):
        runs = expected.setdefault((row[0], row[5]) if stranded else (row[0],), [])
        if runs and row[1] <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], row[2]), runs[-1][2] | {row[3]})
        else:
            runs.append((row[1], row[2], {row[3]}))
    expected = sorted([(*k, a, b, "|".join(sorted(n))) for k, runs in expected.items() for a, b, n in runs], key=repr)
    x = spark.createDataFrame(bed, BED)
    for width in (7, 100, 1000):
        assert rows(intervals.merge(x, stranded, width=width)) == expected
    assert intervals.merge(x.where("false"), stranded).count() == 0


def test_header_numbers_do_not_depend_on_bins(spark):
    x = spark.createDataFrame(some_bed(random.Random(4), 50), BED).withColumn("seq", F.lit("a"))
    whole, cut = (rows(writers.numbered_headers(x, 0, w).select("start", "name")) for w in (1000, 16))
    assert whole == cut and {int(r[1].split("id")[1]) for r in whole} == set(range(1, 51))


def test_counts_and_names_with_missing_keys(spark):
    x = spark.createDataFrame([("i1", "g", 1), ("i2", "g", 2), ("i3", "h", 3), ("i4", "", 4), ("i5", None, 5), ("h", None, 6)], "id string, gene_name string, n int")
    assert rows(catalog.unique_names(x).select("id", "name", "n")) == sorted([("i1", "g_i1", 1), ("i2", "g_i2", 2), ("i3", "h", 3), ("i4", "i4", 4), ("i5", "i5", 5), ("h", "h", 6)], key=repr)
    assert rows(report.with_counts(x, "gene_name", "m").select("id", "m")) == [("h", 2), ("i1", 2), ("i2", 2), ("i3", 1), ("i4", 1), ("i5", 2)]
    assert catalog.unique_names(x.where("false")).count() == report.with_counts(x.where("false"), "gene_name", "m").count() == 0
    hits = spark.createDataFrame([("a", "c", 1, 5, "+"), ("a", "c", 1, 5, "+")], "name string, chrom string, start long, end long, strand string")
    seqs = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    assert rows(search.with_hit_counts(seqs, hits).select("name", "start", "n_hits")) == [("a", 1, 2), ("a", 1, 2), ("b", None, 0)]


def test_text_functions(spark):
    x = spark.createDataFrame([(0.25, "a b/c~*+"), (97.65, ""), (None, None), (100.0, "x")], "v double, s string")
    got = x.select(writers.fixed(F.col("v"), 1).alias("v"), S.url_quote(F.col("s")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("0.2", "a%20b/c~%2A%2B"), ("97.7", ""), (None, None), ("100.0", "x")]
    assert x.select(S.percent_identity(F.lit(1), F.lit(0)), S.coverage(F.lit(1), F.lit(0), F.lit(3))).first() == (None, None)


def test_longest_wins_with_limit(spark):
    a = spark.createDataFrame([("c", 0, 100, "a1", 0, "+"), ("c", 500, 510, "a2", 0, "+"), ("c", 900, 2900, "a3", 0, "+")], BED)
    b = spark.createDataFrame([("c", 50, 150, "b1", 0, "+"), ("c", 505, 2000, "b2", 0, "+"), ("c", 50, 60, "anti", 0, "-")], BED)
    got = {(r["name"], r["start"], r["source"]) for r in intervals.longest_wins(a, b).collect()}
    assert got == {("a1|b1", 50, "both_b"), ("a2|b2", 505, "both_b"), ("a3|b2", 900, "both_a"), ("anti", 50, "b_only")}
    got = {(r["name"], r["start"], r["source"]) for r in intervals.longest_wins(a, b, 1000).collect()}
    assert got == {("a1|b1", 50, "both_b"), ("a2|b2", 500, "both_a"), ("anti", 50, "b_only")}


def all_hits(pats, chroms):
    out = []
    for c, s in chroms:
        for n, p in pats:
            for q, strand in ((p, "+"), (rc(p), "-")) if p else ():
                out += [(n, c, i, i + len(q), strand) for i in range(len(s)) if s.upper().startswith(q, i)]
    return sorted(out, key=repr)


def test_tiled_placement_matches_scan(spark):
    """Patterns shorter than a seed, longer than a tile's reach, longer than several tiles, and ones that end at a chromosome's end."""
    rng = random.Random(2)
    chroms = [("c1", "".join(rng.choice("ACGT") for _ in range(700)) + "AAAAAAAA"), ("c2", "acgtacgt" * 40)]
    g = chroms[0][1]
    pats = [("p1", g[60:75]), ("p2", rc(g[127:140])), ("p3", "AAAA"), ("p4", "ACGT"), ("none", "T" * 30), ("empty", ""), ("l1", g[100:500]), ("l2", rc(g[3:420])), ("l3", g[300:]), ("l4", "ACGT" * 30), ("l5", g[100:480] + "T" + g[481:500]), ("l5", g[50:84]), ("x", g[640:] + "A"), ("whole", g)]
    seqs = spark.createDataFrame(pats, "name string, seq string")
    genome = search.tile(spark.createDataFrame(chroms, "chrom string, seq string"), 64, 32)
    hits = search.place(seqs, genome)
    assert rows(hits) == rows(search.place(seqs, genome, bound=0)) == all_hits(pats, chroms)
    counted = search.with_hit_counts(seqs, hits)
    assert counted.where("name = 'none'").first()["n_hits"] == 0
    bed = spark.createDataFrame([("c1", 60, 200, "x", 0, "+"), ("c1", 60, 200, "y", 0, "-"), ("c1", 60, 200, "y", 0, "-"), ("c1", 5, 5, "z", 0, "+")], BED)
    got = [(r["name"], r["seq"]) for r in search.extract(bed, genome).collect()]
    assert sorted(got, key=repr) == sorted([("x", g[60:200]), ("y", rc(g[60:200])), ("y", rc(g[60:200])), ("z", None)], key=repr)


def test_genome_is_tiled_over_file_splits(spark, tmp_path):
    """Chromosomes over many splits, several in one, empty ones, blank lines, text before the first header: the same tiles as from whole sequences."""
    rng = random.Random(41)
    chroms = [("chrA", "".join(rng.choice("ACGTacgtN") for _ in range(9000))), ("chrB", ""), ("chrC", "ACG"), ("chrD", "".join(rng.choice("ACGT") for _ in range(64 * 7))), ("chrE", "".join(rng.choice("ACGT") for _ in range(5000)))]
    (tmp_path / "g").mkdir()
    for k, part in enumerate((chroms[:3], chroms[3:])):
        text = "; stray\n" * k + "".join(f">{n} about {n}\n" + "".join(s[i : i + 50] + "\n" for i in range(0, len(s), 50)) + "\n" for n, s in part)
        (tmp_path / "g" / f"{k}.fa").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("700", "3000", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10")
            for stride, reach in ((64, 40), (64, 200), (500, 7)):
                genome = readers.genome_tiles(spark, str(tmp_path / "g"), stride, reach)
                want = sorted((n, i, s.upper()[i : i + stride + reach]) for n, s in chroms for i in range(0, len(s), stride))
                assert rows(genome.tiles.select("chrom", "tile_start", "seq")) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_queries_place_whole_items(spark, tmp_path):
    from strandframe.queries import QUERIES
    from strandframe.queries_locus import c2_locate_in_genes

    rng = random.Random(17)
    genome = ["".join(rng.choice("ACGT") for _ in range(4500)) for _ in range(10)]
    found = [(1, genome[1][2000:2110]), (2, genome[2][:12] + "ACGTACGTTTGACC"), (3, rc(genome[3][4010:4085])), (4, genome[4][7:15]), (5, "A"), (6, "xyz"), (8, genome[3][50:60]), (9, genome[5][100:4400])]
    spark.createDataFrame(list(enumerate(genome)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(found, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    items = [(str(i), x) for i, x in found if x != "xyz"]
    chroms = [(str(c), g) for c, g in enumerate(genome)]
    hits = [(n, c, a, s) for n, c, a, _, s in all_hits(items, chroms)]
    assert rows(QUERIES["c3_place_in_genome"](spark, str(tmp_path))) == sorted(hits, key=repr)
    both = [((n, f"AC{k}"), x + "ACA" * k) for n, x in items for k in (0, 1)]
    want = [(*n, c, int(c) * 1000 + a, int(c) * 1000 + b, s) for n, c, a, b, s in all_hits(both, chroms) if int(n[0]) % 5 == int(c) % 5]
    got = c2_locate_in_genes(spark, str(tmp_path))
    assert rows(got.where("chrom is not null").select("name", "accession", "chrom", "start", "end", "strand")) == sorted(want, key=repr)
    assert {(r["name"], r["accession"]) for r in got.collect()} == {n for n, _ in both}


def test_records_are_told_apart(spark):
    """Two records of one name, one of them without a hit; repeated records and repeated gene rows; names without a gene."""
    t = lambda r, s: spark.createDataFrame(r, s)
    seqs = t([("a", "x1", "ACGTT"), ("a", "x2", "CCCCCC"), ("a", None, "ACGTT"), ("b", "x3", "ACGTT"), ("c", "x4", "GGTT"), ("d", "x5", "ACGTT"), ("a", "x1", "ACGTT")], "name string, accession string, seq string")
    genes = t([("a", "G", "gencode_direct"), ("a", "G", "gencode_direct"), ("b", "NA", "none"), ("c", "G", "gencode_direct")], "name string, gene string, source string")
    spans = t([("G", "c", 100, 200, "ttACGTTacgttt"), ("NA2", "c", 0, 9, "ACGTT")], "gene string, chrom string, start long, end long, seq string")
    got = search.locate_in_genes(seqs, genes, spans).select("name", "accession", "start", "strand", "n_hits", "status")
    two = [("a", acc, s, "+", 2, "multi_in_gene") for acc in ("x1", None) for s in (102, 107)]
    want = [*two, ("a", "x2", None, None, 0, "not_found_in_gene"), ("b", "x3", None, None, 0, "no_gene"), ("c", "x4", None, None, 0, "not_found_in_gene"), ("d", "x5", None, None, 0, "no_gene")]
    assert rows(got) == sorted(want, key=repr)


def test_missing_ids_follow_the_tables(spark, tmp_path):
    from strandframe.queries import QUERIES
    from strandframe.queries_locus import c21_accession_check, c22_table_check

    ids, parts, labelled = [5, *range(700, 1300), 3100], [2, 3, 3, 2700], [7, 1250, 2999, None]
    spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, "n") for i in parts], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(i,) for i in labelled], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    assert [r[0] for r in rows(QUERIES["u7_missing_numbers"](spark, str(tmp_path)).orderBy("number"))] == sorted(set(range(5, 3101)) - set(labelled), key=lambda i: repr((i,)))
    assert c21_accession_check(spark, str(tmp_path)).first()["missing"] == 3096 - len(ids)
    got = c22_table_check(spark, str(tmp_path)).first()
    assert (got["missing"], got["repeated"]) == (2700 - 3, 1)


def test_extraction_reaches_the_end(spark, tmp_path):
    from strandframe.queries import QUERIES

    rng = random.Random(19)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (4007, 4008, 9000, 20001, 8, 7, 3)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [(str(i), x[7:] if i % 2 == 0 else rc(x[7:])) for i, x in enumerate(texts) if len(x) > 7]
    assert rows(QUERIES["c4_extract"](spark, str(tmp_path))) == want


def scalar_alignment(a, b, gap_open=10.0, gap_extend=0.5):
    """Cell by cell with a traceback: a match or mismatch before a gap in b, that before a gap in a; a gap opened before one extended."""
    low = float("-inf")
    n, m = len(a), len(b)
    h, e, f = ([[0.0 if k == 0 else low] * (m + 1) for _ in range(n + 1)] for k in range(3))
    best = (0.0, 0, 0)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j] = max(h[i][j - 1] - gap_open, e[i][j - 1] - gap_extend)
            f[i][j] = max(h[i - 1][j] - gap_open, f[i - 1][j] - gap_extend)
            h[i][j] = max(0.0, h[i - 1][j - 1] + (5.0 if a[i - 1] == b[j - 1] else -4.0), e[i][j], f[i][j])
            if h[i][j] > best[0]:
                best = (h[i][j], i, j)
    score, i, j = best
    same = columns = 0
    state = "h"
    while i and j and (state != "h" or h[i][j] > 0):
        if state == "h":
            s = 5.0 if a[i - 1] == b[j - 1] else -4.0
            if h[i][j] == h[i - 1][j - 1] + s:
                same, columns, i, j = same + (s > 0), columns + 1, i - 1, j - 1
            else:
                state = "f" if h[i][j] == f[i][j] else "e"
        elif state == "f":
            state, columns, i = "h" if f[i][j] == h[i - 1][j] - gap_open else "f", columns + 1, i - 1
        else:
            state, columns, j = "h" if e[i][j] == h[i][j - 1] - gap_open else "e", columns + 1, j - 1
    return same, columns, score


def some_pairs(rng, n):
    out = []
    for _ in range(n):
        a = "".join(rng.choice("ACGT"[: rng.randrange(2, 5)]) for _ in range(rng.randrange(0, 50)))
        b = a if rng.random() < 0.6 else "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 50)))
        b = "".join(rng.choice("ACGT") if rng.random() < 0.1 else c + rng.choice(["", "", "", "GG"]) for c in b if rng.random() > 0.1)
        out.append((a, b))
    return out


@pytest.mark.parametrize("gaps", [(10.0, 0.5), (3.0, 1.0), (2.0, 0.25)])
def test_alignment_against_cell_by_cell(monkeypatch, gaps):
    pairs = some_pairs(random.Random(29), 250)
    want = [scalar_alignment(a, b, *gaps) for a, b in pairs]
    for cells in (align.CELLS, 200):
        monkeypatch.setattr(align, "CELLS", cells)
        assert list(zip(*(x.tolist() for x in align.align(*map(list, zip(*pairs)), *gaps)))) == want


def test_best_alignment_is_sought_among_all(spark, monkeypatch):
    rng = random.Random(23)
    b = "".join(rng.choice("ACGT") for _ in range(120))
    broken = "".join({"A": "C", "C": "A", "G": "T", "T": "G"}[c] if i % 16 == 15 else c for i, c in enumerate(b))  # 94 %, no common 20-mer
    worse = b[:40] + "".join(c if i % 4 else rng.choice("ACGT".replace(c, "")) for i, c in enumerate(b[40:]))
    other = "".join(rng.choice("ACGT") for _ in range(120))
    a_rows = [("broken", broken, 1), ("worse", worse, 2), ("again", broken, 0), ("late", broken, 5), *((f"r{i}", x, 9 + i) for i, (x, _) in enumerate(some_pairs(rng, 30)))]
    b_rows = [("b", b, 1), ("other", other, 2), ("part", broken[20:100], 3)]
    for block in (compare.BLOCK, 3):
        monkeypatch.setattr(compare, "BLOCK", block)
        got = {r["b_name"]: r for r in compare.align_best(spark.createDataFrame(a_rows, SEQ), spark.createDataFrame(b_rows, SEQ)).collect()}
        assert set(got) == {"b", "part"}
        for name, y, _ in b_rows[::2]:
            best = {}
            for a_name, x, order in a_rows:
                same, columns, _ = scalar_alignment(x, y)
                if columns and columns / min(len(x), len(y)) >= 0.8:
                    best[a_name] = (-100.0 * same / columns, -columns, order)
            first = min(best, key=best.get)
            assert (got[name]["a_name"], got[name]["identity_pct"], got[name]["columns"]) == (first, -best[first][0], -best[first][1])


def test_window_hashes():
    s = "ACGTACGTTACGTAACGT"
    for k in (1, 2, 3, 5, 7, 8, 12, 18, 19):
        h = kmers.window_hashes(kmers.codes_of(s), k)
        assert len(h) == max(0, len(s) - k + 1)
        assert all((h[i] == h[j]) == (s[i : i + k] == s[j : j + k]) for i in range(len(h)) for j in range(len(h)))
        assert kmers.block_hashes(kmers.codes_of(s), k).tolist() == (h if len(h) else kmers.window_hashes(kmers.codes_of(s), len(s)))[::k].tolist()
    assert len(kmers.block_hashes(kmers.codes_of(""), 5)) == 0


def test_containment_of_crowded_kmers(spark):
    """Many sequences that start alike, runs of one letter, copies, and texts shorter than a k-mer: the same pairs as all against all."""
    rng = random.Random(37)
    stock = "the same old words "
    outer = [stock + "".join(rng.choice("abc") for _ in range(30)) for _ in range(40)] + ["a" * 60, "", "ab"]
    inner = [o[: rng.randrange(20, 45)] for o in outer[:20]] + [o[5:40] for o in outer[20:30]] + ["a" * 25, "a" * 70, "ab", "b", stock, outer[3], outer[3], "nothing like it at all here"]
    a = spark.createDataFrame([(f"a{i}", s, i) for i, s in enumerate(outer)], SEQ)
    b = spark.createDataFrame([(f"b{i}", s, i) for i, s in enumerate(inner)], SEQ)
    want = [(f"a{i}", f"b{j}", "b_in_a" if y in x else "a_in_b") for i, x in enumerate(outer) for j, y in enumerate(inner) if x and y and (y in x or x in y)]
    for k in (5, 20):
        assert rows(compare.containment(a, b, k).select("a_name", "b_name", "relation")) == sorted(want, key=repr)
    assert compare.containment(a, b.where("false")).count() == compare.containment(a.where("false"), b).count() == 0


def test_containment_kmers_and_report(spark):
    a = spark.createDataFrame([("a1", "ACGTACGTTTGACC", 0), ("a2", "GGGG", 1), ("a3", "TTTT", 2)], SEQ)
    b = spark.createDataFrame([("b1", "TACGTTTG", 0), ("b2", "CCGGGGTT", 1), ("b3", "AAAA", 2), ("b4", "GGGG", 3)], SEQ)
    got = {(r["a_name"], r["b_name"], r["relation"]) for r in compare.overlap_report(a, b, k=5, min_len=4).collect()}
    assert got == {("a1", "b1", "b_in_a"), ("a2", "b2", "a_in_b"), ("a3", "b3", "revcomp"), ("a2", "b4", "exact")}
    assert {r[0] for r in compare.sharing_kmer(a, b, 5).select("name").collect()} == {"b1"}
    first = compare.first_containing(b, a, 5)
    assert {(r["sno_name"], r["union_name"]) for r in first.collect()} == {("b1", "a1"), ("b2", "a2"), ("b4", "a2")}


def test_alignment_scores_do_not_wrap(monkeypatch):
    want = scalar_alignment("ACGGTTA" * 5, "ACGTTAA" * 5)
    for small in (align.SMALL, 1):  # 64 bits give the same
        monkeypatch.setattr(align, "SMALL", small)
        assert tuple(x[0] for x in align.align(["ACGGTTA" * 5], ["ACGTTAA" * 5])) == want
    monkeypatch.undo()
    monkeypatch.setattr(align, "UNIT", 200_000)
    same, columns, score = align.align(["ACGT" * 600], ["ACGT" * 600])
    assert (same[0], columns[0], score[0]) == (2400, 2400, 12_000.0)


def mutated(rng, text, share):
    out = []
    for c in text:
        x = rng.random()
        out.append("" if x < share / 4 else c + rng.choice("ACGT") if x < share / 2 else rng.choice("ACGT") if x < share else c)
    return "".join(out)


def test_suffixes_in_order():
    rng = random.Random(3)
    for text in ("", "a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abab" * 50, "".join(rng.choice("acgt") for _ in range(3000)), "".join(rng.choice("ab") for _ in range(500)) * 3):
        codes = np.array([ord(c) - 96 for c in text], np.uint8)
        assert fm_index.suffix_order(codes, 27).tolist() == sorted(range(len(text)), key=lambda i: text[i:]) if text else True


@pytest.mark.parametrize("bound", [100_000, 7])
def test_index_places_as_a_scan_does(spark, tmp_path, monkeypatch, bound):
    """Short, long and very frequent sequences, at borders of tiles and pieces, on many small chromosomes and on a long one."""
    monkeypatch.setattr(fm_index, "PIECE", 128)
    monkeypatch.setattr(fm_index, "PLACES", 50)
    rng = random.Random(bound)
    long_ = "".join(rng.choice("ACGT") for _ in range(700)) + "A" * 300 + "N" * 40 + "".join(rng.choice("ACGT") for _ in range(90))
    chroms = [("long", long_), *((f"c{i}", "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 60)))) for i in range(30)), ("none", "")]
    genome = search.tile(spark.createDataFrame(chroms, "chrom string, seq string"), 32, 11)
    seqs = [(f"s{i}", (long_ * 2)[(a := rng.randrange(1000)) : a + rng.randrange(1, 60)], i) for i in range(40)]
    seqs += [("whole", long_, 1), ("a", "A", 2), ("run", "A" * 30, 3), ("rc", rc(long_[100:190]), 4), ("none", "", 5), ("null", None, 6), ("off", long_[:50] + "C" + long_[51:80], 7), ("odd", "AXA", 8), ("s1", "ACGT", 9), ("twice", long_[5:70], 1), ("twice", long_[5:70], 1)]
    df = spark.createDataFrame(seqs, SEQ)
    want = []
    for name, seq, _ in seqs:
        for pattern, strand in ((seq, "+"), (rc(seq), "-")) if seq else ():
            for c, text in chroms:
                want += [(name, c, i, i + len(pattern), strand) for i in range(len(text) - len(pattern) + 1) if text.startswith(pattern, i)]
    path = f"file://{tmp_path}/index"
    built = fm_index.build_index(genome, path)
    assert rows(fm_index.place_indexed(df, built, bound)) == sorted(want, key=repr) == rows(search.place(df, genome))
    again = fm_index.read_index(spark, path)
    plan = fm_index.place_indexed(df, again, bound)
    assert again.reach == 11 and rows(plan) == sorted(want, key=repr)
    assert all("/index/" in f or "/patterns-" in f for f in plan.inputFiles())
    nothing = fm_index.build_index(search.tile(spark.createDataFrame([], "chrom string, seq string"), 32), f"file://{tmp_path}/nothing")
    assert fm_index.place_indexed(df, nothing, bound).count() == 0 == fm_index.place_indexed(df.limit(0), built, bound).count()
    with pytest.raises(Exception, match="different letters"):
        fm_index.build_index(search.tile(spark.createDataFrame([("x", "".join(map(chr, range(5000, 5400))))], "chrom string, seq string"), 128, 300), f"file://{tmp_path}/odd")


def test_index_seeks_no_short_rests(spark, tmp_path, monkeypatch):
    """A long sequence's parts are all of reach + 1 letters: the one letter left over of 13 would be found everywhere."""
    kept = {}
    monkeypatch.setattr(fm_index, "stored", lambda df, name, real=fm_index.stored: kept.setdefault(name, real(df, name)))
    chrom = "ACGTTGCATTAGC" + "C" * 400
    genome = search.tile(spark.createDataFrame([("x", chrom)], "chrom string, seq string"), 32, 11)
    index = fm_index.build_index(genome, f"file://{tmp_path}/index")
    seqs = spark.createDataFrame([("a", chrom[:13], 0), ("b", chrom[2:40], 1), ("c", "TTA", 2)], SEQ)
    assert rows(fm_index.place_indexed(seqs, index)) == [("a", "x", 0, 13, "+"), ("b", "x", 2, 40, "+"), ("c", "x", 8, 11, "+")]
    assert rows(kept["patterns"].select("name", "part", F.length("pattern")).where("strand = '+'")) == [("a", 0, 12), ("a", 1, 12), ("b", 0, 12), ("b", 12, 12), ("b", 24, 12), ("b", 26, 12), ("c", 0, 3)]


@pytest.mark.parametrize("block", [256, 5])
def test_pruned_alignment_loses_nothing(spark, monkeypatch, block):
    """Rows of all pairs, where identities tie, texts are much longer than others, and many come close."""
    monkeypatch.setattr(compare, "BLOCK", block)
    rng = random.Random(block)
    base = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(30, 90))) for _ in range(6)]
    a = [(f"a{i}", mutated(rng, rng.choice(base), rng.choice([0, 0.05, 0.15, 0.3])), i) for i in range(22)] + [("twin", base[0], 90), ("twin2", base[0], 91), ("short", base[1][:9], 92)]
    b = [(f"b{i}", "".join(rng.choice("ACGT") for _ in range(rng.randrange(40))) + mutated(rng, rng.choice(base), rng.choice([0, 0.05, 0.15, 0.3])) + "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 5, 150]))), i) for i in range(25)] + [("exact", base[0], 90)]
    got = {r["b_name"]: r for r in compare.align_best(spark.createDataFrame(a, SEQ), spark.createDataFrame(b, SEQ), k=8).collect()}
    for name, y, _ in b:
        best = None
        if any(y[i : i + 8] in x for _, x, _ in a for i in range(len(y) - 7)):
            for n, x, o in a:
                same, columns, _ = scalar_alignment(x, y)
                if columns and columns / min(len(x), len(y)) >= 0.8:
                    best = min(filter(None, [best, (-100.0 * same / columns, -columns, o, n)]))
        assert (best is None) == (name not in got)
        if best:
            assert (-got[name]["identity_pct"], -got[name]["columns"], got[name]["a_name"]) == (best[0], best[1], best[3])


def test_ways_of_32_and_64_bits_are_the_same(monkeypatch):
    a, b = map(list, zip(*some_pairs(random.Random(37), 60)))
    want = [x.tolist() for x in align.align(a, b)]
    monkeypatch.setattr(align, "NEAR", 0)
    assert [x.tolist() for x in align.align(a, b)] == want


def test_bounds_tell_scrambled_sequences():
    """Enough common q-grams within a sequence's length, but on diagonals that no alignment of nine in ten takes together."""
    rng = random.Random(31)
    parts = ["".join(rng.choice("ACGT") for _ in range(20)) for _ in range(4)]
    whole, mixed = "".join(parts), "".join(parts[i] for i in (2, 0, 3, 1))
    grams = bounds.Grams([whole, mixed], 0.8)
    for lead in ("", "ACGT" * 200):
        y = lead + whole
        assert grams.can_reach(y, grams.places(y), 9, 10).tolist() == [True, False]
        assert grams.can_reach(y, grams.places(y), 9, 10, np.array([False, True])).tolist() == [False] * 2
        assert grams.likeliest_first(y, grams.places(y)).tolist()[0] == 0


def test_bounds_let_every_alignment_through():
    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(70))
    texts = [mutated(rng, base[: rng.randrange(20, 70)], rng.choice([0, 0.1, 0.2, 0.3])) for _ in range(40)]
    grams, cut = bounds.Grams(texts, 0.8), 0
    for _ in range(30):
        y = mutated(rng, base, rng.choice([0, 0.1, 0.2])) + "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 300])))
        places = grams.places(y)
        found = [scalar_alignment(x, y) for x in texts]
        for same, columns in ((1, 1), (9, 10), (19, 20), (7, 8), (2, 3), (1, 2)):
            may = grams.can_reach(y, places, same, columns)
            cut += (~may).sum()
            for x, (i, c, _), ok in zip(texts, found, may):
                assert ok or c / min(len(x), len(y)) < 0.8 or i * columns < same * c
    assert cut > 2000


def test_report_with_alignment(spark):
    """Aligned pairs come after the others, and none that is equal or contained comes again; reverse complements may."""
    rng = random.Random(43)
    x = "".join(rng.choice("ACGT") for _ in range(80))
    near = x[:30] + {"A": "C", "C": "A", "G": "T", "T": "G"}[x[30]] + x[31:70]
    a = spark.createDataFrame([("a1", x, 0), ("a2", "".join(rng.choice("ACGT") for _ in range(80)), 1)], SEQ)
    b = spark.createDataFrame([("same", x, 0), ("part", x[10:70], 1), ("near", near, 2), ("far", "".join(rng.choice("ACGT") for _ in range(80)), 3)], SEQ)
    got = compare.ordered_report(compare.overlap_report(a, b, align=True, k=12)).collect()
    assert [(r["a_name"], r["b_name"], r["relation"], r["overlap_len"]) for r in got] == [("a1", "same", "exact", 80), ("a1", "part", "b_in_a", 60), ("a1", "near", "align", 70)]
    assert got[2]["identity_pct"] == 100 * 69 / 70 and got[2]["coverage"] == 1.0
    bands = {r["band"]: r["n"] for r in report.identity_bands(spark.createDataFrame([(r["identity_pct"],) for r in got], "identity_pct double")).collect()}
    assert bands == {100: 2, 95: 1}


def test_winner_rules_collapse_and_correction(spark):
    uni = "GGGGGGGGGG"
    sno = spark.createDataFrame([("same", uni, 0), ("off", "A" + uni + "T", 1), ("long", "AAAA" + uni + "CCC", 2), ("canon", "TT" + uni[:4] + uni + "ACATTT", 3), ("alone", "CTCTCTCTCTCTCT", 4)], SEQ)
    merged, rep = catalog.collapse(sno, spark.createDataFrame([("u", uni, 0)], SEQ), k=5)
    assert {(r["snodb_name"], r["rule"], r["kept"]) for r in rep.collect()} == {("same", "identical", "union"), ("off", "5prime-offset", "union"), ("long", "longer-5prime-hairpin", "snodb"), ("canon", "snodb-ACA-canonical", "snodb")}
    assert {(r["name"], r["seq"]) for r in merged.collect()} == {("alone", "CTCTCTCTCTCTCT"), ("u", "TT" + uni[:4] + uni + "ACATTT")}
    bed = spark.createDataFrame([("c", 10, 20, "u|x", 0, "+"), ("c", 10, 20, "v", 0, "-")], BED)
    new = spark.createDataFrame([("u_x.id3001", "A" * 13), ("v", "A" * 12)], "name string, seq string")
    assert rows(catalog.corrected_intervals(bed, new).select("start", "end")) == [(10, 22), (7, 20)]
    odd = spark.createDataFrame([("c", 10, 20, "w", 0, "."), ("c", 10, 20, "w.id7", 0, "+"), ("c", 10, 20, "w", 0, "-")], BED)
    twice = spark.createDataFrame([("w.id1", "A" * 15, 1), ("w.id2", "A" * 11, 2)], SEQ.replace("ord long", "ord int"))
    assert rows(catalog.corrected_intervals(odd, twice).select("start", "end", "strand")) == sorted([(9, 20, "."), (10, 20, "+"), (10, 21, "-")], key=repr)


def test_symbol_cascade(spark):
    lines = spark.createDataFrame([("\fAluACA1, AAA, x",), ("AluACA2, OLD, x",), ("AluACA3, GONE, x",), ("ALuACA4, no apparent host gene",), ("AluACA5, ZZZ, x",), ("AluACA6, BAD, x",), ("AluACA7, Q, x",), ("AluACA8, no apparent host gene",), ("AluACA9, no apparent host gene",), ("AluACA10, EMPTY, x",), ("other",)], "value string")
    t = lambda r, s: spark.createDataFrame(r, s)
    got = resolve.resolve_symbols(lines, t([("AAA",), ("NEW",), ("HAND",)], "gene_name string"), t([("OLD", "NEW"), ("GONE", "ELSE"), ("EMPTY", "")], "old string, current string"), t([("AluACA6", "AAA"), ("AluACA8", "AAA")], "name string, symbol string"), t([("AluACA7", "HAND"), ("AluACA9", "HAND")], "name string, symbol string"))
    assert {tuple(r) for r in got.collect()} == {("AluACA1", "AAA", "gencode_direct"), ("AluACA2", "NEW", "ncbi_alias:OLD"), ("AluACA3", "ELSE", "ncbi_notin_gencode:GONE"), ("AluACA4", "NA", "none"), ("AluACA5", "ZZZ", "UNRESOLVED"), ("AluACA6", "AAA", "gencode_direct"), ("AluACA7", "HAND", "manual_desc"), ("AluACA8", "NA", "none"), ("AluACA9", "HAND", "manual_desc"), ("AluACA10", "EMPTY", "UNRESOLVED")}


@pytest.mark.parametrize("indexed", [False, True])
def test_whole_locus_plan(spark, tmp_path, monkeypatch, indexed):
    monkeypatch.setattr(fm_index, "PIECE", 256)
    rng = random.Random(5)
    g = "".join(rng.choice("ACGT") for _ in range(900))
    t = lambda r, s: spark.createDataFrame(r, s)
    # the last record of a name is sought in the genome, so two places of two records aren't two hits of one
    seqs = t([("AluACA1", "X1.1", g[120:150], 0), ("AluACA2", "X2.1", rc(g[700:730]), 1), ("AluACA3", "X3.1", "ACGT" * 9, 2), ("AluACA4", "X4.1", g[400:430], 3), ("AluACA4", "X5.1", g[500:530], 4)], "name string, accession string, seq string, ord long")
    lines = t([("AluACA1, AAA, x",), ("AluACA2, no apparent host gene",), ("AluACA3, ZZZ, x",), ("AluACA4, no apparent host gene",)], "value string")
    (tmp_path / "g.fa").write_text(">chr1\n" + "\n".join(g[i : i + 50] for i in range(0, 900, 50)) + "\n")
    genome = readers.genome_tiles(spark, f"file://{tmp_path}/g.fa", 128, 31)
    tiers = [("t1", "chr1", 711, 720, "-", "gA", "HACA", g[:9]), ("t2", "chr1", 801, 830, "+", "gB", "CD", g[800:830]), ("t3", "chr1", 851, 870, "-", "gB", "CD", "ACGTACGT"), ("t4", "chr1", 1, 9, "+", "x", "AluACA", "A"), ("t5", None, None, None, None, "y", "CD", "A"), ("t6", "chr1", 1, 9, "-", "", "CD", rc(g[:9])), ("t7", "chr1", 31, 39, "-", "z", "CD", "")]
    i = locus.Inputs(
        seqs, lines, t([("chr1", 100, 300, "AAA", "p", "+")], "chrom string, start long, end long, gene_name string, gene_type string, strand string"), genome, t([("chr1", 140, 160, "N1", 20, "+")], BED), t([], "old string, current string"), t([], "name string, symbol string"), t([], "name string, symbol string"), t([], "name string, chrom string, start long, label string"),
        headers=t([("AluACA1", "Y1.1", 0), ("AluACA4", "Y4.1", 1)], "name string, accession string, ord long"), index=fm_index.build_index(genome, f"file://{tmp_path}/index") if indexed else None,
        repeats=t([("chr1", 110, 130, "AluY", 0, "+"), ("chr1", 125, 160, "L1", 0, "-"), ("chr1", 490, 600, "MIR", 0, "+")], BED), tiers=t(tiers, "id string, chrom string, start long, end long, strand string, gene_name string, box_type string, seq string"),
    )
    spark.conf.set("spark.strandframe.fasta_base", "5000")
    out = locus.deliverables(i)
    spark.conf.unset("spark.strandframe.fasta_base")
    assert {(r["name"], r["accession"], r["status"]) for r in out["located"].collect()} == {("AluACA1", "X1.1", "unique"), ("AluACA2", "X2.1", "no_gene"), ("AluACA3", "X3.1", "no_gene"), ("AluACA4", "X4.1", "no_gene"), ("AluACA4", "X5.1", "no_gene")}
    assert {(r["name"], r["start"], r["strand"], r["located_by"]) for r in out["placed"].collect()} == {("AluACA1", 120, "+", "gene_anchored"), ("AluACA2", 700, "-", "genome_unique"), ("AluACA4", 500, "+", "genome_unique")}
    assert [(r["id"], r["accession"], r["match_id"]) for r in out["final"].collect()] == [("AluACA1", "Y1.1", "N1"), ("AluACA2", "-", "-"), ("AluACA4", "Y4.1", "-")]
    assert [r["name"] for r in out["unresolved"].collect()] == ["AluACA3"]
    assert {(r["name"], r["source"]) for r in out["union"].collect()} == {("AluACA1|N1", "both_a"), ("AluACA2", "a_only"), ("AluACA4", "a_only")}
    assert rows(out["union_fasta"].select("name", "seq")) == [("AluACA1_N1.id5001", g[120:150]), ("AluACA2.id5003", rc(g[700:730])), ("AluACA4.id5002", g[500:530])]
    assert rows(out["annotated"].select("name", "repeat_family")) == [("AluACA1|N1", "L1|AluY"), ("AluACA2", "none"), ("AluACA4", "MIR")]
    assert out["repeat_strands"].first()[:] == (3, 2) and report.top_repeats(out["annotated"]).first()[:] == ("L1", 1)
    assert rows(out["replaced"].select("name", "origin")) == [("AluACA1|N1", "union"), ("AluACA2", "union"), ("AluACA4", "union"), ("gB_t2", "catalogue"), ("gB_t3", "catalogue"), ("t6", "catalogue"), ("z", "catalogue")]
    assert rows(out["replaced_fasta"].where("start = 850").select("header", "seq")) == [("gB_t3 chr1:850-870(-)", rc(g[850:870]))]
    assert out["dropped"].first()[:] == (1, 1, 5) and out["verified"].first()[:] == (3, 2, 1) and rows(out["differing"]) == [("gB_t3",)]
    # no deliverable reads the genome's text again, nor what others have computed
    assert all("g.fa" not in f for df in out.values() for f in df.inputFiles())


def test_top_repeats_are_dominant(spark):
    loci = spark.createDataFrame([("AluY|L1",), ("AluY|MIR",), ("none",), ("L1",)], "repeat_family string")
    assert [tuple(r) for r in report.top_repeats(loci).collect()] == [("AluY", 2), ("L1", 1)]


def test_whole_comparison_plan(spark):
    rng = random.Random(6)
    g = "".join(rng.choice("ACGT") for _ in range(1200))
    t = lambda r, s: spark.createDataFrame(r, s)
    sno = t([("s1", g[100:180], 0), ("s2", g[297:380], 1), ("s3", "".join(rng.choice("ACGT") for _ in range(60)), 2), ("s4", rc(g[600:660]), 3)], SEQ)
    union = t([("u1.id3001", g[100:180], 0), ("u2_v.id3002", g[300:380], 1), ("u3.id3003", g[600:660], 2)], SEQ)
    bed = t([("chr1", 100, 180, "u1", 0, "+"), ("chr1", 300, 380, "u2|v", 0, "+"), ("chr1", 600, 660, "u3", 0, "+")], BED)
    cat = t([("k1", "chr1", 101, 180, "+", "g1", "HACA"), ("k2", "chr1", 101, 180, "-", "g1", "HACA"), ("k3", "chr1", 901, 950, "+", "", "CD"), ("k4", "chr1", 1, 9, "+", "x", "AluACA"), ("k5", None, None, None, None, "y", "CD")], "id string, chrom string, start long, end long, strand string, gene_name string, box_type string")
    out = comparison.deliverables(comparison.Inputs(sno, union, bed, cat, search.tile(t([("chr1", g)], "chrom string, seq string"), 64, 32)))
    assert rows(out["overlaps"].select("a_name", "b_name", "relation")) == [("u1.id3001", "s1", "exact"), ("u2_v.id3002", "s2", "a_in_b"), ("u3.id3003", "s4", "revcomp")]
    assert out["relation_sizes"].first()[:] == (1, 1, 1, 2)
    assert rows(out["decisions"].select("union_name", "snodb_name", "kept")) == [("u1.id3001", "s1", "union"), ("u2_v.id3002", "s2", "snodb")]
    assert rows(out["merged"].select("name")) == [("s3",), ("s4",), ("u1.id3001",), ("u2_v.id3002",), ("u3.id3003",)]
    assert rows(out["corrected_bed"].select("name", "start", "end")) == [("u1", 100, 180), ("u2|v", 297, 380), ("u3", 600, 660)]
    assert rows(out["replaced"].select("name", "origin")) == [("g1_k2", "catalogue"), ("k3", "catalogue"), ("u1", "union"), ("u2|v", "union"), ("u3", "union")]
    assert out["dropped"].first()[:] == (1, 1, 3)
    assert rows(out["placements"].select("name", "start", "strand")) == [("s1", 100, "+"), ("s2", 297, "+"), ("s4", 600, "-")]
    assert rows(out["placement_check"]) == [("either", 3, 3), ("same", 2, 2)]


def test_one_file_in_order_from_many_tasks(spark, tmp_path):
    rng = random.Random(9)
    n = 3000
    df = spark.createDataFrame([("c%d" % rng.randrange(3), rng.randrange(10**6), 10**6, f"n{i}", None, "+") for i in range(n)], BED).repartition(7)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    writers.write_bed(df, f"file://{tmp_path}/bed")
    writers.write_tsv(df.select("name", "start"), f"file://{tmp_path}/tsv", ["start", "name"])
    writers.write_fasta(df.withColumn("seq", F.lit("acgt")), f"file://{tmp_path}/fa", "name", ["chrom", "start", "name"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    want = sorted((r["chrom"], r["start"], r["name"]) for r in df.collect())
    one = lambda d: [p for p in (tmp_path / d).iterdir() if not p.name.startswith(".")]
    assert all(len(one(d)) == 1 for d in ("bed", "tsv", "fa")) and not [p for p in tmp_path.iterdir() if ".parts-" in p.name]
    assert one("bed")[0].read_text().splitlines() == [f"{c}\t{s}\t1000000\t{x}\t.\t+" for c, s, x in want]
    assert one("tsv")[0].read_text().splitlines() == ["name\tstart", *(f"{x}\t{s}" for s, x in sorted((s, x) for _, s, x in want))]
    assert one("fa")[0].read_text().split("\n")[:-1:2] == [f">{x}" for _, _, x in want]
    old = one("bed")[0].read_text()
    with pytest.raises(Exception, match="stop"):
        writers.write_bed(df.withColumn("score", F.raise_error(F.lit("stop"))), f"file://{tmp_path}/bed")
    assert one("bed")[0].read_text() == old and not [p for p in tmp_path.iterdir() if ".parts-" in p.name]
    writers.write_tsv(df.limit(0), f"file://{tmp_path}/empty")
    assert one("empty")[0].read_text() == "chrom\tstart\tend\tname\tscore\tstrand\n"


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">X1.1 some AluACA7 text\nacg\ntt\n>X2.2 AluACA8\nGG\n>X1.1 AluACA9\nTT\n")
    assert rows(readers.fasta_ids(spark, str(tmp_path / "x.fa")).select("name", "accession", "seq")) == [("AluACA7", "X1.1", "ACGTT"), ("AluACA8", "X2.2", "GG"), ("AluACA9", "X1.1", "TT")]
    assert rows(readers.fasta_named(spark, str(tmp_path / "x.fa")).select("name", "seq")) == [("X1.1", "TT"), ("X2.2", "GG")]
    (tmp_path / "x2.fa").write_text(">X1.1 a\nacg\nttg\n>X2.2\nGG\n")
    assert rows(readers.genome_tiles(spark, str(tmp_path / "x2.fa"), 4, 2).tiles.select("chrom", "tile_start", "seq"))[:2] == [("X1.1", 0, "ACGTTG"), ("X1.1", 4, "TG")]
    (tmp_path / "x3.fa").write_text(">X1.1 some AluACA7, text\nacg\n>X1.1 AluACA7, again\nTT\n>X9.1 none\nA\n")
    assert rows(readers.fasta_ids(spark, str(tmp_path / "x3.fa")).select("name", "accession", "seq")) == [("AluACA7,", "X1.1", "TT"), ("X9.1", "X9.1", "A")]
    (tmp_path / "g.gtf").write_text('#x\nchr1\ts\tgene\t11\t20\t.\t+\t.\tgene_name "A"; gene_type "p";\nchr1\ts\texon\t11\t12\t.\t+\t.\tgene_name "A"\nGL1\ts\tgene\t1\t2\t.\t+\t.\tx\n')
    assert rows(readers.gtf_genes(spark, str(tmp_path / "g.gtf"))) == [("chr1", 10, 20, "A", "p", "+")]
    bed = spark.createDataFrame([("chr2", 5, 9, "b|c", 0, "+"), ("chr10", 1, 4, "a", 0, "-")], BED)
    writers.write_bed(bed, str(tmp_path / "o.bed"))
    assert [r["name"] for r in readers.bed(spark, str(tmp_path / "o.bed")).collect()] == ["a", "b|c"]
    named = writers.numbered_headers(bed.withColumn("seq", F.lit("acg")))
    assert rows(named.select("name", "seq")) == [("a.id3001", "ACG"), ("b_c.id3002", "ACG")]
    own = writers.numbered_headers(spark.createDataFrame([("c", 1, 2, "n.id7", 0, "+")], BED).withColumn("seq", F.lit("a")))
    assert own.first()["name"] == "n.id7.id3001"
    more = readers.bed(spark, str(tmp_path / "o.bed")).withColumn("family", F.lit("AluY"))
    writers.rewrite(more, str(tmp_path / "o.bed"), lambda df, p: writers.write_bed(df, p, ["chrom", "start", "end", "name", "family"]))
    assert rows(spark.read.text(str(tmp_path / "o.bed"))) == [("chr10\t1\t4\ta\tAluY",), ("chr2\t5\t9\tb|c\tAluY",)]
    writers.write_fasta(named, str(tmp_path / "o.fa"))
    assert readers.fasta_named(spark, str(tmp_path / "o.fa")).count() == 2
    with pytest.raises(FileNotFoundError, match="one.*two"):
        validate(spark, {"one": str(tmp_path / "no1"), "two": str(tmp_path / "no2")})
    assert EngineConfig.resolve({"STRANDFRAME_KMER": "12"}, min_cov=0.5) == EngineConfig(kmer=12, min_cov=0.5)
    spark.conf.set("spark.strandframe.kmer", "11")
    spark.conf.set("spark.strandframe.offset_tol", "3")
    assert EngineConfig.resolve({"STRANDFRAME_KMER": "12"}, spark) == EngineConfig(kmer=12, offset_tol=3)
    assert EngineConfig.resolve({}, spark, kmer=10) == EngineConfig(kmer=10, offset_tol=3)
    spark.conf.unset("spark.strandframe.kmer")
    spark.conf.unset("spark.strandframe.offset_tol")


def test_gene_information_names_symbols_before_synonyms(spark, tmp_path):
    line = lambda tax, n, symbol, synonyms, official: "\t".join([tax, n, symbol, "-", synonyms, "-", "1", "-", '"q', "protein-coding", official, "-"])
    rows_of = [line("9606", "30", "NEW", "OLD|TWICE", "NEW"), line("9606", "4", "OTHER", "TWICE|NEW", "-"), line("9606", "5", "LOC5", "-", "NAMED"), line("9606", "6", "X6", "NAMED", "-"), line("9606", "7", "-", "LOST", "-"), line("10090", "1", "Old", "OLD", "Old")]
    (tmp_path / "info").write_text("#tax_id\tGeneID\n" + "\n".join(rows_of) + "\n")
    got = rows(readers.gene_info(spark, str(tmp_path / "info")))
    assert got == sorted([("NEW", "NEW"), ("OLD", "NEW"), ("TWICE", "OTHER"), ("OTHER", "OTHER"), ("LOC5", "NAMED"), ("NAMED", "NAMED"), ("X6", "X6")], key=repr)
    assert rows(readers.gene_info(spark, str(tmp_path / "info"), "10090")) == [("OLD", "Old"), ("Old", "Old")]


def test_lookups_by_key(spark):
    t = lambda r, s: spark.createDataFrame(r, s)
    x, y = t([(1,), (2,), (2,), (None,)], "k int"), t([(2, "a", 1), (2, "b", 2), (None, "c", 3)], "k int, v string, ord int")
    assert rows(tables.lookup(x, y, "k", {"v": "-"})) == rows(tables.lookup(x, y, "k", {"v": "-"}, "ord")) == sorted([(1, "-"), (2, "b"), (2, "b"), (None, "-")], key=repr)
    assert rows(tables.having_key(x, y, "k")) == [(2,), (2,)]
    assert rows(tables.best_per_key(y, "k", -F.col("ord"))) == sorted([(2, "b", 2), (None, "c", 3)], key=repr)


def test_classes_of_a_sequence_on_most_rows(spark):
    seqs = [(f"h{i:04}", "ACGT" * 300, i) for i in range(900)] + [(f"o{i}", f"A{i % 40}", 1000 + i) for i in range(100)] + [("null", None, 1), ("e1", "", 2), ("e2", "", 3)]
    df = spark.createDataFrame(seqs, SEQ)
    by = {}
    for name, seq, _ in seqs:
        if seq is not None:
            by.setdefault(seq, []).append(name)
    assert rows(classes.equality_classes(df)) == sorted(((min(n), x, len(n), len(s)) for s, n in by.items() if len(n) > 1 for x in n), key=repr)
    assert rows(compare.exact(df, df.where("name in ('h0000', 'e1')")).groupBy("b_name").count()) == [("e1", 2), ("h0000", 900)]
    assert rows(report.alphabet(df)) == sorted(Counter("".join(s for _, s, _ in seqs if s)).items())


def test_reports_and_functions(spark):
    loci = spark.createDataFrame([("s1", "AluY|L1"), ("s1", "none"), ("s2", "L1")], "source string, repeat_family string")
    assert rows(report.repeat_table(loci)) == [("s1", "Alu", 1), ("s1", "none", 1), ("s2", "other", 1)]
    assert rows(report.top_repeats(loci, 1)) == [("AluY", 1)]  # of AluY|L1 only the dominant name counts
    acc = spark.createDataFrame([("PX10.1", "A"), ("PX12.1", "")], "accession string, seq string")
    assert tuple(report.accession_check(acc, 10, 12).first()) == (2, 1, 10, 12, False, 1)
    one = spark.createDataFrame([("AAAA", "AA")], "a string, b string")
    assert one.select(S.find_all(F.col("a"), F.col("b")), S.first_index(F.col("a"), F.col("b")), S.find_all(F.col("a"), F.lit(""))).first()[:] == ([0, 1, 2], 0, None)
    assert one.select(S.kmers(F.col("a"), 3)).first()[0] == ["AAA", "AAA"]


def test_stream_lookup(spark, tmp_path):
    bed = spark.createDataFrame([("c", 0, 10, "a", 0, "+")], BED)
    bed.write.parquet(str(tmp_path / "in"))
    q = lookup.annotate_stream(spark.readStream.schema(bed.schema).parquet(str(tmp_path / "in")), bed).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").count() == 1
