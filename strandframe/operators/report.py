"""Integrity reports and summaries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import accession_number, dominant, is_rna, no_host, repeat_class, source_tag
from .classes import digest, digested, one_check
from .intervals import merge, overlap


def group_counts(df: DataFrame, key: str | Column, name: str = "key", ordered: bool = False) -> DataFrame:
    """How many rows each key has; ordered: the commonest first, then by key."""
    out = df.groupBy((F.col(key) if isinstance(key, str) else key).alias(name)).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), name) if ordered else out


def with_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    """df and how many rows have the same key, null one of them.

    Counts come from partial aggregates; a frequent key's rows are split by the adaptive join, as a window's wouldn't be.
    """
    n = df.groupBy(F.col(key).alias("_counted")).agg(F.count("*").alias(name))
    return df.join(n, F.col(key).eqNullSafe(F.col("_counted"))).drop("_counted")


def symbol_sources(id_gene: DataFrame) -> DataFrame:
    return group_counts(id_gene, source_tag(F.col("source")), "source")


def cross_table(df: DataFrame, row: Column, column: Column) -> DataFrame:
    return df.groupBy(row, column).agg(F.count("*").alias("n"))


def repeat_table(loci: DataFrame) -> DataFrame:
    """source by Alu, other, none."""
    return cross_table(loci, F.col("source"), repeat_class(F.col("repeat_family")).alias("class"))


def top_counts(df: DataFrame, key: str, n: int = 12) -> DataFrame:
    """The n commonest keys, ties in order of the key."""
    return group_counts(df, key, "name", ordered=True).limit(n)


def top_repeats(loci: DataFrame, n: int = 12) -> DataFrame:
    """The n commonest dominant repeats: of each locus the name that covers most of it, which stands first."""
    return top_counts(loci.where("repeat_family <> 'none'").select(dominant(F.col("repeat_family")).alias("name")), "name", n)


def conditional_counts(df: DataFrame, all_rows: str, **conditions: Column) -> DataFrame:
    """One row: how many rows there are, and how many meet each condition."""
    return df.agg(F.count("*").alias(all_rows), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def duplicate_sequences(seqs: DataFrame) -> DataFrame:
    """md5, n and names in order of sequences that several records have. equality_classes() gives the names a row each instead of a list."""
    rows = digested(seqs, "name")
    return rows.groupBy("digest").agg(one_check().alias("md5"), F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names")).where("n > 1").drop("digest")


def first_name_per_sequence(seqs: DataFrame) -> DataFrame:
    """md5 and name: the first record's of each sequence."""
    return digested(seqs, "name", "ord").groupBy("digest").agg(one_check().alias("md5"), F.min_by("name", "ord").alias("name")).drop("digest")


def alphabet(seqs: DataFrame) -> DataFrame:
    """char and n: how often each letter stands in all sequences. A task gives a row for each letter, not one for each place."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                codes, times = np.unique(np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32), return_counts=True)
                n.update(dict(zip(codes.tolist(), times.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["char", "n"])

    return seqs.select("seq").mapInArrow(count, "char string, n long").groupBy("char").agg(F.sum("n").alias("n"))


def alphabet_summary(seqs: DataFrame) -> DataFrame:
    odd = F.length(F.regexp_replace("seq", "[ACGT]", "")) > 0
    return seqs.agg(F.count("*").alias("records"), F.count_distinct(digest(F.col("seq"))).alias("distinct_seqs"), F.count_if(odd).alias("non_acgt"), F.count_if(is_rna(F.col("seq"))).alias("rna"))


def identity_bands(report: DataFrame) -> DataFrame:
    """Identity in bands of five points, 100 the last."""
    band = F.least(F.floor(F.col("identity_pct") / 5) * 5, F.lit(100)).cast("int")
    return group_counts(report, band, "band")


def total_span_mb(bed: DataFrame) -> DataFrame:
    return bed.agg((F.sum(F.col("end") - F.col("start")) / 1e6).alias("mb"))


def id_range(df: DataFrame, number: Column) -> DataFrame:
    return df.agg(F.min(number).alias("least"), F.max(number).alias("greatest"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def missing_numbers(df: DataFrame, number: Column, first: int, last: int) -> DataFrame:
    return df.sparkSession.range(first, last + 1).select(F.col("id").alias("number")).join(df.select(number.alias("number")).distinct(), "number", "left_anti")


def disagreements(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_differ over matched rows a_* and b_*; null equals null."""
    sums = pairs.agg(*[F.count_if(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_differ")) for c in columns])).alias("r")).select("r.*")


def relation_sizes(report: DataFrame) -> DataFrame:
    pair = F.struct("a_name", "b_name")
    of = lambda *k: F.count_distinct(F.when(F.col("relation").isin(*k), pair))
    return report.agg(of("exact").alias("exact"), of("revcomp").alias("revcomp"), of("b_in_a", "a_in_b").alias("contained"), of("exact", "b_in_a", "a_in_b").alias("exact_or_contained"))


def csv_profile(lines: DataFrame) -> DataFrame:
    """rows, numbers of fields, distinct ids and distinct places of raw catalogue lines(value); the header isn't a row."""
    f = F.split("value", ",")
    at = lambda i: F.try_element_at(f, F.lit(i))
    rows = lines.where(at(2) != "napRNAID")
    return rows.agg(F.count("*").alias("rows"), F.array_sort(F.collect_set(F.size(f))).alias("field_counts"), F.count_distinct(at(2)).alias("ids"), F.count_distinct(F.concat_ws("_", at(3), at(4), at(5))).alias("places"))


def catalogue_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """measure, n: overlaps on either strand and on the same, identical places, rows of a among them, and what merging leaves of a.

    Identical places overlap, so one join gives the first four.
    """
    same_place = (F.col("a_start") == F.col("b_start")) & (F.col("a_end") == F.col("b_end"))
    met = overlap(a, b, False).agg(
        F.count("*").alias("overlap_either_strand"),
        F.count_if(F.col("a_strand") == F.col("b_strand")).alias("overlap_same_strand"),
        F.count_if(same_place).alias("identical_place"),
        F.count_distinct(F.when(same_place, F.struct("a_name", "a_chrom", "a_start", "a_end"))).alias("a_with_identical_place"),
    )
    out = met.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("n")) for c in met.columns])).alias("r")).select("r.*")
    for name, stranded in (("a_merged_stranded", True), ("a_merged_unstranded", False)):
        out = out.unionByName(merge(a, stranded).agg(F.lit(name).alias("measure"), F.count("*").alias("n")))
    return out


def placement_check(hits: DataFrame, bed: DataFrame) -> DataFrame:
    """Pairs and distinct placements that overlap the catalogue, by strand rule; one join for both rules."""
    same, place = F.col("a_strand") == F.col("b_strand"), F.struct("a_name", "a_chrom", "a_start", "a_end", "a_strand")
    n = overlap(hits, bed, False).agg(F.count_if(same).alias("sp"), F.count_distinct(F.when(same, place)).alias("sd"), F.count("*").alias("ep"), F.count_distinct(place).alias("ed"))
    row = lambda rule, pairs, places: F.struct(F.lit(rule).alias("strand_rule"), F.col(pairs).alias("pairs"), F.col(places).alias("placements"))
    return n.select(F.explode(F.array(row("same", "sp", "sd"), row("either", "ep", "ed"))).alias("r")).select("r.*")


def accession_check(seqs: DataFrame, first: int, last: int) -> DataFrame:
    """records, missing accessions, empty sequences and id range of fetched seqs(accession, seq)."""
    number = accession_number(F.col("accession"))
    gone = missing_numbers(seqs, number, first, last).agg(F.count("*").alias("missing"))
    own = seqs.agg(F.count("*").alias("records"), F.count_if(F.length("seq") == 0).alias("empty"), F.min(number).alias("least"), F.max(number).alias("greatest"), (F.count("*") == last - first + 1).alias("complete"))
    return own.join(F.broadcast(gone), F.lit(True))  # one row each


def table_check(lines: DataFrame, number: Column, expected: int) -> DataFrame:
    """entries, missing and repeated ids, and lines without host."""
    rows = lines.withColumn("number", number)
    own = rows.agg(F.count("*").alias("entries"), F.count_if(no_host(F.col("value"))).alias("no_host"))
    gone = missing_numbers(rows, F.col("number"), 1, expected).agg(F.count("*").alias("missing"))
    more = duplicate_keys(rows, "number").agg(F.count("*").alias("repeated"))
    return own.join(F.broadcast(gone), F.lit(True)).join(F.broadcast(more), F.lit(True))  # one row each


def except_both(spark: SparkSession, a: DataFrame, b: DataFrame) -> DataFrame:
    """side, value: what only one of two multisets has."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
