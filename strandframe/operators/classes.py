"""Equal sequences as classes, told by digests so that no text is shuffled and no list of members gathered.

A digest is the SHA-256 of the bases with their number; a second one of another kind goes along, and a class whose members differ in it
is an error, not a wrong class. Null sequences are in no class. A sequence that most rows have is a hot key of joins alone, which
adaptive execution splits; counts and least names come from partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(seq: Column) -> Column:
    return F.struct(F.unhex(F.sha2(seq, 256)).alias("sha"), F.length(seq).alias("size"))


def digested(seqs: DataFrame, *cols: str | Column) -> DataFrame:
    """The columns named, digest, and check: the second digest."""
    return seqs.where("seq is not null").select(*cols, digest(F.col("seq")).alias("digest"), F.md5("seq").alias("check"))


def one_check() -> Column:
    """The second digest that all members of a class have."""
    clash = F.min("check") != F.max("check")
    return F.when(clash, F.raise_error(F.lit("two sequences have one digest"))).otherwise(F.min("check"))


def equality_classes(seqs: DataFrame, at_least: int = 2) -> DataFrame:
    """representative (the least name), member, n and seq_len, a row for each record of a sequence that so many records have."""
    rows = digested(seqs, "name")
    own = rows.groupBy("digest").agg(F.min("name").alias("representative"), F.count("*").alias("n"), one_check().alias("check")).where(F.col("n") >= at_least)
    return rows.drop("check").join(own, "digest").select("representative", F.col("name").alias("member"), "n", F.col("digest.size").alias("seq_len"))
