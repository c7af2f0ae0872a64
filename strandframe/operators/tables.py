"""Joins and orders by key that every table has, as the locus and comparison plans use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import id_number


def having_key(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in wanted, each once, repeated rows of df too."""
    return df.join(wanted.select(key), key, "left_semi")


def lookup(df: DataFrame, table: DataFrame, key: str, defaults: dict[str, str], order: str | None = None) -> DataFrame:
    """df with the named columns of a table, as text, or their defaults where the key is absent; of a repeated key the last by order, or the greatest values."""
    cols = [F.col(c).cast("string").alias(c) for c in defaults]
    value = F.struct(*cols)
    per = table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.max_by(value, order) if order else F.max(value)).alias("_found"))
    out = df.join(per, df[key] == F.col("_key"), "left")
    return out.select(*df.columns, *[F.coalesce(F.col(f"_found.{c}"), F.lit(d)).alias(c) for c, d in defaults.items()])


def text_key_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of rows at one place, by the key chrom_start_end: key, a_*, b_*; strands may differ."""
    keyed = lambda df, p: df.select(F.concat_ws("_", "chrom", F.col("start").cast("string"), F.col("end").cast("string")).alias("key"), *[F.col(c).alias(f"{p}{c}") for c in df.columns])
    return keyed(a, "a_").join(keyed(b, "b_"), "key")


def by_id_number(df: DataFrame, name: str = "name") -> DataFrame:
    """Rows in the order of the number in their name, then of the name."""
    return df.orderBy(id_number(F.col(name)), name)


def best_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order of columns, found by partial aggregates instead of a sort of each key's rows."""
    names = [f"_o{i}" for i in range(len(order))]
    row = F.struct(*[o.alias(n) for o, n in zip(order, names)], *[F.col(c) for c in df.columns if c != key])
    return df.groupBy(key).agg(F.min(row).alias("_row")).select(key, *[f"_row.{c}" for c in df.columns if c != key])


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text has the pattern, in upper or lower case."""
    return df.where(F.rlike(column, F.lit(f"(?i){pattern}")))


def pair_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a_name, b_name) that are in either of two sets, once."""
    names = ["a_name", "b_name"]
    return a.select(*names).union(b.select(*names)).distinct()
