"""Writers; sentinels for nulls and single files belong here and nowhere else."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import fasta_name, locus
from ..operators.intervals import coordinate_order
from .one_file import write_one_file


def fixed(value: Column, digits: int) -> Column:
    """Text with so many decimals, rounded from the exact binary value, which the JVM's formats don't do."""

    @F.pandas_udf("string")
    def text(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if pd.isna(x) else f"{x:.{digits}f}")

    return text(value)


def write_fasta(df: DataFrame, path: str, header: Column | str = "name", order: list | None = None) -> None:
    """One record of two lines for each row, in one file, in the given order or that of df's partitions."""
    h = F.col(header) if isinstance(header, str) else header
    own = df.orderBy(*order) if order else df
    write_one_file(own.select(F.concat(F.lit(">"), h, F.lit("\n"), F.col("seq")).alias("value")), path, lambda d, p: d.write.text(p))


def numbered_headers(df: DataFrame, base: int = 3000, width: int = 1 << 20) -> DataFrame:
    """name as name.idN, N from base + 1 in coordinate order, and seq in upper case.

    Rows are numbered within bins of a chromosome, after the counts of the bins before, so no task holds all rows and a
    task run again gives the same numbers.
    """
    binned = df.withColumn("bin", F.floor(F.col("start") / width))
    sizes = binned.groupBy("chrom", "bin").agg(F.count("*").alias("n"))  # as many rows as the genome has bins
    earlier = Window.orderBy("chrom", "bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n").alias("y")
    x = binned.withColumn("at", F.row_number().over(Window.partitionBy("chrom", "bin").orderBy(*coordinate_order()))).alias("x")
    out = x.join(sizes, F.col("x.chrom").eqNullSafe(F.col("y.chrom")) & F.col("x.bin").eqNullSafe(F.col("y.bin"))).select("x.*", "before")
    return out.withColumn("name", F.concat(fasta_name(F.col("name")), F.lit(".id"), (F.col("before") + F.col("at") + base).cast("string"))).withColumn("seq", F.upper("seq")).drop("bin", "at", "before")


def locus_header() -> Column:
    return F.concat(F.col("name"), F.lit(" "), locus(F.col("chrom"), F.col("start"), F.col("end"), F.col("strand")))


def write_bed(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Coordinate order, tabs, no header, one file; nulls as a dot."""
    own = df.orderBy(*coordinate_order())
    write_one_file(own.select(*columns) if columns else own, path, lambda d, p: d.write.option("sep", "\t").option("nullValue", ".").option("quote", "").csv(p))


def write_tsv(df: DataFrame, path: str, order: list | None = None) -> None:
    """With a header, one file; nulls as -."""
    own = df.orderBy(*order) if order else df
    write_one_file(own, path, lambda d, p: d.write.option("sep", "\t").option("nullValue", "-").option("quote", "").csv(p), "\t".join(df.columns) + "\n")


def write_placements(hits: DataFrame, path: str) -> None:
    """Hits as BED of six columns, score 0, in the order of place, name and strand."""
    write_bed(hits.withColumn("score", F.lit(0)), path, ["chrom", "start", "end", "name", "score", "strand"])


def rewrite(df: DataFrame, path: str, write: Callable[[DataFrame, str], None] | None = None) -> str:
    """Writes what was at path anew, say with a column more, while df may still read it, in the format that `write` has (Parquet if none).

    The new files are written beside the old ones and then take their place; a failure before that leaves the old ones.
    """
    spark = df.sparkSession
    top, beside = path.rstrip("/"), f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    (write or (lambda d, p: d.write.parquet(p)))(df, beside)
    jvm = spark.sparkContext._jvm
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (top, beside))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{beside} could not take the place of {top}")
    spark.catalog.refreshByPath(top)
    return top
