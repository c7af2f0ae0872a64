"""Interval joins and merges over (chrom, start, end, name, score, strand), 0-based and half-open.

Overlap joins are equality joins on bins. One side, the home side, has each row in one bin: bins are as wide as the row's
class of length, `width` or that times a power of two, so a row reaches from its own bin into the next one at most. The
other side's rows are listed, for each class there is, in the bins where a home row that they overlap may start. So every
pair meets once, and left, semi and anti joins by overlap are plain joins of Spark's: one pass, no row numbers, and rows
that are equal stay apart. In inner joins the shorter of two rows of very unlike lengths is listed, whichever side it is of.
A chromosome with most of the rows is dealt over its bins, and adaptive execution splits a crowded bin's partition, as
joins read their shuffles directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BED = ["chrom", "start", "end", "name", "score", "strand"]
#: Classes of length apart, at most, for the longer of two rows to be listed in bins of the shorter one's class.
NEAR = 4


def checked(df: DataFrame) -> DataFrame:
    """Intervals with start < end; null or empty ones overlap nothing."""
    return df.where("start < end and chrom is not null")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def _length_class(p: str, width: int) -> Column:
    """The least c so that the row is no longer than width * 2^c."""
    over = F.floor((F.col(f"{p}end") - F.col(f"{p}start") - 1) / width)
    return F.when(over > 0, F.length(F.bin(over))).otherwise(0)


def _wide(width: int, c: Column) -> Column:
    return F.call_function("shiftleft", F.lit(width).cast("long"), c)


def _bins(p: str, classes: Column, width: int, far: bool = False) -> Column:
    """Keys (far, c, bin) of the bins of each of the classes in which a row that this one overlaps may start."""

    def of(c: Column) -> Column:
        w = _wide(width, c)
        bins = F.sequence(F.floor((F.col(f"{p}start") + 1 - w) / w), F.floor((F.col(f"{p}end") - 1) / w))
        return F.transform(bins, lambda n: _key(c, n, far))

    return F.flatten(F.transform(classes, of))


def _key(c: Column, n: Column, far: bool = False) -> Column:
    return F.struct(F.lit(far).alias("far"), c.alias("c"), n.alias("bin"))


def _own_bin(p: str, width: int, far: bool = False) -> Column:
    c = _length_class(p, width)
    return _key(c, F.floor(F.col(f"{p}start") / _wide(width, c)), far)


def _classes(df: DataFrame, p: str, width: int, name: str) -> DataFrame:
    """One row of some thirty numbers at most."""
    return df.where(f"{p}start < {p}end").agg(F.collect_set(_length_class(p, width)).alias(name))


def _meet(home: DataFrame, other: DataFrame, p: str, q: str, stranded: bool, width: int, how: str) -> DataFrame:
    """home joined to other where they overlap; both have prefixed columns."""
    x = home.withColumn("_at", _own_bin(p, width))
    y = other.where(f"{q}start < {q}end and {q}chrom is not null").join(F.broadcast(_classes(home, p, width, "_cs")), F.lit(True))
    y = y.withColumn("_met", F.explode(_bins(q, F.col("_cs"), width))).drop("_cs")
    return _joined(x, y, p, q, stranded, how)


def _joined(x: DataFrame, y: DataFrame, p: str, q: str, stranded: bool, how: str) -> DataFrame:
    """By equal keys _at and _met and by the bases themselves."""
    on = (F.col(f"{p}chrom") == F.col(f"{q}chrom")) & (F.col("_at.c") == F.col("_met.c")) & (F.col("_at.bin") == F.col("_met.bin")) & (F.col("_at.far") == F.col("_met.far"))
    if stranded:
        on = on & (F.col(f"{p}strand") == F.col(f"{q}strand"))
    on = on & (F.col(f"{p}start") < F.col(f"{q}end")) & (F.col(f"{q}start") < F.col(f"{p}end")) & (F.col(f"{p}start") < F.col(f"{p}end"))
    return x.join(y, on, how).drop("_at", "_met")


def _pairs(home: DataFrame, other: DataFrame, p: str, q: str, stranded: bool, width: int) -> DataFrame:
    """_meet's pairs, but of two rows whose classes are more than NEAR apart the shorter is listed, in the bins of the longer one's class.

    So a row is listed in 2^NEAR + 2 bins of a class at most, however long it is: half as many of the next, and two or three of each further one.
    """
    x, y = (df.where(f"{r}start < {r}end and {r}chrom is not null") for df, r in ((home, p), (other, q)))
    x, y = x.join(F.broadcast(_classes(other, q, width, "_cs")), F.lit(True)), y.join(F.broadcast(_classes(home, p, width, "_cs")), F.lit(True))
    above, near = F.filter("_cs", lambda k: k > _length_class(p, width) + NEAR), F.filter("_cs", lambda k: k >= _length_class(q, width) - NEAR)
    below = F.exists("_cs", lambda k: k < _length_class(q, width) - NEAR)
    x = x.withColumn("_at", F.explode(F.concat(F.array(_own_bin(p, width)), _bins(p, above, width, True)))).drop("_cs")
    longer = F.filter(F.array(_own_bin(q, width, True)), lambda k: below)
    y = y.withColumn("_met", F.explode(F.concat(_bins(q, near, width), longer))).drop("_cs")
    return _joined(x, y, p, q, stranded, "inner")


def overlap(a: DataFrame, b: DataFrame, stranded: bool, width: int = 16384, home: str = "a") -> DataFrame:
    """Every overlapping pair, columns a_* and b_*; `home` names the side that each pair is found from, which can't be a stream."""
    x, y = prefixed(a, "a_"), prefixed(b, "b_")
    sides = (x, y, "a_", "b_") if home == "a" else (y, x, "b_", "a_")
    out = _meet(*sides, stranded, width, "inner") if a.isStreaming or b.isStreaming else _pairs(*sides, stranded, width)  # a stream's classes aren't known
    return out.select(*x.columns, *y.columns)


def _matched(a: DataFrame, b: DataFrame, stranded: bool, how: str, width: int) -> DataFrame:
    out = _meet(prefixed(a, "a_"), prefixed(b.select("chrom", "start", "end", *(["strand"] if stranded else [])), "b_"), "a_", "b_", stranded, width, how)
    return out.select(*[F.col(f"a_{c}").alias(c) for c in a.columns])


def overlap_semi(a: DataFrame, b: DataFrame, stranded: bool = False, width: int = 16384) -> DataFrame:
    return _matched(a, b, stranded, "left_semi", width)


def overlap_anti(a: DataFrame, b: DataFrame, stranded: bool = True, width: int = 16384) -> DataFrame:
    return _matched(a, b, stranded, "left_anti", width)


def overlap_left(a: DataFrame, b: DataFrame, stranded: bool = False, width: int = 16384) -> DataFrame:
    """Every pair, and each unmatched row of `a` with nulls; with the overlap in bases, 0 where there is none."""
    out = _meet(prefixed(a, "a_"), prefixed(b, "b_"), "a_", "b_", stranded, width, "left")
    bp = F.when(F.col("b_chrom").isNotNull(), F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).otherwise(0)
    return out.withColumn("bp", bp.cast("long"))


def reciprocal(a: DataFrame, b: DataFrame, fraction: float, stranded: bool = False, width: int = 16384) -> DataFrame:
    """Pairs whose overlap is that fraction of both; at 1.0 a plain equality join."""
    if fraction >= 1.0:
        x, y = prefixed(checked(a), "a_"), prefixed(checked(b), "b_")
        on = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in ("chrom", "start", "end", *(["strand"] if stranded else []))]
        return x.join(y, on)
    bp = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return overlap(a, b, stranded, width).where((bp >= fraction * (F.col("a_end") - F.col("a_start"))) & (bp >= fraction * (F.col("b_end") - F.col("b_start"))))


def merge(df: DataFrame, stranded: bool = True, identical_only: bool = False, width: int = 16384) -> DataFrame:
    """Runs of overlapping or touching intervals as one, distinct names joined by | in order.

    Identical intervals are summed up first. The rest are cut at the borders of bins and run together within each; only the runs
    that reach a border, two a bin at most, are then chained over a chromosome. The input is read once.
    """
    keys = ["chrom", "strand"] if stranded else ["chrom"]
    least = checked(df).groupBy(*keys, "start", "end").agg(F.collect_set("name").alias("names"))
    if identical_only:
        out = least
    else:
        first = F.floor(F.col("start") / width)
        cut = least.withColumn("bin", F.explode(F.sequence(first, F.floor(F.col("end") / width))))  # an end on a border touches what starts there
        cut = cut.withColumn("names", F.when(F.col("bin") == first, F.col("names")).otherwise(F.array().cast("array<string>")))
        left, right = F.col("bin") * width, (F.col("bin") + 1) * width
        cut = cut.withColumn("lo", F.greatest("start", left)).withColumn("hi", F.least("end", right))
        rows = Window.partitionBy(*keys, "bin").orderBy("lo", "hi")
        top = F.max("hi").over(rows.rowsBetween(Window.unboundedPreceding, -1))
        run = cut.withColumn("new", F.when(F.col("lo") <= top, 0).otherwise(1)).withColumn("run", F.sum("new").over(rows.rowsBetween(Window.unboundedPreceding, 0)))
        joined = F.flatten(F.collect_list("names")).alias("names")
        runs = run.groupBy(*keys, "bin", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), joined)
        inner = F.when((F.col("lo") > left) & (F.col("hi") < right), F.struct("bin", "run"))
        runs = runs.withColumn("inner", inner)
        chain = Window.partitionBy(*keys, "inner").orderBy("bin", "run")
        goes_on = (F.col("lo") == left) & (F.lag("hi").over(chain) == left) & (F.lag("bin").over(chain) == F.col("bin") - 1)
        runs = runs.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("chain", F.sum("new").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
        out = runs.groupBy(*keys, "inner", "chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), joined)
    return out.select(*keys, "start", "end", F.array_join(F.array_sort(F.array_distinct("names")), "|").alias("name"))


def redundancy(df: DataFrame, stranded: bool = True) -> DataFrame:
    """Rows, merged rows, and their difference."""
    n, m = df.agg(F.count("*").alias("n")), merge(df, stranded).agg(F.count("*").alias("merged"))
    return n.join(F.broadcast(m), F.lit(True)).select("n", "merged", (F.col("n") - F.col("merged")).alias("residual"))  # one row each


def coordinate_order() -> list[str]:
    """Bytewise by chromosome, then by place."""
    return ["chrom", "start", "end", "name", "strand"]


def keep_short(df: DataFrame, max_len: int) -> DataFrame:
    """Intervals shorter than max_len; all of them if it is 0 or less."""
    return df if max_len <= 0 else df.where(F.col("end") - F.col("start") < max_len)


def to_zero_based(start: Column) -> Column:
    return start - 1


def longest_wins(a: DataFrame, b: DataFrame, max_len: int = 0, a_tag: str = "a", b_tag: str = "b", width: int = 16384) -> DataFrame:
    """Same-strand union: of each overlapping pair the longer interval, of equals b's; then what overlaps nothing.

    With max_len, an over-long winner yields to a partner below it; pairs with neither below it and lone intervals not below it go.
    """
    la, lb = F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start")
    lone, b_wins = F.col("b_chrom").isNull(), lb >= la
    rows = overlap_left(a.select(*BED), b.select(*BED), True, width)  # pairs, and what is a's alone
    if max_len > 0:
        rows = rows.where((la < max_len) | (lb < max_len))
        b_wins = F.when(la >= max_len, True).when(lb >= max_len, False).otherwise(b_wins)
    own = lone | ~b_wins
    pick = lambda c: F.when(own, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c)
    name = F.when(lone, F.col("a_name")).otherwise(F.concat_ws("|", "a_name", "b_name")).alias("name")
    source = F.when(lone, f"{a_tag}_only").when(b_wins, f"both_{b_tag}").otherwise(f"both_{a_tag}").alias("source")
    score = F.lit(0).cast("long").alias("score")
    out = rows.select(F.col("a_chrom").alias("chrom"), pick("start"), pick("end"), name, score, F.col("a_strand").alias("strand"), source)
    rest = keep_short(overlap_anti(b.select(*BED), a, True, width), max_len)
    return out.unionByName(rest.select("chrom", "start", "end", "name", score, "strand", F.lit(f"{b_tag}_only").alias("source")))


def clipped(pairs: DataFrame) -> DataFrame:
    """Pairs whose kept b interval doesn't cover a."""
    return pairs.where("(b_end - b_start) >= (a_end - a_start) and (b_start > a_start or b_end < a_end)")
