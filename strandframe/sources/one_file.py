"""One file from many tasks: parts are written in order, each by its own task, and the file system puts them together.

A sort deals rows over partitions by ranges, so parts in the order of their numbers are the whole in order; no task has all rows. A
file system that can join files (as HDFS does, by their blocks) is asked to; on others the driver copies bytes from one stream to another, a
buffer at a time, without looking at rows. The parts stand beside the file until it is whole, and only then it takes its place, so a
failure before that leaves what was there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame


def write_one_file(df: DataFrame, path: str, write: Callable[[DataFrame, str], None], header: str = "") -> None:
    """Writes df's partitions in their order by `write` (into a folder of parts), and puts them together as the one file in the folder `path`, after the header if there is one."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    of = jvm.org.apache.hadoop.fs.Path
    top = path.rstrip("/")
    beside = f"{top}.parts-{uuid.uuid4().hex}"
    fs = of(top).getFileSystem(conf)
    try:
        write(df, f"{beside}/rows")
        parts = sorted((s.getPath() for s in fs.listStatus(of(f"{beside}/rows")) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda p: p.getName())
        whole = of(f"{beside}/whole/part-00000.txt")
        out = fs.create(whole)
        try:
            out.write(bytearray(header.encode()))
            if not _joins(fs, parts):
                for part in parts:
                    source = fs.open(part)
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                    finally:
                        source.close()
        finally:
            out.close()
        if _joins(fs, parts):
            paths = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
            for i, p in enumerate(parts):
                paths[i] = p
            fs.concat(whole, paths)
        fs.delete(of(top), True)
        if not fs.rename(of(f"{beside}/whole"), of(top)):
            raise OSError(f"{beside}/whole could not take the place of {top}")
    finally:
        fs.delete(of(beside), True)


def _joins(fs, parts: list) -> bool:
    """Whether the file system joins files by their blocks."""
    return bool(parts) and fs.getScheme() in ("hdfs", "webhdfs", "swebhdfs")
