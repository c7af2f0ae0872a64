"""Engine parameters: defaults, then spark.strandframe.* settings of the session, then STRANDFRAME_* environment variables, then arguments."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """max_len 0 turns the length filter off; lengths and offsets are in bases."""

    max_len: int = 0
    kmer: int = 20
    min_cov: float = 0.8
    offset_tol: int = 1
    fasta_base: int = 3000
    gap_open: float = 10.0
    gap_extend: float = 0.5
    min_contained: int = 40
    bin_width: int = 16384

    @classmethod
    def resolve(cls, env: dict[str, str] | None = None, spark: SparkSession | None = None, **given) -> EngineConfig:
        env = os.environ if env is None else env
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        values = {}
        for f in fields(cls):
            kind = type(f.default)
            if spark is not None and (v := spark.conf.get(f"spark.strandframe.{f.name}", None)) is not None:
                values[f.name] = kind(v)
            if (v := env.get(f"STRANDFRAME_{f.name.upper()}")) is not None:
                values[f.name] = kind(v)
            if given.get(f.name) is not None:
                values[f.name] = kind(given[f.name])
        return cls(**values)


def validate(spark: SparkSession, required: dict[str, str], optional: dict[str, str] | None = None) -> list[str]:
    """Raises one error that names every missing required input; gives the names of missing optional ones."""

    def there(path: str) -> bool:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    missing = [f"{k}: {v}" for k, v in required.items() if not there(v)]
    if missing:
        raise FileNotFoundError("missing inputs: " + "; ".join(missing))
    return [k for k, v in (optional or {}).items() if not there(v)]
