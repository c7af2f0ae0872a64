"""Interval lookup of a stream against a static catalogue; stateless, so any output mode and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.intervals import overlap


def annotate_stream(stream: DataFrame, catalogue: DataFrame, stranded: bool = True, width: int = 16384) -> DataFrame:
    """a_* and b_* of each overlap of a streamed interval with the catalogue."""
    return overlap(stream, catalogue, stranded, width, home="b")
