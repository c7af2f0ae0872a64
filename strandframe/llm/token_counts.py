"""Token counts of a document's sections from one encoding of the whole document.

Each token gets the span of characters that its bytes touch, and token spans are joined to section spans as
intervals: both ascend, so a section is found by binary search for all tokens at once. A token within
one section counts there. One that touches several counts by `rule`:

- "majority": in the section with most of its characters, the earlier of equals;
- "first": in the first section it touches;
- "split": in each, by its share of the characters that lie in sections.

Tokens that touch no section count as outside, section -1, if there are any. Sections ascend and don't
overlap; without a column of them, they are the text's lines, each with its line feed. Null and empty texts
have no sections and no tokens, so they give no rows, nor do empty tables; a text whose column of sections is empty
has tokens outside only. A long text is one row in a worker's memory, encoded whole. Repeated rows each give theirs;
other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices, small_batches
from .bpe import ByteBpe, vocabulary

RULES = ("majority", "first", "split")


def token_spans(bpe: ByteBpe, raw: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character touched by each token and the one after the last."""
    ends = np.cumsum(bpe.token_length[ids])
    starts = ends - bpe.token_length[ids]
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    ends = np.array([len(x) for x in text.split("\n")], np.int64)
    ends[:-1] += 1
    ends = np.cumsum(ends)
    if len(ends) > 1 and ends[-1] == ends[-2]:  # the text ends with a line feed
        ends = ends[:-1]
    return np.concatenate([[0], ends[:-1]]), ends


def attribute(a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens of each section, tokens of each that touch another one or its outside, and tokens outside all."""
    n = len(start)
    count, crossing = np.zeros(n), np.zeros(n, np.int64)
    i, j = np.searchsorted(end, a, side="right"), np.searchsorted(start, b, side="left") - 1
    outside = float((i > j).sum())
    count += np.bincount(i[i == j], minlength=n)[:n] if n else 0
    for t in np.flatnonzero(i < j):
        s = np.arange(i[t], j[t] + 1)
        share = np.minimum(end[s], b[t]) - np.maximum(start[s], a[t])
        crossing[s] += 1
        if rule == "split":
            count[s] += share / share.sum()
        else:
            count[s[0] if rule == "first" else s[int(share.argmax())]] += 1
    return count, crossing, outside


def section_tokens(df: DataFrame, vocab_path: str, pattern: str, sections_col: str | None = None, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, section (its number), start, n_chars, n_tokens (double by "split", else long), n_crossing; a map without a shuffle.

    sections_col holds array<struct<start, end>> in characters.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(df.sparkSession)
    cols = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")]
    if sections_col:
        cols.append(F.transform(F.col(sections_col), lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))).alias("sections"))
    src = df.select(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocab_path, pattern)
        for batch, raw in slices(batches, 1):
            texts = [x.decode("utf-8", "replace") for x in raw]
            ids, n = bpe.encode_texts(texts)
            ends = np.cumsum(n)
            given = batch.column(2).to_pylist() if sections_col else [None] * len(raw)
            out: list[list[np.ndarray]] = []
            rows = np.zeros(len(raw), np.int64)
            for r, (text, e, k, own) in enumerate(zip(texts, ends, n, given)):
                if sections_col:
                    start, end = (np.array([s[x] for s in own or ()], np.int64) for x in ("start", "end"))
                    if (end < start).any() or (start[1:] < end[:-1]).any():
                        raise ValueError("sections must ascend and not overlap")
                elif not text:
                    continue
                else:
                    start, end = line_spans(text)
                a, b = token_spans(bpe, text.encode("utf-8"), ids[e - k : e])
                count, crossing, outside = attribute(a, b, start, end, rule)
                number = np.arange(len(start))
                if outside:
                    number, start, end, count, crossing = (np.append(x, y) for x, y in ((number, -1), (start, 0), (end, 0), (count, outside), (crossing, 0)))
                rows[r] = len(number)
                out.append([number, start, end - start, count, crossing])
            cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0)] * 5
            which = pa.array(np.repeat(np.arange(len(raw)), rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(which), pa.array(cols[0].astype(np.int32)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.int64)), pa.array(cols[3].astype(np.float64 if rule == "split" else np.int64)), pa.array(cols[4].astype(np.int64))],
                names=["id", "section", "start", "n_chars", "n_tokens", "n_crossing"],
            )

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, section int, start long, n_chars long, n_tokens {'double' if rule == 'split' else 'long'}, n_crossing long").withColumnRenamed("id", id_col)
