"""A genome's index, built once and kept: exact places of any number of sequences without reading the genome again.

Pieces of PIECE bases, each with the `reach` bases after it, are dealt over shards of about as many bases, small chromosomes together.
A shard's row has the Burrows-Wheeler transform of its text, the counts of each letter before every BLOCK-th place of it, and the
places of every STEP-th letter in order of the suffixes: an FM-index. Patterns are searched backwards, all of them a letter at a time:
a pattern's suffix is a run of the sorted suffixes, and counts of a letter give the run of the suffix longer by one. A run's places are
found by walking back to a kept one. Patterns longer than reach + 1 are sought in parts of reach + 1 letters each, the last of which
overlaps the one before, as a few letters left over would be found nearly everywhere; a place counts where all its parts are.

Letters are told apart as they are in the tiles (upper case); a shard may have 254 different ones. Null and empty sequences have no
places, repeated rows have theirs each, and empty tables and genomes give no rows. Other columns of seqs aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored
from .search import AUTOMATON_BYTES, Genome, patterns

#: Bases of a piece, and of a shard about.
PIECE = 1 << 19
#: Letters between counts, and letters of the text between kept places.
BLOCK, STEP = 64, 32
#: Places found at once.
PLACES = 1 << 15
SHARD = "shard long, letters array<int>, bwt binary, counts binary, kept binary, marks binary, chroms array<string>, starts array<long>, offsets array<long>, own array<long>, reach long"


@dataclass(frozen=True)
class Index:
    """Rows of shards, and the bases that a piece has after its own."""

    shards: DataFrame
    reach: int


def suffix_order(text: np.ndarray, letters: int) -> np.ndarray:
    """Places of a text (codes below letters) in order of what follows them, by doubling the length by which they are told apart."""
    n, bits = len(text), max(1, int(letters - 1).bit_length())
    size = 63 // bits
    key = np.zeros(n, np.int64)
    for j in range(size):
        key <<= bits
        key[: max(0, n - j)] |= text[j:]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = np.flatnonzero(new)[np.cumsum(new) - 1], -1  # a group's rank is its first place
    while not new.all():
        open_ = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))  # places in groups of several
        at = order[open_]
        group, then = rank[at], rank[np.minimum(at + size, n)]
        sort = np.lexsort((then, group))
        at, group, then = at[sort], group[sort], then[sort]
        order[open_] = at
        new[open_] = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[order] = first
        size *= 2
    return order


def _shard(number: int, rows: list[dict], stride: int, reach: int) -> dict:
    """The index of some pieces' tiles."""
    parts, chroms, starts, own = [], [], [], []
    for r, after in zip(rows, [*rows[1:], None]):
        if not chroms or (r["chrom"], r["piece"]) != here:
            here = r["chrom"], r["piece"]
            chroms.append(r["chrom"]), starts.append(r["tile_start"]), own.append(0), parts.append("")
        last = after is None or (after["chrom"], after["piece"]) != here
        parts[-1] += r["seq"] if last else r["seq"][:stride]
        own[-1] += min(len(r["seq"]), stride)
    codes = [np.frombuffer(p.encode("utf-32-le", "replace"), np.uint32) for p in parts]
    letters = np.unique(np.concatenate(codes))
    if len(letters) > 254:
        raise ValueError(f"{len(letters)} different letters near {chroms[0]}:{starts[0]}; an index takes 254")
    # 1 stands after each piece, 0 at the end alone, so that walks back find their way over borders, too
    text = np.concatenate([*(np.append(np.searchsorted(letters, c) + 2, 1) for c in codes), [0]]).astype(np.uint8)
    order = suffix_order(text, len(letters) + 2)
    bwt = text[order - 1]
    blocks = -(-len(bwt) // BLOCK) + 1
    counts = np.zeros((blocks, len(letters) + 2), np.uint32)
    np.add.at(counts, (np.arange(len(bwt)) // BLOCK + 1, bwt), 1)
    marks = order % STEP == 0
    return {
        "shard": number, "letters": letters.astype(np.int32).tolist(), "bwt": bwt.tobytes(), "counts": np.cumsum(counts, axis=0, dtype=np.uint32).tobytes(),
        "kept": order[marks].astype("<u4").tobytes(), "marks": np.packbits(marks).tobytes(), "chroms": chroms, "starts": starts,
        "offsets": np.concatenate([[0], np.cumsum([len(c) + 1 for c in codes])[:-1]]).astype(int).tolist(), "own": own, "reach": reach,
    }


def build_index(genome: Genome, path: str) -> Index:
    """Writes the index of a genome's tiles as Parquet at path."""
    spark, stride, reach = genome.tiles.sparkSession, genome.stride, genome.reach
    if PIECE % stride:
        raise ValueError(f"a piece of {PIECE} bases isn't a whole number of strides of {stride}")
    tiles = stored(genome.tiles.select("chrom", "tile_start", "seq").where("seq <> ''").withColumn("piece", F.floor(F.col("tile_start") / PIECE)), "tiles")
    bases = tiles.agg(F.sum(F.least(F.length("seq"), F.lit(stride)))).first()[0] or 0
    tiles = tiles.withColumn("shard", F.pmod(F.xxhash64("chrom", "piece"), F.lit(max(1, -(-bases // PIECE)))))

    def build(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("chrom", "ascending"), ("tile_start", "ascending")]).to_pylist()
        return pa.Table.from_pylist([_shard(rows[0]["shard"], rows, stride, reach)], schema=schema)

    kinds = {"array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "binary": pa.binary(), "long": pa.int64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SHARD.split(", ")])
    tiles.groupBy("shard").applyInArrow(build, SHARD).write.mode("overwrite").parquet(path)
    return read_index(spark, path, reach)


def read_index(spark: SparkSession, path: str, reach: int | None = None) -> Index:
    shards = spark.read.schema(SHARD).parquet(path)
    if reach is None:
        row = shards.select("reach").first()
        reach = row[0] if row else 0
    return Index(shards, reach)


class _Patterns:
    """Distinct patterns as one run of code points, and the rows that ask for each."""

    def __init__(self, rows: list[tuple]):
        of: dict[str, int] = {}
        self.rows, number = rows, np.array([of.setdefault(r[0], len(of)) for r in rows], np.int64)
        self.order = np.argsort(number, kind="stable")
        self.first = np.searchsorted(number[self.order], np.arange(len(of) + 1))
        codes = [np.frombuffer(p.encode("utf-32-le", "replace"), np.uint32) for p in of]
        self.size = np.array([len(c) for c in codes], np.int64)
        self.end = np.cumsum(self.size)
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.uint32)


class _Searcher:
    """One shard's index, for many patterns at once."""

    def __init__(self, row: dict):
        letters = len(row["letters"]) + 2
        self.letters = np.array(row["letters"], np.uint32)
        bwt = np.frombuffer(row["bwt"], np.uint8)
        self.size = len(bwt)
        self.bwt = np.append(bwt, np.full(-len(bwt) % BLOCK + BLOCK, 255, np.uint8)).reshape(-1, BLOCK)
        self.counts = np.frombuffer(row["counts"], np.uint32).reshape(-1, letters).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.counts[-1])])
        self.kept = np.frombuffer(row["kept"], "<u4").astype(np.int64)
        self.marks = np.unpackbits(np.frombuffer(row["marks"], np.uint8))[: self.size].astype(bool)
        self.nth = np.cumsum(self.marks) - 1
        self.offsets, self.own, self.starts, self.chroms = np.array(row["offsets"], np.int64), np.array(row["own"], np.int64), np.array(row["starts"], np.int64), row["chroms"]

    def rank(self, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each letter stands before a place of the transform."""
        block, rest = at // BLOCK, at % BLOCK
        out = self.counts[block, letter]
        for a in range(0, len(at), 1 << 14):
            s = slice(a, a + (1 << 14))
            out[s] += ((self.bwt[block[s]] == letter[s, None]) & (np.arange(BLOCK) < rest[s, None])).sum(axis=1)
        return out

    def runs(self, p: _Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns that occur, and the run of sorted suffixes that begin with each."""
        live = np.arange(len(p.size))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.size, np.int64)
        done: list[tuple] = []
        step = 0
        while len(live):
            code = p.codes[p.end[live] - 1 - step]
            letter = np.searchsorted(self.letters, code)
            known = letter < len(self.letters)
            known[known] = self.letters[letter[known]] == code[known]
            live, low, high, letter = live[known], low[known], high[known], letter[known] + 2
            low, high = self.before[letter] + self.rank(letter, low), self.before[letter] + self.rank(letter, high)
            step += 1
            some = low < high
            live, low, high = live[some], low[some], high[some]
            end = p.size[live] == step
            done.append((live[end], low[end], high[end]))
            live, low, high = live[~end], low[~end], high[~end]
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 3

    def places(self, row: np.ndarray) -> np.ndarray:
        """Places of the text that sorted suffixes begin at."""
        out, steps, live = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        while len(live):
            there = self.marks[row]
            out[live[there]] = self.kept[self.nth[row[there]]] + steps
            live, row = live[~there], row[~there]
            letter = self.bwt[row // BLOCK, row % BLOCK].astype(np.int64)
            row = self.before[letter] + self.rank(letter, row)
            steps += 1
        return out

    def hits(self, p: _Patterns) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Patterns, pieces and places within their chromosomes, of those that begin in a piece's own bases."""
        which, low, high = self.runs(p)
        cuts = np.cumsum(high - low)
        for a in range(0, int(cuts[-1]) if len(cuts) else 0, PLACES):
            at = np.arange(a, min(a + PLACES, int(cuts[-1])))
            i = np.searchsorted(cuts, at, side="right")
            place = self.places(high[i] - (cuts[i] - at))
            piece = np.searchsorted(self.offsets, place, side="right") - 1
            own = place - self.offsets[piece] < self.own[piece]
            yield which[i[own]], piece[own], (self.starts[piece] + place - self.offsets[piece])[own]


def _found(row: dict, p: _Patterns) -> Iterator[pa.RecordBatch]:
    """name, strand, part (its place in the pattern), parts, size, chrom, start of the pattern's parts in a shard."""
    searcher = _Searcher(row)
    for which, piece, start in searcher.hits(p):
        n = p.first[which + 1] - p.first[which]
        i = np.repeat(np.arange(len(which)), n)
        asked = p.order[p.first[which][i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
        own = [p.rows[k] for k in asked.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[1] for r in own], pa.string()), pa.array([r[2] for r in own], pa.string()), pa.array([r[3] for r in own], pa.int32()), pa.array([r[4] for r in own], pa.int32()), pa.array([r[5] for r in own], pa.int64()), pa.array([searcher.chroms[k] for k in piece[i].tolist()], pa.string()), pa.array(start[i], pa.int64())],
            names=["name", "strand", "part", "parts", "size", "chrom", "start"],
        )


FOUND = "name string, strand string, part int, parts int, size long, chrom string, start long"


def place_indexed(seqs: DataFrame, index: Index, bound: int = 100_000) -> DataFrame:
    """name, chrom, start, end, strand of every occurrence of each sequence on either strand, as place() gives them, from the index alone.

    Up to `bound` parts of patterns, and AUTOMATON_BYTES of them, go to every task; more than that are dealt into blocks of about as many, and
    every block meets every shard.
    """
    width = index.reach + 1
    pats = patterns(seqs.select(F.col("name").cast("string").alias("name"), "seq")).withColumn("size", F.length("pattern").cast("long"))
    pats = pats.withColumn("parts", F.ceil(F.col("size") / width).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pats = pats.withColumn("part", F.greatest(F.lit(0), F.least(F.col("part") * width, F.col("size").cast("int") - width)))
    pats = pats.withColumn("pattern", F.substring("pattern", F.col("part") + 1, F.lit(width))).withColumn("row", F.monotonically_increasing_id())
    pats = stored(pats.select("pattern", "name", "strand", "part", "parts", "size", "row"), "patterns")
    n, size = pats.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()
    blocks = max(1, -(-n // bound), -(-size // AUTOMATON_BYTES))
    if blocks == 1:
        sent = pats.sparkSession.sparkContext.broadcast([tuple(r)[:6] for r in pats.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = _Patterns(sent.value)
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from _found(batch.slice(i, 1).to_pylist()[0], p)

        found = index.shards.mapInArrow(run, FOUND)
    else:
        block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
        dealt = pats.groupBy(block).agg(F.collect_list(F.struct("pattern", "name", "strand", "part", "parts", "size")).alias("asked"))

        def run_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    yield from _found(row, _Patterns([tuple(r.values()) for r in row["asked"]]))

        each = index.shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = each.join(dealt, "block").mapInArrow(run_block, FOUND)
    whole = found.where("parts = 1").select("name", "chrom", "start", "size", "strand")
    # a part's place less its offset is where the whole would begin; repeated rows of a sequence give each part as often as themselves
    begun = found.where("parts > 1").groupBy("name", "strand", "chrom", (F.col("start") - F.col("part")).alias("start"), "size", "parts", "part").agg(F.count("*").alias("n"))
    begun = begun.groupBy("name", "strand", "chrom", "start", "size", "parts").agg(F.count("*").alias("met"), F.min("n").alias("n")).where("met = parts")
    long_ = begun.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("name", "chrom", "start", "size", "strand")
    return whole.unionByName(long_).select("name", "chrom", "start", (F.col("start") + F.col("size")).alias("end"), "strand")
