"""Substring deduplication by super-k-mers of words.

A window is `window` consecutive words. Its minimiser is the least hash of the `mer`-word runs in it, and
consecutive windows with one minimiser form a super-k-mer, so equal windows always lie in super-k-mers of
equal minimiser. The steps:

1. One pass lists each document's super-k-mers: minimiser, 128-bit digest, place. No text travels.
2. Equal super-k-mers are summed up, map-side first, to the least and greatest document that has them.
3. Where a minimiser has one super-k-mer only, every window of it first stands in that least document.
4. Where it has several, one copy of each travels as a packed string of words to the minimiser's bucket,
   where windows are sorted and equal ones, compared word for word, get the least of their documents.
   A minimiser with more than `crowd` different super-k-mers isn't one bucket: tasks take any of them, sum
   up windows by 128-bit digest, and the windows that stand in several are joined to the sums.
5. Windows that stand in an earlier document come back to their documents, and words they cover go.

Texts are shuffled only where a bitmap of bounded size says that strings are to be cut or words may go.

Words are runs of other bytes than space and U+0009 to U+000D, unchanged; null text has none. A long text is one
row, whole in a worker's memory with a few numbers for each word. Rows without doc_id keep everything and take
nothing from others. Rows with one doc_id are told apart by 64-bit hashes of their texts and, having no smaller
doc_id, take nothing from each other; equal rows all come back alike. Empty tables give no rows; other columns
aren't read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CACHE_ENTRIES, Numbered, discard, materialize, mix64, partitions, sieve, slices, small_batches

B1, B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
I1, I2 = (np.uint64(pow(int(b), -1, 1 << 64)) for b in (B1, B2))
SPLIT = np.uint64(0xA0761D6478BD642F)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHashes:
    """64-bit hashes of words, remembered."""

    def __init__(self):
        self.known, self.hashes = Numbered(), np.zeros(0, np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_ENTRIES:
            self.known, self.hashes = Numbered(), np.zeros(0, np.uint64)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        new = self.known.fresh()
        if new:
            self.hashes = np.concatenate([self.hashes, np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in new), np.uint64, len(new))])
        return self.hashes[at]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, by doubling."""
    reach, out = 1, x
    while reach * 2 <= width:
        out = np.minimum(out[: len(out) - reach], out[reach:])
        reach *= 2
    more = width - reach
    return np.minimum(out[: len(out) - more], out[more:]) if more else out


def super_kmers(w: np.ndarray, window: int, mer: int) -> tuple[np.ndarray, ...]:
    """start, windows, minimiser and two digests of each super-k-mer of the word hashes w."""
    n = len(w)
    if n < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 3
    h = w[: n - mer + 1]
    for j in range(1, mer):
        h = h * B1 + w[j : n - mer + 1 + j]
    least = sliding_least(mix64(h), window - mer + 1)
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    count = np.diff(np.concatenate([start, [len(least)]]))
    return start, count, least[start], *digests(w, start, start + count + window - 1)


def digests(w: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each run start..end of word hashes, the same wherever the run stands."""
    out = []
    for base, inverse, x in ((B1, I1, w), (B2, I2, mix64(w ^ SPLIT))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(base, len(x)), dtype=np.uint64)])
        out.append(mix64((sums[end] - sums[start]) * powers(inverse, len(w) + 1)[start] + (end - start).astype(np.uint64)))
    return tuple(out)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def list_super_kmers(docs: DataFrame, window: int, mer: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, raw in slices(batches, 2):
            found = [super_kmers(hashes(x.split()), window, mer) for x in raw]
            n = np.array([len(f[0]) for f in found])
            own = [np.repeat(np.asarray(batch.column(i)), n) for i in (0, 1)]
            start, count, least, s1, s2 = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), _long(least), _long(s1), _long(s2)], names=["id", "t", "start", "windows", "mz", "s1", "s2"])

    return docs.where("id is not null").mapInArrow(run, "id long, t long, start int, windows int, mz long, s1 long, s2 long")


def word_ends(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    space = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
    return np.concatenate([[0], space + 1]), np.concatenate([space, [len(packed)]])


def first_of_windows(bucket: np.ndarray, first: np.ndarray, windows: np.ndarray, packed: list[bytes], window: int) -> np.ndarray:
    """The least `first` among equal windows of one bucket, for each window of each row in order."""
    row = np.repeat(np.arange(len(packed)), windows)
    a, b = [], []
    for x in packed:
        s, e = word_ends(x)
        a.append(s[: len(s) - window + 1]), b.append(e[window - 1 :])
    a, b = np.concatenate(a), np.concatenate(b)
    text = lambda i: packed[row[i]][a[i] : b[i]]
    h = np.fromiter((xxhash.xxh64_intdigest(packed[r][x:y], 7) for r, x, y in zip(row.tolist(), a.tolist(), b.tolist())), np.uint64, len(row))
    order = np.lexsort((first[row], h, bucket[row]))
    same = (h[order][1:] == h[order][:-1]) & (bucket[row[order]][1:] == bucket[row[order]][:-1])
    head = np.concatenate([[True], ~same])
    out = np.empty(len(row), np.int64)
    run = np.flatnonzero(head)
    length = np.diff(np.concatenate([run, [len(row)]]))
    out[order] = np.repeat(first[row[order[run]]], length)
    for at, n in zip(run[length > 1].tolist(), length[length > 1].tolist()):
        own = [text(i) for i in order[at : at + n].tolist()]
        if any(x != own[0] for x in own):  # different windows of one hash
            least: dict[bytes, int] = {}
            for x, i in zip(own, order[at : at + n]):
                least[x] = min(least.get(x, first[row[i]]), first[row[i]])
            for x, i in zip(own, order[at : at + n]):
                out[i] = least[x]
    return out


def cut_strings(docs: DataFrame, need: DataFrame) -> DataFrame:
    """The packed words of the super-k-mers in need(id, t, start, words, ...), cut from their documents."""
    per = materialize(need.groupBy("id", "t").agg(F.collect_list(F.struct(*[c for c in need.columns if c not in ("id", "t")])).alias("of")), "super-k-mers-to-cut")
    docs = sieve(per, "id", "t")(docs).where("maybe").drop("maybe")
    rest = need.drop("id", "t", "start", "words")
    names, schema = rest.columns, rest.schema
    kinds = {f.name: {"bigint": pa.int64(), "int": pa.int32()}[f.dataType.simpleString()] for f in schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, 0):
            cols: dict[str, list] = {c: [] for c in names}
            packed = []
            for own, x in zip(batch.column(1).to_pylist(), raw):
                words = x.split()
                for r in own:
                    packed.append(b" ".join(words[r["start"] : r["start"] + r["words"]]))
                    for c in names:
                        cols[c].append(r[c])
            yield pa.RecordBatch.from_arrays([*(pa.array(cols[c], kinds[c]) for c in names), pa.array(packed, pa.binary())], names=[*names, "packed"])

    out = docs.join(per, ["id", "t"]).select("text", "of").mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", packed binary")
    out = materialize(out, "packed-super-k-mers")
    discard(per)
    return out


def sort_buckets(strings: DataFrame, window: int) -> DataFrame:
    """s1, s2 and firsts of super-k-mers with windows of an earlier document, from the sorted windows of their buckets."""

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        mz, first, last, windows = (t.column(c).to_numpy().astype(np.int64) for c in ("mz", "first", "last", "windows"))
        got = first_of_windows(mz, first, windows, t.column("packed").to_pylist(), window)
        ends = np.cumsum(windows)
        some = np.flatnonzero(np.minimum.reduceat(got, ends - windows) < last)
        yield pa.RecordBatch.from_arrays([pa.array(t.column("s1").to_numpy()[some]), pa.array(t.column("s2").to_numpy()[some]), pa.array([got[e - k : e].astype("<i8").tobytes() for e, k in zip(ends[some], windows[some])], pa.binary())], names=["s1", "s2", "firsts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            mz = batch.column(0).to_numpy()
            cut = int(np.argmax(mz == mz[-1]))
            if cut:
                held[-1] = batch.slice(0, cut)
                yield from whole(held)
                held = [batch.slice(cut)]
        if held:
            yield from whole(held)

    rows = strings.select("mz", "s1", "s2", "first", "last", "windows", "packed").repartition(partitions(strings.sparkSession), "mz").sortWithinPartitions("mz")
    return rows.mapInArrow(run, "s1 long, s2 long, firsts binary")


def window_digests(hashes: WordHashes, packed: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of windows of each packed string, and their two digests."""
    d = []
    for x in packed:
        w = hashes(x.split())
        at = np.arange(len(w) - window + 1)
        d.append(digests(w, at, at + window))
    return np.array([len(x[0]) for x in d]), np.concatenate([x[0] for x in d]), np.concatenate([x[1] for x in d])


#: Slots that tell windows of crowded minimisers which surely stand in one super-k-mer only, and slots of a block.
SLOTS, BLOCK = 1 << 24, 1 << 13


def deal_windows(strings: DataFrame, window: int) -> DataFrame:
    """The same from super-k-mers of crowded minimisers, wherever they lie.

    A counting bitmap first sets aside windows that no two super-k-mers have. Each task sums up those left by
    digest, and the sums go back to the super-k-mers by minimiser.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, once, twice = WordHashes(), np.zeros(SLOTS // 8, np.uint8), np.zeros(SLOTS // 8, np.uint8)
        for batch, raw in slices(batches, 4):
            slot, n = np.unique((window_digests(hashes, raw, window)[1] & np.uint64(SLOTS - 1)).astype(np.int64), return_counts=True)
            mask = (1 << (slot & 7)).astype(np.uint8)
            again = (n > 1) | ((once[slot >> 3] & mask) != 0)
            np.bitwise_or.at(twice, slot[again] >> 3, mask[again])
            np.bitwise_or.at(once, slot >> 3, mask)
        some = np.flatnonzero(once.reshape(-1, BLOCK // 8).any(axis=1))
        cut = lambda x: pa.array([x[i * BLOCK // 8 : (i + 1) * BLOCK // 8].tobytes() for i in some], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), cut(once), cut(twice)], names=["block", "once", "twice"])

    def join_blocks(t: pa.Table) -> pa.Table:
        once, twice = np.zeros(BLOCK // 8, np.uint8), np.zeros(BLOCK // 8, np.uint8)
        for a, b in zip(t.column("once").to_pylist(), t.column("twice").to_pylist()):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            twice |= b | (once & a)
            once |= a
        return pa.table({"block": t.column("block")[:1], "twice": pa.array([twice.tobytes()], pa.binary())})

    own = strings.select("s1", "s2", "first", "last", "windows")
    strings = strings.select("mz", "s1", "s2", "first", "packed", "last")
    blocks = strings.mapInArrow(count, "block int, once binary, twice binary").groupBy("block").applyInArrow(join_blocks, "block int, twice binary")
    shared = np.zeros(SLOTS // 8, np.uint8)
    for r in blocks.collect():  # SLOTS / 8 bytes at most
        shared[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["twice"], np.uint8)
    sent = strings.sparkSession.sparkContext.broadcast(shared)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, bits = WordHashes(), [], sent.value

        def out() -> pa.RecordBatch:
            mz, w1, w2, first, last = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((w2, w1, mz))
            mz, w1, w2, first, last = (x[order] for x in (mz, w1, w2, first, last))
            at = np.concatenate([[0], np.flatnonzero((mz[1:] != mz[:-1]) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])) + 1])
            return pa.RecordBatch.from_arrays([pa.array(mz[at]), _long(w1[at]), _long(w2[at]), pa.array(np.minimum.reduceat(first, at)), pa.array(np.maximum.reduceat(last, at))], names=["mz", "w1", "w2", "first", "last"])

        for batch, raw in slices(batches, 4):
            n, w1, w2 = window_digests(hashes, raw, window)
            slot = (w1 & np.uint64(SLOTS - 1)).astype(np.int64)
            keep = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            row = np.repeat(np.arange(len(raw)), n)[keep]
            held.append((batch.column(0).to_numpy()[row], w1[keep], w2[keep], batch.column(3).to_numpy()[row], batch.column(5).to_numpy()[row]))
            if sum(len(x[0]) for x in held) > 1 << 20:
                yield out()
        if sum(len(x[0]) for x in held):
            yield out()

    low = strings.mapInArrow(sum_up, "mz long, w1 long, w2 long, first long, last long").groupBy("mz", "w1", "w2").agg(F.min("first").alias("f"), F.max("last").alias("z")).where("f < z")
    low = materialize(low.select("mz", "w1", "w2", "f"), "crowded-windows")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), sent.value
        for batch, raw in slices(batches, 4):
            n, w1, w2 = window_digests(hashes, raw, window)
            slot = (w1 & np.uint64(SLOTS - 1)).astype(np.int64)
            keep = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            row = np.repeat(np.arange(len(raw)), n)[keep]
            place = keep - (np.cumsum(n) - n)[row]
            mz, s1, s2, first = (batch.column(i).to_numpy()[row] for i in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(mz), _long(w1[keep]), _long(w2[keep]), pa.array(s1), pa.array(s2), pa.array(first), pa.array(place.astype(np.int32))], names=["mz", "w1", "w2", "s1", "s2", "first", "place"])

    # a window that stands everywhere meets one row, and adaptive execution can split its side of the join
    earlier = strings.mapInArrow(spell, "mz long, w1 long, w2 long, s1 long, s2 long, first long, place int").join(low, ["mz", "w1", "w2"]).where("f < first")
    earlier = earlier.groupBy("s1", "s2").agg(F.collect_list(F.struct("place", "f")).alias("of"))  # of one super-k-mer's windows

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, windows, of in zip(*(batch.column(c).to_pylist() for c in ("first", "windows", "of"))):
                firsts = np.full(windows, first, np.int64)
                for r in of or ():
                    firsts[r["place"]] = r["f"]
                out.append(firsts.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["s1", "s2", "firsts"])

    return own.join(earlier, ["s1", "s2"], "left").where("first < last or of is not null").select("s1", "s2", "first", "windows", "of").mapInArrow(fill, "s1 long, s2 long, firsts binary")


def _first_docs(docs: DataFrame, listed: DataFrame, window: int, crowd: int) -> DataFrame:
    """s1, s2, and `first` for all windows of that super-k-mer or else `firsts`, little-endian int64 of each window."""
    least = listed.groupBy("mz", "s1", "s2").agg(F.min(F.struct("id", "t", "start")).alias("at"), F.max("id").alias("last"), F.first("windows").alias("windows"))
    least = materialize(least.select("mz", "s1", "s2", F.col("at.id").alias("id"), F.col("at.t").alias("t"), F.col("at.start").alias("start"), "last", "windows"), "super-k-mers")
    shared = materialize(least.groupBy("mz").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("last").alias("b")).where("n > 1 and a < b").select("mz", "n"), "shared-minimisers")
    least_marked = sieve(shared, "mz")(least)
    copied = least_marked.where("id < last")
    alone = copied.where("not maybe").unionByName(copied.where("maybe").join(shared, "mz", "left_anti"))
    need = least_marked.where("maybe").drop("maybe").join(shared, "mz")
    need = need.select("id", "t", "start", (F.col("windows") + (window - 1)).alias("words"), "mz", "s1", "s2", F.col("id").alias("first"), "last", "windows", F.col("n").alias("crowd"))
    strings = cut_strings(docs, need)
    found = sort_buckets(strings.where(F.col("crowd") <= crowd), window)
    if strings.where(F.col("crowd") > crowd).limit(1).count():
        found = found.unionByName(deal_windows(strings.where(F.col("crowd") > crowd), window))
    out = alone.select("s1", "s2", F.col("id").alias("first"), F.lit(None).cast("binary").alias("firsts"))
    out = materialize(out.unionByName(found.select("s1", "s2", F.lit(None).cast("long").alias("first"), "firsts")), "window-origins")
    for x in (least, shared, strings):
        discard(x)
    return out


def dedup_substrings(df: DataFrame, window: int = 50, mer: int = 10, crowd: int = 256, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """id_col, n_words, n_removed and kept (the words left, joined by one space, as binary) of every row.

    With as_is, kept is the text itself, white space and all, where nothing goes.
    The columns named in carry come along unchanged; none of them may have the name of a result.
    """
    small_batches(df.sparkSession)
    more = [f"carried_{i}" for i in range(len(carry))]
    whole = df.select(*[F.col(c).alias(m) for c, m in zip(carry, more)], F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").alias("text"))
    docs = whole.select("id", "t", "text")
    listed = materialize(list_super_kmers(docs, window, mer), "super-k-mer-places")
    origins = _first_docs(docs, listed, window, crowd)
    marks = sieve(origins, "s1", "s2")(listed).where("maybe").join(origins, ["s1", "s2"]).where("first < id or firsts is not null")
    # of one text's super-k-mers: a set, as equal rows have the same ones
    marks = materialize(marks.groupBy("id", "t").agg(F.collect_set(F.struct("start", "windows", "firsts")).alias("of")), "window-marks")
    for x in (listed, origins):
        discard(x)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, 1):
            ids, total, gone, kept = batch.column(0), [], [], []
            for own, x, of in zip(ids.to_pylist(), raw, batch.column(2).to_pylist()):
                words = x.split()
                cover = np.zeros(len(words) + 1, np.int64)
                for r in of or ():
                    if r["firsts"] is None:
                        cover[r["start"]] += 1
                        cover[r["start"] + r["windows"] - 1 + window] -= 1
                    else:
                        at = np.flatnonzero(np.frombuffer(r["firsts"], "<i8") < own) + r["start"]
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                keep = np.cumsum(cover[:-1]) == 0
                total.append(len(words)), gone.append(int((~keep).sum()))
                kept.append(x if as_is and not gone[-1] else b" ".join(words if not gone[-1] else [w for w, k in zip(words, keep.tolist()) if k]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), *batch.columns[3:]], names=["id", "n_words", "n_removed", "kept", *more])

    kinds = "".join(f", {m} {whole.schema[m].dataType.simpleString()}" for m in more)
    seen = sieve(marks, "id", "t")(whole)
    hit = seen.where("maybe").join(marks, ["id", "t"], "left").select("id", "text", "of", *more)
    rest = seen.where("not maybe").select("id", "text", F.lit(None).cast(marks.schema["of"].dataType).alias("of"), *more)
    out = hit.unionByName(rest).mapInArrow(cut, f"id long, n_words long, n_removed long, kept binary{kinds}")
    return out.withColumnsRenamed({"id": id_col, **dict(zip(more, carry))})


def substring_digests(df: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return dedup_substrings(df, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], window: int) -> list[tuple]:
    """The same result from a table of all windows, for tests on small inputs."""
    texts = [(i, (x or "").encode().split()) for i, x in rows]
    first: dict[bytes, int] = {}
    spell = lambda w, k: b" ".join(w[k : k + window])
    for i, w in texts:
        for k in range(len(w) - window + 1 if i is not None else 0):
            first[spell(w, k)] = min(first.get(spell(w, k), i), i)
    out = []
    for i, w in texts:
        keep = [True] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[spell(w, k)] < i:
                keep[k : k + window] = [False] * window
        left = b" ".join(x for x, y in zip(w, keep) if y)
        out.append((i, len(w), keep.count(False), hashlib.sha256(left).hexdigest()))
    return out
