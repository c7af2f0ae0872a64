"""Token-id files: one concatenated id array per shard beside Elias-Fano coded document boundaries.

A shard is two files. NAME.ids holds the ids of its documents one after another, as little-endian
uint16 (uint32 if the vocabulary needs it). NAME.ef holds two Elias-Fano sequences, the documents'
first positions in NAME.ids (and the end) and the ascending document ids. An Elias-Fano sequence of n
values below u keeps the low floor(log2(u / n)) bits of every value packed, and the high parts in
unary: about 2 + log2(u / n) bits a value. select(i) finds the i-th set bit of the unary part with
sampled counts, so an offset is read without a table of 64-bit positions. MANIFEST is a Parquet table
with a row per shard: its files, documents, ids, and the ids before it.

Shards are ranges of doc_id: their borders come from a percentile sketch over doc_id alone, and rows go
to their shard in one shuffle of encoded ids. An id that fills several shards, and null, is dealt over all
of them by its rows' places in the input. Each shard is streamed to a file with a name of its own
for every attempt, and only names of finished tasks reach the manifest, so a lost executor or a
speculative copy leaves at most an unlisted file.

Ids are the library's for the whole text, added tokens quoted in it included: a text that holds one is encoded
whole by the library. A long text is encoded like any other, in one worker's memory. Null text is an empty
document: it holds the end id alone. Documents without id come first and read back as null. Repeated doc_ids
stay separate documents, next to each other; within a shard the bytes of their ids order them. An empty table
gives no shards and no rows. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import CACHE_ENTRIES, Numbered, discard, materialize, mix64, partitions, ragged, shared_dir, slices, small_batches

#: Documents read from a shard at once.
READ_DOCS = 1024
#: A select sample for every so many set bits.
SAMPLE = 256


class EliasFano:
    """A sequence of ascending values >= 0 in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        self.ones_before = ones - np.bitwise_count(high)
        self.samples = np.searchsorted(ones, np.arange(0, max(n, 1), SAMPLE), side="right")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if n and (values[0] < 0 or (np.diff(values) < 0).any()):
            raise ValueError("values must ascend from 0 or more")
        bits = max(0, int(values[-1] // n).bit_length() - 1) if n else 0
        low = np.zeros((n, bits), np.uint8)
        for b in range(bits):
            low[:, b] = (values >> b) & 1
        high = np.zeros(((int(values[-1]) >> bits) + n if n else 0) // 8 + 1, np.uint8)
        at = (values >> bits) + np.arange(n)
        np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return cls(n, bits, np.packbits(low.reshape(-1), bitorder="little"), high)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte = int(self.samples[i // SAMPLE])
        while byte + 1 < len(self.high) and self.ones_before[byte + 1] <= i:
            byte += 1
        left, word, at = i - int(self.ones_before[byte]), int(self.high[byte]), 0
        while True:
            if word >> at & 1:
                if not left:
                    break
                left -= 1
            at += 1
        first, low = i * self.low_bits, 0
        for b in range(self.low_bits):
            k = first + b
            low |= (int(self.low[k >> 3]) >> (k & 7) & 1) << b
        return ((byte * 8 + at - i) << self.low_bits) | low

    def select_range(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1 at once, from the part of the unary code between the samples around them."""
        if i >= j:
            return np.zeros(0, np.int64)
        if i < 0 or j > self.n:
            raise IndexError((i, j))
        byte = int(self.samples[i // SAMPLE])
        after = (j - 1) // SAMPLE + 1
        stop = int(self.samples[after]) + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[byte:stop], bitorder="little")) + byte * 8
        skip = i - int(self.ones_before[byte])
        high = ones[skip : skip + j - i] - np.arange(i, j)
        if not self.low_bits:
            return high
        first, last = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[first >> 3 : (last >> 3) + 1], bitorder="little")[first & 7 :][: last - first]
        return (high << self.low_bits) | (bits.reshape(-1, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def write(self, f) -> None:
        f.write(struct.pack("<QQQQ", self.n, self.low_bits, len(self.low), len(self.high)))
        f.write(self.low.tobytes())
        f.write(self.high.tobytes())

    @classmethod
    def read(cls, f) -> EliasFano:
        n, bits, low, high = struct.unpack("<QQQQ", f.read(32))
        return cls(n, bits, np.frombuffer(f.read(low), np.uint8), np.frombuffer(f.read(high), np.uint8))


#: Marks after a word's last letter, which always are a piece of their own.
TAIL = b".,;:!?"


class WordEncoder:
    """Ids of whole texts from ids of words between ASCII white space, which no token of the vocabulary spans.

    A word's ids are its stem's and its closing marks': the vocabulary's pattern cuts between an ASCII letter and
    those marks, and it lowers ASCII letters in any case. The library encodes each stem once.
    """

    def __init__(self, path: str, end_id: int, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.kind = end_id, np.dtype(f"<u{width}")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added if not t.normalized]
        self.added_normalized = [t.content for t in added if t.normalized]
        self.added_start = commonprefix(self.added) or b""
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        probe = ascii_lowercase * 2
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(probe) if self.tokenizer.pre_tokenizer else []
        kept = self.tokenizer.normalizer.normalize_str(probe) if self.tokenizer.normalizer else probe
        self.letters_stay = kept == probe and [x for x, _ in pieces] == [probe]
        self.forget_stems()
        self.forget()

    def forget_stems(self) -> None:
        self.stems, self.stem_ids = Numbered(), np.zeros(0, self.kind)
        self.stem_start, self.stem_length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        self.known, self.ids = Numbered(), np.array([self.end_id], self.kind)
        self.known[b""] = 0  # no word is empty: its place is the end id's
        self.start, self.length = np.zeros(1, np.int64), np.ones(1, np.int64)

    def parts(self, word: bytes) -> tuple[bytes, bytes]:
        if word.isascii():
            low = word.lower()
            if self.added_start not in low or not any(t in low for t in self.added):  # the library looks for those in the text as it is
                word = low
        stem = word.rstrip(TAIL)
        if len(stem) < len(word) and stem and stem[-1:].isalpha():
            return stem, word[len(stem) :]
        return word, b""

    def encode_stems(self, stems: list[bytes]) -> None:
        """Stems of ASCII letters go straight to the library's merges, as its normaliser and its pattern leave them as they are.

        Other stems of letters alone are encoded as one text: each is one piece, which its last token closes.
        """
        n, ids = np.zeros(len(stems), np.int64), [np.zeros(0, self.kind)] * len(stems)
        merge = self.tokenizer.model.tokenize
        letters = [i for i, x in enumerate(stems) if x.isalpha() and x.islower()] if self.letters_stay else []
        got = [[t.id for t in merge(stems[i].decode())] for i in letters]
        n[letters] = [len(x) for x in got]
        for i, x in zip(letters, got):
            ids[i] = np.array(x, self.kind)
        texts = [x.decode("utf-8", "replace") for x in stems]
        plain = [i for i, x in enumerate(texts) if not n[i] and x.isalpha()]
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(texts[i] for i in part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.closes[got]) + 1
            if len(ends) == len(part):
                for i, a, b in zip(part, [0, *ends[:-1].tolist()], ends.tolist()):
                    ids[i] = got[a:b]
                n[part] = np.diff(ends, prepend=0)
        rest = [i for i in range(len(texts)) if not n[i]]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            ids[i] = np.array(e.ids, self.kind)
            n[i] = len(ids[i])
        self.stem_start = np.concatenate([self.stem_start, len(self.stem_ids) + np.cumsum(n) - n])
        self.stem_length = np.concatenate([self.stem_length, n])
        self.stem_ids = np.concatenate([self.stem_ids, *ids])

    def learn(self, words: list[bytes]) -> None:
        if len(self.stems) > CACHE_ENTRIES:
            self.forget_stems()
        flat = np.fromiter((self.stems[x] for w in words for x in self.parts(w)), np.int64, 2 * len(words))
        if self.stems.new:
            self.encode_stems(self.stems.fresh())
        n = self.stem_length[flat]
        ids = self.stem_ids[ragged(self.stem_start[flat], n)]
        n = n[::2] + n[1::2]
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
        self.length = np.concatenate([self.length, n])
        self.ids = np.concatenate([self.ids, ids])

    def quotes(self, raw: bytes) -> bool:
        """Whether a text holds the string of an added token, which may join what white space or marks would cut."""
        if any(t in raw for t in self.added):
            return True
        if not self.added_normalized:
            return False
        text = raw.decode("utf-8", "replace")
        text = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return any(t in text for t in self.added_normalized)

    def encode_texts(self, raw: list[bytes]) -> list[np.ndarray]:
        """Each text's ids, the end id included."""
        quoting = {i for i, x in enumerate(raw) if self.quotes(x)}
        plain = iter(self.encode_plain([x for i, x in enumerate(raw) if i not in quoting]))
        whole = lambda x: np.array([*self.tokenizer.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids, self.end_id], self.kind)
        return [whole(x) if i in quoting else next(plain) for i, x in enumerate(raw)]

    def encode_plain(self, raw: list[bytes]) -> list[np.ndarray]:
        if not raw:
            return []
        if len(self.known) > CACHE_ENTRIES:
            self.forget()
        look, at = self.known.__getitem__, []
        for x in raw:
            words = x.split()
            words.append(b"")
            at.append(np.fromiter(map(look, words), np.int64, len(words)))
        if self.known.new:
            self.learn(self.known.fresh())
        flat = np.concatenate(at)
        n = self.length[flat]
        ids = self.ids[ragged(self.start[flat], n)]
        ends = np.cumsum(n)[np.cumsum([len(x) for x in at]) - 1].tolist()
        return [ids[i:j] for i, j in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def word_encoder(path: str, end_id: int, width: int) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path, end_id, width)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def encode_words(df: DataFrame, vocab_path: str, end_id: int, width: int, id_col: str = "doc_id", text_col: str = "text", cuts: list[int | None] | None = None) -> DataFrame:
    """id long and ids binary, little-endian unsigned of `width` bytes, end id included; before them shard and key, if cuts are given."""
    small_batches(df.sparkSession)
    dealer = None if cuts is None else Dealer(cuts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = word_encoder(vocab_path, end_id, width), 0
        for batch, raw in slices(batches, 1):
            out = {"id": batch.column(0), "ids": pa.array([x.tobytes() for x in enc.encode_texts(raw)], pa.binary())}
            if dealer is not None:
                shard = dealer.shards(batch.column(0), row)
                out = {"shard": pa.array(shard, pa.int32()), "key": pa.array(dealer.keys[shard]), **out}
            row += len(raw)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kinds = "id long, ids binary" if dealer is None else "shard int, key long, id long, ids binary"
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, kinds)


class Dealer:
    """Shards of ids by ascending borders, null before all numbers: a shard ends with its border. A border that stands several times has several shards."""

    def __init__(self, cuts: list[int | None]):
        self.nulls = sum(c is None for c in cuts)
        self.cuts = np.array([c for c in cuts if c is not None], np.int64)
        self.keys = np.array(spread(len(cuts) + 1), np.int64)

    def shards(self, ids: pa.Array, row: int) -> np.ndarray:
        """The shard of each of a task's rows from number `row` on."""
        null = np.asarray(ids.is_null())
        x = np.asarray(ids.fill_null(0), np.int64)
        low, high = np.searchsorted(self.cuts, x), np.searchsorted(self.cuts, x, side="right")
        first = np.where(null, 0, self.nulls + low)
        several = np.where(null, max(1, self.nulls), np.maximum(1, high - low))
        turn = mix64(np.arange(row, row + len(x), dtype=np.uint64)) % several.astype(np.uint64)
        return first + turn.astype(np.int64)


def spread(shards: int) -> list[int]:
    """For each shard a key that Spark's hash partitioning sends to the partition of that number."""
    keys, i = {}, 0
    while len(keys) < shards:
        part = _murmur3_long(i) % shards
        keys.setdefault(part, i)
        i += 1
    return [keys[k] for k in range(shards)]


def _murmur3_long(v: int) -> int:
    """Spark's hash() of a long, seed 42, as a signed int."""
    m = 0xFFFFFFFF
    h = 42
    for k in (v & m, v >> 32 & m):
        k = k * 0xCC9E2D51 & m
        k = (k << 15 | k >> 17) & m
        k = k * 0x1B873593 & m
        h ^= k
        h = (h << 13 | h >> 19) & m
        h = (h * 5 + 0xE6546B64) & m
    h ^= 8
    h ^= h >> 16
    h = h * 0x85EBCA6B & m
    h ^= h >> 13
    h = h * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def write_id_files(df: DataFrame, vocab_path: str, out: str, end_id: int = 2, width: int = 2, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards below `out`, a folder all executors share, and returns the manifest as read back from it.

    shards defaults to the number of shuffle partitions, which the cluster sizes to its input.
    """
    spark = df.sparkSession
    n = shards or partitions(spark)
    own = F.col(id_col).cast("long")
    seen = df.agg(F.percentile_approx(own, F.lit([i / n for i in range(1, n)] or [0.5]), F.lit(max(10_000, 10 * n))).alias("q"), F.count("*").alias("rows"), F.count(own).alias("named")).first()
    nulls = min(n - 1, n * (seen["rows"] - seen["named"]) // max(1, seen["rows"]))
    q, left = seen["q"] or [], n - 1 - nulls
    cuts = [None] * nulls + [q[(i + 1) * n // (left + 1) - 1] for i in range(left if q else 0)]
    fs, top = filesystem(out)
    fs.create_dir(top)

    rows = encode_words(df, vocab_path, end_id, width, id_col, text_col, cuts)
    rows = rows.repartition(len(cuts) + 1, "key").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "ids").select("shard", "id", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(out)
        now = None
        for batch in batches:
            shard = np.asarray(batch.column(0))
            for a, b in zip(*_runs(shard)):
                if now is None or now.shard != shard[a]:
                    if now is not None:
                        yield now.close()
                    now = _Writer(fs, top, int(shard[a]), width)
                now.add(batch.slice(a, b - a))
        if now is not None:
            yield now.close()

    listed = rows.mapInArrow(write, "shard int, name string, width int, docs long, null_ids long, least_id long, ids long")
    made = materialize(listed, "id-files-manifest")
    rows = sorted(made.collect())  # one small row for each shuffle partition
    discard(made)
    start, full = 0, []
    for r in rows:
        full.append((*r, start))
        start += r["ids"]
    schema = listed.schema.add("start", "long")
    spark.createDataFrame(full, schema).coalesce(1).write.parquet(f"{out}/MANIFEST")
    return spark.read.schema(schema).parquet(f"{out}/MANIFEST")


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    starts = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist()] if len(x) else []
    return starts, [*starts[1:], len(x)]


class _Writer:
    """Streams one shard to its files."""

    def __init__(self, fs, top: str, shard: int, width: int):
        self.fs, self.top, self.shard, self.width = fs, top, shard, width
        self.name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(f"{top}/{self.name}.ids")
        self.at, self.lengths, self.doc_ids, self.nulls = 0, [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        ids = batch.column(1)
        self.nulls += ids.null_count
        self.doc_ids.append(np.asarray(ids.drop_null(), np.int64))
        raw = batch.column(2).to_pylist()
        self.lengths.append(np.fromiter(map(len, raw), np.int64, len(raw)) // self.width)
        self.out.write(b"".join(raw))

    def close(self) -> pa.RecordBatch:
        self.out.close()
        n = np.concatenate(self.lengths)
        ids = np.concatenate(self.doc_ids)
        least = int(ids[0]) if len(ids) else 0
        with self.fs.open_output_stream(f"{self.top}/{self.name}.ef") as f:
            EliasFano.of(np.concatenate([[0], np.cumsum(n)])).write(f)
            EliasFano.of(ids - least).write(f)
        row = [self.shard, self.name, self.width, len(n), self.nulls, least, int(n.sum())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()])], names=["shard", "name", "width", "docs", "null_ids", "least_id", "ids"])


class IdFile:
    """Random access to one written shard."""

    def __init__(self, path: str, name: str, width: int, nulls: int = 0, least: int = 0):
        fs, top = filesystem(path)
        self.width, self.nulls, self.least = width, nulls, least
        with fs.open_input_file(f"{top}/{name}.ef") as f:
            head = io.BytesIO(f.read())
        self.bounds, self.doc_ids = EliasFano.read(head), EliasFano.read(head)
        self.file = fs.open_input_file(f"{top}/{name}.ids")

    def __len__(self) -> int:
        return self.bounds.n - 1

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.doc_ids.select(i - self.nulls)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds.select(i), self.bounds.select(i + 1)
        self.file.seek(a * self.width)
        return np.frombuffer(self.file.read((b - a) * self.width), f"<u{self.width}").astype(np.uint32)

    def doc_ids_range(self, i: int, j: int) -> list[int | None]:
        k = max(i, self.nulls)
        return [None] * (min(j, self.nulls) - i) + (self.least + self.doc_ids.select_range(k - self.nulls, j - self.nulls)).tolist() if j > k else [None] * (j - i)

    def ids_range(self, i: int, j: int) -> Iterator[np.ndarray]:
        """Ids of documents i to j - 1, read one after another from the first one's place."""
        n = np.diff(self.bounds.select_range(i, j + 1)).tolist()
        self.file.seek(self.bounds.select(i) * self.width)
        for k in n:
            yield np.frombuffer(self.file.read(k * self.width), f"<u{self.width}")


def read_id_files(spark: SparkSession, out: str) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32, each from select() of its boundaries."""
    manifest = spark.read.parquet(f"{out}/MANIFEST")
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = IdFile(out, row["name"], row["width"], row["null_ids"], row["least_id"])
                for at in range(0, len(f), READ_DOCS):
                    to = min(at + READ_DOCS, len(f))
                    first = f.bounds.select_range(at, to + 1)
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in f.ids_range(at, to)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.doc_ids_range(at, to), pa.int64()), pa.array(first[:-1] + row["start"], pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    dealt = manifest.withColumn("key", F.element_at(F.lit(spread(n)), F.row_number().over(_by_shard()))).repartition(n, F.col("key").cast("long"))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _by_shard():
    from pyspark.sql import Window

    return Window.orderBy("shard")  # over the manifest's rows, one for each shuffle partition


def id_file_digests(df: DataFrame, vocab_path: str, end_id: int = 2) -> DataFrame:
    """Encodes documents, writes them as id files below the shared folder and reads them back."""
    out = shared_dir(df.sparkSession, "id-files")
    write_id_files(df, vocab_path, out, end_id)
    return read_id_files(df.sparkSession, out)
