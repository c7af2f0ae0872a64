"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

Pieces of a text (matches of the vocabulary's pattern) are independent, so each distinct piece is
encoded once per worker. Pieces of similar length become the rows of one padded matrix of token
ids. A matrix of pair ranks stands beside it; each round every row merges its leftmost pair of least
rank, looks up the two pairs that changed in a hashed pair table, closes the gap, and leaves the
matrix once no pair has a rank.

Pieces above WIDEST bytes, such as long runs of one character, are the exception: a row as wide as one of them would
make its matrix too large, so they are merged with a heap, to the same ids. A long text is one row in a worker's
memory, cut into pieces. Null text encodes like an empty one: no ids. Bytes that are not UTF-8 count as U+FFFD. Repeated rows
each give their own result, an empty table gives no rows, and only the columns named are read, so
further columns can't clash.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CACHE_ENTRIES, HashTable, Numbered, ragged, slices, small_batches

NO_RANK = np.int32(2**31 - 1)
#: Pieces above this many bytes are merged with a heap: the same merges without a row as wide as the piece.
WIDEST = 2048


#: Unicode's White_Space. Python's \\s also has U+001C to U+001F, which the rank files' own pattern language lacks.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def piece_pattern(pattern: str) -> regex.Pattern:
    """The pattern with \\s and \\S spelt out."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]"))


class ByteBpe:
    """A rank file's vocabulary with encoding and decoding of pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.findall = piece_pattern(pattern).findall
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        size = max(self.bytes_of) + 1
        lengths = np.zeros(size, np.int64)
        for i, b in self.bytes_of.items():
            lengths[i] = len(b)
        self.token_length = lengths
        self.token_start = np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, joined = [], [], []
        for b, r in self.ranks.items():
            for cut in range(1, len(b)):
                x, y = self.ranks.get(b[:cut]), self.ranks.get(b[cut:])
                if x is not None and y is not None:
                    left.append(x), right.append(y), joined.append(r)
        self.pairs = HashTable(self._key(np.array(left, np.int64), np.array(right, np.int64)), np.array(joined), int(NO_RANK))
        self.forget()

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank, which is also the id, of each pair's join; NO_RANK if it has none or either side is padding."""
        out = np.full(left.shape, NO_RANK, np.int32)
        real = (left >= 0) & (right >= 0)
        out[real] = self.pairs.get(self._key(left[real], right[real])).astype(np.int32)
        return out

    def encode_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of similar length, all rows a round at a time."""
        out: list = [None] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        t = np.full((len(pieces), int(lengths.max()) + 1), -1, np.int32)
        t[np.repeat(np.arange(len(pieces)), lengths), ragged(np.zeros_like(lengths), lengths)] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        r = self.pair_ranks(t[:, :-1], t[:, 1:])
        row = np.arange(len(pieces))
        while len(row):
            at = r.argmin(axis=1)
            here = np.arange(len(row))
            least = r[here, at]
            done = least == NO_RANK
            if done.any():
                for i in np.flatnonzero(done):
                    out[row[i]] = t[i, : lengths[i]]
                go = ~done
                t, r, row, at, least, lengths = t[go], r[go], row[go], at[go], least[go], lengths[go]
                if not len(row):
                    break
                here = np.arange(len(row))
            lengths -= 1
            t[here, at] = least
            width = int(lengths.max())
            cols = np.arange(width + 1)[None, :]
            t = np.take_along_axis(t, np.minimum(cols + (cols > at[:, None]), t.shape[1] - 1), axis=1)
            t[here, lengths] = -1
            cols = np.arange(width)[None, :]
            r = np.take_along_axis(r, np.minimum(cols + (cols > at[:, None]), r.shape[1] - 1), axis=1)
            at = np.minimum(at, width - 1)
            r[here, at] = self.pair_ranks(t[here, at], t[here, at + 1])
            before = np.flatnonzero(at > 0)
            r[before, at[before] - 1] = self.pair_ranks(t[before, at[before] - 1], t[before, at[before]])
            r[here, lengths - 1] = NO_RANK
        return out

    def encode_wide(self, piece: bytes) -> np.ndarray:
        """The same merges, least rank first and leftmost among equals, for one very long piece."""
        get, ids = self.ranks.get, [int(x) for x in self.of_byte[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        after, before, of = list(range(1, n + 1)), list(range(-1, n - 1)), self.bytes_of
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(of[ids[i]] + of[ids[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i] if ids[i] == x else n
            if j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (s := get(of[r] + of[ids[after[j]]])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[after[j]]))
            if before[i] >= 0 and (s := get(of[ids[before[i]]] + of[r])) is not None:
                heapq.heappush(heap, (s, before[i], ids[before[i]], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > WIDEST:
                out[i] = self.encode_wide(p)
            else:
                n = len(p)
                buckets.setdefault(n if n <= 16 else 16 << (n - 1).bit_length() - 4, []).append(i)
        for n, rows in buckets.items():
            step = max(1, (1 << 20) // n)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self.encode_matrix([pieces[i] for i in part])):
                    out[i] = ids
        return out

    def forget(self) -> None:
        self.known = Numbered()
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and each text's number of ids."""
        if len(self.known) > CACHE_ENTRIES:
            self.forget()
        per, at = np.zeros(len(texts), np.int64), []
        look = self.known.__getitem__
        for i, text in enumerate(texts):
            found = self.findall(text)
            per[i] = len(found)
            at.append(np.fromiter(map(look, found), np.int64, len(found)))
        new = self.known.fresh()
        if new:
            got = self.encode_pieces([x.encode("utf-8", "replace") for x in new])
            n = np.array([len(x) for x in got], np.int64)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
            self.length, self.ids = np.concatenate([self.length, n]), np.concatenate([self.ids, *got])
        piece = np.concatenate(at) if at else np.zeros(0, np.int64)
        n = self.length[piece]
        ids = self.ids[ragged(self.start[piece], n)]
        ends = np.cumsum(per)
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, total[ends] - total[ends - per]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids; ids outside the vocabulary raise."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(self.token_length)):
            raise ValueError("id outside the vocabulary")
        return self.token_bytes[ragged(self.token_start[ids], self.token_length[ids])].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def bpe_encode(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id_col, n_tokens long, ids binary (little-endian uint32), and with decoded=True the bytes decoded from those ids.

    A map without a shuffle: each text is encoded whole in the task that reads it.
    """
    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocab_path, pattern)
        for batch, raw in slices(batches, 1):
            ids, n = bpe.encode_texts([x.decode("utf-8", "replace") for x in raw])
            ends = np.cumsum(n)
            own = [ids[e - k : e] for e, k in zip(ends, n)]
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in own], pa.binary())]
            names = ["id", "n_tokens", "ids"]
            if decoded:
                cols.append(pa.array([bpe.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in cols[2].to_pylist()], pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(encode, f"id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded)
    return out.withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and decoded binary from little-endian uint32 ids; null ids decode to nothing."""
    src = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocab_path, pattern)
        for batch, raw in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in raw], pa.binary())], names=["id", "decoded"])

    return src.mapInArrow(decode, f"id {src.schema['id'].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id_col)


def bpe_digests(df: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    done = bpe_encode(df, vocab_path, pattern, decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
