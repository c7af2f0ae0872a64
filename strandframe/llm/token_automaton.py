"""BPE encoding and decoding by a tokenization automaton.

Merges are compiled, one gadget after the other, into a deterministic automaton over tokens. It starts as one state with an
arc for each byte. The gadget of a merge (a, b -> c) takes arc b out of the state that a leads to, in a copy that only a leads
to, and gives every state that has an arc a an arc c to where b led: so a state is known by the arc that leads to it, and the
automaton accepts just the sequences of tokens that the merges give. A gadget is kept as one entry, its cut (a, b) and its
time; whether the state after x has an arc y is read from the cuts on x's line of last parts and y's line of first parts.

Words are read byte by byte. A state of the byte table is the token that ends the word so far, and the places where a longer
token may have begun, each with the token before it and its node in the tree of arc labels. Rows of that table are made from
the automaton when a word first needs them and are kept; a word is then a walk through the table, many words at a time, and
its tokens are read backwards from the last state. Decoding emits the labels of the arcs.

Null text encodes like an empty one: no ids. A text of any length is one row, cut into pieces by the pattern; added tokens
quoted in a text are found first, as the tokenizers library does. Ties don't occur: a word has one path. Repeated rows give
their result each, an empty table gives no rows, and only the columns named are read, so further columns can't clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CACHE_ENTRIES, Numbered, ragged, slices, small_batches
from .bpe import piece_pattern

#: Rows of the byte table at most (1 KB each); beyond that it is begun anew.
STATES = 1 << 17
#: Words walked through the table together, and the bytes beyond which a word is walked alone.
TOGETHER, ALONE = 4096, 128
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenAutomaton:
    """The automaton of a byte-level BPE file, its byte table, and its arcs' labels."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte_of = spec["model"], byte_letters()
        if model.get("type") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens") or []):
            raise ValueError("added tokens that take white space or whole words aren't supported")
        self.quoted = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.findall = piece_pattern(pattern).findall
        vocab = model["vocab"]
        size = max([*vocab.values(), *self.added.values()]) + 1
        label = [b""] * size
        for token, i in vocab.items():
            label[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            label[i] = token.encode()
        self.length = np.array([len(x) for x in label], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.labels = np.frombuffer(b"".join(label), np.uint8)
        self.decimal = np.array([str(i) for i in range(size)], object)
        self._compile(vocab, [m if isinstance(m, list) else m.split(" ") for m in model["merges"]], {b: vocab[c] for c, b in byte_of.items() if c in vocab})
        self._grow_tree(label)
        self.forget_states()
        self.forget_words()

    def _compile(self, vocab: dict[str, int], merges: list[list[str]], byte_ids: dict[int, int]) -> None:
        """Adds the merges' gadgets in their order."""
        if len(byte_ids) != 256:
            raise ValueError("a byte has no token")
        self.first: dict[int, int] = {}
        self.last: dict[int, int] = {}
        self.born = {i: -1 for i in byte_ids.values()}
        self.cut: dict[tuple[int, int], int] = {}
        for time, (x, y) in enumerate(merges):
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            if c in self.born:
                raise ValueError(f"two merges make the token {x + y!r}")
            if a not in self.born or b not in self.born or not self.has_arc(a, b):
                continue  # the two never meet, as earlier merges take one of them
            self.cut[a, b] = time
            self.first[c], self.last[c], self.born[c] = a, b, time

    def has_arc(self, x: int, y: int) -> bool:
        """Whether y may follow x. A copy of a state has the cuts that its original had by then, an arc those that its first part had."""
        cut, born, first, last = self.cut, self.born, self.first, self.last
        before = NEVER
        while True:
            z, until = y, NEVER
            while True:
                k = cut.get((x, z))
                if k is not None and k < before and k <= until:
                    return False
                if z not in first:
                    break
                z, until = first[z], born[z]
            if x not in last:
                return True
            x, before = last[x], born[x]

    def _grow_tree(self, label: list[bytes]) -> None:
        """The tree of the arcs' labels: child by node and byte, and the token that ends at a node."""
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for i in self.born:
            node = 0
            for byte in label[i]:
                key = node << 8 | byte
                self.inner[node] = True
                node = self.child.get(key, -1)
                if node < 0:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = i

    def forget_states(self) -> None:
        """Begins the byte table anew."""
        self.table = np.full((1024, 256), -1, np.int32)
        self.keys: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.ends = np.full(1024, -1, np.int64)
        self._state((-1, ()))

    def forget_words(self) -> None:
        """Begins the cache of words anew."""
        self.known = Numbered()
        self.word_start, self.word_length, self.word_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _state(self, key: tuple) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.keys)
            self.keys.append(key)
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.ends = np.concatenate([self.ends, np.full_like(self.ends, -1)])
            self.ends[n] = key[0]
        return n

    def _follow(self, key: tuple, byte: int) -> tuple:
        """The state after one more byte: tokens that end here, and those that may go on."""
        end, going = -1, []
        for x, node in (*key[1], (key[0], 0)):
            node = self.child.get(node << 8 | byte, -1)
            if node < 0:
                continue
            y = self.token[node]
            if end < 0 and y >= 0 and (x < 0 or self.has_arc(x, y)):
                end = y
            if self.inner[node]:
                going.append((x, node))
        return end, tuple(going)

    def _row(self, state: int, byte: int) -> int:
        n = self._state(self._follow(self.keys[state], byte))
        self.table[state, byte] = n
        return n

    def _walk_alone(self, word: bytes) -> np.ndarray:
        """Token that ends at each byte of one long word."""
        out, state = np.empty(len(word), np.int64), 0
        for i, byte in enumerate(word):
            n = int(self.table[state, byte])
            if n < 0:
                if len(self.keys) >= STATES:
                    key = self.keys[state]
                    self.forget_states()
                    state = self._state(key)
                n = self._row(state, byte)
            state = n
            out[i] = self.ends[state]
        return out

    def _walk(self, words: list[bytes]) -> np.ndarray:
        """Token that ends at each byte of each word, for words from the longest to the shortest; -1 beyond a word."""
        sizes = np.array([len(w) for w in words])
        rows, width = len(words), int(sizes[0])
        text = np.zeros((width, rows), np.int64)
        text[ragged(np.zeros_like(sizes), sizes), np.repeat(np.arange(rows), sizes)] = np.frombuffer(b"".join(words), np.uint8)
        out = np.full((width, rows), -1, np.int64)
        state = np.zeros(rows, np.int64)
        for i in range(width):
            n = int(np.searchsorted(-sizes, -i, side="left"))  # words longer than i
            s, byte = state[:n], text[i, :n]
            to = self.table[s, byte]
            if (to < 0).any():
                for code in np.unique((s << 8 | byte)[to < 0]).tolist():
                    self._row(code >> 8, code & 255)
                to = self.table[s, byte]
            state[:n] = to
            out[i, :n] = self.ends[to]
        return out

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words, none of them empty."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        far = 0
        while far < len(order) and len(words[order[far]]) > ALONE:
            far += 1
        for i in order[:far]:
            ends, ids, at = self._walk_alone(words[i]), [], len(words[i])
            while at:
                ids.append(int(ends[at - 1]))
                at -= int(self.length[ids[-1]])
            out[i] = np.array(ids[::-1], np.int32)
        while far < len(order):
            part = order[far : far + min(TOGETHER, STATES // 2 // len(words[order[far]]))]
            far += len(part)
            if len(self.keys) + sum(len(words[i]) for i in part) > STATES:
                self.forget_states()
            ends = self._walk([words[i] for i in part])
            at, ids, rows = np.array([len(words[i]) for i in part]), [], []
            live = np.arange(len(part))
            while len(live):  # tokens of all words, from their ends backwards
                token = ends[at[live] - 1, live]
                ids.append(token), rows.append(live)
                at[live] -= self.length[token]
                live = live[at[live] > 0]
            row = np.concatenate(rows[::-1])
            sort = np.argsort(row, kind="stable")
            flat, n = np.concatenate(ids[::-1])[sort].astype(np.int32), np.bincount(row, minlength=len(part))
            for i, x in zip(part, np.split(flat, np.cumsum(n)[:-1])):
                out[i] = x
        return out

    def _pieces(self, text: str) -> list:
        """Words of a text, and the ids of added tokens that it quotes."""
        if not self.quoted:
            return self.findall(text)
        out, at = [], 0
        for m in self.quoted.finditer(text):
            out += self.findall(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self.findall(text[at:]) if at else self.findall(text)

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and each text's number of ids."""
        if len(self.known) > CACHE_ENTRIES:
            self.forget_words()
        per, at, look = np.zeros(len(texts), np.int64), [], self.known.__getitem__
        for i, text in enumerate(texts):
            found = self._pieces(text)
            per[i] = len(found)
            at.append(np.fromiter(map(look, found), np.int64, len(found)))
        if new := self.known.fresh():
            words = [x.encode("utf-8", "replace") for x in new if isinstance(x, str)]
            got = iter(self.encode_words(words))
            got = [next(got) if isinstance(x, str) else np.array([x], np.int32) for x in new]
            n = np.array([len(x) for x in got], np.int64)
            self.word_start = np.concatenate([self.word_start, len(self.word_ids) + np.cumsum(n) - n])
            self.word_length, self.word_ids = np.concatenate([self.word_length, n]), np.concatenate([self.word_ids, *got])
        word = np.concatenate(at) if at else np.zeros(0, np.int64)
        n = self.word_length[word]
        total, ends = np.concatenate([[0], np.cumsum(n)]), np.cumsum(per)
        return self.word_ids[ragged(self.word_start[word], n)], total[ends] - total[ends - per]

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the ids' arcs, one after another; bytes that aren't UTF-8 become U+FFFD, ids without an arc raise."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(self.length)):
            raise ValueError("id outside the vocabulary")
        return self.labels[ragged(self.start[ids], self.length[ids])].tobytes().decode("utf-8", "replace")

    def join(self, ids: np.ndarray) -> str:
        return ",".join(self.decimal[ids].tolist())


@lru_cache(maxsize=2)
def automaton(path: str, pattern: str) -> TokenAutomaton:
    return TokenAutomaton(path, pattern)


def automaton_encode(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, joined: bool = False) -> DataFrame:
    """id_col, n_tokens long, ids binary (little-endian uint32); decoded=True adds the text decoded from those ids, joined=True the ids in decimal with commas.

    A map without a shuffle: each text is encoded whole in the task that reads it.
    """
    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = automaton(vocab_path, pattern)
        for batch, raw in slices(batches, 1):
            ids, n = bpe.encode_texts([x.decode("utf-8", "replace") for x in raw])
            ends = np.cumsum(n)
            own = [ids[e - k : e] for e, k in zip(ends, n)]
            cols = {"id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array([x.astype("<u4").tobytes() for x in own], pa.binary())}
            if decoded:
                cols["decoded"] = pa.array([bpe.decode(x) for x in own], pa.string())
            if joined:
                cols["joined"] = pa.array([bpe.join(x) for x in own], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(encode, f"id {kind}, n_tokens long, ids binary" + ", decoded string" * decoded + ", joined string" * joined)
    return out.withColumnRenamed("id", id_col)


def automaton_decode(df: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and decoded string from little-endian uint32 ids; null ids decode to nothing."""
    src = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = automaton(vocab_path, pattern)
        for batch, raw in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in raw], pa.string())], names=["id", "decoded"])

    return src.mapInArrow(decode, f"id {src.schema['id'].dataType.simpleString()}, decoded string").withColumnRenamed("id", id_col)


def automaton_digests(df: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 of every document."""
    done = automaton_encode(df, vocab_path, pattern, decoded=True, joined=True)
    return done.select("doc_id", "n_tokens", F.sha2(F.col("joined").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
