"""Features and logistic models that the mixing and quality operators train here.

A text's content features are its distinct words and word shapes, hashed, and, if wanted, statistics of its
lines and characters in steps; each has the same weight, scaled to unit length. A page's metadata features come
from recorded columns alone, never from the text. Models are fitted on the driver, on bounded samples whose
bounds are parameters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CACHE_ENTRIES, Numbered, slices, small_batches

BUCKETS = 1 << 18
#: Buckets of metadata features.
PAGE_BUCKETS = 1 << 12
#: Steps in a unit of a text's statistics, and the last of them.
FINE, TOP = 40, 200


LETTERS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def shape(word: str) -> str:
    """Runs of capitals, other letters and digits as A, a and 0; other characters stay."""
    stem = word.rstrip(".,;:!?")
    if stem.isalpha():  # the same, sooner
        return ("A" if len(stem) > 1 and stem[0].isupper() else "a") + word[len(stem) :]
    out = LETTERS.sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", word)
    return DIGITS.sub("0", out)


class Content:
    """Hashed features of words, remembered."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.known, self.of, self.shapes = Numbered(), np.zeros((1 << 12, 2), np.int32), {}

    def learn(self, first: int, words: list[bytes]) -> None:
        while first + len(words) > len(self.of):
            self.of = np.concatenate([self.of, np.zeros_like(self.of)])
        for i, w in enumerate(words, first):
            form = shape(w.decode("utf-8", "replace"))
            if form not in self.shapes:
                self.shapes[form] = xxhash.xxh32_intdigest(form, 1) % BUCKETS
            self.of[i] = xxhash.xxh32_intdigest(w.lower().strip(b".,;:!?")) % BUCKETS, self.shapes[form]

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features, ascending, and the words' numbers in order."""
        words = raw.split()
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        new = self.known.fresh()
        if new:
            self.learn(len(self.known) - len(new), new)
        return np.unique(self.of[np.unique(at)]), at


def layout(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Hashed steps that statistics of a text with word numbers `at` reach: size, lines, capitals, digits, marks, spaces, distinct and doubled words."""
    b = np.frombuffer(raw, np.uint8)
    n, lines = max(1, len(b)), int((b == 10).sum()) + 1
    upper, digit = ((b >= 65) & (b <= 90)).sum(), ((b >= 48) & (b <= 57)).sum()
    odd = ((b >= 33) & (b <= 47) | (b >= 58) & (b <= 64) | (b >= 91) & (b <= 96) | (b >= 123) & (b <= 126)).sum()
    spaces = (b == 32).sum()
    words = max(1, len(at))
    x = (np.log1p(n) / 10, np.log1p(lines) / 5, np.log1p(n / lines) / 8, upper / n * 3, digit / n * 3, odd / n * 5, spaces / n * 3, len(np.unique(at)) / words, (at[1:] == at[:-1]).sum() / words * 3)
    return np.concatenate([steps(i)[: min(int(v * FINE), TOP) + 1] for i, v in enumerate(x)])


@lru_cache(maxsize=None)
def steps(i: int) -> np.ndarray:
    """Features of a statistic's steps: a value has those up to its own."""
    return np.array([xxhash.xxh32_intdigest(f"{i}:{k}", 2) % BUCKETS for k in range(TOP + 1)], np.int32)


def metadata(source: str | None, lang: str | None, n_chars: str | None) -> np.ndarray:
    """Hashed features of a page's recorded source, language and size, and of pairs of them; nulls have none."""
    size = None if n_chars is None else (int(n_chars) ** 2).bit_length()  # half powers of two
    own = {"source": source, "lang": lang, "size": size}
    names = [f"{k}:{v}" for k, v in own.items() if v is not None]
    names += [f"{a}:{own[a]}/{b}:{own[b]}" for a, b in (("source", "lang"), ("source", "size"), ("lang", "size")) if own[a] is not None and own[b] is not None]
    return np.unique(np.array([xxhash.xxh32_intdigest(x, 3) % PAGE_BUCKETS for x in names], np.int32))


def with_layout(found: tuple[np.ndarray, np.ndarray], raw: bytes) -> np.ndarray:
    return np.unique(np.concatenate([found[0], layout(raw, found[1])]))


def features(df: DataFrame, keep: list[str], page: list[str]) -> DataFrame:
    """The kept columns with content and, of the columns source, lang and n_chars named in page, metadata: int32 features as bytes; df needs text.

    With page columns the content has the text's statistics, too.
    """
    small_batches(df.sparkSession)
    schema = df.select(*keep).schema
    m = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = Content()
        for batch, raw in slices(batches, m):
            if len(content.known) > CACHE_ENTRIES:
                content.forget()
            both = [content(x) for x in raw]
            own = [with_layout(f, x) for f, x in zip(both, raw)] if page else [f for f, _ in both]
            rows = zip(*(batch.column(m + 1 + i).to_pylist() for i in range(len(page)))) if page else ()
            cols = [*(batch.column(i) for i in range(m)), pa.array([f.astype("<i4").tobytes() for f in own], pa.binary())]
            if page:
                cols.append(pa.array([metadata(*r).astype("<i4").tobytes() for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "content", *["page"] * bool(page)])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return df.select(*keep, F.col("text").cast("string"), *[F.col(c).cast("string").alias(f"page_{c}") for c in page]).mapInArrow(run, f"{kinds}, content binary" + ", page binary" * bool(page))


class Sparse:
    """Rows of unit-length 0/1 features below `width`."""

    def __init__(self, rows: list[np.ndarray], width: int = BUCKETS):
        self.n = np.fromiter(map(len, rows), np.int64, len(rows))
        self.col = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(rows)), self.n)
        self.value = np.repeat(1 / np.sqrt(np.maximum(self.n, 1)), self.n)
        self.shape = (len(rows), width)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, w[self.col, k] * self.value, minlength=self.shape[0]) for k in range(w.shape[1])], axis=1)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.col, g[self.row, k] * self.value, minlength=self.shape[1]) for k in range(g.shape[1])], axis=1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: Sparse, y: np.ndarray, classes: int, steps: int = 80, rate: float = 0.5, ridge: float = 1e-5, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic weights and offsets by Adam over the whole sample."""
    w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
    if not x.shape[0]:
        return w, b
    weight = np.ones(len(y)) if weight is None else weight
    goal = np.eye(classes)[y]
    b = np.log((goal * weight[:, None]).sum(axis=0) + 0.5)
    b -= b.mean()
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        g = (softmax(x.times(w) + b) - goal) * weight[:, None] / weight.sum()
        for k, (p, d) in enumerate(((w, x.back(g) + ridge * w), (b, g.sum(axis=0)))):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return w, b


def sampled(df: DataFrame, bound: int, salt: str, id_col: str = "doc_id") -> DataFrame:
    """About `bound` rows, chosen by a hash of the id; all of them if there are fewer."""
    n = df.count()
    dice = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(salt)), F.lit(1 << 30)) / (1 << 30)
    return df if n <= bound else df.where(dice < bound / n)


def one_label(labels: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with their labels; of several label rows of one document the least counts, and rows without label go."""
    least = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.min(F.struct(*columns)).alias("label"))
    joined = docs.join(least, docs["doc_id"] == least["label_id"]).select(*docs.columns, *[F.col(f"label.{c}").alias(f"label_{c}") for c in columns])
    return joined.where(" and ".join(f"label_{c} is not null" for c in columns))
