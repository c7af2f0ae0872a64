"""Language identification by unigram models that sum over all segmentations.

Each language has a probability for every piece of one fixed public vocabulary. A word's probability is
the sum, over all ways to cut it into pieces, of the product of their probabilities: a forward pass over
the word's characters. A text's is the product over its words, and Bayes' rule with the languages' shares
gives the score. Expectation maximisation learns the piece probabilities from word counts: backward passes
turn them into expected piece counts, summed over the cluster in each round.

Words are runs between white space, lower-cased, with all but letters removed. A character that no piece
covers alone has a small fixed probability in every language. Null text, and text without a letter, is
`und` with score 0. A long text is one row in a worker's memory; a long word takes time in proportion to its
letters, and about as much memory for each letter as the longest piece has. Languages equally likely go by name.
Rows whose label is null don't teach; a table without labelled rows makes every text `und`. Empty tables give no
rows, repeated rows each a result, and other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import CACHE_ENTRIES, HashTable, Numbered, discard, materialize, run_sums, slices, small_batches

MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Probability of a character outside the vocabulary, in every language.
UNKNOWN = 1e-7
#: Pseudo-count of each piece.
PRIOR = 0.1


def hash_text(codes: np.ndarray) -> np.uint64:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in codes:
            h = h * BASE + np.uint64(c) + np.uint64(1)
    return h


def vocabulary_pieces(path: str) -> list[str]:
    """Lower-case letter pieces of a sentencepiece model, with and without the mark of a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in found if p.replace(MARK, "").isalpha() or p == MARK})


class Pieces:
    """The vocabulary as hashes; finds the pieces at every place of many words at once."""

    def __init__(self, pieces: list[str]):
        self.size, self.longest = len(pieces), max(map(len, pieces), default=1)
        self.table = HashTable(np.array([hash_text([ord(c) for c in p]) for p in pieces], np.uint64), np.arange(len(pieces)), len(pieces))

    def at(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each piece length l, the piece from each place; size: none, size + 1: a lone unknown character."""
        codes, h, out = codes.astype(np.uint64) + np.uint64(1), None, []
        for l in range(1, min(self.longest, codes.shape[1]) + 1):
            h = codes if h is None else h[:, :-1] * BASE + codes[:, l - 1 :]
            got = self.table.get(h.ravel()).reshape(h.shape)
            out.append(np.where(got == self.size, self.size + 1, got) if l == 1 else got)
        return out


def forward(at: list[np.ndarray], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward sums (words, places + 1, languages) and the logs of the scales (words, places + 1); all pieces that end at a place are taken at once."""
    (n, width), longest = at[0].shape, len(at)
    ends = np.full((width + 1, n, longest), len(p) - 2)  # the last but one row of p stands for no piece
    for l, ids in enumerate(at, 1):
        ends[l:, :, longest - l] = ids.T
    alpha, log = np.zeros((n, width + 1, p.shape[1])), np.zeros((n, width + 1))
    alpha[:, 0] = 1
    for j in range(1, width + 1):
        m = min(longest, j)
        scale = np.exp(log[:, j - m : j] - log[:, j - 1 : j])
        alpha[:, j] = np.einsum("nmk,nmk,nm->nk", alpha[:, j - m : j], p[ends[j, :, longest - m :]], scale)
        top = np.maximum(alpha[:, j].max(axis=1), 1e-300)
        alpha[:, j] /= top[:, None]
        log[:, j] = log[:, j - 1] + np.log(top)
    return alpha, log


def backward(at: list[np.ndarray], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    (n, width), longest = at[0].shape, len(at)
    starts = np.full((width, n, longest), len(p) - 2)
    for l, ids in enumerate(at, 1):
        starts[: width - l + 1, :, l - 1] = ids.T
    beta, log = np.zeros((n, width + 1, p.shape[1])), np.zeros((n, width + 1))
    beta[:, width] = 1
    for i in range(width - 1, -1, -1):
        m = min(longest, width - i)
        scale = np.exp(log[:, i + 1 : i + m + 1] - log[:, i + 1 : i + 2])
        beta[:, i] = np.einsum("nmk,nmk,nm->nk", beta[:, i + 1 : i + m + 1], p[starts[i, :, :m]], scale)
        top = np.maximum(beta[:, i].max(axis=1), 1e-300)
        beta[:, i] /= top[:, None]
        log[:, i] = log[:, i + 1] + np.log(top)
    return beta, log


def expected_pieces(finder: Pieces, p: np.ndarray, words: list[str], weight: np.ndarray) -> np.ndarray:
    """How often each row of p is expected in the words' segmentations, by language; weight is words x languages."""
    total = np.zeros(p.shape)
    for part, codes in by_length(words):
        at = finder.at(codes)
        alpha, la = forward(at, p)
        beta, lb = backward(at, p)
        share = weight[part] / np.maximum(alpha[:, -1], 1e-300)
        for l, ids in enumerate(at, 1):
            row, i = np.nonzero(ids != finder.size)
            scale = np.exp(la[row, i] + lb[row, i + l] - la[row, -1])[:, None]
            piece = ids[row, i]
            here = alpha[row, i] * p[piece] * beta[row, i + l] * scale * share[row]
            for k in range(p.shape[1]):
                total[:, k] += np.bincount(piece, here[:, k], minlength=len(p))
    return total


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def by_length(words: list[str], cells: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of words of one length, marked and as code points, with their places in the list."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, cuts):
        if not len(group) or not size[group[0]]:
            continue
        step = max(1, cells // int(size[group[0]]))
        for k in range(0, len(group), step):
            part = group[k : k + step]
            codes = np.frombuffer("".join(MARK + words[i] for i in part).encode("utf-32-le", "replace"), np.uint32)
            yield part, codes.reshape(len(part), -1)


@dataclass
class LanguageModel:
    languages: list[str]
    shares: np.ndarray
    pieces: list[str]
    probabilities: np.ndarray  # pieces x languages
    usual: np.ndarray | None = None  # each language's mean negative log probability of a letter in its own texts

    def table(self) -> np.ndarray:
        k = len(self.languages)
        return np.concatenate([self.probabilities, np.zeros((1, k)), np.full((1, k), UNKNOWN)])

    def score_words(self, finder: Pieces, words: list[str]) -> np.ndarray:
        out, p = np.zeros((len(words), len(self.languages))), self.table()
        for part, codes in by_length(words):
            alpha, log = forward(finder.at(codes), p)
            with np.errstate(divide="ignore"):
                out[part] = np.maximum(np.log(alpha[:, -1]) + log[:, -1][:, None], -60 * codes.shape[1])
        return out


@lru_cache(maxsize=2)
def _finder(pieces: tuple[str, ...]) -> Pieces:
    return Pieces(list(pieces))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to about that many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def count_words(df: DataFrame) -> DataFrame:
    """word, k, n: how often each word stands in texts of language number k, from columns k and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = [(w, k, n) for (w, k), n in seen.items()]
            seen.clear()
            w, k, n = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(k, pa.int32()), pa.array(n, pa.int64())], names=["word", "k", "n"])

        for batch, raw in slices(batches, 1):
            for k, x in zip(batch.column(0).to_pylist(), raw):
                for w, n in Counter(x.decode("utf-8", "replace").lower().split()).items():
                    if w := letters(w):
                        seen[w, k] += n
            if len(seen) > CACHE_ENTRIES:
                yield out()
        yield out()

    return df.select("k", "text").mapInArrow(run, "word string, k int, n long").groupBy("word", "k").agg(F.sum("n").alias("n"))


def train(df: DataFrame, vocab_path: str, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 5000, rounds: int = 4) -> LanguageModel:
    """Learns from labelled rows where `learn` holds: about docs_per_language texts of each label, chosen by a hash of the id."""
    small_batches(df.sparkSession)
    rows = df.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    languages, pieces = sorted(have), vocabulary_pieces(vocab_path)
    if not languages:
        return LanguageModel([], np.zeros(0), pieces, np.zeros((len(pieces), 0)))
    share = np.array([have[x] for x in languages], float)
    rate = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, docs_per_language / have[x]))])
    number = F.create_map(*[F.lit(v) for i, x in enumerate(languages) for v in (x, i)])
    dice = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language")), F.lit(1 << 30)) / (1 << 30)
    sample = rows.where(dice < rate[F.col("lang")]).select(number[F.col("lang")].cast("int").alias("k"), "text")
    counts = materialize(count_words(sample).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("n")), "word-counts")

    size, k = len(pieces), len(languages)
    p = np.full((size, k), 1.0 / size)
    held = tuple(pieces)
    for _ in range(rounds):
        table = np.concatenate([p, np.zeros((1, k)), np.full((1, k), UNKNOWN)])

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder, total = _finder(held), np.zeros((size + 2, k))
            for table_ in gathered(batches, 20_000):
                words = table_.column(0).to_pylist()
                weight = np.zeros((len(words), k))
                for i, pairs in enumerate(table_.column(1).to_pylist()):
                    for lang, n in pairs:
                        weight[i, lang] = n
                total += expected_pieces(finder, table, words, weight)
            some = np.flatnonzero(total[:size].any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(total[some, j]) for j in range(k)]], names=["piece", *[f"e{j}" for j in range(k)]])

        sums = counts.mapInArrow(expect, "piece int, " + ", ".join(f"e{j} double" for j in range(k))).groupBy("piece").agg(*[F.sum(f"e{j}").alias(f"e{j}") for j in range(k)])
        e = np.full((size, k), PRIOR)
        for r in sums.collect():  # the vocabulary's size at most
            e[r[0]] += r[1:]
        p = e / e.sum(axis=0)
    model = LanguageModel(languages, share / share.sum(), pieces, p)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, total = _finder(held), np.zeros((2, k))
        for table_ in gathered(batches, 20_000):
            words = table_.column(0).to_pylist()
            logs = model.score_words(finder, words)
            for i, pairs in enumerate(table_.column(1).to_pylist()):
                for lang, n in pairs:
                    total[:, lang] += n * logs[i, lang], n * len(words[i])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.ravel()], names=[f"w{j}" for j in range(2 * k)])

    sums = np.array([x or 0.0 for x in counts.mapInArrow(weigh, ", ".join(f"w{j} double" for j in range(2 * k))).agg(*[F.sum(f"w{j}") for j in range(2 * k)]).first()]).reshape(2, k)
    model.usual = -sums[0] / np.maximum(sums[1], 1)
    discard(counts)
    return model


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), most: float = 2.2, letters_to_tell: int = 30) -> DataFrame:
    """id_col, lang_pred, score and foreign of every row, from its text alone, in a map without a shuffle.

    The score compares the learned languages with each other; foreign says that a text of enough letters to tell is in none of them: its
    letters cost more than `most` times what those of the likeliest language's own texts do. The columns named in
    carry come along unchanged; none of them may have the name of a result.
    """
    small_batches(df.sparkSession)
    more = ["text" if c == text_col else f"carried_{i}" for i, c in enumerate(carry)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(tuple(model.pieces))
        known, logs, sizes, k = Numbered(), np.zeros((0, len(model.languages))), np.zeros(0, np.int64), len(model.languages)
        for batch, raw in slices(batches, 1):
            if len(known) > CACHE_ENTRIES:
                known, logs, sizes = Numbered(), np.zeros((0, k)), np.zeros(0, np.int64)
            at = []
            for x in raw:
                words = x.decode("utf-8", "replace").lower().split()
                at.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            new = [letters(w) for w in known.fresh()]
            if new:
                logs = np.concatenate([logs, model.score_words(finder, new)])
                sizes = np.concatenate([sizes, np.fromiter(map(len, new), np.int64, len(new))])
            n, flat = np.fromiter(map(len, at), np.int64, len(at)), np.concatenate(at)
            has = run_sums((sizes[flat] > 0).astype(float), n) > 0
            lang, score, foreign = ["und"] * len(raw), np.zeros(len(raw)), np.zeros(len(raw), bool)
            if k:
                own = np.stack([run_sums(logs[flat, j], n) for j in range(k)], axis=1)
                log = own + np.log(model.shares)
                best = log.argmax(axis=1)
                if model.usual is not None:
                    size = run_sums(sizes[flat].astype(float), n)
                    foreign = (size >= letters_to_tell) & (-own[np.arange(len(raw)), best] > most * model.usual[best] * size)
                odds = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
                for i in np.flatnonzero(has):
                    lang[i], score[i] = model.languages[best[i]], odds[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(np.minimum(score, 1.0)), pa.array(foreign), *(batch.column(m) for m in more)], names=["id", "lang_pred", "score", "foreign", *more])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(m) for c, m in zip(carry, more) if m != "text"])
    kinds = "".join(f", {m} {src.schema[m].dataType.simpleString()}" for m in more)
    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, lang_pred string, score double, foreign boolean{kinds}")
    return out.withColumnsRenamed({"id": id_col, **dict(zip(more, carry))})


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def identify(df: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from the labelled rows that aren't held out, then predicts all."""
    model = train(df, vocab_path, ~held_out() & F.col("doc_id").isNotNull())
    return predict(df, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
