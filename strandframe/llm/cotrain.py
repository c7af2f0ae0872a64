"""Co-training of a quality classifier on two views of a page.

One classifier sees a document's content, its hashed words, word shapes and statistics of its text; the other its
page's recorded metadata alone: source, language, and size. Each learns from the labelled documents. In every round each
scores every unlabelled document, in a map, and the ones it is surest of, in the classes' proportions, become
pseudo-labels of the other view: those at or above a threshold of log-odds, read from a summed histogram, so that
equally sure ones come in together. The views then learn on, by gradients that are the driver's sum over the labelled
sample plus the executors' sums over all pseudo-labelled documents. At last each view is calibrated on labelled
documents that neither learnt from, and the calibrated log-odds, weighted by how well each view orders those, make
the score of every document.

Only the labelled sample is bounded, by a parameter; every unlabelled document takes part in each round, and every
document is scored, whole: a long text is one row in a worker's memory, and its features are no more than its distinct
words. Null text is empty; null metadata has no feature. Documents without doc_id are scored but don't teach, nor do
rows whose label is null; of several label rows of a document the least counts. With labels of one class only, or
none, the score is that class's share, 0.5 if there is none. Repeated rows each get a score, and empty tables give no
rows. Columns other than doc_id, text, source, lang and n_chars aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import CACHE_ENTRIES, discard, materialize, partitions, sieve, slices, small_batches
from .classify import BUCKETS, PAGE_BUCKETS, Content, Sparse, features, metadata, one_label, sampled, with_layout

PAGE = ["source", "lang", "n_chars"]
#: Buckets of each view's features.
WIDTHS = (BUCKETS, PAGE_BUCKETS)
#: Weight of a pseudo-label; a label has 1.
PSEUDO = 0.5
#: Bins of log-odds in a unit, and the log-odds from which all are in one bin.
BINS, FAR = 256, 4096
#: Numbers of a gradient in one row.
BLOCK = 4096
#: Partitions of a shuffle for one task of a gradient, if that leaves each core one: each sends a sum about as large, however few rows it has.
SPARE = 4
#: How features are written: ascending numbers, of whose bytes half say little.
PACKED = "zstd"


class Fit:
    """A view's logistic weights, (-w, w) for the classes, and the state of their fit by Adam."""

    def __init__(self, width: int, rate: float, y: np.ndarray, ridge: float = 1e-5):
        self.w, self.b = np.zeros(width), np.array([np.log(((y == 1).sum() + 0.5) / ((y == 0).sum() + 0.5)) / 2])
        self.m, self.v = ([np.zeros(width), np.zeros(1)] for _ in range(2))
        self.rate, self.ridge, self.t = rate, ridge, 0

    def log_odds(self, x: Sparse) -> np.ndarray:
        return log_odds(self.w, self.b[0], x)

    def step(self, g: np.ndarray) -> None:
        """g: sums over rows of the gradient by each weight, then by the offset, then of the rows' weights."""
        self.t += 1
        for k, (p, d) in enumerate(((self.w, g[:-2] / g[-1] + self.ridge * self.w), (self.b, g[-2:-1] / g[-1]))):
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.v[k] = 0.99 * self.v[k] + 0.01 * d * d
            p -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)


def log_odds(w: np.ndarray, b: float, x: Sparse) -> np.ndarray:
    return 2 * (x.times(w[:, None])[:, 0] + b)


def gradient(w: np.ndarray, b: float, x: Sparse, y: np.ndarray, weight: float) -> np.ndarray:
    """As Fit.step takes it."""
    r = weight * (1 / (1 + np.exp(-np.clip(log_odds(w, b, x), -500, 500))) - y)
    return np.concatenate([x.back(r[:, None])[:, 0], [r.sum(), weight * len(y)]])


def views_of(batch: pa.RecordBatch) -> tuple[Sparse, Sparse]:
    """Both views of a batch with columns content and page."""
    return tuple(Sparse([np.frombuffer(x, "<i4") for x in batch.column(c).to_pylist()], width) for c, width in zip(("content", "page"), WIDTHS))


def histogram(pool: DataFrame, views: list[tuple[np.ndarray, float]], least: float) -> list[dict[int, dict[int, int]]]:
    """For each view and label the number of documents in each bin of the log-odds for that label, from `least` up."""
    sent = pool.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            if not batch.num_rows:
                continue
            for v, (x, (w, b)) in enumerate(zip(views_of(batch), sent.value)):
                z = log_odds(w, b, x)
                for label, q in ((1, z), (0, -z)):
                    for k, n in zip(*(a.tolist() for a in np.unique(bins(q[q >= least]), return_counts=True))):
                        counts[v, label, k] += n
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int64()) for i in range(3)), pa.array([counts[k] for k in keys], pa.int64())], names=["v", "label", "bin", "n"])

    out: list[dict[int, dict[int, int]]] = [{0: {}, 1: {}}, {0: {}, 1: {}}]
    for r in pool.mapInArrow(run, "v long, label long, bin long, n long").groupBy("v", "label", "bin").agg(F.sum("n").alias("n")).collect():  # one row for each bin
        out[r["v"]][r["label"]][r["bin"]] = r["n"]
    sent.destroy()
    return out


def bins(q: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(q, -FAR, FAR) * BINS).astype(np.int64)


def threshold(counts: dict[int, int], n: int) -> int | None:
    """The greatest bin so that n documents are in it or above; the least if there are fewer, none if n is 0."""
    if n <= 0 or not counts:
        return None
    total = 0
    for k in sorted(counts, reverse=True):
        total += counts[k]
        if total >= n:
            break
    return k


def pseudo_labels(z: np.ndarray, bounds: dict[int, int | None], least: float) -> np.ndarray:
    """1, 0 or -1 for none, by a view's log-odds."""
    out = np.full(len(z), -1)
    for label, q in ((1, z), (0, -z)):
        if bounds[label] is not None:
            out[(q >= least) & (bins(q) >= bounds[label])] = label
    return out


def exchanged(pool: DataFrame, rounds: list[tuple[list[tuple[np.ndarray, float]], list[dict[int, int | None]]]], least: float) -> DataFrame:
    """content, page, y0 and y1 of documents with a pseudo-label for either view, -1 where there is none: the first that the other view gave in any round."""
    sent = pool.sparkSession.sparkContext.broadcast(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = views_of(batch), np.full((2, batch.num_rows), -1)
            for views, bounds in sent.value:
                for v, (w, b) in enumerate(views):
                    own = y[1 - v]
                    own[:] = np.where(own >= 0, own, pseudo_labels(log_odds(w, b, x[v]), bounds[v], least))
            out = pa.RecordBatch.from_arrays([batch.column("content"), batch.column("page"), *(pa.array(a.astype(np.int32)) for a in y)], names=["content", "page", "y0", "y1"])
            yield out.filter(pa.array((y >= 0).any(axis=0)))

    out = materialize(pool.select("content", "page").mapInArrow(run, "content binary, page binary, y0 int, y1 int"), "pseudo-labels", PACKED)
    sent.destroy()
    return out


def gathered(pseudo: DataFrame) -> DataFrame:
    """The rows in as many partitions as a gradient has tasks, at most."""
    spark = pseudo.sparkSession
    return pseudo.coalesce(max(1, spark.sparkContext.defaultParallelism, partitions(spark) // SPARE))


def gradient_sums(pseudo: DataFrame, views: list[tuple[np.ndarray, float]]) -> list[np.ndarray]:
    """Each view's gradient over its pseudo-labelled documents; partitions' sums are summed in tasks, block by block, before the driver gets one gradient."""
    sent = pseudo.sparkSession.sparkContext.broadcast(views)
    ends = np.cumsum([0, *(w + 2 for w in WIDTHS)])
    size = int(-(-ends[-1] // BLOCK) * BLOCK)

    def rows(total: np.ndarray) -> pa.RecordBatch:
        parts = total.reshape(-1, BLOCK)
        own = [(k, np.flatnonzero(x)) for k, x in enumerate(parts)]
        own = [(k, at) for k, at in own if len(at)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int32()), pa.array([at.astype("<u2").tobytes() for _, at in own], pa.binary()), pa.array([parts[k][at].astype("<f4").tobytes() for k, at in own], pa.binary())], names=["block", "at", "total"])

    def put(total: np.ndarray, block: int, at: bytes, x: bytes) -> None:
        total[block * BLOCK + np.frombuffer(at, "<u2").astype(np.int64)] += np.frombuffer(x, "<f4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            for v in range(len(WIDTHS)):
                y = batch.column(f"y{v}").to_numpy()
                some = batch.filter(pa.array(y >= 0))
                if some.num_rows:
                    total[ends[v] : ends[v + 1]] += gradient(*sent.value[v], views_of(some)[v], y[y >= 0], PSEUDO)
        yield rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                put(total, *row)
        yield rows(total)

    kind = "block int, at binary, total binary"
    parts = gathered(pseudo).mapInArrow(run, kind).repartition(min(partitions(pseudo.sparkSession), size // BLOCK), "block").mapInArrow(add, kind)
    total = np.zeros(size)
    for row in parts.collect():  # one gradient
        put(total, *row)
    sent.destroy()
    return [total[a:b] for a, b in zip(ends, ends[1:])]


def platt(z: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[float, float]:
    """Slope and offset that make log-odds of z, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * z).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b])
        q = p * (1 - p)
        h = np.array([[(q * z * z).sum() + 0.01, (q * z).sum()], [(q * z).sum(), q.sum() + 0.01]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return max(float(a), 0.0), float(b)


def loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y == 1, -z, z)).mean()) if len(y) else 1.0


class CoTrained:
    """Two views' weights, calibrations and weights in the score."""

    def __init__(self, share: float):
        self.share, self.views = share, None

    @classmethod
    def learn(cls, content: list[np.ndarray], page: list[np.ndarray], y: np.ndarray, test: np.ndarray, pool: DataFrame, rounds: int, sure: float, most: float, passes: int) -> CoTrained:
        teach = ~test
        out = cls(float(y.mean()) if len(y) else 0.5)
        if len(set(y[teach].tolist())) < 2 or len(set(y[test].tolist())) < 2:
            return out
        own = [Sparse([x for x, t in zip(rows, teach) if t], width) for width, rows in zip(WIDTHS, (content, page))]
        fits = [Fit(width, rate, y[teach]) for width, rate in zip(WIDTHS, (0.5, 0.2))]
        for fitted, x, steps in zip(fits, own, (60, 120)):
            for _ in range(steps):
                fitted.step(gradient(fitted.w, fitted.b[0], x, y[teach], 1.0))
        pool = materialize(pool, "unlabelled", PACKED)
        n, least, done = pool.count(), float(np.log(sure / (1 - sure))), []
        for _ in range(rounds if n else 0):
            now = [(f.w.copy(), float(f.b[0])) for f in fits]
            counts = histogram(pool, now, least)
            done.append((now, [{label: threshold(c[label], int(most * n * (out.share if label else 1 - out.share))) for label in (0, 1)} for c in counts]))
            pseudo = exchanged(pool, done, least)
            for _ in range(passes):
                sums = gradient_sums(pseudo, [(f.w, float(f.b[0])) for f in fits])
                for fitted, x, more in zip(fits, own, sums):
                    fitted.step(gradient(fitted.w, fitted.b[0], x, y[teach], 1.0) + more)
            discard(pseudo)
        discard(pool)
        views = []
        for fitted, width, rows in zip(fits, WIDTHS, (content, page)):
            z = fitted.log_odds(Sparse([x for x, t in zip(rows, test) if t], width))
            a, b = platt(z, y[test])
            views.append((np.stack([-fitted.w, fitted.w], axis=1), np.array([-fitted.b[0], fitted.b[0]]), a, b, 1 / max(loss(a * z + b, y[test]), 1e-2)))
        total = sum(v[-1] for v in views)
        out.views = [(w, b, a, c, k / total) for w, b, a, c, k in views]
        return out


def unlabelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """content and page of every document that has a doc_id and no row in labels; only ids are shuffled, and the few texts that two sieves can't tell."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *PAGE).where("doc_id is not null")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    marked = sieve(known, "doc_id")(own)
    held = marked.where("maybe").drop("maybe")
    astray = held.select("doc_id").join(known, "doc_id", "left_anti").distinct()  # ids that the sieve held wrongly
    freed = sieve(astray, "doc_id")(held).where("maybe").drop("maybe").join(known, "doc_id", "left_anti")
    bare = marked.where("not maybe").drop("maybe").unionByName(freed)
    return features(bare, ["doc_id"], PAGE).select("content", "page")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = 5000, rounds: int = 3, sure: float = 0.9, most: float = 0.1, passes: int = 8) -> CoTrained:
    """Learns from about `labelled` labelled and all unlabelled documents; `most` is about the share of those that a view labels in a round, `passes` the gradient steps over them.

    Log-odds are taken by bins of 1/256, and the bin in which `most` is reached comes in whole, so documents that a view can't tell apart are labelled together: where a view
    has few different inputs, as metadata do, one bin can be a large part of all documents and the share far above `most`.
    """
    own = docs.select("doc_id", "text", *PAGE)
    rows = one_label(sampled(labels, labelled, "co-training"), own, [label])
    rows = rows.withColumn("y", F.col(f"label_{label}").cast("int")).withColumn("test", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    got = features(rows, ["y", "test"], PAGE).collect()  # about `labelled` rows
    bits = lambda c: [np.frombuffer(r[c], "<i4") for r, k in zip(got, ok) if k]
    y = np.array([r["y"] for r in got], np.int64)
    ok = np.isin(y, (0, 1))
    return CoTrained.learn(bits("content"), bits("page"), y[ok], np.array([r["test"] for r in got], bool)[ok], unlabelled(docs, labels), rounds, sure, most, passes)


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, p_content, p_page, score and quality_pred (score >= 0.5) of every document, in a map without a shuffle."""
    if model.views is None:
        p = F.lit(model.share)
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), p.alias("p_content"), p.alias("p_page"), p.alias("score"), (p >= 0.5).cast("int").alias("quality_pred"))
    small_batches(docs.sparkSession)
    (w, b, a, c, k), page = model.views
    pw, pb, pa_, pc, pk = page
    # one number for each hashed bucket, and one for each of the metadata
    sent = docs.sparkSession.sparkContext.broadcast(((w[:, 1] - w[:, 0]).astype(np.float32), (pw[:, 1] - pw[:, 0]).astype(np.float32)))
    offsets = np.array([b[1] - b[0], pb[1] - pb[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, weights = Content(), sent.value
        for batch, raw in slices(batches, 1):
            if len(content.known) > CACHE_ENTRIES:
                content.forget()
            z = np.zeros((len(raw), 2))
            for i, (x, *own) in enumerate(zip(raw, *(batch.column(2 + j).to_pylist() for j in range(len(PAGE))))):
                for v, f in enumerate((with_layout(content(x), x), metadata(*own))):
                    z[i, v] = weights[v][f].sum() / np.sqrt(max(1, len(f)))
            z = (z + offsets) * np.array([a, pa_]) + np.array([c, pc])
            p = 1 / (1 + np.exp(-np.clip(np.column_stack([z, z @ np.array([k, pk])]), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, j]) for j in range(3)), pa.array((p[:, 2] >= 0.5).astype(np.int32))], names=["doc_id", "p_content", "p_page", "score", "quality_pred"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(x).cast("string").alias(x) for x in PAGE]).mapInArrow(run, "doc_id long, p_content double, p_page double, score double, quality_pred int")
