"""Mixing documents to target domain weights with soft membership.

A classifier trained on the labelled table gives every document a posterior over domains. Each document then
gets a rate, not below zero: how often it is to be used. Rates minimise the squares of the gaps between
expected domain tokens, sum of rate x tokens x posterior, and the targets, in the metric of the inverse of the
posteriors' token-weighted second moments, which makes all directions alike. Accelerated projected gradient steps
go from rate 1. A step subtracts posterior . c, for a short vector c that all documents share, and cuts at zero; so
every task replays the steps for its own documents, and a round is one small sum over the documents. After every
`keep` rounds the rates are written, and replay starts from there. Lost executors lose nothing.

Steps go on until every domain is within `close` of its target, or until they bring no more, where no rates above
zero meet the targets. The greatest gap left is in the result as share_gap, so a target that is missed is seen.
Should neither come about in `rounds` rounds, it is an error that names the gaps.

Tokens are runs between white space. Null and empty texts have none, so any rate suits; they get what the
steps give. A long text is counted whole, in one worker's memory. Repeated rows are documents of their own. Equal
posteriors get equal rates. Of several label rows of a document the least counts, and null labels don't teach.
Domains that nothing is labelled with get next to no posterior, and their targets can't be met. An empty table gives
no rows; without labels every domain has the same posterior. Other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import CACHE_ENTRIES, discard, materialize, slices, small_batches
from .classify import Content, Sparse, features, fit, one_label, sampled, softmax

#: Domains of the labels table, and its rows' domain.
DOMAINS = ("plain", "poor", "toxic")
TARGETS = {"plain": 0.90, "poor": 0.06, "toxic": 0.04}


def domain_of() -> Column:
    return F.when(F.col("label_toxic") == 1, 2).when(F.col("label_quality") == 0, 1).otherwise(0)


def train_domains(docs: DataFrame, labels: DataFrame, bound: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the domain classifier from about `bound` labelled documents."""
    some = sampled(labels, bound, "domains")
    rows = one_label(some, docs.select("doc_id", "text"), ["quality", "toxic"]).withColumn("y", domain_of())
    got = features(rows, ["y"], []).select("y", "content").collect()  # about `bound` rows of a few hundred numbers
    x = Sparse([np.frombuffer(r["content"], "<i4") for r in got])
    return fit(x, np.array([r["y"] for r in got], np.int64), len(DOMAINS))


def posteriors(docs: DataFrame, w: np.ndarray, b: np.ndarray, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens and posterior of every document, and its columns named in carry."""
    small_batches(docs.sparkSession)
    w = w.astype(np.float32)
    used = np.flatnonzero(w.any(axis=1))
    w = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), w[used], len(w)))  # bounded by the hashed buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = Content()
        used, some, size = w.value
        weights = np.zeros((size, len(b)), np.float32)
        weights[used] = some
        for batch, raw in slices(batches, 1):
            if len(content.known) > CACHE_ENTRIES:
                content.forget()
            found = [content(x) for x in raw]
            z = np.array([weights[f].sum(axis=0) / np.sqrt(max(1, len(f))) for f, _ in found])
            p = softmax(z + b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array([len(at) for _, at in found], np.int64)), pa.array(list(p), pa.list_(pa.float64())), *batch.columns[2:]], names=["doc_id", "n_tokens", "posterior", *carry])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    return src.mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry))


class Steps:
    """The shared vectors of the gradient steps since rates were last written; replays them for any documents."""

    def __init__(self, t: float = 1.0):
        self.t, self.c = t, []

    def rates(self, p: np.ndarray, r: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Rates after the last step, the point from which the next one starts, and the weight of its momentum."""
        t = self.t
        for c, again in self.c:
            if again:  # momentum starts anew
                y, t = r, 1.0
            then = np.maximum(0.0, y - p @ c)
            s = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, r, t = then + (t - 1) / s * (then - r), then, s
        return r, y, t


def _matrix(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, posteriors, rates and starting points of a batch."""
    t, r, y = (batch.column(batch.schema.names.index(c)).to_numpy().astype(float) for c in ("n_tokens", "rate", "ahead"))
    return t, np.asarray(batch.column(batch.schema.names.index("posterior")).flatten()).reshape(-1, k), r, y


def measure(soft: DataFrame, steps: Steps, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By the token, over all documents: second moments of the posteriors, domain tokens at the rates, and at the next step's start."""
    cols = [f"v{i}" for i in range(k * k + 2 * k + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(cols))
        for batch in batches:
            t, p, r, y = _matrix(batch, k)
            r, y, _ = steps.rates(p, r, y)
            out += np.concatenate([((p * t[:, None]).T @ p).ravel(), (r * t) @ p, (y * t) @ p, [t.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=cols)

    row = soft.select("n_tokens", "posterior", "rate", "ahead").mapInArrow(run, ", ".join(f"{c} double" for c in cols)).agg(*[F.sum(c) for c in cols]).first()
    s = np.array([x or 0.0 for x in row])
    s /= max(s[-1], 1.0)
    return s[: k * k].reshape(k, k), s[k * k : k * k + k], s[k * k + k : -1]


def written(soft: DataFrame, steps: Steps, k: int) -> DataFrame:
    """soft with the rates that the steps lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, p, r, y = _matrix(batch, k)
            r, y, _ = steps.rates(p, r, y)
            at = {"rate": pa.array(r), "ahead": pa.array(y)}
            yield pa.RecordBatch.from_arrays([at.get(c, x) for c, x in zip(batch.schema.names, batch.columns)], names=batch.schema.names)

    return soft.mapInArrow(run, soft.schema)


def solve(soft: DataFrame, targets: np.ndarray, rounds: int = 2000, close: float = 1e-3, keep: int = 32, patience: int = 50) -> tuple[DataFrame, np.ndarray]:
    """soft(doc_id, n_tokens, posterior) with `rate`, and the shares of the domains that the rates reach.

    Ends when every share is within `close` of its target, or when the last `patience` rounds have not brought the squares
    of the gaps down by a hundredth, which is where rates above zero can do no better but by a few hundredths.
    """
    k, steps = len(targets), Steps()
    first = now = soft.withColumns({"rate": F.lit(1.0), "ahead": F.lit(1.0)})
    metric = scale = None
    best, before, again = [], np.inf, False
    for _ in range(rounds):
        moments, at_rate, at_start = measure(now, steps, k)
        gap = at_rate - targets
        if metric is None:
            metric = np.linalg.inv(moments + 1e-4 * max(np.trace(moments), 1e-12) * np.eye(k))
            scale = max(np.linalg.eigvals(metric @ moments).real.max(), 1e-12)
        cost = float(gap @ metric @ gap)
        best.append(min([cost, *best[-1:]]))
        stuck = len(best) > patience and best[-1] > 0.99 * best[-1 - patience]
        if np.abs(gap).max() <= close or stuck or not at_rate.any():
            done = written(now, steps, k).drop("ahead")
            return done, at_rate
        again, before = cost > before, cost
        start = at_rate if again else at_start
        steps.c.append((metric @ (start - targets) / scale, again))
        if len(steps.c) >= keep:
            after = steps.rates(np.zeros((1, k)), np.zeros(1), np.zeros(1))[2]
            then = materialize(written(now, steps, k), "rates")
            if now is not first:
                discard(now)
            now, steps = then, Steps(after)
    raise RuntimeError(f"no rates found in {rounds} rounds: shares {at_rate.tolist()} for targets {targets.tolist()}")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, bound: int = 6000, close: float = 1e-3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, p_<domain> for each domain, rate, copies (the rate rounded up or down by a hash of the id), share_gap and the columns named in carry.

    share_gap is the same for every row: how far the share of some domain is from its target at most; above `close` only where no rates reach the targets.
    """
    targets = targets or TARGETS
    goal = np.array([targets[d] for d in DOMAINS], float)
    goal /= goal.sum()
    w, b = train_domains(docs, labels, bound)
    soft = materialize(posteriors(docs, w, b, carry), "posteriors")
    done, reached = solve(soft, goal, close=close)
    out = done.select("doc_id", "n_tokens", *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", *carry)
    dice = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mix")), F.lit(1 << 30)) / (1 << 30)
    return out.withColumn("copies", F.floor(F.col("rate") + dice).cast("int")).withColumn("share_gap", F.lit(float(np.abs(reached - goal).max())))
