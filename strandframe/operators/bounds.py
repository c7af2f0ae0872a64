"""Which sequences can align with one at a given identity at all, by the q-grams that they must share.

An alignment of c columns, e of them no match, has c - q + 1 runs of q columns of which each miss spoils q at most; so at least
c - q + 1 - q e of them are a q-gram that both sequences have. At an identity of at least p no more than (1 - p) c columns miss, so c
columns need c (1 - q (1 - p)) - q + 1 or more, least at the fewest columns allowed. A column that misses moves the alignment by one
diagonal (place in one sequence less place in the other) at most; and with the shorter sequence's m letters no more than m (1 - p) / p
columns miss, so those q-grams lie within as many diagonals of each other. Both are exact: what fails either can't reach p, whatever
its alignment is.
"""

from __future__ import annotations

import numpy as np

from .kmers import codes_of, window_hashes

#: Lengths of q-grams. Short ones tell something at low identities, long ones at high ones.
GRAMS = (4, 6, 9, 14)
#: Letters of sequences that are aligned sooner than looked at any further.
LITTLE = 48
#: The length by which sequences are guessed to be near, and those by which they are put in order.
GUESS, ORDER = 6, (6, 9, 14)


def fewest_columns(a: int, b: int, min_cov: float) -> int:
    """The least number of columns whose share of the shorter sequence is min_cov."""
    short = min(a, b)
    c = max(0, int(min_cov * short) - 2)
    while c / short < min_cov:
        c += 1
    return c


class Places(dict):
    """For each q that is asked for, the sequences that share a text's q-grams, each as often as they do, and (sequence, diagonal) of each as one ascending number."""

    def __init__(self, grams: Grams, text: str):
        self.grams, self.codes = grams, codes_of(text)
        self.stride = len(self.codes) + grams.longest + 1

    def __missing__(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        self[q] = self.grams.met(self.codes, q, self.stride)
        return self[q]


class Grams:
    """The q-grams of some sequences, looked up for one sequence after another."""

    def __init__(self, texts: list[str], min_cov: float):
        self.sizes, self.min_cov, self.lists = np.array([len(t) for t in texts], np.int64), min_cov, {}
        self.longest = int(self.sizes.max(initial=0))
        codes = [codes_of(t) for t in texts]
        for q in GRAMS:
            own = [window_hashes(c, q) for c in codes]
            keys, of, place = np.concatenate(own), np.repeat(np.arange(len(texts)), [len(x) for x in own]), np.concatenate([np.arange(len(x)) for x in own])
            order = np.argsort(keys, kind="stable")
            keys, starts = np.unique(keys[order], return_index=True)
            self.lists[q] = keys, np.append(starts, len(order)), of[order], place[order]

    def places(self, text: str) -> Places:
        return Places(self, text)

    def met(self, codes: np.ndarray, q: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
        keys, starts, of, place = self.lists[q]
        h = window_hashes(codes, q)
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        hit = np.flatnonzero(keys[at] == h) if len(keys) else np.zeros(0, np.int64)
        n = starts[at[hit] + 1] - starts[at[hit]]
        which = np.repeat(starts[at[hit]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        key = np.sort(of[which] * stride + np.repeat(hit, n) - place[which] + self.longest)
        return (key // stride).astype(np.int32), key

    def most_within(self, places: Places, q: int, diagonals: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """Of each sequence (of those `among` says yes to), the most q-grams that lie within so many diagonals of each other."""
        which, key = places[q] if among is None or among.all() else (x[among[places[q][0]]] for x in places[q])
        out = np.zeros(len(self.sizes), np.int64)
        if len(which):
            reach = np.minimum(key + diagonals[which] + 1, (which.astype(np.int64) + 1) * places.stride)
            count = np.searchsorted(key, reach) - np.arange(len(key))
            first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            out[which[first]] = np.maximum.reduceat(count, first)
        return out

    def guess(self, text: str, places: Places, q: int = GUESS) -> np.ndarray:
        """How near each sequence may be, by the share of q-grams met on near diagonals."""
        short = np.minimum(self.sizes, len(text))
        return self.most_within(places, q, short // 8) / np.maximum(short - q + 1, 1)

    def likeliest_first(self, text: str, places: Places) -> np.ndarray:
        """All sequences, those that may align at higher identities first, as far as shares of q-grams tell."""
        return np.argsort(-sum(self.guess(text, places, q) for q in ORDER), kind="stable")

    def can_reach(self, text: str, places: Places, same: int, columns: int, among: np.ndarray | None = None) -> np.ndarray:
        """Whether each sequence (of those `among` says yes to) may align with text at an identity of same / columns or more, on the least coverage.

        Long q-grams come first: they are few, and shorter ones are looked at for what they let through only.
        """
        short = np.minimum(self.sizes, len(text))
        out = short > 0 if among is None else (short > 0) & among
        for q in reversed(GRAMS):
            keep = columns - q * (columns - same)
            if keep > 0 and out.any() and (q in places or self.sizes[out].sum() > LITTLE):
                most = self.most_within(places, q, short * (columns - same) // max(same, 1), out)
                own = np.flatnonzero(out)
                fewest = np.array([fewest_columns(int(n), len(text), self.min_cov) for n in self.sizes[own]], np.int64)
                out[own] = most[own] * columns >= fewest * keep - (q - 1) * columns
        return out
