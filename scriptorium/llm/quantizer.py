"""Coarse cells and additive quantisation of unit vectors, in numpy.

A vector is written as a sum of full-dimensional codewords, one of each codebook. Encoding keeps a beam of partial sums instead of the
single best, and works on inner products only: what a codeword adds to the error follows from the products of the vector with all codewords
and from the Gram matrix of the codebooks. A query is scored against a code by looking up its product with each codeword; the stored norm of
the sum turns that into a cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (in doubles first, so that very long or short vectors survive)."""
    x = np.asarray(x, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """For each row the indices of the n closest centres, closest first."""
    out = np.empty((len(x), n), np.int32)
    half = (centres**2).sum(1) / 2
    for i in range(0, len(x), 4096):
        score = x[i : i + 4096] @ centres.T - half
        if n == 1:
            out[i : i + 4096, 0] = score.argmax(1)
        else:
            part = np.argpartition(-score, n - 1, axis=1)[:, :n]
            order = np.argsort(-np.take_along_axis(score, part, 1), axis=1, kind="stable")
            out[i : i + 4096] = np.take_along_axis(part, order, 1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm; empty cells restart at random rows. With fewer rows than k, every row is a centre."""
    if len(x) <= k:
        return x.copy()
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)[:, 0]
        order = np.argsort(own, kind="stable")
        sizes = np.bincount(own, minlength=k)
        used = sizes > 0
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sums = np.add.reduceat(x[order], starts[used], axis=0)
        centres[used] = sums / sizes[used, None]
        if not used.all():
            centres[~used] = x[rng.integers(len(x), size=(~used).sum())]
    return centres


@dataclass
class Quantizer:
    """Coarse `cells` (c, dim) and codebooks as `words` (books * size, dim)."""

    cells: np.ndarray
    words: np.ndarray
    books: int
    size: int

    def __post_init__(self) -> None:
        self.gram = self.words @ self.words.T
        self.norms = np.diag(self.gram).copy()

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, books: int, size: int, beam: int, seed: int = 7) -> Quantizer:
        """Cells, then one codebook after another on what the beam left over."""
        rng = np.random.default_rng(seed)
        centres = kmeans(sample, cells, 8, rng)
        x = sample if len(sample) <= 16_384 else sample[rng.choice(len(sample), 16_384, replace=False)]
        size = min(size, max(1, len(x)))
        words, rest = np.zeros((0, x.shape[1]), np.float32), x
        for b in range(books):
            book = kmeans(rest, size, 6, rng)
            words = np.vstack([words, book]).astype(np.float32)
            self = cls(centres, words, b + 1, size)
            rest = x - self.decode(self.encode(x, beam)[0])
        return self

    def encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, books) as uint8 and the squared norms of the sums."""
        codes, norms = [], []
        for i in range(0, len(x), 2048):
            c, n = self._encode(x[i : i + 2048], beam)
            codes.append(c)
            norms.append(n)
        if not codes:
            return np.zeros((0, self.books), np.uint8), np.zeros(0, np.float32)
        return np.vstack(codes), np.concatenate(norms)

    def _encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, dots = len(x), x @ self.words.T
        err = np.zeros((n, 1), np.float32)  # |sum|^2 - 2 x.sum of every partial sum
        codes = np.zeros((n, 1, 0), np.int32)
        for b in range(self.books):
            lo, hi = b * self.size, (b + 1) * self.size
            step = self.norms[lo:hi] - 2 * dots[:, None, lo:hi]
            grown = np.repeat(step, err.shape[1], axis=1) if err.shape[1] > 1 else step.copy()
            for j in range(b):
                grown += 2 * self.gram[codes[:, :, j] + j * self.size, lo:hi]
            grown += err[:, :, None]
            flat = grown.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            err = np.take_along_axis(flat, best, 1)
            parent, word = best // self.size, best % self.size
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]], axis=2)
        top = err.argmin(1)
        chosen = codes[np.arange(n), top].astype(np.uint8)
        rebuilt = self.decode(chosen)
        return chosen, (rebuilt**2).sum(1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.words.shape[1]), np.float32)
        for b in range(self.books):
            out += self.words[codes[:, b].astype(np.int32) + b * self.size]
        return out

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Cosines of unit queries with coded vectors, by table look-up."""
        tables = np.ascontiguousarray((queries @ self.words.T).T)
        total = tables[codes[:, 0].astype(np.int32)]
        for b in range(1, self.books):
            total += tables[codes[:, b].astype(np.int32) + b * self.size]
        total /= np.sqrt(np.maximum(norms, 1e-12))[:, None]
        return total.T
