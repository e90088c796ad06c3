"""Quality classifier: supervised subword embeddings, averaged by document, softmax output, numpy SGD.

Features of a word are itself, its shape and its character n-grams (2 to 4, with edges), hashed to buckets; a word's vector
is the mean of theirs, a document's the mean of its words'.  Words are those between ASCII white space, whole, however long; a
text without white space is one word and its n-grams tell what it is.  Two words of its own tell a document's length and how
often its words recur, which no mean of its words can.  The output layer being linear, a document's logit is a weighted sum of
one number a bucket.

Bounds (parameters): examples per class, buckets (a power of two), dimensions, epochs.  Trained by a fixed seed on a
hash-picked sample, balanced, with the natural share of the classes put back into the bias.  Null and empty texts have only
the length word.  Without labels of both classes every score is the share of class 1.  Repeated rows: one result each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import texts
from .labelled import examples, held_out

PIECE = 1 << 18  # bytes of words looked at together
SPREAD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SHAPE = np.array([0x41 if 65 <= c < 91 else 0x61 if 97 <= c < 123 or c > 127 else 0x30 if 48 <= c < 58 else c for c in range(256)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * SPREAD
    return x ^ (x >> np.uint64(32))


def _pieces(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words of a text, each between its edge marks, some at once: their bytes, and where each begins."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~SPACE[raw]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    sizes = ends - starts
    group = np.cumsum(sizes) // PIECE
    for g in np.unique(group).tolist():
        a, b = np.searchsorted(group, [g, g + 1]).tolist()
        n, first = sizes[a:b], int(starts[a])
        at = np.concatenate([[0], np.cumsum(n + 2)])
        out = np.empty(int(at[-1]), np.uint64)
        chars = raw[first : int(ends[b - 1])][inside[first + 1 : int(ends[b - 1]) + 1]]
        out[np.arange(len(chars)) + 2 * np.repeat(np.arange(b - a), n) + 1] = chars
        out[at[:-1]], out[at[1:] - 1] = ord("<"), ord(">")
        yield out, at[:-1]


def features(text: str, buckets: int, own_weight: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and their weights, which sum to 1: words share 1 - own_weight, the two words of its own the rest."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    words, seen = 0, []
    found = []
    with np.errstate(over="ignore"):
        for x, at in _pieces(text):
            size = np.diff(np.append(at, len(x)))
            place = (np.arange(len(x)) - np.repeat(at, size)).astype(np.uint64) << np.uint64(8)
            whole, shape = np.add.reduceat(_mix(x + place), at), np.add.reduceat(_mix(SHAPE[x.astype(np.int64)] + place) * SPREAD, at)
            share = 1.0 / (2 + np.maximum(3 * size - 6, 3))  # a word of `size` bytes with its edges has so many n-grams
            every, left = np.repeat(share, size), np.repeat(at + size, size) - np.arange(len(x))
            gram = x
            ids, weights = [whole, shape], [share, share]
            for n in (2, 3, 4):
                gram = gram[:-1] * np.uint64(257) + x[n - 1 :] + np.uint64(1)
                fits = left[: len(gram)] >= n
                ids.append(_mix(gram[fits]) * SPREAD)
                weights.append(every[: len(gram)][fits])
            found.append((np.concatenate(ids), np.concatenate(weights)))
            words += len(at)
            seen.append(whole)
        for ids, weights in found:
            yield (ids >> shift).astype(np.int64), weights * ((1 - own_weight) / words)
        fresh = len(np.unique(np.concatenate(seen))) / words if words else 1.0
        expected = 1.0 if words < 2 else words**-0.2  # distinct words grow slower than the text
        own = np.array([1 + min(12, words.bit_length()), 100 + min(20, int(10 * fresh / expected))], np.uint64)
        yield (_mix(own * np.uint64(1_000_003)) >> shift).astype(np.int64), np.full(2, own_weight / 2)


class SubwordClassifier:
    """input_rate: how much larger the step of the bucket vectors is than that of the output, each having a small share of a text."""

    def __init__(self, rows: list[tuple], share: float, buckets: int = 1 << 17, dims: int = 8, epochs: int = 4, rate: float = 0.5, input_rate: float = 30.0, own_weight: float = 0.2):
        self.buckets, self.share, self.own_weight = buckets, share, own_weight
        labels = np.array([r[1] for r in rows], int)
        n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
        self.trained = bool(n1 and n0)
        if not self.trained:
            return
        rng = np.random.default_rng(7)
        vectors = rng.uniform(-1 / dims, 1 / dims, (buckets, dims)).astype(np.float32)
        out = np.zeros((2, dims), np.float32)
        bias = np.zeros(2, np.float32)
        bags = []
        for r in rows:
            ids, weights = map(np.concatenate, zip(*features(r[0], buckets, own_weight), strict=True))
            ids, back = np.unique(ids, return_inverse=True)
            bags.append((ids.astype(np.int32), np.bincount(back, weights).astype(np.float32)))
        balance = {0: len(rows) / 2 / n0, 1: len(rows) / 2 / n1}
        steps, done = epochs * len(rows), 0
        for _ in range(epochs):
            for i in rng.permutation(len(rows)).tolist():
                (ids, w), y = bags[i], int(labels[i])
                lr = np.float32(rate * (1 - done / steps) * balance[y])
                done += 1
                mean = w @ vectors[ids]
                z = out @ mean + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                back_to = p @ out
                out -= lr * np.outer(p, mean)
                bias -= lr * p
                vectors[ids] -= (lr * np.float32(input_rate) * w)[:, None] * back_to[None, :]
        self.per_bucket = (vectors @ (out[1] - out[0])).astype(np.float64)
        # as trained the classes weigh the same; their natural share comes back as a shift
        self.bias = float(bias[1] - bias[0]) + math.log((share + 1e-6) / (1 - share + 1e-6))

    def score(self, text: str) -> float:
        if not self.trained:
            return self.share
        z = self.bias + sum(float(self.per_bucket[ids] @ weights) for ids, weights in features(text, self.buckets, self.own_weight))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = SubwordClassifier(*examples(docs, labels, "quality", per_class))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return texts(docs).withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
