"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are words and the 4-letter beginnings of longer words (inflected forms meet there), all those of the examples.  A
term weighs TF-IDF times the square root of its evidence, the likelihood ratio G of its shares of toxic and other examples:
no bound is set on either, a term with little evidence weighs little.  The index holds each term's postings by block of
examples with the largest weight in each block.  A query's terms that many examples hold are summed first, for a batch of
queries at once; what its other terms can still add is bounded by block, and only examples that can reach the k-th best so far
are summed to the end.  The k nearest are
exact.  Neighbours vote with the square of their cosine; votes turn into rates through a table learnt by leaving each example
out, with the natural share of the classes put back.  Their doc_ids come with the score, as its evidence.

An example that is a near copy (Jaccard of 3-word shingles 0.8 or more) of an earlier one kept, of the same label, is left
out: a rare word of a much-copied text is no sign of its class.

Bounds (parameters): examples per class.  A text without any term of the examples, an empty or a null text scores the rate
of such examples.  Without labels of both classes every score is the share of class 1 (0 without any).  Ties between
neighbours go to the earlier example.  Repeated rows: one result each.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts
from .labelled import fitted, held_out
from .ngram_join import shingle_set

LETTERS = re.compile(r"[^\W\d_]+")
STEM = 4
BLOCK = 64
FREQUENT = 8  # a term that one in so many examples holds is summed by a matrix product
BATCH = 32  # texts scored at once

def terms_of(text: str) -> list[str]:
    words = LETTERS.findall(text.lower())
    return words + [w[:STEM] + "*" for w in words if len(w) > STEM]


def without_copies(rows: list[tuple]) -> list[tuple]:
    """The rows (text, label, ...) without those whose shingles have a Jaccard of 0.8 or more with those of an earlier row kept, of the same label.

    Two such sets share one of the first n - ceil(0.8 n) + 1 of each, rare shingles first; texts of under 3 words are one shingle.
    """
    sets = [shingle_set(r[0], 3) for r in rows]
    every, times = np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]), return_counts=True)
    by_prefix: dict[tuple[int, int], list[int]] = {}
    kept = []
    for i, (mine, row) in enumerate(zip(sets, rows, strict=True)):
        n, y = len(mine), row[1]
        often = times[np.searchsorted(every, mine)]
        head = np.argsort(often, kind="stable")[: n - (4 * n + 4) // 5 + 1]
        prefix = [(s, y) for s in mine[head[often[head] > 1]].tolist()]  # what one set alone holds meets nothing
        met = {k for p in prefix for k in by_prefix.get(p, ())}
        if any(5 * (both := len(np.intersect1d(mine, sets[k], assume_unique=True))) >= 4 * (n + len(sets[k]) - both) for k in met):
            continue
        kept.append(row)
        for p in prefix:
            by_prefix.setdefault(p, []).append(i)
    return kept


def _ranges(first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges in one array, and the length of each range."""
    n = ends - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum())), n


class Postings:
    """Examples by term; an entry is a term's run of postings within one block, with its largest weight.

    A posting is held once, with its example's number in as few bytes as the examples need, and no worker has a second copy.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        """Of each example its terms, ascending, and their weights."""
        terms = np.concatenate([np.zeros(0, np.int32), *(at for at, _ in vectors)])
        order = np.argsort(terms, kind="stable")  # examples stay in order within a term
        held = np.bincount(terms, minlength=n_terms)
        where = np.repeat(np.arange(len(vectors), dtype=np.min_scalar_type(len(vectors))), np.array([len(at) for at, _ in vectors], int))[order]
        self.__setstate__((len(vectors), held, where, np.concatenate([np.zeros(0), *(w for _, w in vectors)])[order]))

    def __getstate__(self):
        return self.examples, self.held, self.where, self.weight  # only these travel to a task

    def __setstate__(self, state: tuple[int, np.ndarray, np.ndarray, np.ndarray]):
        """The number of examples, and of postings by term; the postings' examples and weights."""
        self.examples, self.held, self.where, self.weight = state
        self.blocks = (self.examples + BLOCK - 1) // BLOCK
        n, n_terms = len(self.where), len(self.held)
        narrow = np.int32 if n < 1 << 31 else np.int64
        begin = np.r_[0, np.cumsum(self.held)]
        block = self.where // BLOCK
        new = np.ones(n, bool)
        np.not_equal(block[1:], block[:-1], out=new[1:])
        new[begin[:-1][self.held > 0]] = True
        first = np.flatnonzero(new)
        self.block, self.starts = block[first], np.r_[first, n].astype(narrow)
        self.tops = np.maximum.reduceat(self.weight, first) if n else self.weight
        self.entries = np.searchsorted(first, begin).astype(narrow)  # of a term, the first
        often = np.flatnonzero(FREQUENT * self.held >= max(self.examples, FREQUENT))
        self.row = np.full(n_terms, -1, np.int32)  # of the matrix, for frequent terms
        self.row[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.examples))
        for row, term in zip(self.matrix, often.tolist(), strict=True):
            where, weight = self[term]
            row[where] = weight

    def frequent(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """By query and example what the frequent terms give."""
        x = np.zeros((len(queries), len(self.matrix)))
        for i, (at, q) in enumerate(queries):
            row = self.row[at]
            x[i, row[row >= 0]] = q[row >= 0]
        return x @ self.matrix

    def __getitem__(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.starts[self.entries[term]], self.starts[self.entries[term + 1]])
        return self.where[s], self.weight[s]

    def bounds(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """By block the most that these terms can give an example."""
        entries, n = _ranges(self.entries[at], self.entries[at + 1])
        return np.bincount(self.block[entries], np.repeat(q, n) * self.tops[entries], minlength=self.blocks)

    def sums(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """By example what these terms give it."""
        at, n = _ranges(self.starts[self.entries[at]], self.starts[self.entries[at + 1]])
        return np.bincount(self.where[at], np.repeat(q, n) * self.weight[at], minlength=self.examples)

    def sums_within(self, blocks: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """By example what these terms give it, in the blocks marked; 0 in others."""
        entries, n = _ranges(self.entries[at], self.entries[at + 1])
        mine = blocks[self.block[entries]]
        entries, q = entries[mine], np.repeat(q, n)[mine]
        at, n = _ranges(self.starts[entries], self.starts[entries + 1])
        return np.bincount(self.where[at], np.repeat(q, n) * self.weight[at], minlength=self.examples)


class NearestExamples:
    """rows: (text, label, doc_id), doc_id being what evidence names."""

    def __init__(self, rows: list[tuple], share: float, k: int = 15):
        self.k, self.share, self.table = k, share, None
        rows = without_copies(rows)
        labels = np.array([r[1] for r in rows], int)
        n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
        self.index: dict[str, int] = {}
        if not n1 or not n0:
            return
        number = self.index
        bags = []
        for r in rows:
            at, counts = np.unique(np.array([number.setdefault(t, len(number)) for t in terms_of(r[0])], np.int32), return_counts=True)
            bags.append((at, counts.astype(np.int32)))
        df1, df0 = (np.bincount(np.concatenate([at for (at, _), y in zip(bags, labels, strict=True) if y == x]), minlength=len(number)).astype(float) for x in (1, 0))
        n = len(rows)
        self.factor = (np.log((1 + n) / (1 + df0 + df1)) + 1) * (np.sqrt(self._evidence(df1, df0, n1, n0)) + 0.01)
        vectors = [self._weighted(at, c) for at, c in bags]
        del bags
        order = sorted((i for i in range(n) if vectors[i][0].size), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), i))  # alike ones share blocks
        self.labels = labels[order]
        self.names = [rows[i][2] if len(rows[i]) > 2 else i for i in order]
        self.post = Postings([vectors[i] for i in order], len(number))
        self._calibrate(vectors, order, labels, n1, n0)

    @staticmethod
    def _evidence(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
        """G of terms in a of n1 toxic and b of n0 other examples."""
        p = (a + b) / (n1 + n0)
        g = np.zeros(len(a))
        with np.errstate(divide="ignore", invalid="ignore"):
            for x, e in ((a, n1 * p), (b, n0 * p), (n1 - a, n1 * (1 - p)), (n0 - b, n0 * (1 - p))):
                g += np.where((x > 0) & (e > 0), x * np.log(x / e), 0.0)
        return np.maximum(0.0, 2 * g)

    def _weighted(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.factor[at]
        return at, w / (np.linalg.norm(w) or 1.0)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """Of each query (terms, weights) the k best (cosine, example), exact; ties to the smaller example."""
        out = []
        for i, ((at, q), scores) in enumerate(zip(queries, self.post.frequent(queries), strict=True)):
            rare = self.post.row[at] < 0
            at, q = at[rare], q[rare]
            if without:
                scores[without[i]] = -1
            least = np.partition(scores, -self.k)[-self.k] if len(scores) > self.k else 0.0
            bounds = self.post.bounds(at, q)
            found = np.flatnonzero(scores + np.repeat(bounds, BLOCK)[: len(scores)] >= least - 1e-9)
            reached = np.zeros(self.post.blocks, bool)
            reached[found // BLOCK] = True
            scores += self.post.sums_within(reached, at, q) if 4 * np.count_nonzero(reached) < len(reached) else self.post.sums(at, q)
            if without:
                scores[without[i]] = 0
            found = found[scores[found] > 0]
            if len(found) > self.k:
                found = found[scores[found] >= np.partition(scores[found], -self.k)[-self.k]]
            out.append(sorted(zip(scores[found].tolist(), found.tolist(), strict=True), key=lambda x: (-x[0], x[1]))[: self.k])
        return out

    def _vote(self, best: list[tuple[float, int]]) -> float:
        total = sum(s * s for s, _ in best)
        return sum(s * s for s, i in best if self.labels[i]) / total if total else 0.0

    def _calibrate(self, vectors, order, labels, n1: int, n0: int) -> None:
        """Rates of class 1 by vote, each example left out of its own; classes weigh as among all labels."""
        weight = {1: self.share / n1, 0: (1 - self.share) / n0}
        bins = np.zeros((11, 2))
        votes = [self._vote(x) for a in range(0, len(order), BATCH) for x in self.nearest([vectors[i] for i in order[a : a + BATCH]], list(range(a, min(a + BATCH, len(order)))))]
        for i, v in zip(order, votes, strict=True):
            bins[min(10, int(v * 10) + 1), labels[i]] += weight[labels[i]]
        for i in set(range(len(labels))) - set(order):
            bins[0, labels[i]] += weight[labels[i]]
        prior = 1 / len(labels)
        rate = (bins[:, 1] + prior * self.share) / (bins.sum(1) + prior)
        self.table = np.r_[rate[0], np.maximum.accumulate(rate[1:])]

    def score(self, texts: list[str]) -> list[tuple[float, list[tuple[float, int]]]]:
        """Of each text the calibrated score, and the neighbours as evidence."""
        if self.table is None:
            return [(self.share, []) for _ in texts]
        ids = [[i for i in map(self.index.get, terms_of(t)) if i is not None] for t in texts]
        found = iter(self.nearest([self._weighted(*np.unique(np.array(x, np.int64), return_counts=True)) for x in ids if x]))
        return [self._calibrated(next(found)) if x else (float(self.table[0]), []) for x in ids]

    def _calibrated(self, best: list[tuple[float, int]]) -> tuple[float, list[tuple[float, int]]]:
        v = self._vote(best)
        return float(np.clip(self.table[min(10, int(v * 10) + 1)] * 0.999 + v * 0.001, 0, 1)), best

    def score_column(self, column) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        """Of every text of an Arrow column, few at once."""
        for a in range(0, len(column), BATCH):
            yield from self.score([t or "" for t in column.slice(a, BATCH).to_pylist()])


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2000, k: int = 15) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic_neighbours, best_cosine, neighbours (doc_ids of the nearest examples, nearest first)."""
    shared = fitted(docs, labels, "toxic", per_class, lambda rows, share: NearestExamples(rows, share, k))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            found = list(model.score_column(batch.column(1)))
            scores = [s for s, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array([sum(int(model.labels[i]) for _, i in b) for _, b in found], pa.int32()),
                    pa.array([b[0][0] if b else 0.0 for _, b in found], pa.float64()),
                    pa.array([[model.names[i] for _, i in b] for _, b in found], pa.list_(pa.int64())),
                ],
                ["doc_id", "held_out", "score", "predicted", "n_toxic_neighbours", "best_cosine", "neighbours"],
            )

    return texts(docs).withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_toxic_neighbours int, best_cosine double, neighbours array<long>")


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = 2000, k: int = 15, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they are."""
    shared = fitted(docs, labels, "toxic", per_class, lambda rows, share: NearestExamples(rows, share, k))
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s, _ in model.score_column(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
