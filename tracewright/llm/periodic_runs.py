"""Periodic runs of words inside one document, and the text with each run cut down to its first period.

A run is a stretch of words with smallest period q, at least `least` words and at least `periods` times q long, that no
neighbouring word extends.  Method, for the suffixes of many documents at once: put them in lexicographic order with the
lengths they share with their neighbours (LCP), unite the classes of neighbouring suffixes by decreasing LCP (Kruskal) with
union-find over ordered sets of positions, and take each pair of positions i < j that becomes adjacent in a set at distance
j - i <= LCP as a seed: words i .. j + LCP have the period j - i.

Why the seeds are all that is needed: let a stretch of words s .. e have smallest period q, e - s >= 2 q, and no extension.
Then s and s + q share exactly e - s - q words, and a position between them that shared as many would, by Fine and Wilf, give
the stretch a period below q.  So the two become adjacent when their classes meet, and are a seed.  By the same argument a
seed's distance is the smallest period of its stretch.  Seeds of one run agree in period and end; the leftmost is its start.

The two positions of a run share a number of words that `least` and `periods` bound from below, so classes are united down to
that LCP only, and a document in which no so many words occur twice is not sorted at all.

Null text: no words.  Repeated rows: one result each.  Null doc_ids: as others.  Other columns are ignored.  Documents never
meet, so no key can be hot; a task holds some hundred thousand words, or one document if that is longer.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from .common import texts

#: Words that are handled at once; a longer document alone.
AT_ONCE = 300_000


class OrderedPositions:
    """An ordered set of positions in blocks, so that adding to a large set moves the positions of one block only."""

    MOST = 512

    def __init__(self, position: int):
        self.size, self.blocks, self.firsts = 1, [[position]], [position]

    def add(self, x: int) -> tuple[int, int]:
        """Add x; its neighbours before and after, -1 for none."""
        b = max(bisect_right(self.firsts, x) - 1, 0)
        block = self.blocks[b]
        at = bisect_left(block, x)
        before = block[at - 1] if at else self.blocks[b - 1][-1] if b else -1
        after = block[at] if at < len(block) else self.blocks[b + 1][0] if b + 1 < len(self.blocks) else -1
        block.insert(at, x)
        self.size += 1
        if at == 0:
            self.firsts[b] = x
        if len(block) > self.MOST:
            half = block[self.MOST // 2 :]
            del block[self.MOST // 2 :]
            self.blocks.insert(b + 1, half)
            self.firsts.insert(b + 1, half[0])
        return before, after

    def all(self) -> list[int]:
        return [x for block in self.blocks for x in block]


def suffix_order(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of a sequence in lexicographic order, and by level k each suffix's class by its first 2^k keys.

    Prefix doubling; a suffix that has become single is not sorted again.  The last key must occur nowhere else.
    """
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(keys), np.int64)
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, at, length = [], order, 1
    while True:
        levels.append(rank.astype(np.int32))
        here = rank[at]
        equal = here[1:] == here[:-1]  # `at` is in the order reached so far
        at = at[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])]
        if not len(at):
            break
        pair = rank[at] * len(keys) + rank[at + length]  # a class of two or more ends before the last key
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
        here = rank[at]
        index = np.arange(len(at))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], here[1:] != here[:-1]]), index, 0))
        inner = np.maximum.accumulate(np.where(np.concatenate([[True], pair[1:] != pair[:-1]]), index, 0))
        rank[at] = here + inner - group
        length *= 2
    final = np.empty(len(keys), np.int64)
    final[rank] = np.arange(len(keys))
    return final, levels


def shared(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of keys that the suffixes a and b share, pair by pair."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length += (levels[k][a + length] == levels[k][b + length]).astype(np.int64) << k
    return length


def seeds(a: list[int], b: list[int], lcp: list[int]) -> Iterator[tuple[int, int]]:
    """(i, j), and their LCP, that become adjacent at a distance within it; a, b, lcp: neighbouring suffixes by decreasing LCP."""
    sets: dict[int, OrderedPositions] = {}
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        if x not in parent:
            parent[x], sets[x] = x, OrderedPositions(x)
            return x
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y, most in zip(a, b, lcp, strict=True):
        x, y = root(x), root(y)
        if sets[x].size < sets[y].size:
            x, y = y, x
        parent[y] = x
        large, small = sets[x], sets.pop(y).all()
        last = -1  # the position of the small set that was added before
        for k, p in enumerate(small):
            before, after = large.add(p)
            if before != last and before >= 0 and p - before <= most:
                yield before, p, most
            if 0 <= after <= p + most and (k + 1 == len(small) or small[k + 1] > after):
                yield p, after, most
            last = p


def runs(ids: np.ndarray, docs: np.ndarray, least: int = 6, periods: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run in the words `ids`, of documents `docs` (ascending), by start, then period."""
    none = np.zeros(0, np.int64)
    common = min(max(least, periods * q) - q for q in range(1, least + 1))  # of the two first positions of any run
    often = _repeating(ids, docs, common)
    if not often.any():
        return none, none, none
    at = np.flatnonzero(often)
    ends = np.flatnonzero(np.concatenate([docs[at][1:] != docs[at][:-1], [True]]))  # a key of its own behind each document
    where = np.insert(at, ends + 1, -1)
    words = int(ids.max()) + 1
    keys = np.where(where < 0, 0, docs[where] * words + ids[where])
    keys[where < 0] = (int(docs[-1]) + 1) * words + np.arange(len(ends))
    order, levels = suffix_order(keys)
    a, b = order[:-1], order[1:]
    near = levels[min(common.bit_length() - 1, len(levels) - 1)]
    close = near[a] == near[b]
    a, b = a[close], b[close]
    lcp = shared(levels, a, b)
    by = np.argsort(-lcp, kind="stable")
    by = by[lcp[by] >= common]
    found = np.array(list(seeds(a[by].tolist(), b[by].tolist(), lcp[by].tolist())), np.int64).reshape(-1, 3)
    i, period, end = found[:, 0], found[:, 1] - found[:, 0], found[:, 1] + found[:, 2]
    by = np.lexsort((i, period, end))
    i, period, end = i[by], period[by], end[by]
    first = np.ones(len(i), bool)
    first[1:] = (period[1:] != period[:-1]) | (end[1:] != end[:-1])
    i, period, length = i[first], period[first], (end - i)[first]
    long = length >= np.maximum(least, periods * period)
    i, period, length = where[i[long]], period[long], length[long]
    by = np.lexsort((period, i))
    return i[by], length[by], period[by]


def _repeating(ids: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Words of the documents in which some `length` words may occur twice; by a hash, so some others too."""
    n = len(ids) - length + 1
    if n < 2:
        return np.zeros(len(ids), bool)
    mixed = docs[:n].astype(np.uint64)
    with np.errstate(over="ignore"):
        word = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        word ^= word >> np.uint64(31)
        for k in range(length):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
    inside = docs[:n] == docs[length - 1 :]
    ordered = np.sort(mixed[inside])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    some = np.zeros(int(docs[-1]) + 1, bool)
    if len(twice):
        some[docs[:n][inside & np.isin(mixed, twice)]] = True
    return some[docs]


class Numbers(dict):
    """A number for each key, from 0."""

    def __missing__(self, key: bytes) -> int:
        self[key] = len(self)
        return self[key]


COLUMNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def collapse_runs(
    docs: DataFrame, least: int = 6, periods: int = 4, with_text: bool = False, taken: Callable[[int | None, int], np.ndarray | None] = lambda doc_id, n: None
) -> DataFrame:
    """Per document: number of runs, the longest (ties: smallest start, then period), hashes of all runs and of the collapsed text.

    The collapsed text is the words that no run holds behind its first period, joined by one space.  with_text: also the runs themselves (array of start,
    length, period) and the collapsed text.  taken(doc_id, n): which of the n words, by number, to read instead of all in order.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in COLUMNS.split(", ")]
        types = [pa.int64()] * 6 + [pa.string()] * 2
        if with_text:
            names += ["runs", "collapsed"]
            types += [pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])), pa.string()]

        def made(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
            known = Numbers()
            sizes = np.array([len(w) for _, w in held])
            ids = np.fromiter((i for _, w in held for i in map(known.__getitem__, w)), np.int64, int(sizes.sum()))
            begin = np.concatenate([[0], np.cumsum(sizes)])
            start, length, period = runs(ids, np.repeat(np.arange(len(held)), sizes), least, periods)
            edge = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            dropped = np.cumsum(edge[:-1]) > 0
            cut = np.searchsorted(start, begin)
            rows = []
            for k, (doc_id, words) in enumerate(held):
                a, b = int(cut[k]), int(cut[k + 1])
                if a == b:
                    rows.append((doc_id, 0, None, None, None, None, EMPTY, _hex(joined := b" ".join(words)), *(((), joined.decode()) if with_text else ())))
                    continue
                own = list(zip((start[a:b] - begin[k]).tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
                s, n, q = min(own, key=lambda r: (-r[1], r[0], r[2]))
                joined = b" ".join([words[i] for i in np.flatnonzero(~dropped[begin[k] : begin[k + 1]]).tolist()])
                told = "".join([f"{x},{y},{z}\n" for x, y, z in own])
                rows.append((doc_id, b - a, s, n, q, 1000 * n // q, _hex(told.encode()), _hex(joined), *(([dict(zip(("start", "length", "period"), r, strict=True)) for r in own], joined.decode()) if with_text else ())))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            held, size = [], 0
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                words = batch.column(1)[i].as_py().encode().split()  # at the six ASCII white-space bytes
                if (place := taken(doc_id, len(words))) is not None:
                    words = [words[j] for j in place.tolist()]
                held.append((doc_id, words))
                size += len(words)
                if size > AT_ONCE:
                    yield made(held)
                    held, size = [], 0
            if held:
                yield made(held)

    return texts(docs).mapInArrow(run, COLUMNS + (", runs array<struct<start:long,length:long,period:long>>, collapsed string" if with_text else ""))


def _hex(data: bytes) -> str:
    return sha256(data).hexdigest()


EMPTY = _hex(b"")


def cycled(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's planted periods: for a tenth of the doc_ids, by hash, the words from a on repeat the first p of them."""
    from zlib import crc32

    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place
