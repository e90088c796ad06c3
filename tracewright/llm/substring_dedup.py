"""Removal of word windows that occur earlier in the corpus.

Every window of `window` consecutive words gets a Rabin-Karp hash (sums of word hashes times powers of an odd base, modulo
2^64, so one pass of prefix sums gives all windows), and a second one of which 32 bits travel along: 96 bits decide equality.  Windows are
counted by hash in Spark: a window whose hash also stands earlier (smaller doc_id, or earlier in the same document) marks its
words; marked windows of a document merge into maximal removal intervals, which the document's words are then read without.

Steps and what moves:
1. Tasks read documents and hash chunks of about two million windows.  Within a chunk repeated windows are settled at once, so
   a passage that a third of all documents share leaves each chunk once.  What is left goes to the bucket of its hash
   range in packed cells: some 13 bytes a window.
2. A bucket sorts its hashes.  Windows that are not the first of theirs go back to the chunk they came from, packed.
3. A chunk's answers become one row of intervals a document, stored in the shared folder (the windows' shuffle files go).
4. Documents meet their intervals by (doc_id, hash of the text) and are cut.
The number of buckets follows the bytes of text, so a bucket's size does not grow with the corpus.

Null text: no words.  Fewer words than a window: nothing is removed.  Null doc_ids count as the largest.  Different texts of one doc_id are different
documents, in the order of the hashes of their texts; rows that repeat doc_id and text are one document and get one result
each.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, texts
from .periodic_runs import Numbers

#: Windows that a task hashes before it hands them on, and windows that a bucket is meant to hold.
CHUNK, BUCKET = 2_000_000, 3_000_000
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))  # odd, so that they have inverses
LAST = (1 << 63) - 1


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs."""
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


class Cell:
    """Numbers one list behind another in a binary cell."""

    @staticmethod
    def of(*lists: np.ndarray) -> bytes:
        return b"".join([len(x).to_bytes(8, "little") + narrow(x) for x in lists])

    @staticmethod
    def read(cell: bytes) -> list[np.ndarray]:
        out, at = [], 0
        while at < len(cell):
            n, width = int.from_bytes(cell[at : at + 8], "little"), cell[at + 8]
            whole = np.zeros((n, 8), np.uint8)
            whole[:, :width] = np.frombuffer(cell, np.uint8, n * width, at + 9).reshape(n, width)
            out.append(whole.reshape(-1).view("<u8"))
            at += 9 + n * width
        return out


def unsigned(x: np.ndarray) -> np.ndarray:
    """doc_ids as unsigned numbers in the same order."""
    return x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def signed(x: np.ndarray) -> np.ndarray:
    return (x ^ np.uint64(1 << 63)).view(np.int64)


class RollingHashes:
    """Hashes of all windows of a sequence of words, by prefix sums."""

    def __init__(self, window: int):
        self.window = window
        self.powers = [np.ones(1, np.uint64)] * 2
        self.inverses = [np.ones(1, np.uint64)] * 2

    def _grown(self, n: int) -> None:
        if len(self.powers[0]) < n:
            for k, base in enumerate(BASES):
                inverse = np.uint64(pow(int(base), -1, 1 << 64))
                for held, by in ((self.powers, base), (self.inverses, inverse)):
                    x = np.full(n, by, np.uint64)
                    x[0] = 1
                    held[k] = np.multiply.accumulate(x)

    def of(self, ids: np.ndarray, words: list[bytes]) -> list[np.ndarray]:
        """Two hashes of the window at each start; those that reach over a document's end are for the caller to leave out."""
        import xxhash

        own = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
        self._grown(len(ids))
        out = []
        with np.errstate(over="ignore"):
            for k in range(2):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own[ids, k] * self.powers[k][: len(ids)])])
                h = (sums[self.window :] - sums[: -self.window]) * self.inverses[k][: len(ids) - self.window + 1]
                h ^= h >> np.uint64(32)  # the low bits of such sums are the weak ones
                h *= np.uint64(0xBF58476D1CE4E5B9)
                out.append(h ^ (h >> np.uint64(29)))
        return out


def later(h: np.ndarray, more: np.ndarray, keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of windows with hashes (h, more): which are behind the first of theirs, and which are to be left out of further counting.

    keys: what orders them, the most significant first.  Windows whose keys equal those of the first are no later ones (the
    row repeats), but are to be left out as well.
    """
    order = np.argsort(h)
    equal = h[order][1:] == h[order][:-1]
    some = order[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])]
    by = np.lexsort((*[k[some] for k in reversed(keys)], more[some], h[some]))
    some = some[by]
    new = np.ones(len(some), bool)
    new[1:] = (h[some][1:] != h[some][:-1]) | (more[some][1:] != more[some][:-1])
    first = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
    same = np.logical_and.reduce([k[some] == k[first] for k in keys])
    return some[~same], some[~new]


def intervals(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals (from, to) that windows with these starts, ascending, cover."""
    cut = np.flatnonzero(np.diff(starts) > window)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + window


def window_cells(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """bucket, chunk, cell: what each chunk sends to each bucket; with `settled`, windows that the chunk itself knows as later ones."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        rolling = RollingHashes(window)
        chunk = TaskContext.get().partitionId() << 32
        known, parts, docs_held, ties_held, windows = Numbers(), [], [], [], 0

        def made() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            sizes = np.array([len(p) for p in parts])
            begin = np.cumsum(sizes) - sizes
            names, ties = unsigned(np.array(docs_held, np.int64)), np.array(ties_held, np.int64).view(np.uint64)
            h, more = rolling.of(ids, list(known))
            more &= np.uint64(0xFFFFFFFF)
            doc = np.repeat(np.arange(len(parts)), sizes)
            at = np.flatnonzero(doc[: len(h)] == doc[window - 1 :])
            h, more, doc = h[at], more[at], doc[at]
            behind, out = later(h, more, (names[doc], ties[doc], at - begin[doc]))
            left = np.ones(len(h), bool)
            left[out] = False
            left = np.flatnonzero(left)
            left = left[np.argsort(h[left])]
            sent = [_answer(names, ties, doc[behind], (at - begin[doc])[behind])] if len(behind) else []
            to = [chunk_seq % buckets] * len(sent)
            cuts = np.searchsorted((h[left] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own = left[cuts[b] : cuts[b + 1]]
                met = np.zeros(len(parts), bool)
                met[doc[own]] = True
                sent.append(Cell.of(names[met], ties[met], begin[met], h[own[:1]], np.diff(h[own], prepend=h[own[0]]), more[own], at[own]))
                to.append(b)
            settled = [True] * len(behind[:1]) + [False] * (len(sent) - len(behind[:1]))
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([chunk] * len(sent), pa.int64()), pa.array(settled, pa.bool_()), pa.array(sent, pa.binary())], ["bucket", "chunk", "settled", "cell"])

        chunk_seq = TaskContext.get().partitionId()
        for batch in batches:
            for i, (doc_id, tie) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                words = batch.column(2)[i].as_py().encode().split()  # at the six ASCII white-space bytes
                if len(words) < window:
                    continue
                parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                docs_held.append(doc_id)
                ties_held.append(tie)
                windows += len(words)
                if windows >= CHUNK:
                    yield made()
                    known, parts, docs_held, ties_held, windows, chunk, chunk_seq = Numbers(), [], [], [], 0, chunk + 1, chunk_seq + 1
        if parts:
            yield made()

    return docs.select("key", "tie", "text").sortWithinPartitions("key", "tie").mapInArrow(run, "bucket int, chunk long, settled boolean, cell binary")


def _answer(names: np.ndarray, ties: np.ndarray, doc: np.ndarray, start: np.ndarray) -> bytes:
    """Later windows by document, for the chunk that they came from."""
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    met, counts = np.unique(doc, return_counts=True)
    return Cell.of(names[met], ties[met], counts, start)


def later_windows(cells: DataFrame) -> DataFrame:
    """chunk, cell: of each bucket's windows those that are not the first of their hash, back to their chunks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def reply(chunks: list[int], cells: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(cells, pa.binary())], ["chunk", "cell"])

        def counted(chunks: list[int], held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            """h, more and place of each window; documents are looked up for windows that recur only."""
            sizes = np.array([len(x[3]) for x in held])
            h = np.concatenate([x[3] for x in held])
            more = np.concatenate([x[4] for x in held])
            place = np.concatenate([x[5] for x in held])
            order = np.sort(h)
            twice = np.unique(order[1:][order[1:] == order[:-1]])
            del order
            slot = np.searchsorted(twice, h)
            slot[slot == len(twice)] = 0
            at = np.flatnonzero(twice[slot] == h) if len(twice) else np.zeros(0, np.int64)
            if not len(at):
                return
            source = np.repeat(np.arange(len(held)), sizes)[at]
            h, more, place = h[at], more[at], place[at]
            docs = np.empty(len(at), np.int64)
            names, ties, starts = (np.empty(len(at), np.uint64) for _ in range(3))
            cuts = np.searchsorted(source, np.arange(len(held) + 1))
            for k, x in enumerate(held):
                a, b = cuts[k], cuts[k + 1]
                d = np.searchsorted(x[2], place[a:b], "right") - 1
                docs[a:b], names[a:b], ties[a:b], starts[a:b] = d, x[0][d], x[1][d], place[a:b] - x[2][d]
            behind = np.sort(later(h, more, (names, ties, starts))[0])
            cuts = np.searchsorted(source[behind], np.arange(len(held) + 1))
            some = np.flatnonzero(np.diff(cuts)).tolist()
            out = [_answer(held[k][0], held[k][1], docs[own], starts[own]) for k in some for own in (behind[cuts[k] : cuts[k + 1]],)]
            if out:
                yield reply([chunks[k] for k in some], out)

        chunks, held, now = [], [], None
        for batch in batches:
            for i, (bucket, chunk, settled) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if bucket != now and held:
                    yield from counted(chunks, held)
                    chunks, held = [], []
                now = bucket
                cell = batch.column(3)[i].as_py()
                if settled:
                    yield reply([chunk], [cell])
                    continue
                x = Cell.read(cell)
                x[3:5] = [x[3] + np.cumsum(x[4])]
                x[4], x[5] = x[4].astype(np.uint32), x[5].astype(np.uint32) if x[5].max() < 1 << 32 else x[5]
                chunks.append(chunk)
                held.append(x)
        if held:
            yield from counted(chunks, held)

    return cells.mapInArrow(run, "chunk long, cell binary")


def removals(answers: DataFrame, window: int) -> DataFrame:
    """key, tie, begins, ends: the maximal removal intervals of each document that has any, from the answers of one chunk after another."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def made(held: list[list[np.ndarray]]) -> pa.RecordBatch:
            names = np.concatenate([np.repeat(x[0], x[2].astype(np.int64)) for x in held])
            ties = np.concatenate([np.repeat(x[1], x[2].astype(np.int64)) for x in held])
            starts = np.concatenate([x[3] for x in held]).astype(np.int64)
            by = np.lexsort((starts, ties, names))
            names, ties, starts = names[by], ties[by], starts[by]
            cuts = np.concatenate([[0], np.flatnonzero((names[1:] != names[:-1]) | (ties[1:] != ties[:-1])) + 1, [len(names)]])
            found = [intervals(starts[a:b], window) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x[k]) for x in found])]), pa.int32()), pa.array(np.concatenate([x[k] for x in found]), pa.int64())) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(signed(names[cuts[:-1]])), pa.array(ties[cuts[:-1]].view(np.int64)), *lists], ["key", "tie", "begins", "ends"])

        held, now = [], None
        for batch in batches:
            for i, chunk in enumerate(batch.column(0).to_pylist()):
                if chunk != now and held:
                    yield made(held)
                    held = []
                now = chunk
                held.append(Cell.read(batch.column(1)[i].as_py()))
        if held:
            yield made(held)

    found = answers.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "key long, tie long, begins array<long>, ends array<long>")
    return found.dropDuplicates(["key", "tie"])  # a row that repeats may have come from two chunks, with equal intervals


def substring_dedup(docs: DataFrame, window: int = 20, with_text: bool = False) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256 of the kept words joined by one space; with_text: also the kept text and the intervals."""
    spark = docs.sparkSession
    keyed = texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("key"), F.xxhash64("text").alias("tie"), "text")
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, round(size / 6 / BUCKET))
    tables = Tables(spark)
    cells = window_cells(keyed, window, buckets)
    dealt = cells.repartitionById(buckets, "bucket")  # one bucket a partition
    found = tables.keep("removals", removals(later_windows(dealt), window))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i, (doc_id, begins, ends) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                words = batch.column(1)[i].as_py().encode().split()
                kept, gone, at = words, 0, 0
                if begins:
                    kept = []
                    for a, b in zip(begins, ends, strict=True):
                        kept += words[at:a]
                        at = b
                        gone += b - a
                    kept += words[at:]
                text = b" ".join(kept)
                rows.append((doc_id, len(words), gone, sha256(text).hexdigest(), *((text.decode(), [list(x) for x in zip(begins or (), ends or (), strict=True)]) if with_text else ())))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "removed"]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names[: len(cols)])

    joined = keyed.join(found, ["key", "tie"], "left").select("doc_id", "text", "begins", "ends")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string, removed array<array<long>>" if with_text else ""))
