"""Alignment of two tokenizers over a corpus, each distinct text being tokenised and aligned once.

A text, behind one space, is encoded by a byte-level BPE file (A) and by a SentencePiece BPE model (B).  Byte offsets at which a
token of either ends cut both token sequences into groups; every A token of a group is linked with every B token of it.  An
id pair's count is the number of documents, of the whole corpus, that hold it linked.

Steps and what moves:
1. Texts are shuffled whole, so equal texts meet: one row each with its number of copies (partial counts first, so a text that a
   third of all documents share leaves each task once).
2. Tasks encode and align chunks of distinct texts.  A chunk is stored as one row: its distinct id pairs with the number of documents in
   which they are linked, copies included, and by text the measures and the links as places in that list of pairs.
3. Pair counts are summed over chunks; the chunks' lists meet the sums by pair and go back to their chunks.
4. Measures by text meet the documents by the text's sha256.

Nulls, empty texts, and texts whose tokens do not give back their bytes: no tokens, all measures 0 and groups_sha256 ''.  Repeated rows: one result
each, and each counts as a document.  Null doc_ids: as others.  Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_level import load
from .common import Tables, small_batches, texts
from .sentencepiece_bpe import MARK
from .substring_dedup import Cell

#: Characters of text in a chunk, characters aligned at once, and links of a group beyond which its distinct ids are paired instead of its tokens.
CHUNK, AT_ONCE, LARGE = 12_000_000, 1_000_000, 10_000
#: Fixed value: how byte-level files of this kind part a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEASURES = ("n_a", "n_b", "n_groups", "n_links")


class ByteLevel:
    """Ids and bytes of a byte-level BPE file.  Where its merges stand in the order of their ids, the file is read as ranks and the faster library encodes."""

    def __init__(self, path: str):
        self.slow = load(path)
        self.slow.encode_special_tokens = True
        told = json.loads(self.slow.to_str())
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"] for t in told["added_tokens"]}
        vocab = {w: i for w, i in told["model"]["vocab"].items() if w not in special}
        self.bytes_of = [b""] * self.slow.get_vocab_size(with_added_tokens=True)
        for w, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in w)
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in told["model"]["merges"]]
        split = told["pre_tokenizer"] or {}
        plain = not told["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.fast = None
        if plain and merged == sorted(merged) and all(len(b) == 1 for b in self.bytes_of[: merged[0]]):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={self.bytes_of[i]: i for i in vocab.values()}, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast and len(text) < 1_000_000:  # its splitter may give up on longer runs of white space
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


class Aligner:
    """Both tokenizers; kept per Python worker."""

    _kept: dict[tuple[str, str], "Aligner"] = {}

    @classmethod
    def of(cls, *paths: str) -> "Aligner":
        if paths not in cls._kept:
            cls._kept[paths] = cls(*paths)
        return cls._kept[paths]

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.a = ByteLevel(byte_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in pieces]
        self.bytes_a = self.a.bytes_of
        self.n_b = len(pieces)
        self.size_a, self.size_b = (np.array([len(b) for b in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # a token's place among the strings of `told`: its id, then what stands behind it
        self.told = [f"{i}{sign}" for i in range(max(len(self.bytes_a), self.n_b)) for sign in ",|;"]

    def ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """A's and B's ids; None if either does not give back the text."""
        whole = (" " + text).encode()
        b = self.b.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        a = self.a.encode(" " + text)
        return (a, b) if b"".join(map(self.bytes_a.__getitem__, a)) == whole else None

    def align(self, texts_: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """For some texts: their measures (a row each), digests of their groups, and (text, pair, occurrences) of the linked id pairs, sorted."""
        measures, digests = np.zeros((len(texts_), 4), np.int64), [b""] * len(texts_)
        found = [(k, both) for k, t in enumerate(texts_) if t and (both := self.ids(t))]
        if not found:
            return measures, digests, *(np.zeros(0, np.int64) for _ in range(3))
        which = np.array([k for k, _ in found])
        sizes = np.array([[len(a), len(b)] for _, (a, b) in found])
        a = np.fromiter((i for _, (x, _) in found for i in x), np.int64, int(sizes[:, 0].sum()))
        b = np.fromiter((i for _, (_, x) in found for i in x), np.int64, int(sizes[:, 1].sum()))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.zeros(int(end_a[-1]) + 1, np.uint8)
        ends[end_a] = 1
        ends[end_b] += 2
        cut_a, cut_b = ends[end_a] == 3, ends[end_b] == 3
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        n_groups = int(group_a[-1]) + 1
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        edge = np.cumsum(sizes[:, 0])
        first = np.concatenate([[0], group_a[edge - 1] + 1])  # of each text's groups
        doc = np.repeat(which, np.diff(first))  # by group
        measures[which] = np.column_stack([sizes, np.diff(first), np.add.reduceat(in_a * in_b, first[:-1])])
        # a group is told as its A ids, then its B ids
        place = np.empty(len(a) + len(b), np.int64)
        place[np.arange(len(a)) + from_b[group_a]] = 3 * a + cut_a
        place[np.arange(len(b)) + (from_a + in_a)[group_b]] = 3 * b + 2 * cut_b
        place = place.tolist()
        at = 0
        for k, n in zip(which.tolist(), sizes.sum(1).tolist(), strict=True):
            digests[k] = sha256("".join(map(self.told.__getitem__, place[at : at + n]))[:-1].encode()).digest()
            at += n
        del place
        return measures, digests, *self._links(a, b, group_a, in_a, in_b, from_a, from_b, doc)

    def _links(self, a, b, group_a, in_a, in_b, from_a, from_b, doc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        large = in_a * in_b > LARGE
        each = np.flatnonzero(~large[group_a])
        times = in_b[group_a[each]]
        begin = np.cumsum(times) - times
        left = np.repeat(each, times)
        group = group_a[left]
        right = np.arange(len(left)) - np.repeat(begin, times) + from_b[group]
        span = len(self.bytes_a) * self.n_b
        codes = doc[group] * span + a[left] * self.n_b + b[right]
        del left, right, group
        codes.sort()
        new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        codes, counts = codes[new], np.diff(new, append=len(codes))
        if large.any():
            more = [(codes, counts)]
            for g in np.flatnonzero(large).tolist():
                x, nx = np.unique(a[from_a[g] : from_a[g] + in_a[g]], return_counts=True)
                y, ny = np.unique(b[from_b[g] : from_b[g] + in_b[g]], return_counts=True)
                more.append(((doc[g] * span + x[:, None] * self.n_b + y).ravel(), (nx[:, None] * ny).ravel()))
            codes, back = np.unique(np.concatenate([c for c, _ in more]), return_inverse=True)
            counts = np.zeros(len(codes), np.int64)
            np.add.at(counts, back, np.concatenate([n for _, n in more]))
        return codes // span, codes % span, counts


def aligned_chunks(distinct: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """chunk, its pairs and in how many documents each is linked, and a cell with all else about its texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        aligner = Aligner.of(byte_path, piece_path)
        chunk = TaskContext.get().partitionId() << 32
        keys: list[bytes] = []
        copies: list[int] = []
        groups: list[bytes] = []
        parts: list[tuple] = []

        def made() -> pa.RecordBatch:
            measures = np.concatenate([p[0] for p in parts])
            before = np.cumsum([0] + [len(p[0]) for p in parts])
            doc = np.concatenate([p[1] + n for p, n in zip(parts, before, strict=False)])
            pairs, place = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
            weights = np.bincount(place, np.array(copies, float)[doc], minlength=len(pairs)).astype(np.int64)
            cell = Cell.of(*measures.T, np.bincount(doc, minlength=len(measures)), place, np.concatenate([p[3] for p in parts]))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(x, pa.int64())) for x in (pairs, weights)]
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *lists, pa.array([b"".join(keys)]), pa.array([b"".join(g.ljust(32, b"\0") for g in groups)]), pa.array([cell])], ["chunk", "pairs", "documents", "keys", "groups", "cell"])

        held, size, total = [], 0, 0

        def aligned() -> None:
            measures, digests, *links = aligner.align(held)
            parts.append((measures, links[0].astype(np.int32), links[1], links[2].astype(np.int32) if links[2].max(initial=0) < 1 << 31 else links[2]))
            groups.extend(digests)

        for batch in batches:
            for i, n in enumerate(batch.column(1).to_pylist()):
                text = batch.column(0)[i].as_py()
                keys.append(sha256(text.encode()).digest())
                copies.append(n)
                held.append(text)
                size += len(text)
                if size > AT_ONCE:
                    aligned()
                    total += size
                    held, size = [], 0
                    if total > CHUNK:
                        yield made()
                        keys, copies, groups, parts, total, chunk = [], [], [], [], 0, chunk + 1
        if held:
            aligned()
        if keys:
            yield made()

    return distinct.select("text", "copies").mapInArrow(run, "chunk long, pairs array<long>, documents array<long>, keys binary, groups binary, cell binary")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair, documents: corpus-wide.  A pair is A's id times the number of B's ids, plus B's id."""
    each = chunks.select(F.explode(F.arrays_zip("pairs", "documents")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.documents").alias("documents"))
    return each.groupBy("pair").agg(F.sum("documents").alias("documents"))


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    spark = docs.sparkSession
    n_b = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    tables = Tables(spark)
    small_batches(spark)
    own = texts(docs)
    distinct = own.where("text != ''").groupBy("text").agg(F.count("*").alias("copies"))
    chunks = tables.keep("chunks", aligned_chunks(distinct, byte_path, piece_path))
    # an A id has n_b pairs at most, so its window is bounded by the vocabulary
    best = F.max("documents").over(Window.partitionBy(F.expr(f"pair div {n_b}")))
    counts = pair_counts(chunks).withColumn("best", F.col("documents") == best)
    asked = chunks.select("chunk", F.explode("pairs").alias("pair"))
    told = asked.join(counts, "pair").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pair", "documents", "best"))).alias("told"))
    answered = chunks.select("chunk", "keys", "groups", "cell").join(told.select("chunk", F.col("told.documents").alias("documents"), F.col("told.best").alias("best")), "chunk", "left")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                keys, groups, cell = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                *measures, links, place, times = (x.astype(np.int64) for x in Cell.read(cell))
                n = len(links)
                doc = np.repeat(np.arange(n), links)
                told, best = (np.asarray(batch.column(c)[i].values) if batch.column(c)[i].is_valid else np.zeros(0, np.int64) for c in (4, 5))
                n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(n_best, doc, times * best[place])
                np.add.at(count_sum, doc, times * told[place])
                cut = lambda data: [data[32 * k : 32 * k + 32] for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k.hex() for k in cut(keys)]), *(pa.array(m) for m in (*measures, n_best, count_sum)), pa.array([g.hex() if m else "" for g, m in zip(cut(groups), measures[0].tolist(), strict=True)])],
                    ["text_sha256", *MEASURES, "n_best", "count_sum", "groups_sha256"],
                )

    numbers = [*MEASURES, "n_best", "count_sum"]
    by_text = answered.mapInArrow(run, "text_sha256 string, " + ", ".join(f"{c} long" for c in numbers) + ", groups_sha256 string")
    keyed = own.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return keyed.join(by_text, "text_sha256", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
