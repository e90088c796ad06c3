"""Token-ID output: one wavelet matrix per shard.

A shard file holds whole documents in ascending doc_id order: a header, the documents' ids and ends, and one bit-plane
per id bit, each with its rank directory (ones before every 512th bit, and in all).  From it alone come any token (access), the number of occurrences of an id in a range
(count) and the place of its k-th occurrence (select); reading everything back is one pass over the planes.

Shard files are the `payload` cells of a Parquet table, so Spark's commit protocol and any file system it knows apply; a
lost executor only makes its shards be written again.  Documents are dealt by ranges of doc_id; offsets come from sums
by range, never from the documents themselves.

Nulls and empty texts: the end id alone.  Null doc_ids come first.  Repeated and null doc_ids stay, in the order of the hashes
of their texts, by which they are dealt as well.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_level import SegmentEncoder
from .common import scratch, texts

MAGIC = b"WMX2"
BLOCK = 512  # bits between entries of a rank directory
GATHERED = 16 << 20  # bytes of texts encoded together


class WaveletMatrix:
    """Bit-planes from the highest bit down; below each, zeros come before ones, otherwise in order."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.planes, self.ranks = n, planes, ranks
        self.zeros = [n - int(r[-1]) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        bits = max(1, int(ids.max(initial=0)).bit_length())
        planes, ranks, x = [], [], ids
        for b in range(bits - 1, -1, -1):
            ones = (x & x.dtype.type(1 << b)) != 0
            plane = np.packbits(ones, bitorder="little")
            blocks = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            blocks[: len(plane)] = plane
            planes.append(plane)
            ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(blocks.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64))]).astype("<u4"))
            x = np.concatenate([x.take(np.flatnonzero(~ones)), x.take(np.flatnonzero(ones))])  # places are found faster than masks applied
        return cls(len(ids), planes, ranks)

    def all(self) -> np.ndarray:
        """Every token, from the lowest plane up."""
        dtype = np.uint16 if len(self.planes) <= 16 else np.uint32
        x = np.zeros(self.n, dtype)
        for b, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            up = np.empty_like(x)
            up[np.flatnonzero(~ones)] = x[:z]
            up[np.flatnonzero(ones)] = x[z:] | dtype(1 << b)
            x = up
        return x

    def _rank(self, level: int, at: int) -> int:
        """Ones among the first `at` bits of a plane."""
        block = at // BLOCK
        plane, first = self.planes[level], block * BLOCK // 8
        whole = at // 8
        count = int(self.ranks[level][block]) + int(np.bitwise_count(plane[first:whole]).sum())
        return count + (int(plane[whole] & ((1 << at % 8) - 1)).bit_count() if at % 8 else 0)

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at // 8]) >> at % 8 & 1

    def access(self, at: int) -> int:
        value = 0
        for level, z in enumerate(self.zeros):
            bit, ones = self._bit(level, at), self._rank(level, at)
            value, at = value << 1 | bit, z + ones if bit else at - ones
        return value

    def _range(self, value: int, a: int, b: int) -> tuple[int, int]:
        for level, z in enumerate(self.zeros):
            ra, rb = self._rank(level, a), self._rank(level, b)
            a, b = (z + ra, z + rb) if value >> len(self.planes) - 1 - level & 1 else (a - ra, b - rb)
        return a, b

    def count(self, value: int, a: int = 0, b: int | None = None) -> int:
        if value >> len(self.planes):
            return 0
        lo, hi = self._range(value, a, self.n if b is None else b)
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0), or -1."""
        if not 0 <= k < self.count(value):
            return -1
        at = self._range(value, 0, self.n)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> len(self.planes) - 1 - level & 1
            want = at - self.zeros[level] if bit else at
            lo, hi = 0, self.n  # the smallest prefix with want + 1 such bits
            while lo < hi:
                mid = (lo + hi) // 2
                ones = self._rank(level, mid + 1)
                if (ones if bit else mid + 1 - ones) > want:
                    hi = mid
                else:
                    lo = mid + 1
            at = lo
        return at


def pack(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    matrix = WaveletMatrix.build(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    head = struct.pack("<4sQQI", MAGIC, len(ids), len(doc_ids), len(matrix.planes))
    return b"".join([head, known.tobytes(), null.tobytes(), ends.astype("<i8").tobytes(), *(x.tobytes() for both in zip(matrix.planes, matrix.ranks, strict=True) for x in both)])


def unpack(payload: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    magic, n, docs, levels = struct.unpack_from("<4sQQI", payload)
    if magic != MAGIC:
        raise ValueError("not a shard file")
    at = struct.calcsize("<4sQQI")
    known = np.frombuffer(payload, "<i8", docs, at)
    null = np.frombuffer(payload, np.uint8, docs, at + 8 * docs)
    ends = np.frombuffer(payload, "<i8", docs, at + 9 * docs)
    at, size, blocks = at + 17 * docs, (n + 7) // 8, (n + BLOCK - 1) // BLOCK + 1
    planes, ranks = [], []
    for _ in range(levels):
        planes.append(np.frombuffer(payload, np.uint8, size, at))
        ranks.append(np.frombuffer(payload, "<u4", blocks, at + size))
        at += size + 4 * blocks
    return WaveletMatrix(n, planes, ranks), [None if x else int(d) for d, x in zip(known, null, strict=True)], ends


def gathered(batches: Iterator, most: int = GATHERED) -> Iterator:
    """Batches joined to at most so many bytes, as more places of a key then share a lookup; a larger batch stays alone."""
    import pyarrow as pa

    joined = lambda held: pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*(b.columns for b in held), strict=True)], names=held[0].schema.names)
    held: list = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > most:
            yield joined(held)
            held = []
        held.append(batch)
    if held:
        yield joined(held)


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int, tokens_per_shard: int = 1 << 20) -> None:
    """Write shards (part, shard, n_tokens, payload) as a Parquet table at `path`."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = SegmentEncoder.of(tokenizer_path)
        end, dtype = end_id.to_bytes(encoder.width, "little"), "<u2" if encoder.width == 2 else "<u4"
        part, shard = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        names: list[int | None] = []
        lengths: list[int] = []
        tokens = 0

        def flush():
            ids = np.frombuffer(b"".join(held), dtype)
            payload = pack(ids, names, np.cumsum(lengths))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], ["part", "shard", "n_tokens", "payload"])

        for batch in gathered(batches):
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), strict=True):
                held += [ids, end]
                names.append(name)
                lengths.append(len(ids) // encoder.width + 1)
                tokens += lengths[-1]
                if tokens >= tokens_per_shard:
                    yield flush()
                    held, names, lengths, tokens, shard = [], [], [], 0, shard + 1
        if names:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = texts(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(run, "part int, shard int, n_tokens long, payload binary").write.parquet(path)


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files alone."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, (part, shard) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "shard")), strict=True)):
                payload = batch.column("payload")[i].as_py()
                matrix, names, ends = unpack(payload)
                ids, starts = matrix.all().astype("<u4"), np.concatenate([[0], ends[:-1]])
                crc = [crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(names), pa.int32()), pa.array([shard] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    sizes = shards.select("part", "shard", F.col("n_tokens").alias("size"))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("part_size"))  # one row a range, so one window over them is small
    before = parts.select("part", (F.sum("part_size").over(Window.orderBy("part")) - F.col("part_size")).alias("part_start"))
    inside = sizes.withColumn("shard_start", F.sum("size").over(Window.partitionBy("part").orderBy("shard")) - F.col("size"))
    starts = inside.join(before, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))
    read = shards.select("part", "shard", "payload").mapInArrow(run, "part int, shard int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tokens_per_shard: int = 1 << 20) -> DataFrame:
    """Write every document's ids and its end id to shard files, read them back, and give one row per document."""
    spark = docs.sparkSession
    path = scratch(spark)
    write_shards(docs, tokenizer_path, path, end_id, tokens_per_shard)
    return read_shards(spark.read.schema("part int, shard int, n_tokens long, payload binary").parquet(path))
