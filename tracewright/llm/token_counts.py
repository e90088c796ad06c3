"""Token counts, huge documents by overlapping chunks that are brought back in step.

A huge document is encoded in chunks that overlap, with offsets.  Inside an overlap both encodings are cut at one
position that (1) is stable: no splitter pattern or special string can reach over it, whatever the context, and (2) both
encodings show as a token boundary.  Left of it the earlier chunk's tokens count, right of it the later one's.  When an
overlap holds no such position it is doubled to the left, in the end to the whole earlier chunk, and the chunks become one.
Shorter documents go through the same library, segment by segment between stable positions.

Nulls and empty texts: 0 bytes, 0 tokens.  Repeated rows: one result each.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .byte_level import STABLE, SegmentEncoder
from .common import texts


def resync_count(tokenizer, text: str, chunk: int, overlap: int) -> int:
    """Number of tokens of text, from overlapping chunks."""

    def ends(a: int, b: int) -> list[int]:
        return [a + e for _, e in tokenizer.encode(text[a:b], add_special_tokens=False).offsets]

    total, a, b, cut = 0, 0, min(chunk, len(text)), 0  # the current chunk is text[a:b]; tokens up to cut are counted
    left = ends(a, b)
    while b < len(text):
        reach, after = overlap, min(b + chunk, len(text))
        while True:
            start = b - reach
            if start <= cut:  # never in step: the two chunks become one
                b = after
                left = ends(a, b)
                break
            right = ends(start, after)
            inner = {e for e in left if start < e < b} & set(right)
            places = [start + m.start() for m in STABLE.finditer(text[start:b]) if start + m.start() in inner]
            if places:
                at = places[len(places) // 2]
                total += sum(cut < e <= at for e in left)
                a, b, cut, left = start, after, at, right
                break
            reach *= 2
    return total + sum(e > cut for e in left)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, huge: int = 32_768, chunk: int = 16_384, overlap: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens); texts over `huge` characters go by chunks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        encoder = SegmentEncoder.of(tokenizer_path)
        for batch in batches:
            every = batch.column(1).to_pylist()
            counts = [resync_count(encoder.tokenizer, t, chunk, overlap) if len(t) > huge else len(encoder.encode(t)) // encoder.width for t in every]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(batch.column(1)).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
