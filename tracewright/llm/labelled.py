"""Labelled examples for the classifiers: a bounded sample by hash, never from held-out rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a model in a row, and the tasks over which its rows are dealt on their way through the driver.  Results over
#: spark.task.maxDirectResultSize (1 MB) are fetched whole, and the driver keeps the room that they took.
PIECE, DEALT = 1 << 17, 32


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 5, is 0.  A row without doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, float]:
    """(text, y, doc_id) of up to per_class texts of each class, those with the smallest md5 of doc_id, in order; and the share of class 1 among all usable labels.

    Labels are picked first, so only the texts of at most 2 * per_class rows move (a broadcast of that proven size).
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id"), F.col("y")]
    picked = [usable.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
        .orderBy("doc_id", "text", "y")
        .limit(4 * per_class)  # repeated doc_ids cannot make it longer without bound
        .select("text", "y", "doc_id")
    )
    total = counts.get(0, 0) + counts.get(1, 0)
    return rows, (counts.get(1, 0) / total if total else 0.5)


def examples(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[list[tuple[str, int, int]], float]:
    """The sample as a list, and the share of class 1."""
    rows, share = sample(docs, labels, label, per_class)
    return [(r["text"], r["y"], r["doc_id"]) for r in rows.collect()], share


class Packed:
    """A model's pickled bytes, which a task unpacks: there the broadcast's value is the model, once a worker, without bytes beside it."""

    def __init__(self, data: bytes):
        self.data = data

    def __reduce__(self):
        return pickle.loads, (self.data,)


def in_pieces(rows: DataFrame, share: float, fit: Callable) -> DataFrame:
    """fit(rows, share), pickled, as (place, piece) dealt out evenly: no result of a task is large, however large the model.

    The sample's size is bounded, so one task fits it.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        data = pickle.dumps(fit(held, share))
        for k, at in enumerate(range(0, len(data), PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data[at : at + PIECE]], pa.binary())], ["place", "piece"])

    return rows.coalesce(1).mapInArrow(run, "place int, piece binary").repartition(DEALT)


def fitted(docs: DataFrame, labels: DataFrame, label: str, per_class: int, fit: Callable) -> Broadcast:
    """fit(rows, share) of the sample, for all tasks.  The driver sees the model's bytes alone."""
    import pyarrow as pa

    rows, share = sample(docs, labels, label, per_class)
    found = in_pieces(rows, share, fit).toArrow().sort_by("place")["piece"]
    data = b"".join(x.as_buffer() for x in found) or pickle.dumps(fit([], share))  # an empty sample has no task
    del found
    pa.default_memory_pool().release_unused()  # else the driver keeps the room of the pieces
    return docs.sparkSession.sparkContext.broadcast(Packed(data))
