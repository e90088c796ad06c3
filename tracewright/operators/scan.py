"""Running values over the rows of a key in their order, also in blocks, so that no task has to hold a whole key.

Without blocks these are plain windows by key.  With a block (a column that never falls along the order, such as an hour or a
range of line numbers) the work is a two-level scan: windows by (key, block); one summary row of each block, made by partial
aggregation; the summaries' own running value, which is what a block is handed from those before (or behind) it; and a join by
(key, block), for which the rows lie right already.  Every value here is associative, so both ways give the same.

A scan in blocks reads its rows twice, so they are checkpointed first (spark.checkpoint.dir); plans of several scans would double otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

Kind = Literal["total", "last", "before", "previous", "following", "first"]


@dataclass(frozen=True)
class Running:
    """total: sum up to this row; last, before: last value that is not null, this row's included or not; previous: the value of the row before, null or not;
    following: first value that is not null behind this row; first: first such value of the whole key."""

    kind: Kind
    value: Column


def _known(value: Column, place: Column) -> Column:
    return F.when(value.isNotNull(), place)


def _within(r: Running, w: WindowSpec) -> Column:
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    if r.kind == "total":
        return F.sum(r.value).over(w.rowsBetween(start, 0))
    if r.kind == "last":
        return F.last(r.value, ignorenulls=True).over(w.rowsBetween(start, 0))
    if r.kind == "before":
        return F.last(r.value, ignorenulls=True).over(w.rowsBetween(start, -1))
    if r.kind == "previous":
        return F.lag(r.value).over(w)
    if r.kind == "following":
        return F.first(r.value, ignorenulls=True).over(w.rowsBetween(1, end))
    return F.first(r.value, ignorenulls=True).over(w.rowsBetween(start, end))


def _summary(r: Running, place: Column) -> Column:
    if r.kind == "total":
        return F.sum(r.value)
    if r.kind == "previous":
        return F.max_by(F.struct(r.value.alias("v")), place)  # the last row's value, null or not
    return (F.max_by if r.kind in ("last", "before") else F.min_by)(r.value, _known(r.value, place))


def _handed(r: Running, summary: Column, by: WindowSpec) -> Column:
    """What a block gets from the others."""
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    if r.kind == "total":
        return F.sum(summary).over(by.rowsBetween(start, -1))
    if r.kind in ("last", "before"):
        return F.last(summary, ignorenulls=True).over(by.rowsBetween(start, -1))
    if r.kind == "previous":
        return F.lag(summary).over(by)["v"]
    return F.first(summary, ignorenulls=True).over(by.rowsBetween(1, end) if r.kind == "following" else by.rowsBetween(start, end))


def running(rows: DataFrame, key: list[str], order: list[Column], values: dict[str, Running], block: Column | None = None) -> DataFrame:
    """rows with one column more for each of `values`.  order: ascending, nulls first; equal rows of an order get their values in either sequence."""
    if block is None:
        w = Window.partitionBy(*key).orderBy(*order)
        return rows.withColumns({name: _within(r, w) for name, r in values.items()})
    place = placed(order)
    d = keyed(rows, key, block)
    sums = d.groupBy("_key", "_block").agg(*[_summary(r, place).alias(f"_s{i}") for i, r in enumerate(values.values())])
    by = Window.partitionBy("_key").orderBy("_block")
    handed = sums.select("_key", "_block", *[_handed(r, F.col(f"_s{i}"), by).alias(f"_h{i}") for i, r in enumerate(values.values())])
    w = Window.partitionBy("_key", "_block").orderBy(*order)
    d = d.withColumns({f"_w{i}": _within(r, w) for i, r in enumerate(values.values())} | {"_nth": F.row_number().over(w)})
    d = d.join(handed, ["_key", "_block"])
    out = {}
    for i, (name, r) in enumerate(values.items()):
        own, other = F.col(f"_w{i}"), F.col(f"_h{i}")
        if r.kind == "total":
            out[name] = F.coalesce(own + other, own, other)
        elif r.kind == "previous":
            out[name] = F.when(F.col("_nth") == 1, other).otherwise(own)
        else:
            out[name] = other if r.kind == "first" else F.coalesce(own, other)
    return d.select(*[c for c in rows.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def placed(order: list[Column]) -> Column:
    return F.struct(*[c.alias(f"p{i}") for i, c in enumerate(order)])


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows without their history.  Only in local mode may spark.checkpoint.dir be missing; a folder of our own is used then."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file:///tmp/checkpoints/tracewright")
    return rows.checkpoint()


def keyed(rows: DataFrame, key: list[str], block: Column) -> DataFrame:
    """rows, checkpointed, with _key and _block.  A struct of the key is never null itself, so keys with nulls join like others."""
    d = rows.withColumns({"_key": F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)]), "_block": block})
    return checkpointed(d)


def cuts(rows: DataFrame, key: list[str], order: list[Column], cut: Callable[[dict[str, Column], dict[str, Column]], Column], told: dict[str, Column], block: Column | None, name: str, alive: tuple[str, Column] | None = None) -> DataFrame:
    """rows with `name`: how many rows of the key, up to and with this one, are cut off from the row before them.

    cut(of this row, of the row before): whether there is a cut, from the columns `told`; null is no cut, and so is a key's first row.
    alive (column, value): the last value that is not null since the last cut, this row's included.
    """
    fields = lambda s: {n: s[n] for n in told}
    own = F.struct(*[c.alias(n) for n, c in told.items()])
    is_cut = lambda now, before: F.coalesce(cut(fields(now), fields(before)), F.lit(False)).cast("int")
    by = [F.col(k) for k in key] if block is None else [F.col("_key"), F.col("_block")]
    d = rows if block is None else keyed(rows, key, block)
    w = Window.partitionBy(*by).orderBy(*order)
    d = d.withColumn("_own", own).withColumn("_before", F.lag("_own").over(w))
    d = d.withColumn("_cut", F.when(F.col("_before").isNull(), 0).otherwise(is_cut(F.col("_own"), F.col("_before"))))
    d = d.withColumn("_cuts", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if alive:
        d = d.withColumn("_alive", F.last(alive[1], ignorenulls=True).over(Window.partitionBy(*by, "_cuts").orderBy(*order)))
    if block is not None:
        place = placed(order)
        ends = [F.min_by("_own", place).alias("_first"), F.max_by("_own", place).alias("_last"), F.max("_cuts").alias("_inner")]
        sums = d.groupBy("_key", "_block").agg(*ends, *([F.max_by(F.struct(F.col("_alive").alias("v")), place).alias("_tail")] if alive else []))
        over = Window.partitionBy("_key").orderBy("_block")
        before = over.rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_prior", F.lag("_last").over(over)).withColumn("_joint", F.when(F.col("_prior").isNull(), 0).otherwise(is_cut(F.col("_first"), F.col("_prior"))))
        # cuts before the first row's own place in the block, and the cut in front of that row
        sums = sums.withColumn("_base", F.sum("_joint").over(over.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("_inner").over(before), F.lit(0)))
        kept = ["_base"]
        if alive:
            known = F.when(F.col("_tail.v").isNotNull(), F.struct(F.col("_tail.v").alias("v"), (F.col("_base") + F.col("_inner")).alias("at")))
            sums = sums.withColumn("_from", F.last(known, ignorenulls=True).over(before)).withColumn("_handed", F.when(F.col("_from.at") == F.col("_base"), F.col("_from.v")))
            kept.append("_handed")
        d = d.join(sums.select("_key", "_block", *kept), ["_key", "_block"])
        if alive:
            d = d.withColumn("_alive", F.coalesce("_alive", F.when(F.col("_cuts") == 0, F.col("_handed"))))
        d = d.withColumn("_cuts", F.col("_cuts") + F.col("_base"))
    return d.select(*rows.columns, F.col("_cuts").alias(name), *([F.col("_alive").alias(alive[0])] if alive else []))


def whole(rows: DataFrame, key: list[str], values: dict[str, Column], blocks: bool) -> DataFrame:
    """rows with aggregates of their whole key: by a window, or in blocks by partial sums and a join."""
    if not blocks:
        w = Window.partitionBy(*key)
        return rows.withColumns({n: c.over(w) for n, c in values.items()})
    d = keyed(rows, key, F.lit(0)).drop("_block")
    sums = d.groupBy("_key").agg(*[c.alias(n) for n, c in values.items()])
    return d.join(sums, "_key").drop("_key")
