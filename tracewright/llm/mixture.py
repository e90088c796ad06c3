"""Mixing sources to target weights by systematic sampling.

Weights give each source a share of all words; no target is above `most` times its source's words, the excess going to
the others by weight until none is above (the level where sum(min(level * weight, cap)) meets the total).  A document's
expected copies are target / source_size of its source.  Documents of a source stand in one order, their expected copies
are summed along it from a random offset, and each whole number crossed emits the document once.

The order is (size class, hash of doc_id): neighbours are alike in size, so every stretch of the order gives its share
of words.  Running positions come from counts of (source, size class, salt) cells and a row number inside a cell, so a
source that holds a third of all rows is spread over many tasks.  Only md5 decides, so reruns agree.

Null text: size 0.  Null source: a source of its own, last.  A source without words: target 0, nothing taken.
Repeated doc_ids are separate documents, told apart by their texts; equal rows of one doc_id share one hash, so their order cannot
matter to any sum.  Other columns stay as they are in mixed(), which copies rows; mixture() returns its own columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

SALT_DIGITS = 2  # 256 cells for each size class of a source


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the md5 of text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """sizes(source, source_size) -> with weight and target.  One row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(most))
    # in the order of cap / weight the capped sources come first
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    # the level is left / weight_left at the first source whose cap is not below it
    t = t.withColumn("level", F.col("left") / F.col("weight_left"))
    below = F.col("level") * F.col("weight") <= F.col("cap")
    first = F.min(F.when(below, F.struct((F.col("cap") / F.col("weight")).alias("rank"), "level"))).over(every)
    t = t.withColumn("common", first["level"])
    return t.select("source", "source_size", F.coalesce(F.least(F.col("common") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _copies(rows: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """rows(doc, doc_id, source, size, tie) -> doc, size, source_size, target, copies."""
    d = rows.select(
        "doc",
        "size",
        "tie",
        "source",
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), "source")).alias("key"),
        F.floor(F.sqrt(F.col("size").cast("double"))).alias("class"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("hash"),
    ).withColumn("salt", F.substring("hash", 1, SALT_DIGITS))
    cells = d.groupBy("key", "source", "class", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    t = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    t = t.withColumn("key", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), "source"))).drop("source")
    ahead = Window.partitionBy("key").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.drop("source").withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n", "words").join(t, "key")
    inner = Window.partitionBy("key", "class", "salt").orderBy("hash", "size", "tie")
    d = d.withColumn("row", F.row_number().over(inner)).join(starts, ["key", "class", "salt"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at, u = (F.col("before") + F.col("row")).cast("double"), _unit(F.coalesce(F.col("source"), F.lit("")))
    copies = F.floor(at * rate + u) - F.floor((at - F.lit(1.0)) * rate + u)
    return d.select("doc", "size", "source_size", "target", F.least(copies, F.lit(int(most)).cast("long")).alias("copies"))


def _rows(docs: DataFrame, doc: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(doc.alias("doc"), "doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("tie"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    d = _copies(_rows(docs, F.col("doc_id")), weights, most)
    return d.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs."""
    d = _copies(_rows(docs, F.struct(*docs.columns)), weights, most)
    return d.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS hash
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3.0::DOUBLE AS cap,
             [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / ((sum(weight) OVER ())
             - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM w),
c AS (SELECT arg_min(level, cap / weight) AS common FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, coalesce(least(common * weight, cap), cap) AS target FROM l CROSS JOIN c),
p AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY floor(sqrt(size::DOUBLE)), hash, size)::DOUBLE AS pos,
         ('0x' || substr(md5(coalesce(d.source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (least(floor(pos * rate + u) - floor((pos - 1.0::DOUBLE) * rate + u), 3)::BIGINT * size)::BIGINT AS taken
FROM p
"""
