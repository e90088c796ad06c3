"""Log files and snippets as numbered lines.

Files are read in byte ranges by Spark's own text reader, on any file system that it knows, so a file of any size is many tasks.
A range's lines are counted, the counts are summed over the ranges of a file (one row a range), and a line's number is its
range's sum and its place in the range; no window goes over the lines themselves.
"""

from __future__ import annotations

import codecs
import fnmatch
import os
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import Running, running

MASKS = ("*.log", "*.txt", "*.json", "*.log.*")


def plain_path(uri: Column) -> Column:
    """Paths as people write them: percent signs decoded, local ones without their scheme."""
    decoded = F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.coalesce(decoded, uri), "^file:/*", "/")


def expand(inputs: list[str], masks: tuple[str, ...] = MASKS, recursive: bool = False, spark: SparkSession | None = None) -> list[str]:
    """Files of paths, folders and globs, on any file system Spark knows: distinct, sorted.  What does not exist is an error.

    Spark lists the folders, in tasks where there are many; only the names come to the driver.  Masks hold in folders alone.
    """
    spark = spark or SparkSession.builder.getOrCreate()
    found: set[str] = set()
    for given in inputs:
        path = spark._jvm.org.apache.hadoop.fs.Path(given)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        top = system.makeQualified(path).toString()
        if any(c in given for c in "*?"):
            found |= set(_listed(spark, top))
        elif not system.exists(path):
            raise FileNotFoundError(given)
        elif not system.getFileStatus(path).isDirectory():
            found |= set(_listed(spark, escaped(top)))
        elif recursive:
            found |= {p for p in _listed(spark, escaped(top)) if any(fnmatch.fnmatchcase(p.rpartition("/")[2], m) for m in masks)}
        else:
            deep = _listed(spark, escaped(top) + "/{" + ",".join(masks) + "}")
            found |= {p for p in deep if p.rpartition("/")[0] == re.sub("^file:/*", "/", top)}  # not those of folders that a mask meets
    return sorted(found)


def escaped(path: str) -> str:
    """A name, not a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    """Files of a pattern, empty ones too; a pattern that meets nothing has none.  No content is read."""
    try:
        d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return [re.sub("^file:/*", "/", unquote(uri)) for uri in d.inputFiles()]


def split_lines(sources: DataFrame) -> DataFrame:
    """(source_file, file_ord, text) -> (source_file, file_ord, line_no, line), as a line reader would give them."""
    parts = F.split("text", r"\r\n|\r|\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    lines = sources.select("source_file", "file_ord", F.posexplode(parts).alias("pos", "line"))
    first = F.when(F.col("pos") == 0, F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line"))
    return lines.select("source_file", "file_ord", (F.col("pos") + 1).alias("line_no"), first.alias("line"))


def from_text(spark: SparkSession, text: str, name: str = "snippet") -> DataFrame:
    return split_lines(spark.createDataFrame([(name, 0, text)], "source_file string, file_ord int, text string"))


def _same_line_ends(charset: str) -> bool:
    """Whether the single bytes 10 and 13 end lines in the charset and mean nothing else."""
    if codecs.lookup(charset).name in ("utf-7", "hz", "iso2022_jp", "iso2022_kr"):
        return False
    try:
        return all(chr(b).encode(charset) == bytes([b]) for b in range(128))
    except UnicodeEncodeError:
        return False


def _ranges(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """at, range (its first byte), nth (ascending inside a range) and value of every line, as Spark's text reader cuts them."""
    d = spark.read.options(**options).text([escaped(p) for p in paths])
    return d.select(plain_path(F.col("_metadata.file_path")).alias("at"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("nth"), F.col("value"))


def _texts(d: DataFrame, work: Callable, result: str) -> DataFrame:
    """d with `value` (bytes) replaced by what work makes of it, in Arrow batches."""
    names = [c for c in d.columns if c != "value"]
    kinds = dict(d.dtypes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [work(*r) for r in zip(*(batch.column(n).to_pylist() for n in ("value", *names)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(got, pa.string() if "array" not in result else pa.list_(pa.string()))], [*names, result.split()[0]])

    return d.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", " + result)


def _byte_lines(spark: SparkSession, paths: list[str], charset: str) -> DataFrame:
    """at, range, nth and line, null where its bytes are no text of the charset."""
    d = _ranges(spark, paths)
    if codecs.lookup(charset).name == "utf-8":
        return d.select("at", "range", "nth", F.when(F.is_valid_utf8("value"), F.col("value")).alias("line"))

    def text(value: bytes, *_: object) -> str | None:
        try:
            return value.decode(charset)
        except UnicodeDecodeError:
            return None

    return _texts(d.withColumn("value", F.col("value").cast("binary")), text, "line string")


def _wide_lines(spark: SparkSession, paths: list[str], charset: str) -> DataFrame:
    """The same for UTF-16 and UTF-32, whose units of two or four bytes may hold the byte 10 in any place and lie across ranges.

    Ranges are cut at every byte 10.  Running sums of lengths give each of these bytes its offset in the file; those in the
    place of a unit's low byte, with zeros for the rest of it, are line feeds.  Pieces up to the next one are joined again.
    """
    name = codecs.lookup(charset).name
    width = 4 if "32" in name else 2
    marks = {2: (b"\xff\xfe", b"\xfe\xff"), 4: (b"\xff\xfe\0\0", b"\0\0\xfe\xff")}[width]
    d = _ranges(spark, paths, lineSep="\n").withColumn("value", F.col("value").cast("binary"))
    head = F.substring("value", 1, width)
    known = F.lit(name.endswith("-le")) if name.endswith(("-le", "-be")) else head == F.lit(marks[0])
    # by file: whether the low byte of a unit comes first; without a mark it comes last
    low_first = d.groupBy("at").agg(F.min_by(known, F.struct("range", "nth")).alias("low_first"))
    values = {"end": Running("total", F.octet_length("value") + 1), "next": Running("following", F.substring("value", 1, width - 1))}
    d = running(d, ["at"], [F.col("range"), F.col("nth")], values, F.col("range")).join(low_first, "at")
    zeros = F.lit(bytes(width - 1))
    low = (F.col("end") - 1) % width == 0
    feeds = F.when(F.col("low_first"), low & (F.col("next") == zeros)).otherwise((F.col("end") % width == 0) & (F.substring("value", 1 - width, width - 1) == zeros))
    d = d.withColumn("feed", F.coalesce(feeds, F.lit(False)))
    d = running(d, ["at"], [F.col("range"), F.col("nth")], {"feeds": Running("total", F.col("feed").cast("int"))}, F.col("range"))
    d = d.withColumn("segment", F.col("feeds") - F.col("feed").cast("int"))
    pieces = F.array_sort(F.collect_list(F.struct("range", "nth", "value")))
    d = d.groupBy("at", "segment", "low_first").agg(pieces.alias("pieces"), F.bool_or("feed").alias("ended"))
    joined = F.aggregate(F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(0))), F.get("pieces", 0)["value"], lambda a, x: F.concat(a, F.lit(b"\n"), x["value"]))
    d = d.select("at", F.get("pieces", 0)["range"].alias("range"), "segment", "low_first", "ended", joined.alias("value"))

    def lines(value: bytes, at: str, start: int, segment: int, low_first: bool, ended: bool) -> list[str | None]:
        if segment and low_first:
            value = value[width - 1 :]  # the rest of the line feed before
        if ended and not low_first:
            value = value[: len(value) - width + 1]
        if not segment and value.startswith(marks):
            value = value[width:]
        try:
            text = value.decode(f"utf-{8 * width}-{'le' if low_first else 'be'}")
        except UnicodeDecodeError:
            return [None]
        parts = text.split("\r")
        return parts[:-1] if parts[-1] == "" and (len(parts) > 1 or not ended) else parts

    d = _texts(d, lines, "parts array<string>").select("at", "range", "segment", F.posexplode("parts").alias("pos", "line"))
    return d.select("at", "range", F.row_number().over(Window.partitionBy("at", "range").orderBy("segment", "pos")).cast("long").alias("nth"), "line")


def from_files(spark: SparkSession, paths: list[str], charset: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(lines, warnings).  Files come in the order given; undecodable and empty ones give a warning."""
    named = [(p.removeprefix("file:") if "://" in p or p.startswith("file:") else os.path.abspath(p), p, i) for i, p in enumerate(paths)]
    named = [("/" + at.lstrip("/") if p.startswith("file:") else at, p, i) for at, p, i in named]
    order = spark.createDataFrame(named, "at string, source_file string, file_ord int")
    if not paths:
        return split_lines(order.withColumn("text", F.lit(""))), order.select("source_file", F.lit("").alias("warning"))
    wide = codecs.lookup(charset).name.startswith(("utf-16", "utf-32"))
    if not wide and not _same_line_ends(charset):
        raise ValueError(f"{charset} has no line ends of its own")
    lines = (_wide_lines if wide else _byte_lines)(spark, paths, charset)
    sums = lines.groupBy("at", "range").agg(F.count("*").alias("n"), F.min("nth").alias("first"), F.count_if(F.col("line").isNull()).alias("bad"))
    # one row a range: what stands before it in its file
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("at").orderBy("range")) - F.col("n")).withColumn("broken", F.sum("bad").over(Window.partitionBy("at")) > 0)
    known = order.join(sums, "at", "left")
    files = known.groupBy("source_file").agg(F.bool_or("broken").alias("broken"))
    bad = files.where("broken").select("source_file", F.lit(f"cannot be decoded as {charset}").alias("warning"))
    empty = files.where("broken IS NULL").select("source_file", F.lit("empty file").alias("warning"))
    numbered = lines.join(known.where("NOT broken").select("at", "range", "first", "before", "source_file", "file_ord"), ["at", "range"])
    no = F.col("before") + F.col("nth") - F.col("first") + 1
    line = F.when(no == 1, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line"))
    return numbered.select("source_file", "file_ord", no.alias("line_no"), line.alias("line")), bad.unionByName(empty)
