"""Point files as DataFrames (scan, pid, x, y, z): PLY, PCD, STL, OBJ, delimited text, NPY and NPZ.

Line formats are read as text, in splits, and parsed by column functions. Binary formats are read by
ranges of records after a scan of the headers, so that a large file is many tasks. pid is the row's
place in its file, from 0.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import cut, finite
from . import layout

SCHEMA = "scan string, pid long, x double, y double, z double"
SEPARATORS = {".csv": ",", ".tsv": "\t", ".xyz": r"\s+", ".txt": r"\s+"}


#: Records of about so many bytes are read by a task.
RANGE_BYTES = 32_000_000


def _open(path: str):
    """A file of the shared store, to be read from any place."""
    from pyarrow import fs

    if path.startswith("file:"):
        return open(unquote("/" + path.removeprefix("file:").lstrip("/")), "rb")
    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(scan, size, content): contents are read only where they are asked for."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("_metadata.file_path").alias("scan"), F.col("length").alias("size"), "content")


def _in_reach(files: DataFrame) -> bool:
    """Whether tasks can open the files by their paths; some stores can be read by Spark's own sources only."""
    first = files.select("scan").first()
    try:
        if first is not None:
            _open(first.scan).close()
        return True
    except (OSError, ValueError, ImportError):  # pyarrow's ArrowInvalid is a ValueError
        return False


def ranges(files: DataFrame, suffix: str, range_bytes: int = RANGE_BYTES, by_path: bool = True) -> DataFrame:
    """(scan, the columns of Layout, first, n): the record ranges of the listed files.

    Tasks read the headers, so that no file passes the driver. A file of lines, or one to be unpacked,
    is one range, and so is every file if not `by_path`.
    """

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                with _open(r.scan) if by_path else io.BytesIO(r.content) as f:
                    at = layout.BY_SUFFIX[suffix](f, int(r.size))
                split = by_path and at.way == layout.RECORDS
                step = max(1, range_bytes // max(1, at.dtype.itemsize)) if split else max(1, at.records)
                firsts = np.arange(0, max(1, at.records), step, dtype=np.int64)
                yield pd.DataFrame({"scan": r.scan, **at._asdict(), "first": firsts, "n": np.minimum(step, at.records - firsts)})

    kind = "scan string, way string, at long, records long, kind string, xyz string, points int, columns boolean, first long, n long"
    return (files.drop("content") if by_path else files).mapInPandas(scan, kind)


def _points(f, at: layout.Layout, first: int, n: int, scan: str, batch: int = 100_000) -> Iterator[pa.RecordBatch]:
    if at.way == layout.STREAM:
        blocks = layout.unpacked(f)
    else:
        blocks = ((i * at.points, at.read(f, i, min(batch, first + n - i))) for i in range(first, first + n, batch))
    for pid, p in blocks:
        columns = [pa.array([scan] * len(p)), pa.array(np.arange(pid, pid + len(p))), *[pa.array(np.ascontiguousarray(c)) for c in p.T]]
        yield pa.RecordBatch.from_arrays(columns, ["scan", "pid", "x", "y", "z"])


def _read_ranges(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for r in part.to_pylist():
            with _open(r["scan"]) as f:
                yield from _points(f, layout.Layout(*[r[c] for c in layout.Layout._fields]), r["first"], r["n"], r["scan"])


def _read_contents(files: DataFrame, suffix: str) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                f = io.BytesIO(r["content"])
                at = layout.BY_SUFFIX[suffix](f, r["size"])
                if at.way != layout.LINES:
                    yield from _points(f, at, 0, at.records, r["scan"])

    return files.mapInArrow(run, SCHEMA)


def _read_lines(spark: SparkSession, path: str, heads: DataFrame, suffix: str) -> DataFrame:
    """Points of files of lines, in splits: blank lines, comments and the header's lines are none."""
    bare = lambda v: F.trim(F.regexp_replace(v, "#.*$", ""))
    kept = (lambda v: bare(v).startswith("vertex ")) if suffix == ".stl" else (lambda v: bare(v) != "")
    table = heads.select("scan", "at", "records", F.from_json("xyz", "array<array<int>>").alias("xyz"))
    d = _numbered(spark, path, kept).join(table, "scan").withColumn("pid", F.col("pid") - F.col("at"))
    d = d.where((F.col("pid") >= 0) & (F.col("pid") < F.col("records"))).withColumn("t", F.split(bare(F.col("line")), r"\s+"))
    named = [F.try_element_at("t", F.col("xyz")[i][0] + 1).try_cast("double").alias(c) for i, c in enumerate("xyz")]
    d = d.select("scan", "pid", *named)
    bad = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()
    return d.withColumn("x", F.when(bad, F.raise_error(F.concat(F.lit("not three numbers in "), "scan"))).otherwise(F.col("x")))


def read_binary(spark: SparkSession, path: str, suffix: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Points of PLY, PCD, STL, NPY or NPZ files of a path or pattern: records by ranges, text by splits of lines.

    Files of a store that only Spark's sources reach are taken whole, a file a task (below 2 GB each).
    """
    files = _listed(spark, path)
    by_path = _in_reach(files)
    found = cut(ranges(files, suffix, range_bytes, by_path))
    lines = found.where(F.col("way") == layout.LINES)
    of_records, of_lines = found.agg(F.count_if(F.col("way") != layout.LINES), F.count_if(F.col("way") == layout.LINES)).first()
    if not by_path:
        out = _read_contents(files, suffix)
    else:
        out = found.where(F.col("way") != layout.LINES).repartition(max(1, of_records)).mapInArrow(_read_ranges, SCHEMA)
    if not of_lines:
        return out
    text = _read_lines(spark, path, lines, suffix)
    return out.unionByName(text) if of_records else text


def _numbered(spark: SparkSession, path: str, keep) -> DataFrame:
    """(scan, pid, line) of the kept lines of text files, numbered without sorting a file in one task."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("scan"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value").where(keep(F.col("value")))
    sizes = lines.groupBy("scan", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("scan").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("scan", "block").orderBy("at")) - 1
    return lines.withColumn("place", place).join(sizes.withColumn("before", before).select("scan", "block", "before"), ["scan", "block"]).select("scan", (F.col("before") + F.col("place")).alias("pid"), F.col("value").alias("line"))


def _numbers(tokens, first: int):
    return [F.try_element_at(tokens, F.lit(first + i)).try_cast("double").alias(c) for i, c in enumerate("xyz")]


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of OBJ files; a line of fewer than three values is skipped, one that isn't numbers fails."""
    d = _numbered(spark, path, lambda v: v.rlike(r"^\s*v[ \t]+\S+\s+\S+\s+\S")).select("scan", "pid", *_numbers(F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "), 2))
    bad = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()
    return d.withColumn("x", F.when(bad, F.raise_error(F.concat(F.lit("not a vertex in "), "scan"))).otherwise(F.col("x")))


def read_delimited(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """The first three columns of text files; # begins a comment, and one heading row may come first."""
    text = F.regexp_replace(F.col("line"), "#.*$", "")
    d = _numbered(spark, path, lambda v: F.trim(F.regexp_replace(v, "#.*$", "")) != "").withColumn("t", F.split(F.trim(text) if separator == r"\s+" else text, separator)).withColumn("cells", F.size("t"))
    d = d.select("scan", "pid", "cells", *[F.trim(F.try_element_at("t", F.lit(i + 1))).try_cast("double").alias(c) for i, c in enumerate("xyz")])
    bad = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()
    heading = d.where((F.col("pid") == 0) & bad).select(F.col("scan").alias("headed"))
    d = d.join(F.broadcast(heading), F.col("scan") == F.col("headed"), "left").where(F.col("headed").isNull() | (F.col("pid") > 0))  # a row a file at most
    why = F.when(F.col("cells") < 3, F.lit("fewer than 3 columns in ")).otherwise(F.lit("not three numbers in "))
    return d.select("scan", (F.col("pid") - F.when(F.col("headed").isNotNull(), 1).otherwise(0)).alias("pid"), F.when(bad & (F.col("headed").isNull() | (F.col("pid") > 0)), F.raise_error(F.concat(why, "scan"))).otherwise(F.col("x")).alias("x"), "y", "z")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of a file, or of files of one kind by a pattern, by the path's suffix; ValueError for an unknown one."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix in layout.BY_SUFFIX:
        return read_binary(spark, path, suffix)
    if suffix == ".obj":
        return read_obj(spark, path)
    if suffix in SEPARATORS:
        return read_delimited(spark, path, SEPARATORS[suffix])
    raise ValueError(f"files that end in {suffix!r} are not read")


def clean(points: DataFrame, least: int = 3) -> DataFrame:
    """Rows with finite coordinates; ValueError for fewer than `least`."""
    kept = points.where(finite("x", "y", "z"))
    if kept.limit(least).count() < least:
        raise ValueError(f"a scan needs at least {least} points with finite coordinates")
    return kept


def load_ply(spark, path):
    return clean(read_binary(spark, path, ".ply"))


def load_pcd(spark, path):
    return clean(read_binary(spark, path, ".pcd"))


def load_stl_vertices(spark, path):
    return clean(read_binary(spark, path, ".stl"))


def load_obj(spark, path):
    return clean(read_obj(spark, path))


def load_delimited(spark, path):
    return clean(read_delimited(spark, path, SEPARATORS[os.path.splitext(path)[1].lower()]))


def load_points(spark, path):
    return clean(read_points(spark, path))
