"""Column expressions that several operators use."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def finite(*names: str) -> Column:
    """Whether all columns hold a number that is neither NaN nor infinite."""
    out = F.lit(True)
    for n in names:
        c = F.col(n)
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return out


def clip(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, low), high)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a temporary folder serves a local master, which has one machine; on a
    cluster this raises, since a folder of the driver's machine is of no use there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        path = tempfile.mkdtemp(prefix="rugosa-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def counted_cut(df: DataFrame) -> tuple[DataFrame, int]:
    """`cut`, and the number of rows, which is observed while they are written."""
    seen = Observation()
    stored = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return stored, seen.get["n"]


#: A table with a row for each patch is broadcast up to so many rows (of a few dozen numbers: about 30 MB).
PATCH_ROWS = 100_000


def patch_table(table: DataFrame) -> DataFrame:
    """A table with about a row for each patch, stored, and marked for broadcast if it has PATCH_ROWS rows at most.

    Joined with one, the rows of a single large patch stay where they are; beyond the bound the join
    shuffles on the patch. What reaches the driver is a count.
    """
    table, n = counted_cut(table)
    return F.broadcast(table) if n <= PATCH_ROWS else table


def with_patches(df: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """df joined with a table that has one row for each patch, which is computed once."""
    return df.join(patch_table(table), "patch", how)


# Upper limits in mm of each comparator's grades, and what lies above and below.
COMPARATORS = {
    "SCRATA": ("< A1", 0.0214, [(0.0356, "A1"), (0.0539, "A2"), (0.0973, "A3"), (0.1500, "A4")], "> A4"),
    "GAR C-9": ("< C-9 200", 0.0089, [(0.0128, "C-9 200"), (0.0175, "C-9 300"), (0.0231, "C-9 420"), (0.0430, "C-9 560"), (0.0648, "C-9 720"), (0.0850, "C-9 900")], "> C-9 900"),
    "ACI SIS": ("< SIS-1", 0.0088, [(0.0147, "SIS-1"), (0.0222, "SIS-2"), (0.0523, "SIS-3"), (0.1000, "SIS-4")], "> SIS-4"),
}


def grade(svr_mm: Column, comparator: str) -> Column:
    """The comparator's grade of a roughness in mm; NaN gets the last."""
    below, least, limits, above = COMPARATORS[comparator]
    out = F.when(svr_mm < least, below)
    for limit, name in limits:
        out = out.when(svr_mm <= limit, name)
    return out.otherwise(above)


def grade_of(svr_mm: float, comparator: str) -> str:
    below, least, limits, above = COMPARATORS[comparator]
    if svr_mm < least:
        return below
    return next((name for limit, name in limits if svr_mm <= limit), above)
