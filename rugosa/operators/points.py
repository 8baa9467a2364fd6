"""Operators on points: (patch, x, y, z) rows, any unit, one scan or face for each patch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import eigen
from ..functions.columns import cut, finite, with_patches
from ..functions.quantiles import percentiles


def finite_filter(points: DataFrame) -> DataFrame:
    return points.where(finite("x", "y", "z"))


def range_crop(points: DataFrame, x_range=None, y_range=None, z_range=None) -> DataFrame:
    """Points within inclusive ranges; pushed down to the scan where the columns come from it."""
    for name, r in (("x", x_range), ("y", y_range), ("z", z_range)):
        if r is not None:
            points = points.where(F.col(name).between(*r))
    return points


def percentile_crop(points: DataFrame, percent: float, u: str = "u", v: str = "v") -> DataFrame:
    """Points of each patch between the percentiles percent and 100 - percent in both plane coordinates."""
    if percent <= 0:
        return points
    p, q = percent / 100, 1 - percent / 100
    a, b = (percentiles(points, c, {f"{n}_lo": p, f"{n}_hi": q}) for n, c in (("u", u), ("v", v)))
    inside = F.col(u).between(F.col("u_lo"), F.col("u_hi")) & F.col(v).between(F.col("v_lo"), F.col("v_hi"))
    return with_patches(points, a.join(b, "patch")).where(inside).select(*points.columns)


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """The centroid of each occupied voxel, counted from the least coordinates of the patch."""
    low = points.groupBy("patch").agg(*[F.min(c).alias(f"{c}0") for c in "xyz"])
    keyed = with_patches(points, low).select("patch", *[F.floor((F.col(c) - F.col(f"{c}0")) / size).alias(f"v{c}") for c in "xyz"], "x", "y", "z")
    return keyed.groupBy("patch", "vx", "vy", "vz").agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("n"))


def covariance(points: DataFrame, sample: bool = False, names: str = "xyz") -> DataFrame:
    """Per patch: n, means and the six covariances, divided by n or, if `sample`, by n - 1."""
    f = F.covar_samp if sample else F.covar_pop
    a, b, c = names
    return points.groupBy("patch").agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{x}") for x in names], *[f(x, y).alias(f"c{x}{y}") for x, y in ((a, a), (a, b), (a, c), (b, b), (b, c), (c, c))])


COVARIANCES = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")


def matrix(row) -> np.ndarray:
    return np.array([[row.cxx, row.cxy, row.cxz], [row.cxy, row.cyy, row.cyz], [row.cxz, row.cyz, row.czz]], float)


def axis_columns(three: list) -> list:
    """e00 ... e22 of three axes: e{i}{j} is part j of axis i."""
    return [part.alias(f"e{i}{j}") for i, axis in enumerate(three) for j, part in enumerate(axis)]


def principal_axes(stats: DataFrame) -> DataFrame:
    """(all columns of a `covariance` table, e00 ... e22): each patch's axes by falling variance, right-handed.

    Signs are fixed: the first axis points to +x, the third up (see functions/eigen.py).
    """
    d = stats.withColumn("eigen", eigen.eigen(*[F.col(c) for c in COVARIANCES]))
    return d.select(*stats.columns, *axis_columns(eigen.axes(F.col("eigen"))))


def plane_basis(stats: DataFrame) -> DataFrame:
    """(all columns of a `covariance` table, e00 ... e22): x axis, y axis and normal of each patch's plane.

    The normal points up, the x axis is the global X laid into the plane (Y, where the plane stands across X).
    """
    d = stats.withColumn("eigen", eigen.eigen(*[F.col(c) for c in COVARIANCES]))
    return d.select(*stats.columns, *axis_columns(eigen.plane_axes(F.col("eigen"))))


def angles(n: int) -> list[float]:
    return [i * (math.pi / 2) / (n - 1) for i in range(n)]


def box_scan_all(points: DataFrame, n_angles: int, u: str = "u", v: str = "v") -> DataFrame:
    """(patch, angle, w, h): the bounding box of (u, v) turned by each of n angles from 0 to 90 degrees, both included.

    The points are read once. Each partition reduces its points to their extremes at all angles by
    one matrix product a batch; what is shuffled is n_angles rows for each patch and partition.
    """
    t = np.array(angles(n_angles))
    cos, sin = np.cos(t)[:, None], np.sin(t)[:, None]
    names = ["patch", "angle", "x0", "x1", "y0", "y1"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def out() -> pd.DataFrame:
            rows = [pd.DataFrame(dict(zip(names, (k, np.arange(n_angles), *a)))) for k, a in held.items()]
            held.clear()
            return pd.concat(rows)[names]

        for part in parts:
            for k, p in part.groupby("patch", sort=False):
                a, b = p[u].to_numpy()[None, :], p[v].to_numpy()[None, :]
                x, y = cos * a - sin * b, sin * a + cos * b
                now = (x.min(axis=1), x.max(axis=1), y.min(axis=1), y.max(axis=1))
                if k in held:
                    now = tuple(f(i, j) for f, i, j in zip((np.minimum, np.maximum) * 2, held[k], now))
                held[k] = now
            if len(held) > 1000:
                yield out()
        if held:
            yield out()

    kind = dict(points.dtypes)["patch"]
    found = points.select("patch", u, v).mapInPandas(run, f"patch {kind}, angle int, x0 double, x1 double, y0 double, y1 double")
    every = found.groupBy("patch", "angle").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return every.select("patch", "angle", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))


def _inside(p: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Which points lie strictly inside a convex polygon whose corners run counterclockwise."""
    a, b = corners, np.roll(corners, -1, axis=0)
    out = np.ones(len(p), bool)
    for (ax, ay), (bx, by) in zip(a, b):
        out &= (bx - ax) * (p[:, 1] - ay) - (by - ay) * (p[:, 0] - ax) > 0
    return out


def hull_of(p: np.ndarray, directions: int = 32) -> np.ndarray:
    """Corners of the convex hull of (n, 2) points, counterclockwise from the least; none between two others.

    Points inside the polygon of those that lie furthest in some directions are no corners: most go
    by array operations, and the chain walks over what is left.
    """
    p = np.unique(p, axis=0)
    if len(p) > 4 * directions:
        t = np.arange(directions) * 2 * math.pi / directions
        far = np.argmax(p @ np.stack([np.cos(t), np.sin(t)]), axis=0)
        ring = p[far[np.concatenate(([True], far[1:] != far[:-1]))]]
        if len(ring) > 2:
            p = p[~_inside(p, ring)]

    def chain(rows: np.ndarray) -> list:
        out: list = []
        for x, y in rows.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out

    if len(p) < 3:
        return p
    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def convex_hull(points: DataFrame, u: str = "u", v: str = "v", groups: int = 64) -> DataFrame:
    """(patch, place, u, v): the corners of each patch's convex hull, counterclockwise from the least u, then v.

    Partitions send the corners of their own points; these are merged in `groups` parts of a patch, and
    the parts' corners once more, so that no task gets more than the corners of many hulls.
    """
    kind = dict(points.dtypes)["patch"]

    def local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def out() -> pd.DataFrame:
            rows = pd.concat([pd.DataFrame({"patch": k, "u": h[:, 0], "v": h[:, 1]}) for k, h in held.items()])
            held.clear()
            return rows

        for part in parts:
            for k, p in part.groupby("patch", sort=False):
                now = p[["u", "v"]].to_numpy(float)
                held[k] = hull_of(np.vstack([held[k], now]) if k in held else now)
            if sum(map(len, held.values())) > 100_000:
                yield out()
        if held:
            yield out()

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull_of(pdf[["u", "v"]].to_numpy(float))
        return pd.DataFrame({"patch": key[0], "place": np.arange(len(h), dtype=np.int32), "u": h[:, 0], "v": h[:, 1]})

    plane = points.select("patch", F.col(u).alias("u"), F.col(v).alias("v")).where(finite("u", "v"))
    corners = plane.mapInPandas(local, f"patch {kind}, u double, v double").withColumn("group", F.pmod(F.spark_partition_id(), F.lit(groups)))
    schema = f"patch {kind}, place int, u double, v double"
    return corners.groupBy("patch", "group").applyInPandas(merged, schema).groupBy("patch").applyInPandas(merged, schema)


def box_scan(points: DataFrame, n_angles: int, u: str = "u", v: str = "v") -> DataFrame:
    """(patch, angle, w, h, area) of each patch's least box of `box_scan_all`; of equal areas the first angle's."""
    every = box_scan_all(points, n_angles, u, v).withColumn("area", F.col("w") * F.col("h"))
    return every.groupBy("patch").agg(F.min(F.struct("area", "angle", "w", "h")).alias("m")).select("patch", "m.angle", "m.w", "m.h", "m.area")


AXES = [f"e{i}{j}" for i in range(3) for j in range(3)]


def rotate(points: DataFrame, axes: DataFrame, names=("u", "v", "w"), centered: bool = False) -> DataFrame:
    """points with coordinates along each patch's axes: axes has (patch, e00 ... e22), a row a patch.

    If `centered`, they are counted from the means mx, my, mz of the same table. Points of patches
    without axes are left out.
    """
    d = with_patches(points, axes.select("patch", *AXES, *(["mx", "my", "mz"] if centered else [])))
    rel = [F.col(c) - F.col(f"m{c}") if centered else F.col(c) for c in "xyz"]
    return d.select(*points.columns, *[sum(rel[j] * F.col(f"e{i}{j}") for j in range(3)).alias(n) for i, n in enumerate(names)])


def aligned_axes(points: DataFrame, n_angles: int = 90) -> DataFrame:
    """(patch, n, e00 ... e22): PCA axes of each patch, turned in the plane to the least bounding box.

    Patches of up to 20 points aren't turned. A plan: no row of a patch comes to the driver.
    """
    axes = cut(principal_axes(covariance(points)).select("patch", "n", *AXES))
    best = box_scan(rotate(points, axes), n_angles).select("patch", "angle")
    turn = F.when(F.col("n") > 20, F.col("angle") * F.lit(math.pi / 2) / (n_angles - 1)).otherwise(F.lit(0.0))
    d = axes.join(best, "patch").withColumn("c", F.cos(turn)).withColumn("s", F.sin(turn))
    first = [(F.col("c") * F.col(f"e0{j}") - F.col("s") * F.col(f"e1{j}")).alias(f"e0{j}") for j in range(3)]
    second = [(F.col("s") * F.col(f"e0{j}") + F.col("c") * F.col(f"e1{j}")).alias(f"e1{j}") for j in range(3)]
    return d.select("patch", "n", *first, *second, *[f"e2{j}" for j in range(3)])
