"""Roughness figures of a grid: Sa, Sq, the variogram and S_VR, in micrometres."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import MANY_OFFSETS, correlated, shifted, tiled


def sa_sq(grid: DataFrame) -> DataFrame:
    """(patch, sa_um, sq_um) over valid cells, about zero."""
    return grid.where("valid").groupBy("patch").agg((F.avg(F.abs("z")) * 1e6).alias("sa_um"), (F.sqrt(F.avg(F.col("z") * F.col("z"))) * 1e6).alias("sq_um"))


def pair_offsets(pitch: float, points: int, span: float) -> list[tuple[int, int, int]]:
    """(dy, dx, bucket) of the half-plane of displacements, the distance in metres over the span."""
    most = math.ceil(points * span / pitch)
    out = []
    for dy in range(most + 1):
        for dx in range(-most, most + 1):
            if dy or dx > 0:
                b = math.floor(math.hypot(dx * pitch, dy * pitch) / span)
                if b < points:
                    out.append((dy, dx, b))
    return out


def _pairs_by_fft(z: np.ndarray, first: np.ndarray, live: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each displacement up to `reach`: pairs of a `first` and a live cell, and their squared differences' sum.

    (a - b)^2 is summed as a^2 + b^2 - 2 ab by three correlations, of heights about their mean.
    """
    z = np.where(live, z - z[live].mean(), 0.0) if live.any() else np.zeros(z.shape)
    f, m = first.astype(float), live.astype(float)
    n = np.rint(correlated(f, m, reach))
    total = correlated(f * z * z, m, reach) + correlated(f, z * z, reach) - 2 * correlated(f * z, z, reach)
    return n, np.maximum(0.0, total)


def variogram(grid: DataFrame, pitch: float, points: int = 10, span: float = 0.0005, many: int = MANY_OFFSETS) -> DataFrame:
    """(patch, bucket, pairs, total): twice the pairs of valid cells, and twice their squared differences.

    Each pair is counted in the tile that holds its first cell, against a halo of the longest
    displacement; what is shuffled is cells and a few sums for each tile, never pairs. From `many`
    displacements on, those of a tile are summed together by FFT instead of one after another.
    """
    offsets = pair_offsets(pitch, points, span)
    halo = math.ceil(points * span / pitch)

    def program(a: dict, inside: np.ndarray, core: np.ndarray) -> pd.DataFrame:
        live = a["valid"] & inside
        z = np.where(live, a["z"], 0.0)
        total, pairs = np.zeros(points), np.zeros(points, np.int64)
        first = live & core
        if len(offsets) >= many:
            n, d = _pairs_by_fft(z, first, live, halo)
            dy, dx, b = np.array(offsets).T
            np.add.at(pairs, b, 2 * n[dy + halo, dx + halo].astype(np.int64))
            np.add.at(total, b, 2 * np.where(n > 0, d, 0.0)[dy + halo, dx + halo])
        else:
            for dy, dx, b in offsets:
                both = first & shifted(live, dy, dx, False)
                n = int(both.sum())
                if n:
                    d = (z - shifted(z, dy, dx))[both]
                    pairs[b] += 2 * n
                    total[b] += 2 * float(d @ d)
        return pd.DataFrame({"bucket": np.arange(points, dtype=np.int32), "pairs": pairs, "total": total})

    kind = dict(grid.dtypes)["patch"]
    sums = tiled(grid, halo, program, f"patch {kind}, bucket int, pairs long, total double", cells=False)
    return sums.groupBy("patch", "bucket").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"))


def bins(vario: DataFrame) -> DataFrame:
    """(patch, bucket, pairs, value_um): the root of half the mean squared difference; 0 for a bucket without pairs.

    `pairs` and `total` both count each pair twice.
    """
    half = F.sqrt(F.col("total") / (2 * F.col("pairs"))) * 1e6
    return vario.select("patch", "bucket", "pairs", F.when(F.col("pairs") > 0, half).otherwise(0.0).alias("value_um"))


def svr(vario: DataFrame, points: int = 10) -> DataFrame:
    """(patch, svr_um): the sum of the bins over the configured number of bins; empty bins add 0."""
    return bins(vario).groupBy("patch").agg((F.coalesce(F.sum("value_um"), F.lit(0.0)) / points).alias("svr_um"))


def less_noise(raw, noise, enabled: bool = True):
    """sqrt(max(0, raw^2 - noise^2)) of columns, where noise is above 0."""
    if not enabled:
        return raw
    return F.when(noise > 0, F.sqrt(F.greatest(F.lit(0.0), raw * raw - noise * noise))).otherwise(raw)


def size_figures(points: DataFrame) -> DataFrame:
    """(patch, points, width, height, area, density, spacing) of (patch, u, v); density and spacing 0 without an area."""
    d = points.groupBy("patch").agg(F.count("*").alias("points"), (F.max("u") - F.min("u")).alias("width"), (F.max("v") - F.min("v")).alias("height")).withColumn("area", F.col("width") * F.col("height"))
    density = F.when(F.col("area") > 0, F.col("points") / F.col("area")).otherwise(0.0)
    return d.withColumn("density", density).withColumn("spacing", F.when(F.col("density") > 0, 1 / F.sqrt("density")).otherwise(0.0))


def object_figures(faces: DataFrame) -> DataFrame:
    """One row of (area, svr_um) rows: the mean by area, the worst and the best."""
    return faces.agg((F.sum(F.col("area") * F.col("svr_um")) / F.sum("area")).alias("mean_svr_um"), F.max("svr_um").alias("worst_svr_um"), F.min("svr_um").alias("best_svr_um"))
