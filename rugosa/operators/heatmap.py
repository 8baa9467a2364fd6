"""Local roughness: a heatmap over a disc around each cell, and its values at points."""

from __future__ import annotations

import math
import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, finite, with_patches
from .grid import MANY_OFFSETS, shifted, summed_around, tiled


def disc_offsets(radius: float, pitch: float) -> list[tuple[int, int]]:
    """Displacements with 0 < distance <= radius (both in one unit), the distance in double precision as it comes."""
    r = math.ceil(radius / pitch)
    at = np.arange(-r, r + 1) * pitch
    distance = np.sqrt(at[:, None] * at[:, None] + at[None, :] * at[None, :])
    y, x = np.nonzero((distance <= radius) & (distance > 0))
    return list(zip((y - r).tolist(), (x - r).tolist()))


def heatmap(grid: DataFrame, pitch: float, radius: float = 5.0, min_support: int = 12, disc_averaging: bool | None = None, many: int = MANY_OFFSETS) -> DataFrame:
    """(patch, iy, ix, value in um, null where unsupported) of a grid in mm whose null or NaN cells are unmeasured.

    Point mode: the root of half of (z - m)^2 + v, m and v being the mean and variance of the
    measured cells in the disc without its centre; disc mode: the root of 2 v. A cell needs to be
    measured, with at least max(4, min_support) cells around. disc_averaging None reads the
    environment variable SVR_DISC_AVERAGING. Discs of `many` cells and more are summed by FFT.
    """
    if pitch <= 0 or radius <= 0:
        raise ValueError("pitch and radius must be above 0")
    if disc_averaging is None:
        disc_averaging = os.environ.get("SVR_DISC_AVERAGING", "").strip().lower() in ("1", "true", "yes", "on")
    offsets, least = disc_offsets(radius, pitch), max(4, min_support)
    reach = max([0, *(abs(o) for p in offsets for o in p)])
    disc = np.zeros((2 * reach + 1, 2 * reach + 1))
    for dy, dx in offsets:
        disc[dy + reach, dx + reach] = 1

    def program(a: dict, inside: np.ndarray, core: np.ndarray) -> dict:
        z = a["z"]
        live = inside & np.isfinite(z)
        z = np.where(live, z, 0.0)
        base = z[live].mean() if live.any() else 0.0  # sums about a nearby level lose less
        y = np.where(live, z - base, 0.0)
        mask, square = live.astype(float), y * y
        if len(offsets) >= many:
            n, s, q = (summed_around(a, disc) for a in (mask, y, square))
            n = np.rint(n)
        else:
            n, s, q = (sum(shifted(a, *o) for o in offsets) + np.zeros(z.shape) for a in (mask, y, square))
        some = np.maximum(n, 1)
        m = s / some
        v = np.maximum(0, q / some - m * m)
        value = np.sqrt(2 * v) if disc_averaging else np.sqrt(0.5 * ((y - m) ** 2 + v))
        return {"value": np.where(live & (n >= least), value * 1000, np.nan)}

    out = tiled(grid.select("patch", "iy", "ix", F.when(finite("z"), F.col("z")).alias("z")), reach, program, f"patch {dict(grid.dtypes)['patch']}, iy int, ix int, value double", columns=("z",))
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def interpolate(heat: DataFrame, shape: DataFrame, points: DataFrame, pitch: float) -> DataFrame:
    """points (patch, pid, u, v) with `value` (float): bilinear among the finite corners; null where none has weight.

    shape: (patch, ox, oy, h, w). Points outside clamp to the border; a grid under 2 cells in a
    dimension gives null.
    """
    d = with_patches(points, shape)
    gx = clip((F.col("u") - F.col("ox")) / pitch, F.lit(0.0), (F.col("w") - 1).cast("double"))
    gy = clip((F.col("v") - F.col("oy")) / pitch, F.lit(0.0), (F.col("h") - 1).cast("double"))
    d = d.withColumn("gx", gx).withColumn("gy", gy)
    d = d.withColumn("ix0", clip(F.floor("gx"), F.lit(0), F.col("w") - 2)).withColumn("iy0", clip(F.floor("gy"), F.lit(0), F.col("h") - 2))
    fx, fy = F.col("gx") - F.col("ix0"), F.col("gy") - F.col("iy0")
    corners = [F.struct((F.col("iy0") + dy).cast("int").alias("iy"), (F.col("ix0") + dx).cast("int").alias("ix"), ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("k")) for dy in (0, 1) for dx in (0, 1)]
    spread = d.where("w >= 2 and h >= 2").select("patch", "pid", F.explode(F.array(*corners)).alias("c")).select("patch", "pid", "c.iy", "c.ix", "c.k")
    met = spread.join(heat.where("value is not null").select("patch", "iy", "ix", "value"), ["patch", "iy", "ix"])
    found = met.groupBy("patch", "pid").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("value")).alias("kv"))
    out = points.join(found, ["patch", "pid"], "left")
    return out.select(*points.columns, F.when(F.col("k") > 1e-6, F.col("kv") / F.col("k")).cast("float").alias("value"))
