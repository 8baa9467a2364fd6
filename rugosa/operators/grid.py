"""Elevation grids: dense (patch, iy, ix, z, valid) rows, in metres.

Stencils run on square tiles with a halo: each cell goes to its own tile and to those whose halo it
lies in, one shuffle deals the tiles out, and a small array program works on each. The halo makes a
tile's core independent of its neighbours, so several rounds of a stencil need one shuffle only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, cut, patch_table, with_patches
from ..functions.quantiles import percentiles

TILE = 512


class SparseScanError(ValueError):
    """The points are too far apart for the grid pitch."""

    def __init__(self, message: str, suggested_pitch: float) -> None:
        super().__init__(message)
        self.suggested_pitch = suggested_pitch


def check_spacing(n: int, area: float, pitch_mm: float) -> None:
    """Raises SparseScanError where the mean spacing of n points on an area (mm2) is over two pitches."""
    spacing = math.sqrt(area / n) if n else math.inf
    if spacing > 2 * pitch_mm:
        better = max(0.40, math.ceil(10 * round(0.55 * spacing, 2)) / 10)
        better = better if better > pitch_mm else round(2 * pitch_mm, 1)
        raise SparseScanError(f"points are {spacing:.3f} mm apart, too sparse for a pitch of {pitch_mm:g} mm; try {better:g} mm", better)


def extents(points: DataFrame) -> DataFrame:
    """One row a patch: n and the least and largest u and v."""
    return points.groupBy("patch").agg(F.count("*").alias("n"), F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"))


def scatter(points: DataFrame, pitch: float, box: DataFrame | None = None) -> DataFrame:
    """Bilinear scatter of (patch, u, v, w): (patch, iy, ix, sw, swz), origins at the least u and v.

    Points of one cell are summed for its four corners before anything is multiplied, so the rows
    that are spread to corners are occupied cells, not points. `box`: the patches' extents, if they are
    known; points of other patches are left out.
    """
    box = extents(points) if box is None else box
    steps = lambda a, b: F.ceil((F.col(b) - F.col(a)) / pitch).cast("long") + 1
    box = box.select("patch", "u0", "v0", steps("u0", "u1").alias("w_"), steps("v0", "v1").alias("h_"))
    d = with_patches(points, box)
    gx, gy = (F.col("u") - F.col("u0")) / pitch, (F.col("v") - F.col("v0")) / pitch
    d = d.select("patch", "w", clip(F.floor(gx), F.lit(0), F.col("w_") - 2).alias("ix"), clip(F.floor(gy), F.lit(0), F.col("h_") - 2).alias("iy"), gx.alias("gx"), gy.alias("gy"))
    d = d.withColumn("fx", clip(F.col("gx") - F.col("ix"), F.lit(0.0), F.lit(1.0))).withColumn("fy", clip(F.col("gy") - F.col("iy"), F.lit(0.0), F.lit(1.0)))
    weights = {(0, 0): (1 - F.col("fx")) * (1 - F.col("fy")), (0, 1): F.col("fx") * (1 - F.col("fy")), (1, 0): (1 - F.col("fx")) * F.col("fy"), (1, 1): F.col("fx") * F.col("fy")}
    sums = d.groupBy("patch", "iy", "ix").agg(*[x for (dy, dx), w in weights.items() for x in (F.sum(w).alias(f"w{dy}{dx}"), F.sum(w * F.col("w")).alias(f"z{dy}{dx}"))])
    corners = F.array(*[F.struct((F.col("iy") + dy).cast("int").alias("iy"), (F.col("ix") + dx).cast("int").alias("ix"), F.col(f"w{dy}{dx}").alias("sw"), F.col(f"z{dy}{dx}").alias("swz")) for dy, dx in weights])
    return sums.select("patch", F.explode(corners).alias("c")).groupBy("patch", "c.iy", "c.ix").agg(F.sum("c.sw").alias("sw"), F.sum("c.swz").alias("swz"))


def trimmed(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense grid of the valid cells' bounding box, indexed from 0, and its shape: (patch, y0, x0, h, w)."""
    measured = cells.where("sw > 1e-5").select("patch", "iy", "ix", (F.col("swz") / F.col("sw")).alias("z"))
    shape = measured.groupBy("patch").agg(F.min("iy").alias("y0"), F.min("ix").alias("x0"), (F.max("iy") - F.min("iy") + 1).alias("h"), (F.max("ix") - F.min("ix") + 1).alias("w"))
    moved = with_patches(measured, shape).select("patch", (F.col("iy") - F.col("y0")).alias("iy"), (F.col("ix") - F.col("x0")).alias("ix"), "z")
    lattice = shape.select("patch", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("iy")).repartition("patch", "iy").select("patch", "iy", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("ix"))
    grid = lattice.join(moved, ["patch", "iy", "ix"], "left").select("patch", "iy", "ix", "z", F.col("z").isNotNull().alias("valid"))
    return grid, shape


def tiled(grid: DataFrame, halo: int, program: Callable, schema: str, columns: tuple = ("z", "valid"), tile: int = TILE, cells: bool = True) -> DataFrame:
    """program(arrays by column, inside, core) on each tile; nulls of doubles are NaN.

    inside marks the cells that exist, core those that are the tile's own. A program returns arrays
    of the tile's shape by name, of which the core's cells become rows (patch, iy, ix, ...), or, if
    not `cells`, a frame of rows without the patch.
    """
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int")))
    d = grid.select("patch", "iy", "ix", *columns).withColumn("ty", reach("iy")).withColumn("tx", reach("ix"))
    names = [c.split()[0] for c in schema.split(",")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        patch, ty, tx = key
        iy, ix = pdf.iy.to_numpy(), pdf.ix.to_numpy()
        y0, x0 = int(iy.min()), int(ix.min())
        shape = (int(iy.max()) - y0 + 1, int(ix.max()) - x0 + 1)
        at = (iy - y0, ix - x0)
        inside = np.zeros(shape, bool)
        inside[at] = True
        core = inside.copy()
        yy, xx = np.arange(shape[0]) + y0, np.arange(shape[1]) + x0
        core &= ((yy >= ty * tile) & (yy < (ty + 1) * tile))[:, None] & ((xx >= tx * tile) & (xx < (tx + 1) * tile))[None, :]
        if not core.any():
            return pd.DataFrame(columns=names)
        arrays = {}
        for c in columns:
            v = pdf[c].to_numpy()
            a = np.zeros(shape, bool) if v.dtype == bool else np.full(shape, np.nan)
            a[at] = v
            arrays[c] = a
        got = program(arrays, inside, core)
        if not cells:
            return got.assign(patch=patch)[names]
        cy, cx = np.nonzero(core)
        return pd.DataFrame({"patch": patch, "iy": cy + y0, "ix": cx + x0} | {k: v[cy, cx] for k, v in got.items()})[names]

    return d.groupBy("patch", "ty", "tx").applyInPandas(run, schema)


def shifted(a: np.ndarray, dy: int, dx: int, fill=0.0) -> np.ndarray:
    """b[y, x] = a[y + dy, x + dx], `fill` outside."""
    out = np.full_like(a, fill)
    h, w = a.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def correlated(a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    """c[dy + reach, dx + reach] = sum of a[y, x] b[y + dy, x + dx] over the cells, by FFT, up to `reach` each way."""
    size = [n + reach for n in a.shape]
    c = np.fft.irfft2(np.conj(np.fft.rfft2(a, size)) * np.fft.rfft2(b, size), size)
    k = np.arange(-reach, reach + 1)
    return c[np.ix_(k % size[0], k % size[1])]


def summed_around(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """b[y, x] = sum of kernel[dy + r, dx + r] a[y + dy, x + dx], by FFT; the kernel is 2 r + 1 cells a side."""
    r = len(kernel) // 2
    size = [n + 2 * r for n in a.shape]
    b = np.fft.irfft2(np.fft.rfft2(a, size) * np.fft.rfft2(kernel[::-1, ::-1], size), size)
    return b[r : r + a.shape[0], r : r + a.shape[1]]


CROSS = ((-1, 0), (1, 0), (0, -1), (0, 1))


#: From so many displacements on, sums over them are taken by FFT.
MANY_OFFSETS = 100


def fill_holes(grid: DataFrame, rounds: int = 8) -> DataFrame:
    """Fills cells that aren't valid: rounds of the mean of known neighbours, then the mean of the valid.

    All rounds run in one pass over tiles with a halo of `rounds` cells. `valid` stays as it was;
    a patch without a valid cell gets 0.
    """

    def program(a: dict, inside: np.ndarray, core: np.ndarray) -> dict:
        return {"z": _filled(a["z"], a["valid"] & inside, rounds, inside), "valid": a["valid"]}

    filled = tiled(grid, rounds, program, f"patch {dict(grid.dtypes)['patch']}, iy int, ix int, z double, valid boolean")
    mean = grid.where("valid").groupBy("patch").agg(F.avg("z").alias("m"))
    rest = with_patches(filled, mean, "left")
    return rest.select("patch", "iy", "ix", F.when(F.col("z").isNull() | F.isnan("z"), F.coalesce("m", F.lit(0.0))).otherwise(F.col("z")).alias("z"), "valid")


def _filled(z: np.ndarray, known: np.ndarray, rounds: int, inside: np.ndarray | bool = True) -> np.ndarray:
    """z with `rounds` rounds of the mean of known neighbours; NaN where a cell stays unknown."""
    z = np.where(known, z, 0.0)
    for _ in range(rounds):
        if known.all():
            break
        n = sum(shifted(known.astype(float), *o) for o in CROSS)
        s = sum(shifted(np.where(known, z, 0.0), *o) for o in CROSS)
        new = inside & ~known & (n > 0)
        z = np.where(new, s / np.maximum(n, 1), z)
        known = known | new
    return np.where(known, z, np.nan)


def rasterize(points: DataFrame, pitch: float, box: DataFrame | None = None, rounds: int = 8, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(filled grid with validity, shape) of (patch, u, v, w) points: `trimmed` and `fill_holes` of their `scatter`.

    The points are read twice, for their box and for their cells. The cells are stored; the frame of
    each patch (its first cell, height, width and mean) comes from them. A tile gets the measured cells
    in reach and a row of its frame, so that the dense lattice is made where it is filled, without a join.
    """
    cells = cut(scatter(points, pitch, box))
    measured = cells.where("sw > 1e-5").select("patch", "iy", "ix", (F.col("swz") / F.col("sw")).alias("z"))
    size = lambda c: (F.max(c) - F.min(c) + 1)
    frame = measured.groupBy("patch").agg(F.min("iy").alias("y0"), F.min("ix").alias("x0"), size("iy").alias("h"), size("ix").alias("w"), F.avg("z").alias("mean"))
    frame = patch_table(frame)
    moved = measured.join(frame, "patch").select("patch", (F.col("iy") - F.col("y0")).alias("iy"), (F.col("ix") - F.col("x0")).alias("ix"), "z")
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - rounds) / tile).cast("int"), F.floor((F.col(c) + rounds) / tile).cast("int")))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("h", "int"), ("w", "int"), ("mean", "double"))]
    dealt = moved.withColumn("ty", reach("iy")).withColumn("tx", reach("ix")).select("patch", "ty", "tx", "iy", "ix", "z", *none)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.floor((F.col(c) - 1) / tile).cast("int")))
    marks = frame.withColumn("ty", every("h")).withColumn("tx", every("w"))
    marks = marks.select("patch", "ty", "tx", *[F.lit(None).cast(t).alias(c) for c, t in (("iy", "int"), ("ix", "int"), ("z", "double"))], "h", "w", "mean")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        patch, ty, tx = key
        mark = pdf[pdf.h.notna()]
        if not len(mark):  # in reach of a cell, but outside the patch
            return pd.DataFrame(columns=["patch", "iy", "ix", "z", "valid"])
        h, w, mean = int(mark.h.iloc[0]), int(mark.w.iloc[0]), float(mark["mean"].iloc[0])
        y0, x0 = max(0, ty * tile - rounds), max(0, tx * tile - rounds)
        shape = (min(h, (ty + 1) * tile + rounds) - y0, min(w, (tx + 1) * tile + rounds) - x0)
        some = pdf[pdf.h.isna()]
        at = (some.iy.to_numpy().astype(int) - y0, some.ix.to_numpy().astype(int) - x0)
        known, z = np.zeros(shape, bool), np.zeros(shape)
        known[at], z[at] = True, some.z.to_numpy()
        z = _filled(z, known, rounds)
        own = (slice(ty * tile - y0, (ty + 1) * tile - y0), slice(tx * tile - x0, (tx + 1) * tile - x0))
        z, known = np.where(np.isnan(z), mean, z)[own], known[own]
        iy, ix = np.indices(z.shape)
        return pd.DataFrame({"patch": patch, "iy": (iy + ty * tile).ravel(), "ix": (ix + tx * tile).ravel(), "z": z.ravel(), "valid": known.ravel()})

    filled = dealt.unionByName(marks).groupBy("patch", "ty", "tx").applyInPandas(run, f"patch {dict(points.dtypes)['patch']}, iy int, ix int, z double, valid boolean")
    return filled, frame.select("patch", "y0", "x0", "h", "w")


def gaussian_kernel(cutoff: float, pitch: float) -> np.ndarray:
    """Weights of the ISO 16610-61 Gaussian for a cutoff, both in metres; they sum to 1."""
    half = math.ceil(0.5 * cutoff / pitch)
    x = np.arange(-half, half + 1) * pitch / cutoff
    w = np.exp(-math.pi * (x / 0.4697) ** 2)
    return w / w.sum()


def _smoothed(z: np.ndarray, inside: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    half = len(kernel) // 2
    for axis in (1, 0):
        s, m = np.zeros_like(z), np.zeros_like(z)
        live = np.where(inside, z, 0.0)
        for k, w in enumerate(kernel):
            o = (0, k - half) if axis else (k - half, 0)
            s += w * shifted(live, *o)
            m += w * shifted(inside.astype(float), *o)
        z = s / np.maximum(m, 1e-12)
    return z


def smooth(grid: DataFrame, cutoff: float, pitch: float, column: str = "z") -> DataFrame:
    """Separable Gaussian of a dense grid, x then y, each pass divided by the kernel's mass in bounds."""
    kernel = gaussian_kernel(cutoff, pitch)
    return tiled(grid, len(kernel) // 2, lambda a, inside, core: {"z": _smoothed(a["z"], inside, kernel), "valid": a["valid"]}, f"patch {dict(grid.dtypes)['patch']}, iy int, ix int, z double, valid boolean")


def band_pass(grid: DataFrame, pitch: float, short: float, long: float) -> DataFrame:
    """The grid smoothed at the short cutoff less that smoothed again at the long; a cutoff <= 0 skips its pass.

    Both passes run on one tile: its halo is as wide as the two kernels together.
    """
    first = gaussian_kernel(short, pitch) if short > 0 else None
    second = gaussian_kernel(long, pitch) if long > 0 else None
    halo = sum(len(k) // 2 for k in (first, second) if k is not None)

    def program(a: dict, inside: np.ndarray, core: np.ndarray) -> dict:
        z = a["z"] if first is None else _smoothed(a["z"], inside, first)
        return {"z": z if second is None else z - _smoothed(z, inside, second), "valid": a["valid"]}

    return tiled(grid, halo, program, f"patch {dict(grid.dtypes)['patch']}, iy int, ix int, z double, valid boolean")


def laplacian(grid: DataFrame) -> DataFrame:
    """The 5-point Laplacian of the grid, zero outside."""

    def program(a: dict, inside: np.ndarray, core: np.ndarray) -> dict:
        z = np.where(inside, a["z"], 0.0)
        return {"z": sum(shifted(z, *o) for o in CROSS) - 4 * z, "valid": a["valid"]}

    return tiled(grid, 1, program, f"patch {dict(grid.dtypes)['patch']}, iy int, ix int, z double, valid boolean")


def noise_floor(grid: DataFrame) -> DataFrame:
    """(patch, noise_um): the scaled median deviation of the Laplacian over valid cells of a filled grid."""
    lap = cut(laplacian(grid).where("valid"))
    off = with_patches(lap, percentiles(lap, "z", {"mid": 0.5})).select("patch", F.abs(F.col("z") - F.col("mid")).alias("off"))
    off = percentiles(off, "off", {"mad": 0.5})
    return off.select("patch", (F.col("mad") / 0.6745 / math.sqrt(20) * 1e6).alias("noise_um"))
