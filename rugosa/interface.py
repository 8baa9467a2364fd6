"""Functions of the interface whose arrays are DataFrames here, under the interface's parameter names.

A grid is (iy, ix, z in mm, null where unmeasured), with or without a column `patch`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.columns import cut, finite
from .operators import defects, heatmap
from .result import Abnormality


def _one_patch(cells: DataFrame) -> DataFrame:
    return cells if "patch" in cells.columns else cells.withColumn("patch", F.lit(0))


def compute_heatmap_grid(
    roughness_grid_mm: DataFrame, pitch_mm: float, radius_mm: float = 5.0, min_support_cells: int = 12, disc_averaging: bool | None = None
) -> DataFrame:
    """(patch, iy, ix, value in um): the local roughness of each cell of a grid."""
    return heatmap.heatmap(_one_patch(roughness_grid_mm), pitch_mm, radius_mm, min_support_cells, disc_averaging)


def detect_surface_abnormalities(
    roughness_grid_mm: DataFrame,
    pitch_mm: float,
    global_svr_um: float,
    threshold_factor: float = 2.0,
    min_area_mm2: float = 2.0,
    valid_mask: DataFrame | None = None,
    heatmap_grid_um: DataFrame | None = None,
) -> tuple[list[Abnormality], DataFrame]:
    """The defects of one grid, by id, and their cells (patch, iy, ix, id).

    valid_mask: the (iy, ix) that count as measured; None takes the finite cells. heatmap_grid_um: (iy, ix,
    value), where it is known. A roughness of 0 or less has no defects.
    """
    g = _one_patch(roughness_grid_mm).select("patch", "iy", "ix", F.when(finite("z"), F.col("z")).alias("z"))
    if valid_mask is not None:
        marked = valid_mask.select("iy", "ix", F.lit(True).alias("marked"))
        g = g.join(marked, ["iy", "ix"], "left").select("patch", "iy", "ix", F.when(F.col("marked"), F.col("z")).alias("z"))
    g = cut(g.withColumn("valid", F.col("z").isNotNull()))
    heat = compute_heatmap_grid(g, pitch_mm) if heatmap_grid_um is None else _one_patch(heatmap_grid_um)
    level = g.select("patch").distinct().withColumn("svr_um", F.lit(float(global_svr_um)))
    listed, cells = defects.detect(g, heat, level, pitch_mm, threshold_factor, min_area_mm2)
    rows = sorted(listed.collect(), key=lambda d: d.id)
    found = [Abnormality(d.id, d.kind, round(d.area_mm2, 4), round(d.diameter_mm, 4), round(d.peak_deviation_um, 2), (round(d.u_mm, 3), round(d.v_mm, 3)), d.points) for d in rows]
    return found, cells


def interpolate_heatmap_at_points(
    hmap: DataFrame, origin_x_mm: float, origin_y_mm: float, pitch_mm: float, points: DataFrame, u_mm: str = "u_mm", v_mm: str = "v_mm"
) -> DataFrame:
    """points with `value`: the heatmap (iy, ix, value) between its cells, at the columns u_mm and v_mm of points."""
    h = _one_patch(hmap)
    size = lambda c: (F.max(c) + 1).cast("int")
    shape = h.groupBy("patch").agg(size("iy").alias("h"), size("ix").alias("w"))
    shape = shape.select("patch", F.lit(float(origin_x_mm)).alias("ox"), F.lit(float(origin_y_mm)).alias("oy"), "h", "w")
    row = F.struct(*points.columns).alias("row")
    d = cut(points.select(row, F.monotonically_increasing_id().alias("pid"), F.col(u_mm).alias("u"), F.col(v_mm).alias("v")).withColumn("patch", F.lit(0)))
    return heatmap.interpolate(h, shape, d, pitch_mm).select("row.*", "value")
