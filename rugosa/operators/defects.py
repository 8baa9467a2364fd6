"""Defects: regions whose local roughness stands far above the surface's."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, with_patches
from .morphology import EIGHT, components, erode


def candidates(grid: DataFrame, heat: DataFrame, svr: DataFrame, factor: float, margin: int = 2) -> DataFrame:
    """(patch, iy, ix) of cells with a heatmap value >= factor x S_VR, `margin` erosions inside the valid area.

    The erosion takes the border of the measured area away, not that of the hot regions.
    """
    hot = with_patches(heat.where("value is not null"), svr.where("svr_um > 0")).where(F.col("value") >= factor * F.col("svr_um"))
    inner = erode(grid.where(F.col("valid") & finite("z")).select("patch", "iy", "ix"), margin)
    return hot.select("patch", "iy", "ix").join(inner, ["patch", "iy", "ix"], "left_semi")


def detect(grid_mm: DataFrame, heat: DataFrame, svr: DataFrame, pitch_mm: float, factor: float = 2.0, min_area: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(defects, their cells) of a grid in mm: 8-connected candidates of at least min_area mm2.

    defects: patch, id (from 1, by first cell), kind, area_mm2, diameter_mm, peak_deviation_um,
    u_mm, v_mm (of the mean cell, from the grid's corner), points.
    """
    cells = components(candidates(grid_mm, heat, svr, factor), ("iy", "ix"), EIGHT)
    least = max(1, math.ceil(min_area / pitch_mm**2))
    z = cells.join(grid_mm.select("patch", "iy", "ix", "z"), ["patch", "iy", "ix"])
    found = z.groupBy("patch", "label").agg(F.count("*").alias("points"), F.avg("z").alias("mean"), F.max(F.abs("z")).alias("peak"), F.avg("iy").alias("my"), F.avg("ix").alias("mx")).where(F.col("points") >= least)
    area = F.col("points") * pitch_mm**2
    # one row a defect, of one patch, is numbered in order
    found = found.withColumn("id", F.row_number().over(Window.partitionBy("patch").orderBy("label")))
    defects = found.select("patch", "id", F.when(F.col("mean") >= 0, "protrusion").otherwise("depression").alias("kind"), area.alias("area_mm2"), (2 * F.sqrt(area / math.pi)).alias("diameter_mm"), (F.col("peak") * 1000).alias("peak_deviation_um"), (F.col("mx") * pitch_mm).alias("u_mm"), (F.col("my") * pitch_mm).alias("v_mm"), "points", "label")
    return defects.drop("label"), cells.join(defects.select("patch", "label", "id"), ["patch", "label"]).select("patch", "iy", "ix", "id")


def totals(defects: DataFrame, areas: DataFrame) -> DataFrame:
    """(patch, defects, area_mm2, area_pct, per_dm2) for each patch of areas (patch, patch_area_mm2); 0 where it has none."""
    found = defects.groupBy("patch").agg(F.count("*").alias("defects"), F.sum("area_mm2").alias("area_mm2"))
    d = areas.join(found, "patch", "left").na.fill(0, ["defects"]).na.fill(0.0, ["area_mm2"])
    of_area = lambda c: F.when(F.col("patch_area_mm2") > 0, c / F.col("patch_area_mm2")).otherwise(0.0)
    return d.select("patch", "defects", "area_mm2", of_area(100 * F.col("area_mm2")).alias("area_pct"), of_area(10_000 * F.col("defects")).alias("per_dm2"))
