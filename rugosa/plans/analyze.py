"""The analysis of one surface, or of all faces of an object in one plan."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RoughnessConfig
from ..functions.columns import cut, with_patches
from ..operators import defects, grid, heatmap, metrics, points
from ..result import Abnormality, PlaneFit, RoughnessResult
from ..sources.readers import clean, load_points

#: Points that an analysis needs after each crop.
LEAST_POINTS = 20


def settings(config: RoughnessConfig | None, overrides: dict) -> RoughnessConfig:
    return (config or RoughnessConfig()).with_(**overrides)


def with_patch(df: DataFrame) -> DataFrame:
    """x, y, z as doubles with a patch column (0 where there is none) and nothing else."""
    patch = F.col("patch") if "patch" in df.columns else F.lit(0).alias("patch")
    return df.select(patch, *[F.col(c).cast("double").alias(c) for c in "xyz"])


def _crop(p: DataFrame, config: RoughnessConfig) -> DataFrame:
    p = points.range_crop(p, config.x_range, config.y_range, config.z_range)
    if config.percentile_crop > 0:
        basis = points.plane_basis(points.covariance(p, sample=True).where("n > 1"))
        laid = points.rotate(p, basis, ("u", "v", "w"), centered=True)
        p = points.percentile_crop(laid, config.percentile_crop).select("patch", "x", "y", "z")
    return p


#: Why a patch has no figures.
FEW, SPARSE, LINE = "too few points", "too sparse for the pitch", "the points lie on a line"


class Surfaces(NamedTuple):
    """What the analysis of patches gives: `figures`, a row for each patch, and the cells behind them.

    figures: patch, error (null, or why the rest is null), points, kept_points (after the crops),
    processed_points, svr_um, sa_um, sq_um, svr_raw_um, noise_floor_um, svr_clean_um, height, width, u0,
    v0, u1, v1 (extent in the plane, m), y0, x0 (first cell), mx, my, mz (mm), e00 ... e22 (axes),
    bins_um, pairs (arrays by bucket), abnormalities (array of structs, by id).
    """

    figures: DataFrame
    laid: DataFrame
    roughness_mm: DataFrame
    elevation_mm: DataFrame
    heat: DataFrame | None
    cells: DataFrame | None


def _bins_by_patch(rough: DataFrame, pitch: float, config: RoughnessConfig) -> DataFrame:
    """(patch, bins_um, pairs, svr_raw_um) of a grid; buckets without pairs count as 0."""
    curve = metrics.bins(metrics.variogram(rough, pitch, config.svr_points, config.svr_span_mm * 0.001))
    entry = F.struct("bucket", F.struct("value_um", "pairs"))
    by = curve.groupBy("patch").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))  # svr_points entries
    every = F.sequence(F.lit(0), F.lit(config.svr_points - 1))
    read = lambda c, none: F.transform(every, lambda b: F.coalesce(F.try_element_at("m", b)[c], none))
    d = by.select("patch", read("value_um", F.lit(0.0)).alias("bins_um"), read("pairs", F.lit(0).cast("long")).alias("pairs"))
    return d.withColumn("svr_raw_um", F.aggregate("bins_um", F.lit(0.0), lambda a, b: a + b) / config.svr_points)


def analyze_patches(df: DataFrame, config: RoughnessConfig, progress: Callable | None = None) -> Surfaces:
    """The figures of all patches of (patch, x, y, z) points in mm, as a DataFrame with a row for each.

    Every step runs for all patches at once, and nothing of a patch comes to the driver. Tables of a row
    a patch are joined as they stand: a short one is broadcast after its rows are counted.
    """
    tell = progress or (lambda text, share: None)
    pitch = config.grid_mm * 0.001
    whole = points.finite_filter(with_patch(df))
    total = whole.groupBy("patch").agg(F.count("*").alias("points"))
    cropped = cut(_crop(whole, config))
    low = [F.min(c).alias(f"{c}0") for c in "xyz"]
    stats = cropped.groupBy("patch").agg(F.count("*").alias("kept_points"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *low)
    stats = cut(total.join(stats, "patch", "left").na.fill(0, ["kept_points"]))
    tell("aligning", 0.1)
    metre = [((F.col(c) - F.col(f"m{c}")) * 0.001).alias(c) for c in "xyz"]
    enough = stats.where(F.col("kept_points") >= LEAST_POINTS)
    metres = with_patches(cropped, enough.select("patch", "mx", "my", "mz")).select("patch", *metre)
    voxels = cut(points.voxel_downsample(metres, pitch))
    processed = voxels.groupBy("patch").agg(F.count("*").alias("processed_points"))
    axes = cut(points.aligned_axes(voxels.select("patch", "x", "y", "z")).drop("n"))
    laid = points.rotate(metres, axes).select("patch", "u", "v", "w")
    wide, high = (F.col("u1") - F.col("u0")) * 1000, (F.col("v1") - F.col("v0")) * 1000
    spacing = F.sqrt(wide * high / F.col("n"))
    cells_each_way = F.least(F.ceil(wide / config.grid_mm), F.ceil(high / config.grid_mm))
    why = F.when(spacing > 2 * config.grid_mm, SPARSE).when(cells_each_way < 1, LINE)
    boxes = cut(grid.extents(laid).withColumn("error", why))
    tell("rasterizing", 0.3)
    surface, shape = grid.rasterize(laid, pitch, boxes.where("error is null").drop("error"))
    surface = cut(surface)
    short, long = config.short_cutoff_mm * 0.001, config.long_cutoff_mm * 0.001
    filtered = lambda g: grid.band_pass(g, pitch, short, long) if config.gaussian_mesh else g
    rough = cut(filtered(surface))
    tell("measuring", 0.6)
    net = lambda c: metrics.less_noise(F.col(c), F.col("noise_floor_um"), config.subtract_noise)
    noise = grid.noise_floor(surface).withColumnRenamed("noise_um", "noise_floor_um")
    levels = metrics.sa_sq(rough).join(noise, "patch").join(_bins_by_patch(rough, pitch, config), "patch")
    levels = cut(levels.withColumn("svr_um", net("svr_raw_um")))
    in_mm = rough.select("patch", "iy", "ix", F.when(F.col("valid"), F.col("z") * 1000).alias("z"), "valid")
    heat = cells = None
    figures = levels
    if config.detect_abnormalities:
        tell("looking for defects", 0.8)
        heat = cut(heatmap.heatmap(in_mm, config.grid_mm))
        found, cells = defects.detect(in_mm, heat, levels.select("patch", "svr_um"), config.grid_mm, config.abnormality_threshold, config.min_abnormality_area_mm2)
        found, cells = cut(found), cut(cells)
        listed = found.groupBy("patch").agg(F.sort_array(F.collect_list(F.struct("id", *[c for c in found.columns if c not in ("patch", "id")]))).alias("abnormalities"))
        figures = figures.join(listed, "patch", "left").withColumn("svr_clean_um", F.col("svr_um"))
        if found.limit(1).count():  # without the defects' cells, filled anew
            marked = with_patches(surface, found.select("patch").distinct()).join(cells.withColumnRenamed("id", "defect"), ["patch", "iy", "ix"], "left")
            # what was a hole before isn't a measurement now: only these cells are known
            known = marked.select("patch", "iy", "ix", "z", (F.col("valid") & F.col("defect").isNull()).alias("valid"))
            refilled = cut(grid.fill_holes(known))
            left = refilled.where("valid").select("patch").distinct()
            clean = _bins_by_patch(filtered(refilled), pitch, config).join(left, "patch").select("patch", F.col("svr_raw_um").alias("again"))
            figures = figures.join(clean, "patch", "left").withColumn("svr_clean_um", F.coalesce(net("again"), "svr_um")).drop("again")
    else:
        none = F.lit(None).cast("double").alias("svr_clean_um")
        figures = figures.select("*", none, F.lit(None).cast("array<struct<id:int>>").alias("abnormalities"))
    placed = boxes.drop("n").join(axes, "patch").join(processed, "patch")
    placed = placed.join(shape.select("patch", "y0", "x0", F.col("h").alias("height"), F.col("w").alias("width")), "patch", "left").join(figures, "patch", "left")
    every = stats.drop("x0", "y0", "z0").join(placed, "patch", "left")
    error = F.when(F.col("kept_points") < LEAST_POINTS, FEW).otherwise(F.col("error"))
    tell("done", 1.0)
    raised = surface.select("patch", "iy", "ix", F.when(F.col("valid"), F.col("z") * 1000).alias("z"))
    return Surfaces(cut(every.withColumn("error", error)), laid, in_mm, raised, heat, cells)


def _error(r, config: RoughnessConfig) -> ValueError:
    if r.error == FEW:
        return ValueError(f"an analysis needs at least {LEAST_POINTS} points")
    if r.error == SPARSE:
        try:
            grid.check_spacing(r.kept_points, (r.u1 - r.u0) * 1000 * (r.v1 - r.v0) * 1000, config.grid_mm)
        except grid.SparseScanError as e:
            return e
    return ValueError("the points lie on a line; a grid needs two cells each way")


def results(found: Surfaces, config: RoughnessConfig) -> tuple[dict, dict]:
    """({patch: RoughnessResult}, {patch: error}) on the driver, for objects of some faces."""
    out, errors = {}, {}
    pitch = config.grid_mm * 0.001
    flat_mm = [(F.col(c) * 1000).alias(c) for c in "uvw"]
    for r in found.figures.collect():
        k = r.patch
        if r.error is not None:
            errors[k] = _error(r, config)
            continue
        of = lambda df, k=k: df.where(F.col("patch") == k) if df is not None else None
        e = np.array([[r[f"e{i}{j}"] for j in range(3)] for i in range(3)])
        listed = [Abnormality(d.id, d.kind, round(d.area_mm2, 4), round(d.diameter_mm, 4), round(d.peak_deviation_um, 2), (round(d.u_mm, 3), round(d.v_mm, 3)), d.points) for d in r.abnormalities or ()]
        out[k] = RoughnessResult(
            svr_um=r.svr_um,
            sa_um=r.sa_um,
            sq_um=r.sq_um,
            svr_raw_um=r.svr_raw_um,
            noise_floor_um=r.noise_floor_um,
            points=r.points,
            processed_points=r.processed_points,
            grid_shape=(r.height, r.width),
            grid_pitch_mm=config.grid_mm,
            grid_origin_mm=((r.u0 + r.x0 * pitch) * 1000, (r.v0 + r.y0 * pitch) * 1000),
            extent_mm=((r.u1 - r.u0) * 1000, (r.v1 - r.v0) * 1000),
            plane=PlaneFit(np.array([r.mx, r.my, r.mz]), e[2], e[0], e[1], of(found.laid).select(*flat_mm)),
            grid=of(found.roughness_mm),
            variogram_bins_um=tuple(r.bins_um),
            variogram_counts=tuple(r.pairs),
            config=config,
            abnormalities=tuple(listed),
            svr_clean_um=r.svr_clean_um,
            abnormal_cells=of(found.cells),
            elevation_grid=of(found.elevation_mm),
            heatmap_grid_um=of(found.heat),
        )
    return out, errors


def analyze_points(df: DataFrame, config: RoughnessConfig | None = None, progress: Callable | None = None, **overrides) -> RoughnessResult:
    """Roughness of one surface: a DataFrame with x, y, z in mm. ValueError where there is too little of it."""
    one = clean(with_patch(df.drop("patch")))
    config = settings(config, overrides)
    found, errors = results(analyze_patches(one, config, progress), config)
    if errors:
        raise errors[0]
    return found[0]


compute_roughness = analyze_points


class PurePythonResult(NamedTuple):
    """The engine's figures under the names of its interface; grids are DataFrames of cells."""

    # The names of the fields.
    sa_um: float
    sq_um: float
    svr_um: float
    processed_points: int
    variogram_bins_um: np.ndarray
    variogram_counts: np.ndarray
    grid_width: int
    grid_height: int
    grid_origin_mm: np.ndarray
    grid_z_mm: DataFrame
    elevation_grid_mm: DataFrame | None = None
    noise_floor_um: float = 0.0
    svr_raw_um: float = 0.0
    plane_centroid_mm: np.ndarray | None = None
    plane_normal: np.ndarray | None = None
    plane_x_axis: np.ndarray | None = None
    plane_y_axis: np.ndarray | None = None
    abnormalities: tuple[Abnormality, ...] = ()
    svr_clean_um: float | None = None
    abnormal_mask: DataFrame | None = None
    heatmap_grid_um: DataFrame | None = None


def analyze_pure_python(df: DataFrame, voxel_size_mm: float = 0.20, variogram_points: int = 10, variogram_span_mm: float = 0.5, **options) -> PurePythonResult:
    """The engine without crops: points (x, y, z) in mm; `options` are settings of RoughnessConfig."""
    names = {"min_abnormality_area_mm2", "abnormality_threshold", "detect_abnormalities", "gaussian_mesh", "subtract_noise", "short_cutoff_mm", "long_cutoff_mm"}
    if unknown := set(options) - names:
        raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
    r = analyze_points(df, grid_mm=voxel_size_mm, svr_points=variogram_points, svr_span_mm=variogram_span_mm, **options)
    p = r.plane
    return PurePythonResult(
        sa_um=r.sa_um, sq_um=r.sq_um, svr_um=r.svr_um, processed_points=r.processed_points,
        variogram_bins_um=np.array(r.variogram_bins_um), variogram_counts=np.array(r.variogram_counts, np.int64),
        grid_width=r.grid_shape[1], grid_height=r.grid_shape[0], grid_origin_mm=np.array([*r.grid_origin_mm, voxel_size_mm]),
        grid_z_mm=r.grid, elevation_grid_mm=r.elevation_grid, noise_floor_um=r.noise_floor_um, svr_raw_um=r.svr_raw_um,
        plane_centroid_mm=p.centroid, plane_normal=p.normal, plane_x_axis=p.x_axis, plane_y_axis=p.y_axis,
        abnormalities=r.abnormalities, svr_clean_um=r.svr_clean_um, abnormal_mask=r.abnormal_cells, heatmap_grid_um=r.heatmap_grid_um,
    )


def analyze_file(spark: SparkSession, path: str, config: RoughnessConfig | None = None, auto_decompose: bool = False, progress: Callable | None = None, **overrides):
    """Roughness of a point file; with auto_decompose, of each face where the points aren't planar."""
    p = load_points(spark, path)
    if auto_decompose:
        from .decompose import is_planar_surface

        if not is_planar_surface(p):
            return analyze_object(p, settings(config, overrides), progress=progress)
    return analyze_points(p, config, progress, **overrides)


def analyze_ply(spark: SparkSession, path: str, config: RoughnessConfig | None = None, **overrides) -> RoughnessResult:
    from ..sources.readers import load_ply

    return analyze_points(load_ply(spark, path), config, **overrides)


compute_roughness_from_ply = analyze_ply


def analyze_object(df: DataFrame, config: RoughnessConfig | None = None, decomposition=None, progress: Callable | None = None, **overrides):
    """Roughness of each planar face of an object."""
    from .decompose import decompose_3d_object

    return decompose_3d_object(df, settings(config, overrides), decomposition, progress)
