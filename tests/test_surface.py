import json
import math
import os
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rugosa.config import DecompositionConfig, RoughnessConfig, config_from_values, parse_range
from rugosa.functions import eigen
from rugosa.functions.columns import COMPARATORS, grade, grade_of
from rugosa.functions.quantiles import percentiles
from rugosa.operators import defects, grid, heatmap, metrics, morphology, neighbors, points
from rugosa.plans import analyze, decompose
from rugosa.plans.analyze import analyze_file, analyze_object, analyze_points
from rugosa.result import RoughnessResult, grid_array
from rugosa.sources import readers, writers


def frame(spark, a):
    a = np.asarray(a, float)
    return spark.createDataFrame(pd.DataFrame({"patch": 0, "pid": np.arange(len(a)), "x": a[:, 0], "y": a[:, 1], "z": a[:, 2]}))


def cells(spark, z, valid=None):
    y, x = np.indices(z.shape)
    v = np.isfinite(z) if valid is None else valid
    return spark.createDataFrame(pd.DataFrame({"patch": 0, "iy": y.ravel().astype("int32"), "ix": x.ravel().astype("int32"), "z": np.where(np.isfinite(z), z, 0.0).ravel(), "valid": v.ravel()}))


def dense(df, shape, column="z"):
    return grid_array(df, shape, column)


def lattice(w, h, step, z=0.0):
    x, y = np.meshgrid(np.arange(0, w + 1e-9, step), np.arange(0, h + 1e-9, step))
    return np.stack([x.ravel(), y.ravel(), np.full(x.size, z)], axis=1)


def test_config():
    assert parse_range("1:2.5") == (1, 2.5) and parse_range(None) is None
    with pytest.raises(ValueError):
        parse_range("7")
    assert parse_range("-5.5:10.2") == (-5.5, 10.2) and parse_range([3, 4]) == (3, 4) and parse_range("3:1") == (3, 1)
    assert config_from_values(x_range="0:4", grid_mm=0.5).x_range == (0, 4)
    with pytest.raises(TypeError):
        RoughnessConfig().with_(colour=1)
    assert RoughnessConfig.astm_standard_defaults() == RoughnessConfig()


def test_voxels(spark):
    got = points.voxel_downsample(frame(spark, [[0, 0, 0], [0.0004, 0, 0], [0.01, 0, 0]]), 0.001).orderBy("vx").collect()
    assert [r.n for r in got] == [2, 1] and got[0].x == pytest.approx(0.0002)


def axes_of(table):
    """The axes of one patch, as columns of a matrix."""
    r = table.first()
    return np.array([[r[f"e{i}{j}"] for j in range(3)] for i in range(3)]).T


def test_axes_of_a_tilted_plane(spark):
    rng = np.random.default_rng(42)
    xy = rng.uniform(-1, 1, (500, 2))
    p = frame(spark, np.column_stack([xy, 0.5 * xy[:, 0] - 0.3 * xy[:, 1] + 2]))
    axes = points.aligned_axes(p)
    e = axes_of(axes)
    assert np.allclose(e.T @ e, np.eye(3)) and np.linalg.det(e) > 0
    assert points.rotate(p, axes).agg(F.stddev("w")).first()[0] < 1e-6


def test_tiles_agree_with_one_tile(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(23, 31))
    g = cells(spark, z)
    kernel = grid.gaussian_kernel(0.005, 0.001)
    want = grid._smoothed(z, np.ones_like(z, bool), kernel)
    program = lambda a, inside, core: {"z": grid._smoothed(a["z"], inside, kernel)}
    got = grid.tiled(g, len(kernel) // 2, program, "patch int, iy int, ix int, z double", tile=8)
    assert np.allclose(dense(got, z.shape), want)


def test_holes_fill_in_rounds(spark):
    z = np.full((1, 30), np.nan)
    z[0, 0] = 1.0
    got = dense(grid.fill_holes(cells(spark, z)), z.shape)
    assert np.allclose(got, 1.0)
    z[0, 29] = 3.0
    got = dense(grid.fill_holes(cells(spark, z)), z.shape)
    assert np.allclose(got[0, :9], 1.0) and np.allclose(got[0, -9:], 3.0) and np.allclose(got[0, 9:-9], 2.0)


def test_constant_surface_is_smooth(spark):
    out = dense(grid.band_pass(cells(spark, np.full((50, 50), 0.005)), 0.0002, 0.001, 0.025), (50, 50))
    assert np.abs(out).max() < 1e-8


def test_variogram_of_two_measured_cells(spark):
    z = np.full((4, 4), np.nan)
    z[1, 1], z[1, 2] = 0, 1e-4
    v = metrics.variogram(cells(spark, z), 0.001, 2, 0.002)
    got = metrics.bins(v).orderBy("bucket").collect()
    assert [r.pairs for r in got] == [2, 0] and got[0].value_um == pytest.approx(100 / math.sqrt(2), abs=1e-5) and got[1].value_um == 0
    assert metrics.svr(v, 2).first().svr_um == pytest.approx(100 / (2 * math.sqrt(2)), abs=1e-5)


def test_variogram_of_a_constant_and_of_a_step(spark):
    mask = np.zeros((8, 8), bool)
    mask[2:6, 2:6] = True
    g = cells(spark, np.full((8, 8), 1e-4), mask)
    flat, v = metrics.sa_sq(g).first(), metrics.bins(metrics.variogram(g, 0.001, 5, 0.001)).orderBy("bucket").collect()
    assert flat.sa_um == pytest.approx(100) and flat.sq_um == pytest.approx(100)
    assert v[0].pairs == 0 and sum(r.pairs for r in v) < 8 * 8 * 25 and all(r.value_um == pytest.approx(0, abs=1e-4) for r in v)
    step = metrics.variogram(cells(spark, np.array([[0.0, 1e-4]])), 0.001, 4, 0.002)
    b = metrics.bins(step).collect()
    assert sum(r.pairs > 0 for r in b) == 1 and metrics.svr(step, 4).first().svr_um == pytest.approx(sum(r.value_um for r in b) / 4)


def test_variogram_of_noise(spark):
    z = np.random.default_rng(123).normal(0, 5e-5, (100, 100))
    g = cells(spark, z)
    v, flat = metrics.bins(metrics.variogram(g, 0.0002)).orderBy("bucket").collect(), metrics.sa_sq(g).first()
    assert len(v) == 10 and all(r.pairs > 0 for r in v) and flat.sq_um >= flat.sa_um > 0
    # half the mean squared difference of independent values is their variance
    assert all(r.value_um == pytest.approx(50, rel=0.05) for r in v)


def test_disc_of_the_default_setting():
    # cells within 5 mm at each pitch, as counted in double precision
    assert [len(heatmap.disc_offsets(5.0, p)) for p in (0.2, 0.1, 1.0)] == [1952, 7836, 80]


def test_axes_turn_towards_the_least_box(spark):
    """A rectangle whose longer side lies along (0.8, 0.6): the axes lie along its sides, and turn as documented."""
    x, y = np.meshgrid(np.linspace(-5, 5, 60), np.linspace(-2, 2, 25))
    x, y = x.ravel(), y.ravel()
    p = frame(spark, np.column_stack([0.8 * x - 0.6 * y, 0.6 * x + 0.8 * y, np.zeros(x.size)]))
    axes = points.principal_axes(points.covariance(p))
    e = axes_of(axes)
    laid = points.rotate(p, axes)
    boxes = {r.angle: (r.w, r.h) for r in points.box_scan_all(laid, 90).collect()}
    a = np.array(laid.select("u", "v").collect())
    for i in (0, 23, 66, 89):
        t = i * math.pi / 2 / 89
        w = np.ptp(math.cos(t) * a[:, 0] - math.sin(t) * a[:, 1])
        h = np.ptp(math.sin(t) * a[:, 0] + math.cos(t) * a[:, 1])
        assert boxes[i] == pytest.approx((w, h))
    best = points.box_scan(laid, 90).first()
    assert best.area == pytest.approx(min(w * h for w, h in boxes.values()))
    aligned = points.aligned_axes(p)
    got = axes_of(aligned)
    t = best.angle * math.pi / 2 / 89
    assert np.allclose(got[:, 0], math.cos(t) * e[:, 0] - math.sin(t) * e[:, 1])
    turned = points.rotate(p, aligned)
    spans = turned.agg(F.max("u") - F.min("u"), F.max("v") - F.min("v")).first()
    assert sorted(spans) == pytest.approx([4, 10], rel=0.02)


def test_eigenvectors_of_columns(spark):
    """Against LAPACK: any symmetric matrices, equal eigenvalues, zeros, and entries of very different sizes."""
    rng = np.random.default_rng(8)
    all_ = [a + a.T for a in rng.normal(size=(60, 3, 3))]
    all_ += [np.eye(3), np.zeros((3, 3)), np.diag([1.0, 3.0, 2.0]), np.diag([2.0, 2.0, 1.0]), np.ones((3, 3)), np.diag([1e12, 1e-12, 1.0]) + 1e-7, 1e-200 * all_[0], np.array([[0, 1, 0], [1, 0, 0], [0, 0, 0.0]])]
    i, j = (0, 0, 0, 1, 1, 2), (0, 1, 2, 1, 2, 2)
    d = spark.createDataFrame([(k, *map(float, a[i, j])) for k, a in enumerate(all_)] + [(99, None, 0.0, 0.0, 1.0, 0.0, 1.0)], ["k", *points.COVARIANCES])
    columns = [F.col(c) for c in points.COVARIANCES]
    got = {r.k: r.e for r in d.select("k", eigen.eigen(*columns).alias("e")).collect()}
    assert got.pop(99) is None
    for k, a in enumerate(all_):
        values, v = np.array([x.value for x in got[k]]), np.array([x.v for x in got[k]]).T
        size = max(np.abs(a).max(), 1e-300)
        assert np.allclose(values / size, np.linalg.eigvalsh(a / size)[::-1], atol=1e-13)
        assert np.allclose(v.T @ v, np.eye(3), atol=1e-13) and np.allclose(a / size @ v, v * (values / size), atol=1e-12)
    stats = d.where("k < 99").withColumnRenamed("k", "patch")
    for r in points.principal_axes(stats).collect():
        e = np.array([[r[f"e{m}{n}"] for n in range(3)] for m in range(3)])
        assert np.allclose(e @ e.T, np.eye(3)) and np.linalg.det(e) == pytest.approx(1)
        first = lambda v, order: next(v[n] for n in order if abs(v[n]) > 1e-9)
        assert first(e[0], (0, 1, 2)) > 0 and first(e[2], (2, 1, 0)) > 0


def test_plane_basis(spark):
    """The x axis is X laid into the plane; Y, where the plane stands across X."""
    rng = np.random.default_rng(6)
    flat = rng.uniform(-1, 1, (300, 2))
    tilted = np.column_stack([flat, 0.4 * flat[:, 0] + 0.2 * flat[:, 1]])
    across = np.column_stack([np.zeros(300), flat])
    d = frame(spark, np.vstack([tilted, across])).withColumn("patch", F.when(F.col("pid") < 300, 0).otherwise(1))
    got = {r.patch: np.array([[r[f"e{i}{j}"] for j in range(3)] for i in range(3)]) for r in points.plane_basis(points.covariance(d)).collect()}
    n = np.array([-0.4, -0.2, 1]) / math.sqrt(1.2)
    x = np.array([1, 0, 0]) - n[0] * n
    assert np.allclose(got[0], [x / np.linalg.norm(x), np.cross(n, x / np.linalg.norm(x)), n])
    assert np.allclose(np.abs(got[1]), [[0, 1, 0], [0, 0, 1], [1, 0, 0]]) and np.linalg.det(got[1]) == pytest.approx(1)


def test_percentiles_of_a_stretched_range(spark):
    """One value at 1e30, and one that repeats: ranges narrow by ranks, and few values are left."""
    rng = np.random.default_rng(5)
    v = {0: np.append(rng.normal(size=9000), 1e30), 1: np.append(np.repeat(2.5, 50_000), rng.normal(size=6000)), 2: np.exp(rng.normal(0, 40, 5000)), 3: np.append(np.repeat(0.0, 4000), rng.random(4000) - 2)}
    d = spark.createDataFrame(pd.DataFrame([(k, x) for k, a in v.items() for x in a], columns=["patch", "v"]))
    got = {r.patch: r for r in percentiles(d, "v", {"low": 0.01, "mid": 0.5, "high": 0.999}, few=1).collect()}
    for k, a in v.items():
        assert [got[k][n] for n in ("low", "mid", "high")] == pytest.approx(np.percentile(a, [1, 50, 99.9]).tolist(), rel=1e-12)


def test_figures_are_rows(spark):
    """A row for each patch, those that can't be analysed too; the same figures as one by one."""
    rng = np.random.default_rng(9)
    a = lattice(14, 9, 0.47)  # no point lies between two cells of the pitch, and the sides differ
    a[:, 2] = 0.05 * np.sin(a[:, 0]) + rng.normal(0, 0.005, len(a))
    b = lattice(10, 6, 0.47)
    b[:, 2] = rng.normal(0, 0.02, len(b))
    sparse, few = lattice(30, 30, 5.0), a[:7]
    line = np.column_stack([np.linspace(0, 9, 40), np.zeros(40), np.zeros(40)])
    parts = [frame(spark, q).withColumn("patch", F.lit(k)) for k, q in enumerate((a, b, sparse, few, line))]
    every = parts[0]
    for q in parts[1:]:
        every = every.unionByName(q)
    found = analyze.analyze_patches(every, RoughnessConfig(grid_mm=0.5))
    rows = {r.patch: r for r in found.figures.collect()}
    assert [rows[k].error for k in range(5)] == [None, None, analyze.SPARSE, analyze.FEW, analyze.LINE]
    for k, p in ((0, a), (1, b)):
        one = analyze_points(frame(spark, p), grid_mm=0.5)
        for name in ("svr_um", "sa_um", "sq_um", "noise_floor_um", "points", "processed_points"):
            assert rows[k][name] == pytest.approx(getattr(one, name), rel=1e-9)
        assert (rows[k].height, rows[k].width) == one.grid_shape and tuple(rows[k].pairs) == one.variogram_counts


@pytest.mark.parametrize("pitch", [0.1, 0.5])
def test_sums_by_fft_equal_those_one_by_one(spark, pitch):
    rng = np.random.default_rng(2)
    z = 5 + np.cumsum(rng.normal(0, 0.01, (70, 90)), axis=1)
    d = spark.createDataFrame(pd.DataFrame({"patch": 0, "iy": np.repeat(np.arange(70), 90), "ix": np.tile(np.arange(90), 70), "z": z.ravel(), "valid": (rng.random(z.size) > 0.1)})).withColumn("iy", F.col("iy").cast("int")).withColumn("ix", F.col("ix").cast("int"))
    a, b = ({r.bucket: r for r in metrics.variogram(d, pitch * 0.001, 10, 0.0005 * pitch * 4, many=m).collect()} for m in (1, 10**9))
    assert all(a[k].pairs == b[k].pairs and a[k].total == pytest.approx(b[k].total, rel=1e-9) for k in b)
    measured = d.withColumn("z", F.when(F.col("valid"), F.col("z")))
    for disc in (False, True):
        a, b = (heatmap.heatmap(measured, pitch, 12 * pitch, disc_averaging=disc, many=m).orderBy("iy", "ix").toPandas().value.to_numpy(float) for m in (1, 10**9))
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_percentiles(spark):
    rng = np.random.default_rng(3)
    v = {0: rng.normal(size=5001), 1: rng.integers(0, 4, 1000).astype(float), 2: np.array([7.0]), 3: np.exp(rng.normal(0, 6, 2000)), 4: np.full(9, -2.0)}
    d = spark.createDataFrame(pd.DataFrame([(k, x) for k, a in v.items() for x in a], columns=["patch", "v"]))
    shares = {"a": 0.05, "b": 0.5, "c": 0.95, "d": 1.0}
    got = {r.patch: r for r in percentiles(d, "v", shares).collect()}
    for k, a in v.items():
        assert [got[k][n] for n in shares] == pytest.approx(np.percentile(a, [5, 50, 95, 100]).tolist())
    assert percentiles(d.where("false"), "v", shares).count() == 0


def test_heatmap_modes(spark, monkeypatch):
    z = np.zeros((40, 40))
    z[20, 20] = 0.05
    point = dense(heatmap.heatmap(cells(spark, z), 0.2, 2.0, disc_averaging=False), z.shape, "value")
    disc = dense(heatmap.heatmap(cells(spark, z), 0.2, 2.0, disc_averaging=True), z.shape, "value")
    assert point[20, 20] > 2 * disc[20, 20] and np.nanmin(point) >= 0
    # the definition, cell by cell
    y, x = np.indices(z.shape)
    for cy, cx in ((20, 20), (20, 25), (0, 0), (12, 20)):
        d = np.sqrt(((y - cy) * 0.2) ** 2 + ((x - cx) * 0.2) ** 2)
        near = z[(d <= 2.0) & (d > 0)]
        assert point[cy, cx] == pytest.approx(1000 * math.sqrt(0.5 * ((z[cy, cx] - near.mean()) ** 2 + near.var())), abs=1e-6)
        assert disc[cy, cx] == pytest.approx(1000 * math.sqrt(2 * near.var()), abs=1e-6)
    for value, want in (("1", disc), (" Yes ", disc), ("0", point)):
        monkeypatch.setenv("SVR_DISC_AVERAGING", value)
        assert np.allclose(dense(heatmap.heatmap(cells(spark, z), 0.2, 2.0), z.shape, "value"), want)
    with pytest.raises(ValueError):
        heatmap.heatmap(cells(spark, z), 0.0)


def test_interpolation(spark):
    h = spark.createDataFrame([(0, y, x, 10.0 * (x + 1)) for y in range(4) for x in range(4)], "patch int, iy int, ix int, value double")
    shape = spark.createDataFrame([(0, 0.0, 0.0, 4, 4)], "patch int, ox double, oy double, h int, w int")
    at = [(0, 1, 0.0, 0.0), (0, 2, 1.0, 0.0), (0, 3, 0.5, 0.0), (0, 4, 9.0, -3.0)]
    p = spark.createDataFrame(at, "patch int, pid long, u double, v double")
    got = {r.pid: r.value for r in heatmap.interpolate(h, shape, p, 1.0).collect()}
    assert got == {1: 10, 2: 20, 3: 15, 4: 40}
    assert heatmap.interpolate(h, shape, p.limit(0), 1.0).count() == 0
    thin = spark.createDataFrame([(0, 0.0, 0.0, 1, 2)], "patch int, ox double, oy double, h int, w int")
    assert heatmap.interpolate(h.where("iy = 0 and ix < 2"), thin, p.limit(1), 1.0).first().value is None


def test_components_and_erosion(spark):
    z = np.zeros((20, 20), bool)
    z[2:7, 2:7] = z[7:9, 7:9] = z[12:18, 1:3] = True
    y, x = np.nonzero(z)
    c = spark.createDataFrame(pd.DataFrame({"patch": 0, "iy": y.astype("int32"), "ix": x.astype("int32")}))
    labels = morphology.components(c, ("iy", "ix"), morphology.EIGHT).groupBy("label").count().collect()
    assert sorted(r["count"] for r in labels) == [12, 29]
    assert {(r.iy, r.ix) for r in morphology.erode(c, 2).collect()} == {(4, 4)}


def test_enclosed_gap_is_filled(spark):
    z = np.ones((9, 9), bool)
    z[3:6, 3:6] = False
    y, x = np.nonzero(z)
    c = spark.createDataFrame(pd.DataFrame({"patch": 0, "iy": y.astype("int32"), "ix": x.astype("int32")}))
    assert morphology.fill_enclosed(c).count() == 81
    assert {(r.iy, r.ix) for r in morphology.near_background(morphology.fill_enclosed(c), 1.0).collect()} == {(i, j) for i in range(9) for j in range(9) if i in (0, 8) or j in (0, 8)}


def test_one_bump_and_one_pit(spark):
    z = np.random.default_rng(123).normal(0, 0.002, (100, 100))
    y, x = np.indices(z.shape)
    z[np.hypot((x - 20) * 0.2, (y - 20) * 0.2) <= 1.5] += 0.050
    z[np.hypot((x - 80) * 0.2, (y - 80) * 0.2) <= 1.5] -= 0.050
    g = cells(spark, z)
    level = spark.createDataFrame([(0, 5.0)], "patch int, svr_um double")
    heat = heatmap.heatmap(g, 0.2)
    found, marked = defects.detect(g, heat, level, 0.2)
    rows = found.orderBy("id").collect()
    assert [r.kind for r in rows] == ["protrusion", "depression"]
    assert all(r.area_mm2 >= 2 and r.peak_deviation_um >= 40 for r in rows)
    # every hot cell two cells inside the measured area is in a region: the border goes, not the regions' rims
    hot = dense(heat, z.shape, "value") >= 10
    hot[:2] = hot[-2:] = False
    hot[:, :2] = hot[:, -2:] = False
    assert {(r.iy, r.ix) for r in defects.candidates(g, heat, level, 2.0).collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(hot))))
    assert sum(r.points for r in rows) == marked.count()
    none, _ = defects.detect(g, heat, spark.createDataFrame([(0, 0.0)], "patch int, svr_um double"), 0.2)
    assert none.count() == 0
    flat = cells(spark, np.zeros((50, 50)))
    assert defects.detect(flat, heatmap.heatmap(flat, 0.2), spark.createDataFrame([(0, 10.0)], "patch int, svr_um double"), 0.2)[0].count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(42)
    p = np.concatenate([rng.normal(0, 0.5, (100, 3)), [[50, 0, 0], [-50, 0, 0]]])
    got = {r.pid: r.mean for r in neighbors.knn_mean_distance(frame(spark, p), 6).collect()}
    d = np.sort(np.linalg.norm(p[:, None] - p[None], axis=2), axis=1)[:, 1:7].mean(axis=1)
    assert len(got) == 102 and all(got[i] == pytest.approx(d[i]) for i in range(102))
    means = neighbors.knn_mean_distance(frame(spark, p), 6)
    assert {r.pid for r in neighbors.outliers(means).collect()} == {100, 101}


def test_components_across_tiles(spark):
    rng = np.random.default_rng(8)
    z = rng.random((40, 40)) < 0.45
    y, x = np.nonzero(z)
    c = spark.createDataFrame(pd.DataFrame({"patch": 0, "iy": y.astype("int32"), "ix": x.astype("int32")}))
    pick = lambda n: {(r.iy, r.ix): tuple(r.label) for r in morphology.components(c, ("iy", "ix"), morphology.EIGHT, tile=n).collect()}
    assert pick(7) == pick(512)


def test_components_of_a_long_u(spark):
    arm = 60  # tiles
    cells_ = [(0, y, x) for y in range(arm) for x in (0, 2)] + [(0, arm, x) for x in range(3)]
    c = spark.createDataFrame(cells_, "patch int, iy int, ix int")
    got = morphology.components(c, ("iy", "ix"), morphology.EIGHT, tile=1).collect()
    assert len(got) == len(cells_) and {tuple(r.label) for r in got} == {(0, 0, 0)}
    with pytest.raises(RuntimeError):
        morphology.components(c, ("iy", "ix"), morphology.EIGHT, rounds=1, tile=1)


def test_curvature(spark):
    a = lattice(10, 10, 0.5)
    corner = np.concatenate([a, np.stack([a[:, 0], np.zeros(len(a)), a[:, 1]], axis=1)[a[:, 1] > 0]])
    f = frame(spark, corner)
    s = f.join(neighbors.curvature(f, f), ["patch", "pid"]).toPandas()
    assert (s[(s.y < 0.6) & (s.z < 0.6)].sigma > 0.02).mean() > 0.5 and (s[(s.y > 5)].sigma > 0.02).mean() < 0.05


def test_grades(spark):
    values = [0.001, 0.0089, 0.0214, 0.05, 0.2, float("nan")]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    for k in COMPARATORS:
        assert [r[0] for r in d.select(grade(F.col("v"), k)).collect()] == [grade_of(v, k) for v in values]
    assert grade_of(0.01, "SCRATA") == "< A1" and grade_of(0.2, "ACI SIS") == "> SIS-4"


def result(**figures):
    return RoughnessResult(**({"svr_um": 30.0, "sa_um": 25.0, "sq_um": 35.0, "config": RoughnessConfig()} | figures))


def test_result_record():
    r = result(svr_um=25.4, points=6000, processed_points=5000, grid_shape=(20, 30), grid_pitch_mm=0.2)
    assert r.svr_mm == pytest.approx(0.0254) and r.svr_in == pytest.approx(0.001)
    assert (r.patch_width_mm, r.patch_height_mm, r.patch_area_mm2, r.point_density_pts_mm2) == pytest.approx((6.0, 4.0, 24.0, 250))
    assert r.average_point_spacing_mm == pytest.approx(1 / math.sqrt(250))
    low, high = result(svr_um=10.0).comparator_equivalents(), result(svr_um=200.0).comparator_equivalents()
    assert list(low.values()) == ["< A1", "C-9 200", "SIS-1"] and list(high.values()) == ["> A4", "> C-9 900", "> SIS-4"]
    odd = result(svr_um=float("nan"), sa_um=20.5, sq_um=float("inf"), points=100).to_dict()
    assert (odd["svr_um"], odd["sa_um"], odd["sq_um"], odd["points"]) == (None, 20.5, None, 100) and "20.5" in json.dumps(odd)
    large = result(points=10_000, grid_shape=(300, 300))
    good, bad = large.format_report(0.05), large.format_report(0.02)
    assert "PASS (Within specification)" in good and "VALID (>= 50x50 mm)" in good and "FAIL (Exceeds specification)" in bad
    assert "Evaluation Length" in good and "5.0 mm" in good and "Svr =" in repr(r)


def test_analyze_noisy_plane(spark, tmp_path):
    rng = np.random.default_rng(42)
    x, y = rng.uniform(0, 15, (2, 4000))
    p = frame(spark, np.stack([x, y, 0.2 * x - 0.1 * y + rng.normal(0, 0.02, 4000)], axis=1))
    r = analyze_points(p, grid_mm=0.5, short_cutoff_mm=1.0, long_cutoff_mm=5.0)
    assert r.svr_um > 0 and r.sq_um >= r.sa_um > 0 and r.points == 4000
    assert r.heatmap().count() == r.grid_shape[0] * r.grid_shape[1]
    r.save_metrics_json(str(tmp_path / "a" / "m.json"))
    r.save_grid_npz(str(tmp_path / "g.npz"))
    assert json.load(open(tmp_path / "a" / "m.json"))["points"] == 4000
    assert np.load(tmp_path / "g.npz")["grid"].shape == r.grid_shape
    cropped = analyze_points(p, grid_mm=0.5, x_range="2:12", percentile_crop=5)
    assert cropped.points == 4000 and cropped.extent_mm[0] < r.extent_mm[0]
    with pytest.raises(ValueError):
        analyze_points(frame(spark, rng.normal(size=(5, 3))))


def test_sparse_scan(spark):
    with pytest.raises(grid.SparseScanError) as e:
        analyze_points(frame(spark, lattice(49, 49, 1.0)))
    assert e.value.suggested_pitch == 0.6


def test_defects_lower_the_clean_figure(spark):
    rng = np.random.default_rng(3)
    a = lattice(12, 12, 0.2)
    a[:, 2] = rng.normal(0, 0.002, len(a)) + 0.08 * ((a[:, 0] - 6) ** 2 + (a[:, 1] - 6) ** 2 < 2.25)
    r = analyze_points(frame(spark, a), detect_abnormalities=True, long_cutoff_mm=8.0)
    assert r.abnormalities and r.svr_clean_um < r.svr_um and 0 < r.abnormal_area_pct < 50
    text = r.format_report()
    assert "Abnormality Analysis" in text and f"#{r.abnormalities[0].id}" in text and f"({r.svr_clean_um:.1f} µm)" in text


def filled(z, known):
    """Rounds of the mean of known side neighbours, then the mean of what was known at first; cell by cell."""
    z, mean, now = z.copy(), z[known].mean(), known.copy()
    for _ in range(8):
        new = {}
        for y, x in zip(*np.nonzero(~now)):
            side = [(y + a, x + b) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1)) if 0 <= y + a < z.shape[0] and 0 <= x + b < z.shape[1] and now[y + a, x + b]]
            if side:
                new[y, x] = np.mean([z[p] for p in side])
        for p, v in new.items():
            z[p], now[p] = v, True
    z[~now] = mean
    return z


def test_the_clean_figure_takes_filled_holes_for_unknown(spark):
    rng = np.random.default_rng(4)
    a = lattice(20, 20, 0.2)
    a[:, 2] = rng.normal(0, 0.002, len(a)) + 0.08 * ((a[:, 0] - 10) ** 2 + (a[:, 1] - 10) ** 2 < 2.25)
    a = a[~((abs(a[:, 0] - 14.6) < 1.05) & (abs(a[:, 1] - 10) < 1.05))]  # a hole beside the bump
    r = analyze_points(frame(spark, a), detect_abnormalities=True, gaussian_mesh=False, subtract_noise=False)
    z = dense(r.elevation_grid, r.grid_shape)
    bad = np.zeros(r.grid_shape, bool)
    for c in r.abnormal_cells.collect():
        bad[c.iy, c.ix] = True
    assert bad.any() and np.isnan(z).any()
    ok = np.isfinite(z) & ~bad
    z = filled(np.where(np.isfinite(z), z, 0), ok) / 1000
    v = metrics.variogram(cells(spark, z, ok), 0.0002)
    assert r.svr_clean_um == pytest.approx(metrics.svr(v).first().svr_um, rel=1e-9)


def test_formats(spark, tmp_path):
    p = np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9.5]])
    text = "\n".join(" ".join(map(str, r)) for r in p) + "\n"
    head = "ply\nformat {}\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 0\nproperty list uchar int i\nend_header\n"
    pcd = "# c\nVERSION 0.7\nFIELDS x y z n\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 2\nPOINTS 3\nDATA {}\n"
    files = {
        "a.ply": (head.format("ascii 1.0") + "\n".join(" ".join(map(str, r)) + " 7" for r in p) + "\n").encode(),
        "l.ply": head.format("binary_little_endian 1.0").encode() + b"".join(struct.pack("<fffB", *r, 7) for r in p),
        "b.ply": head.format("binary_big_endian 1.0").encode() + b"".join(struct.pack(">fffB", *r, 7) for r in p),
        "a.pcd": (pcd.format("ascii") + "\n".join(" ".join(map(str, r)) + " 0 0" for r in p)).encode(),
        "b.pcd": pcd.format("binary").encode() + b"".join(struct.pack("<fffff", *r, 0, 0) for r in p),
        "a.stl": ("solid s\n facet normal 0 0 1\n outer loop\n" + "".join(f"  vertex {r[0]} {r[1]} {r[2]}\n" for r in p) + " endloop\n endfacet\nendsolid").encode(),
        "b.stl": bytes(80) + struct.pack("<I", 1) + struct.pack("<12fH", 0, 0, 1, *p.ravel(), 0),
        "h.csv": b"x,y,z,q\n" + "\n".join(",".join(map(str, r)) + ",1" for r in p).encode(),
        "t.tsv": "\n".join("\t".join(map(str, r)) for r in p).encode(),
        "c.xyz": b"# made\n" + text.encode(),
        "o.obj": b"v 1 2 3\n  v\t4 5 6 0.5\nf 1 2 3\nvn 0 0 1\nv 7 8 9.5\n",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    np.save(tmp_path / "n.npy", p)
    np.savez(tmp_path / "n.npz", p)
    for name in [*files, "n.npy", "n.npz"]:
        got = readers.load_points(spark, str(tmp_path / name)).orderBy("pid").toPandas()
        assert np.allclose(got[["x", "y", "z"]], p), name
        assert got.pid.tolist() == [0, 1, 2], name
    commented = pcd.format("ascii") + "1 2 3 0 0\n# not a point\n\n4 5 6 0 0\n7 8 9.5 0 0 # the last\n"
    (tmp_path / "k.pcd").write_text(commented)
    (tmp_path / "k.obj").write_text("v 1 2 3\nv 4 5\nv\nv 4 5 6\nv 7 8 9.5 1\n")
    for name in ("k.pcd", "k.obj"):
        got = readers.load_points(spark, str(tmp_path / name)).orderBy("pid").toPandas()
        assert np.allclose(got[["x", "y", "z"]], p), name
    (tmp_path / "r.csv").write_text("1,2,3\n4,5\n6,7,8\n")
    (tmp_path / "w.csv").write_text("1,2,3\n4,5,6\na,7,8\n9,9,9\n")
    for name in ("r.csv", "w.csv"):
        with pytest.raises(Exception):
            readers.load_points(spark, str(tmp_path / name)).collect()
    (tmp_path / "z.pcd").write_bytes(pcd.format("binary_compressed").encode())
    with pytest.raises(Exception):
        readers.load_points(spark, str(tmp_path / "z.pcd")).collect()
    with pytest.raises(ValueError):
        readers.load_points(spark, "a.unknown")


def test_ranges_equal_one_read(spark, tmp_path):
    """Files cut into ranges of a few records, and files in whole, give the same rows."""
    p = np.random.default_rng(3).normal(size=(1000, 3))
    q = p.astype("<f4").astype(float)
    head = "ply\nformat {} 1.0\ncomment made\nelement vertex 1000\nproperty uchar red\nproperty {} z\nproperty {} x\nproperty {} y\nend_header\n"
    pack = lambda kind, order: b"".join(struct.pack(f"{order}B3{kind}", 7, r[2], r[0], r[1]) for r in p)
    (tmp_path / "l.ply").write_bytes(head.format("binary_little_endian", *["float"] * 3).encode() + pack("f", "<"))
    (tmp_path / "b.ply").write_bytes(head.format("binary_big_endian", *["double"] * 3).encode() + pack("d", ">"))
    (tmp_path / "a.ply").write_bytes(head.format("ascii", *["float"] * 3).encode() + "".join(f"7 {r[2]!r} {r[0]!r} {r[1]!r}\n" for r in p.tolist()).encode())
    pcd = "FIELDS x n y z\nSIZE 4 8 4 4\nTYPE F U F F\nCOUNT 1 2 1 1\nPOINTS 1000\nDATA binary\n"
    (tmp_path / "b.pcd").write_bytes(pcd.encode() + b"".join(struct.pack("<fQQff", r[0], 1, 2, r[1], r[2]) for r in p))
    (tmp_path / "b.stl").write_bytes(bytes(80) + struct.pack("<I", 333) + b"".join(struct.pack("<12fH", 0, 0, 1, *p[i : i + 3].ravel(), 0) for i in range(0, 999, 3)))
    np.save(tmp_path / "c.npy", p)
    np.save(tmp_path / "f.npy", np.asfortranarray(p))
    np.save(tmp_path / "i.npy", (p * 100).astype(">i2"))
    np.savez(tmp_path / "s.npz", p)
    np.savez(tmp_path / "t.npz", np.asfortranarray(p))
    np.savez_compressed(tmp_path / "d.npz", p)
    np.savez_compressed(tmp_path / "e.npz", np.asfortranarray(p))
    want = {"l.ply": q, "b.ply": p, "a.ply": p, "b.pcd": q, "b.stl": q[:999], "c.npy": p, "f.npy": p, "i.npy": (p * 100).astype(">i2"), "s.npz": p, "t.npz": p, "d.npz": p, "e.npz": p}
    for name, a in want.items():
        path, suffix = str(tmp_path / name), name[1:]
        files = readers._listed(spark, path)
        cuts = readers.ranges(files, suffix, 640).collect()
        assert len(cuts) == 1 if name in ("a.ply", "d.npz", "e.npz") else len(cuts) > 5
        for got in (readers.read_binary(spark, path, suffix, 640), readers._read_contents(files, suffix) if name != "a.ply" else readers.read_points(spark, path)):
            got = got.orderBy("pid").toPandas()
            assert got.pid.tolist() == list(range(len(a))) and np.array_equal(got[["x", "y", "z"]].to_numpy(), a), name
    # by a pattern: each file numbered by itself, text and binary together
    both = readers.read_points(spark, str(tmp_path / "*.ply")).groupBy("scan").agg(F.count("*").alias("n"), F.max("pid").alias("last"), F.min("pid").alias("first")).collect()
    assert sorted((r.scan[-5:], r.n, r.first, r.last) for r in both) == [(f"{c}.ply", 1000, 0, 999) for c in "abl"]


def test_a_large_file_is_many_tasks(spark, tmp_path):
    """A sparse file of 3.6 GB: its ranges cover all records once, and the last are read by themselves."""
    n = 300_000_000
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nend_header\n".encode()
    with open(tmp_path / "large.ply", "wb") as f:
        f.write(head)
        f.truncate(len(head) + 12 * n)
        f.seek(len(head) + 12 * (n - 1))
        f.write(struct.pack("<3f", 1, 2, 3))
    cuts = readers.ranges(readers._listed(spark, str(tmp_path / "large.ply")), ".ply").orderBy("first")
    rows = cuts.collect()
    assert len(rows) > 100 and rows[0]["first"] == 0 and all(a["first"] + a.n == b["first"] for a, b in zip(rows, rows[1:])) and rows[-1]["first"] + rows[-1].n == n
    last = cuts.where(F.col("first") == rows[-1]["first"]).mapInArrow(readers._read_ranges, readers.SCHEMA)
    assert last.agg(F.count("*"), F.max("pid"), F.max("z")).first()[:] == (rows[-1].n, n - 1, 3.0)


def test_files_that_end_too_soon(spark, tmp_path):
    """PLY gives the rows that are there; the other formats fail."""
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 9\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    (tmp_path / "s.ply").write_bytes(head.encode() + struct.pack("<12f", *range(12)) + b"xx")
    assert readers.load_ply(spark, str(tmp_path / "s.ply")).count() == 4
    (tmp_path / "s.pcd").write_bytes(b"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nPOINTS 9\nDATA binary\n" + bytes(50))
    np.save(tmp_path / "s.npy", np.zeros((9, 3)))
    (tmp_path / "s.npy").write_bytes((tmp_path / "s.npy").read_bytes()[:-3])
    for name in ("s.pcd", "s.npy"):
        with pytest.raises(Exception, match="before its points do"):
            readers.load_points(spark, str(tmp_path / name)).collect()


@pytest.mark.parametrize("band_cells", [1, 70, 10**6])
def test_grids_are_written_by_bands(spark, tmp_path, band_cells):
    """The file equals the array, also where cells and whole rows are missing; nothing else is left in the folder."""
    z = np.random.default_rng(1).normal(size=(23, 17))
    z[5:9] = np.nan
    z[2, 3] = np.nan
    d = cells(spark, np.nan_to_num(z), np.isfinite(z)).where("valid or iy = 2")
    d = d.withColumn("z", F.when(F.col("valid"), F.col("z"))).repartition(5)
    writers.save_npy(d, z.shape, str(tmp_path / "to" / "g.npy"), band_cells=band_cells)
    assert np.array_equal(np.load(tmp_path / "to" / "g.npy"), z, equal_nan=True)
    assert np.load(tmp_path / "to" / "g.npy", mmap_mode="r").shape == (23, 17) and os.listdir(tmp_path / "to") == ["g.npy"]
    writers.save_npz(str(tmp_path / "a"), {"grid": (d, z.shape, "z"), "pitch": 0.2, "names": np.arange(3)})
    got = np.load(tmp_path / "a.npz")
    assert np.array_equal(got["grid"], z, equal_nan=True) and got["pitch"] == 0.2 and got["names"].tolist() == [0, 1, 2]
    assert sorted(os.listdir(tmp_path)) == ["a.npz", "to"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    z = np.zeros((4, 4))
    (tmp_path / "g.npy").write_bytes(b"before")
    d = cells(spark, z, z == 0).withColumn("ix", F.when(F.col("iy") == 3, 99).otherwise(F.col("ix")))  # beyond the shape
    with pytest.raises(Exception):
        writers.save_npy(d, (4, 4), str(tmp_path / "g.npy"))
    assert os.listdir(tmp_path) == ["g.npy"] and (tmp_path / "g.npy").read_bytes() == b"before"


def test_functions_of_the_interface(spark):
    """The names that take arrays elsewhere take cells here: a bump is found, and the heatmap read between cells."""
    import rugosa

    z = np.random.default_rng(3).normal(0, 0.001, (60, 60))
    y, x = np.indices(z.shape)
    z[(y - 30) ** 2 + (x - 20) ** 2 <= 16] += 0.1
    d = cells(spark, z, z < 9).select("iy", "ix", "z")
    heat = rugosa.compute_heatmap_grid(d, pitch_mm=0.5, radius_mm=3.0, min_support_cells=12, disc_averaging=False)
    a = dense(heat, z.shape, "value")
    found, where = rugosa.detect_surface_abnormalities(d, 0.5, 10.0, threshold_factor=2.0, min_area_mm2=2.0, heatmap_grid_um=heat)
    assert [f.kind for f in found] == ["protrusion"] and found[0].point_count == where.count()
    masked, _ = rugosa.detect_surface_abnormalities(d, 0.5, 10.0, valid_mask=d.where("iy < 20").select("iy", "ix"))
    assert masked == []
    p = spark.createDataFrame([(1.0, 2.0, "a"), (7.25, 10.5, "b"), (-5.0, 99.0, "c")], "u_mm double, v_mm double, patch string")
    got = {r.patch: r.value for r in rugosa.interpolate_heatmap_at_points(heat, 0.0, 0.0, 0.5, p).collect()}
    assert got == pytest.approx({"a": a[4, 2], "b": (a[21, 14] + a[21, 15]) / 2, "c": a[59, 0]}, rel=1e-6)


def test_hulls(spark):
    """Against the definition: the corners are the points that no triangle of others holds; in any partitioning."""
    rng = np.random.default_rng(7)
    sets = {0: rng.normal(size=(3000, 2)), 1: rng.integers(0, 12, (500, 2)).astype(float), 2: np.array([[1.0, 2.0]] * 5), 3: np.column_stack([np.arange(9.0), 2 * np.arange(9.0)]), 4: np.array([[np.cos(t), np.sin(t)] for t in np.arange(200) / 200 * 2 * np.pi])}
    d = spark.createDataFrame(pd.DataFrame([(k, *map(float, q)) for k, a in sets.items() for q in a], columns=["patch", "u", "v"])).repartition(7)
    got = {}
    for r in points.convex_hull(d).orderBy("patch", "place").collect():
        got.setdefault(r.patch, []).append((r.u, r.v))
    for k in (0, 1, 4):
        h, a = np.array(got[k]), sets[k]
        e = np.roll(h, -1, axis=0) - h
        side = e[:, 0, None] * (a[None, :, 1] - h[:, 1, None]) - e[:, 1, None] * (a[None, :, 0] - h[:, 0, None])
        assert (side > -1e-9).all()  # all points lie to the left of every side
        turn = e[:, 0] * np.roll(e, -1, axis=0)[:, 1] - e[:, 1] * np.roll(e, -1, axis=0)[:, 0]
        assert (turn > 0).all() and tuple(h[0]) == min(map(tuple, h))
    assert got[2] == [(1.0, 2.0)] and got[3] == [(0.0, 0.0), (8.0, 16.0)]


def test_planarity(spark):
    rng = np.random.default_rng(1)
    flat = np.column_stack([rng.uniform(0, 50, (1000, 2)), rng.normal(0, 0.01, 1000)])
    assert decompose.is_planar_surface(frame(spark, flat))
    assert not decompose.is_planar_surface(frame(spark, rng.uniform(0, 50, (1000, 3))))
    assert decompose.is_planar_surface(frame(spark, flat[:4]))


def test_single_surface_object(spark):
    a = lattice(60, 60, 0.8)
    a[:, 2] = np.random.default_rng(9).normal(0, 0.02, len(a))
    r = analyze_object(frame(spark, a), RoughnessConfig(grid_mm=1.0))
    assert len(r.patches) == 1 and r.patches[0].name == "Primary Surface" and r.coverage_pct >= 90
    assert r.patches[0].is_astm_compliant and r.unassigned.count() == r.unassigned_points


def test_corner_has_two_faces(spark):
    rng = np.random.default_rng(10)
    a = lattice(60, 60, 0.8)
    n = rng.normal(0, 0.02, (2, len(a)))
    p = np.concatenate([np.column_stack([a[:, 0], a[:, 1], n[0]]), np.column_stack([a[:, 0], n[1], a[:, 1]])])
    r = analyze_object(frame(spark, p), RoughnessConfig(grid_mm=1.0), DecompositionConfig(min_patch_points=2000))
    assert len(r.patches) == 2 and r.unassigned_points > 0
    assert all(max(f.dims_mm) < 60 for f in r.patches) and r.patches[0].invalid_points.count() > 0
    assert r.status.count() == r.assigned_points and r.unassigned.count() == r.unassigned_points
    text, d = r.format_report(0.5), r.to_dict()
    assert "Multi-Surface 3D Object Roughness Report" in text and "Face 2 (" in text
    assert (d["patch_count"], d["dominant_patch_id"], len(d["patches"])) == (2, 1, 2)


def test_command_line(spark, tmp_path, capsys):
    from rugosa.__main__ import main

    a = lattice(20, 20, 0.5)
    a[:, 2] = np.random.default_rng(2).normal(0, 0.01, len(a))
    np.savetxt(tmp_path / "s.csv", a, delimiter=",")
    main([str(tmp_path / "s.csv"), "--grid-mm", "0.5", "--metrics-out", str(tmp_path / "m.json"), "--grid-out", str(tmp_path / "g.npz"), "--heatmap-out", str(tmp_path / "h.npy")])
    assert "S_VR" in capsys.readouterr().out
    assert os.path.exists(tmp_path / "m.json") and np.load(tmp_path / "h.npy").shape == np.load(tmp_path / "g.npz")["grid"].shape


def test_stream_of_scans(spark, tmp_path):
    from rugosa.streaming.watch import write_figures, watch_scans

    a = lattice(10, 10, 0.5)
    a[:, 2] = 0.1 * np.sin(2 * a[:, 0]) + np.random.default_rng(0).normal(0, 0.002, len(a))
    (tmp_path / "in").mkdir()
    pd.DataFrame({"scan": "a", "x": a[:, 0], "y": a[:, 1], "z": a[:, 2]}).to_parquet(tmp_path / "in.parquet")
    os.rename(tmp_path / "in.parquet", tmp_path / "in" / "1.parquet")
    config = RoughnessConfig(grid_mm=0.5)
    watch_scans(spark, str(tmp_path / "in"), str(tmp_path / "out"), config).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    one = analyze_points(frame(spark, a), config)
    assert len(got) == 1 and got[0].scan == "a" and got[0].error is None and one.svr_um > 10
    assert got[0].svr_um == pytest.approx(one.svr_um, rel=1e-9)
    # the same batch once more, as after a failure: no row is added
    write_figures(spark.read.parquet(str(tmp_path / "in")), 0, str(tmp_path / "out"), config)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_auto_decompose_keeps_a_flat_file(spark, tmp_path):
    a = lattice(20, 20, 0.5)
    np.save(tmp_path / "a.npy", a)
    assert isinstance(analyze_file(spark, str(tmp_path / "a.npy"), auto_decompose=True, grid_mm=0.5), RoughnessResult)


def test_neighbours_by_tiles_and_by_cubes(spark, monkeypatch):
    """Tiles that are joined instead, and probes on borders of tiles, find the same neighbours."""
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.random((1500, 3)) * [60, 60, 1], lattice(8, 8, 1.0), rng.normal(30, 0.01, (300, 3))])
    f = frame(spark, p)
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    for rows in (200_000, 150):
        monkeypatch.setattr(neighbors, "TILE_ROWS", rows)
        monkeypatch.setattr(neighbors, "PAIRS", 5000)
        got = {r.pid: r for r in neighbors.nearest_sums(f, f, 12, 6.0).collect()}
        assert len(got) == len(p)
        for i in range(0, len(p), 17):
            near = np.lexsort((np.arange(len(p)), d[i]))[:12]
            near = near[d[i, near] <= 6.0]
            assert got[i].n == len(near) and got[i].far == pytest.approx(d[i, near].sum())
            assert [got[i].cxx, got[i].cxz, got[i].czz] == pytest.approx([np.mean(a * b) - a.mean() * b.mean() for a, b in ((p[near][:, u], p[near][:, v]) for u, v in ((0, 0), (0, 2), (2, 2)))], abs=1e-9)
        some = f.where("pid % 50 = 0")
        want = set(np.flatnonzero((d[:, ::50] <= 1.5).any(axis=1)))
        assert [*sorted(r.pid for r in neighbors.near(f, some, 1.5).collect())] == sorted(want)


def test_neighbours_make_no_rows_of_pairs(spark):
    """What is shuffled and stored is about a row a point, and nothing is broadcast by a stored table's estimate."""
    f = frame(spark, lattice(30, 30, 1.0))
    made = neighbors.near(f, f.where("x < 3"), 1.5)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in made and "bx" not in made
    sums = neighbors.nearest_sums(f, f, 30, 4.5)
    assert sums.count() == f.count()
