"""Registered queries over the driver's tables: each with the SQL that gives the same rows.

Two scans are read out of the tables: `lineitem` as scattered points (x from the price, y from the
keys, z from discount and tax), and `events` as a lattice of 100 points a row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import COMPARATORS, cut, grade
from ..functions.quantiles import percentiles
from ..operators import defects, grid, heatmap, metrics, morphology, neighbors, planes, points
from . import decompose

PITCH, PITCH_MM, SHORT, LONG = 0.001, 1.0, 0.001, 0.025
SPAN, BINS = 0.0005, 10


def lineitem_mm(spark: SparkSession, d: str, patch=None) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    y = ((F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_linenumber")) % 1000) / F.lit(20.0)
    patch = F.lit(0) if patch is None else patch
    return t.select(patch.alias("patch"), (F.col("l_extendedprice") / 1000.0).alias("x"), y.alias("y"), (F.col("l_discount") + F.col("l_tax")).alias("z"))


def lineitem_m(spark: SparkSession, d: str) -> DataFrame:
    return lineitem_mm(spark, d).select("patch", (F.col("x") * 0.001).alias("u"), (F.col("y") * 0.001).alias("v"), (F.col("z") * 0.001).alias("w"))


def holed(p: DataFrame) -> DataFrame:
    """The scan with a window of 6 x 4 mm cut out, so that there is a hole to fill."""
    return p.where(~(F.col("u").between(0.040, 0.046) & F.col("v").between(0.020, 0.024)))


def events_mm(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/events.parquet")
    return t.select(F.lit(0).alias("patch"), F.col("event_id").alias("pid"), (F.col("event_id") % 100).cast("double").alias("x"), F.floor(F.col("event_id") / 100).cast("double").alias("y"), (F.col("value") / 1000.0).alias("z"))


def surface(spark: SparkSession, d: str) -> DataFrame:
    return grid.rasterize(lineitem_m(spark, d), PITCH)[0]


def roughness(spark: SparkSession, d: str) -> DataFrame:
    return grid.band_pass(surface(spark, d), PITCH, SHORT, LONG)


def in_mm(g: DataFrame) -> DataFrame:
    return g.select("patch", "iy", "ix", F.when(F.col("valid"), F.col("z") * 1000).alias("z"), "valid")


def bumpy(g: DataFrame) -> DataFrame:
    """A grid in mm with a raised and a sunken disc, 0.5 mm each."""
    disc = lambda y, x: (F.col("iy") - y) * (F.col("iy") - y) + (F.col("ix") - x) * (F.col("ix") - x) <= 36
    return g.withColumn("z", F.when(disc(12, 30), F.col("z") + 0.5).when(disc(35, 70), F.col("z") - 0.5).otherwise(F.col("z")))


def marks(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the events lattice that are marked: the lower values, and discs of 9 cells about every 40th cell."""
    e = events_mm(spark, d)
    disc = (F.col("x") % 40 - 20) * (F.col("x") % 40 - 20) + (F.col("y") % 40 - 20) * (F.col("y") % 40 - 20) <= 81
    return e.where((F.col("z") < 0.004) | disc).select("patch", F.col("y").cast("int").alias("iy"), F.col("x").cast("int").alias("ix"))


def r(c: str, n: int = 6):
    return F.round(F.col(c), n).alias(c)


#: Means of few decimals often end in a 5 just where they are rounded; both sides add this first.
OFF = 3e-8


def r_off(c: str):
    return F.round(F.col(c) + OFF, 6).alias(c)


PLANES = [(math.sin(i) / 3, math.cos(2 * i) / 4, 1.0, 0.02 * i - 0.2 + 5 * math.sin(i)) for i in range(12)]


def unit_planes() -> list[tuple]:
    out = []
    for i, (a, b, c, o) in enumerate(PLANES):
        n = math.sqrt(a * a + b * b + c * c)
        out.append((i, a / n, b / n, c / n, o))
    return out


def faces(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/part.parquet")
    s = F.col("p_size").cast("double")
    return t.groupBy("p_size").agg(F.sum("p_retailprice").alias("area"), F.avg("p_retailprice").alias("mean")).select(F.col("p_size").alias("face"), F.sin(s).alias("nx"), F.cos(s * 2).alias("ny"), F.sin(s * 3 + 1).alias("nz"), F.round("area", 2).alias("area"), (F.col("mean") / 10).alias("svr_um"))


def q_finite_filter(s, d):
    return points.finite_filter(lineitem_mm(s, d)).select("x", "y", r("z"))


def q_range_crop(s, d):
    return points.range_crop(lineitem_mm(s, d), (20.0, 60.0), (10.0, 40.0), (0.02, 0.15)).select("x", "y", r("z"))


def q_percentile_crop(s, d):
    return points.percentile_crop(lineitem_mm(s, d), 5.0, "x", "y").select("x", "y", r("z"))


def q_voxel_downsample(s, d):
    return points.voxel_downsample(lineitem_mm(s, d), 2.0).select(*[F.col(f"v{c}").cast("long").alias(f"v{c}") for c in "xyz"], r_off("x"), r_off("y"), r_off("z"), "n")


def q_covariance(s, d):
    return points.covariance(lineitem_mm(s, d)).select("n", *[r(c) for c in ("mx", "my", "mz", "cxx", "cxy", "cxz", "cyy", "cyz", "czz")])


def q_obb_angle_scan(s, d):
    return points.box_scan_all(lineitem_mm(s, d), 90, "x", "y").select("angle", r("w"), r("h"))


def q_raster_scatter(s, d):
    return grid.scatter(lineitem_m(s, d), PITCH).select("iy", "ix", r_off("sw"), F.round(F.col("swz") * 1e6 + OFF, 3).alias("swz"))


def q_grid_trim(s, d):
    return grid.trimmed(grid.scatter(lineitem_m(s, d), PITCH))[0].select("iy", "ix", F.round(F.col("z") * 1e6, 3).alias("z"), "valid")


def q_hole_fill(s, d):
    return grid.rasterize(holed(lineitem_m(s, d)), PITCH)[0].select("iy", "ix", F.round(F.col("z") * 1e6, 3).alias("z"), "valid")


def q_gauss_short(s, d):
    return grid.smooth(surface(s, d), SHORT, PITCH).select("iy", "ix", F.round(F.col("z") * 1e6, 3).alias("z"))


def q_gauss_dual(s, d):
    return roughness(s, d).select("iy", "ix", F.round(F.col("z") * 1e6, 3).alias("z"))


def q_sa_sq(s, d):
    return metrics.sa_sq(roughness(s, d)).select(r("sa_um"), r("sq_um"))


def q_laplacian_noise(s, d):
    return grid.noise_floor(surface(s, d)).select(r("noise_um"))


def q_variogram_bins(s, d):
    return metrics.bins(metrics.variogram(roughness(s, d), PITCH, BINS, SPAN)).select(F.col("bucket").cast("long").alias("bucket"), "pairs", r("value_um"))


def q_svr(s, d):
    return metrics.svr(metrics.variogram(roughness(s, d), PITCH, BINS, SPAN), BINS).select(r("svr_um"))


def q_svr_denoised(s, d):
    g = cut(surface(s, d))  # for two branches
    v = metrics.svr(metrics.variogram(grid.band_pass(g, PITCH, SHORT, LONG), PITCH, BINS, SPAN), BINS)
    return v.join(grid.noise_floor(g), "patch").select(r("svr_um"), r("noise_um"), F.round(metrics.less_noise(F.col("svr_um"), F.col("noise_um")), 6).alias("denoised_um"))


def _heat(s, d, disc):
    return heatmap.heatmap(in_mm(roughness(s, d)), PITCH_MM, 5.0, disc_averaging=disc)


def q_heatmap_point(s, d):
    return _heat(s, d, False).select("iy", "ix", r("value", 4))


def q_heatmap_disc(s, d):
    return _heat(s, d, True).select("iy", "ix", r("value", 4))


def q_heatmap_interpolate(s, d):
    h = _heat(s, d, False)
    shape = h.groupBy("patch").agg((F.max("iy") + 1).alias("h"), (F.max("ix") + 1).alias("w")).select("patch", F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"), "h", "w")
    p = events_mm(s, d).select("patch", "pid", (F.col("x") * 1.03 + 0.25).alias("u"), (F.col("y") * 0.5 + F.col("z")).alias("v"))
    return heatmap.interpolate(h, shape, p, PITCH_MM).select("pid", F.round(F.col("value").cast("double"), 2).alias("value"))


FINE, FINE_MM = 0.0002, 0.2


def fine(s, d):
    """The scan at the default pitch, 525 cells wide: its stencils cross a seam between tiles."""
    return grid.rasterize(lineitem_m(s, d), FINE)[0]


def q_hole_fill_fine(s, d):
    return fine(s, d).select("iy", "ix", F.round(F.col("z") * 1e6 + OFF, 3).alias("z"), "valid")


def q_variogram_fine(s, d):
    v = metrics.variogram(fine(s, d), FINE, BINS, SPAN)
    return metrics.bins(v).select(F.col("bucket").cast("long").alias("bucket"), "pairs", r("value_um", 4))


def q_heatmap_fine(s, d):
    return heatmap.heatmap(in_mm(fine(s, d)), FINE_MM, 5.0, disc_averaging=False).select("iy", "ix", r("value", 3))


def q_box_scan(s, d):
    b = points.box_scan(lineitem_mm(s, d), 90, "x", "y")
    return b.select("angle", r("w"), r("h"), r("area", 4))


def q_percentiles(s, d):
    t = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("patch"), "l_extendedprice")
    return percentiles(t, "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p99": 0.99}).select("patch", r("p05", 4), r("p50", 4), r("p99", 4))


def q_clean_refill(s, d):
    """The grid with the cells of a disc taken for unmeasured and filled anew, beside a hole that was filled before."""
    g = grid.rasterize(holed(lineitem_m(s, d)), PITCH)[0]
    bad = (F.col("iy") - 22) * (F.col("iy") - 22) + (F.col("ix") - 48) * (F.col("ix") - 48) <= 9
    again = grid.fill_holes(g.withColumn("valid", F.col("valid") & ~bad))
    return again.select("iy", "ix", F.round(F.col("z") * 1e6, 3).alias("z"), "valid")


def q_closing(s, d):
    return morphology.close_gaps(marks(s, d)).select("iy", "ix")


def q_near_background(s, d):
    return morphology.near_background(marks(s, d), 3.0).select("iy", "ix")


def q_enclosed(s, d):
    return morphology.fill_enclosed(marks(s, d)).select("iy", "ix")


def q_largest_component(s, d):
    c = morphology.components(marks(s, d), ("iy", "ix"), morphology.EIGHT)
    return decompose.of_largest(c).select("iy", "ix")


def q_planarity(s, d):
    """Share of variance across the plane, by kind of part: the figure that flatness is judged by."""
    t = s.read.parquet(f"{d}/lineitem.parquet")
    p = t.select(F.col("l_returnflag").alias("patch"), (F.col("l_extendedprice") / 1000.0).alias("x"), F.col("l_quantity").alias("y"), ((F.col("l_discount") + F.col("l_tax")) * 100).alias("z"))
    c = points.covariance(p, sample=True)
    share = neighbors.least_eigenvalue_share(*[F.col(x) for x in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")])
    return c.select("patch", "n", r("cxx"), r("cxy"), r("cyy"), r("czz"), F.round(share, 5).alias("share"))


def q_unassigned(s, d):
    a = planes.assign(lineitem_mm(s, d), unit_planes()).where(F.col("distance") >= 1.5)
    return a.select("x", "y", r("z"), "model")


def q_erosion(s, d):
    return morphology.erode(marks(s, d), 2).select("iy", "ix")


def q_components(s, d):
    c = morphology.components(marks(s, d), ("iy", "ix"), morphology.EIGHT)
    return c.select("iy", "ix", F.col("label.iy").alias("label_y"), F.col("label.ix").alias("label_x"))


def bumps(s, d):
    """(the grid with a raised and a sunken disc, its defects)."""
    g = cut(bumpy(in_mm(roughness(s, d))))
    v = metrics.svr(metrics.variogram(g.withColumn("z", F.col("z") / 1000), PITCH, BINS, SPAN), BINS)
    return g, defects.detect(g, heatmap.heatmap(g, PITCH_MM, 5.0, disc_averaging=False), v, PITCH_MM)[0]


def q_defects(s, d):
    return bumps(s, d)[1].select(F.col("id").cast("long").alias("id"), "kind", r("area_mm2", 4), r("diameter_mm", 4), r("peak_deviation_um", 2), r("u_mm", 3), r("v_mm", 3), F.col("points").cast("long").alias("points"))


def q_defect_totals(s, d):
    g, found = bumps(s, d)
    areas = g.groupBy("patch").agg(((F.max("iy") + 1) * (F.max("ix") + 1) * PITCH_MM**2).alias("patch_area_mm2"))
    return defects.totals(found, areas).select("defects", r("area_mm2", 4), r("area_pct", 6), r("per_dm2", 6))


def q_plane_score(s, d):
    return planes.score(lineitem_mm(s, d), unit_planes(), 1.5).select("model", "inliers")


def q_plane_assign(s, d):
    a = planes.assign(lineitem_mm(s, d).withColumn("pid", F.lit(0)), unit_planes())
    return a.groupBy("model").agg(F.count("*").alias("points"), F.count_if(F.col("distance") < 1.5).alias("near"), F.round(F.sum("distance"), 3).alias("total"))


def q_knn_mean_distance(s, d):
    return neighbors.knn_mean_distance(events_mm(s, d), 6).select("pid", r("mean"))


def q_outlier_filter(s, d):
    return neighbors.outliers(neighbors.knn_mean_distance(events_mm(s, d), 6)).select("pid")


def q_curvature_sigma(s, d):
    e = events_mm(s, d)
    return neighbors.curvature(e, e).select("pid", "n", r("sigma", 5))


def q_comparator_grade(s, d):
    t = s.read.parquet(f"{d}/events.parquet")
    mm = F.col("value") / 1000.0
    return t.select("event_id", *[grade(mm, k).alias(k.lower().replace(" ", "_").replace("-", "")) for k in COMPARATORS])


def q_patch_order(s, d):
    return planes.ordered(faces(s, d)).select("face", "patch_id", "area")


def q_area_weighted_svr(s, d):
    return metrics.object_figures(faces(s, d)).select(r("mean_svr_um"), r("worst_svr_um"), r("best_svr_um"))


def q_density(s, d):
    t = s.read.parquet(f"{d}/lineitem.parquet")
    p = lineitem_mm(s, d)
    y = ((F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_linenumber")) % 1000) / F.lit(20.0)
    p = t.select(F.col("l_returnflag").alias("patch"), (F.col("l_extendedprice") / 1000.0).alias("u"), y.alias("v"))
    return metrics.size_figures(p).select("patch", "points", r("width"), r("height"), r("area"), r("density"), r("spacing"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Bins, S_VR and its grade of the lineitem scan."""
    v = metrics.variogram(roughness(spark, d), PITCH, BINS, SPAN)
    total = metrics.svr(v, BINS)
    return metrics.bins(v).join(total, "patch").select("bucket", "pairs", "value_um", "svr_um", grade(F.col("svr_um") / 1000, "SCRATA").alias("scrata"))


QUERIES = {k[2:]: f for k, f in list(globals().items()) if k.startswith("q_")}


# The same in SQL ------------------------------------------------------------------------------

Y = "((l_orderkey * 7 + l_partkey * 13 + l_linenumber) % 1000) / 20.0::DOUBLE"
MM = f"mm AS (SELECT l_extendedprice / 1000.0::DOUBLE AS x, {Y} AS y, l_discount + l_tax AS z FROM lineitem)"
EV = "ev AS (SELECT event_id AS pid, (event_id % 100)::DOUBLE AS x, floor(event_id / 100)::DOUBLE AS y, value / 1000.0::DOUBLE AS z FROM events)"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


METRES = f"{MM}, m AS (SELECT x * 0.001::DOUBLE AS u, y * 0.001::DOUBLE AS v, z * 0.001::DOUBLE AS w FROM mm)"


def _scatter(where: str = "TRUE", pitch: float = PITCH, source: str = METRES) -> str:
    """`source` defines m (u, v, w)."""
    return f"""{source}, p AS (SELECT * FROM m WHERE {where}),
box AS (SELECT min(u) AS u0, min(v) AS v0, ceil((max(u) - min(u)) / {pitch}::DOUBLE)::BIGINT + 1 AS w_, ceil((max(v) - min(v)) / {pitch}::DOUBLE)::BIGINT + 1 AS h_ FROM p),
g AS (SELECT (u - u0) / {pitch}::DOUBLE AS gx, (v - v0) / {pitch}::DOUBLE AS gy, w, w_, h_ FROM p, box),
c AS (SELECT *, greatest(0, least(floor(gx)::BIGINT, w_ - 2)) AS ix, greatest(0, least(floor(gy)::BIGINT, h_ - 2)) AS iy FROM g),
f AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, gx - ix)) AS fx, greatest(0.0::DOUBLE, least(1.0::DOUBLE, gy - iy)) AS fy FROM c),
k AS (SELECT iy + dy AS iy, ix + dx AS ix, (CASE WHEN dx = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN dy = 1 THEN fy ELSE 1 - fy END) AS q, w FROM f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx)),
cells AS (SELECT iy, ix, sum(q) AS sw, sum(q * w) AS swz FROM k GROUP BY iy, ix)"""


def _trim(where: str = "TRUE", pitch: float = PITCH, source: str = METRES) -> str:
    return _scatter(where, pitch, source) + """,
seen AS (SELECT iy, ix, swz / sw AS z FROM cells WHERE sw > 1e-5), lim AS (SELECT min(iy) AS y0, max(iy) AS y1, min(ix) AS x0, max(ix) AS x1 FROM seen),
lat AS (SELECT y.y AS iy, x.x AS ix FROM lim, unnest(generate_series(0::BIGINT, y1 - y0)) y(y), unnest(generate_series(0::BIGINT, x1 - x0)) x(x)),
grid AS (SELECT lat.iy, lat.ix, s.z, s.z IS NOT NULL AS valid FROM lat LEFT JOIN (SELECT iy - y0 AS iy, ix - x0 AS ix, z FROM seen, lim) s ON lat.iy = s.iy AND lat.ix = s.ix)"""


def _filled(where: str = "TRUE", pitch: float = PITCH, source: str = METRES) -> str:
    return _trim(where, pitch, source) + _rounds("grid", "full_")


def _rounds(last: str, name: str) -> str:
    """Eight rounds of the mean of known side neighbours, then the mean of what was known at first."""
    out, first = "", last
    for i in range(8):
        out += f""",
{name}{i} AS (SELECT a.iy, a.ix, coalesce(a.z, n.z) AS z, a.valid FROM {last} a LEFT JOIN (SELECT b.iy + dy AS iy, b.ix + dx AS ix, avg(b.z) AS z FROM {last} b, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx) WHERE b.z IS NOT NULL GROUP BY 1, 2) n ON a.iy = n.iy AND a.ix = n.ix)"""
        last = f"{name}{i}"
    return out + f""",
{name} AS (SELECT iy, ix, coalesce(z, (SELECT avg(z) FROM {first} WHERE valid), 0.0::DOUBLE) AS z, valid FROM {last})"""


def _smooth(name: str, source: str, cutoff: float, pitch: float = PITCH) -> str:
    """exp(-pi (x / (0.4697 cutoff))^2) at the cells within half a cutoff, over its sum in bounds; x, then y."""
    half = f"ceil(0.5::DOUBLE * {cutoff}::DOUBLE / {pitch}::DOUBLE)::INT"
    return f""",
{name}_t AS (SELECT unnest(generate_series(-{half}, {half}))::INT AS o),
{name}_k AS (SELECT o, exp(-pi() * pow(o * {pitch}::DOUBLE / {cutoff}::DOUBLE / 0.4697::DOUBLE, 2)) AS q FROM {name}_t),
{name}_x AS (SELECT a.iy, a.ix, sum(q * b.z) / sum(q) AS z FROM {source} a, {name}_k, {source} b
 WHERE b.iy = a.iy AND b.ix = a.ix + o GROUP BY a.iy, a.ix),
{name} AS (SELECT a.iy, a.ix, sum(q * b.z) / sum(q) AS z FROM {name}_x a, {name}_k, {name}_x b
 WHERE b.ix = a.ix AND b.iy = a.iy + o GROUP BY a.iy, a.ix)"""


def _rough(pitch: float = PITCH, source: str = METRES) -> str:
    return _filled("TRUE", pitch, source) + _smooth("s1", "full_", SHORT, pitch) + _smooth("s2", "s1", LONG, pitch) + """,
rough AS (SELECT s1.iy, s1.ix, s1.z - s2.z AS z, full_.valid FROM s1 JOIN s2 ON s1.iy = s2.iy AND s1.ix = s2.ix JOIN full_ ON s1.iy = full_.iy AND s1.ix = full_.ix)"""


def _vario(source: str = "rough", scale: str = "1.0", pitch: float = PITCH) -> str:
    """v(b) = sqrt(1/(2 N) sum (z_i - z_j)^2) over the pairs of the distance bucket, each pair counted both ways."""
    most = f"ceil({BINS} * {SPAN}::DOUBLE / {pitch}::DOUBLE)::INT"
    return f""",
steps AS (SELECT unnest(generate_series(-{most}, {most}))::INT AS k),
offs AS (SELECT y.k AS dy, x.k AS dx, floor(sqrt(pow(x.k * {pitch}::DOUBLE, 2) + pow(y.k * {pitch}::DOUBLE, 2)) / {SPAN}::DOUBLE)::INT AS bucket
 FROM steps y, steps x WHERE y.k > 0 OR (y.k = 0 AND x.k > 0)),
met AS (SELECT o.bucket, count(*) AS n, sum((a.z - c.z) / {scale}::DOUBLE * ((a.z - c.z) / {scale}::DOUBLE)) AS d2
 FROM {source} a, offs o, {source} c
 WHERE o.bucket < {BINS} AND c.iy = a.iy + o.dy AND c.ix = a.ix + o.dx AND a.valid AND c.valid GROUP BY o.bucket),
vario AS (SELECT b.b AS bucket, 2 * coalesce(n, 0)::BIGINT AS pairs, coalesce(sqrt(d2 / (2 * n)), 0) * 1e6 AS value_um
 FROM generate_series(0, {BINS - 1}) b(b) LEFT JOIN met ON met.bucket = b.b),
total AS (SELECT sum(value_um) / {BINS} AS svr_um FROM vario)"""


NOISE = """,
lap AS (SELECT a.iy, a.ix, coalesce(sum(b.z), 0) - 4 * any_value(a.z) AS z, any_value(a.valid) AS valid FROM full_ a CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx) LEFT JOIN full_ b ON b.iy = a.iy + dy AND b.ix = a.ix + dx GROUP BY a.iy, a.ix),
noise AS (SELECT median(abs(z - (SELECT median(z) FROM lap WHERE valid))) / 0.6745::DOUBLE / sqrt(20::DOUBLE) * 1e6 AS noise_um FROM lap WHERE valid)"""


def _heat_sql(source: str, disc: bool, pitch: float = PITCH_MM, radius: float = 5.0) -> str:
    value = "sqrt(2 * v)" if disc else "sqrt(0.5 * ((hn.z - m) * (hn.z - m) + v))"
    most = f"ceil({radius}::DOUBLE / {pitch}::DOUBLE)::INT"
    return f""",
span AS (SELECT unnest(generate_series(-{most}, {most}))::INT AS k),
disc AS (SELECT y.k AS dy, x.k AS dx FROM span y, span x
 WHERE (y.k <> 0 OR x.k <> 0) AND sqrt(x.k * {pitch}::DOUBLE * (x.k * {pitch}::DOUBLE) + y.k * {pitch}::DOUBLE * (y.k * {pitch}::DOUBLE)) <= {radius}::DOUBLE),
hn AS (SELECT a.iy, a.ix, any_value(a.z) AS z, count(b.z) AS n, avg(b.z) AS m, var_pop(b.z) AS v
 FROM {source} a, disc o, {source} b
 WHERE b.iy = a.iy + o.dy AND b.ix = a.ix + o.dx AND b.z IS NOT NULL AND a.z IS NOT NULL GROUP BY a.iy, a.ix),
heat AS (SELECT g.iy, g.ix, CASE WHEN n >= 12 THEN {value} * 1000 END AS value FROM {source} g LEFT JOIN hn ON g.iy = hn.iy AND g.ix = hn.ix)"""


def _heat_rows_sql(source: str, pitch: float, radius: float = 5.0) -> str:
    """Point mode; the disc is summed row by row, each row as a difference of running sums. The grid is dense from 0."""
    most = f"ceil({radius}::DOUBLE / {pitch}::DOUBLE)::INT"
    return f""",
span AS (SELECT unnest(generate_series(-{most}, {most}))::INT AS k),
half AS (SELECT y.k AS dy, max(x.k) AS hw FROM span y, span x
 WHERE sqrt(x.k * {pitch}::DOUBLE * (x.k * {pitch}::DOUBLE) + y.k * {pitch}::DOUBLE * (y.k * {pitch}::DOUBLE)) <= {radius}::DOUBLE GROUP BY y.k),
level AS (SELECT avg(z) AS base, max(ix) AS last FROM {source}),
flat AS (SELECT iy, ix, z - base AS z FROM {source}, level),
run AS (SELECT iy, ix, count(z) OVER r AS n, coalesce(sum(z) OVER r, 0) AS s, coalesce(sum(z * z) OVER r, 0) AS q
 FROM flat WINDOW r AS (PARTITION BY iy ORDER BY ix)),
disc AS (SELECT a.iy, a.ix, any_value(a.z) AS z, sum(h.n - coalesce(l.n, 0)) - 1 AS n,
  sum(h.s - coalesce(l.s, 0)) - any_value(a.z) AS s, sum(h.q - coalesce(l.q, 0)) - any_value(a.z) * any_value(a.z) AS q
 FROM flat a CROSS JOIN half o CROSS JOIN level
 JOIN run h ON h.iy = a.iy + o.dy AND h.ix = least(a.ix + o.hw, level.last)
 LEFT JOIN run l ON l.iy = a.iy + o.dy AND l.ix = a.ix - o.hw - 1
 WHERE a.z IS NOT NULL GROUP BY a.iy, a.ix),
heat AS (SELECT g.iy, g.ix,
  CASE WHEN n >= 12 THEN sqrt(0.5 * ((d.z - s / n) * (d.z - s / n) + greatest(0, q / n - (s / n) * (s / n)))) * 1000 END AS value
 FROM {source} g LEFT JOIN disc d ON g.iy = d.iy AND g.ix = d.ix)"""


MMGRID = ", gmm AS (SELECT iy, ix, CASE WHEN valid THEN z * 1000 END AS z, valid FROM rough)"
MARKS = f"{EV}, mark AS (SELECT y::INT AS iy, x::INT AS ix FROM ev WHERE z < 0.004 OR (x % 40 - 20) * (x % 40 - 20) + (y % 40 - 20) * (y % 40 - 20) <= 81)"
CROSS12 = _values((dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if abs(dy) + abs(dx) in (1, 2))


def _labels(source: str) -> str:
    """Least row-major cell number over 8-connected cells, by a recursive query that keeps the frontier only."""
    return f""",
num AS (SELECT iy, ix, iy::BIGINT * 1000000 + ix AS id FROM {source}),
edge AS (SELECT a.id AS a, b.id AS b FROM num a, (SELECT * FROM (VALUES (-1), (0), (1)) y(dy), (VALUES (-1), (0), (1)) x(dx)) o, num b WHERE b.iy = a.iy + dy AND b.ix = a.ix + dx),
reach AS (SELECT id AS a, id AS b FROM num UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a WHERE edge.b > reach.a),
lab AS (SELECT b AS id, min(a) AS label FROM reach GROUP BY b)"""


def _knn(k: int) -> str:
    w = _values((dy, dx) for dy in range(-2, 3) for dx in range(-2, 3))
    return f"""{EV}, near AS (SELECT a.pid, b.pid AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM ev a, (VALUES {w}) o(dy, dx), ev b WHERE b.y = a.y + dy AND b.x = a.x + dx),
rk AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, other) AS r FROM near), mean_ AS (SELECT pid, sum(sqrt(d2)) / {k} AS mean FROM rk WHERE r <= {k + 1} GROUP BY pid)"""


def _curvature() -> str:
    w = _values((dy, dx) for dy in range(-4, 5) for dx in range(-4, 5))
    cov = ", ".join(f"covar_pop(b{p}, b{q}) AS {p}{q}" for p, q in ("xx", "xy", "xz", "yy", "yz", "zz"))
    return f"""WITH {EV}, near AS (SELECT a.pid, b.pid AS other, b.x AS bx, b.y AS by_, b.z AS bz, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM ev a, (VALUES {w}) o(dy, dx), ev b WHERE b.y = a.y + dy AND b.x = a.x + dx),
rk AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, other) AS r FROM near WHERE d2 <= 20.25),
c AS (SELECT pid, count(*) AS n, {cov.replace("by,", "by_,").replace("by)", "by_)")} FROM rk WHERE r <= 30 GROUP BY pid),
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c), p AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q),
u AS (SELECT *, ((xx - q) / p * ((yy - q) / p * (zz - q) / p - yz / p * yz / p) - xy / p * (xy / p * (zz - q) / p - yz / p * xz / p) + xz / p * (xy / p * yz / p - (yy - q) / p * xz / p)) / 2 AS r FROM p)
SELECT pid, n, round(greatest(q + 2 * p * cos(acos(least(greatest(r, -1.0::DOUBLE), 1.0::DOUBLE)) / 3 + 2 * pi() / 3), 0) / (3 * q), 5) AS sigma FROM u"""


def _grades() -> str:
    out = []
    for k, (below, least, limits, above) in COMPARATORS.items():
        whens = " ".join(f"WHEN value / 1000.0::DOUBLE <= {x}::DOUBLE THEN '{n}'" for x, n in limits)
        out.append(f"CASE WHEN value / 1000.0::DOUBLE < {least}::DOUBLE THEN '{below}' {whens} ELSE '{above}' END AS {k.lower().replace(' ', '_').replace('-', '')}")
    return f"SELECT event_id, {', '.join(out)} FROM events"


FACES = "face AS (SELECT p_size AS face, sin(p_size::DOUBLE) AS nx, cos(p_size::DOUBLE * 2) AS ny, sin(p_size::DOUBLE * 3 + 1) AS nz, round(sum(p_retailprice), 2) AS area, avg(p_retailprice) / 10 AS svr_um FROM part GROUP BY p_size)"
PL = f"pl AS (SELECT * FROM (VALUES {_values(unit_planes())}) t(model, nx, ny, nz, o))"
DIST = "abs(x * nx + y * ny + z * nz + o)"

NINE = "(SELECT * FROM (VALUES (-1), (0), (1)) y(dy), (VALUES (-1), (0), (1)) x(dx))"
HOLE = "NOT (u BETWEEN 0.040::DOUBLE AND 0.046::DOUBLE AND v BETWEEN 0.020::DOUBLE AND 0.024::DOUBLE)"


def _planarity() -> str:
    """The least root of the characteristic polynomial, by Newton steps from below: p(t) = t^3 - c2 t^2 + c1 t - c0."""
    cov = ", ".join(f"covar_samp({a}, {b}) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
    out = f"""WITH p AS (SELECT l_returnflag AS patch, l_extendedprice / 1000.0::DOUBLE AS x, l_quantity AS y, (l_discount + l_tax) * 100 AS z FROM lineitem),
c AS (SELECT patch, count(*) AS n, {cov} FROM p GROUP BY patch),
t0 AS (SELECT *, xx + yy + zz AS c2, xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz AS c1,
 xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS c0, 0.0::DOUBLE AS t FROM c)"""
    for i in range(12):
        out += f", t{i + 1} AS (SELECT * REPLACE (t - (t * t * t - c2 * t * t + c1 * t - c0) / (3 * t * t - 2 * c2 * t + c1) AS t) FROM t{i})"
    return out + " SELECT patch, n, round(xx, 6) AS cxx, round(xy, 6) AS cxy, round(yy, 6) AS cyy, round(zz, 6) AS czz, round(t / c2, 5) AS share FROM t12"


ORACLE_SQL = {
    "finite_filter": f"WITH {MM} SELECT x, y, round(z, 6) AS z FROM mm WHERE isfinite(x) AND isfinite(y) AND isfinite(z)",
    "range_crop": f"WITH {MM} SELECT x, y, round(z, 6) AS z FROM mm WHERE x BETWEEN 20 AND 60 AND y BETWEEN 10 AND 40 AND z BETWEEN 0.02::DOUBLE AND 0.15::DOUBLE",
    "percentile_crop": f"WITH {MM}, l AS (SELECT quantile_cont(x, 0.05) AS a, quantile_cont(x, 0.95) AS b, quantile_cont(y, 0.05) AS c, quantile_cont(y, 0.95) AS d FROM mm) SELECT x, y, round(z, 6) AS z FROM mm, l WHERE x BETWEEN a AND b AND y BETWEEN c AND d",
    "voxel_downsample": f"WITH {MM}, l AS (SELECT min(x) AS a, min(y) AS b, min(z) AS c FROM mm) SELECT floor((x - a) / 2.0::DOUBLE)::BIGINT AS vx, floor((y - b) / 2.0::DOUBLE)::BIGINT AS vy, floor((z - c) / 2.0::DOUBLE)::BIGINT AS vz, round(avg(x) + {OFF}::DOUBLE, 6) AS x, round(avg(y) + {OFF}::DOUBLE, 6) AS y, round(avg(z) + {OFF}::DOUBLE, 6) AS z, count(*) AS n FROM mm, l GROUP BY 1, 2, 3",
    "covariance": f"WITH {MM} SELECT count(*) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(avg(z), 6) AS mz, " + ", ".join(f"round(covar_pop({a}, {b}), 6) AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM mm",
    "obb_angle_scan": f"WITH {MM} SELECT a.i::INT AS angle, round(max(cos(t) * x - sin(t) * y) - min(cos(t) * x - sin(t) * y), 6) AS w, round(max(sin(t) * x + cos(t) * y) - min(sin(t) * x + cos(t) * y), 6) AS h FROM mm, (SELECT i, i * pi() / 2 / 89 AS t FROM range(90) r(i)) a GROUP BY a.i",
    "raster_scatter": f"WITH {_scatter()} SELECT iy::INT AS iy, ix::INT AS ix, round(sw + {OFF}::DOUBLE, 6) AS sw, round(swz * 1e6 + {OFF}::DOUBLE, 3) AS swz FROM cells",
    "grid_trim": f"WITH {_trim()} SELECT iy::INT AS iy, ix::INT AS ix, round(z * 1e6, 3) AS z, valid FROM grid",
    "hole_fill": f"WITH {_filled('NOT (u BETWEEN 0.040::DOUBLE AND 0.046::DOUBLE AND v BETWEEN 0.020::DOUBLE AND 0.024::DOUBLE)')} SELECT iy::INT AS iy, ix::INT AS ix, round(z * 1e6, 3) AS z, valid FROM full_",
    "gauss_short": f"WITH {_filled()}{_smooth('s1', 'full_', SHORT)} SELECT iy::INT AS iy, ix::INT AS ix, round(z * 1e6, 3) AS z FROM s1",
    "gauss_dual": f"WITH {_rough()} SELECT iy::INT AS iy, ix::INT AS ix, round(z * 1e6, 3) AS z FROM rough",
    "sa_sq": f"WITH {_rough()} SELECT round(avg(abs(z)) * 1e6, 6) AS sa_um, round(sqrt(avg(z * z)) * 1e6, 6) AS sq_um FROM rough WHERE valid",
    "laplacian_noise": f"WITH {_filled()}{NOISE} SELECT round(noise_um, 6) AS noise_um FROM noise",
    "variogram_bins": f"WITH {_rough()}{_vario()} SELECT bucket, pairs, round(value_um, 6) AS value_um FROM vario",
    "svr": f"WITH {_rough()}{_vario()} SELECT round(svr_um, 6) AS svr_um FROM total",
    "svr_denoised": f"WITH {_rough()}{_vario()}{NOISE} SELECT round(svr_um, 6) AS svr_um, round(noise_um, 6) AS noise_um, round(CASE WHEN noise_um > 0 THEN sqrt(greatest(0, svr_um * svr_um - noise_um * noise_um)) ELSE svr_um END, 6) AS denoised_um FROM total, noise",
    "heatmap_point": f"WITH {_rough()}{MMGRID}{_heat_sql('gmm', False)} SELECT iy::INT AS iy, ix::INT AS ix, round(value, 4) AS value FROM heat",
    "heatmap_disc": f"WITH {_rough()}{MMGRID}{_heat_sql('gmm', True)} SELECT iy::INT AS iy, ix::INT AS ix, round(value, 4) AS value FROM heat",
    "heatmap_interpolate": f"WITH {_rough()}{MMGRID}{_heat_sql('gmm', False)}, {EV}, sh AS (SELECT max(iy) + 1 AS h, max(ix) + 1 AS w FROM heat), pt AS (SELECT pid, greatest(0, least(x * 1.03::DOUBLE + 0.25::DOUBLE, (w - 1)::DOUBLE)) AS gx, greatest(0, least(y * 0.5::DOUBLE + z, (h - 1)::DOUBLE)) AS gy, w, h FROM ev, sh), lo AS (SELECT *, least(floor(gx)::BIGINT, w - 2) AS ix0, least(floor(gy)::BIGINT, h - 2) AS iy0 FROM pt), co AS (SELECT pid, iy0 + dy AS iy, ix0 + dx AS ix, (CASE WHEN dx = 1 THEN gx - ix0 ELSE 1 - (gx - ix0) END) * (CASE WHEN dy = 1 THEN gy - iy0 ELSE 1 - (gy - iy0) END) AS k FROM lo, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx)), s AS (SELECT pid, sum(k) AS k, sum(k * value) AS kv FROM co JOIN heat USING (iy, ix) WHERE value IS NOT NULL GROUP BY pid) SELECT ev.pid, round((CASE WHEN k > 1e-6 THEN kv / k END)::FLOAT::DOUBLE, 2) AS value FROM ev LEFT JOIN s ON ev.pid = s.pid",
    "hole_fill_fine": f"WITH {_filled(pitch=FINE)} SELECT iy::INT AS iy, ix::INT AS ix, round(z * 1e6 + {OFF}::DOUBLE, 3) AS z, valid FROM full_",
    "variogram_fine": f"WITH {_filled(pitch=FINE)}{_vario('full_', pitch=FINE)} SELECT bucket, pairs, round(value_um, 4) AS value_um FROM vario",
    "heatmap_fine": f"WITH {_filled(pitch=FINE)}, gmm AS (SELECT iy, ix, CASE WHEN valid THEN z * 1000 END AS z, valid FROM full_){_heat_rows_sql('gmm', FINE_MM)} SELECT iy::INT AS iy, ix::INT AS ix, round(value, 3) AS value FROM heat",
    "box_scan": f"WITH {MM}, a AS (SELECT i, i * pi() / 2 / 89 AS t FROM range(90) r(i)), "
    "w AS (SELECT i, max(cos(t) * x - sin(t) * y) - min(cos(t) * x - sin(t) * y) AS w, max(sin(t) * x + cos(t) * y) - min(sin(t) * x + cos(t) * y) AS h FROM mm, a GROUP BY i) "
    "SELECT i::INT AS angle, round(w, 6) AS w, round(h, 6) AS h, round(w * h, 4) AS area FROM w ORDER BY w * h, i LIMIT 1",
    "percentiles": "SELECT l_returnflag AS patch, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(median(l_extendedprice), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1",
    "clean_refill": f"WITH {_filled(HOLE)}, ok AS (SELECT iy, ix, CASE WHEN v THEN z END AS z, v AS valid FROM (SELECT iy, ix, z, valid AND (iy - 22) * (iy - 22) + (ix - 48) * (ix - 48) > 9 AS v FROM full_)){_rounds('ok', 'again')} SELECT iy::INT AS iy, ix::INT AS ix, round(z * 1e6, 3) AS z, valid FROM again",
    "closing": f"WITH {MARKS}, grown AS (SELECT DISTINCT iy + dy AS iy, ix + dx AS ix FROM mark, {NINE}) SELECT (g.iy)::INT AS iy, (g.ix)::INT AS ix FROM grown g, {NINE}, grown h WHERE h.iy = g.iy + dy AND h.ix = g.ix + dx GROUP BY 1, 2 HAVING count(*) = 9",
    "near_background": f"WITH {MARKS}, o AS (SELECT y AS dy, x AS dx FROM range(-3, 4) a(y), range(-3, 4) b(x) WHERE x * x + y * y BETWEEN 1 AND 9) SELECT a.iy, a.ix FROM mark a, o LEFT JOIN mark b ON b.iy = a.iy + dy AND b.ix = a.ix + dx GROUP BY a.iy, a.ix HAVING count(b.iy) < count(*)",
    "enclosed": f"WITH RECURSIVE {MARKS}, lim AS (SELECT min(iy) - 1 AS y0, max(iy) + 1 AS y1, min(ix) - 1 AS x0, max(ix) + 1 AS x1 FROM mark), every AS (SELECT y.y AS iy, x.x AS ix FROM lim, unnest(generate_series(y0, y1)) y(y), unnest(generate_series(x0, x1)) x(x)), empty AS (SELECT * FROM every ANTI JOIN mark USING (iy, ix)), "
    "outer_ AS (SELECT y0 AS iy, x0 AS ix FROM lim UNION SELECT e.iy, e.ix FROM outer_ u, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx), empty e WHERE e.iy = u.iy + dy AND e.ix = u.ix + dx) SELECT iy::INT AS iy, ix::INT AS ix FROM every ANTI JOIN outer_ USING (iy, ix)",
    "largest_component": f"WITH RECURSIVE {MARKS}{_labels('mark')}, sz AS (SELECT label, count(*) AS n FROM lab GROUP BY label ORDER BY n DESC, label LIMIT 1) SELECT num.iy, num.ix FROM num JOIN lab USING (id) JOIN sz USING (label)",
    "planarity": _planarity(),
    "unassigned": f"WITH {MM}, {PL}, n AS (SELECT row_number() OVER () AS i, * FROM mm), a AS (SELECT i, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, arg_min(model, ({DIST}, model)) AS model, min({DIST}) AS distance FROM n, pl GROUP BY i) SELECT x, y, round(z, 6) AS z, model FROM a WHERE distance >= 1.5::DOUBLE",
    "erosion": f"WITH {MARKS}, n AS (SELECT a.iy, a.ix, count(b.iy) AS n FROM mark a, (VALUES {CROSS12}) o(dy, dx), mark b WHERE b.iy = a.iy + dy AND b.ix = a.ix + dx GROUP BY a.iy, a.ix) SELECT iy, ix FROM n WHERE n = 12",
    "components": f"WITH RECURSIVE {MARKS}{_labels('mark')} SELECT num.iy, num.ix, (label // 1000000)::INT AS label_y, (label % 1000000)::INT AS label_x FROM num JOIN lab USING (id)",
    "defects": f"WITH RECURSIVE {_rough()}{MMGRID}, bump AS (SELECT iy, ix, z + CASE WHEN (iy - 12) * (iy - 12) + (ix - 30) * (ix - 30) <= 36 THEN 0.5::DOUBLE WHEN (iy - 35) * (iy - 35) + (ix - 70) * (ix - 70) <= 36 THEN -0.5::DOUBLE ELSE 0 END AS z, valid FROM gmm){_vario('bump', '1000.0')}{_heat_sql('bump', False)}, inside AS (SELECT a.iy, a.ix FROM bump a, (VALUES {CROSS12}) o(dy, dx), bump b WHERE a.valid AND b.valid AND b.iy = a.iy + dy AND b.ix = a.ix + dx GROUP BY a.iy, a.ix HAVING count(*) = 12), cand AS (SELECT heat.iy, heat.ix FROM heat JOIN inside USING (iy, ix), total WHERE value >= 2 * svr_um AND svr_um > 0){_labels('cand')}, d AS (SELECT label, count(*) AS points, avg(z) AS mean, max(abs(z)) AS peak, avg(num.iy) AS my, avg(num.ix) AS mx FROM num JOIN lab USING (id) JOIN bump ON bump.iy = num.iy AND bump.ix = num.ix GROUP BY label HAVING count(*) >= 2) SELECT row_number() OVER (ORDER BY label) AS id, CASE WHEN mean >= 0 THEN 'protrusion' ELSE 'depression' END AS kind, round(points::DOUBLE, 4) AS area_mm2, round(2 * sqrt(points / pi()), 4) AS diameter_mm, round(peak * 1000, 2) AS peak_deviation_um, round(mx, 3) AS u_mm, round(my, 3) AS v_mm, points FROM d",
    "plane_score": f"WITH {MM}, {PL} SELECT model, count(*) FILTER (WHERE {DIST} < 1.5::DOUBLE) AS inliers FROM mm, pl GROUP BY model",
    "plane_assign": f"WITH {MM}, {PL}, n AS (SELECT row_number() OVER () AS i, * FROM mm), a AS (SELECT i, arg_min(model, ({DIST}, model)) AS model, min({DIST}) AS distance FROM n, pl GROUP BY i) SELECT model, count(*) AS points, count(*) FILTER (WHERE distance < 1.5::DOUBLE) AS near, round(sum(distance), 3) AS total FROM a GROUP BY model",
    "knn_mean_distance": f"WITH {_knn(6)} SELECT pid, round(mean, 6) AS mean FROM mean_",
    "outlier_filter": f"WITH {_knn(6)} SELECT pid FROM mean_ WHERE mean > (SELECT avg(mean) + 3 * stddev_pop(mean) FROM mean_)",
    "curvature_sigma": _curvature(),
    "comparator_grade": _grades(),
    "patch_order": f"WITH {FACES}, a AS (SELECT *, CASE WHEN abs(nz) >= abs(nx) AND abs(nz) >= abs(ny) THEN 0 WHEN abs(nx) >= abs(ny) THEN 1 ELSE 2 END AS axis FROM face) SELECT face, row_number() OVER (ORDER BY axis, CASE WHEN (CASE axis WHEN 0 THEN nz WHEN 1 THEN nx ELSE ny END) >= 0 THEN 0 ELSE 1 END, area DESC, face)::INT AS patch_id, area FROM a",
    "area_weighted_svr": f"WITH {FACES} SELECT round(sum(area * svr_um) / sum(area), 6) AS mean_svr_um, round(max(svr_um), 6) AS worst_svr_um, round(min(svr_um), 6) AS best_svr_um FROM face",
    "density": f"WITH s AS (SELECT l_returnflag AS patch, l_extendedprice / 1000.0::DOUBLE AS u, {Y} AS v FROM lineitem), d AS (SELECT patch, count(*) AS points, max(u) - min(u) AS width, max(v) - min(v) AS height FROM s GROUP BY patch) SELECT patch, points, round(width, 6) AS width, round(height, 6) AS height, round(width * height, 6) AS area, round(points / (width * height), 6) AS density, round(1 / sqrt(points / (width * height)), 6) AS spacing FROM d",
}
ORACLE_SQL["defect_totals"] = f"""WITH d AS ({ORACLE_SQL["defects"]}),
area AS (WITH {_filled()} SELECT (max(iy) + 1) * (max(ix) + 1) * {PITCH_MM}::DOUBLE AS a FROM full_)
SELECT count(*) AS defects, round(sum(area_mm2), 4) AS area_mm2, round(100 * sum(area_mm2) / any_value(a), 6) AS area_pct,
 round(10000 * count(*) / any_value(a), 6) AS per_dm2 FROM d, area"""
