"""Queries of the alignment and of the whole engine, by flag of the order lines, and their SQL.

The scan is the lineitem scan, sheared and tilted, so that neither its axes nor its box lie along x and y.
The SQL follows the definitions: eigenvalues by the trigonometric formula, eigenvectors as cross
products of rows of A - l I.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RoughnessConfig
from ..operators import grid, points
from .analyze import analyze_patches
from .queries import BINS, MM, NOISE, SPAN, _rough, _vario, lineitem_mm

#: No multiple of it is a multiple of the coordinates' steps, so that no point lies between two cells.
ENGINE_MM = 1.98713579


def tilted_mm(spark: SparkSession, d: str) -> DataFrame:
    t = lineitem_mm(spark, d, F.col("l_returnflag"))
    return t.select("patch", (F.col("x") + 0.35 * F.col("y")).alias("x"), "y", (F.col("z") + 0.3 * F.col("x") - 0.2 * F.col("y")).alias("z"))


def rounded(*names: str, digits: int = 6) -> list:
    return [(F.round(c, digits) + F.lit(0.0)).alias(c) for c in names]


def q_plane_basis(s, d):
    basis = points.plane_basis(points.covariance(tilted_mm(s, d), sample=True))
    return basis.select("patch", "n", *rounded(*points.AXES))


def q_principal_axes(s, d):
    return points.principal_axes(points.covariance(tilted_mm(s, d))).select("patch", *rounded(*points.AXES))


def q_aligned_box(s, d):
    p = tilted_mm(s, d)
    axes = points.aligned_axes(p)
    box = grid.extents(points.rotate(p, axes)).select("patch", *[(F.col(f"{c}1") - F.col(f"{c}0")).alias(n) for c, n in (("u", "width"), ("v", "height"))])
    return axes.join(box, "patch").select("patch", "n", *rounded(*points.AXES), *rounded("width", "height"))


def q_engine(s, d):
    """The figures of the analysis: a row for each flag, all analysed in one plan."""
    f = analyze_patches(tilted_mm(s, d), RoughnessConfig(grid_mm=ENGINE_MM, svr_points=BINS, svr_span_mm=SPAN * 1000)).figures
    extent = [((F.col(f"{c}1") - F.col(f"{c}0")) * 1000).alias(n) for c, n in (("u", "width_mm"), ("v", "height_mm"))]
    counts = [F.col(c).cast("long").alias(c) for c in ("points", "processed_points", "height", "width")]
    figures = rounded("sa_um", "sq_um", "svr_raw_um", "noise_floor_um", "svr_um", "width_mm", "height_mm", digits=4)
    return f.where("error is null").select("*", *extent).select("patch", *counts, *figures)


QUERIES = {k[2:]: f for k, f in list(globals().items()) if k.startswith("q_")}


FLAG = "l_returnflag AS patch"
TILTED = f"""{MM.replace("AS z FROM", f"AS z, {FLAG} FROM")},
t AS (SELECT patch, x + 0.35::DOUBLE * y AS x, y, z + 0.3::DOUBLE * x - 0.2::DOUBLE * y AS z FROM mm)"""


def _eigen(source: str, covariance: str) -> str:
    """lead and last (patch, x, y, z): unit eigenvectors of the largest and the least eigenvalue, signs as documented."""
    six = ", ".join(f"{covariance}({a}, {b}) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))

    def signed(name: str, which: int, order: str) -> str:
        a, b, c = order
        lead = f"CASE WHEN abs({a}) > 1e-9 THEN sign({a}) WHEN abs({b}) > 1e-9 THEN sign({b}) ELSE sign({c}) END"
        return f"{name} AS (SELECT patch, x * {lead} AS x, y * {lead} AS y, z * {lead} AS z FROM unit WHERE k = {which})"

    return f""",
cov AS (SELECT patch, count(*) AS n, {six} FROM {source} GROUP BY patch),
mid AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cov),
dev AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM mid),
det AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p) AS r FROM dev),
val AS (SELECT d.*, k.k, q + 2 * p * cos(acos(greatest(-1, least(1, r))) / 3 + k.k * 2 * pi() / 3) AS l FROM det d, (VALUES (0), (1)) k(k)),
rows_ AS (SELECT patch, k, array_value(xx - l, xy, xz) AS a, array_value(xy, yy - l, yz) AS b, array_value(xz, yz, zz - l) AS c FROM val),
crossed AS (SELECT patch, k, unnest([array_cross_product(a, b), array_cross_product(a, c), array_cross_product(b, c)]) AS v FROM rows_),
best_ AS (SELECT patch, k, v, sqrt(array_inner_product(v, v)) AS s FROM crossed
 QUALIFY row_number() OVER (PARTITION BY patch, k ORDER BY array_inner_product(v, v) DESC) = 1),
unit AS (SELECT patch, k, v[1] / s AS x, v[2] / s AS y, v[3] / s AS z FROM best_),
{signed("lead", 0, "xyz")},
{signed("last", 1, "zyx")}"""


#: axes (patch, ax ... cz): the principal axes, the second from the two others.
AXES = """,
axes AS (SELECT l.patch, l.x AS ax, l.y AS ay, l.z AS az,
  n.y * l.z - n.z * l.y AS bx, n.z * l.x - n.x * l.z AS by_, n.x * l.y - n.y * l.x AS bz,
  n.x AS cx, n.y AS cy, n.z AS cz FROM lead l JOIN last n USING (patch))"""


def _turned(source: str) -> str:
    """turned (patch, ax ... cz): the axes turned to the least of 90 boxes of the points of `source`."""
    return f""",
flat AS (SELECT patch, x * ax + y * ay + z * az AS u, x * bx + y * by_ + z * bz AS v FROM {source} JOIN axes USING (patch)),
ang AS (SELECT i, i * pi() / 2 / 89 AS t FROM range(90) r(i)),
boxes AS (SELECT patch, i, t, (max(cos(t) * u - sin(t) * v) - min(cos(t) * u - sin(t) * v)) * (max(sin(t) * u + cos(t) * v) - min(sin(t) * u + cos(t) * v)) AS area
 FROM flat, ang GROUP BY patch, i, t),
least_ AS (SELECT patch, t FROM boxes QUALIFY row_number() OVER (PARTITION BY patch ORDER BY area, i) = 1),
turned AS (SELECT patch, cos(t) * ax - sin(t) * bx AS ax, cos(t) * ay - sin(t) * by_ AS ay, cos(t) * az - sin(t) * bz AS az,
  sin(t) * ax + cos(t) * bx AS bx, sin(t) * ay + cos(t) * by_ AS by_, sin(t) * az + cos(t) * bz AS bz, cx, cy, cz
 FROM axes JOIN least_ USING (patch))"""


NINE_NAMES = ("ax", "ay", "az", "bx", "by_", "bz", "cx", "cy", "cz")
NINE = ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS e{i // 3}{i % 3}" for i, c in enumerate(NINE_NAMES))


def _engine(flag: str) -> str:
    pitch = ENGINE_MM / 1000
    vox = ", ".join(f"floor(({c} - {c}0) / {pitch}::DOUBLE) AS v{c}" for c in "xyz")
    source = f"""{TILTED},
mean AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM t WHERE patch = '{flag}'),
c0 AS (SELECT patch, (x - mx) * 0.001::DOUBLE AS x, (y - my) * 0.001::DOUBLE AS y, (z - mz) * 0.001::DOUBLE AS z FROM t, mean WHERE patch = '{flag}'),
low AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM c0),
keyed AS (SELECT patch, {vox}, x, y, z FROM c0, low),
voxels AS (SELECT patch, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM keyed GROUP BY patch, vx, vy, vz){_eigen("voxels", "covar_pop")}{AXES}{_turned("voxels")},
m AS (SELECT x * ax + y * ay + z * az AS u, x * bx + y * by_ + z * bz AS v, x * cx + y * cy + z * cz AS w FROM c0, turned)"""
    return f"""SELECT * FROM (WITH {_rough(pitch, source)}{_vario(pitch=pitch)}{NOISE}
SELECT '{flag}' AS patch, (SELECT count(*) FROM c0) AS points, (SELECT count(*) FROM voxels) AS processed_points,
  (SELECT max(iy) + 1 FROM full_)::BIGINT AS height, (SELECT max(ix) + 1 FROM full_)::BIGINT AS width,
  (SELECT round(avg(abs(z)) * 1e6, 4) FROM rough WHERE valid) AS sa_um,
  (SELECT round(sqrt(avg(z * z)) * 1e6, 4) FROM rough WHERE valid) AS sq_um,
  round(svr_um, 4) AS svr_raw_um, round(noise_um, 4) AS noise_floor_um,
  round(CASE WHEN noise_um > 0 THEN sqrt(greatest(0, svr_um * svr_um - noise_um * noise_um)) ELSE svr_um END, 4) AS svr_um,
  (SELECT round((max(u) - min(u)) * 1000, 4) FROM m) AS width_mm, (SELECT round((max(v) - min(v)) * 1000, 4) FROM m) AS height_mm
FROM total, noise)"""


ORACLE_SQL = {
    "plane_basis": f"""WITH {TILTED}{_eigen("t", "covar_samp")},
laid AS (SELECT patch, x, y, z, 1 - x * x AS px, -x * y AS py, -x * z AS pz FROM last),
one AS (SELECT patch, x AS cx, y AS cy, z AS cz, px / sqrt(px * px + py * py + pz * pz) AS ax, py / sqrt(px * px + py * py + pz * pz) AS ay,
  pz / sqrt(px * px + py * py + pz * pz) AS az FROM laid),
axes AS (SELECT *, cy * az - cz * ay AS bx, cz * ax - cx * az AS by_, cx * ay - cy * ax AS bz FROM one)
SELECT patch, n, {NINE} FROM axes JOIN cov USING (patch)""",
    "principal_axes": f"WITH {TILTED}{_eigen('t', 'covar_pop')}{AXES} SELECT patch, {NINE} FROM axes",
    "aligned_box": f"""WITH {TILTED}{_eigen("t", "covar_pop")}{AXES}{_turned("t")},
ends AS (SELECT patch, max(x * ax + y * ay + z * az) - min(x * ax + y * ay + z * az) AS w, max(x * bx + y * by_ + z * bz) - min(x * bx + y * by_ + z * bz) AS h
 FROM t JOIN turned USING (patch) GROUP BY patch)
SELECT patch, n, {NINE}, round(w, 6) AS width, round(h, 6) AS height FROM turned JOIN ends USING (patch) JOIN cov USING (patch)""",
    "engine": " UNION ALL ".join(_engine(f) for f in "ANR"),
}
