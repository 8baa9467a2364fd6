"""Nearest neighbours of points by tiles: (patch, pid, x, y, z) rows.

Points are dealt to square tiles of several radii, those near a border to both sides. A tile's probes are
answered in its task by array operations, and what leaves it is one row a probe: no pair is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import counted_cut, cut, finite, with_patches

#: A tile's side in radii; tiles of more rows are joined by cubes instead, which can spill.
SIDE, TILE_ROWS = 16, 200_000
#: Pairs of a probe and a candidate that are looked at together.
PAIRS = 1_000_000
#: Cubes and halos are so much wider than the radius, for rounding.
WIDER = 1.001
TILE = ["patch", "tx", "ty", "tz"]

#: The 27 cubes around a point's own.
CUBES = "transform(sequence(0, 26), i -> struct(bx + i % 3 - 1 as bx, by + (i div 3) % 3 - 1 as by, bz + i div 9 - 1 as bz))"


def _celled(points: DataFrame, size) -> DataFrame:
    return points.withColumn("size", size).selectExpr("*", *[f"floor({c} / size) as b{c}" for c in "xyz"])


def pairs_within(probe: DataFrame, build: DataFrame, radius, keep: tuple = ()) -> DataFrame:
    """(patch, pid, other, d2, ox, oy, oz): probe points with the build points within the radius, themselves included.

    radius: a number, or the name of a column that both sides have and that is one for each patch.
    Both sides are dealt into cubes of the radius; a probe looks into the 27 cubes around its own.
    `keep`: further columns of the probe.
    """
    size = F.col(radius) if isinstance(radius, str) else F.lit(float(radius))
    a = _celled(probe, size).selectExpr("patch", "pid", "x as px", "y as py", "z as pz", "size * size as r2", *keep, f"inline({CUBES})")
    b = _celled(build, size).selectExpr("patch", "pid as other", "x as ox", "y as oy", "z as oz", "bx", "by", "bz")
    d2 = "(px - ox) * (px - ox) + (py - oy) * (py - oy) + (pz - oz) * (pz - oz)"
    # a stored table counts as large as the files it once came from: never broadcast by that estimate
    return a.join(b.hint("merge"), ["patch", "bx", "by", "bz"]).withColumn("d2", F.expr(d2)).where("d2 <= r2").select("patch", "pid", "other", "d2", "ox", "oy", "oz", *keep)


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in names]


def _within(p: np.ndarray, b: np.ndarray, r: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, i, j, d2) for runs of rows of p: rows' i-th (rising) lies within r of b's j-th, at a squared distance d2."""
    low = b.min(axis=0)
    cube = ((b - low) / (r * WIDER)).astype(np.int64)
    at = np.floor((p - low) / (r * WIDER)).astype(np.int64)
    # cubes are numbered with one empty cube around them, so that the three along z are neighbours
    most = cube.max(axis=0)
    at = np.clip(at, -1, most + 1)
    span = most + 3
    number = lambda c: ((c[:, 0] + 1) * span[1] + c[:, 1] + 1) * span[2] + c[:, 2] + 1
    key = number(cube)
    order = np.argsort(key, kind="stable")
    key, own = key[order], number(at)
    ahead = np.array([(dx * span[1] + dy) * span[2] for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    begin = np.searchsorted(key, own[:, None] + ahead - 1)
    size = np.searchsorted(key, own[:, None] + ahead + 1, "right") - begin
    upto = np.cumsum(size.sum(axis=1))
    first = 0
    while first < len(p):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, "right")))
        n, s = size[first:last].ravel(), begin[first:last].ravel()
        j = order[np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())]
        i = np.repeat(np.arange(last - first), n.reshape(-1, 9).sum(axis=1))
        dx, dy, dz = (p[first + i, k] - b[j, k] for k in range(3))
        d2 = dx * dx + dy * dy + dz * dz
        ok = d2 <= r * r
        yield slice(first, last), i[ok], j[ok], d2[ok]
        first = last


def _nearest_rows(m: int, i: np.ndarray, other: np.ndarray, d2: np.ndarray, k: int) -> np.ndarray:
    """The pairs that are among the k nearest of their i (rising, below m); ties by the other's pid."""
    n = np.bincount(i, minlength=m)
    place = np.arange(len(i)) - (np.cumsum(n) - n)[i]
    width = max(k, int(n.max(initial=0)))
    if m * width > 8 * (len(i) + m * k):  # one row has far more than others
        order = np.lexsort((other, d2, i))
        ok = np.zeros(len(i), bool)
        ok[order[place < k]] = True
        return np.flatnonzero(ok)
    table = np.full((m, width), np.inf)
    table[i, place] = d2
    last = np.partition(table, k - 1, axis=1)[:, k - 1]
    ok, tied = d2 < last[i], np.flatnonzero(d2 == last[i])
    left = k - np.bincount(i[ok], minlength=m)
    tied = tied[np.lexsort((other[tied], i[tied]))]
    t = i[tied]
    n = np.bincount(t, minlength=m)
    ok[tied[np.arange(len(t)) - (np.cumsum(n) - n)[t] < left[t]]] = True
    return np.flatnonzero(ok)


def _tiled(probe: DataFrame, build: DataFrame, radius: str, side: str, same: bool = False) -> DataFrame:
    """Rows of tiles: build points (has) in each tile within the radius, probes (ask) in their own.

    If `same`, the probes are the build points. Columns of the probe pass; the build has them too.
    """
    own = lambda c: F.floor(F.col(c) / F.col(side))
    rows, columns = build.where(finite("x", "y", "z")), build.columns
    for c in "xyz":
        ends = (F.floor((F.col(c) + sign * WIDER * F.col(radius)) / F.col(side)) for sign in (-1, 1))
        rows = rows.select("*", F.explode(F.sequence(*ends)).alias(f"t{c}"))
    at_home = (F.col("tx") == own("x")) & (F.col("ty") == own("y")) & (F.col("tz") == own("z"))
    rows = rows.select(*columns, *TILE[1:], F.lit(True).alias("has"), (at_home if same else F.lit(False)).alias("ask"))
    if same:
        return rows
    asked = probe.select(*columns, *[own(c).alias(f"t{c}") for c in "xyz"], F.lit(False).alias("has"), F.lit(True).alias("ask"))
    # only tiles in which someone asks
    return rows.join(asked.select(*TILE).distinct().hint("merge"), TILE, "left_semi").select(*asked.columns).unionByName(asked)


def _answered(rows: DataFrame, answer: Callable, schema: str) -> tuple[DataFrame, DataFrame | None]:
    """(the answers of tiles of up to TILE_ROWS rows, the rows of larger ones or None).

    `answer(table of probes, table of build points)` gives the columns of the schema after those of the probes.
    """
    names = [part.split() for part in schema.split(", ")]

    def run(tile: pa.Table) -> pa.Table:
        p, b = tile.filter(tile.column("ask")), tile.filter(tile.column("has"))
        got = answer(p, b) if p.num_rows else {c: pa.array([], kind.replace("long", "int64")) for c, kind in names if c not in p.column_names}
        return pa.table({c: got[c] if c in got else p.column(c) for c, _ in names})

    large, n = counted_cut(rows.groupBy(*TILE).agg(F.count("*").alias("rows")).where(F.col("rows") > TILE_ROWS).select(*TILE))
    if not n:
        return rows.groupBy(*TILE).applyInArrow(run, schema), None
    # as many as TILE_ROWS goes into the table
    small = rows.join(F.broadcast(large), TILE, "left_anti")
    return small.groupBy(*TILE).applyInArrow(run, schema), cut(rows.join(F.broadcast(large), TILE, "left_semi"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each probe; ties by the other's pid."""
    rank = F.row_number().over(Window.partitionBy("patch", "pid").orderBy("d2", "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


MOMENTS = ["xx", "xy", "xz", "yy", "yz", "zz"]
AT = ["patch", "pid", "x", "y", "z", "first", "last"]


def nearest_sums(probe: DataFrame, build: DataFrame, k: int, most: float | None = None, rounds: int = 40) -> DataFrame:
    """(patch, pid, n, far, cxx ... czz): of each probe's k nearest points of `build`, itself included, the number, the sum of
    the distances and the covariances of the coordinates (divided by n).

    Probes look within a radius that holds about twice k points of their own patch, taken as a
    surface; those that find fewer than k look three times as far, up to `most` (a radius; all that lie
    within it are counted then) or until the whole patch is in reach. Ties go by the other's pid. A probe
    that finds nothing gets no row.
    """
    spans = [(F.max(c) - F.min(c)).alias(f"s{c}") for c in "xyz"]
    box = build.groupBy("patch").agg(F.count("*").alias("n"), *spans)
    sides = F.array_sort(F.array("sx", "sy", "sz"))
    area = F.greatest(F.lit(1e-12), F.element_at(sides, 3) * F.greatest(F.element_at(sides, 2), F.element_at(sides, 3) * 1e-3))
    reach = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz")) + 1e-9
    last = reach if most is None else F.least(reach, F.lit(float(most)))
    box = box.select("patch", last.alias("last"), F.least(last, F.sqrt(area / F.col("n") * (2 * k / math.pi))).alias("first"))
    every = cut(with_patches(build, box).select(*AT))
    todo = every if probe is build else cut(with_patches(probe, box).select(*AT))
    kinds = dict(todo.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in AT], "n long, far double", *[f"c{m} double" for m in MOMENTS]])

    def sums(turn: int) -> Callable:
        def answer(p: pa.Table, b: pa.Table) -> dict:
            first, last = p.column("first")[0].as_py(), p.column("last")[0].as_py()
            r, m = _radius(first, last, turn), p.num_rows
            out = {"n": np.zeros(m, np.int64), "far": np.zeros(m), **{f"c{x}": np.zeros(m) for x in MOMENTS}}
            if not b.num_rows:
                return {c: pa.array(x) for c, x in out.items()}
            at, others = np.stack(_columns(p, *"xyz"), axis=1), np.stack(_columns(b, *"xyz"), axis=1)
            pid = b.column("pid").to_numpy()
            for rows, i, j, d2 in _within(at, others, r):
                size = rows.stop - rows.start
                ok = _nearest_rows(size, i, pid[j], d2, k)
                i, j, d2 = i[ok], j[ok], d2[ok]
                n = np.bincount(i, minlength=size)
                by, away = np.maximum(n, 1), others[j] - at[rows][i]  # from the probe, so that no digits go
                away -= np.stack([np.bincount(i, away[:, c], size) / by for c in range(3)], axis=1)[i]
                out["n"][rows], out["far"][rows] = n, np.bincount(i, np.sqrt(d2), size)
                for x in MOMENTS:
                    u, v = ("xyz".index(c) for c in x)
                    out[f"c{x}"][rows] = np.bincount(i, away[:, u] * away[:, v], size) / by
            return {c: pa.array(x) for c, x in out.items()}

        return answer

    done = None
    for turn in range(rounds):
        r = _radius(F.col("first"), F.col("last"), turn)
        sized = lambda d, r=r: d.withColumn("r", r).withColumn("side", F.greatest(SIDE * F.col("first"), 2 * F.col("r")))
        found, rest = _answered(_tiled(sized(todo), sized(every), "r", "side", todo is every), sums(turn), schema)
        if rest is not None:
            asked = rest.where("ask").select(*AT, "r")
            near = nearest(pairs_within(asked, rest.where("has").select(*AT, "r").dropDuplicates(["patch", "pid"]), "r"), k).withColumnsRenamed({"patch": "patch_", "pid": "pid_"})
            cov = [F.covar_pop(f"o{a}", f"o{b}").alias(f"c{a}{b}") for a, b in MOMENTS]
            near = near.groupBy("patch_", "pid_").agg(F.count("*").alias("n"), F.sum(F.sqrt("d2")).alias("far"), *cov)
            figures = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "far", *[f"c{m}" for m in MOMENTS])]
            near = asked.join(near.hint("merge"), (F.col("patch") == F.col("patch_")) & (F.col("pid") == F.col("pid_")), "left")
            found = found.unionByName(near.select(*AT, *figures))
        found = cut(found)
        more = (F.col("n") < k) & (r < F.col("last"))
        got = found.where(~more & (F.col("n") > 0)).drop(*AT[2:])
        done = got if done is None else done.unionByName(got)
        todo = found.where(more).select(*AT)
        if not todo.limit(1).count():
            break
    return done


def _radius(first, last, turn: int):
    """The radius of a round, of numbers or columns: `last` as soon as it is within half as much again."""
    r = first * 3.0**turn
    if isinstance(r, float):
        return last if 1.5 * r >= last else r
    return F.when(1.5 * r >= last, last).otherwise(r)


def near(probe: DataFrame, build: DataFrame, radius: float) -> DataFrame:
    """(patch, pid) of the probe points that have a point of `build` within the radius."""
    at = ["patch", "pid", "x", "y", "z", "r", "side"]
    sized = lambda d: d.withColumn("r", F.lit(float(radius))).withColumn("side", F.lit(float(SIDE * radius))).select(*at)
    p, b = sized(probe), sized(build)
    kinds = dict(p.dtypes)

    def answer(p: pa.Table, b: pa.Table) -> dict:
        n = np.zeros(p.num_rows, np.int64)
        if b.num_rows:
            for rows, i, _, _ in _within(np.stack(_columns(p, *"xyz"), axis=1), np.stack(_columns(b, *"xyz"), axis=1), radius):
                n[rows] = np.bincount(i, minlength=rows.stop - rows.start)
        return {"n": pa.array(n)}

    found, rest = _answered(_tiled(p, b, "r", "side"), answer, f"patch {kinds['patch']}, pid {kinds['pid']}, n long")
    found = found.where("n > 0").select("patch", "pid")
    if rest is not None:
        pairs = pairs_within(rest.where("ask"), rest.where("has"), "r")
        found = found.unionByName(pairs.select("patch", "pid").distinct())
    return found


def knn_mean_distance(points: DataFrame, k: int = 6) -> DataFrame:
    """(patch, pid, mean): the mean distance to the k nearest other points, however far.

    Points of a patch with at most k points get no row.
    """
    return nearest_sums(points, points, k + 1).where(F.col("n") == k + 1).select("patch", "pid", (F.col("far") / k).alias("mean"))


def outliers(means: DataFrame, times: float = 3.0) -> DataFrame:
    """(patch, pid) whose mean distance is above the mean plus so many population deviations."""
    limit = means.groupBy("patch").agg((F.avg("mean") + times * F.stddev_pop("mean")).alias("limit"))
    return with_patches(means, limit).where("mean > limit").select("patch", "pid")


def least_eigenvalue_share(xx, xy, xz, yy, yz, zz):
    """Of columns of a symmetric 3x3 matrix: the least eigenvalue over the trace, by the trigonometric formula."""
    q = (xx + yy + zz) / 3
    p1 = xy * xy + xz * xz + yz * yz
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * p1
    p = F.sqrt(p2 / 6)
    a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
    d, e, f = xy / p, xz / p, yz / p
    r = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    phi = F.acos(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))) / 3
    low = q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return F.when(q <= 0, F.lit(0.0)).when(p <= 0, F.lit(1 / 3)).otherwise(F.greatest(low, F.lit(0.0)) / (3 * q))


def curvature(probe: DataFrame, points: DataFrame, radius: float = 4.5, k: int = 30) -> DataFrame:
    """(patch, pid, n, sigma): the least share of variance among the k nearest points within the radius."""
    sums = nearest_sums(probe, points, k, radius)
    return sums.select("patch", "pid", "n", least_eigenvalue_share(*[F.col(f"c{m}") for m in MOMENTS]).alias("sigma"))
