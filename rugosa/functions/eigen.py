"""Eigenvectors of symmetric 3x3 matrices as column expressions.

A matrix is six columns (xx, xy, xz, yy, yz, zz), such as the covariances of a patch. Jacobi rotations
run over a state that is a struct: each step makes the entry between the first two axes zero and then
renames the axes in a circle, so that three steps are a sweep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Eight sweeps; a 3x3 matrix is diagonal to the last bit after five or so.
STEPS = 24
#: What counts as no component of a unit vector.
NONE = 1e-9

Vector = tuple[Column, Column, Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _step(m: Column) -> Column:
    a = {k: m[k] for k in ("a11", "a12", "a13", "a22", "a23", "a33")}

    def turned(t: Column) -> Column:
        c = 1 / F.sqrt(t * t + 1)
        s = t * c
        first = [c * m["v1"][i] - s * m["v2"][i] for i in range(3)]
        second = [s * m["v1"][i] + c * m["v2"][i] for i in range(3)]
        # the second axis becomes the first, the third the second, the first the third
        return F.struct(
            (a["a22"] + t * a["a12"]).alias("a11"),
            (s * a["a13"] + c * a["a23"]).alias("a12"),
            F.lit(0.0).alias("a13"),
            a["a33"].alias("a22"),
            (c * a["a13"] - s * a["a23"]).alias("a23"),
            (a["a11"] - t * a["a12"]).alias("a33"),
            F.array(*second).alias("v1"),
            m["v3"].alias("v2"),
            F.array(*first).alias("v3"),
        )

    theta = (a["a22"] - a["a11"]) / (2 * a["a12"])
    t = F.when(theta < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) / (F.abs(theta) + F.sqrt(theta * theta + 1))
    return let(F.when(a["a12"] == 0, F.lit(0.0)).otherwise(t), turned)


def eigen(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    """array of three structs (value, v) by falling value; v are orthonormal arrays of three, of any sign.

    A null entry gives null. Equal values keep the order of the axes that their vectors come from.
    """
    unit = [F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(3)]).alias(f"v{i + 1}") for i in range(3)]
    names = ("a11", "a12", "a13", "a22", "a23", "a33")
    start = F.struct(*[c.cast("double").alias(n) for n, c in zip(names, (xx, xy, xz, yy, yz, zz))], *unit)

    def sorted_(m: Column) -> Column:
        three = F.array(*[F.struct(m[f"a{i}{i}"].alias("value"), m[f"v{i}"].alias("v")) for i in (1, 2, 3)])
        falling = lambda p, q: F.when(p["value"] > q["value"], -1).when(p["value"] < q["value"], 1).otherwise(0)
        return F.array_sort(three, falling)

    whole = F.lit(True)
    for c in (xx, xy, xz, yy, yz, zz):
        whole = whole & c.isNotNull()
    return F.when(whole, F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda m, _: _step(m), sorted_))


def parts(v: Column) -> Vector:
    return v[0], v[1], v[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def pointing(v: Vector, order: tuple[int, int, int]) -> Vector:
    """v or -v, whichever has the first component of `order` above 0 that is not as good as none."""
    i, j, k = (v[n] for n in order)
    lead = F.when(F.abs(i) > NONE, i).when(F.abs(j) > NONE, j).otherwise(k)
    sign = F.when(lead < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return v[0] * sign, v[1] * sign, v[2] * sign


def axes(of: Column) -> list[Vector]:
    """Right-handed axes of an `eigen` column, by falling eigenvalue.

    An eigenvector has no sign of its own: the first axis points to +x (to +y or +z where it has no
    such part), the third up (to +y or +x where it lies flat), and the second completes them.
    """
    first = pointing(parts(of[0]["v"]), (0, 1, 2))
    third = pointing(parts(of[2]["v"]), (2, 1, 0))
    return [first, cross(third, first), third]


def plane_axes(of: Column) -> list[Vector]:
    """x axis, y axis and upward normal of the plane of an `eigen` column: the x axis is the global X laid into it.

    Where the plane stands across X, the global Y is laid into it instead.
    """
    n = pointing(parts(of[2]["v"]), (2, 1, 0))
    laid = []
    for g in range(2):
        v = [F.lit(1.0 if i == g else 0.0) - n[i] * n[g] for i in range(3)]
        laid.append((v, F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])))
    (x, sx), (y, sy) = laid
    first = tuple(F.when(sx >= 1e-6, x[i] / F.greatest(sx, F.lit(1e-6))).otherwise(y[i] / F.greatest(sy, F.lit(1e-6))) for i in range(3))
    return [first, cross(n, first), n]
