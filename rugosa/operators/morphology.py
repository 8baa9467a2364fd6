"""Shapes of marked cells: components, erosion, closing, holes, nearness."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cut
from ..functions.unionfind import components as linked
from .grid import CROSS, TILE, shifted, tiled

EIGHT = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
SIX = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def erode(marked: DataFrame, rounds: int = 2) -> DataFrame:
    """Marked cells (patch, iy, ix) that stay after so many erosions by a cross; outside counts as unmarked."""
    ones = marked.withColumn("on", F.lit(True))

    def program(a: dict, inside: np.ndarray, core: np.ndarray) -> dict:
        on = a["on"] & inside
        for _ in range(rounds):
            on = on & np.logical_and.reduce([shifted(on, *o, False) for o in CROSS])
        return {"on": on}

    return tiled(ones, rounds, program, f"patch {dict(marked.dtypes)['patch']}, iy int, ix int, on boolean", columns=("on",)).where("on").select("patch", "iy", "ix")


def _local_labels(at: np.ndarray, offsets: tuple) -> np.ndarray:
    """For rows of integer coordinates: the index of the first row (in row-major order) that each one reaches."""
    low = at.min(axis=0) - 1
    span = at.max(axis=0) - low + 2
    step = np.concatenate((np.cumprod(span[:0:-1])[::-1], [1]))
    number = (at - low) @ step
    order = np.argsort(number)
    number = number[order]
    pairs = []
    for o in offsets:
        to = np.searchsorted(number, number + np.array(o) @ step)
        found = (to < len(number)) & (number[np.minimum(to, len(number) - 1)] == number + np.array(o) @ step)
        pairs.append((np.flatnonzero(found), to[found]))
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    label = np.arange(len(number))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, label, new)  # a root learns what its members have met
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(len(at), np.int64)
    out[order] = order[label]
    return out


def components(cells: DataFrame, keys: tuple, offsets: tuple, rounds: int = 60, tile: int = TILE) -> DataFrame:
    """cells with `label`: the first cell (by patch, then keys) that neighbours reach.

    Cells are labelled within tiles first; a cell of a tile's border is in its neighbour's halo as
    well, and the two labels that it gets there are joined by a distributed union-find over labels.
    """
    types = dict(cells.dtypes)
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / tile).cast("int"), F.floor((F.col(c) + 1) / tile).cast("int")))
    d = cells.select("patch", *keys).distinct()
    for k in keys:
        d = d.withColumn(f"t_{k}", reach(k))
    names = ["patch", *keys, *[f"l_{k}" for k in keys], "core"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[list(keys)].to_numpy()
        core = ((at // tile) == np.array(key[1:])).all(axis=1)
        if not core.any():
            return pd.DataFrame(columns=names)
        first = at[_local_labels(at, offsets)]
        return pd.DataFrame({"patch": key[0]} | {k: at[:, i] for i, k in enumerate(keys)} | {f"l_{k}": first[:, i] for i, k in enumerate(keys)} | {"core": core})

    schema = f"patch {types['patch']}, " + ", ".join(f"{p}{k} int" for p in ("", "l_") for k in keys) + ", core boolean"
    local = d.groupBy("patch", *[f"t_{k}" for k in keys]).applyInPandas(run, schema)
    label = F.struct("patch", *[F.col(f"l_{k}").alias(k) for k in keys]).alias("label")
    local = cut(local.select("patch", *[F.col(k).cast(types[k]).alias(k) for k in keys], label, "core"))
    own = local.where("core").drop("core")
    ties = own.select("patch", *keys, F.col("label").alias("a")).join(local.where("not core").select("patch", *keys, F.col("label").alias("b")), ["patch", *keys]).where("a <> b").select("a", "b").distinct()
    ties = cut(ties)
    if not ties.limit(1).count():
        return own
    now = linked(ties, rounds=rounds)
    joined = own.join(now, F.col("label") == F.col("node"), "left")
    return joined.select("patch", *keys, F.coalesce("component", "label").alias("label"))


def distances(marked: DataFrame, most: float) -> DataFrame:
    """(patch, iy, ix, d2): marked cells and the square of their distance, in cells, to the nearest that isn't.

    Cells that are further from one than `most` are left out. Exact and separable: the nearest in a cell's
    own row first, then the least of (distance in that row)^2 + dy^2 over the rows in reach, so the
    work of a cell grows with the radius and not with its disc. A tile's halo is the radius.
    """
    r = int(np.floor(most + 1e-9))
    ones = marked.withColumn("on", F.lit(True))

    def program(a: dict, inside: np.ndarray, core: np.ndarray) -> dict:
        off = ~np.pad(a["on"] & inside, r + 1)
        far = 4 * (r + 1) ** 2
        row = np.where(off, 0, far)
        for k in range(1, r + 1):
            beside = shifted(off, 0, k, True) | shifted(off, 0, -k, True)
            row = np.where(beside & (row == far), k * k, row)
        best = row
        for k in range(1, r + 1):
            best = np.minimum(best, np.minimum(shifted(row, k, 0, 0), shifted(row, -k, 0, 0)) + k * k)
        return {"d2": best[r + 1 : -r - 1, r + 1 : -r - 1].astype(np.int64)}

    found = tiled(ones, r + 1, program, f"patch {dict(marked.dtypes)['patch']}, iy int, ix int, d2 long", columns=("on",))
    return found.where((F.col("d2") > 0) & (F.sqrt(F.col("d2").cast("double")) <= most + 1e-9))


def near_background(marked: DataFrame, radius_cells: float) -> DataFrame:
    """Marked cells (patch, iy, ix) within a distance of so many cells of one that isn't."""
    return distances(marked, radius_cells).drop("d2")


def close_gaps(marked: DataFrame) -> DataFrame:
    """Marked cells closed by a 3x3 square; cells outside the marked ones' bounding box plus one stay unmarked."""
    grown = marked.select("patch", F.explode(F.array(*[F.struct((F.col("iy") + dy).alias("iy"), (F.col("ix") + dx).alias("ix")) for dy, dx in ((0, 0), *EIGHT)])).alias("c")).select("patch", "c.iy", "c.ix").distinct()
    ones = grown.withColumn("on", F.lit(True))

    def program(a: dict, inside: np.ndarray, core: np.ndarray) -> dict:
        on = a["on"] & inside
        return {"on": on & np.logical_and.reduce([shifted(on, *o, False) for o in EIGHT])}

    eroded = tiled(ones, 1, program, f"patch {dict(marked.dtypes)['patch']}, iy int, ix int, on boolean", columns=("on",)).where("on").select("patch", "iy", "ix")
    return eroded.unionByName(marked.select("patch", F.col("iy").cast("int"), F.col("ix").cast("int"))).distinct()


def fill_enclosed(marked: DataFrame) -> DataFrame:
    """Marked cells and the unmarked ones that no path of side steps joins to the outside."""
    box = marked.groupBy("patch").agg(F.min("iy").alias("a"), F.max("iy").alias("b"), F.min("ix").alias("c"), F.max("ix").alias("d"))
    every = box.select("*", F.explode(F.expr("sequence(a - 1, b + 1)")).alias("iy")).repartition("patch", "iy").select("*", F.explode(F.expr("sequence(c - 1, d + 1)")).alias("ix")).select("patch", F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix"), ((F.col("iy") == F.col("a") - 1) | (F.col("iy") == F.col("b") + 1) | (F.col("ix") == F.col("c") - 1) | (F.col("ix") == F.col("d") + 1)).alias("rim"))
    empty = cut(every.join(marked, ["patch", "iy", "ix"], "left_anti"))
    labels = components(empty.select("patch", "iy", "ix"), ("iy", "ix"), CROSS)
    outer = labels.join(empty.where("rim"), ["patch", "iy", "ix"]).select("label").distinct()
    holes = labels.join(outer, "label", "left_anti").select("patch", "iy", "ix")
    return holes.unionByName(marked.select("patch", F.col("iy").cast("int"), F.col("ix").cast("int")))
