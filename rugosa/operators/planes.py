"""Plane models: scoring, nearest-plane assignment, order of faces."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance(plane: tuple) -> Column:
    """|n . p + d| of a plane (model, nx, ny, nz, d) with a unit normal."""
    _, a, b, c, o = plane
    return F.abs(F.col("x") * a + F.col("y") * b + F.col("z") * c + o)


def score(points: DataFrame, planes: list[tuple], within: float) -> DataFrame:
    """(model, inliers): how many points lie nearer than `within`; one pass, whatever the number of planes.

    Each partition counts its points for all planes by one matrix product a batch.
    """
    models = np.array([p[0] for p in planes], np.int32)
    normal, offset = np.array([p[1:4] for p in planes], float).T, np.array([p[4] for p in planes], float)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(models), np.int64)
        for part in parts:
            total += (np.abs(part[["x", "y", "z"]].to_numpy() @ normal + offset) < within).sum(axis=0)
        yield pd.DataFrame({"model": models, "inliers": total})

    found = points.select("x", "y", "z").mapInPandas(run, "model int, inliers long")
    return found.groupBy("model").agg(F.sum("inliers").alias("inliers"))


def assign(points: DataFrame, planes: list[tuple]) -> DataFrame:
    """points with the nearest plane's model and distance; of equal distances the lowest model."""
    nearest = F.array_min(F.array(*[F.struct(distance(p).alias("distance"), F.lit(p[0]).alias("model")) for p in planes]))
    return points.withColumn("near_", nearest).select(*points.columns, F.col("near_.model").alias("model"), F.col("near_.distance").alias("distance"))


def adjacent(planes: list[tuple], parallel_deg: float) -> list[tuple]:
    """(model, planes that aren't nearly parallel to it) of (model, nx, ny, nz, d)."""
    least = math.cos(math.radians(parallel_deg))
    dot = lambda p, q: abs(sum(a * b for a, b in zip(p[1:4], q[1:4])))
    return [(p[0], [q for q in planes if q[0] != p[0] and dot(p, q) < least]) for p in planes]


def beyond(points: DataFrame, planes: list[tuple], margin: float, parallel_deg: float = 10.0) -> DataFrame:
    """points (patch: the model of their plane) that lie in front of another face's plane, or less than `margin` behind it.

    Adds `by`, the lowest model of such a plane. Planes nearly parallel to the point's own aren't asked.
    The planes are a table of a row a face, which holds the adjacent ones as an array.
    """
    kind = f"patch {dict(points.dtypes)['patch']}, planes array<struct<model:int,nx:double,ny:double,nz:double,d:double>>"
    table = points.sparkSession.createDataFrame(adjacent(planes, parallel_deg), kind)
    ahead = lambda p: F.col("x") * p["nx"] + F.col("y") * p["ny"] + F.col("z") * p["nz"] + p["d"] > -margin
    d = points.join(F.broadcast(table), "patch")  # as many rows as an object has faces
    d = d.withColumn("by", F.array_min(F.transform(F.filter("planes", ahead), lambda p: p["model"])))
    return d.where("by is not null").select(*points.columns, "by")


def ordered(faces: DataFrame) -> DataFrame:
    """faces (face, nx, ny, nz, area) with patch_id from 1: main axis Z, X, Y, then plus before minus, then by area down.

    Faces of one object are few, and pass through one task.
    """
    x, y, z = (F.abs(F.col(f"n{c}")) for c in "xyz")
    axis = F.when((z >= x) & (z >= y), 0).when(x >= y, 1).otherwise(2)
    main = F.when(axis == 0, F.col("nz")).when(axis == 1, F.col("nx")).otherwise(F.col("ny"))
    return faces.withColumn("patch_id", F.row_number().over(Window.orderBy(axis, F.when(main >= 0, 0).otherwise(1), F.desc("area"), "face")))
