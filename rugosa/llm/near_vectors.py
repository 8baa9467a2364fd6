"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are normalised, and each table concatenates k quantised projections floor((a . v + b) / w)
with a ~ N(0, 1), b ~ U(0, w). Near vectors share a bucket of some table; pairs that meet are
checked by their exact cosine in double precision. k follows the logarithm of the number of
vectors, so that buckets of unrelated vectors stay small, and the number of tables follows k and
the target recall at the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import components, cut, mix64


def meeting_chance(distance: float, width: float) -> float:
    """The chance that one quantised projection agrees for vectors at this distance."""
    t = width / distance
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def hash_plan(n: int, threshold: float, recall: float, width: float) -> tuple[int, int]:
    """(projections a table, tables) for n vectors."""
    near, far = meeting_chance(math.sqrt(2 - 2 * threshold), width), meeting_chance(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(2, n)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


class Projections:
    def __init__(self, k: int, tables: int, width: float, seed: int) -> None:
        self.k, self.tables, self.width, self.seed = k, tables, width, seed
        self.held: dict[int, tuple] = {}

    def keys(self, v: np.ndarray) -> np.ndarray:
        """Bucket keys of normalised vectors of one dimension."""
        d = v.shape[1]
        if d not in self.held:
            rng = np.random.default_rng((self.seed, d))
            self.held[d] = rng.standard_normal((d, self.k * self.tables)), rng.random(self.k * self.tables) * self.width
        a, b = self.held[d]
        q = np.floor((v @ a + b) / self.width).astype(np.int64).astype(np.uint64).reshape(len(v), self.tables, self.k)
        h = np.full((len(v), self.tables), d, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.k):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + q[:, :, i])
        return blocks.bucket_keys(h)


def usable(vectors: list) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None where a vector is null, zero, or holds null or non-finite parts."""
    out = []
    for v in vectors:
        x = None if v is None else np.array(v, np.float64)
        if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
            out.append(None)
        else:
            x = x / np.abs(x).max()
            out.append(x / np.linalg.norm(x))
    return out


def digest(v: np.ndarray) -> tuple[int, int]:
    """128 bits of a vector, as two signed longs; 0.0 and -0.0 are one number."""
    return tuple(np.frombuffer(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest(), np.int64).tolist())


def near_vectors(rows: DataFrame, threshold: float = 0.95, recall: float = 0.999, width: float = 2.0, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding).

    Vectors of different lengths never link, nor do null or zero vectors or those with null or
    non-finite parts. Equal vectors always link; they are one class whose size counts in n_links.
    component_id is the least vec_id that links reach; kept marks it. Rows that repeat an id count
    as rows. Null ids form rows of their own with component_id null and kept false. An empty table
    gives an empty one. Labels and other columns are ignored.
    """
    source = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    k, tables = hash_plan(source.count(), threshold, recall, width)

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Projections(k, tables, width, seed)
        for part in parts:
            for i in range(0, part.num_rows, 512):
                some = part.slice(i, 512)
                vectors = usable(some.column(1).to_pylist())
                c1, c2, keys = [None] * len(vectors), [None] * len(vectors), [None] * len(vectors)
                for d in {len(v) for v in vectors if v is not None}:
                    at = [j for j, v in enumerate(vectors) if v is not None and len(v) == d]
                    got = p.keys(np.stack([vectors[j] for j in at])).tolist()
                    for j, key in zip(at, got):
                        keys[j] = key
                        c1[j], c2[j] = digest(vectors[j])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["vec_id", "c1", "c2", "keys"])

    signed = cut(source.mapInArrow(sign, "vec_id long, c1 long, c2 long, keys array<long>"))
    valid = signed.where("c1 is not null and vec_id is not null")
    classes = cut(valid.groupBy("c1", "c2").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("size")))
    # numbers, not hashes, stand for classes: they can't collide
    reps = valid.join(classes, ["c1", "c2"]).where("vec_id = class_id").dropDuplicates(["c1", "c2"])
    reps = cut(reps.select("c1", "c2", "class_id", "size", "keys").withColumn("id", F.monotonically_increasing_id()))
    dealt = cut(blocks.tasks(reps.select("id", F.lit(1).alias("weight"), F.explode("keys").alias("bucket")), 1024, 1 << 40))
    kept = reps.join(dealt.select("id").distinct(), "id").withColumnRenamed("class_id", "vec_id")

    def units(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            vectors = usable(part.column("embedding").to_pylist())
            ours = list(zip(part.column("c1").to_pylist(), part.column("c2").to_pylist()))
            own = [v is not None and digest(v) == tuple(c) for v, c in zip(vectors, ours)]
            unit = pa.array([v.tolist() if o else None for v, o in zip(vectors, own)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], unit], ["id", "size", "keys", "unit"])

    payload = kept.join(source, "vec_id").select("id", "size", "keys", "c1", "c2", "embedding").mapInArrow(units, "id long, size long, keys array<long>, unit array<double>")
    # of rows that repeat an id, only one with the class's own vector
    payload = payload.where("unit is not null").dropDuplicates(["id"]).select("id", F.col("id").alias("member"), "size", "keys", "unit")

    def link(values: list, some: slice) -> np.ndarray:
        lengths = np.array([len(v) for v in values])
        out = np.zeros((some.stop - some.start, len(values)), bool)
        for d in set(lengths[some].tolist()):  # a bucket's hash holds the dimension: one, but for a chance collision
            at, rows = np.flatnonzero(lengths == d), np.flatnonzero(lengths[some] == d)
            v = np.array([values[i] for i in at], np.float64)
            r = np.array([values[some.start + i] for i in rows], np.float64)
            out[np.ix_(rows, at)] = r @ v.T >= threshold - 1e-12
            # close calls are decided by a sum that doesn't depend on the order of the two
            for i, j in zip(*np.nonzero(np.abs(r @ v.T - threshold) < 1e-12)):
                out[rows[i], at[j]] = math.fsum(r[i] * v[j]) >= threshold
        return out

    found = blocks.compare(dealt, payload, "unit array<double>", link, blocks.lists)
    links, edges = blocks.summed(found)
    comps = components(edges)
    top = reps.select("id", "c1", "c2", "class_id")
    least = comps.join(top, comps.node == top.id).groupBy("component").agg(F.min("class_id").alias("component_id"))
    nodes = comps.join(least, "component").select(F.col("node").alias("id"), "component_id")
    figures = links.join(nodes, "id", "full").join(top, "id").select("c1", "c2", "links", "component_id")
    table = classes.join(figures, ["c1", "c2"], "left")
    table = table.select("c1", "c2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    out = signed.select("vec_id", "c1", "c2").join(table, ["c1", "c2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
