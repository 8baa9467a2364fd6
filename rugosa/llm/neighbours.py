"""Approximate nearest neighbours by largest inner product.

Vectors are brought to one sphere: a row x becomes (x / M, sqrt(1 - |x / M|^2)), M the largest norm,
and a query q becomes (q / |q|, 0). Their squared distance is 2 - 2 q.x / (|q| M), so the nearest has
the largest inner product. A few stable (Gaussian) projections take both to a space of low dimension,
in which a kd-tree deals all rows into leaves. There the squared projected distance of a pair over
its true one follows a chi-square law. So rows are verified in the order of their projected distance
until the chi-square test says that a row nearer than the k-th found would, with the wanted
confidence, have been met already.

A query first searches its own leaf. The k-th score found there bounds the projected distance up to
which the test can ask for rows; the leaves whose boxes lie within it are searched next, and in each
the test stops again with what is known by then. Leaves are dealt into blocks of rows and queries, and
each pair of blocks is a task's array program.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sent_if_small, stored

STRIP = 256


def chi_square_quantile(share: float, freedom: int) -> float:
    """x below which a chi-square variable of an even number of degrees of freedom lies with this chance."""
    if freedom % 2:
        raise ValueError("an even number of projections is needed")

    def chance(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while chance(high) < share:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chance(mid) < share else (low, mid)
    return high


class Projections:
    """m stable projections of vectors of any dimension, which grow from a seed."""

    def __init__(self, m: int, longest: float, seed: int) -> None:
        self.m, self.longest, self.seed = m, longest, seed
        self.held: dict[int, np.ndarray] = {}

    def matrix(self, d: int) -> np.ndarray:
        if d not in self.held:
            self.held[d] = np.random.default_rng((self.seed, d)).standard_normal((d + 1, self.m))
        return self.held[d]

    def rows(self, x: np.ndarray) -> np.ndarray:
        a, x = self.matrix(x.shape[1]), x / self.longest
        return x @ a[:-1] + np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None] * a[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return unit(q) @ self.matrix(q.shape[1])[:-1]


def unit(q: np.ndarray) -> np.ndarray:
    q = q / np.abs(q).max(axis=1, keepdims=True)
    return q / np.sqrt((q * q).sum(axis=1, keepdims=True))


class Tree:
    """A complete kd-tree: each node cuts the widest axis at its points' median."""

    def __init__(self, points: np.ndarray, leaves: int) -> None:
        self.leaves = leaves
        self.axis, self.at = np.zeros(leaves - 1, np.int64), np.zeros(leaves - 1)
        inside = {0: points}
        for node in range(leaves - 1):
            p = inside.pop(node)
            if len(p):
                self.axis[node] = axis = int(np.argmax(p.var(axis=0)))
                self.at[node] = np.median(p[:, axis])
            right = p[:, self.axis[node]] > self.at[node]
            inside[2 * node + 1], inside[2 * node + 2] = p[~right], p[right]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.leaves.bit_length() - 1):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - (self.leaves - 1)


#: A leaf's number is the vectors' dimension times this, and its place in the tree of that dimension.
LEAVES_A_DIMENSION = 1 << 20


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose rows are of one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(column: pa.Array):
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, _matrix(column.take(pa.array(at)))


def usable() -> Column:
    """Whether an embedding takes part: not null, not zero, all components finite numbers."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", good) & F.exists("embedding", lambda x: x != 0), F.lit(False))


def search(k: int, stop: float, longest: float):
    """The array program of two blocks: queries and rows -> (uid, query_id, vec_id, score) of a query's best k rows."""

    def exact(q: np.ndarray, x: np.ndarray) -> float:
        try:
            return math.fsum((q * x).tolist())  # right to the last bit for single precision, in any order
        except OverflowError:
            return float(q @ x)

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if queries.num_rows and rows.num_rows:
            q, qp = _matrix(queries.column("q")), _matrix(queries.column("qp"))
            q_uid, q_id = (queries.column(c).to_numpy() for c in ("uid", "query_id"))
            floor = queries.column("known").to_numpy(zero_copy_only=False).astype(float)
            x, every, uid = _matrix(rows.column("embedding")), rows.column("vec_id").to_numpy(), rows.column("uid").to_numpy()
            # equal rows are verified once; of these only the least k ids and the query's own can matter
            _, first, same = np.unique((x + 0.0).view(f"V{x.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
            order = np.lexsort((uid, every, same))
            begins = np.searchsorted(same[order], np.arange(len(first) + 1))
            x, yp = x[first], _matrix(rows.column("proj"))[first]
            whose = {int(u): i for u, i in zip(uid, same)}
            length = np.sqrt((q * q).sum(axis=1)) * longest
            n, squares = len(x), (yp * yp).sum(axis=1)
            for low in range(0, len(q), STRIP):
                s = slice(low, min(len(q), low + STRIP))
                far = np.maximum(0, (qp[s] * qp[s]).sum(axis=1)[:, None] + squares - 2 * (qp[s] @ yp.T))
                for i, u in enumerate(q_uid[s]):
                    own = whose.get(int(u))
                    if own is not None and begins[own + 1] - begins[own] == 1:
                        far[i, own] = np.inf  # no other row is there
                score, seen = np.full(far.shape, -np.inf), np.zeros(far.shape, bool)
                known, want = floor[s].copy(), 4 * k
                while True:
                    # the k-th distance found so far bounds how far the projected neighbours must be followed
                    limit = stop * np.maximum(0, 2 - 2 * known / length[s]) + 1e-12
                    reach = np.partition(far, want, axis=1)[:, want] if want < n else np.full(len(far), np.finfo(float).max)
                    ring = (far <= np.minimum(reach, limit)[:, None]) & ~seen
                    columns = np.flatnonzero(ring.any(axis=0))
                    if len(columns):
                        product = q[s] @ x[columns].T
                        score[:, columns] = np.where(ring[:, columns], product, score[:, columns])
                        seen |= ring
                        if n >= k:
                            known = np.maximum(known, np.partition(score, n - k, axis=1)[:, n - k])
                    if want >= n or (reach > stop * np.maximum(0, 2 - 2 * known / length[s])).all():
                        break
                    want *= 4
                for i in range(len(far)):
                    g = low + i
                    close = 1e-12 * length[g]
                    least = max(floor[g], np.partition(score[i], n - k)[n - k] if n >= k else -np.inf)
                    best = []
                    for j in np.flatnonzero(score[i] >= (least - close if np.isfinite(least) else -np.finfo(float).max)):
                        value, members = exact(q[g], x[j]), order[begins[j] : begins[j + 1]][: k + 1]
                        best += [(-value, int(every[m])) for m in members if uid[m] != q_uid[g]]
                    found += [(int(q_uid[g]), int(q_id[g]), v, -value) for value, v in sorted(best)[:k]]
        columns = list(zip(*found)) if found else [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["uid", "query_id", "vec_id", "score"])

    return run


def nearest(
    source: DataFrame, is_query: Column, k: int = 20, projections: int = 8, confidence: float = 0.95,
    leaf_rows: int = 2048, most_leaves: int = 4096, block_rows: int = 4096, sample: int = 65_536, seed: int = 13,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of (vec_id, embedding) with the largest inner product with each query.

    Queries are the rows that meet `is_query`, and every other row is a candidate, equal vectors too.
    Rows whose embedding is null, zero or holds null or non-finite components take no part, nor do
    null ids; vectors of another length than the query's are no candidates. Ties go to the smaller
    vec_id. Rows that repeat an id are rows of their own, as queries and as candidates. Of fewer than
    k candidates all are returned; an empty table gives an empty one. Other columns are ignored.

    `confidence` is the chance that a true neighbour is met before the search stops. The kd-tree is
    grown from about `sample` rows, has most_leaves leaves at most, and every row is dealt to one. What
    passes the driver is bounded by these: projections of the sample, and the leaves' boxes.
    """
    spark = source.sparkSession
    valid = source.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query")).where(usable())
    largest = F.array_max(F.transform("embedding", F.abs))
    scaled = F.transform("embedding", lambda c: F.pow(c / largest, F.lit(2.0)))
    norm = largest * F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda a, b: a + b))
    n, longest = valid.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    luck = F.shiftrightunsigned(F.xxhash64("vec_id", "embedding", F.lit(seed)), 11) / F.lit(float(1 << 53))
    to = Projections(projections, longest, seed)

    def project(parts):
        for part in parts:
            for _, _, x in _by_length(part.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(list(to.rows(x)), pa.list_(pa.float64())), pa.array(np.full(len(x), x.shape[1]))], ["proj", "d"])

    drawn = valid.where(luck < sample / n).select("embedding").mapInArrow(project, "proj array<double>, d long").limit(2 * sample).toPandas()
    trees = {}
    for d, some in drawn.groupby("d"):
        leaves = 1 << max(0, math.ceil(math.log2(max(1, n * len(some) / len(drawn) / leaf_rows))))
        trees[int(d)] = Tree(np.stack(some.proj.to_numpy()), min(most_leaves, leaves))
    root = Tree(np.zeros((0, projections)), 1)

    def deal(parts):
        for part in parts:
            for d, at, x in _by_length(part.column("embedding")):
                some, proj = part.take(pa.array(at)), to.rows(x)
                leaf = d * LEAVES_A_DIMENSION + trees.get(d, root).leaf(proj)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(leaf), pa.array(list(proj), pa.list_(pa.float64()))], [*some.schema.names, "leaf", "proj"])

    numbered = valid.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "is_query", "embedding")
    rows, _ = stored(numbered.mapInArrow(deal, "uid long, vec_id long, is_query boolean, embedding array<double>, leaf long, proj array<double>"))
    sides = [f(F.col("proj")[i]).alias(f"{name}{i}") for i in range(projections) for name, f in (("low", F.min), ("high", F.max))]
    boxes = rows.groupBy("leaf").agg(F.count("*").alias("n"), *sides).collect()  # most_leaves rows for each length of vectors
    numbers = np.array([b.leaf for b in boxes])
    low, high = (np.array([[b[f"{name}{i}"] for i in range(projections)] for b in boxes]) for name in ("low", "high"))
    stop = chi_square_quantile(confidence, projections)

    def ask(parts):
        """A query's own projection, and the leaf where it falls, or the nearest of its dimension that has rows."""
        for part in parts:
            for d, at, q in _by_length(part.column("q")):
                some, qp = part.take(pa.array(at)), to.queries(q)
                mine = np.flatnonzero(numbers // LEAVES_A_DIMENSION == d)
                home = [mine[np.argmin(gaps(p, mine))] for p in qp]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(list(qp), pa.list_(pa.float64())), pa.array(numbers[home])], [*some.schema.names, "qp", "home"])

    def gaps(p: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The squared distances of a projected point from the boxes of leaves."""
        off = np.maximum(0, np.maximum(low[which] - p, p - high[which]))
        return (off * off).sum(axis=1)

    def further(parts):
        """The other leaves of a query that the test can still ask for."""
        for part in parts:
            known = part.column("known").to_numpy(zero_copy_only=False).astype(float)
            home = part.column("home").to_numpy()
            leaves = []
            for q, p, s, h in zip(part.column("q"), part.column("qp"), known, home):
                q, p = np.array(q.as_py()), np.array(p.as_py())
                mine = np.flatnonzero((numbers // LEAVES_A_DIMENSION == len(q)) & (numbers != h))
                limit = stop * max(0.0, 2 - 2 * s / (np.sqrt(q @ q) * longest)) + 1e-12
                leaves.append(numbers[mine[gaps(p, mine) <= limit]])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaves, pa.list_(pa.int64()))], [*part.schema.names, "leaves"])

    asked = rows.where("is_query").select("uid", F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    kind = "uid long, query_id long, q array<double>, qp array<double>, home long"
    asked = cut(asked.mapInArrow(ask, kind))
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("n"))

    def visit(visits: DataFrame) -> DataFrame:
        visits = cut(visits)
        per = sizes.join(visits.groupBy("leaf").agg(F.count("*").alias("visitors")), "leaf")
        parts = lambda c: F.ceil(F.col(c) / block_rows).cast("int")
        per = sent_if_small(cut(per.select("leaf", parts("n").alias("blocks"), parts("visitors").alias("groups"))), 60)
        place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = visits.join(per, "leaf").withColumn("g", place("uid", "groups")).withColumn("b", all_of("blocks"))
        right = rows.join(per, "leaf").withColumn("b", place("uid", "blocks")).withColumn("g", all_of("groups"))
        left = left.select("leaf", "b", "g", "uid", "query_id", "q", "qp", "known").groupBy("leaf", "b", "g")
        right = right.select("leaf", "b", "g", "uid", "vec_id", "embedding", "proj").groupBy("leaf", "b", "g")
        return left.cogroup(right).applyInArrow(search(k, stop, longest), "uid long, query_id long, vec_id long, score double")

    best = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    none = F.lit(float("-inf"))
    first = cut(visit(asked.withColumnRenamed("home", "leaf").withColumn("known", none)))
    kth = first.withColumn("rank", best).where(F.col("rank") == k).select("uid", F.col("score").alias("known"))
    asked = asked.join(kth, "uid", "left").withColumn("known", F.coalesce("known", none))
    more = asked.mapInArrow(further, f"{kind}, known double, leaves array<long>").withColumn("leaf", F.explode("leaves")).drop("leaves", "home")
    every = first.unionByName(visit(more)).withColumn("rank", best).where(F.col("rank") <= k)
    return every.select("query_id", "rank", "vec_id", "score")


def op13_nearest_vectors(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, F.col("vec_id") % 20 == 0)
