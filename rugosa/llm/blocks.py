"""Comparing the members of hash buckets in blocks, for similarity joins by banded hashing.

A bucket's members are dealt into blocks, and each pair of blocks is compared in one task by array
operations. No pair of rows is ever a row: what comes out is each member's number of links and a
spanning forest of the links. A pair that meets in several tables counts in the first of them only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: A bucket's key: the table's number above, the low 48 bits of its hash below.
TABLE_BITS = 48


def bucket_keys(hashes: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    """(rows, tables) hashes -> bucket keys as signed longs, of `bits` bits of the hashes."""
    tables = np.arange(hashes.shape[1], dtype=np.uint64) << np.uint64(TABLE_BITS)
    return ((hashes & np.uint64((1 << bits) - 1)) | tables).astype(np.int64)


def tasks(rows: DataFrame, block_rows: int, block_weight: int, weight: Column | None = None, scale: Column | None = None, apart: int = 0) -> DataFrame:
    """rows (id, bucket, and weight, unless `weight` is one of their columns) -> rows with blocks and own.

    Buckets of one member go, and of buckets with the very same members the first table's stays. If a
    `scale` of the rows is given, members go that have no other of their bucket within `apart` of it.
    A bucket has so many blocks, and own is the member's: each pair of them is compared in one task. A
    block has about block_rows members or block_weight of their weights.
    """
    n, columns = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.columns
    # looked through and joined on the bucket: one exchange serves both, if both have the join's own filter and all columns
    rows = rows.where("bucket is not null").repartition(n, "bucket")
    used = [F.max("weight").alias("most")] if weight is None else []
    met = rows.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"), *used).where("low < high and most >= 0" if used else "low < high")
    # few rows meet another: those are hashed (a row a bucket, so no task has more), and all rows pass by unsorted
    rows = rows.join(met.select("bucket").hint("shuffle_hash"), "bucket").select(*columns).dropDuplicates(["bucket", "id"])
    if scale is not None:
        # in order of the scale, whoever is near any other member is near its neighbour
        order = Window.partitionBy("bucket").orderBy("scale")
        rows = rows.withColumn("scale", scale).withColumn("below", F.col("scale") - F.lag("scale").over(order)).withColumn("above", F.lead("scale").over(order) - F.col("scale"))
        rows = rows.where((F.col("below") <= apart) | (F.col("above") <= apart)).select(*columns)
    rows = cut(rows)
    of_members = [F.sum(F.xxhash64("id") % (1 << 40)).alias("s1"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("s2")]
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("weight") if weight is None else weight).alias("weight"), *of_members).where("n > 1")
    kept = sizes.groupBy("n", "s1", "s2").agg(F.min("bucket").alias("bucket"), F.min("weight").alias("weight"))
    blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("weight") / block_weight), F.lit(1)).cast("int")
    kept = kept.select("bucket", blocks.alias("blocks"))
    at = rows.join(kept, "bucket").withColumn("own", F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("int"))
    return at.select(*columns, "blocks", "own")


#: Rows of a task that are compared with all its members at once: matrices have so many rows at most.
STRIP = 256
#: Tasks of so many members have their pairs compared together, if that is wanted.
FEW = 4


def compare(dealt: DataFrame, payload: DataFrame, payload_schema: str, link: Callable[[list, slice], np.ndarray], prepare: Callable[[pa.Array], list], count: bool = True, pairs: Callable[[list, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Compares the members of each task; (a, b, links): links of a where b is null, else a link a-b of the forest.

    payload: (id, member, size, keys, and the column of payload_schema). `prepare` turns that column
    of many rows into an object a row; `link(objects, rows)` returns which objects each of some rows is
    linked to, as a boolean matrix. A member's links count the sizes of those it is linked to, each
    pair in the first table in which it meets. If not `count`, only the forest is wanted: pairs that
    are joined already are not compared, and keys may be left out of the payload. `pairs(objects, a, b)`,
    which is for that case, tells of many pairs whether objects a and b are linked: all pairs of tasks
    of up to FEW members are then compared together, and each link found is one of the forest.

    A task holds two blocks of members and matrices of STRIP rows: its memory doesn't grow with a bucket.
    """
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value, more = payload.columns[-1], ["size", "keys"] if count else []
    # members are dealt to their pairs of blocks where they are joined, by id: those of a large bucket lie apart there
    rows = dealt.join(payload, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "member", *more, value)
    rows = rows.repartition(n, "bucket", "first", "second").sortWithinPartitions("bucket", "first", "second")

    def task(own: np.ndarray, first: int, second: int, bucket: int, ids: np.ndarray, size: np.ndarray, keys: np.ndarray, values: list) -> tuple | None:
        m, table = len(ids), bucket >> TABLE_BITS
        root, total = np.arange(m), np.zeros(m)
        for low in range(0, m, STRIP):
            part = slice(low, min(m, low + STRIP))
            new = root[part, None] != root[None, :] if not count else np.ones((part.stop - low, m), bool)
            if count:
                for t in range(table):
                    new &= keys[part, t][:, None] != keys[:, t][None, :]
                new[np.arange(part.stop - low), np.arange(low, part.stop)] = False
            if first != second:
                new &= own[part, None] != own[None, :]
            if not new.any():
                continue
            linked = new & link(values, part)
            if not linked.any():
                continue
            if count:
                total[part] += linked @ size
            while True:  # the least label among the linked goes to all that bear one of their labels
                least = np.minimum(root[part], np.where(linked, root[None, :], m).min(axis=1))
                lower = np.minimum(root, np.where(linked, least[:, None], m).min(axis=0))
                lower[part] = np.minimum(lower[part], least)
                label = np.arange(m)
                np.minimum.at(label, root, lower)
                label = label[label]
                if (label[root] == root).all():
                    break
                root = label[root]
        while (root[root] != root).any():
            root = root[root]
        tied, some = np.flatnonzero(root != np.arange(m)), np.flatnonzero(total > 0)
        if not len(tied):
            return None
        return ids[some], total[some].astype(np.int64), ids[tied], ids[root[tied]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        a, b, links = [], [], []

        def done(batch: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(batch)
            bucket, first, second, own, ids = (t.column(c).to_numpy() for c in ("bucket", "first", "second", "own", "member"))
            size = t.column("size").to_numpy().astype(float) if count else np.ones(t.num_rows)
            keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) if count else np.zeros((t.num_rows, 0))
            bounds = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1]), [True])))
            for group in np.array_split(np.arange(len(bounds) - 1), max(1, t.num_rows // 1000)):
                if not len(group):
                    continue
                low, high = bounds[group[0]], bounds[group[-1] + 1]
                values = prepare(t.column(value).slice(low, high - low).combine_chunks())
                if pairs is not None:
                    begin, m = bounds[group], bounds[group + 1] - bounds[group]
                    few = (m <= FEW) & (first[begin] == second[begin])
                    x, y = [], []
                    for i in range(FEW - 1):
                        for j in range(i + 1, FEW):
                            x.append(begin[few & (m > j)] + i), y.append(begin[few & (m > j)] + j)
                    x, y = np.concatenate(x), np.concatenate(y)
                    ok = pairs(values, x - low, y - low)
                    a.extend(ids[x[ok]].tolist()), b.extend(ids[y[ok]].tolist()), links.extend([0] * int(ok.sum()))
                    group = group[~few]
                for g in group:
                    s = slice(bounds[g], bounds[g + 1])
                    if s.stop - s.start > 1:
                        got = task(own[s], int(first[s.start]), int(second[s.start]), int(bucket[s.start]), ids[s], size[s], keys[s], values[s.start - low : s.stop - low])
                        if got:
                            a.extend(got[0].tolist() + got[2].tolist())
                            b.extend([None] * len(got[0]) + got[3].tolist())
                            links.extend(got[1].tolist() + [0] * len(got[2]))

        def out() -> pa.RecordBatch:
            r = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], ["a", "b", "links"])
            a.clear(), b.clear(), links.clear()
            return r

        for whole in parts:
            for begin in range(0, whole.num_rows, 2000):
                part = whole.slice(begin, 2000)
                # the batch up to the beginning of its last task is whole; the rest waits
                k = [part.column(i) for i in range(3)]
                last, at = tuple(c[-1].as_py() for c in k), part.num_rows - 1
                while at > 0 and tuple(c[at - 1].as_py() for c in k) == last:
                    at -= 1
                if at == 0 and held and tuple(c[0].as_py() for c in (held[-1].column(i) for i in range(3))) == last:
                    held.append(part)
                    continue
                if at:
                    done([*held, part.slice(0, at)])
                    held = []
                elif held:
                    done(held)
                    held = []
                held.append(part.slice(at))
                if len(a) > 50_000:
                    yield out()
        if held:
            done(held)
        if a:
            yield out()

    return rows.mapInArrow(run, "a long, b long, links long")


def lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as arrays, without an object for each item."""
    flat, at = column.flatten().to_numpy(), column.offsets.to_numpy()
    at = at - at[0]
    return [flat[i:j] for i, j in zip(at[:-1], at[1:])]


def summed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, links) of all members with links, and the edges (a, b) of the forests; computed once."""
    found = cut(found)
    return found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links")), found.where("b is not null").select("a", "b")
