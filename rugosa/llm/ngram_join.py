"""N-gram Jaccard join: which documents share most of their word 5-grams.

Equal texts form one class first. Each class's set of 5-grams gets a MinHash signature, cut into
bands; classes that agree on a whole band meet in a bucket, found by a shuffle on band hashes. The
numbers of bands and rows are the cheapest that find a pair at the threshold with the target
recall. Pairs that meet are verified on their full sets of 5-grams, in blocks.
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
from .common import Words, batches, components, cut, mix64, shingles


def band_plan(threshold: float, recall: float, rows: int = 6) -> tuple[int, int]:
    """(bands, rows): the least number of bands that reach the recall for a pair at the threshold."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


class Signer:
    def __init__(self, n: int, bands: int, rows: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.n, self.bands, self.rows = n, bands, rows
        self.a = (rng.integers(1, 1 << 31, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
        self.words = Words()

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The distinct n-gram hashes of each text, sorted. Case is folded; words end at white space."""
        out = []
        for i, j in batches(texts):
            h, at = shingles(*self.words.of(texts[i:j]), self.n)
            out += [np.unique(h[at[k] : at[k + 1]]) for k in range(j - i)]
        return out

    def sign(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket keys of each text's bands, n-grams counted with repeats)."""
        keys, sizes = [], []
        for i, j in batches(texts):
            h, at = shingles(*self.words.of(texts[i:j]), self.n)
            full = np.flatnonzero(np.diff(at))
            least = np.zeros((j - i, len(self.a)), np.uint32)
            if len(full):
                low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
                for k, (a, b) in enumerate(zip(self.a, self.b)):
                    v = low * a
                    v += b
                    v ^= v >> np.uint32(15)
                    least[full, k] = np.minimum.reduceat(v, at[:-1][full])
            with np.errstate(over="ignore"):
                parts = least.reshape(j - i, self.bands, self.rows).astype(np.uint64)
                band = np.zeros((j - i, self.bands), np.uint64)
                for r in range(self.rows):
                    band = mix64(band * np.uint64(Words.BASE) + parts[:, :, r] + np.uint64(r + 1))
            keys.append(blocks.bucket_keys(band))
            sizes.append(np.diff(at))
        return np.concatenate(keys), np.concatenate(sizes)


_HELD: dict[tuple, Signer] = {}


def signer(*key) -> Signer:
    if key not in _HELD:
        _HELD[key] = Signer(*key)
    return _HELD[key]


#: Entries of a matrix of members and shingles.
CELLS = 2_000_000


def jaccard_links(sets: list[np.ndarray], threshold: float, rows: slice = slice(None)) -> np.ndarray:
    """Which of `rows` have a Jaccard similarity of at least the threshold with which sets (sorted, distinct)."""
    m = len(sets)
    rows = slice(*rows.indices(m))
    sizes = np.array([len(s) for s in sets], np.float64)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        common = np.full((2, 2), both, np.float64)[rows]
    else:
        # only shingles of these rows that another member has as well can be shared
        mine = np.unique(np.concatenate(sets[rows]))
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(m), sizes.astype(np.int64))
        column = np.searchsorted(mine, every)
        ok = column < len(mine)
        ok[ok] = mine[column[ok]] == every[ok]
        owner, column = owner[ok], column[ok]
        shared = np.bincount(column, minlength=len(mine)) > 1
        ok = shared[column]
        owner, column = owner[ok], (np.cumsum(shared) - 1)[column[ok]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common, width = np.zeros((rows.stop - rows.start, m), np.float32), int(shared.sum())
        step = max(1, min(width, max(64, CELLS // m)))
        for begin in range(0, width, step):
            i, j = np.searchsorted(column, (begin, begin + step))
            x = np.zeros((m, step), np.float32)
            x[owner[i:j], column[i:j] - begin] = 1
            common += x[rows] @ x.T
    union = sizes[rows, None] + sizes[None, :] - common
    return (common >= threshold * union - 1e-9) & (common > 0)


def digests(texts: list[str]) -> np.ndarray:
    """128 bits of each text, as two signed longs."""
    return np.frombuffer(b"".join(hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)


def ngram_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row a document: doc_id, class_id, n_links, component_id, kept, text_key (a hash of the text).

    class_id is the least doc_id with an equal text (null counts as empty). n_links counts the other
    rows whose text is equal or whose set of n-grams has a Jaccard similarity >= threshold.
    component_id is the least doc_id that links lead to; kept marks the one document of a component
    that stays. A text of fewer than n words has all its words as one n-gram; texts without words
    are linked to equal texts only. Rows repeated with one id count as rows and are kept or not
    together; null ids are left out. An empty table gives an empty one.
    """
    bands, rows = band_plan(threshold, recall)

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = signer(n, bands, rows)
        for part in parts:
            texts = [t or "" for t in part.column(1).to_pylist()]
            digest = digests(texts)
            keys, sizes = s.sign([t.lower().encode() for t in texts])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(sizes.astype(np.int64)), flat], ["doc_id", "text_key", "c1", "c2", "grams", "keys"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    keyed = source.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    signed = cut(keyed.mapInArrow(sign, "doc_id long, text_key long, c1 long, c2 long, grams long, keys array<long>"))
    classes = cut(signed.groupBy("c1", "c2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size")))
    reps = signed.join(classes, ["c1", "c2"]).where("doc_id = class_id and grams > 0")
    # numbers, not hashes, stand for classes: they can't collide. One doc_id may stand for several texts where ids repeat
    reps = reps.dropDuplicates(["c1", "c2"]).select("c1", "c2", "class_id", "size", F.col("grams").alias("weight"), "keys")
    reps = cut(reps.withColumn("id", F.monotonically_increasing_id()))
    dealt = cut(blocks.tasks(reps.select("id", "weight", F.explode("keys").alias("bucket")), 1024, 500_000))
    kept = reps.join(dealt.select("id").distinct(), "id")

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = signer(n, bands, rows)
        for part in parts:
            texts = [t or "" for t in part.column("text").to_pylist()]
            got, digest = s.sets([t.lower().encode() for t in texts]), digests(texts)
            at = np.concatenate(([0], np.cumsum([len(g) for g in got]))).astype(np.int32)
            values = np.concatenate([*got, np.zeros(0, np.uint64)]).astype(np.int64)
            own = pa.array((digest[:, 0] == part.column("c1").to_numpy()) & (digest[:, 1] == part.column("c2").to_numpy()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(pa.array(at), pa.array(values)), own], ["id", "size", "keys", "grams", "own"])

    payload = kept.withColumnRenamed("class_id", "doc_id").join(source, "doc_id").select("id", "size", "keys", "c1", "c2", "text")
    payload = payload.mapInArrow(sets, "id long, size long, keys array<long>, grams array<long>, own boolean")
    # of rows that repeat an id, only one with the class's own text
    payload = payload.where("own").dropDuplicates(["id"]).select("id", F.col("id").alias("member"), "size", "keys", "grams")
    found = blocks.compare(dealt, payload, "grams array<long>", lambda sets, some: jaccard_links(sets, threshold, some), blocks.lists)
    links, edges = blocks.summed(found)
    comps = components(edges)
    # the least doc_id of each component: numbers of classes to doc_ids
    top = reps.select("id", "c1", "c2", "class_id", "weight")
    named = comps.join(top, comps.node == top.id).select("component", "class_id")
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    nodes = comps.join(least, "component").select(F.col("node").alias("id"), "component_id")
    figures = links.join(nodes, "id", "full").join(top, "id").select("c1", "c2", "links", "component_id")
    table = classes.join(figures, ["c1", "c2"], "left")
    table = table.select("c1", "c2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    out = signed.select("doc_id", "text_key", "c1", "c2").join(table, ["c1", "c2"])
    return out.select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "text_key")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
