"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes slide over the whole document. Their responses are max-pooled over chunks
of CHUNK positions that overlap by half and together cover every byte. The network is trained on
chunks (a pooled vector, a rectifier, a logistic output; gradients reach the filters through the
position of each maximum). A document's probability combines its chunks: the mean of the pooled
vectors and the mean, least and largest chunk output, weighed by a logistic layer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import fold

WIDTH, FILTERS, HALF = 6, 24, 128
SEGMENT = 256  # halves looked at together, so that memory stays small for very long texts


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class ByteConvNet:
    def __init__(self, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias, self.out, self.out_bias = np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), np.float32(0)
        self.rng, self.top = rng, np.zeros(FILTERS + 5)

    def pooled(self, text: bytes) -> np.ndarray:
        """The rectified pooled vector of each chunk: the whole text, at least one chunk."""
        raw = np.frombuffer(text.ljust(WIDTH, b"\0"), np.uint8)
        n = len(raw) - WIDTH + 1
        halves = []
        for begin in range(0, n, SEGMENT * HALF):
            end = min(n, begin + SEGMENT * HALF)
            r = self.table[0].take(raw[begin:end], axis=0)
            for j in range(1, WIDTH):
                r += self.table[j].take(raw[begin + j : end + j], axis=0)
            halves.append(np.maximum.reduceat(r, np.arange(0, end - begin, HALF), axis=0))
        h = np.concatenate(halves)
        h = np.maximum(h[:-1], h[1:]) if len(h) > 1 else h
        return np.maximum(h + self.bias, 0)

    def _features(self, text: bytes) -> np.ndarray:
        p = self.pooled(text)
        z = p @ self.out + self.out_bias
        return np.concatenate((p.mean(axis=0), [z.mean(), z.min(), z.max(), np.log1p(len(text)) / 10, 1.0]))

    def fit(self, texts: list[bytes], y: np.ndarray, prior: float | None = None, chunks: int = 9000, epochs: int = 4, rate: float = 0.01) -> ByteConvNet:
        size = 2 * HALF + WIDTH - 1
        pool = []
        for i, t in enumerate(texts):
            last = max(0, len(t) - size)
            starts = range(0, last + 1, HALF) if last else (0,)
            for s in self.rng.permutation(len(starts))[: max(1, chunks // max(1, len(texts)))]:
                pool.append((t[starts[s] : starts[s] + size].ljust(size, b"\0"), i))
        if not pool or len(set(y.tolist())) < 2:
            self.top[-1] = 3.0 if not len(y) or y.mean() > 0.5 else -3.0  # nothing to tell apart
            return self
        x = np.frombuffer(b"".join(c for c, _ in pool), np.uint8).reshape(-1, size)
        label = y[[i for _, i in pool]].astype(np.float32)
        weight = np.where(label > 0, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6)).astype(np.float32)
        state = {}

        def adam(name: str, p: np.ndarray, g: np.ndarray, t: int) -> np.ndarray:
            m, v = state.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            state[name] = m, v
            return (p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

        positions, step = 2 * HALF, 0
        for _ in range(epochs):
            order = self.rng.permutation(len(x))
            for b in range(0, len(order), 128):
                at = order[b : b + 128]
                xb = x[at]
                r = self.table[0][xb[:, :positions]]
                for j in range(1, WIDTH):
                    r += self.table[j][xb[:, j : j + positions]]
                where = r.argmax(axis=1)
                raw = np.take_along_axis(r, where[:, None, :], axis=1)[:, 0] + self.bias
                p = np.maximum(raw, 0)
                err = (sigmoid(p @ self.out + self.out_bias) - label[at]) * weight[at] / len(at)
                back = err[:, None] * self.out * (raw > 0)
                g = np.zeros_like(self.table)
                rows = np.arange(len(at))[:, None]
                for j in range(WIDTH):
                    np.add.at(g[j], (xb[rows, where + j], np.arange(FILTERS)[None, :]), back)
                step += 1
                g_out, g_b = p.T @ err + 1e-4 * self.out, np.float32(err.sum())
                self.table, self.bias = adam("table", self.table, g, step), adam("bias", self.bias, back.sum(axis=0), step)
                self.out, self.out_bias = adam("out", self.out, g_out, step), adam("out_bias", self.out_bias, g_b, step)
        # the layer that combines a document's chunks: ridge logistic regression by Newton steps
        f = np.stack([self._features(t) for t in texts])
        top, yd = np.zeros(f.shape[1]), y.astype(float)
        share = yd.mean()
        prior = share if prior is None else prior
        w = np.where(y > 0, prior / share, (1 - prior) / (1 - share))
        for _ in range(15):
            q = sigmoid(f @ top)
            h = (f * (w * q * (1 - q))[:, None]).T @ f + 1.0 * np.eye(len(top))
            top = top - np.linalg.solve(h, f.T @ (w * (q - yd)) + 1.0 * top)
        self.top = top
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(np.array([self._features(t) @ self.top for t in texts]))


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = 1500, max_chars: int = 100_000, seed: int = 1) -> ByteConvNet:
    """Fits on about `per_label` documents of each quality outside the held-out fold (a documented bound).

    Labels are counted and drawn by ids alone; only the drawn ids' texts (up to max_chars characters
    each) are fetched, by a join with that bounded list.
    """
    ids = docs.select("doc_id").where(fold(F.col("doc_id")) != 0).join(labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id")
    good, n = ids.agg(F.coalesce(F.sum("quality"), F.lit(0)), F.count("*")).first()  # of all rows that may be learned from
    if not n:
        return ByteConvNet().fit([], np.zeros(0, np.int64))
    luck = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    share = F.when(F.col("quality") == 1, min(1.0, per_label / max(good, 1))).otherwise(min(1.0, per_label / max(n - good, 1)))
    drawn = ids.where(luck < share).dropDuplicates(["doc_id"]).toArrow()  # about 2 x per_label rows
    texts = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(docs.sparkSession.createDataFrame(drawn)), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one of the rows that repeat an id
    sample = sorted((r.doc_id, r.text, r.quality) for r in texts.collect())
    return ByteConvNet().fit([t.encode() for _, t, _ in sample], np.array([q for _, _, q in sample], np.int64), good / n)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, keep: tuple = ("doc_id",), **bounds) -> DataFrame:
    """As `quality_scores`, but with the kept columns in one struct `kept`, so that no names clash."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, **bounds))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            s = model.value.score([t or b"" for t in part.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["kept", "held_out", "score", "predicted"])

    given = docs.select(F.struct(*keep).alias("kept"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("binary").alias("text"))
    schema = StructType([*given.schema.fields[:2], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return given.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, keep: tuple = ("doc_id",), **bounds) -> DataFrame:
    """`keep`, held_out, score (0 to 1), predicted (1 if score >= threshold) for every document.

    Scores come from the whole text alone, however long; null counts as empty, and empty texts have a
    score too. Labels of ids that occur several times or not at all in docs do no harm, nor do null
    ids. Where labels show one class or none, every score leans to that class (to 1 for none). Equal
    texts tie, and repeated rows each get a row. An empty table gives an empty one. Columns that
    aren't named in `keep` are ignored.
    """
    return scored(docs, labels, threshold, keep, **bounds).select("kept.*", "held_out", "score", "predicted")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
