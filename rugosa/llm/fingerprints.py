"""Document fingerprints by consistent weighted sampling.

A document is a bag of five-word shingles weighted by how often they occur. Sample k of the
signature is the shingle with the least ln a = ln c - r (t - b + 1), t = floor(ln w / r + b), with
r, c ~ Gamma(2, 1) and b ~ U(0, 1) fixed for each shingle and k (improved consistent weighted
sampling), together with its t. Two signatures agree at k with a probability equal to the
generalised Jaccard similarity sum(min(w)) / sum(max(w)) of the bags.

Variates are drawn once into tables. Two parts of a shingle's hash point into them, one for c and one
for r and b, so that two shingles have the same variates only if 2 x ROWS_LOG2 bits agree; what the
signature keeps of a sample is a hash of the whole 64-bit shingle and t.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, batches, cut, mix64, sent_if_small, shingles

SAMPLES = 128
ROWS_LOG2 = 16
WORDS = 5
#: Documents of a run that one task goes through in order.
RUN_ROWS = 20_000
#: More documents than so many runs hold make the runs longer: the bounds of runs are numbers in the plan.
MOST_RUNS = 1 << 16
#: Shingles looked at together, so that memory stays small for very long texts.
BLOCK = 1024


class Sampler:
    """Signatures of texts: SAMPLES unsigned 16-bit numbers each; all zero for a text without words."""

    def __init__(self, samples: int = SAMPLES, rows_log2: int = ROWS_LOG2, n: int = WORDS, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        size = (1 << rows_log2, samples)
        self.n, self.samples, self.mask, self.shift = n, samples, np.uint64((1 << rows_log2) - 1), np.uint64(rows_log2)
        self.r = rng.standard_gamma(2.0, size, np.float32)
        self.c = np.log(rng.standard_gamma(2.0, size, np.float32))
        self.b = rng.random(size, np.float32)
        self.once = self.r * (1 - self.b)  # ln a at weight 1 is ln c less this
        self.k = np.arange(samples)
        self.held, self.less, self.equal = np.empty((BLOCK, samples), np.float32), np.empty((BLOCK, samples), np.float32), np.empty((BLOCK, samples), bool)
        self.words = Words()

    def _one(self, hashes: np.ndarray) -> np.ndarray:
        terms, weights = np.unique(hashes, return_counts=True)
        row, of_c = (terms & self.mask).astype(np.int64), ((terms >> self.shift) & self.mask).astype(np.int64)
        best, at, t = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.int64), np.zeros(self.samples, np.int64)
        for begin in range(0, len(row), BLOCK):
            part, w = row[begin : begin + BLOCK], weights[begin : begin + BLOCK]
            c = of_c[begin : begin + BLOCK]
            a = self.c.take(c, axis=0, out=self.held[: len(part)], mode="clip")
            a -= self.once.take(part, axis=0, out=self.less[: len(part)], mode="clip")
            steps = np.zeros(a.shape, np.int64) if (more := np.flatnonzero(w > 1)).size else None
            if more.size:
                r, b = self.r[part[more]], self.b[part[more]]
                s = np.floor(np.log(w[more]).astype(np.float32)[:, None] / r + b)
                a[more] = self.c[c[more]] - r * (s - b + 1)
                steps[more] = s
            least = a.min(axis=0)
            hit = np.flatnonzero(np.equal(a, least, out=self.equal[: len(part)]))[::-1]  # several times faster than argmin along this axis
            i = np.empty(self.samples, np.int64)
            i[hit % self.samples] = hit // self.samples
            better = least < best
            best[better], at[better] = least[better], i[better] + begin
            t[better] = 0 if steps is None else steps[i, self.k][better]
        return (mix64(terms[at] ^ mix64(t.astype(np.uint64) + np.uint64(1))) & np.uint64(0xFFFF)).astype(np.uint16)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), self.samples), np.uint16)
        for i, j in batches(texts):
            h, at = shingles(*self.words.of(texts[i:j]), self.n)
            for k in range(i, j):
                if at[k - i + 1] > at[k - i]:
                    out[k] = self._one(h[at[k - i] : at[k - i + 1]])
        return out


_HELD: dict[tuple, Sampler] = {}


def sampler(*key) -> Sampler:
    if key not in _HELD:
        _HELD[key] = Sampler(*key)
    return _HELD[key]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of samples that agree: an estimate of the generalised Jaccard similarity."""
    return (a == b).mean(axis=-1)


def fingerprint(docs: DataFrame, samples: int = SAMPLES, seed: int = 5) -> DataFrame:
    """doc_id, fingerprint (hex, 4 digits a sample) of every text. Null counts as empty."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sampler(samples, ROWS_LOG2, WORDS, seed)
        for part in parts:
            sig = f([t or b"" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.astype(">u2").tobytes().hex() for s in sig], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string")


def ordered_chunks(docs: DataFrame, chunks: int, columns: list[str], by: str = "doc_id") -> DataFrame:
    """The rows dealt into runs of ascending ids, each followed by the first row of the next run.

    Adds chunk (int) and tail (boolean: the row belongs to the next run). The last run is followed
    by the first row of all. Only the bounds of the runs pass through the driver: `chunks` numbers. Rows
    of equal id stay in one run; null ids come first.
    """
    ids = docs.select(F.col(by).cast("double").alias("x"))
    bounds = sorted(set(ids.approxQuantile("x", [i / chunks for i in range(1, chunks)], 0.2 / chunks) if chunks > 1 else []))
    at = F.lit(0)
    if bounds:
        # a binary search over the sorted bounds: the number of bounds below the id
        middle = "shiftright(s.lo + s.hi, 1)"
        step = f"if(s.lo >= s.hi, s, if(element_at(bounds_, {middle} + 1) < cast({by} as double), named_struct('lo', {middle} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {middle})))"
        at = F.expr(f"coalesce(aggregate(sequence(1, {len(bounds).bit_length() + 1}), named_struct('lo', 0, 'hi', {len(bounds)}), (s, i) -> {step}, s -> s.lo), 0)")
    d = docs.select(by, *[c for c in columns if c != by], F.array(*[F.lit(float(b)) for b in bounds]).alias("bounds_")).withColumn("chunk", at).drop("bounds_")
    # a row a run: its first row's key, and the run before, which is the last one for the first
    firsts = d.groupBy("chunk").agg(F.min(F.struct(F.col(by), F.xxhash64("text").alias("h"))).alias("first_"))
    every = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("chunk").over(Window.orderBy("chunk")), F.max("chunk").over(every))
    d = d.join(sent_if_small(cut(firsts.withColumn("before_", before)), 64), "chunk")
    is_first = F.struct(F.col(by).alias(by), F.xxhash64("text").alias("h")).eqNullSafe(F.col("first_"))
    own = F.struct(F.col("chunk").alias("chunk"), F.lit(False).alias("tail"))
    both = F.when(is_first, F.array(own, F.struct(F.col("before_").alias("chunk"), F.lit(True).alias("tail")))).otherwise(F.array(own))
    return d.withColumn("to", F.explode(both)).select(by, *[c for c in columns if c != by], "to.chunk", "to.tail")


def compare_with_edits(docs: DataFrame, samples: int = SAMPLES, seed: int = 5, chunks: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document by ascending doc_id (after the last: the first). Null text counts as
    empty. Rows of equal id follow one another by their text's hash; a single row is its own next.
    Two texts without words are alike (1); one with and one without are not (0). An empty table
    gives an empty one. Extra columns are ignored.
    """
    if chunks is None:
        least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunks = max(1, least, min(MOST_RUNS, math.ceil(docs.count() / RUN_ROWS)))
    n = chunks
    dealt = ordered_chunks(docs.select("doc_id", "text"), n, ["doc_id", "text"])
    dealt = dealt.repartition(n, "chunk").withColumn("h", F.xxhash64("text")).sortWithinPartitions("chunk", "tail", F.col("doc_id").asc_nulls_first(), "h")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sampler(samples, ROWS_LOG2, WORDS, seed)
        held: list[tuple] = []
        size = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            """Of all rows but the last, which is what comes next."""
            done, texts, edited = [], [], []
            for (d, text, chunk, tail), (_, after, chunk2, _) in zip(rows, rows[1:]):
                if not tail and chunk == chunk2:
                    k = len(text) // 4
                    done.append((d, len(text)))
                    texts.append((text.encode(), after.encode()))
                    edited.append((text[: len(text) - k] + after[:k]).encode())
            own = [t for t, _ in texts]
            sigs = f(own + edited + [a for _, a in texts[-1:]])
            m = len(own)
            a, b = sigs[:m], sigs[m : 2 * m]
            # a row's next is the following row of this batch, but where a run ends
            follows = np.concatenate((a[1:], sigs[2 * m :])) if m else a
            ends = [i for i in range(m - 1) if texts[i][1] is not own[i + 1] and texts[i][1] != own[i + 1]]
            if ends:
                follows[ends] = f([texts[i][1] for i in ends])
            text_hex = lambda x: [s.astype(">u2").tobytes().hex() for s in x]
            return pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in done], pa.int64()), pa.array([n for _, n in done], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), pa.array(text_hex(a), pa.string()), pa.array(text_hex(b), pa.string()), pa.array(likeness(a, b), pa.float64()), pa.array(likeness(a, follows), pa.float64())],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for part in parts:
            d, text, chunk, tail = (part.column(i).to_pylist() for i in range(4))
            for row in zip(d, (t or "" for t in text), chunk, tail):
                held.append(row)
                size += len(row[1])
                if size > 4_000_000 and len(held) > 1:
                    yield out(held)
                    held, size = held[-1:], len(row[1])
        if len(held) > 1:
            yield out(held)

    return dealt.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "chunk", "tail").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
