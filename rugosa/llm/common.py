"""What several of the training-data operators share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import checkpoint_dir as checkpoint_dir
from ..functions.columns import cut as cut
from ..functions.unionfind import components as components

#: ASCII white space, as in the class [\x20\x09-\x0D].
SPACES = b" \t\n\v\f\r"


def stored(df: DataFrame):
    """(df, a function that deletes it): written as Parquet in the shared folder, for tables of which
    later jobs read some columns only."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path), lambda: at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: What may be sent to every executor at once.
BROADCAST_BYTES = 64_000_000


def sent_if_small(df: DataFrame, row_bytes: int, items: str | None = None, item_bytes: int = 0) -> DataFrame:
    """df, marked for broadcast if its size is counted to be within BROADCAST_BYTES.

    A row takes row_bytes, and item_bytes for each entry of the array column `items`. A larger table
    is joined by a shuffle. Pass a table that was cut or stored: it is read for the count.
    """
    n, more = df.agg(F.count("*"), F.coalesce(F.sum(F.size(items)), F.lit(0)) if items else F.lit(0)).first()
    return F.broadcast(df) if n * row_bytes + more * item_bytes <= BROADCAST_BYTES else df


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; 0 is held out. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


class Words:
    """Hashes of the white-space-separated words of texts, without a Python object a word.

    A word's hash is a polynomial of its bytes modulo 2^64, taken from running sums, then mixed.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True
        self.powers = self.inverse = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 20)
            with np.errstate(over="ignore"):
                p = np.full(n, self.BASE, np.uint64)
                p[0] = 1
                self.powers = np.multiply.accumulate(p)
                p[1:] = np.uint64(pow(self.BASE, -1, 1 << 64))
                self.inverse = np.multiply.accumulate(p)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts, and where each text's words begin (one more entry than texts)."""
        raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        self._grow(len(raw) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], out=sums[1:])
            gap = self.space[raw]
            starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
            ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
            words = mix64((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        return words, np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))) + 1)


def shingles(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words in each text, and where each text's runs begin.

    A text of fewer words has one run of all its words; a text without words has none.
    """
    counts = np.diff(bounds)
    runs = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate(([0], np.cumsum(runs)))
    at = np.repeat(bounds[:-1] - out_bounds[:-1], runs) + np.arange(out_bounds[-1])
    left = np.repeat(counts, runs)
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    total = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            w = padded[at + i]
            if i and (left <= i).any():
                w = np.where(left > i, w, np.uint64(0))
            total += w * np.uint64(pow(Words.BASE, 3 * i + 7, 1 << 64))
        return mix64(total), out_bounds


def batches(texts: list[bytes], most: int = 200_000):
    """Ranges of texts of about so many bytes together; a longer text stands alone."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield begin, i
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def labelled_sample(rows: DataFrame, label: str, per_label: int, max_labels: int = 512, max_chars: int = 100_000, seed: int = 1) -> list[tuple[str, str]]:
    """(text, label as text) of about `per_label` rows of each label, on the driver.

    For fitting classifiers: at most per_label x max_labels texts of up to max_chars characters,
    drawn by a hash of id and text, so that reruns agree and rows that repeat count once. The commonest
    labels count where there are more than max_labels.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    counts = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(max_labels).collect()
    if not counts:
        return []
    share = F.create_map(*[x for r in counts for x in (F.lit(str(r[0])), F.lit(min(1.0, 1.2 * per_label / r[1])))])
    luck = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(seed)), 11) / F.lit(float(1 << 53))
    drawn = rows.select("text", F.col(label).cast("string").alias("label"), luck.alias("luck")).where(F.col("luck") < F.element_at(share, F.col("label")))
    drawn = drawn.dropDuplicates(["luck", "label"]).collect()  # rows that repeat have one chance between them
    out, seen = [], {}
    for r in sorted(drawn, key=lambda r: (r.luck, r.label, r.text)):
        seen[r.label] = seen.get(r.label, 0) + 1
        if seen[r.label] <= per_label:
            out.append((r.text, r.label))
    return out
