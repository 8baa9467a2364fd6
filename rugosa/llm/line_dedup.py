"""Line dedup: fuzzy lines by MinHash.

Equal lines form one class, by 128 bits of hash. Each class has a MinHash signature of its
character shingles, cut into bands; classes that agree on a band meet in a bucket. Their Jaccard
similarity is verified on the full sets of shingles, in blocks, and a distributed union-find over
the links gives components, of which one line stays: the first one by document id and position.

Splitting, classes, buckets, union-find and rebuilding are DataFrame functions. Signing and
verifying are array programs inside tasks; the README says why not column functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import BROADCAST_BYTES, components, cut, mix64, sent_if_small, stored
from .ngram_join import band_plan, jaccard_links

#: Six values a band: with fewer, unrelated lines of a large corpus meet by chance more often than they are worth.
SHINGLE, ROWS, RECALL, SEED = 5, 6, 0.9999, 7
LINE = "\n"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters hashed or signed together, so that memory stays small and arrays stay in a core's cache.
CHUNK = 100_000
#: Lines signed together: each has a whole signature, however short it is.
LINES = 4_000
#: Bits of a shingle's hash that lie below a line's number, where many lines are sorted at once.
LOW_BITS = 48
LOW = np.uint64((1 << LOW_BITS) - 1)
#: A line's number in buckets: so many bits of its hash, and above them how many shingles it has, as a logarithm in
#: steps of 1 / SCALE. Two lines may share a number; both are then members, and verifying tells them apart.
HASH_BITS, BUCKET_BITS, SCALE = 40, 36, 128


def powers() -> list[np.uint64]:
    return [np.uint64(pow(int(BASE), k, 1 << 64)) for k in (1, 2, 4)]


def character_hashes(text: str) -> np.ndarray:
    """The hash of the SHINGLE characters that begin at each place; the last SHINGLE - 1 places mean nothing."""
    cp = np.frombuffer((text + "\0" * 16).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    p1, p2, p4 = powers()
    with np.errstate(over="ignore"):
        two = cp[:-1] + cp[1:] * p1
        four = two[:-2] + two[2:] * p2
        return mix64(four[: len(text)] + cp[4 : 4 + len(text)] * p4)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_set(line: str) -> np.ndarray:
    """The sorted, distinct shingle hashes of a line of any length; a shorter line is one shingle."""
    n, out = max(1, len(line) - SHINGLE + 1), np.zeros(0, np.uint64)
    for at in range(0, n, CHUNK):
        out = distinct(np.concatenate((out, character_hashes(line[at : at + CHUNK + SHINGLE - 1])[: min(CHUNK, n - at)])))
    return out


def chunks(lines: list[str]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, line in enumerate(lines):
        if held and (held + len(line) > CHUNK or i - begin == LINES):
            yield begin, i
            begin, held = i, 0
        held += len(line) + 1
    if begin < len(lines):
        yield begin, len(lines)


def hashed(lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For chunks of lines of at least SHINGLE characters: the hashes of all shingles, and how many each line has."""
    for i, j in chunks(lines):
        if len(lines[i]) > CHUNK:  # stands alone
            x = shingle_set(lines[i])
            yield x, np.array([len(x)])
            continue
        h = character_hashes(LINE.join(lines[i:j]))
        size = np.fromiter(map(len, lines[i:j]), np.int64, j - i)
        inside = np.ones(len(h) + 1, bool)
        ends = np.cumsum(size + 1)
        for k in range(SHINGLE):
            inside[ends - 1 - k] = False
        yield h[inside[:-1]], size - SHINGLE + 1


def keyed(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """48 bits of each hash below its line's number, sorted, of lines with so many of the hashes each, one after another."""
    return np.sort(np.repeat(np.arange(len(counts), dtype=np.uint64) << np.uint64(LOW_BITS), counts) | h >> np.uint64(64 - LOW_BITS))


def scale(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(size, 1)) * SCALE).astype(np.int64)


def apart(threshold: float) -> int:
    """How far the scales of two lines are apart at most whose similarity reaches the threshold: the smaller set is at
    least that share of the larger one. A step more is for rounding."""
    return math.ceil(SCALE * math.log2(1 / threshold)) + 1


def shingle_sets(lines: pa.Array) -> list[np.ndarray]:
    """48 bits of the distinct shingle hashes of each line, sorted. Lines are hashed together."""
    out = []
    for h, counts in hashed([x.ljust(SHINGLE, "\0") for x in lines.to_pylist()]):
        x = keyed(h, counts)
        x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        at = np.searchsorted(x, np.arange(len(counts) + 1, dtype=np.uint64) << np.uint64(LOW_BITS)).tolist()
        x &= LOW
        out += [x[i:j] for i, j in zip(at[:-1], at[1:])]
    return out


def alike(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sets numbered a and b, pair by pair, have a Jaccard similarity of at least the threshold."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    ok = np.flatnonzero(np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9)
    common, begin = np.zeros(len(a), np.int64), 0
    while begin < len(ok):  # so many at once that a pair's number fits above the hashes and memory stays small
        held = np.cumsum((n[a] + n[b])[ok[begin : begin + 4_000]])
        some = ok[begin : begin + max(1, int(np.searchsorted(held, CHUNK, "right")))]
        each = np.stack((a[some], b[some]), 1).ravel()
        x = np.sort(np.concatenate([sets[i] for i in each]) | np.repeat(np.repeat(np.arange(len(some), dtype=np.uint64), 2) << np.uint64(LOW_BITS), n[each]))
        common[some] = np.bincount((x[1:][x[1:] == x[:-1]] >> np.uint64(LOW_BITS)).astype(np.int64), minlength=len(some))
        begin += len(some)
    return (common >= threshold * (n[a] + n[b] - common) - 1e-9) & (common > 0)


class LineSigner:
    """MinHash signatures of many lines at once, by one hash of each shingle.

    A shingle goes to one of the k places by its hash, and a place keeps the least (one permutation
    hashing). A place that stays empty takes the value of another that has a shingle of its own: the
    first one in a random order of places, which is drawn for each place beforehand. The place that is
    first for both lines' shingles together has their least value there, and the lines agree if both
    have that shingle: with a probability equal to their Jaccard similarity.
    """

    #: Places that an empty one looks at by chance; beyond, it takes the next one that isn't empty.
    LOOKS = 32

    def __init__(self, bands: int, rows: int, seed: int = SEED) -> None:
        self.bands, self.rows, self.k = bands, rows, bands * rows
        rng = np.random.default_rng(seed)
        self.turn = rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.weight = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.other = rng.permuted(np.tile(np.arange(self.k), (self.LOOKS, 1)), axis=1)  # in each look, a place is looked at once

    def sorted(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return keyed(h * self.turn, counts)

    def signatures(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(lines, k) of lines with so many of the shingle hashes each, one after another."""
        return self.least(self.sorted(h, counts), len(counts))

    def least(self, x: np.ndarray, n: int) -> np.ndarray:
        """(n, k) of what `sorted` gives: places follow the order of the hashes, so that a place's first is its least."""
        k, none = self.k, np.uint64(0xFFFFFFFFFFFFFFFF)
        low = x & LOW
        place = ((x >> np.uint64(LOW_BITS)) * np.uint64(k) + (low * np.uint64(k) >> np.uint64(LOW_BITS))).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        own = np.full(n * k, none, np.uint64)
        own[place[first]] = low[first]
        out, todo = own.copy(), np.flatnonzero(own == none)
        line, column = todo // k * k, todo % k
        for other in self.other:
            if not len(todo):
                break
            got = own[line + other[column]]
            out[todo] = got
            left = got == none
            todo, line, column = todo[left], line[left], column[left]
        if len(todo):
            rows, at = np.unique(line // k, return_inverse=True)
            next_ = np.where(own.reshape(n, k)[rows] != none, np.arange(k), 2 * k)
            next_ = np.minimum.accumulate(np.concatenate((next_, next_ + k), axis=1)[:, ::-1], axis=1)[:, ::-1]
            out[todo] = own[line + next_[at, column] % k]
        return out.reshape(n, k)

    def signed(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bucket keys of the lines' bands, and how many shingles each has; lines have at least SHINGLE characters."""
        out, many = [], []
        for h, counts in hashed(lines):
            x = self.sorted(h, counts)
            parts = self.least(x, len(counts)).reshape(len(counts), self.rows, self.bands)
            band = np.zeros((len(counts), self.bands), np.uint64)
            with np.errstate(over="ignore"):
                for r in range(self.rows):
                    band += parts[:, r] * self.weight[r]
            band = mix64(band)
            out.append(blocks.bucket_keys(band, BUCKET_BITS))
            x = x[np.concatenate(([True], x[1:] != x[:-1]))] >> np.uint64(LOW_BITS)
            many.append(np.bincount(x.astype(np.int64), minlength=len(counts)))
        return np.concatenate(out), np.concatenate(many)

    def __call__(self, lines: list[str]) -> np.ndarray:
        return self.signed(lines)[0]


def number(c):
    """A line's number, of a column of its hash or of its number in buckets."""
    return c.bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def signed_buckets(lines: DataFrame, bands: int, rows: int) -> DataFrame:
    """lines (c1, line) -> (id, bucket): a row for each band. A task signs a line that repeats once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, seen = LineSigner(bands, rows), set()
        for part in parts:
            if len(seen) > 200_000:
                seen.clear()
            ids, texts = [], []
            for i, line in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if i not in seen:
                    seen.add(i), ids.append(i), texts.append(line)
            for i, j in chunks(texts):
                keys, many = signer.signed(texts[i:j])
                numbers = np.array(ids[i:j], np.int64) & ((1 << HASH_BITS) - 1) | scale(many) << HASH_BITS
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, bands)), pa.array(keys.ravel())], ["id", "bucket"])

    return lines.mapInArrow(run, "id long, bucket long")


def signed_once(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """lines (r1, r2, pos, line), of classes of several places (c1, c2, first) the first place only.

    A line that is signed twice costs time and changes nothing: where the classes are too many to be
    sent to every executor, all lines pass.
    """
    if repeated.count() * 80 > BROADCAST_BYTES:
        return lines
    first = repeated.select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.struct("first.r1", "first.r2", "first.pos").alias("at"))
    same = (F.xxhash64("line") == F.col("d1")) & (F.xxhash64(F.lit(SEED), "line") == F.col("d2"))
    out = lines.join(F.broadcast(first), same, "left")
    return out.where(F.col("at").isNull() | F.struct("r1", "r2", "pos").eqNullSafe(F.col("at"))).select(*lines.columns)


def dedup_lines(docs: DataFrame, threshold: float = 0.8, least_chars: int = 1) -> DataFrame:
    """docs with `text` less its duplicate lines, and n_lines and n_removed.

    Lines end at line feeds. Of each component of lines of at least `least_chars` characters, one
    occurrence in all documents stays: the first of its earliest class by doc_id (nulls first), then
    the text's hash, then position. A line shorter than a shingle is one shingle, so that equal ones
    are a component. Lines of white space only stay, as do shorter ones than `least_chars`. Every
    document stays, if with an empty text; a null text stays null with 0 lines. Rows that repeat both
    id and text are one document and get equal texts. An empty table gives an empty one. Columns
    n_lines and n_removed of docs, if any, are replaced; others pass, whatever their names.
    """
    docs = docs.drop("n_lines", "n_removed")
    bands, rows = band_plan(threshold, RECALL, ROWS)
    key = (F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))
    source = docs.select("doc_id", F.xxhash64(*key).alias("r1"), F.xxhash64(F.lit(SEED), *key).alias("r2"), "text").where(F.col("text").isNotNull())
    lines = source.select("doc_id", "r1", "r2", F.posexplode(F.split("text", LINE)).alias("pos", "line"))
    lines = lines.where((F.length("line") >= max(least_chars, 1)) & F.col("line").rlike(r"(?U)\S"))
    c1 = F.xxhash64("line")
    seen, forget = stored(lines.select("doc_id", "r1", "r2", "pos", c1.alias("c1"), F.xxhash64(F.lit(SEED), "line").alias("c2")))

    # the classes of several places, and the first place of each
    first = F.min(F.struct("doc_id", "r1", "r2", "pos")).alias("first")
    repeated = cut(seen.groupBy("c1", "c2").agg(F.count("*").alias("n"), first).where("n > 1").select("c1", "c2", "first"))
    once = signed_once(lines.where(F.length("line") >= SHINGLE), repeated)
    buckets = signed_buckets(once.select(c1.alias("c1"), "line"), bands, rows)
    size = F.shiftrightunsigned("id", HASH_BITS)
    dealt = blocks.tasks(buckets, 512, 500_000, F.pow(F.lit(2.0), size / SCALE), size, apart(threshold))
    dealt = cut(dealt.withColumn("id", number(F.col("id"))))
    met = cut(dealt.select("id").distinct())
    # the first place of each class that met another
    where = seen.withColumn("id", number(F.col("c1"))).join(sent_if_small(met, 32), "id", "left_semi").groupBy("id", "c1", "c2").agg(first)
    where = cut(where.withColumn("member", F.monotonically_increasing_id()))
    places = sent_if_small(where.select("id", "member", "first.r1", "first.r2", "first.pos"), 100)
    texts = lines.select("r1", "r2", "pos", "line").join(places, ["r1", "r2", "pos"])
    payload = texts.select("id", "member", "line")  # rows of docs may repeat: a member then meets itself, which joins nothing
    found = blocks.compare(sent_if_small(dealt, 80), payload, "line string", lambda sets, some: jaccard_links(sets, threshold, some), shingle_sets, count=False, pairs=lambda sets, a, b: alike(sets, a, b, threshold))
    _, edges = blocks.summed(found)
    comps = components(edges)

    linked = comps.join(where.select("member", "c1", "c2", "first"), comps.node == F.col("member")).select("c1", "c2", "component", F.col("first").alias("own"))
    part = repeated.join(linked, ["c1", "c2"], "full").select("c1", "c2", F.coalesce("first", "own").alias("first"), "component")
    part = cut(part)
    kept = part.where("component is not null").groupBy("component").agg(F.min(F.struct("first", "c1", "c2")).alias("k"))
    part = part.join(kept.select("k.c1", "k.c2", F.lit(True).alias("leads")), ["c1", "c2"], "left")
    stays = F.when(F.col("component").isNull() | F.col("leads"), F.struct("first.r1", "first.r2", "first.pos"))
    part = cut(part.select("c1", "c2", stays.alias("stays")))
    gone = seen.select("r1", "r2", "pos", "c1", "c2").join(sent_if_small(part, 80), ["c1", "c2"])
    gone = gone.where(~F.struct("r1", "r2", "pos").eqNullSafe(F.col("stays"))).groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone"))  # of one document's lines
    gone = sent_if_small(cut(gone), 80, "gone", 8)
    forget()
    # working columns lie in one struct, away from the names of docs
    mine = F.struct(F.when(F.col("text").isNotNull(), F.xxhash64(*key)).alias("r1"), F.xxhash64(F.lit(SEED), *key).alias("r2"))
    held = docs.select(F.struct(*docs.columns).alias("doc"), mine.alias("mine"))
    out = held.join(gone, (F.col("mine.r1") == F.col("r1")) & (F.col("mine.r2") == F.col("r2")), "left").withColumn("lines", F.split("doc.text", LINE))
    left = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\\n')")
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(left).alias("text")
    columns = [text if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns]
    n_lines = F.when(F.col("doc.text").isNotNull(), F.size("lines")).otherwise(0).cast("long").alias("n_lines")
    n_removed = F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0).cast("long").alias("n_removed")
    return out.select(*columns, n_lines, n_removed)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
