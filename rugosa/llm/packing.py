"""Best-fit packing of tokenised documents into sequences, by vector best-fit.

An item uses three capacities of a sequence: tokens, documents, and attention cost (length
squared). An item goes to the open sequence that it fits in every dimension and that scores best:
the smallest weighted norm of what would be left ("norm"), or the largest weighted dot product of
the item and what is left ("dot").

Items of one length are alike, so the best-fit runs over the histogram of lengths (at most
`max_tokens` entries, whatever the corpus) and sequences in the same state are kept as ranges of
numbers. The plan that comes out says, for each length, which ranks go to which sequences. Ranks
are dealt to the items in a distributed way, and the plan is joined back.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut

#: Bytes that a worker's caches of chunks and of pieces may take, each in two generations; an entry takes about ENTRY.
CHUNK_BYTES, PIECE_BYTES, ENTRY = 80_000_000, 10_000_000, 220
#: Longer chunks are tokenised anew each time.
CACHED_BYTES = 40
#: Chunks of which the pieces below are exactly those of the tokenizer: characters whose classes and
#: normal forms are the same in all versions of Unicode.
SIMPLE = regex.compile(r"[\x21-\x7e\xa1-\u012f\u0131-\u024f]+")
# How the tokenizer cuts a text into pieces; each ends with one token that ends a word.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
END = "</w>"
#: Letters of ASCII and Latin-1 only, in UTF-8.
WORD = re.compile(rb"(?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++")
#: A single mark behind a letter of ASCII or Latin-1 and before a blank is a piece, so it may stand as a chunk of its own.
MARKS = [(re.compile(rb"%b(?=[ \n])(?:(?<=[a-z]%b)|(?<=\xc3[\xa0-\xb6\xb8-\xbf]%b))" % (m, m, m)), b" " + c) for c in (b".", b",") for m in [re.escape(c)]]


def marks_apart(text: bytes) -> bytes:
    for pattern, apart in MARKS:
        text = pattern.sub(apart, text)
    return text


class Cache:
    """Values by key in two generations: what wasn't asked for during a generation goes with the next but one."""

    def __init__(self, most_bytes: int) -> None:
        self.most = most_bytes // 2 // ENTRY
        self.new: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """Those of the keys that have no value; the others' are in `new` from now on."""
        left, old = keys.difference(self.new), self.old
        again = [k for k in left if k in old]  # a set's `intersection` would walk over all of `old`
        self.new.update(zip(again, map(old.__getitem__, again)))
        return list(left.difference(again))

    def trim(self) -> None:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}


class ChunkTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer never joins characters over a blank or a line feed, and lowers case, so a text's
    ids are those of its chunks between blanks and line feeds, and a chunk's are those of its pieces:
    runs of letters, digits, and runs of other characters. Most are met again and again. Where a
    special token's opening is in the text, its case is kept.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.load = lambda: Tokenizer.from_file(path)
        self.tok, self.cut_already = None, self.load()
        # pieces are in normal form, lower case and cut: bytes as letters and the model are left to do
        self.cut_already.normalizer, self.cut_already.pre_tokenizer = None, Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.cut_already.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(END)]] = True
        self.chunks, self.pieces = Cache(CHUNK_BYTES), Cache(PIECE_BYTES)

    def _ids(self, chunks: list[str]) -> list[bytes]:
        if chunks and self.tok is None:
            self.tok = self.load()  # few texts need the whole tokenizer
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)] if chunks else []

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, tokenised as one text and cut behind the tokens that end a word."""
        if not pieces:
            return []
        ids = np.array(self.cut_already.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(pieces) or cuts[-1] != len(ids):
            return self._ids(pieces)
        raw, cuts = ids.astype("<u4").tobytes(), (4 * cuts).tolist()
        return [raw[i:j] for i, j in zip([0, *cuts], cuts)]

    def _of_chunks(self, chunks: list[bytes]) -> list[bytes]:
        out = dict.fromkeys(chunks)
        words = list(filter(WORD.fullmatch, chunks))  # one piece
        out.update(zip(words, self._of_pieces([c.decode().lower() for c in words])))
        chunks = [c for c, ids in out.items() if ids is None]
        out.update(zip(chunks, self._of_mixed(chunks)))
        return list(out.values())

    def _of_mixed(self, chunks: list[bytes]) -> list[bytes]:
        texts = [c.decode() for c in chunks]
        cut = [PIECE.findall(t.lower()) if (t.isascii() and t.isprintable() or SIMPLE.fullmatch(t)) and "<|" not in t else None for t in texts]
        new = self.pieces.missing(set().union(*[c for c in cut if c is not None]))
        self.pieces.new.update(zip(new, self._of_pieces(new)))
        of, odd = self.pieces.new, iter(self._ids([t for t, c in zip(texts, cut) if c is None]))
        out = [b"".join([of[x] for x in c]) if c is not None else next(odd) for c in cut]
        for x in new:
            if len(x) > CACHED_BYTES:
                del of[x]
        self.pieces.trim()
        return out

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        for i, j in batches(texts, 500_000):
            split = [(t if b"<|" in t else marks_apart(t.lower())).replace(b"\n", b" ").split(b" ") for t in texts[i:j]]
            self.chunks.new[b""] = b""
            missing = self.chunks.missing(set().union(*split))
            new = self.chunks.new
            new.update(zip(missing, self._of_chunks(missing)))
            for chunks in split:
                yield b"".join(map(new.__getitem__, chunks))
            for c in missing:
                if len(c) > CACHED_BYTES:
                    del new[c]
            self.chunks.trim()


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, path: str, max_tokens: int, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; null text counts as empty."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(path), array("I", [end_id]).tobytes()
        for part in parts:
            doc, rows = part.column(0).to_pylist(), ([], [], [], [], [])
            texts = (t or b"" for t in part.column(1).to_pylist())
            for d, ids in zip(doc, tok(list(texts))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    cutout = ids[at : at + 4 * max_tokens]
                    for column, x in zip(rows, (d, k, at // 4, len(cutout) // 4, zlib.crc32(cutout))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(lengths: np.ndarray, counts: np.ndarray, max_tokens: int, max_docs: int, max_cost: float, weights: tuple, score: str = "norm") -> list[tuple]:
    """Runs (length, first rank, last rank + 1, items in each sequence, first sequence, offset).

    Lengths are taken from the longest down. `left` holds the residual capacities of groups of
    sequences, as parts of the whole; groups are ranges of consecutive numbers in the same state.
    """
    w = np.asarray(weights, float)
    whole = np.array([max_tokens, max_docs, max_cost], float)
    left = np.zeros((64, 3))  # residual capacities, in units
    first, many, n, opened = np.zeros(64, np.int64), np.zeros(64, np.int64), 0, 0
    plan: list[tuple] = []

    def add(residual, begin, size) -> None:
        nonlocal left, first, many, n
        if size <= 0:
            return
        if n == len(many):
            live = np.flatnonzero(many[:n] > 0)
            live = live[left[live, 0] >= least]
            left[: len(live)], first[: len(live)], many[: len(live)] = left[live], first[live], many[live]
            n = len(live)
            if n > len(many) // 2:
                left, first, many = np.concatenate((left, np.zeros_like(left))), np.concatenate((first, np.zeros_like(first))), np.concatenate((many, np.zeros_like(many)))
        left[n], first[n], many[n] = residual, begin, size
        n += 1

    order = np.argsort(-lengths)
    least = float(lengths.min()) if len(lengths) else 0.0
    for length, count in zip(lengths[order].tolist(), counts[order].tolist()):
        item, rank = np.array([length, 1, float(length) ** 2]), 0
        while rank < count:
            todo = count - rank
            fits = np.flatnonzero((many[:n] > 0) & (left[:n] >= item).all(axis=1))
            if len(fits):
                rest = left[fits] / whole
                gain = (w * rest * (item / whole)).sum(axis=1) if score == "dot" else -(w * (rest - item / whole) ** 2).sum(axis=1)
                at = int(fits[np.argmax(gain)])
                residual, begin, size = left[at].copy(), int(first[at]), int(many[at])
            else:
                residual, begin = whole.copy(), opened
                size = 1 << 62
                at = -1
            each = 1 if score == "dot" else max(1, int(min(residual // item)))
            offset = int(max_tokens - residual[0])
            full = min(todo // each, size)
            if full:
                plan.append((int(length), rank, rank + full * each, each, begin, offset))
                rank += full * each
                add(residual - each * item, begin, full)
            rest_n = min(count - rank, each) if full < size and count > rank and count - rank < each else 0
            if rest_n:
                plan.append((int(length), rank, rank + rest_n, rest_n, begin + full, offset))
                rank += rest_n
                add(residual - rest_n * item, begin + full, 1)
            used = full + bool(rest_n)
            if at < 0:
                opened += used
            else:  # `add` may have moved the group
                at = int(np.flatnonzero((first[:n] == begin) & (many[:n] == size) & (left[:n] == residual).all(axis=1))[0]) if not (at < n and first[at] == begin and many[at] == size and (left[at] == residual).all()) else at
                first[at], many[at] = begin + used, size - used
    return plan


def pack_best_fit(pieces: DataFrame, max_tokens: int = 4096, max_docs: int | None = None, max_cost: float | None = None, weights: tuple = (1.0, 0.02, 0.02), score: str = "norm", shards: int = 256) -> DataFrame:
    """The pieces (doc_id, piece, length, ...) with sequence_id and offset.

    max_docs and max_cost bound a sequence's documents and its sum of squared lengths; by default
    neither is tighter than max_tokens; all three count in choosing a sequence. An item must fit an empty sequence, or this raises
    ValueError. Sequences are gapless from offset 0. Repeated rows are packed one by one. An empty
    table gives an empty one. `pieces` is read three times: pass a checkpointed or stored table.

    The driver sees the histogram only. Ranks are counted within (length, shard of the id), so one
    very common length is spread over the shards.
    """
    max_docs, max_cost = max_docs or max_tokens, max_cost or float(max_tokens) ** 2
    shard = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int")
    d = pieces.withColumn("shard", shard)
    cells = cut(d.groupBy("length", "shard").agg(F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("before", F.coalesce(before, F.lit(0)))
    hist = cells.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most max_tokens rows
    lengths, counts = np.array([r[0] for r in hist], np.int64), np.array([r[1] for r in hist], np.int64)
    if len(lengths) and (lengths.max() > max_tokens or float(lengths.max()) ** 2 > max_cost or lengths.min() < 1):
        raise ValueError("a piece fits no sequence")
    plan = best_fit_plan(lengths, counts, max_tokens, max_docs, max_cost, weights, score)
    spark = pieces.sparkSession
    runs = spark.createDataFrame(plan, "p_length long, p_from long, p_to long, p_each long, p_sequence long, p_offset long")
    rank = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "start")) - 1
    d = d.withColumn("rank", rank).join(cells.select(F.col("length").alias("c_length"), F.col("shard").alias("c_shard"), "before"), (F.col("length") == F.col("c_length")) & (F.col("shard") == F.col("c_shard")))
    d = d.withColumn("rank", F.col("rank") + F.col("before"))
    # the plan has a few runs for each of at most max_tokens lengths: bounded, whatever the corpus
    d = d.join(F.broadcast(runs), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to")))
    step = F.col("rank") - F.col("p_from")
    return d.select(*pieces.columns, (F.col("p_sequence") + F.floor(step / F.col("p_each"))).cast("long").alias("sequence_id"), (F.col("p_offset") + (step % F.col("p_each")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, max_tokens: int = 4096, **options) -> DataFrame:
    """Tokenises and packs `docs` (doc_id, text); see `pack_best_fit`. Other columns are ignored."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    pieces = cut(token_pieces(docs, path, max_tokens))
    return pack_best_fit(pieces, max_tokens, **options)


def op2_pack_documents(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
