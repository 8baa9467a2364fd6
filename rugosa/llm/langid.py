"""Language identification by string kernels.

Two texts are compared by a blended-spectrum presence kernel: how many character n-grams, for each
n from 1 to MAX_N, occur in both, over the root of the product of how many occur in each. A Nyström
approximation takes the kernel against landmark texts only, and one-versus-rest kernel ridge
regression on those columns gives a linear score for each language. Batches of texts are scored by
two matrix products: presence x landmarks, then kernel x coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample

MAX_N = 3
#: n-grams are hashed to so many features.
FEATURES = 1 << 14
SEGMENT = 1 << 20

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def presence(text: str, out: np.ndarray) -> bool:
    """Sets the features of the text's n-grams in `out` to 1; whether it has a letter.

    Letters are lowered; each run of other characters counts as one blank.
    """
    found = False
    text = text.lower()
    for begin in range(0, max(1, len(text)), SEGMENT):
        part = text[max(0, begin - MAX_N) : begin + SEGMENT]
        cp = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters()[cp]
        if not letter.any():
            continue
        found = True
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        cp = np.concatenate((np.array([0], np.uint32), np.where(letter, cp, 0)[keep].astype(np.uint32), np.array([0], np.uint32)))
        h = np.zeros(len(cp), np.uint32)
        for n in range(1, MAX_N + 1):
            h = h[: len(cp) - n + 1] * np.uint32(0x01000193) + cp[n - 1 :] + np.uint32(n)
            g = h * np.uint32(0x9E3779B1)
            out[(g ^ (g >> np.uint32(15))) & np.uint32(FEATURES - 1)] = 1
    return found


class StringKernelClassifier:
    def __init__(self, landmarks: int = 128, ridge: float = 1e-3, seed: int = 9) -> None:
        self.m, self.ridge, self.seed = landmarks, ridge, seed
        self.labels: list[str] = []

    def _rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(texts), FEATURES), np.float32)
        ok = np.array([presence(t, x[i]) for i, t in enumerate(texts)], bool)
        return x, ok

    def _kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.marks.T) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]

    def fit(self, texts: list[str], labels: list[str]) -> StringKernelClassifier:
        self.labels = sorted(set(labels))
        if not self.labels:
            return self
        y = np.array([self.labels.index(v) for v in labels])
        rng = np.random.default_rng(self.seed)
        each = max(1, self.m // len(self.labels))
        chosen = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:each] for k in range(len(self.labels))])
        marks, _ = self._rows([texts[i] for i in chosen])
        self.marks = marks / np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None]
        k = np.concatenate([self._kernel(self._rows(texts[i : i + 256])[0]) for i in range(0, len(texts), 256)]).astype(float)
        k_mm = self._kernel(marks).astype(float)
        target = np.where(y[:, None] == np.arange(len(self.labels)), 1.0, -1.0)
        weight = (len(y) / (len(self.labels) * np.bincount(y, minlength=len(self.labels))))[y]  # labels count alike
        self.bias = (weight[:, None] * target).sum(axis=0) / weight.sum()
        a = k.T @ (weight[:, None] * k) + self.ridge * len(y) * (k_mm + 1e-6 * np.eye(len(k_mm)))
        self.alpha = np.linalg.solve(a, k.T @ (weight[:, None] * (target - self.bias))).astype(np.float32)
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Labels and scores from 0 to 1; "und" and 0 for null, texts without a letter, or no labels learned."""
        out, scores = [], np.zeros(len(texts))
        for i in range(0, len(texts), 64):
            part = texts[i : i + 64]
            x, ok = self._rows([t or "" for t in part])
            if not self.labels:
                out += ["und"] * len(part)
                continue
            f = self._kernel(x) @ self.alpha + self.bias
            p = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            out += [self.labels[k] if good else "und" for k, good in zip(f.argmax(axis=1), ok)]
            scores[i : i + 64] = np.where(ok, p.max(axis=1), 0.0)
        return out, scores


def identify_language(docs: DataFrame, per_label: int = 500, landmarks: int = 128) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document (doc_id, text, lang).

    Fits on at most `per_label` documents of each of the 512 commonest non-null langs outside the
    held-out fold, of up to 100,000 characters each (documented bounds on what is learned from);
    predicts from whole texts alone, however long. Null texts and texts without a letter give "und"
    and 0, as does everything where nothing could be learned. Equal texts tie, and repeated rows each
    get a row. An empty table gives an empty one. Extra columns are ignored.
    """
    fitted = StringKernelClassifier(landmarks)
    sample = labelled_sample(docs.where(fold(F.col("doc_id")) != 0).where(F.length(F.trim("text")) > 0), "lang", per_label)
    fitted.fit([t for t, _ in sample], [v for _, v in sample])
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for part in parts:
            for i in range(0, part.num_rows, 256):
                some = part.slice(i, 256)
                lang, score = m.predict(some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id")) == 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language(spark, sf_dir: str) -> DataFrame:
    return identify_language(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
