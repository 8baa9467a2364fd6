"""Grids as NumPy files, written by the executors: a Data Source whose tasks fill bands of rows.

The file lies in a folder that driver and executors share. It is laid out by its header before any
cell is written; each task then writes whole rows at their own places, so that a task which runs
again, or twice, writes the same bytes. The commit fills rows that no task had with NaN and gives the
file its name; until then nothing of that name is touched.
"""

from __future__ import annotations

import io
import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Cells that a task holds at once.
BAND_CELLS = 2_000_000


def npy_header(height: int, width: int) -> bytes:
    f = io.BytesIO()
    np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": (height, width)})
    return f.getvalue()


@dataclass
class Bands(WriterCommitMessage):
    written: list[int] = field(default_factory=list)


class NpyWriter(DataSourceArrowWriter):
    """Takes (band, iy, ix, value) whose bands come one after another within a partition."""

    def __init__(self, options: dict) -> None:
        self.path, self.height, self.width, self.rows = options["path"], int(options["height"]), int(options["width"]), int(options["band_rows"])
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.head = npy_header(self.height, self.width)
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(self.part, "wb") as f:
            f.write(self.head)
            f.truncate(len(self.head) + 8 * self.height * self.width)

    def _put(self, band: int, iy: np.ndarray, ix: np.ndarray, value: np.ndarray) -> None:
        first = band * self.rows
        a = np.full((min(self.rows, self.height - first), self.width), np.nan)
        a[iy - first, ix] = value
        with open(self.part, "r+b") as f:
            f.seek(len(self.head) + 8 * self.width * first)
            f.write(a.tobytes())

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Bands:
        out, held, now = Bands(), [], None

        def end() -> None:
            if held:
                self._put(now, *[np.concatenate([h[i] for h in held]) for i in range(3)])
                out.written.append(int(now))
                held.clear()

        for batch in iterator:
            band, iy, ix, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "iy", "ix", "value"))
            at = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1], [True]))) if len(band) else []
            for low, high in zip(at[:-1], at[1:]):
                if band[low] != now:
                    end()
                    now = band[low]
                held.append((iy[low:high], ix[low:high], value[low:high].astype(float)))
        end()
        return out

    def commit(self, messages: list[Bands | None]) -> None:
        there = {b for m in messages if m is not None for b in m.written}
        none = np.array([], int)
        for band in range(-(-self.height // self.rows)):
            if band not in there:
                self._put(band, none, none, none.astype(float))
        os.replace(self.part, self.path)

    def abort(self, messages: list[Bands | None]) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class GridNpy(DataSource):
    """format("grid_npy"): options height, width and band_rows; written by `save_npy`."""

    @classmethod
    def name(cls) -> str:
        return "grid_npy"

    def schema(self) -> str:
        return "band long, iy int, ix int, value double"

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(dict(self.options))


def save_npy(cells: DataFrame, shape: tuple[int, int], path: str, column: str = "z", band_cells: int = BAND_CELLS) -> None:
    """(iy, ix, column) of one patch as an array of this shape, NaN where a cell is null or missing.

    The cells are dealt by bands of rows in one shuffle; no task holds more than a band.
    """
    height, width = shape
    rows = max(1, band_cells // max(1, width))
    spark: SparkSession = cells.sparkSession
    spark.dataSource.register(GridNpy)
    d = cells.select(F.floor(F.col("iy") / rows).cast("long").alias("band"), F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix"), F.coalesce(F.col(column).cast("double"), F.lit(float("nan"))).alias("value"))
    bands = -(-height // rows)
    n = max(1, min(bands, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    d = d.repartition(n, "band").sortWithinPartitions("band")
    d.write.format("grid_npy").options(height=height, width=width, band_rows=rows).mode("append").save(path)


def save_npz(path: str, arrays: dict) -> None:
    """An archive of arrays; a value that is (cells, shape, column) is written by the executors first, then packed.

    The driver copies such a file in pieces and never holds it.
    """
    path = path if path.endswith(".npz") else f"{path}.npz"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    whole = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with zipfile.ZipFile(whole, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
            for name, a in arrays.items():
                if isinstance(a, tuple):
                    cells, shape, column = a
                    inner = f"{whole}.npy"
                    save_npy(cells, shape, inner, column)
                    with open(inner, "rb") as f, archive.open(f"{name}.npy", "w", force_zip64=True) as to:
                        shutil.copyfileobj(f, to, 1 << 22)
                    os.remove(inner)
                else:
                    with archive.open(f"{name}.npy", "w", force_zip64=True) as to:
                        np.lib.format.write_array(to, np.asanyarray(a), allow_pickle=False)
        os.replace(whole, path)
    finally:
        for left in (whole, f"{whole}.npy"):
            if os.path.exists(left):
                os.remove(left)
