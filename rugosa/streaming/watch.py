"""New scan files, analysed as they come: a file stream whose batches are analysed scan by scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RoughnessConfig
from ..plans.analyze import analyze_patches


def write_figures(scans: DataFrame, epoch: int, out: str, config: RoughnessConfig) -> None:
    """A row of figures for each scan of a batch (scan, x, y, z), into the folder `epoch=<n>` of `out`.

    A batch that is retried overwrites its own folder, so nothing is written twice.
    """
    found = analyze_patches(scans.withColumn("patch", F.col("scan")), config).figures
    figures = ("svr_um", "sa_um", "sq_um", F.col("noise_floor_um").alias("noise_um"), "points", "error")
    found.select(F.col("patch").alias("scan"), *figures).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")


def watch_scans(spark: SparkSession, folder: str, out: str, config: RoughnessConfig | None = None, checkpoint: str | None = None):
    """Starts a stream over Parquet files (scan string, x, y, z); a row of figures for each scan goes to `out`.

    Each batch's scans are analysed in one plan. A scan must come whole in one batch; one that can't
    be analysed gives a row with its error.
    """
    stream = spark.readStream.schema("scan string, x double, y double, z double").parquet(folder)
    settings = config or RoughnessConfig()
    batch = lambda df, epoch: write_figures(df, epoch, out, settings)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or f"{out}-checkpoint").trigger(availableNow=True).start()
