"""Rasters that arrive as files, and edits that arrive as events, as streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rastrel.operators import features
from rastrel.sources import rasters


def pixels_to_table(spark: SparkSession, path: str, table: str, state: str, once: bool = True) -> StreamingQuery:
    """Appends the pixels of TIFF files as they come to a folder to a Parquet table; each file counts once."""

    def pixels(it):
        for pdf in it:
            for name, raw in zip(pdf.path, pdf.content, strict=True):
                data, _ = rasters.parse_tiff(raw)
                for r in range(data.shape[1]):
                    yield pd.DataFrame({"raster_id": name.rpartition("/")[2], "r": r, "c": np.arange(data.shape[2]), "bands": list(data[:3, r].T.astype(float))}).astype({"r": "int32", "c": "int32"})

    out = rasters.arriving(spark, path).mapInPandas(pixels, "raster_id string, r int, c int, bands array<double>").writeStream.format("parquet").option("checkpointLocation", state)
    return (out.trigger(availableNow=True) if once else out).start(table)


def edits_to_table(edits: DataFrame, base: DataFrame, table: str, state: str, key: tuple[str, ...] = ("layer", "feature_id")) -> StreamingQuery:
    """Keeps a table of features under a stream of edits: each batch's last edits are merged into the newest version.

    Versions are folders by batch, so a batch that runs again writes the same version again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        before = base if number == 0 else batch.sparkSession.read.parquet(f"{table}/version={number - 1}")
        features.merged(before, batch, key).write.mode("overwrite").parquet(f"{table}/version={number}")

    return edits.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(availableNow=True).start()


def edit_counts(edits: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Edits of each kind in tumbling windows of their time (ts), late ones within the watermark counted."""
    return edits.withWatermark("ts", late).groupBy(F.window("ts", window), "op").agg(F.count("*").alias("edits"))
