"""Image files to pixel rows. Spark's image source decodes in the JVM; Python only reshapes the bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schemas import IMAGE_PIXELS


def rejected_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id) of the files that do not decode."""
    return spark.read.format("image").option("dropInvalid", False).load(path).filter("image.height <= 0").selectExpr(
        "image.origin AS image_id")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """The files that decode; rejected_images() lists the others."""
    return (
        spark.read.format("image").option("dropInvalid", False).load(path).filter("image.height > 0")
        .selectExpr("image.origin AS image_id", "image.height AS height", "image.width AS width",
                    "image.nChannels AS channels", "image.data AS data")
    )


def image_pixels(images: DataFrame, rows_per_batch: int = 100_000) -> DataFrame:
    """One row per pixel. The decoder stores 3- and 4-channel pixels as B, G, R[, A] and grey ones as one byte."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image in batch.itertuples(index=False):
                flat = np.frombuffer(image.data, dtype=np.uint8).reshape(-1, image.channels)
                blue = flat[:, 0]
                green = flat[:, 1] if image.channels >= 3 else blue
                red = flat[:, 2] if image.channels >= 3 else blue
                for start in range(0, len(flat), rows_per_batch):
                    part = slice(start, start + rows_per_batch)
                    index = np.arange(start, min(start + rows_per_batch, len(flat)), dtype=np.int64)
                    yield pd.DataFrame({
                        "image_id": image.image_id,
                        "x": (index % image.width).astype(np.int32),
                        "y": (index // image.width).astype(np.int32),
                        "r": red[part].astype(np.int32),
                        "g": green[part].astype(np.int32),
                        "b": blue[part].astype(np.int32),
                        "height": np.int32(image.height),
                        "width": np.int32(image.width),
                    })

    return images.mapInPandas(explode, IMAGE_PIXELS)
