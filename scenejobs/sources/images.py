"""Raster tables as image files: a PNG encoder and a Spark data source that writes one file a row."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FILES = "name string, data binary"


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG file of height x width x 3 bytes, without filters."""
    height, width, _ = pixels.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.zeros((height, 1 + 3 * width), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = pixels.reshape(height, -1)
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


class FileSink(DataSource):
    """Writes the data of each row to a file of its name in the folder that the option path names."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return FILES

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"])


class _FileWriter(DataSourceWriter):
    """A file appears under its name only once it is whole, so tasks may run again."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        for row in iterator:
            part = f"{folder}/.{row.name}-{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(row.data)
            store.move(part, f"{folder}/{row.name}")
        return WriterCommitMessage()


def write_pixels(pixels: DataFrame, path: str) -> None:
    """One PNG file <image_id>.png in path for each image of pixels (image_id, row, col, r, g, b in [0, 1]).

    An image is as large as its last row and column; pixels that are missing are black, values
    are rounded to 255ths (halves up) and held to [0, 1]. Images are independent groups.
    """

    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        row, col = frame["row"].to_numpy(), frame["col"].to_numpy()
        image = np.zeros((row.max() + 1, col.max() + 1, 3), np.uint8)
        image[row, col] = np.clip(np.floor(frame[["r", "g", "b"]].to_numpy(dtype=float) * 255 + 0.5), 0, 255)
        return pd.DataFrame({"name": [f"{frame['image_id'].iloc[0]}.png"], "data": [encode_png(image)]})

    pixels.sparkSession.dataSource.register(FileSink)
    pixels.select("image_id", "row", "col", "r", "g", "b").groupBy("image_id").applyInPandas(encode, FILES).write.format(FileSink.name()).option("path", path).mode("append").save()
