"""Array files (.npy) as rows: point maps and confidences of reconstructions."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"\x93NUMPY"
#: Pixels of one batch of rows.
BATCH = 1 << 17


def header(content: bytes) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    """Type, column-major flag, shape and start of the data of a .npy file's bytes. Objects are refused."""
    if content[:6] != MAGIC:
        raise ValueError("not an array file")
    wide = content[6] >= 2
    (length,) = struct.unpack_from("<I" if wide else "<H", content, 8)
    start = 12 if wide else 10
    said = ast.literal_eval(content[start : start + length].decode("utf-8" if content[6] >= 3 else "latin1"))
    kind = np.dtype(said["descr"])
    if kind.hasobject:
        raise ValueError("arrays of objects aren't read")
    return kind, bool(said["fortran_order"]), tuple(said["shape"]), start + length


def array_of(content: bytes) -> np.ndarray:
    kind, column_major, shape, start = header(content)
    return np.frombuffer(content, kind, int(np.prod(shape)), start).reshape(shape, order="F" if column_major else "C")


def framed(array: np.ndarray, height: int, width: int, values: int) -> np.ndarray:
    """(frames, height, width, values) of an array whose frames, or frames and pixels, may be flattened."""
    pixels = array.size // values
    if array.size % values or pixels % (height * width) or values > 1 and array.shape[-1:] != (values,):
        raise ValueError(f"shape {array.shape} has no frames of {height} x {width} x {values}")
    return array.reshape(-1, height, width, values)


def read_arrays(spark: SparkSession, path: str, height: int, width: int, names: list[str]) -> DataFrame:
    """path, k, px_row, px_col and one double per name, from every .npy file under path.

    Files are read by Spark, so any store will do; a file is one task's work and at most
    2 GB (a binary column's limit). Its pixels go out in batches. An array without frames
    gives no rows.
    """
    types = [pa.string(), *[pa.int64()] * 3, *[pa.float64()] * len(names)]
    columns = ["path", "k", "px_row", "px_col", *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                frames = framed(array_of(content.as_py()), height, width, len(names))
                flat = frames.reshape(-1, len(names))
                for low in range(0, len(flat), BATCH):
                    part = flat[low : low + BATCH].astype(float)
                    at = np.arange(low, low + len(part))
                    rows = [[name] * len(part), at // (height * width), at // width % height, at % width, *part.T]
                    yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, k long, px_row long, px_col long, " + ", ".join(f"{n} double" for n in names))
