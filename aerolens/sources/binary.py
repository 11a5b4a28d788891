"""Binary point and raster files, made as parts that concatenate in order.

A table of parts has low (its place; null for the header) and content (binary); points are
packed by the tasks that hold them, after one range sort, so no task sees a whole cloud.
save() streams the parts of one file to disk, one partition at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files

# The point record of format 3 and the header size of version 1.4.
RECORD = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("classification", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2"), ("time", "<f8"), ("r", "<u2"), ("g", "<u2"), ("b", "<u2")])
HEADER_BYTES = 375
GROUND = 110  # grey of raster cells without points
STRIP_ROWS = 64


def points_header(n: int, scale: list[float], low: list[float], high: list[float]) -> bytes:
    legacy = n if n < 1 << 32 else 0
    head = struct.pack("<4sHH16sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, bytes(16), 1, 4, b"OTHER", b"aerolens", 1, 2000, HEADER_BYTES, HEADER_BYTES, 0, 3, RECORD.itemsize, legacy, legacy, 0, 0, 0, 0)
    extremes = [v for a, b in zip(high, low, strict=True) for v in (a, b)]
    return head + struct.pack("<12dQQIQ15Q", *scale, *low, *extremes, 0, 0, 0, n, n, *[0] * 14)


def points_parts(points: DataFrame, box: DataFrame, order: str) -> DataFrame:
    """(flight_id, low, content) of the binary point file of each flight; box is cloud.bounds(points, ["flight_id"])."""

    def head(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            made = [points_header(int(r.n_points), *[[float(getattr(r, f"{t}_{c}")) for c in "xyz"] for t in ("scale", "min", "max")]) for r in batch.itertuples()]
            yield pd.DataFrame({"flight_id": batch["flight_id"], "low": None, "content": made})

    def body(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for flight, group in batch.groupby("flight_id", sort=False):
                packed = np.zeros(len(group), RECORD)
                packed["returns"] = 0b001001  # first of one
                for c in "xyz":
                    packed[c] = group[f"i{c}"]
                for c in "rgb":
                    packed[c] = group[f"c{c}"]
                yield pd.DataFrame({"flight_id": [flight], "low": [group[order].iloc[0]], "content": [packed.tobytes()]})

    kind = points.schema["flight_id"].dataType.simpleString()
    schema = f"flight_id {kind}, low {points.schema[order].dataType.simpleString()}, content binary"
    scaled = files.scaled_coordinates(points, box, ["flight_id"], (order,))
    return box.mapInPandas(head, schema).unionByName(scaled.repartitionByRange("flight_id", order).sortWithinPartitions("flight_id", order).mapInPandas(body, schema))


def raster_header(side: int, west: float, south: float, east: float, north: float) -> bytes:
    """Header and directory of an uncompressed colour raster of side x side cells in degrees."""
    strips = -(-side // STRIP_ROWS)
    sizes = [min(STRIP_ROWS, side - i * STRIP_ROWS) * side * 3 for i in range(strips)]
    scale = struct.pack("<3d", (east - west) / side, (north - south) / side, 0.0)
    tie = struct.pack("<6d", 0, 0, 0, west, north, 0)
    # A geographic model, cells as areas, coordinates of EPSG 4326.
    keys = struct.pack("<16H", 1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)
    kinds = {"H": 3, "I": 4, "d": 12}
    # Tag numbers, in ascending order; their kinds and values.
    tags = [(256, "I", [side]), (257, "I", [side]), (258, "H", [8, 8, 8]), (259, "H", [1]), (262, "H", [2]), (273, "I", [0] * strips), (277, "H", [3]), (278, "I", [STRIP_ROWS]), (279, "I", sizes), (284, "H", [1]), (33550, "d", scale), (33922, "d", tie), (34735, "H", keys)]
    start = 8 + 2 + 12 * len(tags) + 4
    packed = [v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{k}", *v) for _, k, v in tags]
    total = start + sum(len(p) for p in packed if len(p) > 4)
    offsets = struct.pack(f"<{strips}I", *[total + sum(sizes[:i]) for i in range(strips)])
    packed[[t for t, _, _ in tags].index(273)] = offsets
    entries, more = b"", b""
    for (tag, k, _), p in zip(tags, packed, strict=True):
        entries += struct.pack("<HHI", tag, kinds[k], len(p) // struct.calcsize(f"<{k}"))
        entries += p.ljust(4, b"\0") if len(p) <= 4 else struct.pack("<I", start + len(more))
        more += p if len(p) > 4 else b""
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + entries + bytes(4) + more


def raster_parts(cells: DataFrame, extents: DataFrame, side: int = 1024) -> DataFrame:
    """(flight_id, low, content) of each flight's raster file, from cloud.raster's cells.

    extents: flight_id, west, south, east, north. A strip of STRIP_ROWS rows is one group,
    of at most STRIP_ROWS * side cells; strips without points are made too.
    """

    def head(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            yield pd.DataFrame({"flight_id": batch["flight_id"], "low": None, "content": [raster_header(side, r.west, r.south, r.east, r.north) for r in batch.itertuples()]})

    def strip(rows: pd.DataFrame) -> pd.DataFrame:
        low = int(rows["low"].iloc[0])
        image = np.full((min(STRIP_ROWS, side - low * STRIP_ROWS), side, 3), GROUND, np.uint8)
        own = rows[rows["gx"].notna()]
        image[own["gy"].astype(int) - low * STRIP_ROWS, own["gx"].astype(int)] = own[["r", "g", "b"]].astype(int)
        return pd.DataFrame({"flight_id": [rows["flight_id"].iloc[0]], "low": [low], "content": [image.tobytes()]})

    kind = extents.schema["flight_id"].dataType.simpleString()
    schema = f"flight_id {kind}, low int, content binary"
    every = extents.select("flight_id", F.explode(F.sequence(F.lit(0), F.lit(-(-side // STRIP_ROWS) - 1))).alias("low"))
    placed = cells.select("flight_id", F.floor(F.col("gy") / STRIP_ROWS).cast("int").alias("low"), "gx", "gy", "r", "g", "b")
    strips = every.join(placed, ["flight_id", "low"], "left").groupBy("flight_id", "low").applyInPandas(strip, schema)
    return extents.mapInPandas(head, schema).unionByName(strips)


def save(parts: DataFrame, path: str) -> None:
    """One flight's parts, in order, as one local file: the driver holds one partition at a time."""
    with open(path, "wb") as out:
        for row in parts.orderBy(F.col("low").asc_nulls_first()).select("content").toLocalIterator():
            out.write(row[0])
