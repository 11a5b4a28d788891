"""Reading and writing the formats around reconstructions: ASCII PLY, pose lists, JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from . import listing


def write_ply(points: DataFrame, path: str, order: Column) -> None:
    """ASCII PLY as text parts that concatenate in name order: a part with the header, then the sorted rows."""
    n = points.count()
    names = [*(f"property float {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue"))]
    head = "\n".join(["ply", "format ascii 1.0", f"element vertex {n}", *names, "end_header"])
    rows = points.orderBy(order).select(F.format_string("%.4f %.4f %.4f %d %d %d", "x", "y", "z", *[geo.quantised(F.col(c), 255) for c in "rgb"]).alias("value"))
    points.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/0-header")
    rows.write.mode("overwrite").text(f"{path}/1-vertices")


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, r, g, b (shares) of ASCII PLY text, in one file or in parts; missing colours are grey. No vertex is an error.

    Vertices are the lines of three or six numbers and more that follow a header; lines of headers
    hold none. Faces begin with their number of corners: a line of 1 + that many whole numbers is none.
    """
    parts = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    whole = F.forall(parts, lambda x: x.rlike(r"^\d+$"))
    face = whole & (F.size(parts) > 3) & (F.size(parts) < 6) & (at(1) == F.size(parts) - 1)
    numbers = F.forall(parts, lambda x: x.try_cast("double").isNotNull())
    lines = spark.read.text(path, recursiveFileLookup=True).where(numbers & (F.size(parts) >= 3) & ~face)
    rows = lines.select(*[at(i).alias(c) for i, c in enumerate(("x", "y", "z", "r", "g", "b"), 1)])
    if rows.isEmpty():
        raise ValueError(f"no vertex under {path}")
    top = rows.agg(F.max(F.greatest("r", "g", "b")).alias("top"))
    share = lambda c: F.coalesce(F.when(F.col("top") > 1, F.col(c) / 255).otherwise(F.col(c)), F.lit(0.5)).alias(c)
    return rows.crossJoin(F.broadcast(top)).select("x", "y", "z", *map(share, "rgb"))  # top is one row


def read_newest_ply(spark: SparkSession, folder: str) -> DataFrame:
    """read_ply of the .ply file in folder that was written last."""
    found = listing.newest(listing.files(spark, folder, "*.ply")).select("path").collect()
    if not found:
        raise ValueError(f"no .ply file under {folder}")
    return read_ply(spark, found[0][0])


# The coordinate frame of local clouds, as the side file names it.
_FRAME = {"coordinate_frame": "local_enu_meters", "horizontal_reference": "WGS-84 tangent-plane approximation", "vertical_reference": "input telemetry altitude_m; datum not inferred"}
_AXES = {"x": "east_m", "y": "north_m", "z": "up_m"}


def frame_json(origins: DataFrame) -> DataFrame:
    """flight_id, value: the side file of a cloud in local metres, from its origin (flight_id, latitude, longitude, altitude_m)."""
    own = [F.col(c).cast("double").alias(f"origin_{c}") for c in ("latitude", "longitude", "altitude_m")]
    said = [F.lit(v).alias(k) for k, v in _FRAME.items()]
    axes = F.struct(*[F.lit(v).alias(k) for k, v in _AXES.items()]).alias("axis_order")
    return origins.select("flight_id", F.to_json(F.struct(*said, *own, axes)).alias("value"))


def parse_poses(texts: DataFrame) -> DataFrame:
    """(flight_id, name, x, y, z) camera centres of pose lists (flight_id, content): every second line that isn't a comment."""
    rows = F.filter(F.split("content", r"\r?\n"), lambda x: (F.length(F.trim(x)) > 0) & ~F.trim(x).startswith("#"))
    lines = texts.select("flight_id", F.posexplode(rows).alias("i", "line")).where("i % 2 = 0")
    t = F.split(F.trim("line"), r"\s+")
    fields = lines.where(F.size(t) >= 10).select("flight_id", F.array_join(F.slice(t, 10, 10_000), " ").alias("name"), *[t[j].try_cast("double").alias(f"p{j}") for j in range(1, 8)])
    p = [F.col(f"p{j}") for j in range(1, 8)]
    return fields.dropna().select("flight_id", "name", *geo.pose_centre(p[:4], p[4:]))


def transforms_json(cameras: DataFrame, view_angle: float = 1.047) -> DataFrame:
    """One JSON document a flight: shared rotation, each frame's centre."""
    unit = lambda i: [F.lit(1.0 if i == j else 0.0) for j in range(3)]
    rows = [F.array(*unit(i), F.col(c)) for i, c in enumerate("xyz")] + [F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])]
    frame = F.struct(F.col("k"), F.format_string("frame_%05d.jpg", F.col("k")).alias("file_path"), F.array(*rows).alias("transform_matrix"))
    each = cameras.groupBy("flight_id").agg(F.array_sort(F.collect_list(frame)).alias("f"))
    frames = F.transform("f", lambda x: F.struct(x["file_path"], x["transform_matrix"]))
    return each.select("flight_id", F.to_json(F.struct(F.lit(view_angle).alias("camera_angle_x"), frames.alias("frames"))).alias("value"))


def scaled_coordinates(points: DataFrame, box: DataFrame, by: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Whole-number coordinates and 16-bit colours of the binary point format, after the columns to keep."""
    joined = points.join(box, by)
    whole = [F.round((F.col(c) - F.col(f"min_{c}")) / F.col(f"scale_{c}")).cast("long").alias(f"i{c}") for c in "xyz"]
    return joined.select(*by, *keep, *whole, *[geo.quantised(F.col(c), 65535).alias(f"c{c}") for c in "rgb"])
