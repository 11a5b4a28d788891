"""Telemetry: parsing subtitle text, validating, choosing the key of synchronisation.

Records that can't be used don't end a job: they go to a table of rejects with a reason;
strict=True raises instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import geo
from ..sources import listing

# The written forms of subtitle telemetry.
_TIME = r"(\d+):(\d+):(\d+)[,.](\d+)"
_NUMBER = r"([-\d.]+)"
_LAT = rf"(?i)\[\s*lat(?:itude)?\s*:\s*{_NUMBER}\s*\]"
_LON = rf"(?i)\[\s*lon(?:g(?:t)?itude)?\s*:\s*{_NUMBER}\s*\]"
_ALT = rf"(?i)\[\s*(?:altitude|abs_alt|rel_alt)\s*:\s*{_NUMBER}"
_PARENS = rf"(?i)GPS\s*\(\s*{_NUMBER}\s*,\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\)"
_FRAME = r"(?i)(?:FrameCnt|SrtCnt)\s*:\s*(\d+)"
_IMU = {k: rf"(?i)\[\s*gimbal_{k}\s*:\s*{_NUMBER}" for k in ("pitch", "yaw", "roll")}


#: What is interpolated of a record.
FIELDS = ("latitude", "longitude", "altitude_m", "gimbal_pitch", "gimbal_yaw", "gimbal_roll")


def number(text: Column, pattern: str, group: int = 1) -> Column:
    """The group as a double; null where it isn't found or isn't a number."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")


def subtitle_ms(text: Column) -> Column:
    """Milliseconds of the first HH:MM:SS,mmm; -1 where there is none."""
    parts = F.split(F.translate(F.regexp_extract(text, _TIME, 0), ",.", "::"), ":")
    part = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return F.coalesce(((part(0) * 60 + part(1)) * 60 + part(2)) * 1000 + part(3), F.lit(-1.0))


def once(rows: DataFrame, *fields: Column) -> DataFrame:
    """rows with fields after their columns, each evaluated once a row.

    The optimiser copies expressions into what uses them and into filters; a generator's
    output it leaves alone.
    """
    return rows.select("*", F.inline(F.array(F.struct(*fields))))


def position() -> Column:
    """struct(latitude, longitude, altitude_m) of the columns of subtitle_blocks: bracketed form first, then GPS(lon, lat, alt)."""
    of = lambda lat, lon, alt: F.struct(lat.alias("latitude"), lon.alias("longitude"), alt.alias("altitude_m"))
    lat, lon, a, b, c = (F.col(x) for x in ("lat", "lon", "p1", "p2", "p3"))
    bracketed = F.when(lat.isNotNull() & lon.isNotNull(), of(lat, lon, F.coalesce("alt", F.lit(0.0))))
    # a second number beyond 90 can only be a longitude
    swapped = (F.abs(b) > 90) & (F.abs(a) <= 90)
    parens = F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), of(F.when(swapped, a).otherwise(b), F.when(swapped, b).otherwise(a), c))
    return F.coalesce(bracketed, parens)


def subtitle_blocks(texts: DataFrame, strict: bool = False) -> DataFrame:
    """Every block of texts (flight_id, content) with its fields and, where it's unusable, a reason."""
    content = F.regexp_replace(F.regexp_replace("content", "\r\n", "\n"), r"^\s+|\s+$", "")
    blocks = texts.select("flight_id", F.posexplode(F.split(content, r"\n\s*\n")).alias("block", "text"))
    rows = F.split(F.trim("text"), "\n")
    timing = F.get(F.filter(rows, lambda x: x.contains(" --> ")), 0)
    parens = F.split(F.regexp_extract("text", _PARENS, 0), r"[(),]")
    found = once(blocks, rows.alias("rows"), timing.alias("timing"), parens.alias("parens"))
    found = once(
        found,
        *[number(F.col("text"), p).alias(c) for c, p in (("lat", _LAT), ("lon", _LON), ("alt", _ALT))],
        *[F.trim(F.get("parens", F.lit(i))).try_cast("double").alias(f"p{i}") for i in (1, 2, 3)],
        *[number(F.col("text"), p).alias(f"i_{k}") for k, p in _IMU.items()],
        F.regexp_extract("text", _FRAME, 1).try_cast("long").alias("count"),
        subtitle_ms(F.substring_index("timing", " --> ", 1)).alias("timestamp_ms"),
        F.size("rows").alias("n"),
    )
    whole = F.col("i_pitch").isNotNull() & F.col("i_yaw").isNotNull() & F.col("i_roll").isNotNull()
    imu = F.when(whole, F.struct(*[F.col(f"i_{k}").alias(f"gimbal_{k}") for k in _IMU]))
    body = found.select("flight_id", "block", "text", "n", "timing", position().alias("gps"), imu.alias("imu"), "count", "timestamp_ms")
    in_range = F.col("gps.latitude").between(-90, 90) & F.col("gps.longitude").between(-180, 180)
    reason = F.when(F.col("n") < 2, "short").when(F.col("timing").isNull(), "no timing").when(F.col("timestamp_ms") < 0, "bad time").when(F.col("gps").isNull(), "no position").when(~in_range, "out of range")
    if strict:
        reason = F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit("unusable block: "), reason)).cast("string"))
    return body.withColumn("reason", reason)


def parse_subtitles(texts: DataFrame, strict: bool = False) -> DataFrame:
    """Telemetry records of subtitle texts, by flight and block.

    frame_idx is the frame counter less one, else the number of records accepted before.
    """
    good = subtitle_blocks(texts, strict).where("reason is null")
    before = F.row_number().over(Window.partitionBy("flight_id").orderBy("block")) - 1
    return good.select("flight_id", "block", "timestamp_ms", F.coalesce(F.col("count") - 1, before.cast("long")).alias("frame_idx"), "gps.*", "imu.*")


def rejected_subtitles(texts: DataFrame) -> DataFrame:
    return subtitle_blocks(texts).where("reason is not null").select("flight_id", "block", "reason", "text")


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """(flight_id, content) of each file: the path's last part without its ending is the flight."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
    return spark.read.text(path, wholetext=True).select(name.alias("flight_id"), F.col("value").alias("content"))


RECORD = (
    "timestamp_ms double, frame_idx long, latitude double, longitude double, altitude_m double, gimbal_pitch double, gimbal_yaw double, gimbal_roll double, "
    "gps struct<latitude: double, longitude: double, altitude_m: double, gimbal_pitch: double, gimbal_yaw: double, gimbal_roll: double>"
)


def records_json(records: DataFrame) -> DataFrame:
    """flight_id, name, value: each flight's records as one JSON array in order of time, under <flight>_gps.json.

    A flight of flights (flight_id) without a record is an error where the array is written: see write_records.
    """
    fields = [c for c in records.columns if c not in ("flight_id", "block", "seq")]
    order = F.struct("timestamp_ms", *[c for c in ("block", "seq") if c in records.columns], F.struct(*fields).alias("r"))
    each = records.groupBy("flight_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["r"]).alias("rows"))
    return each.select("flight_id", F.format_string("%s_gps.json", F.col("flight_id").cast("string")).alias("name"), F.to_json("rows").alias("value"))


def write_records(texts: DataFrame, path: str) -> None:
    """Subtitle texts (flight_id, content) as a folder of JSON arrays, one a flight; raises if one has no usable record."""
    records = parse_subtitles(texts)
    empty = texts.select("flight_id").distinct().join(records.select("flight_id").distinct(), "flight_id", "left_anti").limit(1).collect()
    if empty:
        raise ValueError(f"no position in the subtitles of {empty[0][0]}")
    records_json(records).select("name", "value").write.mode("overwrite").partitionBy("name").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of records, flat or nested under gps, one file a flight; raises where there is no record at all."""
    raw = spark.read.schema(RECORD).json(path, multiLine=True)
    if raw.isEmpty():
        raise ValueError(f"no telemetry record under {path}")
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
    own = lambda c: F.coalesce(F.col(f"gps.{c}"), F.col(c)).alias(c)
    return raw.select(name.alias("flight_id"), "timestamp_ms", "frame_idx", *map(own, ("latitude", "longitude", "altitude_m", "gimbal_pitch", "gimbal_yaw", "gimbal_roll")))


def violation(strict: bool = False) -> Column:
    """The first rule that a record breaks, or null."""
    c = F.col
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    missing = c("latitude").isNull() | c("longitude").isNull() | c("altitude_m").isNull()
    code = (
        F.when(missing, "missing field")
        .when(~(finite(c("latitude")) & finite(c("longitude")) & finite(c("altitude_m"))), "not finite")
        .when(~c("latitude").between(-90, 90), "latitude")
        .when(~c("longitude").between(-180, 180), "longitude")
        .when(c("timestamp_ms").isNull() & c("frame_idx").isNull(), "no key")
        .when(c("timestamp_ms").isNotNull() & ~finite(c("timestamp_ms")), "not finite")
        .when(c("frame_idx") < 0, "negative frame")
    )
    return F.when(code.isNotNull(), F.raise_error(F.concat(F.lit("telemetry: "), code)).cast("string")) if strict else code


def sync_keys(records: DataFrame, mode: str = "auto") -> DataFrame:
    """flight_id, sync_key: the key all of a flight's records have (time first), or an error."""
    all_have = lambda x: F.bool_and(F.col(x).isNotNull())
    found = records.groupBy("flight_id").agg(all_have("timestamp_ms").alias("timed"), all_have("frame_idx").alias("framed"))
    wanted = {"auto": F.lit(True), "timestamp": F.lit(True), "frame": F.lit(False)}[mode]
    key = F.when(F.col("timed") & wanted, "timestamp_ms")
    if mode != "timestamp":
        key = key.when(F.col("framed"), "frame_idx")
    return found.select("flight_id", key.otherwise("error").alias("sync_key"))


def _covered(records: DataFrame, frames: DataFrame, key: str, at: str, unit: str, tolerance: float) -> DataFrame:
    r = records.groupBy("flight_id").agg(F.min(key).alias(f"first_{unit}"), F.max(key).alias(f"last_{unit}"), F.count("*").alias("n_records"))
    f = frames.groupBy("flight_id").agg(F.min(at).alias(f"video_first_{unit}"), F.max(at).alias(f"video_last_{unit}"))
    covered = (F.col(f"first_{unit}") <= F.col(f"video_first_{unit}") + tolerance) & (F.col(f"last_{unit}") >= F.col(f"video_last_{unit}") - tolerance)
    return r.join(f, "flight_id").withColumn("covered", covered)


def coverage(records: DataFrame, frames: DataFrame, tolerance_ms: float = 5000.0) -> DataFrame:
    """Per flight: the range of records, of frames, and whether the records reach over the frames."""
    return _covered(records, frames, "timestamp_ms", "ms", "ms", tolerance_ms)


def frame_coverage(records: DataFrame, frames: DataFrame, tolerance: int = 150) -> DataFrame:
    """The same by frame numbers, for flights that are synchronised by frame."""
    return _covered(records, frames, "frame_idx", "raw_i", "frame", tolerance)


def pitch(records: DataFrame, steep: float = 60.0, enough: int = 3) -> DataFrame:
    """Per flight the median pitch of its records with one, and whether the camera looks down; nulls below `enough`. A diagnostic."""
    found = records.groupBy("flight_id").agg(F.count("gimbal_pitch").alias("n_pitch"), F.median("gimbal_pitch").alias("m"))
    median = F.when(F.col("n_pitch") >= enough, F.col("m"))
    return found.select("flight_id", "n_pitch", median.alias("median_pitch"), (F.abs(median) > steep).alias("nadir"))


def summary(records: DataFrame) -> DataFrame:
    """Ranges, duration and number of records with attitude of each flight."""
    spans = [f(c).alias(f"{f.__name__}_{c}") for c in ("latitude", "longitude", "altitude_m") for f in (F.min, F.max)]
    return records.groupBy("flight_id").agg(F.count("*").alias("n_records"), *spans, F.max("timestamp_ms").alias("duration_ms"), F.count("gimbal_pitch").alias("n_imu"), F.median("gimbal_pitch").alias("median_pitch"))


def discover(spark: SparkSession, folders: list[str], stem: str) -> str | None:
    """The telemetry file of a video: a subtitle of its name, a JSON file of its name, else the only one of a kind.

    A folder that isn't there has no files; any other fault in reading one is raised.
    """
    found = []
    for rank, folder in enumerate(folders):
        names = [r[0] for r in listing.files(spark, folder, missing=True).select("path").collect()]
        for kind, ending in enumerate((".srt", ".json")):
            own = sorted(n for n in names if n.lower().endswith(ending))
            found += [((kind, rank), n) for n in own if n.rsplit("/", 1)[-1].rsplit(".", 1)[0] in (stem, f"{stem}_gps")]
            found += [((2 + kind, rank), n) for n in own] if len(own) == 1 else []
    return min(found)[1] if found else None


def synthetic_track(spark: SparkSession, frames: int, lat0: float, lon0: float) -> DataFrame:
    """A made-up drift for demonstrations, marked as synthetic."""
    i = F.col("id").cast("double")
    return spark.range(frames).select(F.col("id").alias("frame_idx"), (lat0 + 1e-5 * i).alias("latitude"), (lon0 + 2e-5 * i).alias("longitude"), (50 + 0.5 * F.sin(i / 10)).alias("altitude_m"), F.lit(True).alias("synthetic"))


def origins(records: DataFrame) -> DataFrame:
    """flight_id, latitude, longitude, altitude_m of each flight's first record (by time, then seq)."""
    first = F.min_by(F.struct("latitude", "longitude", "altitude_m"), F.struct("timestamp_ms", "seq")).alias("o")
    return records.groupBy("flight_id").agg(first).select("flight_id", "o.*")


def with_enu(records: DataFrame) -> DataFrame:
    """records with x, y, z from each flight's origin."""
    own = ("latitude", "longitude", "altitude_m")
    from_ = origins(records).select("flight_id", *[F.col(c).alias(f"__{c}") for c in own])
    return records.join(from_, "flight_id").select(records["*"], *geo.enu(*map(F.col, own), *[F.col(f"__{c}") for c in own]))
