"""A whole run: from the tables of many flights to georeferenced clouds, cameras, reports and a manifest.

In source, as Parquet: telemetry (flight_id long, seq, timestamp_ms, latitude, longitude,
altitude_m, sharpness), points (flight_id, pt_id, k, px_row, px_col, x, y, z, conf, r, g, b)
and, where they exist, mask (flight_id, k, px_row, px_col) and poses (flight_id, name, x, y, z).

In place of telemetry may stand subtitles (flight_id, content) and frames (flight_id, raw_i, ms,
sharpness) with videos (flight_id, fps): see prepared().
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, cloud, sync, telemetry
from ..sources import files, listing


@dataclass(frozen=True)
class Settings:
    least_move_m: float = 2.0
    least_sharpness: float = 40.0
    least_confidence: float = cloud.CONFIDENT
    target_m: float = 1.0
    masked: bool = True
    posed: bool = False
    verified: bool = False
    target_fps: float = 5.0
    max_gap_ms: float = 2000.0
    cloud_budget: int = 2_000_000


#: The share of a run, in per cent, that is done when a part is.
PARTS = {"telemetry": 10, "keyframes": 27, "control": 40, "transforms": 66, "cameras": 72, "cloud": 80, "report": 94, "manifest": 100}


class Cancelled(Exception):
    """Raised by a progress callback to end a run after the part at hand."""


def cancel(spark: SparkSession, run_id: str) -> None:
    """End the jobs of the run with this id, also from another thread."""
    spark.sparkContext.cancelJobsWithTag(f"aerolens-{run_id}")


class Unusable(ValueError):
    """Telemetry that a run can't work with; says which flight and why."""


def _none(rows: DataFrame, why: str) -> None:
    found = rows.limit(1).collect()
    if found:
        raise Unusable(f"flight {found[0]['flight_id']}: {why}")


def prepared(subtitles: DataFrame, frames: DataFrame, videos: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A run's telemetry table, from subtitles: parsed, validated, synchronised, interpolated at the sampled frames.

    Flights by time need records over the whole video (coverage()), flights by frame number
    too (frame_coverage()); frames in a gap of over max_gap_ms are left out. A flight without
    records, with a mixture of keys or without coverage is an error.
    """
    records = telemetry.parse_subtitles(subtitles)
    records = records.where(telemetry.violation().isNull())
    _none(subtitles.select("flight_id").distinct().join(records.select("flight_id").distinct(), "flight_id", "left_anti"), "no usable record")
    keys = telemetry.sync_keys(records)
    _none(keys.where("sync_key = 'error'"), "its records share no key")
    sampled = sync.sampled_videos(frames, videos, settings.target_fps)
    by = lambda key: keys.where(F.col("sync_key") == key).select("flight_id")
    timed, framed = (records.join(by(key), "flight_id", "left_semi") for key in ("timestamp_ms", "frame_idx"))
    _none(telemetry.coverage(timed, sampled).where("not covered"), "its telemetry doesn't cover the video")
    _none(telemetry.frame_coverage(framed, sampled).where("not covered"), "its telemetry doesn't cover the video")
    samples = timed.withColumn("ms", F.col("timestamp_ms")).unionByName(framed.withColumn("ms", F.col("frame_idx").cast("double")))
    targets = sampled.join(keys, "flight_id").select("flight_id", F.when(F.col("sync_key") == "timestamp_ms", F.col("ms")).otherwise(F.col("raw_i").cast("double")).alias("ms"), F.col("raw_i").alias("seq"), "sharpness", F.col("ms").alias("timestamp_ms"))
    placed = sync.interpolate(samples.select("flight_id", "ms", F.col("block").alias("seq"), *telemetry.FIELDS), targets, settings.max_gap_ms)
    return placed.where("not too_wide").select("flight_id", "seq", "timestamp_ms", *telemetry.FIELDS, "sharpness")


def control_points(frames: DataFrame, records: DataFrame, points: DataFrame, poses: DataFrame | None, settings: Settings) -> DataFrame:
    """Cameras, registered or from the point maps, with the metres of their telemetry."""
    placed = telemetry.with_enu(records).join(frames, ["flight_id", "seq"])
    positions = placed.select("flight_id", "k", F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w"))
    proxies = cloud.camera_centres(points, settings.least_confidence, strict=True).select("flight_id", "k", "x", "y", "z")
    named = frames.select("flight_id", "k", F.format_string("frame_%05d.jpg", "k").alias("name"))
    registered = proxies.where("false") if poses is None else sync.registered_cameras(named, poses).drop("posed")
    return sync.paired_cameras(registered, proxies, positions)


def manifest(points: DataFrame, mask: DataFrame, control: DataFrame, transforms: DataFrame, kept: DataFrame, out: str, settings: Settings) -> DataFrame:
    """One JSON document a flight: counts, the masked share, its scale, where its tables are, and where the accuracy comes from."""
    counts = cloud.mask_statistics(points, mask, settings.least_confidence).join(control.groupBy("flight_id").agg(F.count("*").alias("cameras")), "flight_id", "left")
    counts = counts.join(transforms.select("flight_id", "scale", "rolled"), "flight_id", "left").join(kept.groupBy("flight_id").agg(F.count("*").alias("written")), "flight_id", "left")
    said = F.struct(*[F.lit(v).alias(k) for k, v in asdict(settings).items()])
    paths = F.struct(*[F.lit(f"{out}/{n}").alias(n) for n in PARTS])
    source = F.lit("verified" if settings.verified else "unknown").alias("gps_source")
    fields = ["flight_id", "total", "masked", "valid", "masked_fraction", F.coalesce("written", F.lit(0)).alias("written"), F.coalesce("cameras", F.lit(0)).alias("cameras"), "scale", "rolled", source, paths.alias("paths"), said.alias("settings")]
    return counts.select("flight_id", F.to_json(F.struct(*fields)).alias("value"))


def report(spark: SparkSession, out: str, settings: Settings) -> DataFrame:
    """The hold-out report of a finished run: it scores the cameras before they were moved to their positions."""
    found = align.hold_out_report(spark.read.parquet(f"{out}/control"), settings.target_m, cloud_moments=spark.read.parquet(f"{out}/moments"))
    return found.withColumn("accuracy_claim_allowed", F.lit(settings.verified))


def run(spark: SparkSession, source: str, out: str, settings: Settings = Settings(), progress: Callable[[int, str], None] = lambda share, part: None, run_id: str = "run") -> None:
    """Write telemetry, keyframes, control, moments, transforms, cameras, cloud, report (Parquet), report.json, frame.json and manifest (JSON lines) under out.

    progress hears of each part that is done and may raise Cancelled; cancel(spark, run_id) ends jobs at once.
    """
    read = lambda name: spark.read.parquet(f"{source}/{name}")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        if name in PARTS:
            progress(PARTS[name], name)
        return spark.read.parquet(f"{out}/{name}")

    def texts(df: DataFrame, name: str) -> None:
        df.select("value").write.mode("overwrite").text(f"{out}/{name}")

    spark.sparkContext.addJobTag(f"aerolens-{run_id}")
    try:
        points = read("points")
        mask = read("mask") if settings.masked else points.select(*cloud.PIXEL).where("false")
        raw = listing.files(spark, f"{source}/subtitles", missing=True).isEmpty()
        records = kept(read("telemetry") if raw else prepared(read("subtitles"), read("frames"), read("videos"), settings), "telemetry")
        frames = kept(sync.keyframes(records, settings.least_move_m, settings.least_sharpness), "keyframes")
        control = kept(control_points(frames, records, points, read("poses") if settings.posed else None, settings), "control")
        clean = cloud.masked_cloud(points, mask, settings.least_confidence)
        moments = kept(cloud.moments(clean, ["flight_id"]), "moments")
        _none(points.select("flight_id").distinct().join(moments, "flight_id", "left_anti"), "mask and confidence leave no point")
        transforms = kept(align.fit_transforms(control, moments), "transforms")
        kept(align.georeference(control, moments), "cameras")
        written = kept(align.apply_transforms(cloud.voxel_downsample(clean, settings.cloud_budget, ["flight_id"]), transforms), "cloud")
        texts(align.report_json(kept(report(spark, out, settings), "report"), settings.target_m, "verified" if settings.verified else "unknown"), "report.json")
        texts(files.frame_json(telemetry.origins(records)), "frame.json")
        texts(manifest(points, mask, control, transforms, written, out, settings), "manifest")
        progress(PARTS["manifest"], "manifest")
    finally:
        spark.sparkContext.removeJobTag(f"aerolens-{run_id}")
