"""Frames and telemetry in time: two-sided as-of join, keyframes, windows over views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import geo

#: A flight's time is cut into stretches of this length, so that a long flight isn't one task's.
STRETCH_MS = 3_600_000.0
FIELDS = ("latitude", "longitude", "altitude_m", "gimbal_pitch", "gimbal_yaw", "gimbal_roll")


def sampled_frames(frames: DataFrame, interval: int) -> DataFrame:
    return frames.where(F.pmod("raw_i", F.lit(interval)) == 0)


def sampling_interval(fps: Column, target: Column) -> Column:
    """Raw frames per sampled one, at least 1; halves go to the even number; a video without a rate has 30 a second."""
    rate = F.when(fps > 0, fps).otherwise(30.0)
    return F.greatest(F.bround(rate / target).cast("int"), F.lit(1))


def sampled_videos(frames: DataFrame, videos: DataFrame, target_fps: float) -> DataFrame:
    """frames (flight_id, raw_i, ...) of videos (flight_id, fps) at about target_fps, with ms where they have none."""
    rated = frames.join(videos.select("flight_id", "fps"), "flight_id")
    kept = rated.where(F.pmod("raw_i", sampling_interval(F.col("fps"), F.lit(target_fps))) == 0)
    ms = F.col("raw_i") * 1000.0 / F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0)
    return kept.drop("fps") if "ms" in frames.columns else kept.withColumn("ms", ms).drop("fps")


def brackets(samples: DataFrame, targets: DataFrame, stretch_ms: float = STRETCH_MS) -> DataFrame:
    """targets (flight_id, ms, ...) with structs l, r: the samples before (or at) and after each.

    samples: flight_id, ms, seq and any fields. Beyond the first or last sample the time is
    clamped to it (at_ms), as both neighbours are there. The order is (ms, seq).

    Rows of a flight's stretch are put in order by a window; what a stretch needs from its
    neighbours is the last and first sample of each stretch, carried over by a second
    window over one row per stretch.
    """
    fields = [c for c in samples.columns if c != "flight_id"]
    limits = samples.groupBy("flight_id").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    t = targets.join(limits, "flight_id").withColumn("at_ms", F.least(F.greatest(F.col("ms"), F.col("lo")), F.col("hi")))
    kept = [c for c in targets.columns if c != "flight_id"]
    stretch = lambda c: F.floor(F.col(c) / stretch_ms)
    s_rows = samples.select("flight_id", F.col("ms").alias("k"), F.lit(0).alias("is_t"), "seq", F.struct(*fields).alias("s"), stretch("ms").alias("stretch"))
    t_rows = t.select("flight_id", F.col("at_ms").alias("k"), F.lit(1).alias("is_t"), F.struct(*kept).alias("t"), stretch("at_ms").alias("stretch"))
    rows = s_rows.unionByName(t_rows, allowMissingColumns=True)
    order = Window.partitionBy("flight_id", "stretch").orderBy("k", "is_t", "seq")
    # the two samples at or before, and the first after
    own = rows.select("*", F.last("s", True).over(order).alias("l"), F.first("s", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("r"))
    first_last = s_rows.groupBy("flight_id", "stretch").agg(F.min_by("s", F.struct("k", "seq")).alias("first"), F.max_by("s", F.struct("k", "seq")).alias("last"))
    used = first_last.unionByName(t_rows.select("flight_id", "stretch").distinct(), allowMissingColumns=True).groupBy("flight_id", "stretch").agg(F.first("first", True).alias("first"), F.first("last", True).alias("last"))
    over = Window.partitionBy("flight_id").orderBy("stretch")
    carried = used.select("flight_id", "stretch", F.last("last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    found = own.where("is_t = 1").join(carried, ["flight_id", "stretch"])
    return found.select("flight_id", "t.*", F.col("k").alias("at_ms"), F.coalesce("l", "before").alias("l"), F.coalesce("r", "after").alias("r"))


def interpolate(samples: DataFrame, targets: DataFrame, max_gap_ms: float, stretch_ms: float = STRETCH_MS) -> DataFrame:
    """Each target's interpolated position; too_wide flags brackets over max_gap_ms.

    On or past the last sample the last sample itself answers, with gap 0.
    """
    found = brackets(samples, targets, stretch_ms).withColumn("r", F.coalesce("r", "l")).withColumn("l", F.coalesce("l", "r"))
    gap = F.col("r.ms") - F.col("l.ms")
    a = F.when(gap > 0, (F.col("at_ms") - F.col("l.ms")) / gap).otherwise(0.0)
    have = [c for c in FIELDS if c in samples.columns]

    def value(c: str) -> Column:
        left, right = F.col(f"l.{c}"), F.col(f"r.{c}")
        return (geo.yaw_between(left, right, F.col("a")) if c == "gimbal_yaw" else geo.between(left, right, F.col("a"))).alias(c)

    kept = [c for c in found.columns if c not in ("l", "r")]
    return found.withColumn("a", a).select(*kept, *map(value, have), F.col("l.ms").alias("bracket_start"), F.col("r.ms").alias("bracket_end"), gap.alias("gap_ms"), (gap > max_gap_ms).alias("too_wide"))


def keyframes(frames: DataFrame, least_m: float = 2.0, least_sharp: float = 40.0) -> DataFrame:
    """The frames a flight keeps, in order: far enough from the last kept one, and sharp (the first may be blurred).

    Sequential by nature: a fold over each flight's rows, in Catalyst. Memory is one
    flight's telemetry, so nothing else is carried.
    """
    row = F.struct("timestamp_ms", "seq", "latitude", "longitude", "altitude_m", "sharpness")
    flights = frames.groupBy("flight_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = frames.select(row.alias("r")).schema["r"].dataType.simpleString()
    start = F.struct(F.lit(None).cast(kind).alias("last"), F.array().cast("array<bigint>").alias("kept"))

    def step(state: Column, e: Column) -> Column:
        last = state["last"]
        far = last.isNull() | (geo.haversine_3d(last["latitude"], last["longitude"], last["altitude_m"], e["latitude"], e["longitude"], e["altitude_m"]) >= least_m)
        sharp = (e["sharpness"] >= least_sharp) | (F.size(state["kept"]) == 0)
        return F.when(far & sharp, F.struct(e.alias("last"), F.array_append(state["kept"], e["seq"].cast("bigint")).alias("kept"))).otherwise(state)

    return flights.select("flight_id", F.posexplode(F.aggregate("rows", start, step)["kept"]).alias("k", "seq"))


def motion(pixels: DataFrame, threshold: int = 30, reach: int = 2) -> DataFrame:
    """Changed pixels (flight_id, k, px_row, px_col), grown by reach; gray is compared with the frame kept before."""
    before = F.lag("gray").over(Window.partitionBy("flight_id", "px_row", "px_col").orderBy("k"))
    changed = pixels.withColumn("before", before).where(F.abs(F.col("gray") - F.col("before")) > threshold)
    near = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    grown = changed.withColumn("dr", near).withColumn("dc", near).select("flight_id", "k", (F.col("px_row") + F.col("dr")).alias("px_row"), (F.col("px_col") + F.col("dc")).alias("px_col")).distinct()
    return grown.join(pixels.select("flight_id", "k", "px_row", "px_col"), ["flight_id", "k", "px_row", "px_col"], "left_semi")


def local_views(views: DataFrame, stride: int, reach: int) -> DataFrame:
    """Each view's neighbours at multiples of stride, up to reach on either side, with itself, in order."""
    window = Window.partitionBy("flight_id", F.pmod("view", F.lit(stride))).orderBy("view").rowsBetween(-reach, reach)
    return views.withColumn("window", F.array_sort(F.collect_list("view").over(window)))


def buffer_candidates(views: DataFrame, stride: int) -> DataFrame:
    """In each stretch of stride views, the one whose confidences are best together: ((c-1)/c) * ((l-1)/l)."""
    worth = (F.col("conf") - 1) / F.col("conf") * (F.col("local") - 1) / F.col("local")
    block = F.floor(F.col("view") / stride)
    return views.groupBy("flight_id", block.alias("block")).agg(F.max_by("view", F.struct(worth, -F.col("view"))).alias("view"), F.max(worth).alias("worth"))


def spaced_candidates(candidates: DataFrame, stride: int) -> DataFrame:
    """Candidates at least three quarters of a stride after the last one taken: a fold per flight."""
    apart = -(-3 * stride // 4)
    flights = candidates.groupBy("flight_id").agg(F.array_sort(F.collect_list(F.col("view").cast("long"))).alias("v"))
    taken = F.aggregate("v", F.array().cast("array<bigint>"), lambda s, v: F.when((F.size(s) == 0) | (v - F.try_element_at(s, F.lit(-1)) >= apart), F.array_append(s, v)).otherwise(s))
    return flights.select("flight_id", F.explode(taken).alias("view"))


def reservoir(views: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """A fixed-size random choice of each flight's views: those of least hash (the same on every run)."""
    order = Window.partitionBy("flight_id").orderBy(F.xxhash64(F.lit(seed), "view"), "view")
    return views.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= size).drop("__n")


def fifo(views: DataFrame, size: int) -> DataFrame:
    """The last `size` of each flight's views: what a first-in, first-out buffer holds in the end."""
    order = Window.partitionBy("flight_id").orderBy(F.desc("view"))
    return views.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= size).drop("__n")


def rescaled_head(views: DataFrame, initial: int, stride: int) -> DataFrame:
    """views (flight_id, view, conf) whose `initial` first reference views (multiples of stride) are brought to the others' scale.

    The factor is the largest confidence of the views between them by the largest of theirs.
    """
    if stride <= 1:
        return views
    reference = (F.col("view") % stride == 0) & (F.col("view") < initial * stride)
    between = (F.col("view") % stride != 0) & (F.col("view") < (initial - 1) * stride)
    factor = views.groupBy("flight_id").agg((F.max(F.when(between, F.col("conf"))) / F.max(F.when(reference, F.col("conf")))).alias("__f"))
    joined = views.join(factor, "flight_id")
    return joined.withColumn("conf", F.when(reference, F.col("conf") * F.coalesce("__f", F.lit(1.0))).otherwise(F.col("conf"))).drop("__f")


def batches(views: DataFrame, stride: int) -> DataFrame:
    size = max(1, min((stride + 1) // 2, 10))
    return views.withColumn("batch", F.floor(F.col("view") / size))


def registered_cameras(frames: DataFrame, poses: DataFrame, least: int = 4, missing: float = 0.5) -> DataFrame:
    """(flight_id, k, x, y, z, posed) of each frame (flight_id, k, name); a pose's name is the
    frame's without its folders, or else the whole of it.

    Frames without a pose lie between their neighbours, by place in the flight; before the
    first and after the last they stay there. Flights of fewer than least poses, or of more
    than that share missing, give nothing. Of poses of equal name the least counts.
    """
    own = poses.groupBy("flight_id", "name").agg(F.min(F.struct("x", "y", "z")).alias("p"))
    by = lambda c, p: own.select("flight_id", F.col("name").alias(c), F.col("p").alias(p))
    met = frames.select("flight_id", "k", "name", F.element_at(F.split("name", "/"), -1).alias("base")).join(by("base", "p1"), ["flight_id", "base"], "left").join(by("name", "p2"), ["flight_id", "name"], "left")
    met = met.select("flight_id", "k", F.coalesce("p1", "p2").alias("p"))
    ordered = Window.partitionBy("flight_id").orderBy("k")
    n = F.row_number().over(ordered)
    at = F.when(F.col("p").isNotNull(), F.struct("n", "p"))
    before = F.last(at, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(ordered.rowsBetween(0, Window.unboundedFollowing))
    counted = met.withColumn("n", n).withColumns({"l": before, "r": after}).withColumns({"l": F.coalesce("l", "r"), "r": F.coalesce("r", "l")})
    share = F.coalesce((F.col("n") - F.col("l.n")) / F.nullif(F.col("r.n") - F.col("l.n"), F.lit(0)), F.lit(0.0))
    whole = Window.partitionBy("flight_id")
    found = counted.withColumns({"share": share, "posed": F.col("p").isNotNull()}).withColumns({"some": F.count_if("posed").over(whole), "all": F.count("*").over(whole)})
    good = found.where((F.col("some") >= least) & (F.col("all") - F.col("some") <= missing * F.col("all")))
    return good.select("flight_id", "k", *[(F.col(f"l.p.{c}") + F.col("share") * (F.col(f"r.p.{c}") - F.col(f"l.p.{c}"))).alias(c) for c in "xyz"], "posed")


def paired_cameras(registered: DataFrame, proxies: DataFrame, positions: DataFrame) -> DataFrame:
    """(flight_id, k, x, y, z, u, v, w): cameras and positions (u, v, w) by place, as far as both go.

    A flight's registered cameras count only if there is one for each proxy (a centre taken
    from its point map); else the proxies do.
    """
    ordered = Window.partitionBy("flight_id").orderBy("k")
    place = lambda df, *names: df.withColumn("i", F.row_number().over(ordered) - 1).select("flight_id", "i", *names)
    n = lambda df, name: df.groupBy("flight_id").agg(F.count("*").alias(name))
    enough = n(registered, "a").join(n(proxies, "b"), "flight_id", "left").where(F.col("a") >= F.coalesce("b", F.lit(0))).select("flight_id")
    chosen = registered.join(enough, "flight_id", "left_semi").select("flight_id", "k", "x", "y", "z").unionByName(proxies.join(enough, "flight_id", "left_anti").select("flight_id", "k", "x", "y", "z"))
    return place(chosen, "x", "y", "z").join(place(positions, "u", "v", "w"), ["flight_id", "i"]).withColumnRenamed("i", "k")
