"""Queries over virtual flights in the driver's tables, each with its SQL.

Flights: a user's events are its telemetry (vt); line items are a pointmap (vc).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import geo
from ..operators import align, cloud, sync, telemetry
from ..sources import files

_VT = """select user_id as flight_id, event_id as seq, cast({us} as double) / 1000e0 as timestamp_ms,
  28.6139e0 + (event_id * 7 % 40) * 1e-5 as latitude, 77.2090e0 + (event_id * 13 % 40) * 1e-5 as longitude,
  50e0 + (event_id % 5) * 5e-1 as altitude_m, cast((event_id * 37 % 360) - 180 as double) as gimbal_yaw,
  cast(-90 + (event_id % 40) as double) as gimbal_pitch, value as sharpness from {events}"""
VT = _VT.format(us="epoch_us(ts)", events="events")
_VC = """select cast(1 + l_orderkey % 2 as bigint) as flight_id, l_suppkey % 20 as k, l_partkey % 64 as px_row, l_orderkey % 64 as px_col,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity as x, l_extendedprice / 1e3 as y, l_discount * 1e2 as z,
  1e0 + l_tax * 2e2 as conf, l_discount * 1e1 as r, l_tax * 1.25e1 as g, l_quantity / 5e1 as b from {lineitem}"""
VC = _VC.format(lineitem="lineitem")
MASK = "select distinct flight_id, k, px_row, px_col from vc where x > 45 and k < 3"
#: A number for each point of the driver's tables, in the order of its parts.
PT_ID = "((l_orderkey * 8 + l_linenumber) * 262144 + l_partkey) * 16384 + l_suppkey"
PT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def vt(spark: SparkSession, d: str) -> DataFrame:
    us = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
    return spark.sql(_VT.format(us=us, events=f"parquet.`{d}/events.parquet`"))


def vc(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_VC.format(lineitem=f"parquet.`{d}/lineitem.parquet`"))


def mask(points: DataFrame) -> DataFrame:
    return points.where("x > 45 and k < 3").select("flight_id", "k", "px_row", "px_col").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"with recursive vt as ({VT}), vc as ({VC}), mask as ({MASK}) {sql}"
        return f

    return keep


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in names else c for c in df.columns])


_ERR = """sqrt(avg(e * e)) as rmse_m, avg(e) as mean_error_m, median(e) as median_error_m, quantile_cont(e, 0.95) as p95_error_m, max(e) as max_error_m, stddev_pop(e) as std_dev_m"""
_STATS = ("rmse_m", "mean_error_m", "median_error_m", "p95_error_m", "max_error_m", "std_dev_m")
_ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in _STATS)


def _hav(a: str, b: str) -> str:
    h = f"pow(sin(radians({b}latitude - {a}latitude) / 2), 2) + cos(radians({a}latitude)) * cos(radians({b}latitude)) * pow(sin(radians({b}longitude - {a}longitude) / 2), 2)"
    return f"sqrt(pow(2 * 6371000e0 * atan2(sqrt({h}), sqrt(1 - ({h}))), 2) + pow({b}altitude_m - {a}altitude_m, 2))"


@query(f"select event_type, {_ROUNDED}, n as sample_points_count from (select event_type, {_ERR}, count(*) as n from (select event_type, value as e from events) group by event_type)")
def error_stats(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.col("value").alias("e"))
    return rounded(cloud.error_stats(events, ["event_type"]), 6, *_STATS)


@query(f"select held_out, {_ROUNDED}, n as sample_points_count from (select held_out, {_ERR}, count(*) as n from (select event_id % 5 = 0 as held_out, value as e from events) group by held_out)")
def error_stats_holdout(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 5 == 0).alias("held_out"), F.col("value").alias("e"))
    return rounded(cloud.error_stats(events, ["held_out"]), 6, *_STATS)


@query("""select vt.flight_id, seq, round((longitude - o.lon) * 111320e0 * cos(radians(o.lat)), 4) as x, round((latitude - o.lat) * 111320e0, 4) as y, round(altitude_m - o.alt, 4) as z
  from vt join (select flight_id, arg_min(latitude, row(timestamp_ms, seq)) as lat, arg_min(longitude, row(timestamp_ms, seq)) as lon, arg_min(altitude_m, row(timestamp_ms, seq)) as alt from vt group by 1) o on o.flight_id = vt.flight_id""")
def enu_flat_earth(spark, d):
    return rounded(telemetry.with_enu(vt(spark, d)).select("flight_id", "seq", "x", "y", "z"), 4, "x", "y", "z")


@query(f"select flight_id, seq, round({_hav('p_', '')}, 4) as step_m from (select *, lag(latitude) over w as p_latitude, lag(longitude) over w as p_longitude, lag(altitude_m) over w as p_altitude_m from vt window w as (partition by flight_id order by timestamp_ms, seq))")
def haversine_steps(spark, d):
    w = Window.partitionBy("flight_id").orderBy("timestamp_ms", "seq")
    own = ["latitude", "longitude", "altitude_m"]
    return vt(spark, d).select("flight_id", "seq", F.round(geo.haversine_3d(*[F.lag(c).over(w) for c in own], *map(F.col, own)), 4).alias("step_m"))


@query("""select flight_id, seq, p + 0.5e0 * ((((gimbal_yaw - p + 180) % 360) + 360) % 360 - 180) as yaw from (select *, lag(gimbal_yaw) over (partition by flight_id order by timestamp_ms, seq) as p from vt)""")
def yaw_shortest_arc(spark, d):
    w = Window.partitionBy("flight_id").orderBy("timestamp_ms", "seq")
    return vt(spark, d).select("flight_id", "seq", geo.yaw_between(F.lag("gimbal_yaw").over(w), F.col("gimbal_yaw"), F.lit(0.5)).alias("yaw"))


@query("""
, s as (select *, lead(timestamp_ms) over w as r_ms, lead(latitude) over w as r_lat, lead(longitude) over w as r_lon, lead(altitude_m) over w as r_alt from vt where seq % 2 = 0 window w as (partition by flight_id order by timestamp_ms, seq)),
lim as (select flight_id, min(timestamp_ms) as lo, max(timestamp_ms) as hi from s group by 1),
t as (select v.flight_id, v.seq as target, least(greatest(v.timestamp_ms, lo), hi) as at_ms from vt v join lim on lim.flight_id = v.flight_id where v.seq % 2 = 1),
j as (select t.*, s.*exclude(flight_id), case when r_ms is null then 0e0 else (at_ms - timestamp_ms) / (r_ms - timestamp_ms) end as a from t asof join s on t.flight_id = s.flight_id and t.at_ms >= s.timestamp_ms)
select flight_id, target, round(latitude + a * (coalesce(r_lat, latitude) - latitude), 7) as latitude, round(longitude + a * (coalesce(r_lon, longitude) - longitude), 7) as longitude, round(altitude_m + a * (coalesce(r_alt, altitude_m) - altitude_m), 4) as altitude_m,
  coalesce(r_ms, timestamp_ms) - timestamp_ms > 86400000 as too_wide from j""")
def gps_asof_interpolate(spark, d):
    v = vt(spark, d)
    samples = v.where("seq % 2 = 0").withColumnRenamed("timestamp_ms", "ms").drop("sharpness")
    targets = v.where("seq % 2 = 1").select("flight_id", F.col("timestamp_ms").alias("ms"), F.col("seq").alias("target"))
    found = sync.interpolate(samples, targets, 86_400_000.0, stretch_ms=7 * 86_400_000.0)
    return rounded(rounded(found.select("flight_id", "target", "latitude", "longitude", "altitude_m", "too_wide"), 7, "latitude", "longitude"), 4, "altitude_m")


@query(f""", o as (select *, row_number() over (partition by flight_id order by timestamp_ms, seq) as rn from vt),
f as (select flight_id, rn, seq, latitude, longitude, altitude_m, 0 as k, true as kept from o where rn = 1 union all
  select o.flight_id, o.rn, o.seq, case when ok then o.latitude else f.latitude end, case when ok then o.longitude else f.longitude end, case when ok then o.altitude_m else f.altitude_m end, f.k + ok::int, ok
  from f join o on o.flight_id = f.flight_id and o.rn = f.rn + 1, lateral (select {_hav('f.', 'o.')} >= 20 and o.sharpness >= 40 as ok) x)
select flight_id, k::int as k, seq from f where kept""")
def hover_keyframes(spark, d):
    return sync.keyframes(vt(spark, d), 20.0, 40.0)


@query("""select r.flight_id, first_ms, last_ms, n_records, video_first_ms, video_last_ms, first_ms <= video_first_ms + 5000 and last_ms >= video_last_ms - 5000 as covered
  from (select flight_id, min(timestamp_ms) as first_ms, max(timestamp_ms) as last_ms, count(*) as n_records from vt where seq % 3 = 0 group by 1) r
  join (select flight_id, min(timestamp_ms) as video_first_ms, max(timestamp_ms) as video_last_ms from vt group by 1) f on f.flight_id = r.flight_id""")
def telemetry_coverage(spark, d):
    v = vt(spark, d)
    return telemetry.coverage(v.where("seq % 3 = 0"), v.select("flight_id", F.col("timestamp_ms").alias("ms")))


_BROKEN = "select flight_id, seq, case when seq % 50 = 0 then 95e0 when seq % 77 = 0 then null else latitude end as latitude, case when seq % 61 = 0 then 190e0 else longitude end as longitude, altitude_m, case when seq % 11 = 0 then null else timestamp_ms end as timestamp_ms, case when seq % 22 = 0 then null when seq % 33 = 0 then -1 else seq end as frame_idx from "


@query(f""", r as ({_BROKEN} vt) select code, count(*) as n from (select case when latitude is null then 'missing field' when latitude not between -90 and 90 then 'latitude' when longitude not between -180 and 180 then 'longitude'
  when timestamp_ms is null and frame_idx is null then 'no key' when frame_idx < 0 then 'negative frame' else 'ok' end as code from r) group by code""")
def telemetry_validate(spark, d):
    broken = spark.sql(f"{_BROKEN} {{v}}", v=vt(spark, d))
    return broken.groupBy(F.coalesce(telemetry.violation(), F.lit("ok")).alias("code")).agg(F.count("*").alias("n"))


@query(""", r as (select flight_id, case when flight_id % 3 = 0 and seq % 2 = 0 then null else timestamp_ms end as t, case when flight_id % 6 = 0 and seq % 5 = 0 then null else seq end as f from vt)
select flight_id, case when bool_and(t is not null) then 'timestamp_ms' when bool_and(f is not null) then 'frame_idx' else 'error' end as sync_key from r group by 1""")
def sync_keys(spark, d):
    v = vt(spark, d).select("flight_id", F.expr("case when flight_id % 3 = 0 and seq % 2 = 0 then null else timestamp_ms end").alias("timestamp_ms"), F.expr("case when flight_id % 6 = 0 and seq % 5 = 0 then null else seq end").alias("frame_idx"))
    return telemetry.sync_keys(v)


@query("""select flight_id, count(*) as n_records, min(latitude) as min_latitude, max(latitude) as max_latitude, min(longitude) as min_longitude, max(longitude) as max_longitude, min(altitude_m) as min_altitude_m, max(altitude_m) as max_altitude_m,
  max(timestamp_ms) as duration_ms, count(gimbal_pitch) as n_imu, median(gimbal_pitch) as median_pitch from vt group by 1""")
def telemetry_summary(spark, d):
    return telemetry.summary(vt(spark, d))


@query("""select flight_id, seq % 86400000 as timestamp_ms_, round(latitude, 6) as latitude, round(longitude, 6) as longitude, altitude_m, seq - 1 as frame_idx, gimbal_pitch from vt where seq % 7 <> 0""".replace("seq % 86400000 as timestamp_ms_", "cast(seq % 60000 as double) as timestamp_ms"))
def srt_parse(spark, d):
    at = F.format_string("00:00:%02d,%03d", (F.col("seq") % 60000 / 1000).cast("int"), (F.col("seq") % 1000).cast("int"))
    where = F.when(F.col("seq") % 2 == 0, F.format_string("[latitude: %.6f] [longtitude : %.6f] [rel_alt: %.1f abs_alt: 9.0]", "latitude", "longitude", "altitude_m")).otherwise(F.format_string("GPS(%.6f, %.6f, %.1f)", "longitude", "latitude", "altitude_m"))
    line = F.when(F.col("seq") % 7 == 0, F.lit("no position")).otherwise(F.concat(where, F.format_string(" FrameCnt: %d [gimbal_pitch: %.1f] [gimbal_yaw: 0] [gimbal_roll: 0]", "seq", "gimbal_pitch")))
    block = F.concat(F.lit("1\n"), at, F.lit(" --> "), at, F.lit("\n"), line)
    texts = vt(spark, d).groupBy("flight_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("content"))
    return telemetry.parse_subtitles(texts).select("flight_id", "timestamp_ms", "latitude", "longitude", "altitude_m", "frame_idx", "gimbal_pitch")


_VIEWS = "select flight_id, row_number() over (partition by flight_id order by timestamp_ms, seq) - 1 as view, 2 + sharpness as conf, 2 + altitude_m as local from "


@query(f", v as ({_VIEWS} vt) select flight_id, view, array_to_string(list_sort(list(view) over (partition by flight_id, view % 5 order by view rows between 2 preceding and 2 following)), ',') as views from v")
def local_view_window(spark, d):
    views = spark.sql(f"{_VIEWS} {{v}}", v=vt(spark, d)).withColumn("view", F.col("view").cast("long"))
    return sync.local_views(views, 5, 2).select("flight_id", "view", F.array_join("window", ",").alias("views"))


@query(f""", v as ({_VIEWS} vt), w as (select flight_id, view // 10 as block, view, (conf - 1) / conf * (local - 1) / local as worth from v)
select flight_id, block, view, round(worth, 9) as worth from (select *, row_number() over (partition by flight_id, block order by worth desc, view) as n from w) where n = 1""")
def buffer_candidates(spark, d):
    views = spark.sql(f"{_VIEWS} {{v}}", v=vt(spark, d)).withColumn("view", F.col("view").cast("long"))
    return rounded(sync.buffer_candidates(views, 10), 9, "worth")


@query("""select flight_id, k, n_sure, round(case when n_sure >= 8 then sx when n_some > 0 then mx else ax end, 6) as x, round(case when n_sure >= 8 then sz when n_some > 0 then mz else az end, 6) as z from (select flight_id, k, count(*) filter (where conf > 10) as n_sure, count(*) filter (where abs(x) + abs(y) + abs(z) > 1e-9) as n_some,
  avg(x) filter (where conf > 10) as sx, avg(z) filter (where conf > 10) as sz, avg(x) filter (where abs(x) + abs(y) + abs(z) > 1e-9) as mx, avg(z) filter (where abs(x) + abs(y) + abs(z) > 1e-9) as mz, avg(x) as ax, avg(z) as az from vc group by flight_id, k)""")
def camera_centers(spark, d):
    return rounded(cloud.camera_centres(vc(spark, d)).select("flight_id", "k", "n_sure", "x", "z"), 6, "x", "z")


@query("select flight_id, k, round(avg(conf), 6) as mean_conf from vc group by flight_id, k having avg(conf) < 9")
def low_confidence_views(spark, d):
    return rounded(cloud.low_confidence_views(vc(spark, d), 9.0).select("flight_id", "k", "mean_conf"), 6, "mean_conf")


@query("""select vc.flight_id, count(*) as total, count(m.k) as masked, count(*) filter (where m.k is null and conf > 10 and abs(x) + abs(y) + abs(z) > 1e-9) as valid, count(m.k) / count(*) as masked_fraction
  from vc left join mask m on m.flight_id = vc.flight_id and m.k = vc.k and m.px_row = vc.px_row and m.px_col = vc.px_col group by vc.flight_id""")
def masked_cloud_stats(spark, d):
    points = vc(spark, d)
    return cloud.mask_statistics(points, mask(points))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, x, y, z from vc where conf > 10 and not exists (from mask m where m.flight_id = vc.flight_id and m.k = vc.k and m.px_row = vc.px_row and m.px_col = vc.px_col)")
def masked_cloud(spark, d):
    points = vc(spark, d)
    return cloud.masked_cloud(points, mask(points)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x", "y", "z")


@query("""select flight_id, vx, vy, vz, count(*) as n, sum(cast(round(y * 100000) as bigint))::bigint as sum_y from (select vc.*, cast(floor((x - lx + s / 2) / s) as bigint) as vx, cast(floor((y - ly + s / 2) / s) as bigint) as vy, cast(floor((z - lz + s / 2) / s) as bigint) as vz
  from vc join (select flight_id, 4e0 + flight_id as s, min(x) as lx, min(y) as ly, min(z) as lz from vc group by flight_id) o on o.flight_id = vc.flight_id) group by 1, 2, 3, 4""")
def voxel_downsample(spark, d):
    points = vc(spark, d)
    grid = points.groupBy("flight_id").agg(*[F.min(c).alias(f"low_{c}") for c in "xyz"]).withColumn("size", 4.0 + F.col("flight_id"))
    return cloud.voxels(points, grid, [F.count("*").alias("n"), F.sum(F.round(F.col("y") * 100000).cast("long")).alias("sum_y")], ["flight_id"])


@query()
def voxel_budget(spark, d):
    return cloud.voxel_downsample(vc(spark, d), 500, ["flight_id"])


_CELL = "least(greatest({0}, 0), 1023)"


@query(f"""select flight_id, gx, gy, c.r as r, c.g as g, c.b as b from (select flight_id, gx, gy, arg_max({{'r': qr, 'g': qg, 'b': qb}}, {PT_ID}) as c from (
  select vc.*, {_CELL.format("trunc((x - lx) / (hx - lx) * 1023)::int")} as gx, {_CELL.format("1023 - trunc((y - ly) / (hy - ly) * 1023)::int")} as gy, {", ".join(f"trunc(greatest(least({c}, 1e0), 0e0) * 255)::int as q{c}" for c in "rgb")}
  from vc join (select flight_id, min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy from vc group by flight_id) o on o.flight_id = vc.flight_id) group by flight_id, gx, gy)""")
def raster_last_write(spark, d):
    points = vc(spark, d)
    return cloud.raster(points, F.expr(PT_ID), cloud.bounds(points, ["flight_id"]), ["flight_id"])


@query("select flight_id, k, count(*) as n_points, " + ", ".join(f"min({c}) as min_{c}, max({c}) as max_{c}, greatest(max({c}) - min({c}), 1e0) as span_{c}, greatest(greatest(max({c}) - min({c}), 1e0) / 1e7, 0.001e0) as scale_{c}" for c in "xyz") + " from vc group by flight_id, k")
def cloud_bounds_las_scale(spark, d):
    return cloud.bounds(vc(spark, d), ["flight_id", "k"])


@query("select flight_id, k, count(*) as n, " + ", ".join(f"round(avg({c}), 4) as mean_{c}" for c in "xyz") + ", " + ", ".join(f"round(covar_pop({p[0]}, {p[1]}), 4) as cov_{p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz")) + " from vc group by flight_id, k")
def pca_moments(spark, d):
    m = cloud.moments(vc(spark, d), ["flight_id", "k"])
    return rounded(m, 4, *[c for c in m.columns if c not in ("flight_id", "k", "n")])


_CONTROL = "select flight_id, k, x, y, z, 2e0 * y + 1e0 as u, -2e0 * x + 3e0 as v, 2e0 * z + (l_orderkey % 7) * 1e-2 as w from "


@query(f", c as ({_CONTROL} vc) select flight_id, k, count(*) as n, " + ", ".join(f"round(avg({c}), 4) as mean_{c}" for c in "xyzuvw") + ", round(var_pop(x) + var_pop(y) + var_pop(z), 4) as src_var, " + ", ".join(f"round(covar_pop({q}, {p}), 4) as cov_{q}{p}" for q in "uvw" for p in "xyz") + " from c group by flight_id, k")
def umeyama_moments(spark, d):
    m = cloud.fit_moments(spark.sql(f"{_CONTROL} {{v}}", v=vc(spark, d)), ["flight_id", "k"])
    return rounded(m, 4, *[c for c in m.columns if c not in ("flight_id", "k", "n")])


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"round(if(flight_id = 1, 2.5e0 * ({a}) + {t}, 0.5e0 * ({b}) + {u}), 6) as {c}" for c, a, t, b, u in (("x", "-1e0 * y", "10e0", "z", "1e0"), ("y", "x", "20e0", "x", "2e0"), ("z", "z", "30e0", "y", "3e0"))) + " from vc")
def similarity_apply(spark, d):
    one = "select cast(1 as bigint) as flight_id, 2.5e0 as scale, array(array(0e0, -1e0, 0e0), array(1e0, 0e0, 0e0), array(0e0, 0e0, 1e0)) as rotation, array(10e0, 20e0, 30e0) as translation"
    both = spark.sql(one + " union all select 2, 0.5e0, array(array(0e0, 0e0, 1e0), array(1e0, 0e0, 0e0), array(0e0, 1e0, 0e0)), array(1e0, 2e0, 3e0)")
    return rounded(align.apply_transforms(vc(spark, d).select("flight_id", *PT[:4], "x", "y", "z"), both).drop("flight_id"), 6, "x", "y", "z")


_NEAR = "m2.flight_id = a.flight_id and m2.k = a.k and abs(m2.px_row - a.px_row) <= 1 and abs(m2.px_col - a.px_col) <= 1"


@query(f""", a as (select flight_id, k, px_row, px_col, px_row * 65536 + px_col as component from mask union
  select m2.flight_id, m2.k, m2.px_row, m2.px_col, a.component from a join mask m2 on {_NEAR} where a.component < m2.px_row * 65536 + m2.px_col),
b as (select flight_id, k, px_row, px_col, min(component) as component from a group by 1, 2, 3, 4)
select flight_id, k, px_row, px_col, component, count(*) over (partition by flight_id, k, component) as area from b""")
def mask_components(spark, d):
    return cloud.mask_components(mask(vc(spark, d))).select("flight_id", "k", "px_row", "px_col", "component", "area")


_MD5 = "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey))"


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, x, -y as y, -z as z from vc where conf > 10 order by {_MD5}, l_extendedprice limit 500")
def resample_points(spark, d):
    order = F.struct(F.expr(_MD5), "l_extendedprice")
    return cloud.resampled(vc(spark, d), 500, order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x", "y", "z")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"trunc(greatest(least({c}, 1e0), 0e0) * 65535)::int as q{c}" for c in "rgb") + " from vc")
def colour_quantise(spark, d):
    return vc(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[geo.quantised(F.col(c), 65535).alias(f"q{c}") for c in "rgb"])


_N = geo.WGS84_F / (2 - geo.WGS84_F)
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
_K = geo.UTM_SCALE * geo.WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * _N**0.5 / (1 + _N)


@query(f""", z as (select flight_id, seq, latitude, radians(longitude - (zone * 6 - 183)) as away, zone, asinh(tan(radians(latitude))) - {_E!r} * atanh({_E!r} * sin(radians(latitude))) as q from (select *, cast(floor((longitude + 180) / 6) as int) % 60 + 1 as zone from vt)),
x as (select *, atan2(sinh(q), cos(away)) as xi, asinh(sin(away) / sqrt(pow(sinh(q), 2) + pow(cos(away), 2))) as eta from z)
select flight_id, seq, if(latitude >= 0, 32600, 32700) + zone as epsg, round({geo.UTM_FALSE_EAST!r} + {_K!r} * (eta + {" + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1))}), 4) as easting,
  round(if(latitude < 0, {geo.UTM_FALSE_NORTH!r}, 0) + {_K!r} * (xi + {" + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1))}), 4) as northing from x""")
def utm_project(spark, d):
    v = vt(spark, d)
    return rounded(v.select("flight_id", "seq", geo.utm_epsg(F.col("latitude"), F.col("longitude")).alias("epsg"), *geo.utm(F.col("latitude"), F.col("longitude"))), 4, "easting", "northing")


def control_points(spark: SparkSession, d: str, far: str = "0e0") -> DataFrame:
    """Cameras (vectors' first dimensions) and their positions by a planted similarity, u moved by `far`."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    at = [F.col("embedding")[i].cast("double") * 100 for i in range(3)]
    return e.select(F.col("label").cast("long").alias("flight_id"), F.col("vec_id").alias("k"), *[a.alias(c) for a, c in zip(at, "xyz")], (at[1] * -2 + 5 + F.expr(far)).alias("u"), (at[0] * 2 - 7).alias("v"), (at[2] * 2 + 30).alias("w"))


def level_ground(control: DataFrame) -> DataFrame:
    """Moments of a flat cloud under each flight: the planted similarity keeps it level, so nothing is to be rolled."""
    ground = control.select("flight_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i")).select("flight_id", (F.col("i") % 3 * 10.0).alias("x"), (F.floor(F.col("i") / 3) * 7.0).alias("y"), F.lit(-3.0).alias("z"))
    return cloud.moments(ground, ["flight_id"])


_FAR = "if(vec_id % 23 = 0, 40e0, 0e0)"
_PLANTED = "e as (select cast(label as bigint) as flight_id, vec_id as k, embedding[1]::double * 100 as x, embedding[2]::double * 100 as y, embedding[3]::double * 100 as z from embeddings)"


@query(f", {_PLANTED} select flight_id, count(*) as n, count(*) filter (where k % 23 <> 0) as n_inliers, 2e0 as scale, -1e0 as xy, 1e0 as yx, 1e0 as zz, 5e0 as tx, -7e0 as ty, 30e0 as tz, false as rolled, round(sqrt(count(*) filter (where k % 23 = 0) * 1600e0 / count(*)), 4) as rmse_m from e group by flight_id")
def ransac_fit(spark, d):
    control = control_points(spark, d, _FAR)
    r, t = F.col("rotation"), F.col("translation")
    found = align.fit_transforms(control, level_ground(control))
    return rounded(found.select("flight_id", "n", "n_inliers", "scale", r[0][1].alias("xy"), r[1][0].alias("yx"), r[2][2].alias("zz"), t[0].alias("tx"), t[1].alias("ty"), t[2].alias("tz"), "rolled", "rmse_m"), 4, "scale", "xy", "yx", "zz", "tx", "ty", "tz", "rmse_m")


@query(f", {_PLANTED} select flight_id, k, round(-2 * y + 5, 4) as x, round(2 * x - 7, 4) as y, round(2 * z + 30, 4) as z, k % 23 <> 0 as inlier, false as rolled, 0e0 as shift_m from e")
def georeferenced_cameras(spark, d):
    control = control_points(spark, d, _FAR)
    found = rounded(align.georeference(control, level_ground(control)), 4, "x", "y", "z", "shift_m")
    return found


@query(f", {_PLANTED} select flight_id, count(*) as keyframes, greatest(1, round_even(0.2e0 * count(*), 0))::bigint as held_out, {', '.join(f'0e0 as {c}, 0e0 as residual_{c}' for c in _STATS)}, true as passed from e group by flight_id")
def hold_out_report(spark, d):
    control = control_points(spark, d)
    return align.hold_out_report(control, cloud_moments=level_ground(control))


@query("select flight_id, seq as raw_i from vt where seq % 10 = 0")
def frame_sampling(spark, d):
    return sync.sampled_frames(vt(spark, d).select("flight_id", F.col("seq").alias("raw_i")), 10)


@query(""", g as (select flight_id, k, px_row, px_col, max(x) * 5 as gray from vc group by 1, 2, 3, 4),
c as (select *, lag(gray) over (partition by flight_id, px_row, px_col order by k) as p from g)
select distinct flight_id, k, px_row, px_col from g where exists (from c where c.flight_id = g.flight_id and c.k = g.k and abs(c.gray - c.p) > 30 and c.px_row between g.px_row - 2 and g.px_row + 2 and c.px_col between g.px_col - 2 and g.px_col + 2)""")
def motion_mask(spark, d):
    return sync.motion(vc(spark, d).groupBy("flight_id", "k", "px_row", "px_col").agg((F.max("x") * 5).alias("gray")))


@query(f""", v as ({_VIEWS} vt), w as (select flight_id, view // 10 as block, arg_max(view, row((conf - 1) / conf * (local - 1) / local, -view)) as view from v group by 1, 2),
f as (select flight_id, min(view) as view from w group by 1 union all select f.flight_id, min(w.view) from f join w on w.flight_id = f.flight_id and w.view - f.view >= 8 group by 1)
select flight_id, view from f""")
def spaced_candidates(spark, d):
    views = spark.sql(f"{_VIEWS} {{v}}", v=vt(spark, d)).withColumn("view", F.col("view").cast("long"))
    return sync.spaced_candidates(sync.buffer_candidates(views, 10), 10)


@query(f", v as ({_VIEWS} vt) select flight_id, view, view // 5 as batch from v")
def view_batches(spark, d):
    views = spark.sql(f"{_VIEWS} {{v}}", v=vt(spark, d)).withColumn("view", F.col("view").cast("long"))
    return sync.batches(views.select("flight_id", "view"), 10)


_BOXES = """select cast(1 + s_suppkey % 2 as bigint) as flight_id, s_suppkey % 20 as k, s_nationkey as cls, (s_suppkey * 7 % 100) / 1e2 as conf,
  cast(s_suppkey % 60 as int) as r0, cast(s_suppkey % 60 + 3 as int) as r1, cast(s_suppkey * 3 % 60 as int) as c0, cast(s_suppkey * 3 % 60 + 3 as int) as c1 from """


@query(f""", boxes as ({_BOXES} supplier) select distinct flight_id, k, px_row, px_col from vc
  where exists (from boxes o where o.flight_id = vc.flight_id and o.k = vc.k and cls in (0, 1, 2, 3, 5, 7, 8, 14, 16) and o.conf >= 0.25 and px_row between r0 and r1 and px_col between c0 and c1)""")
def detection_masks(spark, d):
    boxes = spark.sql(f"{_BOXES} parquet.`{d}/supplier.parquet`")
    return cloud.detection_masks(boxes, vc(spark, d).select(*cloud.PIXEL).distinct())


@query("select i as frame_idx, round(28.6e0 + 1e-5 * i, 9) as latitude, round(77.2e0 + 2e-5 * i, 9) as longitude, round(50 + 5e-1 * sin(i / 10), 9) as altitude_m, true as synthetic from (select unnest(range(1000)) as i)")
def synthetic_track(spark, d):
    return rounded(telemetry.synthetic_track(spark, 1000, 28.6, 77.2), 9, "latitude", "longitude", "altitude_m")


@query("select flight_id, k, " + ", ".join(f"round(28.6e0 + {f}(y) / 111320e0, 9) as {f}_latitude, round(77.2e0 + {f}(x) / (111320e0 * cos(radians(28.6e0))), 9) as {f}_longitude" for f in ("min", "max")) + " from vc group by flight_id, k")
def cloud_degrees(spark, d):
    box = cloud.bounds(vc(spark, d), ["flight_id", "k"])
    corner = lambda t: [e.alias(f"{t}_{n}") for e, n in zip(geo.enu_inverse(F.col(f"{t}_x"), F.col(f"{t}_y"), F.lit(28.6), F.lit(77.2)), ("latitude", "longitude"))]
    found = box.select("flight_id", "k", *corner("min"), *corner("max"))
    return rounded(found, 9, *found.columns[2:])


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"cast(round(({c} - l{c}) / greatest(greatest(h{c} - l{c}, 1e0) / 1e7, 0.001e0)) as bigint) as i{c}" for c in "xyz") + ", " + ", ".join(f"trunc(greatest(least({c}, 1e0), 0e0) * 65535)::int as c{c}" for c in "rgb") + " from vc join (select flight_id, " + ", ".join(f"min({c}) as l{c}, max({c}) as h{c}" for c in "xyz") + " from vc group by flight_id) o on o.flight_id = vc.flight_id")
def las_coordinates(spark, d):
    points = vc(spark, d)
    return files.scaled_coordinates(points, cloud.bounds(points, ["flight_id"]), ["flight_id"], tuple(PT[:4])).drop("flight_id")


@query(""", o as (select *, row_number() over (partition by flight_id order by timestamp_ms, seq) as n from vt),
p as (select *, case when seq % 3 <> 0 then n end as m, case when seq % 3 <> 0 then sharpness end as px from o),
b as (select *, last_value(m ignore nulls) over a as ln, last_value(px ignore nulls) over a as lx, first_value(m ignore nulls) over z as rn, first_value(px ignore nulls) over z as rx, count(m) over (partition by flight_id) as posed_frames, count(*) over (partition by flight_id) as total
  from p window a as (partition by flight_id order by n rows between unbounded preceding and current row), z as (partition by flight_id order by n rows between current row and unbounded following))
select flight_id, n as k, m is not null as posed, round(case when ln is null then rx when rn is null or ln = rn then lx else lx + (n - ln) / (rn - ln) * (rx - lx) end, 6) as x from b where posed_frames >= 4 and total - posed_frames <= 0.5e0 * total""")
def registered_cameras(spark, d):
    order = Window.partitionBy("flight_id").orderBy("timestamp_ms", "seq")
    frames = vt(spark, d).withColumn("k", F.row_number().over(order).cast("long")).withColumn("name", F.format_string("frames/frame_%05d.jpg", "k"))
    poses = frames.where("seq % 3 <> 0").select("flight_id", F.format_string("frame_%05d.jpg", "k").alias("name"), F.col("sharpness").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return rounded(sync.registered_cameras(frames, poses).select("flight_id", "k", "posed", "x"), 6, "x")


@query(", v as (select flight_id, (array[0e0, 12.5e0, 25e0, 29.97e0, 50e0, 60e0])[1 + flight_id % 6] as fps from (select distinct flight_id from vt)) select vt.flight_id, seq as raw_i, round(seq * 1000 / if(fps > 0, fps, 30e0), 6) as ms from vt join v on v.flight_id = vt.flight_id where seq % greatest(round_even(if(fps > 0, fps, 30e0) / 5, 0)::int, 1) = 0")
def video_sampling(spark, d):
    frames = vt(spark, d).select("flight_id", F.col("seq").alias("raw_i"))
    fps = F.array(*[F.lit(x) for x in (0.0, 12.5, 25.0, 29.97, 50.0, 60.0)])
    videos = frames.select("flight_id").distinct().withColumn("fps", F.get(fps, (F.col("flight_id") % 6).cast("int")))
    return rounded(sync.sampled_videos(frames, videos, 5.0), 6, "ms")


@query("""select r.flight_id, first_frame, last_frame, n_records, video_first_frame, video_last_frame, first_frame <= video_first_frame + 150 and last_frame >= video_last_frame - 150 as covered
  from (select flight_id, min(seq) as first_frame, max(seq) as last_frame, count(*) as n_records from vt where seq % 5 = 0 group by 1) r
  join (select flight_id, min(seq) as video_first_frame, max(seq) as video_last_frame from vt group by 1) f on f.flight_id = r.flight_id""")
def frame_coverage(spark, d):
    v = vt(spark, d)
    return telemetry.frame_coverage(v.where("seq % 5 = 0").withColumn("frame_idx", F.col("seq")), v.select("flight_id", F.col("seq").alias("raw_i")))


@query("select flight_id, count(p) as n_pitch, if(count(p) >= 3, median(p), null) as median_pitch, if(count(p) >= 3, abs(median(p)) > 60, null) as nadir from (select flight_id, if(seq % 9 < flight_id % 9, null, gimbal_pitch) as p from vt) group by 1")
def camera_pitch(spark, d):
    return telemetry.pitch(vt(spark, d).select("flight_id", F.expr("if(seq % 9 < flight_id % 9, null, gimbal_pitch)").alias("gimbal_pitch")))


@query(f", v as ({_VIEWS} vt), f as (select flight_id, max(conf) filter (where view % 5 <> 0 and view < 10) / max(conf) filter (where view % 5 = 0 and view < 15) as f from v group by 1) select v.flight_id, view, round(if(view % 5 = 0 and view < 15, conf * coalesce(f, 1), conf), 9) as conf from v join f on f.flight_id = v.flight_id")
def head_window_rescale(spark, d):
    views = spark.sql(f"{_VIEWS} {{v}}", v=vt(spark, d)).withColumn("view", F.col("view").cast("long"))
    return rounded(sync.rescaled_head(views.select("flight_id", "view", "conf"), 3, 5), 9, "conf")


@query(f", v as ({_VIEWS} vt) select flight_id, view from (select *, row_number() over (partition by flight_id order by view desc) as n from v) where n <= 7")
def fifo_buffer(spark, d):
    views = spark.sql(f"{_VIEWS} {{v}}", v=vt(spark, d)).withColumn("view", F.col("view").cast("long"))
    return sync.fifo(views.select("flight_id", "view"), 7)


@query("select flight_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, y as density from vc join (select flight_id as f, k as kk, quantile_cont(y, 0.05) as q from vc group by 1, 2) on f = flight_id and kk = k where y >= q")
def density_trim(spark, d):
    vertices = vc(spark, d).withColumn("density", F.col("y"))
    return cloud.dense_vertices(vertices, ["flight_id", "k"]).select("flight_id", *PT[:4], "density")


@query("select flight_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, (k * 64 + px_row) * 64 + px_col as pt_id from vc")
def point_numbers(spark, d):
    return cloud.numbered(vc(spark, d), 64, 64).select("flight_id", *PT[:4], "pt_id")


@query("""select distinct flight_id, k, px_row, px_col from vc where exists (from (select distinct flight_id, k, px_row // 2 as r, px_col // 4 as c from mask) m where m.flight_id = vc.flight_id and m.k = vc.k and m.r = px_row // 2 and m.c = px_col // 4)""")
def mask_resize(spark, d):
    points = vc(spark, d)
    small = mask(points).select("flight_id", "k", F.floor(F.col("px_row") / 2).alias("px_row"), F.floor(F.col("px_col") / 4).alias("px_col"))
    return cloud.resized_mask(small, points.select(*cloud.PIXEL).distinct(), (32, 16), (64, 64))
