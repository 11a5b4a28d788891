"""A whole run over two planted flights, and small operators without SQL."""

import json
import os
import time

import numpy as np
import pytest

from aerolens.__main__ import main
from aerolens.operators import cloud, sync, telemetry
from aerolens.plans import run
from aerolens.sources import files, listing


def planted(spark, where):
    """Flights whose point maps are the telemetry's metres, scaled by a half and shifted."""
    rng = np.random.default_rng(5)
    records, points = [], []
    for flight in (1, 2):
        for k in range(12):
            lat, lon, alt = 28.6 + 1e-3 * float(rng.random()), 77.2 + 1e-3 * float(rng.random()), 60.0  # level, so nothing is to be rolled
            records.append((flight, k, 1000.0 * k, lat, lon, alt, 99.0))
            o = records[-1 - k]
            e, n, u = (lon - o[4]) * 111320 * np.cos(np.radians(o[3])), (lat - o[3]) * 111320, alt - o[5]
            for i in range(9):
                far = 1.0 if i % 2 else -1.0
                points.append((flight, k * 9 + i, k, i, 0, float(e / 2 + 3 + (i < 8) * far), float(n / 2 + (i < 8) * far), float(u / 2), 20.0, 0.5, 0.5, 0.5))
    spark.createDataFrame(records, "flight_id long, seq long, timestamp_ms double, latitude double, longitude double, altitude_m double, sharpness double").write.parquet(f"{where}/telemetry")
    cloud = spark.createDataFrame(points, "flight_id long, pt_id long, k long, px_row long, px_col long, x double, y double, z double, conf double, r double, g double, b double")
    cloud.write.parquet(f"{where}/points")
    cloud.where("px_row = 8 and k < 3").select("flight_id", "k", "px_row", "px_col").write.parquet(f"{where}/mask")


def test_run_and_evaluate_again(spark, tmp_path):
    planted(spark, tmp_path)
    out = str(tmp_path / "out")
    main([str(tmp_path), out, "--verified"])
    fits = spark.read.parquet(f"{out}/transforms").collect()
    assert len(fits) == 2 and all(f.scale == pytest.approx(2, abs=1e-6) and f.rmse_m < 1e-6 for f in fits)
    documents = [json.loads(r.value) for r in spark.read.text(f"{out}/manifest").collect()]
    assert [(m["total"], m["masked"], m["cameras"]) for m in documents] == [(108, 3, 12)] * 2
    assert spark.read.parquet(f"{out}/cloud").count() == 2 * 105
    assert [json.loads(r.value)["holdout_ate"]["passed"] for r in spark.read.text(f"{out}/report.json").collect()] == [True, True]
    assert all(json.loads(r.value)["axis_order"]["x"] == "east_m" for r in spark.read.text(f"{out}/frame.json").collect())
    assert all(r.passed and r.accuracy_claim_allowed for r in spark.read.parquet(f"{out}/report").collect())
    main([str(tmp_path), out, "--evaluate-only"])
    assert [(r.passed, r.accuracy_claim_allowed) for r in spark.read.parquet(f"{out}/report").collect()] == [(True, False)] * 2


def test_reservoir_and_transforms_document(spark):
    views = spark.createDataFrame([(f, v) for f, n in ((1, 20), (2, 3)) for v in range(n)], "flight_id long, view long")
    once, again = (sorted(map(tuple, sync.reservoir(views, 5).collect())) for _ in range(2))
    assert once == again and [sum(f == g for g, _ in once) for f in (1, 2)] == [5, 3]
    cameras = spark.createDataFrame([(1, 1, 4.0, 5.0, 6.0), (1, 0, 1.0, 2.0, 3.0)], "flight_id long, k int, x double, y double, z double")
    document = json.loads(files.transforms_json(cameras).first().value)
    assert [f["transform_matrix"][0] for f in document["frames"]] == [[1, 0, 0, 1.0], [1, 0, 0, 4.0]]
    assert document["frames"][1]["file_path"] == "frame_00001.jpg"


def subtitles(spark, where, flights=(1, 2), drop=()):
    """The planted telemetry once more, as subtitle texts with a video of 25 frames a second."""
    planted(spark, where)
    rows = spark.read.parquet(f"{where}/telemetry").orderBy("flight_id", "seq").collect()
    texts, frames = [], []
    for f in flights:
        own = [r for r in rows if r.flight_id == f and r.seq not in drop]
        blocks = [f"{r.seq + 1}\n00:00:{r.seq:02d},000 --> 00:00:{r.seq:02d},500\n[latitude: {r.latitude!r}] [longitude: {r.longitude!r}] [rel_alt: {r.altitude_m!r}] SrtCnt : {r.seq * 25 + 1} [gimbal_pitch: -70 x] [gimbal_yaw: 0] [gimbal_roll: 5]" for r in own]
        texts.append((f, "\n\n".join(blocks)))
        frames += [(f, i, 40.0 * i, 99.0) for i in range(276)]
    spark.createDataFrame(texts, "flight_id long, content string").write.parquet(f"{where}/subtitles")
    spark.createDataFrame(frames, "flight_id long, raw_i long, ms double, sharpness double").write.parquet(f"{where}/frames")
    spark.createDataFrame([(f, 25.0) for f in flights], "flight_id long, fps double").write.parquet(f"{where}/videos")


def test_run_from_subtitles(spark, tmp_path):
    subtitles(spark, tmp_path)
    heard = []
    settings = run.Settings(target_fps=1.0, cloud_budget=50)
    run.run(spark, str(tmp_path), str(tmp_path / "out"), settings, lambda share, part: heard.append((share, part)))
    assert [p for _, p in heard] == list(run.PARTS) and heard[-1][0] == 100
    have = spark.read.parquet(str(tmp_path / "out" / "telemetry")).orderBy("flight_id", "seq").collect()
    want = spark.read.parquet(str(tmp_path / "telemetry")).orderBy("flight_id", "seq").collect()
    assert [(r.flight_id, r.seq // 25, r.timestamp_ms) for r in have] == [(r.flight_id, r.seq, r.timestamp_ms) for r in want]
    assert np.allclose([r.latitude for r in have], [r.latitude for r in want], atol=1e-12) and {(r.gimbal_pitch, r.gimbal_roll) for r in have} == {(-70.0, 5.0)}
    assert all(r.passed for r in spark.read.parquet(str(tmp_path / "out" / "report")).collect())
    assert spark.read.parquet(str(tmp_path / "out" / "cloud")).count() < 2 * 105

    def stop(share, part):
        if part == "control":
            raise run.Cancelled

    with pytest.raises(run.Cancelled):
        run.run(spark, str(tmp_path), str(tmp_path / "other"), settings, stop)
    assert not (tmp_path / "other" / "transforms").exists()


def test_uncovered_video_is_refused(spark, tmp_path):
    subtitles(spark, tmp_path, drop=range(7))
    with pytest.raises(run.Unusable, match="cover"):
        run.prepared(*[spark.read.parquet(str(tmp_path / n)) for n in ("subtitles", "frames", "videos")])


def test_subtitles_to_json_and_back(spark, tmp_path):
    subtitles(spark, tmp_path)
    texts = spark.read.parquet(str(tmp_path / "subtitles"))
    telemetry.write_records(texts, str(tmp_path / "json"))
    back = telemetry.read_records(spark, str(tmp_path / "json"))
    want = telemetry.parse_subtitles(texts)
    key = lambda r: (r.latitude, r.timestamp_ms, r.frame_idx, r.gimbal_roll)
    assert sorted(map(key, back.collect())) == sorted(map(key, want.collect()))
    assert sorted(os.listdir(tmp_path / "json"))[-1] == "name=2_gps.json"
    with pytest.raises(ValueError, match="no position"):
        telemetry.write_records(spark.createDataFrame([(7, "1\nnothing")], "flight_id long, content string"), str(tmp_path / "none"))


def test_listings(spark, tmp_path):
    for i, name in enumerate(["frame_00002.jpg", "frame_00010.jpg", "other.txt", "a.SRT", "cloud.ply"]):
        (tmp_path / name).write_text("ply\nformat ascii 1.0\nelement vertex 1\nend_header\n1 2 3 255 0 0\n3 0 0 0" if name.endswith("ply") else "x")
        os.utime(tmp_path / name, (time.time() - 3600 * (40 - 10 * i),) * 2)
    assert [(r.k, r.name) for r in listing.frames(spark, str(tmp_path)).collect()] == [(2, "frame_00002.jpg"), (10, "frame_00010.jpg")]
    found = listing.files(spark, str(tmp_path))
    name = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert (name(listing.newest(found)), name(listing.first(found)), name(listing.last(found))) == (["cloud.ply"], ["a.SRT"], ["other.txt"])
    assert sorted(name(listing.expired(found, 24.0))) == ["frame_00002.jpg", "frame_00010.jpg"]
    assert name(listing.ordered([found, found.where("path like '%.jpg'")])) == sorted(["frame_00002.jpg", "frame_00010.jpg", "other.txt", "a.SRT", "cloud.ply"])
    assert [tuple(r) for r in files.read_newest_ply(spark, str(tmp_path)).collect()] == [(1.0, 2.0, 3.0, 1.0, 0.0, 0.0)]
    assert telemetry.discover(spark, [str(tmp_path / "none"), str(tmp_path)], "a").endswith("a.SRT")
    assert telemetry.discover(spark, [str(tmp_path / "none")], "a") is None


def test_voxel_budget_by_flight(spark):
    rng = np.random.default_rng(1)
    rows = [(f, *map(float, p)) for f, n, w in ((1, 4000, 10), (2, 3000, 300), (3, 50, 5)) for p in rng.uniform(0, w, (n, 3))]
    points = spark.createDataFrame(rows, "flight_id long, x double, y double, z double")
    out = cloud.voxel_downsample(points, 500, ["flight_id"]).toPandas()
    counts = out.groupby("flight_id").size()
    assert counts[3] == 50 and all(300 < counts[f] < 800 for f in (1, 2)) and out[out.flight_id == 1].x.max() <= 10
    grids = {r.flight_id: r for r in cloud.voxel_grids(points, 500, ["flight_id"]).collect()}
    for f in (1, 2):
        p = np.array([r[1:] for r in rows if r[0] == f])
        g = grids[f]
        cells = np.floor((p - [g.low_x, g.low_y, g.low_z] + g.size / 2) / g.size)
        assert len(np.unique(cells, axis=0)) == counts[f]


def test_masks_and_colours(spark):
    points = spark.createDataFrame([(1, 0, r, c, 0.1, 0.2, 0.3) for r in range(4) for c in range(4)], "flight_id long, k long, px_row long, px_col long, r double, g double, b double")
    shown = points.where("px_row = 0").withColumn("r", points["r"] + 0.5)
    assert {(r.px_row == 0, round(r.r, 2)) for r in cloud.coloured(points, shown).collect()} == {(True, 0.6), (False, 0.1)}
    assert {r.r for r in cloud.coloured(points.drop("r", "g", "b"), shown.where("false")).collect()} == {0.5}
    square = points.where("px_row < 3 and px_col < 3 and not (px_row = 1 and px_col = 1)")
    assert cloud.cleaned_masks(square, 4, 4, 2).count() == 9
    bad = spark.createDataFrame([(1, 0, float("nan"), 0.0, 0.0, 20.0)], "flight_id long, k long, x double, y double, z double, conf double")
    assert not cloud.camera_centres(bad).first().sound
    with pytest.raises(Exception, match="isn't finite"):
        cloud.camera_centres(bad, strict=True).collect()
