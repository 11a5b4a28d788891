"""Array, point and raster files, and the joins of cameras."""

import io
import struct

import numpy as np
import pytest

from aerolens.operators import cloud, sync
from aerolens.sources import arrays, binary

XYZ = "flight_id long, k long, x double, y double, z double"


@pytest.mark.parametrize("shape", [(2, 3, 4, 3), (2, 12, 3), (24, 3)])
def test_arrays_of_any_shape(spark, tmp_path, shape):
    values = np.arange(72, dtype=np.float32)
    np.save(tmp_path / "a.npy", np.asfortranarray(values.reshape(shape)))
    rows = arrays.read_arrays(spark, str(tmp_path), 3, 4, ["x", "y", "z"]).orderBy("k", "px_row", "px_col").collect()
    assert [v for r in rows for v in (r.x, r.y, r.z)] == values.tolist()
    assert [(r.k, r.px_row, r.px_col) for r in rows] == [(k, i, j) for k in range(2) for i in range(3) for j in range(4)]


def test_arrays_refused_and_empty(spark, tmp_path):
    def saved(a, **more):
        out = io.BytesIO()
        np.save(out, a, **more)
        return out.getvalue()

    with pytest.raises(ValueError):
        arrays.array_of(saved(np.array([{}], object), allow_pickle=True))
    with pytest.raises(ValueError):
        arrays.array_of(b"no array")
    with pytest.raises(ValueError):
        arrays.framed(np.zeros((5, 3)), 2, 2, 3)
    np.save(tmp_path / "none.npy", np.zeros((0, 2, 2)))
    assert arrays.read_arrays(spark, str(tmp_path), 2, 2, ["conf"]).count() == 0


def test_point_file(spark, tmp_path):
    rows = [(1, i, i * 1.5, -i / 4, 7.0, 1.0, i / 300, 0.0) for i in range(300)] + [(2, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "flight_id long, pt_id long, x double, y double, z double, r double, g double, b double")
    parts = binary.points_parts(points, cloud.bounds(points, ["flight_id"]), "pt_id")
    binary.save(parts.where("flight_id = 1"), str(tmp_path / "c.las"))
    data = (tmp_path / "c.las").read_bytes()
    assert data[:4] == b"LASF" and len(data) == binary.HEADER_BYTES + 300 * 34
    assert struct.unpack_from("<H", data, 94) == (375,) and struct.unpack_from("<Q", data, 247) == (300,)
    scale, low = (np.array(struct.unpack_from("<3d", data, at)) for at in (131, 155))
    assert struct.unpack_from("<2d", data, 179) == (299 * 1.5, 0.0)  # greatest and least x
    records = np.frombuffer(data, binary.RECORD, 300, 375)
    back = np.stack([records[c] for c in "xyz"], 1) * scale + low
    assert np.abs(back - np.array([r[2:5] for r in rows[:300]])).max() <= 0.0005 + 1e-9
    assert (records["r"] == 65535).all() and records["g"][150] == 32767


def test_raster_file(spark, tmp_path):
    side = 100
    cells = spark.createDataFrame([(1, 5, 70, 1, 2, 3), (1, 99, 0, 9, 8, 7)], "flight_id long, gx int, gy int, r int, g int, b int")
    extents = spark.createDataFrame([(1, 10.0, 20.0, 11.0, 22.0)], "flight_id long, west double, south double, east double, north double")
    binary.save(binary.raster_parts(cells, extents, side), str(tmp_path / "r.tif"))
    data = (tmp_path / "r.tif").read_bytes()
    assert data[:4] == b"II*\0"
    tags = {t: (k, n, data[at + 8 : at + 12]) for at in range(10, 10 + 13 * 12, 12) for t, k, n in [struct.unpack_from("<HHI", data, at)]}
    assert list(tags) == sorted(tags)
    many = lambda t, f: struct.unpack_from(f, data, struct.unpack("<I", tags[t][2])[0])
    first, second = many(273, "<2I")
    assert many(279, "<2I") == (64 * 300, 36 * 300) and second + 36 * 300 == len(data)
    image = np.frombuffer(data, np.uint8, side * side * 3, first).reshape(side, side, 3)
    assert image[70, 5].tolist() == [1, 2, 3] and image[0, 99].tolist() == [9, 8, 7] and (image == 110).sum() == side * side * 3 - 6
    assert many(33550, "<3d") == (0.01, 0.02, 0.0) and many(33922, "<6d")[3:5] == (10.0, 22.0)


def test_cameras_are_paired_by_place(spark):
    some = spark.createDataFrame([(f, k, float(k), 0.0, 0.0) for f, n in ((1, 3), (2, 2)) for k in range(n)], XYZ)
    proxies = spark.createDataFrame([(f, k, -1.0 - k, 0.0, 0.0) for f in (1, 2, 3) for k in range(3)], XYZ)
    gps = spark.createDataFrame([(f, k, 0.0, 0.0, float(k)) for f in (1, 2, 3) for k in (4, 6)], "flight_id long, k long, u double, v double, w double")
    found = sorted((r.flight_id, r.k, r.x, r.w) for r in sync.paired_cameras(some, proxies, gps).collect())
    assert found == [(1, 0, 0.0, 4.0), (1, 1, 1.0, 6.0), (2, 0, -1.0, 4.0), (2, 1, -2.0, 6.0), (3, 0, -1.0, 4.0), (3, 1, -2.0, 6.0)]


def test_too_few_poses(spark):
    frames = spark.createDataFrame([(f, k, f"d/{k}.jpg") for f in (1, 2) for k in range(8)], "flight_id long, k long, name string")
    poses = spark.createDataFrame([(f, f"{k}.jpg", float(k), 0.0, None) for f, ks in ((1, (1, 2, 5, 6)), (2, (1, 2, 5))) for k in ks], "flight_id long, name string, x double, y double, z double")
    assert [(r.flight_id, r.k, r.x, r.z) for r in sync.registered_cameras(frames, poses).orderBy("k").collect()] == [(1, k, float(min(max(k, 1), 6)), None) for k in range(8)]
