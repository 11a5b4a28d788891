"""Fitting reconstructions to GPS: small dense kernels, one group per flight.

Control points are a flight's cameras (x, y, z reconstructed, u, v, w from GPS), a few
thousand rows at most; clouds never enter a kernel: they get the fitted transform by a join.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo

SCALES = (0.25, 4.0)
#: Inliers that one spline takes at most, and cameras that share one where there are more.
LOCAL, STRETCH = 300, 64
Fit = tuple[float, np.ndarray, np.ndarray]


def umeyama_each(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least-squares scales, rotations, translations with dst = s R src + t (Umeyama 1991) of stacks (m, n, 3)."""
    ms, md = src.mean(1), dst.mean(1)
    a, b = src - ms[:, None], dst - md[:, None]
    variance = (a**2).sum((1, 2)) / src.shape[1]
    u, d, vt = np.linalg.svd(np.einsum("mni,mnj->mij", b, a) / src.shape[1])
    flip = np.ones_like(d)
    flip[:, 2] = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
    r = (u * flip[:, None]) @ vt
    still = variance < 1e-12
    s = np.where(still, 1.0, (d * flip).sum(1) / np.where(still, 1.0, variance))
    r[still] = np.eye(3)
    return s, r, md - s[:, None] * np.einsum("mij,mj->mi", r, ms)


def umeyama(src: np.ndarray, dst: np.ndarray) -> Fit:
    s, r, t = umeyama_each(src[None], dst[None])
    return float(s[0]), r[0], t[0]


def residuals(fit: Fit, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    return np.linalg.norm(fit[0] * src @ fit[1].T + fit[2] - dst, axis=1)


def ransac(src: np.ndarray, dst: np.ndarray, rounds: int = 300, near: float = 1.5, size: int = 4, seed: int = 42) -> tuple[Fit, np.ndarray]:
    """Robust fit and its inliers: the first sample with most of them wins, then is refitted on them.

    All samples are drawn first and fitted at once. Samples that don't reach over a fifth of the
    flight, or whose scale is far from that of all points (where that has one), don't count.
    """
    whole = umeyama(src, dst)
    if len(src) < size:
        return whole, np.arange(len(src))
    sane = lambda s: (whole[0] <= 1e-4) | ((s >= SCALES[0] * whole[0]) & (s <= SCALES[1] * whole[0]))
    inliers, best = np.flatnonzero(residuals(whole, src, dst) < near), whole
    rng = np.random.default_rng(seed)
    drawn = np.stack([rng.choice(len(src), size, replace=False) for _ in range(rounds)])
    span = lambda x: np.linalg.norm(x.max(-2) - x.min(-2), axis=-1)
    extent = span(src)
    if extent > 1e-3:
        drawn = drawn[span(src[drawn]) >= 0.2 * extent]
    try:
        s, r, t = umeyama_each(src[drawn], dst[drawn])
    except np.linalg.LinAlgError:
        return best, inliers
    good = np.isfinite(s) & sane(s)
    s, r, t = s[good], r[good], t[good]
    if len(s):
        counts = [int((residuals((s[i], r[i], t[i]), src, dst) < near).sum()) for i in range(len(s))]
        first = int(np.argmax(counts))
        if counts[first] > len(inliers):
            best = (float(s[first]), r[first], t[first])
            inliers = np.flatnonzero(residuals(best, src, dst) < near)
    if len(inliers) >= size:
        fit = umeyama(src[inliers], dst[inliers])
        best = fit if sane(fit[0]) else best
    return best, inliers


def gravity_roll(normal: np.ndarray, gps: np.ndarray) -> np.ndarray:
    """Rotation about the flight axis that brings the ground's normal upright, as far as a roll can."""
    if len(gps) < 3:
        return np.eye(3)
    axis = gps[-1] - gps[0]
    if np.linalg.norm(axis) < 1e-3:
        axis = np.linalg.svd(gps - gps.mean(0))[2][0]
    axis = axis / np.linalg.norm(axis)
    normal = normal if normal[2] >= 0 else -normal
    up = np.array([0.0, 0.0, 1.0])
    # in the plane across the axis: up's direction, and a quarter turn on from it
    e = up - axis * axis[2]
    if min(np.linalg.norm(e), np.linalg.norm(normal - axis * (normal @ axis))) < 1e-4:
        return np.eye(3)
    e = e / np.linalg.norm(e)
    angle = -np.arctan2(normal @ np.cross(axis, e), normal @ e)
    k = np.cross(np.eye(3), axis)
    return np.cos(angle) * np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * np.outer(axis, axis)


def thin_plate(at: np.ndarray, values: np.ndarray, smoothing: float = 1.0):
    """Thin-plate spline in three dimensions with a linear part; a function of new positions."""

    def kernel(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        square = np.maximum((p**2).sum(1)[:, None] + (q**2).sum(1) - 2 * p @ q.T, 0)
        return 0.5 * square * np.log(np.where(square > 1e-18, square, 1))

    centre = at.mean(0)
    at = at - centre
    n = len(at)
    poly = np.hstack([np.ones((n, 1)), at])
    system = np.block([[kernel(at, at) + smoothing * np.eye(n), poly], [poly.T, np.zeros((4, 4))]])
    weights = np.linalg.solve(system, np.vstack([values, np.zeros((4, values.shape[1]))]))
    return lambda x: kernel(x - centre, at) @ weights[:n] + np.hstack([np.ones((len(x), 1)), x - centre]) @ weights[n:]


def winged(at: np.ndarray, values: np.ndarray, reach: float = 15.0) -> tuple[np.ndarray, np.ndarray]:
    """Each point and six more around it with the same value, so that the spline doesn't run away."""
    shifts = np.vstack([np.zeros(3), reach * np.eye(3), -reach * np.eye(3)])
    return (at[:, None] + shifts).reshape(-1, 3), np.repeat(values, 7, axis=0)


def drift(cameras: np.ndarray, gps: np.ndarray, inliers: np.ndarray) -> np.ndarray:
    """Smooth correction of the cameras towards GPS, clipped; none below eight inliers.

    The spline's system is dense: beyond LOCAL inliers a stretch of cameras takes those nearest
    to its middle, so time and memory stay linear in the flight.
    """
    moved = np.zeros_like(cameras)
    if len(inliers) < 8:
        return moved
    left = gps[inliers] - cameras[inliers]
    most = max(2.0, 1.5 * float(np.percentile(np.abs(left), 95)))
    step = len(cameras) if len(inliers) <= LOCAL else STRETCH
    for a in range(0, len(cameras), step):
        own = cameras[a : a + step]
        near = np.argsort(((cameras[inliers] - own.mean(0)) ** 2).sum(1), kind="stable")[:LOCAL]
        try:
            moved[a : a + step] = np.clip(thin_plate(*winged(cameras[inliers][near], left[near]))(own), -most, most)
        except np.linalg.LinAlgError:
            continue
    return moved


class Solved(NamedTuple):
    """One similarity for cloud and cameras (the roll is in it), and the cameras brought to their positions."""

    fit: Fit
    inliers: np.ndarray
    rolled: bool
    rigid: np.ndarray
    moved: np.ndarray


def solve(src: np.ndarray, dst: np.ndarray, mean: np.ndarray | None = None, covariance: np.ndarray | None = None, seen: np.ndarray | None = None) -> Solved:
    """Fit, roll about the moved cloud's centroid, spline for the cameras only.

    mean, covariance: of the cloud as reconstructed; without them nothing is rolled. seen: the cameras
    that may be fitted (all); inliers count among them.
    """
    seen = np.arange(len(src)) if seen is None else seen
    (s, r, t), inliers = ransac(src[seen], dst[seen])
    inliers, roll = seen[inliers], np.eye(3)
    if covariance is not None and np.isfinite(covariance).all():
        roll = gravity_roll(r @ np.linalg.eigh(covariance)[1][:, 0], dst)
        pivot = s * r @ mean + t
        r, t = roll @ r, roll @ (t - pivot) + pivot
    rigid = s * src @ r.T + t
    return Solved((s, r, t), inliers, not np.allclose(roll, np.eye(3), atol=1e-6), rigid, drift(rigid, dst, inliers))


_MOMENTS = [*(f"mean_{c}" for c in "xyz"), *(f"cov_{a}" for a in ("xx", "xy", "xz", "yy", "yz", "zz"))]


def _with_moments(control: DataFrame, cloud_moments: DataFrame | None) -> DataFrame:
    if cloud_moments is None:
        return control.withColumns({c: F.lit(None).cast("double") for c in _MOMENTS})
    return control.join(cloud_moments.select("flight_id", *_MOMENTS), "flight_id", "left")


def _read(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Cameras, positions, and the cloud's mean and covariance of one flight's rows."""
    xx, xy, xz, yy, yz, zz = rows[_MOMENTS[3:]].iloc[0].astype(float)
    covariance = np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]])
    return rows[["x", "y", "z"]].to_numpy(float), rows[["u", "v", "w"]].to_numpy(float), rows[_MOMENTS[:3]].iloc[0].to_numpy(float), covariance


TRANSFORM = "flight_id long, scale double, rotation array<array<double>>, translation array<double>, n long, n_inliers long, rolled boolean, rmse_m double"


def fit_transforms(control: DataFrame, cloud_moments: DataFrame | None = None) -> DataFrame:
    """TRANSFORM: one row per flight, from control points (flight_id, k, x, y, z, u, v, w).

    The one transform of a flight's cloud and of its cameras before the spline; with the cloud's
    moments (cloud.moments by flight) the gravity roll is part of it.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        src, dst, mean, covariance = _read(rows.sort_values("k"))
        found = solve(src, dst, mean, covariance)
        s, r, t = found.fit
        error = np.sqrt((residuals(found.fit, src, dst) ** 2).mean())
        return pd.DataFrame([{"flight_id": rows["flight_id"].iloc[0], "scale": s, "rotation": r.tolist(), "translation": t.tolist(), "n": len(src), "n_inliers": len(found.inliers), "rolled": found.rolled, "rmse_m": float(error)}])

    return _with_moments(control, cloud_moments).groupBy("flight_id").applyInPandas(run, TRANSFORM)


def apply_transforms(points: DataFrame, transforms: DataFrame) -> DataFrame:
    """points moved by their flight's transform (a join; Spark broadcasts it only where it is small)."""
    moved = points.join(transforms.select("flight_id", "scale", "rotation", "translation"), "flight_id")
    kept = [c for c in points.columns if c not in "xyz"]
    return moved.select(*kept, *geo.similarity(F.col("x"), F.col("y"), F.col("z"), F.col("scale"), F.col("rotation"), F.col("translation")))


CAMERAS = "flight_id long, k long, x double, y double, z double, inlier boolean, rolled boolean, shift_m double"


def georeference(control: DataFrame, cloud_moments: DataFrame | None) -> DataFrame:
    """CAMERAS: moved by the flight's transform (fit_transforms) and by the spline, per flight."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        src, dst, mean, covariance = _read(rows)
        found = solve(src, dst, mean, covariance)
        out = pd.DataFrame(found.rigid + found.moved, columns=["x", "y", "z"])
        out["flight_id"], out["k"] = rows["flight_id"].to_numpy(), rows["k"].to_numpy()
        out["inlier"] = np.isin(np.arange(len(src)), found.inliers)
        out["rolled"], out["shift_m"] = found.rolled, np.linalg.norm(found.moved, axis=1)
        return out[[c.split()[0] for c in CAMERAS.split(", ")]]

    return _with_moments(control, cloud_moments).groupBy("flight_id").applyInPandas(run, CAMERAS)


_ERRORS = ("rmse_m", "mean_error_m", "median_error_m", "p95_error_m", "max_error_m", "std_dev_m")
REPORT = "flight_id long, keyframes long, held_out long, " + ", ".join(f"{c} double" for c in _ERRORS) + ", passed boolean, " + ", ".join(f"residual_{c} double" for c in _ERRORS)


def _stats(e: np.ndarray) -> list[float]:
    found = [np.sqrt((e**2).mean()), e.mean(), np.median(e), np.percentile(e, 95), e.max(), e.std()]
    return [round(float(x), 4) for x in found]


def hold_out_report(control: DataFrame, target_m: float = 1.0, share: float = 0.2, seed: int = 42, cloud_moments: DataFrame | None = None) -> DataFrame:
    """REPORT: errors of the delivered model (fit, roll, spline) on cameras that it didn't see.

    residual_*: what is left where it saw all, a diagnostic of the fit only. Flights of too few
    cameras get nulls. Rounded to 4 places.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        src, dst, mean, covariance = _read(rows)
        k = len(src)
        n = max(1, round(share * k))
        row = {"flight_id": rows["flight_id"].iloc[0], "keyframes": k, "held_out": 0} | {c.split()[0]: None for c in REPORT.split(", ")[3:]}
        error = lambda found: np.linalg.norm(found.rigid + found.moved - dst, axis=1)
        if k >= 4:
            row |= dict(zip([f"residual_{c}" for c in _ERRORS], _stats(error(solve(src, dst, mean, covariance)))))
        if k >= 4 and k - n >= 4:
            out = np.random.default_rng(seed).choice(k, n, replace=False)
            seen = np.setdiff1d(np.arange(k), out)
            row |= dict(zip(_ERRORS, _stats(error(solve(src, dst, mean, covariance, seen))[out]))) | {"held_out": n}
            row["passed"] = bool(row["rmse_m"] <= target_m)
        return pd.DataFrame([row])

    return _with_moments(control, cloud_moments).groupBy("flight_id").applyInPandas(run, REPORT)


# What the report's parts mean.
_RESIDUAL = "A diagnostic of the fit only: the cameras were drawn to these positions, so small values are no accuracy."
_FEW = "Too few cameras to hold some out and fit the others."
_CAVEAT = "Only the hold-out error tells of accuracy, and only where the telemetry is marked as verified."


def report_json(report: DataFrame, target_m: float = 1.0, source: str = "unknown") -> DataFrame:
    """flight_id, value: the report as a nested JSON document, with what its parts mean and what may be claimed."""
    part = lambda prefix, *more: F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in _ERRORS], *more)
    held = F.when(F.col("passed").isNull(), F.to_json(F.struct(F.lit(_FEW).alias("meaning")))).otherwise(F.to_json(part("", "passed")))
    left = F.when(F.col("residual_rmse_m").isNull(), F.to_json(F.struct(F.lit(_FEW).alias("meaning")))).otherwise(F.to_json(part("residual_", F.lit(_RESIDUAL).alias("meaning"))))
    head = F.to_json(F.struct(F.lit(target_m).alias("target_accuracy_m"), "keyframes", F.lit(source).alias("gps_source"), F.lit(source == "verified").alias("accuracy_claim_allowed")))
    tail = F.to_json(F.struct(F.lit(_CAVEAT).alias("honesty_caveat")))
    inner = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    value = F.concat(F.lit("{"), inner(head), F.lit(',"alignment_residual":'), left, F.lit(',"holdout_ate":'), held, F.lit(","), inner(tail), F.lit("}"))
    return report.select("flight_id", value.alias("value"))
