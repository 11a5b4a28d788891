"""Point clouds: confidence and mask filters, camera centres, voxels, rasters, moments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .state import cut

CONFIDENT = 10.0
NOWHERE = 1e-9
PIXEL = ["flight_id", "k", "px_row", "px_col"]
#: Detector classes of things that move.
DYNAMIC_CLASSES = [0, 1, 2, 3, 5, 7, 8, 14, 16]


def somewhere() -> Column:
    return F.abs("x") + F.abs("y") + F.abs("z") > NOWHERE


def finite() -> Column:
    ok = F.lit(True)
    for c in "xyz":
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return ok


def camera_centres(points: DataFrame, least_conf: float = CONFIDENT, enough: int = 8, strict: bool = False) -> DataFrame:
    """Per frame the mean of its confident points; of all that lie somewhere, where those are few; of all, where none do.

    Point maps without a conf column have no confident points. A centre that isn't finite has
    sound = false; strict=True raises.
    """
    sure, some = (F.col("conf") > least_conf) if "conf" in points.columns else F.lit(False), somewhere()
    mean = lambda cond, tag: [F.avg(F.when(cond, F.col(c))).alias(f"{tag}{c}") for c in "xyz"]
    stats = points.groupBy("flight_id", "k").agg(F.count_if(sure).alias("n_sure"), F.count_if(some).alias("n_some"), *mean(sure, "s"), *mean(some, "m"), *mean(F.lit(True), "a"))
    pick = lambda c: F.when(F.col("n_sure") >= enough, F.col(f"s{c}")).when(F.col("n_some") > 0, F.col(f"m{c}")).otherwise(F.col(f"a{c}")).alias(c)
    found = stats.select("flight_id", "k", "n_sure", *map(pick, "xyz"))
    if strict:
        fault = F.raise_error(F.format_string("the centre of frame %s of flight %s isn't finite", F.col("k").cast("string"), F.col("flight_id").cast("string"))).cast("double")
        return found.withColumns({c: F.when(finite(), F.col(c)).otherwise(fault) for c in "xyz"}).withColumn("sound", F.lit(True))
    return found.withColumn("sound", finite())


def masked_cloud(points: DataFrame, mask: DataFrame, least_conf: float = CONFIDENT) -> DataFrame:
    """Points off the mask, confident, finite and somewhere."""
    return points.where((F.col("conf") > least_conf) & finite() & somewhere()).join(mask.select(*PIXEL).distinct(), PIXEL, "left_anti")


def resized_mask(mask: DataFrame, pixels: DataFrame, made: tuple[int, int], wanted: tuple[int, int]) -> DataFrame:
    """Those of pixels (PIXEL, of a raster of `wanted` rows and columns) whose nearest pixel of the mask's raster `made` is in mask."""
    at = pixels.select(*PIXEL).withColumns({"__r": F.floor(F.col("px_row") * made[0] / wanted[0]), "__c": F.floor(F.col("px_col") * made[1] / wanted[1])})
    own = mask.select("flight_id", "k", F.col("px_row").cast("long").alias("__r"), F.col("px_col").cast("long").alias("__c")).distinct()
    return at.join(own, ["flight_id", "k", "__r", "__c"], "left_semi").select(*PIXEL)


def coloured(points: DataFrame, *sources: DataFrame) -> DataFrame:
    """points with r, g, b from the first of sources (PIXEL, r, g, b) that has the pixel, else their own, else grey."""
    out = points
    for i, s in enumerate(sources):
        out = out.join(s.select(*PIXEL, F.struct("r", "g", "b").alias(f"__{i}")), PIXEL, "left")
    own = [[F.col(c)] if c in points.columns else [] for c in "rgb"]
    return out.select(*[c for c in points.columns if c not in "rgb"], *[F.coalesce(*[F.col(f"__{i}.{c}") for i in range(len(sources))], *o, F.lit(0.5)).alias(c) for c, o in zip("rgb", own)])


def numbered(points: DataFrame, height: int, width: int) -> DataFrame:
    """points with pt_id: frames in order, a frame's pixels row by row."""
    return points.withColumn("pt_id", (F.col("k").cast("long") * height + F.col("px_row")) * width + F.col("px_col"))


def dense_vertices(vertices: DataFrame, by: list[str], share: float = 0.05) -> DataFrame:
    """vertices (density, ...) without those below the share's quantile of each mesh's density."""
    least = vertices.groupBy(*by).agg(F.percentile("density", F.lit(share)).alias("__least"))
    return vertices.join(least, by).where(F.col("density") >= F.col("__least")).drop("__least")


def mask_statistics(points: DataFrame, mask: DataFrame, least_conf: float = CONFIDENT) -> DataFrame:
    marked = points.join(mask.select(*PIXEL).distinct().withColumn("masked", F.lit(True)), PIXEL, "left")
    masked = F.coalesce("masked", F.lit(False))
    good = (F.col("conf") > least_conf) & finite() & somewhere()
    return marked.groupBy("flight_id").agg(F.count("*").alias("total"), F.count_if(masked).alias("masked"), F.count_if(~masked & good).alias("valid")).withColumn("masked_fraction", F.col("masked") / F.col("total"))


def low_confidence_views(points: DataFrame, least: float = CONFIDENT) -> DataFrame:
    return points.groupBy("flight_id", "k").agg(F.avg("conf").alias("mean_conf")).where(F.col("mean_conf") < least)


def detection_masks(boxes: DataFrame, pixels: DataFrame, least_conf: float = 0.25) -> DataFrame:
    """Pixels under any box of a thing that moves; boxes: flight_id, k, cls, conf, r0, r1, c0, c1."""
    able = boxes.where(F.col("cls").isin(DYNAMIC_CLASSES) & (F.col("conf") >= least_conf))
    rows = able.select("flight_id", "k", "c0", "c1", F.explode(F.sequence("r0", "r1")).alias("px_row"))
    marked = rows.select("flight_id", "k", "px_row", F.explode(F.sequence("c0", "c1")).alias("px_col")).distinct()
    return pixels.select(*PIXEL).join(marked, PIXEL, "left_semi")


def resampled(points: DataFrame, n: int, order: Column, least_conf: float = CONFIDENT) -> DataFrame:
    """n confident points in the order of a hash column, axes flipped for viewers: a top-k, not a sort of all."""
    return points.where((F.col("conf") > least_conf) & somewhere()).orderBy(order).limit(n).withColumn("y", -F.col("y")).withColumn("z", -F.col("z"))


def bounds(points: DataFrame, by: list[str]) -> DataFrame:
    """Minimum, maximum, centre and span (at least 1) of each axis, with the scale of 32-bit coordinates."""
    aggs = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    found = points.groupBy(*by).agg(F.count("*").alias("n_points"), *aggs)
    for c in "xyz":
        span = F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(1.0))
        found = found.withColumn(f"span_{c}", span).withColumn(f"scale_{c}", F.greatest(F.col(f"span_{c}") / 1e7, F.lit(0.001)))
    return found


def voxels(points: DataFrame, grid: DataFrame, aggregates: list[Column], by: list[str]) -> DataFrame:
    """One row per occupied voxel of each cloud's grid (by, size, low_x, low_y, low_z), which begins half a voxel before low."""
    placed = points.join(grid.select(*by, "size", *[f"low_{c}" for c in "xyz"]), by)
    at = [F.floor((F.col(c) - F.col(f"low_{c}") + F.col("size") / 2) / F.col("size")).alias(f"v{c}") for c in "xyz"]
    return placed.select(*[placed[c] for c in points.columns], *at).groupBy(*by, "vx", "vy", "vz").agg(*aggregates)


def voxel_grids(points: DataFrame, budget: int, by: list[str], rounds: int = 5) -> DataFrame:
    """by, size, low_x, low_y, low_z of each cloud of more than budget points: about that many voxels are occupied.

    Sizes are tried by counting only, all clouds that still search at once; a cloud stops within a
    tenth of the budget, and keeps the size that was tried last.
    """
    lows = [F.min(c).alias(f"low_{c}") for c in "xyz"]
    spans = [F.greatest(F.max(c) - F.min(c), F.lit(1e-4)).alias(f"s{c}") for c in "xyz"]
    boxes = points.groupBy(*by).agg(F.count("*").alias("n"), *lows, *spans).where(F.col("n") > budget)
    first = F.greatest(F.pow(F.col("sx") * F.col("sy") * F.col("sz") / budget, F.lit(1 / 3)), F.lit(1e-4))
    grids = cut(boxes.select(*by, *[f"low_{c}" for c in "xyz"], first.alias("size"), first.alias("next"), F.lit(False).alias("done")))
    for _ in range(rounds):
        tried = grids.where("not done").withColumn("size", F.col("next"))
        counts = voxels(points, tried, [F.count("*").alias("m")], by).groupBy(*by).agg(F.count("*").alias("found"))
        found = F.coalesce("found", F.lit(0))
        near = F.abs(found - budget) < 0.1 * budget
        change = F.when(found == 0, F.lit(0.5)).otherwise(F.greatest(F.pow(found / budget, F.lit(1 / 3)), F.lit(0.1)))
        after = tried.join(counts, by, "left").withColumn("next", F.when(near, F.col("size")).otherwise(F.col("size") * change)).withColumn("done", near).drop("found")
        grids = cut(grids.where("done").unionByName(after))
        if grids.where("not done").isEmpty():
            break
    return grids.select(*by, "size", *[f"low_{c}" for c in "xyz"])


def voxel_downsample(points: DataFrame, budget: int, by: list[str], rounds: int = 5) -> DataFrame:
    """by, x, y, z and colours: means per voxel of the clouds over budget points, the others as they are."""
    grids = voxel_grids(points, budget, by, rounds)
    fields = [c for c in ("x", "y", "z", "r", "g", "b") if c in points.columns]
    thinned = voxels(points, grids, [F.avg(c).alias(c) for c in fields], by).select(*by, *fields)
    return points.join(grids.select(*by), by, "left_anti").select(*by, *fields).unionByName(thinned)


def raster(points: DataFrame, order: Column, box: DataFrame, by: list[str], side: int = 1024) -> DataFrame:
    """Sparse top-down cells (gx, gy, r, g, b); of a cell's points the last by order shows.

    order is a long (pt_id), so that a cell's colour and rank are two numbers in a hash table before
    the shuffle. box: per `by`, min_x, max_x, min_y, max_y; an extent of nothing is widened by half a unit either way.
    """
    flat = lambda c: F.col(f"max_{c}") - F.col(f"min_{c}") <= 0
    lo = lambda c: F.when(flat(c), F.col(f"min_{c}") - 0.5).otherwise(F.col(f"min_{c}"))
    hi = lambda c: F.when(flat(c), F.col(f"max_{c}") + 0.5).otherwise(F.col(f"max_{c}"))
    cell = lambda c: ((F.col(c) - lo(c)) / (hi(c) - lo(c)) * (side - 1)).cast("int")
    inside = lambda x: F.greatest(F.least(x, F.lit(side - 1)), F.lit(0))
    placed = points.join(box, by).withColumn("gx", inside(cell("x"))).withColumn("gy", inside((side - 1) - cell("y")))
    r, g, b = (geo.quantised(F.col(c), 255) for c in "rgb")
    cells = placed.groupBy(*by, "gx", "gy").agg(F.max_by(r * 65536 + g * 256 + b, order).alias("c"))
    part = lambda i: F.call_function("shiftright", F.col("c"), F.lit(8 * i)).bitwiseAND(255)
    return cells.select(*by, "gx", "gy", part(2).alias("r"), part(1).alias("g"), part(0).alias("b"))


def moments(points: DataFrame, by: list[str], a: str = "xyz") -> DataFrame:
    """Means and population covariances, in one pass over all points."""
    pairs = [(a[i], a[j]) for i in range(3) for j in range(i, 3)]
    return points.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in a], *[F.covar_pop(p, q).alias(f"cov_{p}{q}") for p, q in pairs])


def fit_moments(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Means, source variance and cross-covariance of control points (x,y,z) -> (u,v,w)."""
    cross = [F.covar_pop(q, p).alias(f"cov_{q}{p}") for q in "uvw" for p in "xyz"]
    var = (F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("src_var")
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in "xyzuvw"], var, *cross)


def error_stats(errors: DataFrame, by: list[str], e: str = "e") -> DataFrame:
    """Root mean square, mean, median, 95th percentile, maximum, population deviation, count."""
    return errors.groupBy(*by).agg(F.sqrt(F.avg(F.col(e) * F.col(e))).alias("rmse_m"), F.avg(e).alias("mean_error_m"), F.median(e).alias("median_error_m"), F.percentile(e, F.lit(0.95)).alias("p95_error_m"), F.max(e).alias("max_error_m"), F.stddev_pop(e).alias("std_dev_m"), F.count(e).alias("sample_points_count"))


def label_components(mask: np.ndarray) -> np.ndarray:
    """8-connected components of a boolean image, numbered by their least pixel plus one; 0 elsewhere."""
    h, w = mask.shape
    labels = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    big = h * w + 1
    while True:
        padded = np.pad(np.where(labels > 0, labels, big), 1, constant_values=big)
        low = np.minimum.reduce([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)])
        new = np.where(mask, low, 0)
        # follow labels to the labels of the pixels that they name
        new = np.where(mask, np.minimum(new, np.concatenate([[0], new.ravel()])[new]), 0)
        if (new == labels).all():
            return labels
        labels = new


def mask_components(mask: DataFrame) -> DataFrame:
    """mask's pixels with component (the least row * 65536 + column of it) and area: a kernel per frame."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = rows["px_row"].min(), rows["px_col"].min()
        image = np.zeros((rows["px_row"].max() - r0 + 1, rows["px_col"].max() - c0 + 1), bool)
        at = (rows["px_row"] - r0, rows["px_col"] - c0)
        image[at] = True
        labels = label_components(image)[at]
        least = labels - 1
        area = np.bincount(labels)
        width = image.shape[1]
        rows["component"] = (least // width + r0) * 65536 + least % width + c0
        rows["area"] = area[labels]
        return rows[[*PIXEL, "component", "area"]]

    own = mask.select("flight_id", "k", F.col("px_row").cast("long"), F.col("px_col").cast("long")).distinct()
    kind = own.schema["flight_id"].dataType.simpleString()
    return own.groupBy("flight_id", "k").applyInPandas(run, f"flight_id {kind}, k {own.schema['k'].dataType.simpleString()}, px_row long, px_col long, component long, area long")


def cleaned_mask(image: np.ndarray, least: int) -> np.ndarray:
    """Components over least pixels, with holes of at most least pixels (off the border) filled."""
    if least <= 0 or not image.any():
        return image
    labels = label_components(image)
    big = np.bincount(labels.ravel()) > least
    big[0] = False
    out = big[labels]
    holes = label_components(~out)
    border = np.unique(np.concatenate([holes[0], holes[-1], holes[:, 0], holes[:, -1]]))
    small = np.bincount(holes.ravel()) <= least
    small[border] = False
    small[0] = False
    return out | small[holes]


def cleaned_masks(mask: DataFrame, height: int, width: int, least: int) -> DataFrame:
    """PIXEL of each frame's mask after cleaned_mask: a kernel per frame over its image."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width), bool)
        image[rows["px_row"], rows["px_col"]] = True
        r, c = np.nonzero(cleaned_mask(image, least))
        return pd.DataFrame({"flight_id": rows["flight_id"].iloc[0], "k": rows["k"].iloc[0], "px_row": r, "px_col": c})

    own = mask.select(*[F.col(c).cast("long") for c in PIXEL]).where(F.col("px_row").between(0, height - 1) & F.col("px_col").between(0, width - 1)).distinct()
    return own.groupBy("flight_id", "k").applyInPandas(run, "flight_id long, k long, px_row long, px_col long")
