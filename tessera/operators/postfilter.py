"""Deblocking of decoded pixels: flat boundaries, then junctions. Only for small blocks wider than one pixel.

Pixels are (img_id, x, y, r, g, b, w, h) with their picture's size, so one plan filters pictures of any sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.color import luma

#: Fixed values of the format: luma differences up to which a boundary is flat, four corners meet, and a run goes on; and the longest run.
FLAT, JUNCTION_SPREAD, SIMILAR, RUN = 10, 32, 8, 3
CHANNELS = ("r", "g", "b")


def _pass(pixels: DataFrame, small: int, axis: str) -> DataFrame:
    """Pixels on both sides of a grid line are averaged where their luma is close; the sides meet by a self equi-join."""
    other = "y" if axis == "x" else "x"
    p = pixels.withColumn("l", luma(*map(F.col, CHANNELS)))
    at = F.col(axis)
    # a pixel's partner across the nearest grid line, if it touches one
    wide = (F.col("w") >= 2 * small) & (F.col("h") >= 2 * small)
    partner = F.when((at % small == 0) & (at > 0), at - 1).when(at % small == small - 1, at + 1)
    p = p.withColumn("partner", F.when(wide, partner))
    q = p.select(F.col("img_id").alias("q_img"), F.col(axis).alias("q_at"), F.col(other).alias("q_other"), *(F.col(c).alias(f"q_{c}") for c in (*CHANNELS, "l")))
    j = p.join(q, (F.col("img_id") == F.col("q_img")) & (F.col("partner") == F.col("q_at")) & (F.col(other) == F.col("q_other")), "left")
    near = F.abs(F.col("l") - F.col("q_l")) <= FLAT
    return j.select("img_id", "x", "y", "w", "h", *(F.when(near, F.floor((F.col(c) + F.col(f"q_{c}")) / 2).cast("int")).otherwise(F.col(c)).alias(c) for c in CHANNELS))


def deblock(pixels: DataFrame, small: int, passes: str = "xy") -> DataFrame:
    """Pictures of fewer than two blocks in either direction stay as they are."""
    for axis in passes:
        pixels = _pass(pixels, small, axis)
    return pixels


def _lerp(a: Column, b: Column, t: Column) -> Column:
    return F.floor(a.cast("double") * (1 - t) + b.cast("double") * t + 0.5).cast("int")


def junctions(pixels: DataFrame, small: int) -> DataFrame:
    """Around each inner grid point with like corners, a rectangle of like pixels becomes their bilinear blend.

    Each point gathers its pixels by an equi-join on the point they are near to; of overlapping rectangles the later one
    in scan order stays.
    """
    radius = min(small, RUN)
    p = pixels.withColumn("l", luma(*map(F.col, CHANNELS)))
    reach = range(-radius, radius)
    # every pixel goes to the points whose cross it is on: at most four for each offset
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in reach for dy in reach if dx in (-1, 0) or dy in (-1, 0)))
    near = p.where((F.col("w") >= 2 * small) & (F.col("h") >= 2 * small)).select("img_id", "x", "y", "w", "h", *CHANNELS, "l", F.explode(offsets).alias("o"))
    jx, jy = F.col("x") - F.col("o.dx"), F.col("y") - F.col("o.dy")
    near = near.withColumn("jx", jx).withColumn("jy", jy).where((jx % small == 0) & (jy % small == 0) & (jx > 0) & (jy > 0) & (jx < F.col("w")) & (jy < F.col("h")))
    at = lambda c, dx, dy: F.max(F.when((F.col("o.dx") == dx) & (F.col("o.dy") == dy), F.col(c)))
    corner = {"_nw": (-1, -1), "_ne": (0, -1), "_sw": (-1, 0), "_se": (0, 0)}
    cols = [at(c, *d).alias(f"{c}{k}") for k, d in corner.items() for c in (*CHANNELS, "l")]
    for i in range(1, radius + 1):
        for name, a, b in (("L", (-i, -1), (-i, 0)), ("R", (i - 1, -1), (i - 1, 0)), ("U", (-1, -i), (0, -i)), ("D", (-1, i - 1), (0, i - 1))):
            cols += [at("l", *a).alias(f"{name}{i}a"), at("l", *b).alias(f"{name}{i}b")]
    j = near.groupBy("img_id", "jy", "jx").agg(*cols)
    ls = [F.col(f"l{k}") for k in corner]
    j = j.where(F.greatest(*ls) - F.least(*ls) <= JUNCTION_SPREAD)
    for name, a, b in (("L", "l_nw", "l_sw"), ("R", "l_ne", "l_se"), ("U", "l_nw", "l_ne"), ("D", "l_sw", "l_se")):
        run: Column = F.lit(0)
        for i in range(radius, 0, -1):
            ok = F.coalesce((F.abs(F.col(f"{name}{i}a") - F.col(a)) <= SIMILAR) & (F.abs(F.col(f"{name}{i}b") - F.col(b)) <= SIMILAR), F.lit(False))
            run = F.when(ok, 1 + run).otherwise(0)
        j = j.withColumn(name, run)
    x0, x1, y0, y1 = F.col("jx") - F.col("L"), F.col("jx") - 1 + F.col("R"), F.col("jy") - F.col("U"), F.col("jy") - 1 + F.col("D")
    j = j.withColumn("px", F.explode(F.sequence(x0, x1))).withColumn("py", F.explode(F.sequence(y0, y1)))
    u, v = (F.col("px") - x0).cast("double") / (x1 - x0), (F.col("py") - y0).cast("double") / (y1 - y0)
    blend = [_lerp(_lerp(F.col(f"{c}_nw"), F.col(f"{c}_ne"), u), _lerp(F.col(f"{c}_sw"), F.col(f"{c}_se"), u), v).alias(c) for c in CHANNELS]
    new = j.groupBy(F.col("img_id").alias("n_img"), F.col("px").alias("n_x"), F.col("py").alias("n_y")).agg(F.max_by(F.struct(*blend), F.struct("jy", "jx")).alias("n"))
    out = pixels.join(new, (F.col("img_id") == F.col("n_img")) & (F.col("x") == F.col("n_x")) & (F.col("y") == F.col("n_y")), "left")
    return out.select("img_id", "x", "y", "w", "h", *(F.coalesce(F.col(f"n.{c}"), F.col(c)).alias(c) for c in CHANNELS))


def postfilter(pixels: DataFrame, small: int) -> DataFrame:
    return junctions(deblock(pixels, small), small) if small > 1 else pixels
