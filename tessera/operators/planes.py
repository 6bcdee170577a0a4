"""Pixels to colour planes, chroma up-sampling, and planes back to pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.color import premultiplied, rgb, ycbcr

#: Horizontal and vertical subsampling by ratio.
RATIOS = {"444": (1, 1), "422": (2, 1), "420": (2, 2), "440": (1, 2), "411": (4, 1), "410": (4, 2)}


def _long(df: DataFrame, y: Column, cb: Column, cr: Column, gray: bool = False) -> DataFrame:
    values = [y] if gray else [y, cb, cr]
    each = F.posexplode(F.array(*(v.cast("int") for v in values))).alias("ch", "v")
    return df.select("img_id", "x", "y", each).select("img_id", "ch", "x", "y", "v")


def planes_rgb(pixels: DataFrame, bw: bool = False) -> DataFrame:
    """(img_id, ch, x, y, v); with ``bw`` the chroma planes are never computed. Alpha, if any, is ignored."""
    return _long(pixels, *ycbcr(F.col("r"), F.col("g"), F.col("b")), gray=bw)


def to_rgba(pixels: DataFrame) -> DataFrame:
    """Any pixel relation as (img_id, x, y, r, g, b, a), opaque."""
    c = ("r", "g", "b") if "r" in pixels.columns else ("v", "v", "v")
    return pixels.select("img_id", "x", "y", *(F.col(n).alias(t) for n, t in zip(c, "rgb", strict=True)), F.lit(255).alias("a"))


def planes_gray(pixels: DataFrame, bw: bool = False) -> DataFrame:
    return _long(pixels, F.col("v"), F.lit(128), F.lit(128), gray=bw)


def planes_generic16(pixels: DataFrame) -> DataFrame:
    """Straight 16-bit samples (r16, g16, b16, a16): premultiplied, cut to 8 bits, then converted."""
    c = [premultiplied(F.col(n), F.col("a16")) for n in ("r16", "g16", "b16")]
    p = pixels.select("img_id", "x", "y", *(v.alias(n) for v, n in zip(c, "rgb", strict=True)))
    return planes_rgb(p)


def subsample(planes: DataFrame, ratio: str) -> DataFrame:
    """Chroma samples of a full-resolution relation at every fx-th column and fy-th row."""
    fx, fy = RATIOS[ratio]
    kept = planes.where((F.col("ch") > 0) & (F.col("x") % fx == 0) & (F.col("y") % fy == 0))
    return kept.select("img_id", "ch", F.floor(F.col("x") / fx).cast("int").alias("x"), F.floor(F.col("y") / fy).cast("int").alias("y"), "v")


def upsample(luma: DataFrame, chroma: DataFrame, ratio: str) -> DataFrame:
    """Nearest chroma for each luma sample: an equi-join on the divided coordinates."""
    fx, fy = RATIOS[ratio]
    at = luma.select("img_id", "x", "y", F.floor(F.col("x") / fx).cast("int").alias("cx"), F.floor(F.col("y") / fy).cast("int").alias("cy"))
    c = chroma.select(F.col("img_id").alias("c_img"), "ch", F.col("x").alias("c_x"), F.col("y").alias("c_y"), "v")
    up = at.join(c, (at.img_id == c.c_img) & (at.cx == c.c_x) & (at.cy == c.c_y)).select("img_id", "ch", "x", "y", "v")
    return luma.select("img_id", F.lit(0).alias("ch"), "x", "y", "v").unionByName(up)


def pixels_of(planes: DataFrame, channels: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(img_id, x, y, r, g, b) from the planes given; others count as absent."""
    at = lambda ch: F.max(F.when(F.col("ch") == ch, F.col("v")))
    wide = planes.groupBy("img_id", "x", "y").agg(at(0).alias("yy"), *(at(ch).alias(f"c{ch}") for ch in channels if ch))
    r, g, b = rgb(F.col("yy"), F.col("c1") if 1 in channels else None, F.col("c2") if 2 in channels else None)
    return wide.select("img_id", "x", "y", r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))
