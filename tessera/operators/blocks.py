"""Planes to two-level blocks, in one exchange by macro block.

A macro block's values (64 at most) meet in one array; whether it stays whole, its small blocks, their levels and
masks are array expressions on that row. Sequence numbers come from counts of rows of blocks, their running sum, and a
rank within each row, so no task orders a whole channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layout(w: Column, h: Column, small: int | Column, macro: int | Column) -> tuple[Column, Column, Column, Column]:
    """Width and height in whole small blocks, and of the part in whole macro blocks."""
    cut = lambda v, s: (F.floor(v / s) * s).cast("int")
    w4, h4 = cut(w, small), cut(h, small)
    return w4, h4, cut(w4, macro), cut(h4, macro)


def too_small(sizes: DataFrame, small: int) -> DataFrame:
    """Images without one whole small block."""
    return sizes.where((F.col("w") < small) | (F.col("h") < small))


def block_values(planes: DataFrame, small: int, macro: int, spread: int) -> DataFrame:
    """(img_id, ch, region, gy, gx, sy, sx, x0, y0, side, is_macro, vals): each block's values in raster order.

    ``planes`` has w and h beside (img_id, ch, x, y, v). Pixels outside whole small blocks are dropped.
    """
    w4, h4, fw, fh = layout(F.col("w"), F.col("h"), small, macro)
    x, y = F.col("x"), F.col("y")
    p = planes.where((x < w4) & (y < h4)).withColumn("region", F.when(y >= fh, 2).when(x >= fw, 1).otherwise(0))
    grid = F.when(F.col("region") == 0, macro).otherwise(small)
    p = p.select("img_id", "ch", "region", F.floor(y / grid).cast("int").alias("gy"), F.floor(x / grid).cast("int").alias("gx"), "x", "y", "v")
    # a value with its place in one number: sorted as longs, in raster order
    placed = F.shiftleft(F.col("y").cast("long"), 36) + F.shiftleft(F.col("x").cast("long"), 8) + F.col("v")
    p = p.groupBy("img_id", "ch", "region", "gy", "gx").agg(F.sort_array(F.collect_list(placed)).alias("raster"))
    p = p.withColumn("vals", F.transform("raster", lambda e: e.bitwiseAND(255).cast("int")))
    big = (F.col("region") == 0) & (F.array_max("vals") - F.array_min("vals") < spread)
    k = macro // small

    def part(j: int, i: int) -> Column:
        inside = F.array(*(F.get("vals", F.lit((j * small + y) * macro + i * small + x)) for y in range(small) for x in range(small)))
        return F.struct(F.lit(j).alias("sy"), F.lit(i).alias("sx"), inside.alias("vals"))

    parts = F.array(*(part(j, i) for j in range(k) for i in range(k)))
    whole = F.array(F.struct(F.lit(0).alias("sy"), F.lit(0).alias("sx"), F.col("vals").alias("vals")))
    p = p.withColumn("is_macro", big.cast("int")).withColumn("part", F.explode(F.when((F.col("region") > 0) | big, whole).otherwise(parts)))
    first = F.col("raster")[0]
    x0 = (F.shiftright(first, 8).bitwiseAND((1 << 28) - 1) + F.col("part.sx") * small).cast("int")
    y0 = (F.shiftright(first, 36) + F.col("part.sy") * small).cast("int")
    return p.select("img_id", "ch", "region", "gy", "gx", "part.sy", "part.sx", x0.alias("x0"), y0.alias("y0"), F.sqrt(F.size("part.vals")).cast("int").alias("side"), "is_macro", "part.vals")


def fit(blocks: DataFrame) -> DataFrame:
    """Adds is_pattern, fg, bg and bits (null for a solid block) in place of vals; 6 and 8 wide masks go by quadrant."""
    v = F.col("vals")
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, e: s + e)
    b = blocks.withColumn("thr", F.floor(add(v) / F.size(v)).cast("int"))
    b = b.withColumn("hi", F.filter("vals", lambda e: e >= F.col("thr"))).withColumn("lo", F.filter("vals", lambda e: e < F.col("thr")))
    b = b.withColumn("fg_", F.floor(add(F.col("hi")) / F.size("hi")).cast("int")).withColumn("bg_", F.floor(add(F.col("lo")) / F.nullif(F.size("lo"), F.lit(0))).cast("int"))
    pattern = F.coalesce((F.size("lo") > 0) & (F.col("fg_") != F.col("bg_")), F.lit(False))
    raster = F.array_join(F.transform("vals", lambda e: F.when(e >= F.col("thr"), "1").otherwise("0")), "")
    order = F.col("side").isin(6, 8)
    quads = raster
    for side in (6, 8):
        half = side // 2
        rows = [F.substring(raster, (qy * half + r) * side + qx * half + 1, half) for qy in (0, 1) for qx in (0, 1) for r in range(half)]
        quads = F.when(F.col("side") == side, F.concat(*rows)).otherwise(quads)
    bits = F.when(order, quads).otherwise(raster)
    return b.select("img_id", "ch", "region", "gy", "gx", "sy", "sx", "x0", "y0", "side", "is_macro", pattern.cast("int").alias("is_pattern"), F.when(pattern, F.col("fg_")).otherwise(F.col("thr")).alias("fg"), F.when(pattern, F.col("bg_")).alias("bg"), F.when(pattern, bits).alias("bits"))


def number(blocks: DataFrame) -> DataFrame:
    """Adds seq, from 0 in scan order within (img_id, ch)."""
    key = ["img_id", "ch", "region", "gy"]
    rows = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("img_id", "ch").orderBy("region", "gy").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(*(F.col(c).alias(f"o_{c}") for c in key), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy(*key).orderBy("gx", "sy", "sx")) - 1
    ranked = blocks.withColumn("rank", within)
    joined = ranked.join(rows, (F.col("img_id") == F.col("o_img_id")) & (F.col("ch") == F.col("o_ch")) & (F.col("region") == F.col("o_region")) & (F.col("gy") == F.col("o_gy")))
    return joined.withColumn("seq", (F.col("ahead") + F.col("rank")).cast("int")).drop("ahead", "rank", *(f"o_{c}" for c in key))


def encode_blocks(planes: DataFrame, small: int, macro: int, spread: int) -> DataFrame:
    return number(fit(block_values(planes, small, macro, spread)))


def with_size(planes: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Adds w and h of each image: from ``sizes`` (img_id, w, h), or the largest coordinates of its first plane."""
    sizes = sizes if sizes is not None else sizes_of(planes.where("ch = 0"))
    return planes.join(sizes.select(F.col("img_id").alias("s_img"), "w", "h"), F.col("img_id") == F.col("s_img")).drop("s_img")


def sizes_of(pixels: DataFrame) -> DataFrame:
    """(img_id, w, h) from the largest coordinates."""
    return pixels.groupBy("img_id").agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"))
