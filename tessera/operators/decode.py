"""Streams to blocks to planes to pixels.

Sizes are columns, so a table of pictures of any sizes and block sizes is decoded in one plan. Each stream becomes rows of
bytes once; blocks meet them by position, and offsets into a stream are running sums by parts of the channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import layout
from tessera.operators.prefix import running
from tessera.plans.tables import materialize

#: Largest macro block and largest pixel count that are decoded.
MAX_MACRO, MAX_PIXELS = 8, 1 << 28
#: Fixed value of the format: the streams of a segment, in order.
STREAMS = ("size", "type", "pattern", "fg", "bg")


def byte_rows(streams: DataFrame, name: str, *keep: str) -> DataFrame:
    """(img_id, ch, pos, byte, *keep) of one stream: a byte a row."""
    n = F.length(name)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.hex(F.substring(F.col(name), i + 1, F.lit(1))), 16, 10).cast("int"))
    return streams.where(n > 0).select("img_id", "ch", *keep, F.posexplode(each).alias("pos", "byte"))


def _met(rows: DataFrame, at: Column, found: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """``rows`` with the ``column`` of ``found`` (img_id, ch, pos, column) whose pos is ``at``."""
    f = found.select(F.col("img_id").alias("m_img"), F.col("ch").alias("m_ch"), F.col("pos").cast("long").alias("m_pos"), column)
    r = rows.withColumn("at_", at.cast("long"))
    return r.join(f, (F.col("img_id") == F.col("m_img")) & (F.col("ch") == F.col("m_ch")) & (F.col("at_") == F.col("m_pos")), how).drop("at_", "m_img", "m_ch", "m_pos")


def placed(streams: DataFrame) -> DataFrame:
    """(img_id, ch, seq, x0, y0, side, is_macro, is_pattern) of the blocks of streams (img_id, ch, w, h, small, macro, size, type)."""
    w4, h4, fw, fh = layout(F.col("w"), F.col("h"), F.col("small"), F.col("macro"))
    s = streams.select("img_id", "ch", "size", *(F.col(c).cast("int").alias(c) for c in ("small", "macro")), w4.alias("w4"), h4.alias("h4"), fw.alias("fw"), fh.alias("fh"))
    small, macro, i = F.col("small"), F.col("macro"), F.col("i")
    each = F.floor(macro / small) * F.floor(macro / small)
    across = F.floor(F.col("fw") / macro)
    sizes = ["small", "macro", "fw"]
    m = byte_rows(s.where("fw > 0 AND fh > 0").withColumn("macros", across * F.floor(F.col("fh") / macro)), "size", *sizes, "macros")
    m = m.select("img_id", "ch", *sizes, "macros", F.col("pos"), "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).withColumn("i", F.col("pos").cast("long") * 8 + F.col("bit"))
    m = m.where(i < F.col("macros")).select("img_id", "ch", *sizes, "i", F.pmod(F.floor(F.col("byte") / F.pow(F.lit(2.0), 7 - F.col("bit"))), F.lit(2)).cast("int").alias("is_macro"))
    count = F.when(F.col("is_macro") == 1, 1).otherwise(each)
    m = materialize(m, "macros")
    inside = m.groupBy(F.col("img_id").alias("n_img"), F.col("ch").alias("n_ch")).agg(F.sum(count).alias("n_inside"))
    j, k = F.col("j"), F.floor(macro / small)
    seq_type = "long"
    inner = running(m, "i", {"first": count}).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).select(
        "img_id", "ch", (F.col("first") + j).cast(seq_type).alias("seq"), (i % across * macro + F.when(F.col("is_macro") == 1, 0).otherwise(j % k * small)).alias("x0"),
        (F.floor(i / across) * macro + F.when(F.col("is_macro") == 1, 0).otherwise(F.floor(j / k) * small)).alias("y0"), F.when(F.col("is_macro") == 1, macro).otherwise(small).alias("side"), "is_macro",
    )
    s = s.drop("size").join(inside, (F.col("img_id") == F.col("n_img")) & (F.col("ch") == F.col("n_ch")), "left").withColumn("n_inside", F.coalesce("n_inside", F.lit(0)))

    def stripe(rows: DataFrame, n: Column, ahead: Column, wide: Column, x0: Column, y0: Column) -> DataFrame:
        r = rows.where(n > 0).withColumn("wide", wide).withColumn("ahead", ahead).select("*", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("i"))
        return r.select("img_id", "ch", (F.col("n_inside") + F.col("ahead") + i).cast(seq_type).alias("seq"), (x0 + i % F.col("wide") * small).alias("x0"), (y0 + F.floor(i / F.col("wide")) * small).alias("y0"), small.alias("side"), F.lit(0).alias("is_macro"))

    per_row, rows_right = F.floor((F.col("w4") - F.col("fw")) / small), F.floor(F.col("fh") / small)
    right = per_row * rows_right
    per_low = F.floor(F.col("w4") / small)
    bottom = per_low * F.floor((F.col("h4") - F.col("fh")) / small)
    b = inner.unionByName(stripe(s, right, F.lit(0), per_row, F.col("fw"), F.lit(0))).unionByName(stripe(s, bottom, right, per_low, F.lit(0), F.col("fh")))
    b = _met(b, F.floor(F.col("seq") / 8), byte_rows(streams, "type"), "byte")
    kind = F.pmod(F.floor(F.col("byte") / F.pow(F.lit(2.0), 7 - F.col("seq") % 8)), F.lit(2)).cast("int")
    return b.select("img_id", "ch", "seq", *(F.col(c).cast("int").alias(c) for c in ("x0", "y0", "side", "is_macro")), kind.alias("is_pattern"))


def blocks_of(streams: DataFrame) -> DataFrame:
    """(img_id, ch, seq, x0, y0, side, is_macro, is_pattern, fg, bg, bits) of streams (img_id, ch, w, h, small, macro, size, type, pattern, fg, bg).

    Streams must be sound (``codec.parse`` tells).
    """
    # tables that several of the following steps read are written
    b = materialize(_met(placed(streams), F.col("seq"), byte_rows(streams, "fg").withColumnRenamed("byte", "level"), "level"), "blocks")
    area = F.col("side") * F.col("side")
    b = running(b, "seq", {"kth": F.col("is_pattern"), "start": F.col("is_pattern") * area, "sum": F.col("level")})
    b = materialize(b.withColumn("fg", (F.col("sum") + F.col("level")).bitwiseAND(255).cast("int")).drop("sum", "level"), "blocks")
    low = running(byte_rows(streams, "bg"), "pos", {"sum": F.col("byte")}).withColumn("bg", (F.col("sum") + F.col("byte")).bitwiseAND(255).cast("int"))
    pattern = materialize(_met(b.where("is_pattern = 1"), F.col("kth"), low, "bg"), "patterns")
    # a mask of at most 64 bits lies in at most nine bytes
    span = F.sequence(F.floor(F.col("start") / 8), F.floor((F.col("start") + area - 1) / 8))
    parts = pattern.select("img_id", "ch", "seq", F.explode(span).alias("at"))
    parts = _met(parts, F.col("at"), byte_rows(streams, "pattern"), "byte").groupBy(F.col("img_id").alias("b_img"), F.col("ch").alias("b_ch"), F.col("seq").alias("b_seq"))
    each = F.transform(F.sort_array(F.collect_list(F.col("at") * 256 + F.col("byte"))), lambda e: F.lpad(F.bin(e.bitwiseAND(255)), 8, "0"))
    masks = parts.agg(F.array_join(each, "").alias("wide"))
    pattern = pattern.join(masks, (F.col("img_id") == F.col("b_img")) & (F.col("ch") == F.col("b_ch")) & (F.col("seq") == F.col("b_seq")))
    pattern = pattern.withColumn("bits", F.substring(F.col("wide"), (F.col("start") % 8 + 1).cast("int"), area))
    out = ["img_id", "ch", F.col("seq").cast("int").alias("seq"), "x0", "y0", "side", "is_macro", "is_pattern", "fg"]
    solid = b.where("is_pattern = 0").select(*out, F.lit(None).cast("int").alias("bg"), F.lit(None).cast("string").alias("bits"))
    return solid.unionByName(pattern.select(*out, "bg", "bits"))


def streams_of(segments: DataFrame, heads: DataFrame) -> DataFrame:
    """What ``blocks_of`` reads, from segments (img_id, ch, size_hex, ..., bg_hex) and heads (img_id, w, h, small, macro)."""
    h = heads.select(F.col("img_id").alias("h_img"), "w", "h", "small", "macro")
    return segments.join(h, F.col("img_id") == F.col("h_img")).select("img_id", "ch", "w", "h", "small", "macro", *(F.unhex(f"{n}_hex").alias(n) for n in STREAMS))


def planes_of(blocks: DataFrame) -> DataFrame:
    """(img_id, ch, x, y, v): each block's pixels; 6 and 8 wide masks are stored by quadrant."""
    b = blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("side") * F.col("side") - 1)))
    y, x = F.floor(F.col("k") / F.col("side")), F.col("k") % F.col("side")
    half = F.floor(F.col("side") / 2)
    quad = (F.floor(y / half) * 2 + F.floor(x / half)) * half * half + (y % half) * half + x % half
    at = F.when(F.col("side").isin(6, 8), quad).otherwise(F.col("k")).cast("int")
    v = F.when((F.col("is_pattern") == 1) & (F.substr(F.col("bits"), at + 1, F.lit(1)) == "0"), F.col("bg")).otherwise(F.col("fg"))
    return b.select("img_id", "ch", (F.col("x0") + x).cast("int").alias("x"), (F.col("y0") + y).cast("int").alias("y"), v.alias("v"))


def grid_of(sizes: DataFrame) -> DataFrame:
    """(img_id, x, y) of all pixels of sizes (img_id, w, h)."""
    rows = sizes.where("w > 0 AND h > 0").select("img_id", "w", F.explode(F.sequence(F.lit(0), F.col("h").cast("int") - 1)).alias("y"))
    return rows.select("img_id", F.explode(F.sequence(F.lit(0), F.col("w").cast("int") - 1)).alias("x"), "y")


def fill_margin(planes: DataFrame, grid: DataFrame, channels: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """The planes over the whole ``grid`` (img_id, x, y): what no block covers is black."""
    full = grid.select("img_id", "x", "y", F.explode(F.array(*map(F.lit, channels))).alias("ch"))
    p = planes.select(F.col("img_id").alias("p_img"), F.col("ch").alias("p_ch"), F.col("x").alias("p_x"), F.col("y").alias("p_y"), "v")
    j = full.join(p, (F.col("img_id") == F.col("p_img")) & (F.col("ch") == F.col("p_ch")) & (F.col("x") == F.col("p_x")) & (F.col("y") == F.col("p_y")), "left")
    return j.select("img_id", "ch", "x", "y", F.coalesce("v", F.when(F.col("ch") == 0, 0).otherwise(128)).alias("v"))
