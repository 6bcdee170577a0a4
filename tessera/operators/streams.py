"""Block relations to packed streams, segments and payloads, as hex text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.prefix import running

#: Fixed value of the format: the magic bytes.
MAGIC = "424142450A"


def pack_bits(bits: DataFrame) -> DataFrame:
    """(img_id, ch, hex) from (img_id, ch, pos, bit): first bit highest, the last byte padded with zeros.

    Bytes are summed before they are put in order, so an eighth of the rows is ordered.
    """
    b = bits.groupBy("img_id", "ch", F.floor(F.col("pos") / 8).alias("i")).agg(F.sum(F.col("bit") * F.pow(F.lit(2), 7 - F.col("pos") % 8)).cast("int").alias("v"))
    return join_bytes(b)


def join_bytes(values: DataFrame) -> DataFrame:
    """(img_id, ch, hex) from byte values v at i."""
    parts = F.array_sort(F.collect_list(F.struct("i", F.lpad(F.hex("v"), 2, "0").alias("h"))))
    return values.groupBy("img_id", "ch").agg(F.array_join(F.transform(parts, lambda e: e["h"]), "").alias("hex"))


def size_bits(blocks: DataFrame) -> DataFrame:
    """A bit a macro block: 1 if it is whole."""
    m = blocks.where((F.col("region") == 0) & (F.col("sy") == 0) & (F.col("sx") == 0))
    wide = m.groupBy(F.col("img_id").alias("m_img"), F.col("ch").alias("m_ch")).agg((F.max("gx") + 1).alias("across"))
    m = m.join(wide, (F.col("img_id") == F.col("m_img")) & (F.col("ch") == F.col("m_ch")))
    return m.select("img_id", "ch", (F.col("gy") * F.col("across") + F.col("gx")).alias("pos"), F.col("is_macro").alias("bit"))


def type_bits(blocks: DataFrame) -> DataFrame:
    return blocks.select("img_id", "ch", F.col("seq").alias("pos"), F.col("is_pattern").alias("bit"))


def pattern_bits(blocks: DataFrame) -> DataFrame:
    p = running(blocks.where("is_pattern = 1"), "seq", {"at": F.col("side") * F.col("side")})
    each = F.posexplode(F.split("bits", "")).alias("k", "c")
    return p.select("img_id", "ch", "at", each).select("img_id", "ch", (F.col("at") + F.col("k")).alias("pos"), F.col("c").cast("int").alias("bit"))


def fg_deltas(blocks: DataFrame) -> DataFrame:
    """(img_id, ch, i, v): levels as differences mod 256."""
    b = running(blocks.select("img_id", "ch", "seq", "fg"), "seq", last={"prev": F.col("fg")})
    return b.select("img_id", "ch", F.col("seq").alias("i"), (F.col("fg") - F.coalesce("prev", F.lit(0))).bitwiseAND(255).alias("v"))


def bg_deltas(blocks: DataFrame) -> DataFrame:
    p = running(blocks.where("is_pattern = 1").select("img_id", "ch", "seq", "bg"), "seq", {"i": F.lit(1)}, {"prev": F.col("bg")})
    return p.select("img_id", "ch", F.col("i").cast("int").alias("i"), (F.col("bg") - F.coalesce("prev", F.lit(0))).bitwiseAND(255).alias("v"))


def delta_decode(deltas: DataFrame) -> DataFrame:
    """Running sums mod 256."""
    d = running(deltas, "i", {"before": F.col("v")})
    return d.select("img_id", "ch", "i", (F.col("before") + F.col("v")).bitwiseAND(255).cast("int").alias("v"))


def u32(n: Column) -> Column:
    return F.lpad(F.hex(n), 8, "0")


def segments(blocks: DataFrame) -> DataFrame:
    """(img_id, ch, block_count, size_hex, type_hex, pattern_hex, fg_hex, bg_hex, segment_hex)."""
    out = blocks.groupBy("img_id", "ch").agg(F.count(F.lit(1)).alias("block_count"))
    for name, stream in (("size", pack_bits(size_bits(blocks))), ("type", pack_bits(type_bits(blocks))), ("pattern", pack_bits(pattern_bits(blocks))), ("fg", join_bytes(fg_deltas(blocks))), ("bg", join_bytes(bg_deltas(blocks)))):
        s = stream.select(F.col("img_id").alias("j_img"), F.col("ch").alias("j_ch"), F.col("hex").alias(f"{name}_hex"))
        out = out.join(s, (F.col("img_id") == F.col("j_img")) & (F.col("ch") == F.col("j_ch")), "left").drop("j_img", "j_ch").withColumn(f"{name}_hex", F.coalesce(f"{name}_hex", F.lit("")))
    parts = [u32(F.col("block_count"))]
    for name in ("size", "type", "pattern", "fg", "bg"):
        parts += [u32((F.length(f"{name}_hex") / 2).cast("long")), F.col(f"{name}_hex")]
    return out.withColumn("segment_hex", F.concat(*parts))


def header_hex(small: int, macro: int, w: Column, h: Column, bw: bool) -> Column:
    return F.concat(F.lit(f"{MAGIC}{small:04X}{macro:04X}{1 if bw else 7:02X}"), u32(w), u32(h))


def payloads(blocks: DataFrame, sizes: DataFrame, small: int, macro: int, bw: bool = False) -> DataFrame:
    """(img_id, w, h, payload_hex); sizes: (img_id, w, h)."""
    s = segments(blocks).groupBy("img_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ch", "segment_hex"))), lambda e: e["segment_hex"]), "").alias("body"))
    s = s.join(sizes.withColumnRenamed("img_id", "z_img"), F.col("img_id") == F.col("z_img"))
    return s.select("img_id", "w", "h", F.concat(header_hex(small, macro, F.col("w"), F.col("h"), bw), F.col("body")).alias("payload_hex"))
