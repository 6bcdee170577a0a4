"""Colour conversions as integer expressions: no Python on the rows. Their coefficients are fixed values of the format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    y = F.shiftright(r * 77 + g * 150 + b * 29, 8)
    cb = F.shiftright(r * -43 - g * 85 + b * 128, 8) + 128
    cr = F.shiftright(r * 128 - g * 107 - b * 21, 8) + 128
    return y, cb, cr


def _byte(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), c))


def rgb(y: Column, cb: Column | None = None, cr: Column | None = None) -> tuple[Column, Column, Column]:
    """Red, green, blue; a missing chroma plane adds nothing."""
    u = cb - 128 if cb is not None else F.lit(0)
    v = cr - 128 if cr is not None else F.lit(0)
    return _byte(y + F.shiftright(v * 91881, 16)), _byte(y - F.shiftright(u * 22554 + v * 46802, 16)), _byte(y + F.shiftright(u * 116130, 16))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r * 299 + g * 587 + b * 114) / 1000).cast("int")


def premultiplied(c16: Column, a16: Column) -> Column:
    """A 16-bit sample with straight alpha as the 8-bit premultiplied one."""
    return F.shiftright(F.floor(c16.cast("long") * a16 / 65535).cast("int"), 8)


def full_range_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """The JFIF conversion in 16-bit fixed point, for the split-channel sink."""
    half = 1 << 15

    def level(c: Column) -> Column:
        return _byte(F.shiftright(c, 16))

    return level(r * 19595 + g * 38470 + b * 7471 + half), level(r * -11056 - g * 21712 + b * 32768 + (257 << 15)), level(r * 32768 - g * 27440 - b * 5328 + (257 << 15))
