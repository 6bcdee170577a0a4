"""Block sizes and the macro threshold by quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: (first quality, last quality, small block, macro block).
BANDS = ((80, 100, 1, 2), (60, 79, 1, 3), (40, 59, 2, 4), (20, 39, 3, 6), (0, 19, 4, 8))
SPREAD_HIGH, SPREAD_LOW = 64, 8


def clamp(quality: int) -> int:
    return min(100, max(0, quality))


def preset(quality: int) -> tuple[int, int, int]:
    """(small block, macro block, spread below which a macro block stays whole)."""
    q = clamp(quality)
    first, last, small, macro = next(b for b in BANDS if b[0] <= q <= b[1])
    return small, macro, SPREAD_HIGH - (q - first) * (SPREAD_HIGH - SPREAD_LOW) // (last - first)


def preset_columns(quality: Column) -> dict[str, Column]:
    """The same as expressions over a quality column."""
    q = F.greatest(F.lit(0), F.least(F.lit(100), quality.cast("int")))

    def pick(of) -> Column:
        e = None
        for band in BANDS:
            e = F.when(q >= band[0], of(band)) if e is None else e.when(q >= band[0], of(band))
        return e

    spread = pick(lambda b: F.lit(SPREAD_HIGH) - F.floor((q - b[0]) * (SPREAD_HIGH - SPREAD_LOW) / F.lit(b[1] - b[0])))
    return {"quality": q, "small": pick(lambda b: F.lit(b[2])), "macro": pick(lambda b: F.lit(b[3])), "spread": spread.cast("int")}


def presets(spark: SparkSession) -> DataFrame:
    c = preset_columns(F.col("id"))
    return spark.range(101).select(*(c[n].alias(n) for n in ("quality", "small", "macro", "spread")))
