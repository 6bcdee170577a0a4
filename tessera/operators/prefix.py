"""Running sums and previous values along a channel, without a task that orders the whole channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions that are ordered together.
PART = 4096


def running(rows: DataFrame, at: str, sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None) -> DataFrame:
    """Adds, to each row of (img_id, ch, ``at``, ...), totals over the rows of its channel at smaller positions.

    sums: name -> what is summed, 0 where nothing stands before; last: name -> the value of the row just before, null for
    the first. Positions are dealt into parts; a row orders within its part, and the parts' totals, a thousandth of the
    rows, within the channel.
    """
    sums, last = sums or {}, last or {}
    r = rows.withColumns({"p_": F.floor(F.col(at) / PART), **{f"v_{n}": c for n, c in (*sums.items(), *last.items())}})
    parts = r.groupBy("img_id", "ch", "p_").agg(*(F.sum(f"v_{n}").alias(n) for n in sums), *(F.max_by(f"v_{n}", at).alias(n) for n in last), F.count(F.lit(1)).alias("n_"))
    by_part = Window.partitionBy("img_id", "ch").orderBy("p_")
    ahead = by_part.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("img_id").alias("t_img"), F.col("ch").alias("t_ch"), F.col("p_").alias("t_p"),
        *(F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"t_{n}") for n in sums), *(F.lag(n).over(by_part).alias(f"t_{n}") for n in last),
    )
    within = Window.partitionBy("img_id", "ch", "p_").orderBy(at)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumns({**{f"w_{n}": F.coalesce(F.sum(f"v_{n}").over(before), F.lit(0)) for n in sums}, **{f"w_{n}": F.lag(f"v_{n}").over(within) for n in last}, "k_": F.row_number().over(within)})
    r = r.join(parts, (F.col("img_id") == F.col("t_img")) & (F.col("ch") == F.col("t_ch")) & (F.col("p_") == F.col("t_p")))
    found = [(F.col(f"t_{n}") + F.col(f"w_{n}")).alias(n) for n in sums] + [F.when(F.col("k_") == 1, F.col(f"t_{n}")).otherwise(F.col(f"w_{n}")).alias(n) for n in last]
    return r.select(*rows.columns, *found)
