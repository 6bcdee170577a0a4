"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
LIMIT = 3
#: Hex digits of the salt within a size class: a source's rows of one class are ranked in 256 parts.
SALT_DIGITS = 2
#: Offsets of a source that are drawn; the one whose copies come nearest to the target in words is added.
OFFSETS = 16
#: Hundredths by which a source's expected copies are then raised or lowered, first those that change least: a few long documents
#: can leave its words off the target at any offset.
SCALES = (0, -2, 2, -4, 4, -6, 6, -9, 9, -12, 12, -16, 16, -20, 20)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target of each row of ``sizes`` (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share all words. A target stops at ``limit`` times
    its source's size, the rest shared anew by weight: sources are filled in the order of limit * size / weight, and the
    level is the first one that the next source can still take.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.lit(limit) * F.col("source_size"))
    t = t.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    before = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("all_size", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    t = t.withColumn("level", (F.col("all_size") - F.col("full")).cast("double") / (F.col("all_weight") - F.col("gone")))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * level)
    return t.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def size_class(size: Column) -> Column:
    """Sizes below 32 each, then 16 classes a doubling: systematic sampling runs through the documents by size."""
    octave = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")))
    return F.when(size < 32, size).otherwise(F.lit(32) + (octave - 5) * 16 + F.floor(size / F.pow(F.lit(2.0), octave) * 16) - 16).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row.

    Each row expects target / source_size copies; the expectations are summed within the source in the order of (size
    class, salt, doc_id, mark), one offset a source is added, and a copy is emitted for each integer crossed. The offset
    is the one of OFFSETS, evenly spaced from a random one (by ``seed`` and source), whose words come nearest to the target, ties to
    the first; then all of a source's expectations are scaled by the one of SCALES that comes nearest. Counts by (source, class, salt) are summed first, so no task ranks a whole source. Salt and mark are a hash of
    doc_id and text, so null or repeated ids share no window unless their texts are equal too. Null texts have size 0; a
    source without words has target 0 and gives no copies; null is a source of its own; rows that repeat are rows of
    their own; an empty table gives an empty result. Other columns are not read.
    """
    mark = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary")), 1, 16)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), mark.alias("mark"))
    rows = materialize(rows.withColumn("class", size_class(F.col("size"))).withColumn("salt", F.substring("mark", 1, SALT_DIGITS)), "sizes")
    cell = rows.groupBy("source", "class", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    goal = targets(cell.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit)
    # what stands ahead of a cell: the smaller classes of its source, and the smaller salts of its class
    by_class = cell.groupBy("source", "class").agg(F.sum("n").alias("n"))
    below = F.sum("n").over(Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1))
    by_class = by_class.select(F.col("source").alias("b_source"), F.col("class").alias("b_class"), F.coalesce(below, F.lit(0)).alias("below"))
    beside = F.sum("n").over(Window.partitionBy("source", "class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    ahead = cell.withColumn("beside", F.coalesce(beside, F.lit(0))).join(by_class, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("class") == F.col("b_class")))
    ahead = ahead.select(F.col("source").alias("c_source"), F.col("class").alias("c_class"), F.col("salt").alias("c_salt"), (F.col("below") + F.col("beside")).alias("ahead"))
    first = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = materialize(goal.select(F.col("source").alias("g_source"), "source_size", "target", rate.alias("rate"), first.alias("first")), "goals")
    plan = ahead.join(goal, F.col("c_source").eqNullSafe(F.col("g_source"))).select("c_source", "c_class", "c_salt", "ahead", "rate", "first")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "class", "salt").orderBy("doc_id", "mark")))
    r = ranked.join(plan, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class")) & (F.col("salt") == F.col("c_salt")))
    r = materialize(r.select("doc_id", "source", "size", (F.col("ahead") + F.col("rank")).alias("rank"), "rate", "first"), "ranked")
    rank = F.col("rank")

    def copies(offset: Column, scale: Column) -> Column:
        # rounding alone could add a copy beyond the limit
        rate = F.least(F.col("rate") * scale, F.lit(float(limit)))
        n = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
        return F.least(n, F.lit(limit).cast("long"))

    def nearest(rows: DataFrame, keep: list[str], choices: list[tuple[Column, Column]], name: str, pick: int) -> DataFrame:
        """For each source, the choice of (offset, scale) whose words come nearest to the target; its ``pick``-th part as ``name``."""
        sums = rows.groupBy(F.col("source").alias("o_source")).agg(*(F.first(c).alias(c) for c in keep), *(F.sum(copies(*c) * F.col("size")).alias(f"w{j}") for j, c in enumerate(choices)))
        sums = sums.join(goal.select("g_source", "source_size", "target"), F.col("o_source").eqNullSafe(F.col("g_source")))
        tried = (F.struct(F.abs(F.col(f"w{j}").cast("double") - F.col("target")).alias("d"), F.lit(j).alias("j"), c[pick].alias("u")) for j, c in enumerate(choices))
        return materialize(sums.select("g_source", "source_size", "target", *(k for k in keep if k != "first"), F.array_min(F.array(*tried))["u"].alias(name)), "offsets")

    def offset(j: int) -> Column:
        u = F.col("first") + F.lit(j / OFFSETS)
        return F.when(u >= 1, u - 1).otherwise(u)

    one = F.lit(1.0)
    at = nearest(r, ["first"], [(offset(j), one) for j in range(OFFSETS)], "offset", 0)
    r = r.join(at.select("g_source", "offset"), F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    chosen = nearest(r, ["offset"], [(F.col("offset"), F.lit(1.0 + c / 100)) for c in SCALES], "scale", 1).drop("offset")
    r = r.join(chosen, F.col("source").eqNullSafe(F.col("g_source"))).withColumn("copies", copies(F.col("offset"), F.col("scale")))
    return r.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: The same relation for DuckDB.
MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 16) AS mark FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS BIGINT) AS cap FROM rows GROUP BY source),
weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM totals),
rated AS (SELECT *, CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE) AS ratio FROM weighed),
filled AS (
  SELECT *, coalesce(sum(cap) OVER b, 0) AS used, coalesce(sum(weight) OVER b, 0) AS gone,
    sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
  FROM rated WINDOW b AS (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, CAST(all_size - used AS DOUBLE) / CAST(all_weight - gone AS DOUBLE) AS lvl FROM filled),
goal AS (
  SELECT source AS g_source, source_size,
    coalesce(least(CAST(cap AS DOUBLE), CAST(weight AS DOUBLE) * (SELECT lvl FROM levels WHERE lvl <= ratio ORDER BY ratio, lvl LIMIT 1)), 0.0) AS target,
    CAST(('0x' || substr(md5('mix:' || coalesce(source, 'null')), 1, 8)) AS BIGINT) / 4294967296.0 AS u
  FROM levels),
ranked AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY
    CASE WHEN size < 32 THEN size ELSE CAST(32 + (floor(log2(size)) - 5) * 16 + floor(size / pow(2.0, floor(log2(size))) * 16) - 16 AS BIGINT) END,
    substr(mark, 1, 2), doc_id NULLS FIRST, mark) AS rnk FROM rows),
drawn AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM ranked JOIN goal ON source IS NOT DISTINCT FROM g_source),
offsets AS (
  SELECT g_source AS o_source, target AS o_target, j, CASE WHEN u + j / 16.0::DOUBLE >= 1 THEN u + j / 16.0::DOUBLE - 1 ELSE u + j / 16.0::DOUBLE END AS o FROM goal, range(16) t(j)),
tried AS (
  SELECT o_source, j, o, abs(CAST(sum(least(CAST(floor(rnk * least(rate, 3.0::DOUBLE) + o) AS BIGINT) - CAST(floor((rnk - 1) * least(rate, 3.0::DOUBLE) + o) AS BIGINT), 3) * size) AS DOUBLE) - any_value(o_target)) AS miss
  FROM drawn JOIN offsets ON g_source IS NOT DISTINCT FROM o_source GROUP BY o_source, j, o),
best AS (SELECT o_source, o FROM tried QUALIFY row_number() OVER (PARTITION BY o_source ORDER BY miss, j) = 1),
scales AS (SELECT unnest([0, -2, 2, -4, 4, -6, 6, -9, 9, -12, 12, -16, 16, -20, 20]) AS c, unnest(range(15)) AS j),
scaled AS (
  SELECT o_source, o, j, least(rate * (1.0::DOUBLE + c / 100.0::DOUBLE), 3.0::DOUBLE) AS r2, target AS s_target, doc_id, size, rnk
  FROM drawn JOIN best ON g_source IS NOT DISTINCT FROM o_source, scales),
weighed2 AS (
  SELECT o_source, o, j, any_value(r2) AS r2, abs(CAST(sum(least(CAST(floor(rnk * r2 + o) AS BIGINT) - CAST(floor((rnk - 1) * r2 + o) AS BIGINT), 3) * size) AS DOUBLE) - any_value(s_target)) AS miss
  FROM scaled GROUP BY o_source, o, j),
chosen AS (SELECT o_source, o, r2 FROM weighed2 QUALIFY row_number() OVER (PARTITION BY o_source ORDER BY miss, j) = 1)
SELECT doc_id, source, size, source_size, target,
  least(CAST(floor(rnk * r2 + o) AS BIGINT) - CAST(floor((rnk - 1) * r2 + o) AS BIGINT), 3) AS copies,
  least(CAST(floor(rnk * r2 + o) AS BIGINT) - CAST(floor((rnk - 1) * r2 + o) AS BIGINT), 3) * size AS taken
FROM drawn JOIN chosen ON source IS NOT DISTINCT FROM o_source
"""
