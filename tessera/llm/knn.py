"""Exact top-k by inner product: a Voronoi kNN join.

Vectors become integers (floor of scale * x). Queries and data are grouped by nearest pivot; pivots are a sample, fixed
by hash, that grows with the root of the rows. With p the pivot of a row x, Cauchy and Schwarz bound the product of x
with any query q by q.p plus or minus |q| |x - p|, so the distance to the pivot bounds the score. Summaries (each
group's count, largest distance and k + 1 smallest distances) give each query a score that k rows other than itself reach at least;
from it follows, for each block of neighbouring queries and each group of data, the least distance to the pivot from
which on a row may matter. A join of rows and these distances replicates a row to the blocks that may need it. The rows
that a block gets are dealt into slices, whose number comes from the summaries, so neither a full group nor a crowded
pivot makes a task grow. Slices are solved by integer-exact products; the k best of each are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import keyed_groups, materialize, partitions

SCALE = 256
TOP = 5
#: Pivots: the root of the rows, within these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 16, 1024
#: Vector components of one block's queries, and of one slice's rows.
BLOCK_VALUES = 1 << 17
SLICE_VALUES = 1 << 19
#: Queries whose bounds or scores are held at once.
AT_ONCE = 256
_LOW = np.int64(-(2**63))


def _by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, off = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    size = np.diff(off)
    flat = flat if len(flat) else np.zeros(0)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, flat[(off[at] - off[0])[:, None] + np.arange(n)]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; what overflows is infinite."""
    with np.errstate(all="ignore"):
        d = np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T), 0))
    return np.where(np.isnan(d), np.inf, d)


def top_scores(q: np.ndarray, q_row: np.ndarray, d: np.ndarray, d_id: np.ndarray, d_row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, data number and score of each query's k largest integer products, ties to the smaller id, own row left out.

    Products are exact: in doubles where no sum can reach 2**53, else in Python's integers, cut to the range of a long.
    """
    plain = lambda m: np.abs(m).max(axis=1) < (2**53 / m.shape[1]) ** 0.5
    easy_q, easy_d = plain(q), plain(d)
    wide_d = [[int(x) for x in row] for row in d[~easy_d]]
    out = []
    for at in range(0, len(q), AT_ONCE):
        block, easy = q[at : at + AT_ONCE], easy_q[at : at + AT_ONCE]
        score = np.zeros((len(block), len(d)), dtype=np.int64)
        score[np.ix_(easy, easy_d)] = np.rint(block[easy] @ d[easy_d].T).astype(np.int64)
        for i in range(len(block)):
            hard = np.flatnonzero(~easy_d) if easy[i] else np.arange(len(d))
            if len(hard):
                mine = [int(x) for x in block[i]]
                others = wide_d if easy[i] else ([int(x) for x in row] for row in d)
                score[i, hard] = [max(-(2**63) + 1, min(2**63 - 1, sum(map(int.__mul__, mine, o)))) for o in others]
        score[q_row[at : at + AT_ONCE, None] == d_row[None, :]] = _LOW
        least = np.partition(score, -k, axis=1)[:, -k] if len(d) > k else np.full(len(block), _LOW)
        i, j = np.nonzero((score >= least[:, None]) & (score > _LOW))
        s = score[i, j]
        by = np.lexsort((d_row[j], d_id[j], ~s, i))  # ~s falls as s rises, without overflow
        i, j, s = i[by], j[by], s[by]
        first = np.searchsorted(i, np.arange(len(block)))
        keep = np.arange(len(i)) - first[i] < k
        out.append((i[keep] + at, j[keep], s[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def voronoi_knn(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, scale: int = SCALE, block_values: int = BLOCK_VALUES, slice_values: int = SLICE_VALUES) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's ``k`` largest integer inner products, ties to the smaller vec_id.

    Every row but the query's own is a candidate: rows that repeat an id, with the same vector or another, are rows of
    their own, as queries and as candidates. Rows with a null id, a null or empty vector, or null or non-finite
    components take no part; a vector meets those of its own length. Fewer than k candidates give all of them. Scores
    beyond a long's range are cut to it. An empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score long"
    most = 1.7976931348623157e308

    def whole(c: Column) -> Column:
        x = F.greatest(F.least(c.cast("double") * scale, F.lit(most)), F.lit(-most))
        return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)  # larger doubles are integers

    sound = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, whole).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("n"), "q"), "vectors")
    # a row a length
    sizes = {r.n: r.count_ for r in rows.groupBy("n").agg(F.count(F.lit(1)).alias("count_"), F.count_if("q").alias("asked")).where("asked > 0").collect()}
    if not sizes:
        return spark.createDataFrame([], out_schema)
    slice_rows = lambda n: max(16, slice_values // n)
    many = {n: min(MOST_PIVOTS, max(LEAST_PIVOTS, isqrt(c))) for n, c in sizes.items() if c > slice_rows(n)}
    pivots: dict[int, np.ndarray] = {}
    if many:
        # distinct vectors by hash, so that copies don't fill the sample
        hashed = rows.where(F.col("n").isin(list(many))).groupBy("n", F.xxhash64("v").alias("h")).agg(F.min("row").alias("p_row"))
        hashed = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy("h"))).where(F.col("rank") <= MOST_PIVOTS)
        for r in rows.join(F.broadcast(hashed.select("p_row", "rank")), F.col("row") == F.col("p_row")).select("n", "rank", "v").orderBy("n", "rank").collect():
            if r.rank <= many[r.n]:
                pivots.setdefault(r.n, []).append(r.v)
        pivots = {n: np.array(p) for n, p in pivots.items()}
    shared = spark.sparkContext.broadcast(pivots)
    of_length = lambda n: shared.value.get(n, np.zeros((1, n)))  # noqa: E731  few rows of a length are one group around zero

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            for at, v in _by_length(batch.column(2)):
                for a in range(0, len(at), 4096):
                    d = _distances(v[a : a + 4096], of_length(v.shape[1]))
                    cell[at[a : a + 4096]], far[at[a : a + 4096]] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    placed = materialize(rows.mapInArrow(place, "row long, vec_id long, v array<double>, n int, q boolean, cell int, far double"), "cells")
    # summaries, a row a group; k + 1 near distances, as one candidate may be the query itself
    cells = materialize(placed.groupBy("n", "cell").agg(F.count(F.lit(1)).alias("count"), F.max("far").alias("hi"), F.count_if("q").alias("asked")), "summaries")
    near = placed.select("n", "cell", "far").withColumn("m", F.row_number().over(Window.partitionBy("n", "cell").orderBy("far"))).where(f"m <= {k + 1}")
    known: dict[int, list] = {n: [] for n in sizes}
    for r in near.where(F.col("n").isin(list(sizes))).select("n", "cell", "far").collect():
        known[r.n].append((r.cell, r.far))
    summaries = [r for r in cells.collect() if r.n in sizes]
    top = {n: np.full(len(pivots.get(n, [0])), -1.0) for n in sizes}
    for r in summaries:
        top[r.n][r.cell] = r.hi
    shared_near = spark.sparkContext.broadcast(({n: (np.array([c for c, _ in x]), np.array([f for _, f in x])) for n, x in known.items()}, top))
    # blocks: neighbouring groups of queries together, crowded ones over several
    homes, n_blocks = [], 0
    for n in sorted(sizes):
        p, room = pivots.get(n, np.zeros((1, n))), max(1, block_values // n)
        filled, from_first = room, _distances(p, p[:1])[:, 0]
        for r in sorted((r for r in summaries if r.n == n and r.asked), key=lambda r: (from_first[r.cell], r.cell)):
            parts = -(-r.asked // room)
            if parts > 1 or filled + r.asked > room:
                homes.append((n, r.cell, n_blocks, parts))
                n_blocks += parts
                filled = r.asked if parts == 1 else room
            else:
                homes.append((n, r.cell, n_blocks - 1, 1))
                filled += r.asked
    homes = F.broadcast(spark.createDataFrame(homes, "h_n int, h_cell int, start int, parts int"))  # a row a group
    block = F.col("start") + F.pmod(F.xxhash64("row"), F.col("parts"))
    asked = placed.where("q").join(homes, (F.col("n") == F.col("h_n")) & (F.col("cell") == F.col("h_cell"))).select(block.cast("int").alias("block"), "n", "row", "vec_id", "v")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block of queries and group of data: the least distance to the pivot from which on a row may matter."""
        for t in keyed_groups(batches, "block"):
            blocks = t.column("block").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]]).tolist()
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                for _, v in _by_length(t.column("v").slice(a, z - a)):
                    n = v.shape[1]
                    p, (cell, far), hi = of_length(n), shared_near.value[0][n], shared_near.value[1][n]
                    reach = np.full(len(p), np.inf)
                    for i in range(0, len(v), AT_ONCE):
                        with np.errstate(all="ignore"):
                            q = v[i : i + AT_ONCE]
                            size = np.sqrt((q**2).sum(axis=1))[:, None]
                            product = q @ p.T
                            low = product[:, cell] - size * far[None, :]
                            low = np.where(np.isnan(low), -np.inf, low)
                            sure = np.partition(low, -(k + 1), axis=1)[:, -(k + 1), None] if low.shape[1] > k else np.full((len(q), 1), -np.inf)
                            r = (sure - product) / size
                            r -= 1e-9 * (1 + np.abs(r) + (np.abs(sure) + np.abs(product)) / size)
                            reach = np.minimum(reach, np.where(np.isnan(r), -np.inf, r).min(axis=0))
                    some = np.flatnonzero(hi >= reach)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), blocks[a], dtype=np.int32)), pa.array(np.full(len(some), n, dtype=np.int32)), pa.array(some.astype(np.int32)), pa.array(reach[some])], names=["block", "r_n", "r_cell", "reach"])

    by_block = asked.select("block", "v").repartition(partitions(spark), "block").sortWithinPartitions("block")
    reach = materialize(by_block.mapInArrow(bounds, "block int, r_n int, r_cell int, reach double"), "reach")
    size = cells.select(F.col("n").alias("s_n"), F.col("cell").alias("s_cell"), "count")
    room = F.greatest(F.lit(16), F.floor(F.lit(slice_values) / F.col("r_n")))
    cuts = reach.join(size, (F.col("r_n") == F.col("s_n")) & (F.col("r_cell") == F.col("s_cell"))).groupBy("block").agg(F.ceil(F.sum("count") / F.max(room)).cast("int").alias("slices"))
    cuts = materialize(cuts.withColumnRenamed("block", "c_block"), "slices")
    goes = reach.join(cuts, F.col("block") == F.col("c_block")).drop("c_block")
    data = placed.join(goes, (F.col("n") == F.col("r_n")) & (F.col("cell") == F.col("r_cell")) & (F.col("far") >= F.col("reach")))
    data = data.select("block", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int").alias("slice"), "row", "vec_id", "v", F.lit(False).alias("q"))
    asks = asked.join(cuts, F.col("block") == F.col("c_block")).select("block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "row", "vec_id", "v", F.lit(True).alias("q"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        q, d = part[part.q], part[~part.q]
        if not len(q) or not len(d):
            return pd.DataFrame({"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": []}).astype("int64")
        i, j, s = top_scores(np.stack(q.v.to_numpy()), q.row.to_numpy(), np.stack(d.v.to_numpy()), d.vec_id.to_numpy(), d.row.to_numpy(), k)
        return pd.DataFrame({"query_row": q.row.to_numpy()[i], "query_id": q.vec_id.to_numpy()[i], "row": d.row.to_numpy()[j], "vec_id": d.vec_id.to_numpy()[j], "score": s})

    best = asks.union(data).groupBy("block", "slice").applyInPandas(solve, "query_row long, query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return best.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


#: The same relation for DuckDB.
KNN_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rn, d.rn AS other, q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
  FROM r q JOIN r d ON q.rn <> d.rn AND len(q.v) = len(d.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id, other))::INT AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id, other) <= 5
"""
