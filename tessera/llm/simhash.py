"""SimHash near-duplicates by pivot distance tables.

Each distinct fingerprint gets a table row: its Hamming distances to a base pivot, to 64 pivots that differ from the
base in one bit, and to pseudo-random pivots. A distance to a one-bit pivot is the base distance plus or minus one, so
these columns tell the fingerprint's bits in eight blocks of eight. Two bits that differ touch at most two blocks:
linked fingerprints agree on all pivot coordinates of some six blocks, and those coordinates (28 choices) are the join
keys. A key leaves 16 bits open, so its group holds at most 65,536 distinct fingerprints whatever the input. Within a
group, pairs whose distances to any pivot differ by more than the radius are discarded; survivors are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, keyed_groups, materialize, mix64, partitions, text_pieces

RADIUS = 2
SHINGLE = 3
BLOCKS = 8
#: Six of the eight blocks that linked fingerprints have in common.
KEYS = list(combinations(range(BLOCKS), BLOCKS - RADIUS))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ONE_BIT = _BASE ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
_RANDOM = mix64(np.arange(1, 17, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
PIVOTS = np.concatenate([[_BASE], _ONE_BIT, _RANDOM]).astype(np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of A-Z-lower-cased word shingles hashed by XXH64 (seed 42); 0 without words."""
    w = text.lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) < shingle:
        parts = [joined]
    else:
        size = np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1
        ends = np.cumsum(size) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        parts = [joined[a:b] for a, b in zip(starts[: len(w) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(p, 42) for p in parts), dtype=np.uint64, count=len(parts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, mark: Column | None = None) -> DataFrame:
    """(doc_id, fp long) of every row, and with ``mark`` (a long) that as a third column; null and empty texts get 0."""
    more = [] if mark is None else [mark.alias("mark")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in text_pieces(batches, "text"):
            fps = np.array([fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(off[:-1], off[1:], strict=True)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(fps.view(np.int64)), *rows.columns[2:]], names=["doc_id", "fp", "mark"][: rows.num_columns])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more).mapInArrow(run, "doc_id long, fp long" + ", mark long" * len(more))


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances, fingerprints by pivots."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :])


def block_keys(table: np.ndarray) -> np.ndarray:
    """Join keys, fingerprints by KEYS: the number of the choice, and the signs of the chosen one-bit pivots' coordinates."""
    signs = (table[:, 1:65] > table[:, :1]).reshape(-1, BLOCKS, 8)
    block = np.packbits(signs, axis=2, bitorder="little")[:, :, 0].astype(np.int64)
    out = np.empty((len(table), len(KEYS)), dtype=np.int64)
    for k, chosen in enumerate(KEYS):
        out[:, k] = k
        for b in chosen:
            out[:, k] = out[:, k] << 8 | block[:, b]
    return out


def local_links(fps: np.ndarray, radius: int = RADIUS, rows: int = 512) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of one group: (members, their smallest linked root) after discarding by pivot coordinates and verifying."""
    n = len(fps)
    root = np.arange(n)
    table = pivot_table(fps)[:, [0, *range(65, len(PIVOTS))]].astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    base = table[:, 0]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for at in range(0, n, rows):
        to = min(n, at + rows)
        stop = int(np.searchsorted(base, base[to - 1] + radius, side="right"))
        for left in range(at, stop, rows):
            right = min(stop, left + rows)
            near = np.ones((to - at, right - left), dtype=bool)
            for p in range(table.shape[1]):
                near &= np.abs(table[at:to, p, None] - table[None, left:right, p]) <= radius
            i, j = np.nonzero(near)
            i, j = i + at, j + left
            keep = i < j
            i, j = i[keep], j[keep]
            keep = np.bitwise_count(fps[i] ^ fps[j]) <= radius
            for a, b in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
                ra, rb = find(a), find(b)
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
    tops = np.array([find(x) for x in range(n)])
    moved = tops != np.arange(n)
    return fps[moved], fps[tops[moved]]


def _pairs(key: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    cut = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
    size = ends - starts
    two = starts[size == 2]
    if len(two):
        a, b = fps[two], fps[two + 1]
        near = (np.abs(pivot_table(a).astype(np.int8) - pivot_table(b).astype(np.int8)) <= RADIUS).all(axis=1)
        near &= np.bitwise_count(a ^ b) <= RADIUS
        yield a[near], b[near]
    for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
        yield local_links(fps[s:e])


def links(distinct: DataFrame) -> DataFrame:
    """Spanning links (u, v) between distinct fingerprints (column fp) that differ in at most two bits."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            k = block_keys(pivot_table(fps))
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(fps.view(np.int64), len(KEYS)))], names=["k", "fp"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in keyed_groups(batches, "k"):
            fps = t.column("fp").to_numpy().view(np.uint64)
            for u, v in _pairs(t.column("k").to_numpy(), fps):
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    keyed = distinct.select("fp").mapInArrow(keys, "k long, fp long")
    n = partitions(distinct.sparkSession)
    return keyed.repartition(n, "k").sortWithinPartitions("k").mapInArrow(solve, "u long, v long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    Fingerprints link at two or fewer differing bits; component_id is the smallest doc_id reachable. Null and empty
    texts have fingerprint zero and link like any other; equal texts share a fingerprint and so a component; rows that
    repeat a doc_id are returned each; rows with a null doc_id are returned, and name a component only if no other id
    does (then null). An empty table gives an empty result. Other columns are not read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fp")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    roots = connected_components(links(distinct))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, mark: Column, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, n) of one row of each component: the smallest doc_id, nulls last, then the smallest ``mark``.

    ``mark`` is a long that tells rows of one doc_id apart; n is how many rows have that doc_id and mark.
    """
    fps = fingerprints(docs, id_col, text_col, shingle, mark).groupBy("fp", "doc_id", "mark").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "n")).alias("row")
    distinct = materialize(fps.groupBy("fp").agg(first), "fps")
    roots = connected_components(links(distinct))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("row", F.coalesce("root", "fp").alias("root"))
    return named.groupBy("root").agg(F.min("row").alias("row")).select("row.doc_id", "row.mark", "row.n")
