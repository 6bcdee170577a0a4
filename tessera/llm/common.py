"""Helpers that the operators of this subpackage share: Arrow text buffers, written tables, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.tables import materialize, shared_dir  # noqa: F401

#: Text bytes that a numpy kernel handles at once; a longer single text makes a piece of its own.
PIECE_BYTES = 1 << 19


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, UTF-8 bytes of the column, offsets with n + 1 entries) for slices of at most ``limit`` text bytes; null counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if col.null_count:
            col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        # the batch's own buffers, without a copy
        wide = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
        off = np.frombuffer(col.buffers()[1], dtype=wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _byte_codes() -> np.ndarray:
    """A fixed 64-bit code for each byte, by splitmix64."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


CODES = _byte_codes()
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n each."""
    if "b" not in _powers or len(_powers["b"]) < n:
        size = 1 << max(16, int(n).bit_length())
        for key, base in (("b", _BASE), ("i", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["b"][:n], _powers["i"][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i modulo 2**64, with a leading zero."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end): equal spans hash alike wherever they stand."""
    h = (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]
    return mix64(h ^ ((end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of the texts, and each word's text number. Words don't cross texts."""
    if not len(data):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off[off < len(data)]] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(off, starts, side="right") - 1


def keyed_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by ``key``: each group ends up in one table, small groups share one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if held:
            last = held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py()
            if k[0] != last:
                yield pa.Table.from_batches(held)
                held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


#: Bits of a ``Bitmap`` at most: 16 MB.
MOST_BITS = 1 << 27


class Bitmap:
    """A Bloom filter with two probes and 32 bits a key, up to MOST_BITS whatever the keys: beyond, it only lets more through."""

    def __init__(self, keys: DataFrame, column: str, count: int):
        self.size = min(MOST_BITS, 1 << max(16, (32 * count - 1).bit_length() if count else 0))
        k = F.col(column)
        probes = F.array(k.bitwiseAND(self.size - 1), F.shiftrightunsigned(k, 32).bitwiseAND(self.size - 1))
        bits = keys.select(F.explode(probes).alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
        got = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most MOST_BITS / 64 rows
        words = np.zeros(self.size // 64, dtype=np.int64)
        words[got.w.to_numpy(dtype=np.int64)] = got.b.to_numpy(dtype=np.int64)
        self.bits = words.view(np.uint8)
        self.flat: np.ndarray | None = None

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key (64 bits) may be one of the bitmap's."""
        k = keys.view(np.uint64)
        if self.size <= 1 << 22 and self.flat is None:
            self.flat = np.unpackbits(self.bits, bitorder="little").view(bool)  # a byte a bit is faster, while it fits a cache

        def probe(p: np.ndarray) -> np.ndarray:
            p = (p & np.uint64(self.size - 1)).astype(np.int64)
            return self.flat[p] if self.flat is not None else (self.bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)

        out = probe(k)
        at = np.flatnonzero(out)
        out[at] = probe(k[at] >> np.uint64(32))
        return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the smallest node reachable.

    Minimum labels move along links, then each label is replaced by its own label (pointer jumping), so the
    rounds grow with the logarithm of a chain's length. Every round is written to the shared folder.
    """
    spark = edges.sparkSession
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("root").alias("near"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("top"))
        step = materialize(step.join(up, step.root == up.up).select("node", "was", F.least("root", "top").alias("root")), "labels")
        labels = step.select("node", "root")
        if not step.where("was <> root").limit(1).count():
            return labels
