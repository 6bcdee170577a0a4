"""Repeated substrings of a collection, byte-exact, by column-wise construction of ordered suffixes.

A suffix order of the whole collection built a symbol a document each round needs as many rounds as the longest document
has bytes, each reading all that was built. Here every string of ``length`` bytes is first given its anchor, the leftmost
smallest hash among its 32-byte substrings, so equal strings share anchor and alignment. The starts of a document fall
into runs of one anchor; a run's bytes (at most 368) are a small document. Anchors that occur once are dropped after a
grouped count. Runs that are equal as a whole match without further work; the distinct runs of an anchor are the small
collection on which the construction runs: one symbol of each is inserted a round, last column first, and each round
updates the order of the suffixes and the common prefixes of neighbours. A start whose common prefix with a neighbour
reaches ``length`` is repeated. A round reads the order and prefixes once from front to back and writes them anew, and
whole anchors stream through a task in batches, so a task holds one batch however large the input is.

An anchor that lies in a frequent passage has many distinct runs. Those are cut into cells of neighbouring starts, and
the part that all strings of a cell have in common takes the anchor's place: first a part nearly as long as the
strings, then, for cells that are still crowded, a longer one, at last the whole string. Every step gathers smaller
collections, all of which are ordered in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CODES, keyed_groups, materialize, mix64, partitions, powers, prefix_hash, span_hash, text_pieces

LENGTH = 200
KMER = 32
#: Distinct runs of one anchor that are ordered together; an anchor with more is cut into cells.
GROUP_RUNS = 512
#: Distinct runs, of many anchors, that a task orders at once.
BATCH_RUNS = 4096
#: Starts of one text whose anchors are sought at once.
WINDOW = 1 << 20
_CELL = "p_anchor long, p_run long, j0 long, anchor long, run long, shift long, owner long, many boolean, bytes binary"


def runs(data: np.ndarray, off: np.ndarray, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, ...]:
    """Text number, anchor hash, run hash, first start, last start (both within the text) and anchor offset of each run.

    A text longer than WINDOW is read in windows that share length - 1 bytes; a run ends where a window does.
    """
    if len(off) == 2 and len(data) > WINDOW + length:
        parts = []
        for at in range(0, len(data) - length + 1, WINDOW):
            part = data[at : at + WINDOW + length - 1]
            t, a, r, first, last, shift = runs(part, np.array([0, len(part)]), length, kmer)
            parts.append((t, a, r, first + at, last + at, shift))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    width = length - kmer + 1
    n = len(data)
    if n < length:
        z = np.zeros(0, dtype=np.int64)
        return z, z.astype(np.uint64), z.astype(np.uint64), z, z, z
    prefix = prefix_hash(CODES[data])
    kmers = mix64((prefix[kmer:] - prefix[:-kmer]) * powers(n - kmer + 1)[1])
    m = len(kmers)
    pad = -m % width
    grid = np.full(m + pad, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[:m] = kmers
    grid = (grid & ~np.uint64(0xFF)).reshape(-1, width) | np.arange(width, dtype=np.uint64)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    at = np.arange(count)
    a, b = back[:count], ahead[width - 1 : width - 1 + count]
    left = (a >> np.uint64(8)) <= (b >> np.uint64(8))
    anchor = np.where(left, at // width * width + (a & np.uint64(0xFF)).astype(np.int64), (at + width - 1) // width * width + (b & np.uint64(0xFF)).astype(np.int64))
    sizes = np.diff(off)
    ok = np.zeros(n + 1, dtype=np.int64)
    fits = sizes >= length
    np.add.at(ok, off[:-1][fits], 1)
    np.add.at(ok, off[1:][fits] - length + 1, -1)
    ok = np.cumsum(ok)[:count] > 0
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    last_ok = ok.copy()
    last_ok[:-1] &= ~ok[1:] | (anchor[1:] != anchor[:-1])
    last = np.flatnonzero(last_ok)
    text = np.searchsorted(off, first, side="right") - 1
    p = anchor[first]
    return text, kmers[p], span_hash(prefix, first, last + length), first - off[text], last - off[text], p - first


def cells(data: np.ndarray, off: np.ndarray, anchor: np.ndarray, shift: np.ndarray, width: int, length: int) -> tuple[np.ndarray, ...]:
    """Strings of runs cut into cells of ``width`` starts, counted back from the anchor.

    Row, first and last start of each cell, a hash of the bytes that all strings of the cell share (with the anchor and
    the cell's number), and a hash of the cell's bytes. Equal strings stand equally far from their anchor, so they share a cell's hash.
    """
    n = np.diff(off) - length + 1
    c0, c1 = (shift - n + 1) // width, shift // width
    count = c1 - c0 + 1
    row = np.repeat(np.arange(len(n)), count)
    c = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + c0[row]
    near = shift[row] - c * width  # of the start that is nearest to the anchor
    first, last = np.maximum(0, near - width + 1), np.minimum(n[row] - 1, near)
    prefix = prefix_hash(CODES[data])
    common = span_hash(prefix, off[row] + near, off[row] + near - width + 1 + length)
    key = mix64(common ^ mix64(anchor[row] + c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return row, first, last, key, span_hash(prefix, off[row] + first, off[row] + last + length)


def insert_columns(
    group: np.ndarray, strings: list[bytes], shift: np.ndarray, starts: np.ndarray, length: int = LENGTH, owner: np.ndarray | None = None, many: np.ndarray | None = None, kmer: int = KMER
) -> np.ndarray:
    """Repeated starts of aligned strings, strings by starts (boolean).

    With owner (the text that a string is of) and many (it is of several), a start must be repeated in another text.

    group: sorted group numbers; shift: the anchor's offset in each string; starts: number of starts of each string.
    Rounds go from the last column to the first. ``order`` lists the strings by (group, suffix from the column on) and
    ``common`` holds each one's common prefix with the one before it.
    """
    m = len(strings)
    room = length - kmer
    columns = room + length
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=m)
    begin = room - shift
    end = begin + sizes
    symbols = np.zeros((m, columns), dtype=np.uint16)
    flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
    # the place of each byte in the table of rows
    place = np.arange(len(flat)) + np.repeat(np.arange(m) * columns + begin - (np.cumsum(sizes) - sizes), sizes)
    symbols.ravel()[place] = flat.astype(np.uint16) + 1
    symbols = np.ascontiguousarray(symbols.T)
    repeated = np.zeros((m, room + 1), dtype=bool)
    order = np.arange(m)
    common = np.zeros(m + 1, dtype=np.int32)
    for c in range(int(end.max()) - 1, int(begin.min()) - 1, -1):
        if c < room:  # strings that began after this column are complete
            stay = begin[order] <= c
            if not stay.all():
                kept = np.flatnonzero(stay)
                if not len(kept):
                    continue
                lows = np.minimum.reduceat(common[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1])) if len(kept) > 1 else np.zeros(1, dtype=np.int32)
                order = order[kept]
                common = np.append(lows, np.int32(0))
        s = symbols[c][order]
        key = group[order] * 512 + s
        to = np.argsort(key, kind="stable")
        moved = key[to]
        same = np.flatnonzero((moved[1:] == moved[:-1]) & (s[to][1:] > 0)) + 1
        fresh = np.zeros(len(order) + 1, dtype=np.int32)
        if len(same):
            bounds = np.empty(2 * len(same), dtype=np.int64)
            bounds[0::2], bounds[1::2] = to[same - 1] + 1, to[same] + 1
            fresh[same] = np.minimum.reduceat(common, bounds)[::2] + 1
        order, common = order[to], fresh
        if c <= room:
            if owner is None:
                hit = order[np.maximum(common[:-1], common[1:]) >= length]
            else:
                alike = np.flatnonzero(common[:-1] < length)
                sizes_ = np.diff(np.append(alike, len(order)))
                own = owner[order]
                wide = (np.minimum.reduceat(own, alike) != np.maximum.reduceat(own, alike)) | np.logical_or.reduceat(many[order], alike)
                hit = order[np.repeat(wide, sizes_)]
            j = c - begin[hit]
            inside = j < starts[hit]
            repeated[hit[inside], j[inside]] = True
    return repeated


def _mask(rows: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.packbits(rows, axis=1, bitorder="little")]


def repeated_spans(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, across: bool = False, group_runs: int | None = None) -> DataFrame:
    """(rid, tag, pos, mask): the starts that ``pos`` tells of a row's text are repeated, or, with a mask, those whose bit is set.

    ``docs`` has rid, tag (the row's key) and text. With ``across``, it has grp too: strings count as repeated only across
    distinct rows of one grp. Rows of one key give each span once.
    """
    group_runs = group_runs or GROUP_RUNS
    width = length - kmer + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in text_pieces(batches, "text"):
            text, anchor, run, first, last, shift = runs(data, off, length, kmer)
            if len(text):
                key = rows.select(["rid", "tag"]).take(pa.array(text))
                if across:
                    anchor = mix64(anchor ^ mix64(rows.column(rows.schema.get_field_index("grp")).to_numpy()[text].view(np.uint64)))
                pos = first << 16 | (last - first) << 8 | shift
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), key.column(0), key.column(1), pa.array(pos)], names=["anchor", "run", "rid", "tag", "pos"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in text_pieces(batches, "text"):
            lists = rows.column(rows.schema.get_field_index("wanted"))
            flat = pa.Table.from_struct_array(lists.flatten())
            if not flat.num_rows:
                continue
            n = np.diff(lists.offsets.to_numpy())
            pos = flat["pos"].to_numpy()
            a = np.repeat(off[:-1], n) + (pos >> 16)
            z = a + (pos >> 8 & 0xFF) + length
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([flat["anchor"].combine_chunks(), flat["run"].combine_chunks(), pa.array(pos & 0xFF), pa.array(np.repeat(rows.column(rows.schema.get_field_index("rid")).to_numpy(), n)), flat["many"].combine_chunks(), pa.array([raw[x:y] for x, y in zip(a.tolist(), z.tolist(), strict=True)], type=pa.binary())], names=["anchor", "run", "shift", "owner", "many", "bytes"])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Masks of the runs that aren't repeated as a whole."""
        for t in keyed_groups(batches, "anchor"):
            anchors = t.column("anchor").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(anchors)) + 1, [len(anchors)]])
            at = 0
            while at < len(edges) - 1:
                to = max(at + 1, int(np.searchsorted(edges, edges[at] + BATCH_RUNS, side="right")) - 1)
                part = t.slice(int(edges[at]), int(edges[to] - edges[at]))
                group = np.repeat(np.arange(to - at), np.diff(edges[at : to + 1]))
                strings = part.column("bytes").to_pylist()
                starts = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings)) - length + 1
                many = part.column("many").to_numpy()
                who = (part.column("owner").to_numpy(), many) if across else (None, None)
                found = insert_columns(group, strings, part.column("shift").to_numpy(), starts, length, *who, kmer=kmer)
                some = np.flatnonzero(found.any(axis=1) & ~many)
                if len(some):
                    p = part.select(["anchor", "run"]).take(pa.array(some)).combine_chunks()
                    yield from p.append_column("mask", pa.array(_mask(found[some]), type=pa.binary())).to_batches()
                at = to

    def in_cells(w: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, data, off in text_pieces(batches, "bytes", 1 << 17):
                get = lambda c: rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                shift, raw = get("shift"), data.tobytes()
                row, first, last, key, part = cells(data, off, get("anchor").view(np.uint64), shift, w, length)
                a, z = (off[row] + first).tolist(), (off[row] + last + length).tolist()
                columns = [get("p_anchor")[row], get("p_run")[row], get("j0")[row] + first, key.view(np.int64), part.view(np.int64), shift[row] - first, get("owner")[row], get("many")[row]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([raw[x:y] for x, y in zip(a, z, strict=True)], type=pa.binary())], names=[c.split()[0] for c in _CELL.split(", ")])

        return run

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The masks of a run's cells as one."""
        for batch in batches:
            bits = np.zeros((batch.num_rows, width), dtype=bool)
            for i, parts in enumerate(batch.column(2).to_pylist()):
                for p in parts:
                    if p["mask"] is None:
                        bits[i, p["j0"] : p["j0"] + p["n"]] = True
                    else:
                        got = np.flatnonzero(np.unpackbits(np.frombuffer(p["mask"], dtype=np.uint8), bitorder="little"))
                        bits[i, p["j0"] + got] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_mask(bits), type=pa.binary())], names=["anchor", "run", "mask"])

    n = partitions(docs.sparkSession)
    # the runs are found twice rather than written: they are larger than what is left of them
    found = docs.mapInArrow(find, "anchor long, run long, rid long, tag int, pos long")
    several_rows = F.min("rid") != F.max("rid") if across else F.count(F.lit(1)) > 1
    twice = found.groupBy("anchor").agg(several_rows.alias("many"), F.min("run").alias("lo"), F.max("run").alias("hi")).where("many")
    # written first: a join of two plain exchanges is one whose crowded anchors Spark can split
    twice = materialize(twice.select(F.col("anchor").alias("t_anchor"), (F.col("lo") != F.col("hi")).alias("several")), "anchors")
    seen = materialize(found.join(twice, F.col("anchor") == F.col("t_anchor")).drop("t_anchor"), "runs")
    alone = seen.where("not several").select("rid", "tag", "pos", F.lit(None).cast("binary").alias("mask"))
    several = seen.where("several").drop("several")
    kinds = materialize(several.groupBy("anchor", "run").agg(several_rows.alias("many"), F.min(F.struct("rid", "tag", "pos")).alias("at")), "kinds")

    def ordered(rows: DataFrame) -> DataFrame:
        return rows.select("anchor", "run", "shift", "owner", "many", "bytes").repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(order, "anchor long, run long, mask binary")

    def crowded(rows: DataFrame) -> tuple[DataFrame, bool]:
        over = materialize(rows.groupBy("anchor").count().where(F.col("count") > group_runs).select(F.col("anchor").alias("c_anchor")), "crowded")
        return over, bool(over.limit(1).count())

    def bytes_of(which: DataFrame) -> DataFrame:
        wanted = which.groupBy(F.col("at.rid").alias("w_rid"), F.col("at.tag").alias("w_tag")).agg(F.collect_list(F.struct("anchor", "run", "many", F.col("at.pos").alias("pos"))).alias("wanted"))
        rows = docs.join(wanted, (F.col("rid") == F.col("w_rid")) & (F.col("tag") == F.col("w_tag")))
        # a key's rows are equal: whichever gives the bytes
        return rows.select("rid", "text", "wanted").mapInArrow(cut, "anchor long, run long, shift long, owner long, many boolean, bytes binary")

    over, some = crowded(kinds)
    in_over = F.col("anchor") == F.col("c_anchor")
    parts = ordered(bytes_of(kinds.join(over, in_over, "left_anti") if some else kinds))
    masks = []
    if some:
        todo = bytes_of(kinds.join(over, in_over, "left_semi")).dropDuplicates(["anchor", "run"])
        todo = todo.select(F.col("anchor").alias("p_anchor"), F.col("run").alias("p_run"), F.lit(0).cast("long").alias("j0"), "anchor", "run", "shift", "owner", "many", "bytes")
    w = width
    while some:
        w = max(1, -(-w // 4))
        cell = materialize(todo.mapInArrow(in_cells(w), _CELL), "cells")
        repeated = F.max("many") | (F.min("owner") != F.max("owner") if across else F.count(F.lit(1)) > 1)
        kind = materialize(cell.groupBy("anchor", "run").agg(repeated.alias("many"), F.min("owner").alias("owner"), F.first("shift").alias("shift"), F.first("bytes").alias("bytes")), "kinds")
        over, some = crowded(kind)
        some &= w > 1  # cells of one start hold one string each
        whole = kind.where("many").select("anchor", "run", (F.length("bytes") - length + 1).alias("n"), F.lit(None).cast("binary").alias("mask"))
        few = ordered(kind.join(over, in_over, "left_anti") if some else kind).select("anchor", "run", F.lit(0).alias("n"), "mask")
        got = materialize(whole.union(few).select(F.col("anchor").alias("m_anchor"), F.col("run").alias("m_run"), "n", "mask"), "masks")
        masks.append(cell.join(got, (F.col("anchor") == F.col("m_anchor")) & (F.col("run") == F.col("m_run"))).select("p_anchor", "p_run", F.struct("j0", "n", "mask").alias("part")))
        todo = cell.join(over, in_over, "left_semi") if some else todo
    if masks:
        each = reduce(DataFrame.union, masks).groupBy("p_anchor", "p_run").agg(F.collect_list("part").alias("parts"))  # at most a part for each start and step
        parts = parts.union(each.mapInArrow(joined, "anchor long, run long, mask binary"))
    # a run is repeated as a whole, or where its mask says
    whole = kinds.where("many").select("anchor", "run", F.lit(None).cast("binary").alias("mask"))
    marks = materialize(whole.union(parts), "masks").select(F.col("anchor").alias("m_anchor"), F.col("run").alias("m_run"), "mask")
    spans = several.join(marks, (F.col("anchor") == F.col("m_anchor")) & (F.col("run") == F.col("m_run"))).select("rid", "tag", "pos", "mask").union(alone)
    again = docs.groupBy("rid", "tag").count().where("count > 1").limit(1).count()
    return spans.dropDuplicates(["rid", "tag", "pos"]) if again else spans


def intervals(pos: np.ndarray, mask: list[bytes | None], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of bytes that the spans of one text cover."""
    first = pos >> 16
    full = np.array([b is None for b in mask], dtype=bool)
    begin, end = [first[full]], [first[full] + (pos[full] >> 8 & 0xFF) + length]
    for f, b in zip(first[~full].tolist(), (b for b in mask if b is not None), strict=True):
        at = f + np.flatnonzero(np.unpackbits(np.frombuffer(b, dtype=np.uint8), bitorder="little"))
        begin.append(at), end.append(at + length)
    begin, end = np.concatenate(begin), np.concatenate(end)
    by = np.argsort(begin, kind="stable")
    begin, end = begin[by], np.maximum.accumulate(end[by])
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > end[:-1]
    return begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """All rows with their columns, and n_bytes, n_removed, n_spans, kept (binary: the bytes left).

    With ``as_text``, kept is a string without the broken bytes of characters that were cut.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another.
    Texts are judged as UTF-8 on the input; null is empty; shorter texts keep all. Rows that repeat are copies of each
    other, so they lose all bytes if long enough. An empty table gives an empty result. Columns named like the added
    ones are replaced.
    """

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in text_pieces(batches, "text"):
            lists = rows.column(rows.schema.get_field_index("spans"))
            flat = pa.Table.from_struct_array(lists.flatten()) if len(lists.flatten()) else None
            count = np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else np.array([len(x) if x.is_valid else 0 for x in lists])
            raw, k = data.tobytes(), 0
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            pos = flat["pos"].to_numpy() if flat is not None else np.zeros(0, dtype=np.int64)
            mask = flat["mask"].to_pylist() if flat is not None else []
            for i, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                size = z - a
                text = raw[a:z]
                if count[i]:
                    begin, end = intervals(pos[k : k + count[i]], mask[k : k + count[i]], length)
                    k += count[i]
                    out["n_removed"].append(int((end - begin).sum()))
                    out["n_spans"].append(len(begin))
                    text = b"".join(text[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), size], strict=True))
                else:
                    out["n_removed"].append(0)
                    out["n_spans"].append(0)
                out["n_bytes"].append(size)
                out["kept"].append(text.decode("utf-8", "ignore") if as_text else text)
            keep = rows.select([c for c in rows.schema.names if c not in ("text", "spans")])
            yield pa.RecordBatch.from_arrays([*keep.columns, *(pa.array(out[c], type=pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], type=pa.string() if as_text else pa.binary())], names=[*keep.schema.names, *out])

    rid, tag = F.xxhash64(F.col(id_col), F.col(text_col)), F.pmod(F.xxhash64(F.col(text_col), F.lit(7), F.col(id_col)), F.lit(32768)).cast("int")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_removed", "n_spans", "kept")]
    spans = repeated_spans(docs.select(rid.alias("rid"), tag.alias("tag"), text.alias("text")), length)
    # equal rows have equal spans, found once for each
    spans = spans.groupBy(F.col("rid").alias("s_rid"), F.col("tag").alias("s_tag")).agg(F.collect_list(F.struct("pos", "mask")).alias("spans"))
    rows = docs.select(*rest, text.alias("text"), rid.alias("rid"), tag.alias("tag"))
    joined = rows.join(spans, (F.col("rid") == F.col("s_rid")) & (F.col("tag") == F.col("s_tag")), "left")
    joined = joined.select(*rest, "text", F.coalesce("spans", F.array().cast("array<struct<pos:bigint,mask:binary>>")).alias("spans"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("text", "spans")), f"n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"])
    return joined.mapInArrow(strip, schema)
