"""Benchmark decontamination by spaced-seed hashing.

Fixed masks of at most twelve words ignore some positions, so a window still hits where a substituted word falls on an
ignored one; together they hit every overlap, whichever of its words are substituted. Windows of the benchmark and of
the documents are hashed under each mask, and the two tables of hashes are joined; a bitmap of the benchmark's hashes
keeps what can't meet out of the exchange. Of each document and item that share a hash, the item is laid along the
document at every shift that a seed hits, word by word as far as both go; the overlap is the longest stretch of such a
laying that is long enough and of whose words enough agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CODES, Bitmap, materialize, mix64, prefix_hash, span_hash, text_pieces
from tessera.llm.toxicity import fold, letters_words

#: The seeds, a 1 for each word that counts. Some mask fits wherever 2 of 12, 3 of 15, 4 of 20 or 5 of 25 words
#: are substituted, so in all overlaps of 13 to 25 words; a longer overlap has such a part that agrees to MIN_AGREE.
MASKS = ("11110111", "1100101111", "11011001011", "1111111", "110100101011", "11100010111", "111010100011")
#: Items of fewer words match whole and word for word.
SPAN = max(map(len, MASKS))
MIN_WORDS = 13
MIN_AGREE = 0.8
#: A substitution weighs as much as so many agreeing words: a stretch agrees to MIN_AGREE if its sum isn't negative.
LOSS = 4
#: Items that one row of a document is compared with; a document that shares hashes with more is dealt into several rows.
ITEMS_A_ROW = 4096
_RID, _TAG = "_sh_rid", "_sh_tag"


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and their text numbers: runs of letters and digits, case folded."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    data = fold(data)
    starts, ends, text = letters_words(data, off)
    return span_hash(prefix_hash(CODES[data]), starts, ends), text


def word_hashes(text: str) -> np.ndarray:
    """The word hashes of one text."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return _tokens(raw, np.array([0, len(raw)]))[0]


def seeds(h: np.ndarray, text: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all windows under a mask that lie within one text."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    total = np.full(n, np.uint64(number + 1))
    for j in (j for j, c in enumerate(mask) if c == "1"):
        total += h[j : j + n] * mix64(np.array([j + 1], dtype=np.uint64))
    at = np.flatnonzero(text[:n] == text[len(mask) - 1 :])
    return at, mix64(total[at])


def masks_of(words: int) -> list[tuple[int, str]]:
    """Numbers and masks for an item of so many words: one that takes it whole if it is shorter than SPAN."""
    return list(enumerate(MASKS)) if words >= SPAN else [(len(MASKS) + words, "1" * words)] if words else []


class Document:
    """A document's words, and its windows by hash."""

    def __init__(self, h: np.ndarray):
        self.h = h
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def shifts(self, item: np.ndarray) -> np.ndarray:
        """All shifts of the item's first word at which some seed hits."""
        n = len(item)
        hit = np.zeros(len(self.h) + n + 1, dtype=bool)
        for number, mask in masks_of(n):
            if number not in self.windows:
                at, s = seeds(self.h, np.zeros(len(self.h), dtype=np.int8), mask, number)
                by = np.argsort(s, kind="stable")
                self.windows[number] = s[by], at[by]
            keys, at = self.windows[number]
            p, s = seeds(item, np.zeros(n, dtype=np.int8), mask, number)
            lo, hi = np.searchsorted(keys, s), np.searchsorted(keys, s, side="right")
            for i in np.flatnonzero(hi > lo).tolist():
                hit[at[lo[i] : hi[i]] - p[i] + n] = True
        return np.flatnonzero(hit) - n

    def overlap(self, item: np.ndarray) -> tuple[int, int, int] | None:
        """The longest verified overlap over all shifts: words, words that agree, first word; ties to the first."""
        n, best = len(item), None
        for shift in self.shifts(item).tolist():
            a, z = max(0, -shift), min(n, len(self.h) - shift)
            same = item[a:z] == self.h[a + shift : z + shift]
            if span := longest(same, min(MIN_WORDS, n)):
                found = (span[1] - span[0], int(same[span[0] : span[1]].sum()), shift + a + span[0])
                if best is None or found[:2] > best[:2]:
                    best = found
        return best


def longest(same: np.ndarray, least: int) -> tuple[int, int] | None:
    """The longest span of at least ``least`` words that agrees to MIN_AGREE and begins and ends with words that agree.

    If only spans with substituted ends are long enough, the ``least`` words that agree most; None if there are none.
    """
    if len(same) < least or not same.any():
        return None
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -LOSS))])
    ends = np.flatnonzero(same) + 1
    # the least score before any start so far falls, so the first start that an end can reach is found by bisection
    low = np.minimum.accumulate(np.where(same, score[:-1], len(same) + 1))
    starts = np.searchsorted(-low, -score[ends])
    k = np.lexsort((score[ends] - score[starts], ends - starts))[-1]
    if ends[k] - starts[k] >= least:
        return int(starts[k]), int(ends[k])
    gains = score[least:] - score[:-least]
    k = int(gains.argmax())
    return (k, k + least) if gains[k] >= 0 else None


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, item, short): the hashes of each item's windows; short: the item's words if it is taken whole, else 0."""
    for rows, data, off in text_pieces(batches, "text"):
        h, text = _tokens(data, off)
        size = np.bincount(text, minlength=rows.num_rows)
        item = rows.column(0).to_numpy()
        short = sorted(set(size[(size > 0) & (size < SPAN)].tolist()))
        for n, masks in [(0, masks_of(SPAN)), *((n, masks_of(n)) for n in short)]:
            for number, mask in masks:
                at, s = seeds(h, text, mask, number)
                fit = size[text[at]] == n if n else size[text[at]] >= SPAN
                at, s = at[fit], s[fit]
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(item[text[at]]), pa.array(np.full(len(at), n, dtype=np.int32))], names=["k", "item", "short"])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", items_a_row: int = ITEMS_A_ROW) -> DataFrame:
    """All rows and columns of ``docs``, and overlaps: array of (item_id, words, agree, first_word), longest first.

    Each text meets each item that shares a seed's hash once, so equal texts have equal overlaps and a passage that many
    texts hold is a frequent key of a join that Spark can split. Null and empty texts (or items) overlap nothing; items
    shorter than MIN_WORDS must be met whole, those shorter than SPAN word for word. Items that repeat (same id and text)
    are one; ties of length go to the smaller item_id, null last. Empty tables give no overlaps or no rows. Texts are
    known by 128 bits of hash. A column of ``docs`` named overlaps is replaced.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c != "overlaps"]
    kind = "array<struct<item_id:bigint,words:int,agree:int,first_word:int>>"
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [F.xxhash64(text).alias(_RID), F.xxhash64(F.lit(7), text).alias(_TAG)]
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    items = materialize(items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text"), "items")
    found = materialize(items.select("item", "text").mapInArrow(_item_seeds, "k long, item long, short int"), "seeds")
    short = sorted(r.short for r in found.where("short > 0").select("short").distinct().collect())  # at most SPAN - 1
    masks = [*enumerate(MASKS), *(m for n in short for m in masks_of(n))]
    shared = spark.sparkContext.broadcast(Bitmap(found, "k", found.count()))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = shared.value
        for rows, data, off in text_pieces(batches, "text"):
            h, text = _tokens(data, off)
            both = []
            for number, mask in masks:
                at, s = seeds(h, text, mask, number)
                ok = may.has(s)
                both.append(np.stack([text[at[ok]].astype(np.uint64), s[ok]], axis=1))
            both = np.unique(np.concatenate(both), axis=0)
            if len(both):
                keys = rows.select([_RID, _TAG]).take(pa.array(both[:, 0].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 1].astype(np.uint64).view(np.int64)), *keys.columns], names=["k", _RID, _TAG])

    texts = docs.select(*key, text.alias("text"))
    # copies of a text give equal rows, which leave a task once
    met = materialize(texts.mapInArrow(hits, f"k long, {_RID} long, {_TAG} long").distinct(), "hits")
    pairs = met.join(found.select(F.col("k").alias("i_k"), "item"), F.col("k") == F.col("i_k")).select(_RID, _TAG, "item").distinct()
    pairs = materialize(pairs, "pairs")
    parts = -(-items.count() // items_a_row)
    with_items = pairs.join(items.withColumnRenamed("item", "i_item"), F.col("item") == F.col("i_item"))
    lists = with_items.groupBy(_RID, _TAG, F.pmod("item", F.lit(max(1, parts))).alias("part")).agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    lists = materialize(lists.select(F.col(_RID).alias("l_rid"), F.col(_TAG).alias("l_tag"), "items"), "lists")
    known = pairs.select(_RID).distinct()
    some = spark.sparkContext.broadcast(Bitmap(known, _RID, known.count()))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(some.value.has(batch.column(0).to_numpy())))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in text_pieces(batches, "text"):
            h, text = _tokens(data, off)
            edge = np.searchsorted(text, np.arange(rows.num_rows + 1))
            out: dict[str, list] = {n: [] for n in (_RID, _TAG, "item_id", "words", "agree", "first_word")}
            for i in range(rows.num_rows):
                doc = Document(h[edge[i] : edge[i + 1]])
                for it in rows.column(rows.schema.get_field_index("items"))[i].as_py():
                    if best := doc.overlap(word_hashes(it["text"])):
                        for n, v in zip(out, (rows.column(0)[i].as_py(), rows.column(1)[i].as_py(), it["item_id"], *best), strict=True):
                            out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(_RID, pa.int64()), (_TAG, pa.int64()), ("item_id", pa.int64()), *((n, pa.int32()) for n in ("words", "agree", "first_word"))]))

    there = texts.mapInArrow(chosen, texts.schema)
    there = there.join(lists, (F.col(_RID) == F.col("l_rid")) & (F.col(_TAG) == F.col("l_tag"))).select(_RID, _TAG, "text", "items")
    sure = there.mapInArrow(verify, f"{_RID} long, {_TAG} long, item_id long, words int, agree int, first_word int").distinct()
    order = F.struct((-F.col("words")).alias("w"), (-F.col("agree")).alias("a"), F.col("item_id").isNull().alias("n"), F.struct("item_id", "words", "agree", "first_word").alias("o"))
    sure = sure.groupBy(_RID, _TAG).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["o"]).alias("overlaps"))
    sure = materialize(sure.select(F.col(_RID).alias("o_rid"), F.col(_TAG).alias("o_tag"), "overlaps"), "overlaps")
    out = docs.select(*rest, *key).join(sure, (F.col(_RID) == F.col("o_rid")) & (F.col(_TAG) == F.col("o_tag")), "left")
    return out.select(*rest, F.coalesce("overlaps", F.array()).cast(kind).alias("overlaps"))
