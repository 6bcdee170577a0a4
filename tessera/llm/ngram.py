"""Deleted interpolation language model: bigram, unigram and uniform estimates mixed by context-frequency bucket.

Texts are tokenised once into chunks of some 700,000 tokens: the chunk's distinct words as 64-bit hashes and the
tokens as numbers into them. Each chunk asks for the corpus counts of its distinct words and bigrams in blocks dealt out
by hash; a block's owner sums what all chunks counted and answers each chunk in its own order. So frequent words meet
once a chunk, not once an occurrence, and no table of counts is held whole anywhere. The mixture weights of each bucket
of context counts are learned by expectation-maximisation in which every training token is held out from the counts
that predict it (its own occurrence is deleted). Tokens of like evidence are summed in half-octave classes first, so
EM runs over a table whose size is bounded whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CODES, LOWER, keyed_groups, materialize, mix64, partitions, prefix_hash, span_hash, text_pieces, words

CHUNK_TOKENS = 700_000
#: Counts that one block's owner sums at once.
BLOCK_KEYS = 2_000_000
#: Tokens that one task of an exchange gets about, where the session's number of partitions would give it more.
TASK_TOKENS = 16_000_000
BUCKETS = 48
CLASSES = 64
EM_ROUNDS = 200
END = np.uint64(0x656E64206F662074)
BEGIN = np.uint64(0x626567696E6E696E)
_K = np.uint64(0x9E3779B97F4A7C15)
CHUNK = "ids array<long>, nulls array<boolean>, held array<boolean>, sizes array<int>, vocabulary binary, tokens binary, train_tokens long"


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    """crc32 of the id as text, mod ``modulus``, is ``remainder``; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def _pack(x: np.ndarray) -> bytes:
    """Little-endian values by byte planes, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _unpack(b: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def _sequence(sizes: np.ndarray, tokens: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context number of each token (the vocabulary's size for the begin), distinct pair keys, each token's pair, pair hashes."""
    u = len(vocabulary)
    context = np.empty(len(tokens), dtype=np.int64)
    context[1:] = tokens[:-1]
    context[np.cumsum(sizes) - sizes] = u
    pairs, inverse = np.unique(context * (u + 1) + tokens, return_inverse=True)
    hashes = np.append(vocabulary, BEGIN)
    return context, pairs, inverse, mix64(hashes[pairs // (u + 1)] * _K + mix64(hashes[pairs % (u + 1)] + _K))


def _chunk(ids: list, held: list, sizes: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
    n = np.concatenate([np.asarray(s, dtype=np.int64) for s in sizes])
    h = np.concatenate(hashes)
    vocabulary, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    by = np.argsort(-count, kind="stable")
    place = np.empty(len(by), dtype=np.uint32)
    place[by] = np.arange(len(by), dtype=np.uint32)
    out = np.concatenate([np.asarray(x, dtype=bool) for x in held])
    i = pa.concat_arrays(ids)
    row = {
        "ids": [i.fill_null(0).to_pylist()], "nulls": [i.is_null().to_pylist()], "held": [out.tolist()], "sizes": [n.tolist()],
        "vocabulary": [_pack(vocabulary[by])], "tokens": [_pack(place[inverse])], "train_tokens": [int(n[~out].sum())],
    }
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("nulls", pa.list_(pa.bool_())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("vocabulary", pa.binary()), ("tokens", pa.binary()), ("train_tokens", pa.int64())])
    return pa.RecordBatch.from_pydict(row, schema=schema)


def _tokenise(chunk_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list = []
        sizes: list = []
        hashes: list = []
        waiting = 0
        for rows, data, off in text_pieces(batches, "text"):
            data = LOWER[data]
            starts, ends, text = words(data, off)
            n = np.bincount(text, minlength=rows.num_rows)
            h = np.full(len(starts) + rows.num_rows, END)
            at = np.arange(len(starts)) + text
            if len(starts):
                h[at] = span_hash(prefix_hash(CODES[data]), starts, ends)
            ids.append(rows.column(0))
            held.append(rows.column(1).to_numpy(zero_copy_only=False))
            sizes.append(n + 1)
            hashes.append(h)
            waiting += len(h)
            if waiting >= chunk_tokens:
                yield _chunk(ids, held, sizes, hashes)
                ids, held, sizes, hashes, waiting = [], [], [], [], 0
        if waiting:
            yield _chunk(ids, held, sizes, hashes)

    return run


def _ask(blocks: int):
    """Rows (block, chunk, kind, keys, counts) of each chunk: kind 0 words, 1 bigrams; counts are of training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], dtype=np.int64)
                vocabulary, tokens = _unpack(row["vocabulary"], np.uint64), _unpack(row["tokens"], np.uint32).astype(np.int64)
                _, _, inverse, pair_hashes = _sequence(sizes, tokens, vocabulary)
                train = np.repeat(~np.array(row["held"], dtype=bool), sizes)
                out: dict[str, list] = {"block": [], "chunk": [], "kind": [], "keys": [], "counts": []}
                for kind, keys, which in ((0, vocabulary, tokens), (1, pair_hashes, inverse)):
                    count = np.bincount(which[train], minlength=len(keys)).astype(np.uint32)
                    block = (keys % np.uint64(blocks)).astype(np.int64)
                    by = np.argsort(block, kind="stable")
                    edge = np.searchsorted(block[by], np.arange(blocks + 1))
                    rest = keys // np.uint64(blocks)
                    for b in np.flatnonzero(np.diff(edge)).tolist():
                        part = by[edge[b] : edge[b + 1]]
                        k = rest[part]
                        # words keep all bits; of a bigram's hash, 48 bits beside the block's number tell it
                        raw = k.tobytes() if kind == 0 else np.ascontiguousarray(k.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                        for c, v in (("block", 2 * b + kind), ("chunk", row["chunk"]), ("kind", kind), ("keys", raw), ("counts", _pack(count[part]))):
                            out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The corpus counts of each asked block, in the order asked; a row of chunk null holds the block's number of known words."""
    schema = pa.schema([("chunk", pa.int64()), ("block", pa.int64()), ("counts", pa.binary()), ("known", pa.int64())])
    for t in keyed_groups(batches, "block"):
        blocks = t.column("block").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]]).tolist()
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            part = t.slice(a, z - a)
            kind = part.column("kind")[0].as_py()
            keys = []
            for raw in part.column("keys").to_pylist():
                if kind == 0:
                    keys.append(np.frombuffer(raw, dtype=np.uint64))
                else:
                    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
                    wide[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
                    keys.append(wide.view(np.uint64).ravel())
            counts = [_unpack(c, np.uint32) for c in part.column("counts").to_pylist()]
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.uint64)
            answers = np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1])
            known = int((total > 0).sum()) if kind == 0 else 0
            yield pa.RecordBatch.from_pydict({"chunk": [*part.column("chunk").to_pylist(), None], "block": [*part.column("block").to_pylist(), int(blocks[a])], "counts": [*map(_pack, answers), b""], "known": [*[0] * (z - a), known]}, schema=schema)


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64) + (count > 0), BUCKETS - 1)


def _each_chunk(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A chunk's row, and for each token the counts of its word, its context and its bigram."""
    for t in keyed_groups(batches, "chunk"):
        numbers = t.column("chunk").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)]]).tolist()
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            rows = t.slice(a, z - a).to_pylist()
            row = next(r for r in rows if r["tokens"] is not None)
            sizes = np.array(row["sizes"], dtype=np.int64)
            vocabulary, tokens = _unpack(row["vocabulary"], np.uint64), _unpack(row["tokens"], np.uint32).astype(np.int64)
            context, _, inverse, pair_hashes = _sequence(sizes, tokens, vocabulary)
            found = []
            for kind, keys in ((0, vocabulary), (1, pair_hashes)):
                by = np.argsort((keys % np.uint64(blocks)).astype(np.int64), kind="stable")
                c = np.concatenate([_unpack(r["counts"], np.uint64) for r in sorted((r for r in rows if r["tokens"] is None and r["block"] % 2 == kind), key=lambda r: r["block"])])
                full = np.empty(len(keys), dtype=np.int64)
                full[by] = c
                found.append(full)
            yield row, sizes, found[0][tokens], np.append(found[0], -1)[context], found[1][inverse]


def learn_weights(table: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket by EM. table: bucket, tokens, p2/p0 and p1/p0 of each class."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    if len(table):
        bucket, n = table[:, 0].astype(np.int64), table[:, 1]
        ratio = np.stack([table[:, 2], table[:, 3], np.ones(len(table))], axis=1)
        total = np.bincount(bucket, weights=n, minlength=BUCKETS)
        for _ in range(rounds):
            share = weights[bucket] * ratio
            share *= (n / share.sum(axis=1))[:, None]
            new = np.stack([np.bincount(bucket, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1)
            weights = np.where(total[:, None] > 0, new / np.maximum(total, 1)[:, None], weights)
    # a bucket without tokens takes the nearest smaller one's; nothing is known of a bucket below: no bigram weight there
    seen = np.zeros(BUCKETS, dtype=bool) if not len(table) else np.bincount(table[:, 0].astype(np.int64), minlength=BUCKETS) > 0
    for b in range(1, BUCKETS):
        if not seen[b]:
            weights[b] = weights[b - 1]
    # no outcome is impossible
    weights = np.maximum(weights, 1e-9)
    weights[0, 0] = 0
    return weights / weights.sum(axis=1, keepdims=True)


def score_texts(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Counts come from rows where ``held`` is false. Tokens are A-Z-lower-cased words and one end a text; a null or empty
    text is its end alone. Unknown words share one unit of the uniform part. With no training row all counts are zero,
    weights stay at their start and scores are those of the uniform part. Rows that repeat are rows of their own. An
    empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held"), F.col(text_col).alias("text"))
    # numbers are given as the table is written: a task that runs again writes it whole again
    chunks = materialize(rows.mapInArrow(_tokenise(chunk_tokens), CHUNK).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    tokens, n_train, n_docs = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum("train_tokens"), F.sum(F.size(F.filter("held", lambda h: ~h)))).first()
    tokens, n_train, begins = tokens or 0, n_train or 0, n_docs or 0
    n = max(partitions(spark), -(-tokens // TASK_TOKENS))
    blocks = max(n, -(-tokens // block_keys))
    asked = chunks.mapInArrow(_ask(blocks), "block long, chunk long, kind int, keys binary, counts binary")
    counts = materialize(asked.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_answer, "chunk long, block long, counts binary, known long"), "counts")
    known = counts.agg(F.sum("known")).first()[0] or 0
    left = chunks.select("chunk", F.lit(-1).cast("long").alias("block"), F.lit(None).cast("binary").alias("counts"), "ids", "nulls", "held", "sizes", "vocabulary", "tokens")
    right = counts.where("chunk is not null").select("chunk", "block", "counts", *(F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<long>"), ("nulls", "array<boolean>"), ("held", "array<boolean>"), ("sizes", "array<int>"), ("vocabulary", "binary"), ("tokens", "binary"))))
    both = left.union(right).repartition(n, "chunk").sortWithinPartitions("chunk")
    uniform = 1.0 / (known + 1)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, sizes, word, context, pair in _each_chunk(batches, blocks):
            train = np.repeat(~np.array(row["held"], dtype=bool), sizes)
            word, context, pair = word[train], np.where(context[train] < 0, begins, context[train]) - 1, pair[train]
            if not len(word):
                continue
            p2 = np.where(context > 0, (pair - 1) / np.maximum(context, 1), 0) / uniform
            p1 = (word - 1) / max(n_train - 1, 1) / uniform
            key = _bucket(context)
            for p in (p2, p1):
                half = np.where(p > 0, np.clip(np.floor(np.log2(np.maximum(p, 1e-300)) * 2) + 20, 1, CLASSES - 1), 0).astype(np.int64)
                key = key * CLASSES + half
            some, inverse = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.bincount(inverse).astype(np.float64)), pa.array(np.bincount(inverse, weights=p2)), pa.array(np.bincount(inverse, weights=p1))], names=["k", "n", "r2", "r1"])

    # at most BUCKETS * CLASSES * CLASSES rows
    table = both.mapInArrow(evidence, "k long, n double, r2 double, r1 double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("r2").alias("r2"), F.sum("r1").alias("r1")).orderBy("k").toPandas()
    weights = learn_weights(np.stack([table.k // CLASSES**2, table.n, table.r2 / table.n, table.r1 / table.n], axis=1).astype(np.float64)) if len(table) else learn_weights(np.zeros((0, 4)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, sizes, word, context, pair in _each_chunk(batches, blocks):
            context = np.where(context < 0, begins, context)
            w = weights[_bucket(context)]
            p = w[:, 0] * np.where(context > 0, pair / np.maximum(context, 1), 0) + w[:, 1] * (word / max(n_train, 1)) + w[:, 2] * uniform
            at = np.cumsum(sizes) - sizes
            base = np.add.reduceat(np.log10((word + 1) / (n_train + known + 1)), at)
            ids = pa.array(row["ids"], type=pa.int64(), mask=np.array(row["nulls"], dtype=bool))
            yield pa.RecordBatch.from_arrays([ids, pa.array(row["held"]), pa.array(sizes), pa.array(np.add.reduceat((word > 0).astype(np.int64), at)), pa.array(np.full(len(sizes), n_train, dtype=np.int64)), pa.array(base), pa.array(np.add.reduceat(np.log10(p), at))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return both.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
