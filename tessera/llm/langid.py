"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a document's language are multiplied: the text's likelihood under hashed byte-trigram
models, the declared language's and the address suffix's likelihoods (smoothed tables of how often each is stated by
documents of a language), and a prior of the host, smoothed toward its domain's, its suffix's and the corpus's. Models and
tables are grouped counts over all documents: the trigram models by declared language, the rest by the language that
the text alone speaks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, materialize, text_pieces

BINS = 1 << 13
#: Trigrams that a text's likelihood counts for at most: neighbouring trigrams aren't independent.
EVIDENCE = 40.0
#: Documents that a parent's prior counts for, and pseudo-counts of the tables.
STRENGTH = 10.0
SMOOTH = 1.0
#: Posterior below which a document is rejected: no language has the larger half.
CONFIDENCE = 0.5
#: Rows by languages that are scored at once.
CELLS = 1 << 22
#: Hosts up to which their priors are broadcast; more are joined by shuffle.
BROADCAST_HOSTS = 5000
_PREFIX = "_lid_"


def _bins(data: np.ndarray) -> np.ndarray:
    """A bin for each byte trigram (letters case folded, every run of other ASCII as it is but digits and marks as spaces)."""
    x = _CLASS[data].astype(np.uint32)
    return ((x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(19)).astype(np.int64)


_CLASS = LOWER.copy()
_CLASS[: ord("a")] = 32
_CLASS[65:91] = np.arange(97, 123)
_CLASS[123:128] = 32


def _windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the trigrams within one text that aren't blank, and their text numbers."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    b = _bins(data)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    plain = _CLASS[data] != 32
    ok = (text[:-2] == text[2:]) & (plain[:-2] | plain[1:-1]) & (plain[1:-1] | plain[2:])
    return b[ok], text[:-2][ok]


def _log_likelihoods(data: np.ndarray, off: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts by languages: log likelihood, tempered to EVIDENCE trigrams; and the number of trigrams."""
    b, text = _windows(data, off)
    n = np.bincount(text, minlength=len(off) - 1)
    out = np.stack([np.bincount(text, weights=row[b], minlength=len(off) - 1) for row in model], axis=1)
    return out * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None], n


def _slices(batches: Iterator[pa.RecordBatch], n_langs: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most CELLS / n_langs rows."""
    step = max(1, CELLS // n_langs)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def suffix_of(url: Column) -> Column:
    """The language that an address states: a two-letter first path segment, else the last label of the host."""
    path = F.regexp_extract(url, r"(?i)^[^:]*://[^/?#]*/([a-z]{2})(?:[/?#-]|$)", 1)
    return F.lower(F.when(path != "", path).otherwise(F.nullif(F.regexp_extract(url, r"^[^:]*://[^/?#]*?([a-zA-Z]+)(?:[:/?#]|$)", 1), F.lit(""))))


def identify(docs: DataFrame, text: Column | str, declared: Column, host: Column, suffix: Column, confidence: float = CONFIDENCE, train: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """All rows and columns of ``docs``, and language, posterior, text_language, accepted.

    ``keep`` names the columns that are returned, by default all: others don't go through Python. A text that is a column's
    name and returned goes there once.

    ``train`` (text, declared) has the texts that the trigram models are counted on; by default ``docs`` with its declared
    languages. Every declared language with a trigram in its texts is a class, however few they are; declarations that
    differ in case or outer spaces are one, named as most of its documents write it, and blank ones are none. A row is accepted if its text has a trigram and the best language's posterior reaches ``confidence``.
    Null or empty texts are carried by the other evidence and not accepted; null declared languages, suffixes and hosts
    are no evidence. Without any declared language there is no class: language is null and nothing is accepted. Rows that
    repeat count and score as rows of their own. Columns of ``docs`` named like the added ones are replaced.
    """
    named, text = (text, F.col(text)) if isinstance(text, str) else (None, text)
    if train is None:
        train = docs.select(text.alias("text"), declared.alias("declared"))
    clean = lambda c: F.lower(F.trim(c))
    train = train.withColumn("written", F.col("declared")).withColumn("declared", clean(F.col("declared"))).where("declared <> ''")
    # a row for each spelling of each language
    spellings = train.select("text", "declared", "written").groupBy("declared", "written").agg(F.count("*").alias("n"))
    name = F.min_by("written", F.struct((-F.col("n")).alias("n"), "written")).alias("name")
    names = sorted((r.name, r.declared) for r in spellings.groupBy("declared").agg(name).collect())
    rest = [c for c in (docs.columns if keep is None else keep) if c not in ("language", "posterior", "text_language", "accepted")]
    own = named if named in rest else f"{_PREFIX}text"
    number = {key: i for i, (_, key) in enumerate(names)}
    n_names = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_names * BINS, dtype=np.int64)
        for rows, data, off in text_pieces(batches, "text"):
            lang = np.array([number.get(d, -1) for d in rows.column(1).to_pylist()])
            b, t = _windows(data, off)
            ok = lang[t] >= 0
            k, n = np.unique(lang[t[ok]] * BINS + b[ok], return_counts=True)
            sums[k] += n
        k = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(sums[k])], names=["k", "n"])

    # at most languages * BINS rows
    counts = train.select("text", "declared").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas() if names else None
    table = np.zeros(n_names * BINS)
    if names:
        table[counts.k.to_numpy()] = counts.n.to_numpy()
    table = table.reshape(n_names, BINS)
    some = np.flatnonzero(table.any(axis=1))
    langs, keys = [names[i][0] for i in some], [names[i][1] for i in some]
    if not langs:
        none = F.lit(None)
        return docs.select(*rest, none.cast("string").alias("language"), none.cast("double").alias("posterior"), none.cast("string").alias("text_language"), F.lit(False).alias("accepted"))
    table = table[some] + 0.5
    model = np.log(table / table.sum(axis=1, keepdims=True))
    n_langs = len(langs)
    known = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*rest, *([] if own in rest else [text.alias(own)]), clean(declared).alias(f"{_PREFIX}declared"), clean(host).alias(f"{_PREFIX}host"), clean(suffix).alias(f"{_PREFIX}suffix"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in text_pieces(_slices(batches, n_langs), own):
            score, n = _log_likelihoods(data, off, known.value)
            top = np.where(n > 0, score.argmax(axis=1), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(top)], names=["declared", "host", "suffix", "top"])

    seen = inner.select(f"{_PREFIX}declared", f"{_PREFIX}host", f"{_PREFIX}suffix", own).mapInArrow(best, "declared string, host string, suffix string, top int").where("top >= 0")
    # counts by host and statement: as many rows as there are kinds of them, not documents
    cells = materialize(seen.groupBy("declared", "host", "suffix", "top").count(), "languages")

    corpus = np.zeros(n_langs)
    for r in cells.groupBy("top").agg(F.sum("count").alias("n")).collect():
        corpus[r.top] = r.n
    base = (corpus + SMOOTH) / (corpus.sum() + SMOOTH * n_langs)

    def stated(column: str) -> dict[str, np.ndarray]:
        """log P(statement | language) for the statements that name a class; any other is no evidence."""
        m = np.full((n_langs, n_langs), SMOOTH)
        row = {key: i for i, key in enumerate(keys)}
        for r in cells.where(F.col(column).isin(keys)).groupBy(column, "top").agg(F.sum("count").alias("n")).collect():
            m[row[r[0]], r.top] += r.n
        m = np.log(m / m.sum(axis=0, keepdims=True))
        return {key: m[i] for i, key in enumerate(keys)}

    # priors: corpus -> last label -> domain -> host, by grouped counts; a row's array has an entry for each language
    hosted = cells.where("host is not null").groupBy("host", "top").agg(F.sum("count").alias("n"))

    def counted(level: str, of: Column) -> DataFrame:
        per = hosted.groupBy(of.alias(f"of_{level}"), "top").agg(F.sum("n").alias("n"))
        per = per.groupBy(f"of_{level}").agg(F.map_from_entries(F.collect_list(F.struct("top", "n"))).alias("by"), F.sum("n").alias(f"all_{level}"))
        got = F.transform(F.sequence(F.lit(0), F.lit(n_langs - 1)), lambda i: F.coalesce(F.col("by")[i], F.lit(0)))
        return per.select(f"of_{level}", got.alias(f"n_{level}"), f"all_{level}")

    prior = F.array(*(F.lit(float(x)) for x in base))
    hosts = materialize(counted("host", F.col("host")), "hosts")
    for level, of in (("label", F.substring_index("of_host", ".", -1)), ("domain", F.substring_index("of_host", ".", -2)), ("host", None)):
        if of is not None:
            hosts = hosts.join(counted(level, F.substring_index("host", ".", -1 if level == "label" else -2)), of == F.col(f"of_{level}"))
        smoothed = F.zip_with(f"n_{level}", prior, lambda g, p: (g + STRENGTH * p) / (F.col(f"all_{level}") + STRENGTH))  # noqa: B023
        # a host without dots is its own label and domain, whose counts say nothing more
        prior = smoothed if of is None else F.when(of != F.col("of_host"), smoothed).otherwise(prior)
    hosts = materialize(hosts.select(F.col("of_host").alias(f"{_PREFIX}h"), F.transform(prior, lambda p: F.log(p)).alias(f"{_PREFIX}prior")), "priors")
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    says, suffixes = stated("declared"), stated("suffix")
    nothing = np.zeros(n_langs)
    base_log = np.log(base).tolist()
    joined = inner.join(F.broadcast(hosts) if few else hosts, F.col(f"{_PREFIX}host") == F.col(f"{_PREFIX}h"), "left").drop(f"{_PREFIX}h", f"{_PREFIX}host")
    added = "language string, posterior double, text_language string, accepted boolean"
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema), added])

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in text_pieces(_slices(batches, n_langs), own):
            score, n = _log_likelihoods(data, off, known.value)
            get = lambda c: rows.column(rows.schema.get_field_index(_PREFIX + c)).to_pylist()
            total = score + np.array([p or base_log for p in get("prior")])
            total += np.array([says.get(d, nothing) for d in get("declared")]) + np.array([suffixes.get(d, nothing) for d in get("suffix")])
            p = np.exp(total - total.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            top = p.argmax(axis=1)
            sure = p[np.arange(len(p)), top]
            alone = score.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(rows.schema.get_field_index(c)) for c in rest), pa.array([langs[i] for i in top]), pa.array(sure), pa.array([langs[i] if k else None for i, k in zip(alone, n, strict=True)], type=pa.string()), pa.array((n > 0) & (sure >= confidence))],
                names=[*rest, "language", "posterior", "text_language", "accepted"],
            )

    return joined.mapInArrow(fuse, out_schema)


def identify_documents(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``identify`` for rows of documents: ``lang`` is the declared language, ``source`` the host; there is no address."""
    return identify(docs, "text", F.col("lang"), F.col("source"), F.lit(None).cast("string"), keep=keep)


def identify_pages(pages: DataFrame, documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``identify`` for web pages with all evidence: the html element's lang, the address, the host; models from ``documents``."""
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1)
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    host = F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)
    return identify(pages, body, F.nullif(declared, F.lit("")), F.nullif(host, F.lit("")), suffix_of(F.col("url")), train=documents.select("text", F.col("lang").alias("declared")), keep=keep)
