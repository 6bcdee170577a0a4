"""Main text of HTML pages by what a host repeats.

A page is read once into blocks, each with what its markup says: inside an article or main element (text), inside a
landmark (menu, header, footer, sidebar, form, advert, notice, comments: a boilerplate mark), or neither. The token
streams of all blocks outside articles, and of marked blocks inside them, are taken together by host, and substrings of
``LENGTH`` bytes repeated across distinct pages of the host are found by the suffix order of ``suffix`` (so a host with
most pages is dealt out by its strings, not held in one task). What such substrings cover is boilerplate and goes,
whatever its markup; unique runs of blocks without a mark stay. Marks decide only what no other page of the host
repeats. Repeats inside articles stay: syndicated passages are text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, text_pieces
from tessera.llm.suffix import intervals, repeated_spans

#: Bytes of a repeated substring, and of its anchor.
LENGTH, KMER = 40, 16
MAIN, MARKED, OPEN = b"m", b"k", b"o"

# one pass, whatever is left open: a tag ends at the first > outside quotes, or else at the first >
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*+)(>|\Z))", re.S)
_ROLE = re.compile(r"""(?<!\S)(class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# Elements by what they do to text.
RAW = {"script", "style", "template", "iframe", "noembed", "noframes", "textarea", "select", "title", "canvas", "audio", "video"}
LANDMARKS = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog"}
CONTAINERS = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big button cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= set("math mi mn mo ms mtext mrow msup msub mfrac msqrt semantics annotation svg text tspan g object noscript".split())
#: Names that mark a block, if all parts of the name are these or filling: a share-price or notice-period is text.
NAMES = set("ad ads advert adverts advertisement sponsored promo banner sidebar nav navbar navigation menu breadcrumb breadcrumbs header masthead footer cookie cookies consent notice notices newsletter comment comments commentlist disqus complementary contentinfo".split())
FILLING = set("area bar block bottom box container content global inner left list main outer page primary right secondary section site slot top unit widget wrap wrapper".split())
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[^a-z0-9]+")


def marked(tag: str, attributes: str) -> bool:
    """Whether an element is a landmark by its name, or by a class, id or role that is made of landmark names."""
    if tag in LANDMARKS or tag in RAW:
        return True
    if attributes and tag not in ("html", "body"):
        for kind, a, b, c in _ROLE.findall(attributes):
            for name in (a or b or c).lower().split():
                parts = [p for p in _PART.split(name) if p]
                if any(p in NAMES for p in parts) and all(p in NAMES or p in FILLING or p.isdigit() for p in parts):
                    return True
                if kind.lower() == "role" and name in ("search", "form"):
                    return True
    return False


def blocks(page: str) -> list[tuple[bytes, str]]:
    """(kind, text) of each block in page order; white space is one space, references are decoded, empty blocks are left out.

    Time grows with the page's size alone, whatever its markup.
    """
    out: list[tuple[bytes, str]] = []
    parts: list[str] = []
    mains = 0  # open article and main elements
    skip: list[tuple[str, int]] = []  # the marked element, and how many of its name are open within
    skip_outside = False
    endless: set[str] = set()  # raw elements of which no further end was found

    def close() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append((MARKED if skip else MAIN if mains else OPEN, text))

    at = 0
    while m := _TOKEN.search(page, at):
        parts.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        if m[3] is None and not m[5]:  # the page ends within a tag: not markup
            parts.append(m[0])
            continue
        closing, tag, attributes = m[1] == "/", m[2].lower(), m[3] or m[4] or ""
        if tag in INLINE and not (not closing and attributes and marked(tag, attributes)) and not (skip and skip[-1][0] == tag):
            continue
        if tag in RAW and not closing and not attributes.endswith("/"):
            # what is inside isn't markup
            close()
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end is None:
                endless.add(tag)
            at = end.end() if end else (len(page) if tag in ("script", "style") else at)
            continue
        close()
        if tag in VOID:
            continue
        if tag in CONTAINERS and not (not closing and marked(tag, attributes)):
            if closing:
                if mains:
                    mains -= 1
                    if skip and not skip_outside:
                        skip.clear()
            else:
                if skip and skip_outside:
                    skip.clear()  # an element left open before the article
                if not skip:
                    mains += 1
            continue
        if skip:
            name, depth = skip[-1]
            if tag == name:
                depth += -1 if closing else 1
                skip[-1] = (name, depth)
                if not depth:
                    skip.pop()
        elif not closing and marked(tag, attributes):
            skip.append((tag, 1))
            skip_outside = not mains
    parts.append(page[at:])
    close()
    return out


def uncovered(text: str, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[str, bool]:
    """What is left of a block whose bytes begin..end (from its start, sorted, apart) are repeated, and whether all went.

    A run counts if it is the whole block or ``length`` bytes long within it: a repeat that ends in a block's first words
    is another block's. Words that a run touches go as a whole.
    """
    size = len(text.encode())
    begin, end = np.maximum(begin, 0), np.minimum(end, size)
    ok = end - begin >= min(length, size)
    begin, end = begin[ok], end[ok]
    if not len(begin):
        return text, False
    if begin[0] == 0 and end[0] == size:
        return "", True
    words = text.split(" ")
    z = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    a = np.concatenate([[0], z[:-1] + 1])
    k = np.searchsorted(end, a, side="right")
    hit = (k < len(begin)) & (begin[np.minimum(k, len(begin) - 1)] < z)
    left = " ".join(w for w, h in zip(words, hit.tolist(), strict=True) if not h)
    return left, not left


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", length: int = LENGTH) -> DataFrame:
    """page_id, url, text, n_chars, repeated, by_mark of every row of ``pages``.

    repeated and by_mark count the blocks that went because the host repeats them, and those that only their markup
    decided. A null or empty html gives an empty text. Pages without a host share one. Rows that repeat (same id, url and
    html) give the same text and count as one page. An empty table gives an empty result. Other columns are not read.
    """
    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    rid, tag = F.xxhash64(id_col, url_col, html_col), F.pmod(F.xxhash64(html_col, F.lit(7), id_col), F.lit(32768)).cast("int")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), rid.alias("rid"), tag.alias("tag"), F.xxhash64(host).alias("grp"))

    kind = rows.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in text_pieces(batches, "html"):
            found = [blocks(h) for h in batch.column(2).to_pylist()]
            # a block's text holds no line end, so blocks are told apart by one
            kinds = pa.array([b"".join(k for k, _ in bs) for bs in found], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[3:], kinds, pa.array(["\n".join(t for _, t in bs) for bs in found], type=pa.string())], names=["page_id", "url", "rid", "tag", "kinds", "body"])

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in text_pieces(batches, "html"):
            texts = ["\n".join(t for k, t in blocks(h) if k != MAIN) for h in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, type=pa.string())], names=["rid", "tag", "grp", "text"])

    # what isn't an article's is little and written; pages are read again for the result rather than written too
    stream = materialize(rows.select("rid", "tag", "grp", "html").mapInArrow(streams, "rid long, tag int, grp long, text string").where("text <> ''"), "streams")
    spans = repeated_spans(stream, length, KMER, across=True)
    spans = materialize(spans.groupBy(F.col("rid").alias("s_rid"), F.col("tag").alias("s_tag")).agg(F.collect_list(F.struct("pos", "mask")).alias("spans")), "spans")
    parsed = rows.select("page_id", "url", "html", "rid", "tag").mapInArrow(read, f"page_id {kind}, url string, rid long, tag int, kinds binary, body string")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in text_pieces(batches, "body"):
            out, repeated, by_mark = [], [], []
            for kinds, body, found in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                begin = end = np.zeros(0, dtype=np.int64)
                if found:
                    begin, end = intervals(np.array([s["pos"] for s in found]), [s["mask"] for s in found], length)
                at, kept, n, m = 0, [], 0, 0
                for k, t in zip(kinds, body.split("\n"), strict=False):
                    if k == MAIN[0]:
                        kept.append(t)
                        continue
                    size = len(t.encode())
                    lo, hi = np.searchsorted(end, at, side="right"), np.searchsorted(begin, at + size)
                    left, gone = uncovered(t, begin[lo:hi] - at, end[lo:hi] - at, length) if hi > lo else (t, False)
                    at += size + 1
                    n += gone
                    if k == OPEN[0] and left:
                        kept.append(left)
                    elif not gone:
                        m += 1
                out.append(" ".join(kept))
                repeated.append(n), by_mark.append(m)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, type=pa.string()), pa.array(repeated, type=pa.int32()), pa.array(by_mark, type=pa.int32())], names=["page_id", "url", "text", "repeated", "by_mark"])

    both = parsed.join(spans, (F.col("rid") == F.col("s_rid")) & (F.col("tag") == F.col("s_tag")), "left").select("page_id", "url", "kinds", "body", "spans")
    done = both.mapInArrow(texts, f"page_id {kind}, url string, text string, repeated int, by_mark int")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "repeated", "by_mark")
