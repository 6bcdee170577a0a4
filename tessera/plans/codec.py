"""Encoding and decoding of image tables on the Arrow path. Parameters travel with the plan, results with the row: an
image that can't be encoded or a container that can't be decoded is a row with an error, never a failed job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.presets import clamp
from tessera.operators.decode import STREAMS
from tessera.operators.planes import RATIOS
from tessera.plans import kernel
from tessera.plans.tables import slices, spread

CHANNELS = {"rgb": 3, "gray": 1, "rgba": 4, "nrgba": 4}
#: All kinds of image data.
KINDS = {*CHANNELS, "rgba16", *(f"ycbcr{r}" for r in RATIOS)}
QUALITY = 70


def compress(payload: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=7).compress(payload)


def decompress(data: bytes, most: int = 1 << 30) -> bytes:
    """All frames of ``data``, with or without their sizes; at most ``most`` bytes. A frame that ends early is an error."""
    if not data:
        raise kernel.CodecError("no zstd frame")
    out, size, at, one = [], 0, 0, None
    while at < len(data) or one:
        if at >= len(data):
            raise kernel.CodecError("bad zstd frame")
        one = one or zstandard.ZstdDecompressor().decompressobj()
        part = data[at : at + (1 << 14)]
        out.append(one.decompress(part))
        size += len(out[-1])
        if size > most:
            raise kernel.CodecError("payload too large")
        at += len(part)
        if one.eof:
            at, one = at - len(one.unused_data), None
    return b"".join(out)


def planes_of(data: bytes, w: int, h: int, kind: str, bw: bool) -> list[np.ndarray]:
    """The planes of one image, of bytes. kind: rgb, rgba and nrgba (alpha ignored), gray, rgba16 (big-endian straight 16-bit
    samples, premultiplied and cut to 8 bits), or ycbcr and a ratio (whole Y, then Cb and Cr at the ratio)."""
    px = np.frombuffer(data, dtype=np.uint8)
    if w <= 0 or h <= 0:
        raise kernel.CodecError("data don't fit the size")
    if kind.startswith("ycbcr"):
        fx, fy = RATIOS[kind.removeprefix("ycbcr")]
        cw, ch = -(-w // fx), -(-h // fy)
        if len(px) != w * h + 2 * cw * ch:
            raise kernel.CodecError("data don't fit the size")
        out = [px[: w * h].reshape(h, w)]
        for k in range(0 if bw else 2):
            at = w * h + k * cw * ch
            out.append(px[at : at + cw * ch].reshape(ch, cw)[np.arange(h)[:, None] // fy, np.arange(w)[None, :] // fx])
        return out
    if kind == "rgba16":
        if len(px) != w * h * 8:
            raise kernel.CodecError("data don't fit the size")
        wide, cut = px.view(">u2").reshape(h, w, 4), np.empty((h, w, 3), dtype=np.uint8)
        for at in kernel.strips(h, w):
            part = wide[at].astype(np.int64)
            cut[at] = part[..., :3] * part[..., 3:] // 65535 >> 8
        return kernel.planes(cut, bw)
    n = CHANNELS[kind]
    if len(px) != w * h * n:
        raise kernel.CodecError("data don't fit the size")
    px = px.reshape(h, w, n)
    if kind == "gray":
        y = px[..., 0]
        return [y] if bw else [y, np.full_like(y, 128), np.full_like(y, 128)]
    return kernel.planes(px[..., :3], bw)


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def chain(rows: DataFrame, schema: str, *steps: Step) -> DataFrame:
    """``rows`` through the steps, one after the other in the same Python worker: nothing goes back to the JVM in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return spread(rows).mapInArrow(run, schema)


def encoder(quality: int, bw: bool, keep_payload: bool = False) -> Step:
    """The step from images to what ``encode`` returns."""
    q = clamp(quality)
    schema = pa.schema([("img_id", pa.int64()), ("w", pa.int32()), ("h", pa.int32()), ("quality", pa.int32()), ("bw", pa.bool_()), ("raw_size", pa.int64()), ("payload", pa.binary()), ("compressed", pa.binary()), ("error", pa.string())])

    def row(pack: Callable[[bytes], bytes], img: int, w: int, h: int, kind: str, data: pa.Buffer) -> tuple:
        payload, error = None, None
        try:
            if data is None or w is None or h is None or kind not in KINDS:
                raise kernel.CodecError("no image")
            payload = kernel.encode(planes_of(data, w, h, kind, bw), q)
        except kernel.CodecError as e:
            error = str(e)
        return img, w, h, q, bw, len(payload) if payload else None, payload if keep_payload else None, pack(payload) if payload else None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=7).compress
        for batch in slices(batches):
            out: dict[str, list] = {n: [] for n in schema.names}
            # the data stay where they are
            views = (d.as_buffer() if d.is_valid else None for d in batch.column(4))
            for img, w, h, kind, data in zip(*(c.to_pylist() for c in batch.columns[:4]), views, strict=True):
                for n, v in zip(schema.names, row(pack, img, w, h, kind, data), strict=True):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


ENCODED = "img_id long, w int, h int, quality int, bw boolean, raw_size long, payload binary, compressed binary, error string"


def encode(images: DataFrame, quality: int = QUALITY, bw: bool = False, keep_payload: bool = False) -> DataFrame:
    """(img_id, w, h, quality, bw, raw_size, payload, compressed, error) of images (img_id, w, h, kind, data).

    payload is null unless ``keep_payload``. Null fields and sizes that don't fit the data give an error row.
    """
    images = images.select(F.col("img_id").cast("long"), F.col("w").cast("int"), F.col("h").cast("int"), "kind", "data")
    return chain(images, ENCODED, encoder(quality, bw, keep_payload))


def decode(encoded: DataFrame, postfilter: bool = False) -> DataFrame:
    """(img_id, w, h, data, error) of containers (img_id, compressed): data are RGB bytes in raster order."""
    schema = pa.schema([("img_id", pa.int64()), ("w", pa.int32()), ("h", pa.int32()), ("data", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {n: [] for n in schema.names}
            for img, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (img, None, None, None, "no data")
                if data is not None:
                    try:
                        rgb = kernel.decode(decompress(data), postfilter)
                        row = (img, rgb.shape[1], rgb.shape[0], rgb.tobytes(), None)
                    except (kernel.CodecError, zstandard.ZstdError) as e:
                        row = (img, None, None, None, str(e) if isinstance(e, kernel.CodecError) else "bad zstd frame")
                for n, v in zip(schema.names, row, strict=True):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return spread(encoded.select(F.col("img_id").cast("long"), "compressed")).mapInArrow(run, "img_id long, w int, h int, data binary, error string")


SUMS = "img_id long, n long, total long, weighted long"


def sums_of(v: np.ndarray) -> tuple[int, int, int]:
    """Of the values of a plane (y, x): how many, their sum, and their sum by v * (x + 1) * (y % 1000 + 1)."""
    lines = v.astype(np.int64)
    h, w = lines.shape
    return v.size, int(lines.sum()), int((lines @ np.arange(1, w + 1)) @ (np.arange(h) % 1000 + 1))


def sum_rows(rows: list[tuple[int, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["img_id", "n", "total", "weighted"])


def plane_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The step from what ``encode`` returns to SUMS: containers are parsed and decoded, and what their blocks cover is summed over
    the stored planes. What can't be encoded or decoded, or has no block, is left out."""
    for batch in batches:
        out: list[tuple[int, ...]] = []
        for img, data in zip(batch.column("img_id").to_pylist(), batch.column("compressed").to_pylist(), strict=True):
            try:
                head, chans = kernel.split(decompress(data or b""))
                w4, h4, _, _ = kernel.layout(head["w"], head["h"], head["small"], head["macro"])
                each = [sums_of(kernel.decode_plane(s, head, 0)[:h4, :w4]) for s in chans.values()]
            except (kernel.CodecError, zstandard.ZstdError):
                continue
            if w4 and h4:
                out.append((img, *map(sum, zip(*each, strict=True))))
        yield sum_rows(out)


def filtered_sums(small: int) -> Step:
    """The step from gray images to SUMS of their pixels after the post-filter; pictures of one width are filtered together.
    Images without pixels are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
            for img, w, h, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data:
                    by_width.setdefault(w, []).append((img, planes_of(data, w, h, kind, True)[0].astype(np.uint8)))
            out = []
            for found in by_width.values():
                heights = np.array([len(v) for _, v in found])
                stack = kernel.deblocked(np.concatenate([v for _, v in found])[..., None], small, heights)[..., 0]
                ends = np.cumsum(heights)
                out += [(img, *sums_of(stack[to - n : to])) for (img, _), n, to in zip(found, heights, ends, strict=True)]
            yield sum_rows(out)

    return run


def parse(payloads: DataFrame) -> DataFrame:
    """(img_id, w, h, small, macro, error, segments) of (img_id, payload): the header and the streams of each stored channel.

    segments: array of (ch, block_count, size, type, pattern, fg, bg), null where error says what stands against decoding:
    the header, a segment's length, or streams that don't fit each other. Bytes after the last segment are ignored.
    """
    fields = [pa.field("ch", pa.int32()), pa.field("block_count", pa.int64()), *(pa.field(n, pa.binary()) for n in STREAMS)]
    schema = pa.schema([("img_id", pa.int64()), *((n, pa.int32()) for n in ("w", "h", "small", "macro")), ("error", pa.string()), ("segments", pa.list_(pa.struct(fields)))])
    streams = ",".join(f"{n}:binary" for n in STREAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {n: [] for n in schema.names}
            for img, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head, found, error = {}, None, None
                try:
                    head, chans = kernel.split(data or b"")
                    for s in chans.values():
                        kernel.verify(s, head)
                    found = [{"ch": ch, "block_count": s["count"], **{n: s[n].tobytes() for n in STREAMS}} for ch, s in chans.items()]
                except kernel.CodecError as e:
                    error = str(e)
                for n, v in zip(schema.names, (img, *(head.get(n) for n in ("w", "h", "small", "macro")), error, found), strict=True):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    rows = payloads.select(F.col("img_id").cast("long"), "payload")
    return rows.mapInArrow(run, f"img_id long, w int, h int, small int, macro int, error string, segments array<struct<ch:int,block_count:bigint,{streams}>>")


def streams_of(parsed: DataFrame) -> DataFrame:
    """A row a stored channel of the payloads without error: what ``operators.decode.blocks_of`` reads."""
    head = ["img_id", "w", "h", "small", "macro"]
    return parsed.where("error is null").select(*head, F.explode("segments").alias("s")).select(*head, "s.*")


def compressed(payload: Column) -> Column:
    """A binary column as zstd frames; null stays null."""

    @F.pandas_udf("binary")
    def zstd(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else compress(bytes(b)))

    return zstd(payload)


def ratio(out_size: Column, in_size: Column) -> Column:
    return out_size.cast("double") / in_size


def size_text(size: Column) -> Column:
    """Below 1 MiB in KB, else in MB, with two decimals."""
    text = lambda unit, name: F.format_string(f"%.2f {name}", F.bround(size / unit, 2))
    return F.when(size < 1 << 20, text(1 << 10, "KB")).otherwise(text(1 << 20, "MB"))


def report(encoded: DataFrame, original: DataFrame) -> DataFrame:
    """(img_id, in_size, out_size, ratio, size_text) of the pictures that were encoded; original has img_id and in_size."""
    o = original.select(F.col("img_id").alias("o_img"), "in_size")
    e = encoded.where("compressed is not null").select("img_id", F.length("compressed").cast("long").alias("out_size"))
    return e.join(o, F.col("img_id") == F.col("o_img")).select("img_id", "in_size", "out_size", ratio(F.col("out_size"), F.col("in_size")).alias("ratio"), size_text(F.col("out_size")).alias("size_text"))


def register(spark: SparkSession) -> None:
    """The codec for SQL: zstd_compress, zstd_decompress, codec_encode(data, w, h, kind, quality, bw), codec_decode(container, postfilter), and the table function codec_segments(payload)."""
    from pyspark.sql.functions import pandas_udf, udtf

    @pandas_udf("binary")
    def zstd_compress(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else compress(bytes(b)))

    @pandas_udf("binary")
    def zstd_decompress(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else decompress(bytes(b)))

    @pandas_udf("binary")
    def codec_encode(data: pd.Series, w: pd.Series, h: pd.Series, kind: pd.Series, quality: pd.Series, bw: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else compress(kernel.encode(planes_of(bytes(d), int(a), int(b), k, bool(g)), int(q))) for d, a, b, k, q, g in zip(data, w, h, kind, quality, bw, strict=True)])

    @pandas_udf("w int, h int, data binary")
    def codec_decode(data: pd.Series, postfilter: pd.Series) -> pd.DataFrame:
        got = [kernel.decode(decompress(bytes(d)), bool(p)) for d, p in zip(data, postfilter, strict=True)]
        return pd.DataFrame({"w": [g.shape[1] for g in got], "h": [g.shape[0] for g in got], "data": [g.tobytes() for g in got]})

    @udtf(returnType="ch int, block_count long, size_b binary, type_b binary, pattern_b binary, fg_b binary, bg_b binary")
    class Segments:
        def eval(self, payload: bytes):
            for ch, s in kernel.split(bytes(payload))[1].items():
                yield ch, s["count"], *(s[n].tobytes() for n in STREAMS)

    for name, f in (("zstd_compress", zstd_compress), ("zstd_decompress", zstd_decompress), ("codec_encode", codec_encode), ("codec_decode", codec_decode)):
        spark.udf.register(name, f)
    spark.udtf.register("codec_segments", Segments)
