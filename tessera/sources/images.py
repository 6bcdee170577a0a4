"""Image and container files as tables, and tables as files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.plans.tables import slices


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(img_id, origin, w, h, kind, data) of picture files; Spark's reader gives blue first, which ``to_rgb`` turns round.

    A file that isn't a picture is a row without size, kind and data, which ``encode`` makes an error row.
    """
    i = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    good = F.col("width") > 0
    kind = F.when(F.col("nChannels") == 1, "gray").when(F.col("nChannels") == 4, "nrgba").otherwise("rgb")
    rows = i.select(F.xxhash64("origin").alias("img_id"), "origin", *(F.when(good, c).alias(n) for n, c in (("w", F.col("width")), ("h", F.col("height")), ("kind", kind), ("data", F.col("data")))))
    return to_rgb(rows)


def to_rgb(images: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            out = []
            for kind, data in zip(batch.column(at("kind")).to_pylist(), batch.column(at("data")).to_pylist(), strict=True):
                if data is None:
                    out.append(None)
                    continue
                n = {"gray": 1, "rgb": 3}.get(kind, 4)
                px = np.frombuffer(data, dtype=np.uint8).reshape(-1, n)
                out.append((px if n == 1 else px[:, [2, 1, 0, *range(3, n)]]).tobytes())
            yield batch.set_column(at("data"), "data", pa.array(out, type=pa.binary()))

    return images.mapInArrow(run, images.schema)


def read_containers(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(img_id, origin, compressed) of container files."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return f.select(F.xxhash64("path").alias("img_id"), F.col("path").alias("origin"), F.col("content").alias("compressed"))


def png(pixels: np.ndarray) -> bytes:
    """PNG bytes of (h, w) gray or (h, w, 3) RGB bytes."""
    h, w = pixels.shape[:2]

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    rows = pixels.reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), dtype=np.uint8), rows.astype(np.uint8)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_files(table: DataFrame, folder: str, name_col: str, data_col: str) -> None:
    """A file for each row, by the tasks, into ``folder`` (a path or URI that all executors reach)."""

    def run(rows: Iterable[Row]) -> None:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        files.create_dir(base, recursive=True)
        for r in rows:
            # written aside and moved, so a task that runs again leaves a whole file
            at, part = f"{base}/{r[0]}", f"{base}/.{r[0]}.part"
            with files.open_output_stream(part) as f:
                f.write(bytes(r[1]))
            files.move(part, at)

    table.select(name_col, data_col).where(F.col(data_col).isNotNull()).foreachPartition(run)


def with_png(decoded: DataFrame) -> DataFrame:
    """Adds png to decoded images (w, h, data): null where there is no image."""
    return decoded.withColumn("png", _png("w", "h", "data"))


def write_png(decoded: DataFrame, folder: str) -> None:
    """Decoded images (img_id, w, h, data) as ``<img_id>.png``."""
    write_files(with_png(decoded).select(F.concat(F.col("img_id").cast("string"), F.lit(".png")).alias("name"), "png"), folder, "name", "png")


def write_split(decoded: DataFrame, folder: str) -> None:
    """Three gray pictures an image, ``_Y``, ``_Cb``, ``_Cr`` by the JFIF conversion, named by ``name`` if there is such a column, else by img_id."""
    base = F.col("name") if "name" in decoded.columns else F.col("img_id").cast("string")
    for k, name in enumerate(("Y", "Cb", "Cr")):
        write_files(decoded.select(F.concat(base, F.lit(f"_{name}.png")).alias("name"), _png("w", "h", "data", k).alias("png")), folder, "name", "png")


def jfif(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    half, mid = 1 << 15, 257 << 15
    out = np.stack([19595 * r + 38470 * g + 7471 * b + half, -11056 * r - 21712 * g + 32768 * b + mid, 32768 * r - 27440 * g - 5328 * b + mid], axis=-1) >> 16
    return np.clip(out, 0, 255).astype(np.uint8)


def _png(w: str, h: str, data: str, channel: int | None = None):
    @F.pandas_udf("binary")
    def f(w: pd.Series, h: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for a, b, d in zip(w, h, data, strict=True):
            if d is None:
                out.append(None)
                continue
            a, b = int(a), int(b)
            rgb = np.frombuffer(bytes(d), dtype=np.uint8).reshape(b, a, 3)
            out.append(png(rgb if channel is None else jfif(rgb)[..., channel]))
        return pd.Series(out)

    return f(F.col(w), F.col(h), F.col(data))


def images_of(pixels: DataFrame, kind: str | None = None) -> DataFrame:
    """(img_id, w, h, kind, data) of a pixel relation with r, g, b (and a for the kinds rgba and nrgba) or v: the way from rows to arrays, an image a group."""
    cols = ("v",) if "r" not in pixels.columns else ("r", "g", "b", "a") if kind in ("rgba", "nrgba") else ("r", "g", "b")
    kind = kind or ("rgb" if len(cols) == 3 else "gray")
    # rows of pixels become strings of hex first, so an image's group holds a row a line
    line = pixels.groupBy("img_id", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", *cols))), lambda e: F.concat(*(F.lpad(F.hex(e[c]), 2, "0") for c in cols))), "").alias("line"), F.count(F.lit(1)).alias("n"))
    img = line.groupBy("img_id").agg(F.max("n").cast("int").alias("w"), F.count(F.lit(1)).cast("int").alias("h"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "line"))), lambda e: e["line"]), "").alias("hex"))
    return img.select("img_id", "w", "h", F.lit(kind).alias("kind"), F.unhex("hex").alias("data"))


def text_images(batches: Iterator[pa.RecordBatch], width: int = 32) -> Iterator[pa.RecordBatch]:
    """Images (img_id, w, h, kind, data) of rows (id, text): code points as gray pixels, the last row filled up with zeros."""
    schema = pa.schema([("img_id", pa.int64()), ("w", pa.int32()), ("h", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])
    for batch in slices(batches):
        out = {"img_id": batch.column(0).to_pylist(), "w": [], "h": [], "kind": [], "data": []}
        for t in batch.column(1).to_pylist():
            code = np.frombuffer((t or "").encode("utf-32-le"), dtype=np.uint32)
            h = -(-len(code) // width)
            pixels = np.zeros(h * width, dtype=np.uint8)
            pixels[: len(code)] = code & 255
            for n, v in (("w", width), ("h", h), ("kind", "gray"), ("data", pixels.tobytes())):
                out[n].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``text_images`` reads."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("img_id"), "text")


def images_of_documents(spark: SparkSession, sf_dir: str, width: int = 32) -> DataFrame:
    """Each text as a gray picture of its code points, the last row filled up with zeros, without pixel rows."""
    return documents_of(spark, sf_dir).mapInArrow(lambda batches: text_images(batches, width), "img_id long, w int, h int, kind string, data binary")
