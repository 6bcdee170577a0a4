"""python -m tessera PICTURES [quality] [bw] [decoded.png] [-out DIR]   encode picture files (a path, folder or glob) to containers
python -m tessera CONTAINERS.btc [-postfilter] [-split] [-out DIR]   decode container files to PNG

What ends in .btc is a container (or say -decode). Files are named after their source and, without -out, written beside it."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.plans.codec import QUALITY, decode, encode, ratio, report, size_text
from tessera.plans.tables import materialize
from tessera.sources.images import read_containers, read_images, with_png, write_files, write_split

CONTAINER = ".btc"


def quality(text: str) -> int:
    q = int(text)
    if not 0 <= q <= 100:
        raise argparse.ArgumentTypeError("quality is 0 to 100")
    return q


def option(text: str) -> str:
    if text != "bw" and not text.lower().endswith(".png"):
        raise argparse.ArgumentTypeError("bw or a name that ends in .png")
    return text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("path")
    p.add_argument("quality", nargs="?", type=quality, default=QUALITY, help="0 to 100")
    p.add_argument("options", nargs="*", type=option, metavar="bw|decoded.png", help="gray; decode what was encoded to this file")
    p.add_argument("-decode", action="store_true")
    p.add_argument("-postfilter", action="store_true")
    p.add_argument("-split", action="store_true")
    p.add_argument("-out")
    return p


def named(end: str) -> Column:
    """The source's file name with another ending."""
    return F.concat(F.regexp_replace(F.regexp_extract("origin", r"([^/]*)$", 1), r"\.[^.]*$", ""), F.lit(end))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    last = a.path.rstrip("/").rpartition("/")
    out = a.out or ((last[0] or ("/" if last[1] else ".")) if "." in last[2] or "*" in last[2] else a.path)
    if a.decode or a.path.lower().endswith(CONTAINER):
        found = materialize(read_containers(spark, a.path), "containers")
        images = materialize(decode(found.select("img_id", "compressed"), a.postfilter).join(found.select(F.col("img_id").alias("f_id"), "origin", F.length("compressed").cast("long").alias("in_size")), F.col("img_id") == F.col("f_id")), "images")
        if a.split:
            write_split(images.withColumn("name", named("")), out)
            return
        png = materialize(with_png(images).select("origin", "in_size", "png", "error"), "png")
        write_files(png.select(named(".png").alias("name"), "png"), out, "name", "png")
        size = F.length("png").cast("long")
        png.select("origin", ratio(size, F.col("in_size")).alias("ratio"), size_text(size).alias("size"), "error").show(truncate=False)
        return
    images = materialize(read_images(spark, a.path), "images")
    encoded = materialize(encode(images, a.quality, "bw" in a.options), "encoded")
    files = encoded.join(images.select(F.col("img_id").alias("f_id"), "origin"), F.col("img_id") == F.col("f_id"))
    write_files(files.select(named(CONTAINER).alias("name"), "compressed"), out, "name", "compressed")
    report(encoded, images.select("img_id", F.length("data").alias("in_size"))).show(truncate=False)
    files.where("error is not null").select("origin", "error").show(truncate=False)
    for name in (o for o in a.options if o != "bw"):
        folder, _, file = name.rpartition("/")
        write_files(with_png(decode(encoded)).select(F.lit(file).alias("name"), "png"), folder or ".", "name", "png")


if __name__ == "__main__":
    main()
