"""Pixel relations: generated images, and tables read as images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, w: int, h: int) -> DataFrame:
    i = F.col("id")
    return spark.range(w * h).select(F.lit(0).cast("long").alias("img_id"), (i % w).cast("int").alias("x"), F.floor(i / w).cast("int").alias("y"))


def synthetic(spark: SparkSession, w: int = 64, h: int = 48) -> DataFrame:
    """The test picture: R = 17x xor 31y, G = 43x + 13y, B = 7x xor 11y, mod 256."""
    x, y = F.col("x"), F.col("y")
    return grid(spark, w, h).select("img_id", "x", "y", (x * 17).bitwiseXOR(y * 31).bitwiseAND(255).alias("r"), (x * 43 + y * 13).bitwiseAND(255).alias("g"), (x * 7).bitwiseXOR(y * 11).bitwiseAND(255).alias("b"))


def smooth(spark: SparkSession, w: int = 64, h: int = 48) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return grid(spark, w, h).select("img_id", "x", "y", (x * 2 + y).bitwiseAND(255).alias("r"), (x + y * 2).bitwiseAND(255).alias("g"), (x + y).bitwiseAND(255).alias("b"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as one picture, 100 wide."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    byte = lambda c: c.cast("long").bitwiseAND(255).cast("int")
    return e.select(F.lit(0).cast("long").alias("img_id"), (F.col("event_id") % 100).cast("int").alias("x"), F.floor(F.col("event_id") / 100).cast("int").alias("y"), byte(F.floor("value")).alias("r"), byte(F.col("user_id")).alias("g"), byte(F.second("ts")).alias("b"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as one gray picture: a vector a row."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return e.select(F.lit(0).cast("long").alias("img_id"), "x", "y", F.floor((F.col("e").cast("double") + 1) * 127.5).cast("int").alias("v"))


def documents(spark: SparkSession, sf_dir: str, width: int = 32) -> DataFrame:
    """Each text as a gray picture of its code points; the last row is filled up with zeros."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 0").withColumn("n", (F.ceil(F.length("text") / width) * width).cast("int"))
    d = d.select(F.col("doc_id").alias("img_id"), F.posexplode(F.split(F.rpad("text", F.col("n"), F.lit("\0")), "")).alias("i", "c"))
    return d.select("img_id", (F.col("i") % width).cast("int").alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), F.ascii("c").bitwiseAND(255).alias("v"))
