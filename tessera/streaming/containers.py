"""Files that arrive are encoded or decoded as they come: each is whole in itself, so the stream keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.codec import QUALITY, decode, encode


def container_stream(spark: SparkSession, path: str, glob: str = "*", files_a_batch: int = 1000) -> DataFrame:
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch).load(path)
    return s.select(F.xxhash64("path").alias("img_id"), F.col("path").alias("origin"), F.col("content").alias("compressed"))


def image_table_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """Tables of images (img_id, w, h, kind, data) written as Parquet files."""
    return spark.readStream.schema("img_id long, w int, h int, kind string, data binary").option("maxFilesPerTrigger", files_a_batch).parquet(path)


def start(result: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    return result.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def encode_stream(images: DataFrame, to: str, checkpoint: str, quality: int = QUALITY, bw: bool = False) -> StreamingQuery:
    return start(encode(images, quality, bw), to, checkpoint)


def decode_stream(containers: DataFrame, to: str, checkpoint: str, postfilter: bool = False) -> StreamingQuery:
    return start(decode(containers, postfilter), to, checkpoint)
