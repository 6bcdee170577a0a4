"""Written tables: where a plan would otherwise be computed several times, or its lineage grow."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a fresh folder of this machine serves a session in one process; a cluster uses its warehouse.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        unset = tempfile.mkdtemp(prefix="tessera-") if own else f"{spark.conf.get('spark.sql.warehouse.dir')}/tessera-{uuid.uuid4().hex}"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or unset)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is read from fewer files than there are: for work that outweighs its bytes.

    The files are those of the plan: nothing runs to count them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or len(df.inputFiles()) >= cores else df.repartition(cores)


#: Rows of images or texts that Python handles at once, and their bytes; a single larger one is handled alone.
SLICE_ROWS, SLICE_BYTES = 64, 1 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Fewer rows at once, as views: results leave before the next are made."""
    for batch in batches:
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for c in batch.columns:
            if any(is_kind(c.type) for is_kind in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            to = min(max(full, at + 1), at + rows)
            yield batch.slice(at, to - at)
            at = to


def release(spark: SparkSession) -> None:
    """Delete the tables that this process wrote. Results that still read them must have been written or collected."""
    jvm = spark.sparkContext._jvm
    for path in _written:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.clear()
