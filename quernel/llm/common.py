"""What the operators share: tables in the shared folder, worker paths and views of Arrow text."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A word: a run of code points that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"
ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, keeps Arrow batches small, and sees to a shared folder.

    The folder is the one the session names in spark.checkpoint.dir. Where it names none, a
    temporary one is made if the session runs on one machine; a cluster's has to be named.
    """
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, path]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark


def shared(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{ready(spark).sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A copy as a table in the shared folder, without lineage.

    Unlike a checkpoint it is compressed and keeps no constraints, which grow with each join of a
    loop. `drop` removes it; a table that a result still reads stays for as long as the folder does.
    """
    path = shared(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Removes the tables of `cut` that no plan reads any more."""
    for df in frames:
        if path := getattr(df, "cut_path", None):
            there = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def byte_chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Views (first row, row after the last, bytes, offsets) of about `most` bytes; null counts as empty.

    A text longer than `most` is a chunk of its own, so memory is bounded by the longest text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(rows):
        return
    buffers = rows.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that are over: it does so when both collectors have run."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
