"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one Arrow batch are handed to Python code in pieces of about this many characters,
#: so that temporary arrays stay small whatever the batch holds.
PIECE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: those of long texts would else take more memory than a task has.
BATCH_ROWS = 1_000


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches of at most BATCH_ROWS rows. The engine has one such setting for a
    session; it is lowered here, which changes no result."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        hand_back()

    return df.mapInArrow(run, schema)


def hand_back() -> None:
    """Give memory that a task has freed back to the system: workers stay for the next tasks, beside
    those of other cores and the executor's JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str | StructType, rows: int | None = None
) -> DataFrame:
    """``fn`` over every Arrow batch of ``df``, or over its slices of ``rows`` rows; ``fn`` may
    return None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), rows or max(1, len(whole))):
                out = fn(whole.slice(at, rows) if rows else whole)
                if out is None:
                    continue
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield out

    return map_arrow(df, run, schema)


def pieces(texts: list[str | None], chars: int = PIECE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` holding about ``chars`` characters each (one text at least)."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def column_pieces(column: pa.Array, chars: int = PIECE_CHARS) -> Iterator[tuple[int, int]]:
    """As ``pieces``, of an Arrow column of texts by their bytes, without making Python texts."""
    size = np.asarray(pc.binary_length(column).fill_null(0), np.int64)
    start, total = 0, np.cumsum(size)
    while start < len(size):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + chars, side="right")))
        yield start, stop
        start = stop


def fresh(df: DataFrame, name: str) -> str:
    """A name for a column of our own that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``. Only a session on one
    machine may leave that unset; its warehouse serves."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def gone_at_exit(spark: SparkSession, folder: str) -> None:
    """Remove a written folder when the session's JVM ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def materialize(df: DataFrame, name: str, keep_shuffles: bool = True) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder. Shuffle files of the write go with it
    unless they are kept (until the driver collects garbage)."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(setting)
    if not keep_shuffles:
        spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, old)
    gone_at_exit(spark, path)
    return spark.read.parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Remove the files of a frame that ``materialize`` wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {re.sub(r"(/\w+=[^/]*)*/[^/]*$", "", f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(m)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, also inside lambda functions."""
    return F.element_at(F.transform(F.array(value), use), 1)
