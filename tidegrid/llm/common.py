"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.session import shared_folder

#: Text bytes handled at once inside a task; a longer text is handled alone.
SLICE_BYTES = 4 << 20
#: The same where every byte takes some seventy bytes of arrays for a moment.
SMALL_SLICE = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, nothing is computed twice.

    Spark frees the shuffle files of finished jobs when the driver collects garbage; asking for
    that here keeps one step's shuffle on disk, not those of all steps.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads again; what was made of them has to be staged itself."""
    for table in tables:
        session = table.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = session._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(session._jsc.sc().hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column and the places between them; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, places, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64)[column.offset: column.offset + len(column) + 1]
    held = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return held[offsets[0]: offsets[-1]], offsets - offsets[0]


def byte_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` text bytes each, so that task memory is bounded by that or one text."""
    offsets = text_buffer(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def small_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """All batches in small slices; at the end the task gives its pooled memory back."""
    for batch in batches:
        yield from byte_slices(batch, column, SMALL_SLICE)
    pa.default_memory_pool().release_unused()
