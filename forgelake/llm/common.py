"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from forgelake.session import RUNTIME_CONF, name_local_folder

# Rows and bytes an Arrow batch holds at most, and rows that are read at once, so that a batch of long texts stays small.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session, and let a local one
    without a shared folder have its own."""
    for key, value in {**RUNTIME_CONF, **BATCH_CONF}.items():
        spark.conf.set(key, value)
    return name_local_folder(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the system: a worker serves the stages that follow, whose own memory comes on top."""
    pa.default_memory_pool().release_unused()
    # Part of the GNU library only.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]], schema: str | T.StructType
) -> DataFrame:
    """``mapInArrow`` for a function that takes record batches and yields columns as lists.

    Arrow instead of pandas, because a NULL among integers would turn them into floats.
    """
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        for columns in function(batches):
            arrays = [
                columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
                for f in arrow
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        give_back()

    return df.mapInArrow(run, struct)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def type_of(df: DataFrame, name: str) -> T.DataType:
    return next(f.dataType for f in df.schema.fields if f.name == name)


def free_name(base: str, taken: list[str]) -> str:
    """A column name that is not taken, whatever the case."""
    lower = {c.lower() for c in taken}
    while base.lower() in lower:
        base = "_" + base
    return base


def row_salt(buckets: int, seed: int = 0) -> Column:
    """A bucket per row that does not follow any column, so that no hot value fills one.

    Built from the position of the row in its scan: the same when a task is run again.
    """
    return F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(buckets))
