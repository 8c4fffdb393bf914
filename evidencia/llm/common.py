"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from contextlib import suppress

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, shared_folder, stored  # noqa: F401  used by the operators

#: Rows handed to a Python worker at once; texts may be long, so batches stay small.
BATCH_ROWS = 1000
#: Bytes handed over at once, so that rows with long texts or sets come in fewer.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, schema.field(n).type) for n, c in ((n, columns[n]) for n in schema.names)], schema=schema)


def release() -> None:
    """Gives unused memory back to the system, which workers that wait for their next task would keep else."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(work):
    """``work`` on batches, for mapInArrow(), which gives back unused memory as it goes and at its end."""

    def run(batches):
        def fed():
            for n, b in enumerate(batches, 1):
                yield b
                if n % 16 == 0:
                    release()

        yield from work(fed())
        release()

    return run


def row_base() -> int:
    """First id of a range that only this partition uses; the same again when the task is run again."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 40


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; rows without an id count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)
