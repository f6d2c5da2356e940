"""Helpers that several operators use: durable intermediate tables and Arrow text access."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: White space of the word rule `[^\x20\x09-\x0D]+`, as used by Java and Python patterns alike.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, on one machine as in tests) a fresh one."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="lexloom-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


PART_ROWS = 1 << 10
#: Rows and bytes in an Arrow batch between Spark and Python: both sides hold several.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Settings for a session that works on long texts. The queries and the pipeline make them; operators leave settings alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8_rows(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def byte_parts(batch: pa.RecordBatch, column: int, budget: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `budget` bytes of this column (texts or binary); one longer value stands alone."""
    for start, stop in slices(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), budget):
        yield batch.slice(start, stop - start)


def give_back() -> None:
    """Return freed memory to the system at a task's end: Spark reuses its Python workers, and other stages need the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not among columns, in any case of letters."""
    known = {c.lower() for c in columns}
    while name.lower() in known:
        name += "_"
    return name


def slices(sizes: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Row ranges [start, stop) of about `budget` units each (and at most PART_ROWS rows); one larger row stands alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > budget or i - start >= PART_ROWS):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
