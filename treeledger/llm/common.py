"""Helpers that the text operators share."""

import ctypes
import sys
from collections.abc import Sequence
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.sources.scratch import fresh_folder, materialise

__all__ = [
    "fold", "free_name", "materialise", "offsets", "ordered_table", "process_cache", "release_memory", "table", "written"
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, so that a lost executor costs a reread and no rerun."""
    return materialise(df, fresh_folder(df.sparkSession))


def fold(key: str | Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the key's text; NULL for a NULL key."""
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that no column of ``df`` has in any case."""
    taken = {name.lower() for name in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def ordered_table(df: DataFrame, order: Sequence[str], part: str) -> DataFrame:
    """``df`` range-partitioned by ``order`` and written, with the number of its range in ``part``.

    Rows of a range precede all rows of the next one, so that a running sum needs one total per range.
    """
    ranged = df.repartitionByRange(*[F.col(name).asc_nulls_last() for name in order])
    return written(ranged.withColumn(part, F.spark_partition_id()))


def offsets(totals: DataFrame, part: str, amount: str) -> DataFrame:
    """From one total per range (as many rows as ranges): what all earlier ranges hold together."""
    running, rows = 0, []
    for row in sorted(totals.select(part, amount).collect(), key=lambda r: r[0]):
        rows.append((row[0], running))
        running += row[1] or 0
    return totals.sparkSession.createDataFrame(rows, f"{part} int, base long")


def process_cache() -> dict:
    """What a Python worker process keeps from one task to the next, for things that cost much to open.

    A module of its own holds it: globals of functions that are shipped by value are new in every task.
    """
    keeper = sys.modules.setdefault("_treeledger_process_cache", ModuleType("_treeledger_process_cache"))
    return keeper.__dict__.setdefault("kept", {})


def release_memory() -> None:
    """Give what this worker process has freed back to the system.

    Worker processes outlive their tasks; what they keep for reuse is missing beside them.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # where the C library has it
        trim(0)
