"""Hashing in committed batches, so that an interrupted run does not start over.

Each batch is appended to a staging table by one Spark job.  A rerun skips what
is staged for the same path, size and times; a file that changed in between no
longer matches its staged row and is hashed again.
"""

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import div
from ..operators.chunks import tree_digest
from ..sources.content import (
    CHUNK_BYTES,
    CHUNK_KEY,
    FILE_KEY,
    file_chunks,
    hash_chunks,
    hash_files,
    task_count,
)
from ..sources.scratch import delete_folder, fresh_folder, materialise

BATCH_BYTES_PER_CORE = 16 << 30
BATCH_ROWS_PER_CORE = 4  # so that large files do not make batches too few to go round


def _staged(due: DataFrame, folder: str, key: tuple, digest: str) -> DataFrame:
    """Rows of the staging table that still describe a due file or chunk."""
    schema = due.select(*key, F.lit(None).cast("binary").alias(digest), F.lit("").alias("error")).schema
    try:
        staged = due.sparkSession.read.schema(schema).parquet(folder).drop("batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return due.sparkSession.createDataFrame([], schema)
    return staged.join(due.select(*key), list(key), "left_semi")


def _hash_in_batches(
    due: DataFrame,
    folder: str,
    key: tuple,
    digest: str,
    weight: str,
    hash_rows: Callable,
    batch_bytes: int | None,
) -> tuple[DataFrame, DataFrame]:
    """Hash the due rows that are not staged yet; returns (done, failed)."""
    spark = due.sparkSession
    total = due.agg(F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("bytes")).first()
    cores = spark.sparkContext.defaultParallelism
    by_bytes = (total.bytes or 0) // (batch_bytes or BATCH_BYTES_PER_CORE * cores) + 1
    batches = max(1, min(by_bytes, total.rows // (BATCH_ROWS_PER_CORE * cores)))
    tasks = task_count(total.rows // batches, (total.bytes or 0) // batches, cores)
    known = _staged(due, folder, key, digest).where(F.col(digest).isNotNull())
    hashed_key = F.xxhash64(*key)
    todo = due.join(known, list(key), "left_anti").select(
        *key, F.pmod(hashed_key, F.lit(batches)).alias("batch")
    )
    work = fresh_folder(spark)
    if batches > 1:  # one folder per batch, so that each batch reads only its rows
        todo = todo.repartition("batch", F.pmod(F.shiftright(hashed_key, 32), F.lit(8)))
        todo = materialise(todo, work, ["batch"])

    def run(number: int) -> None:
        part = todo.where(F.col("batch") == number).drop("batch")
        hash_rows(part, tasks).write.parquet(f"{folder}/batch={uuid.uuid4().hex}")

    # Two batches at a time: while one waits for its largest file, the other goes on.
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(inheritable_thread_target(spark)(run), range(batches)))
    delete_folder(spark, work)
    staged = _staged(due, folder, key, digest)
    done = staged.where(F.col(digest).isNotNull())
    failed = staged.where(F.col(digest).isNull()).select(*key, "error")
    if failed.isEmpty():
        failed = spark.createDataFrame([], failed.schema)
    else:
        failed = failed.join(done, list(key), "left_anti").groupBy(*key).agg(F.max("error").alias("error"))
    return done.select(*key, digest), failed


def hash_due_files(
    due: DataFrame, root: str, folder: str, batch_bytes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """sha512 of the due files, staged in ``folder``: (done, failed)."""

    def run(part, tasks):
        return hash_files(part, root, tasks)

    return _hash_in_batches(due, folder, FILE_KEY, "sha512", "size", run, batch_bytes)


def hash_due_chunks(
    files: DataFrame,
    root: str,
    ledger: str,
    chunk_bytes: int = CHUNK_BYTES,
    batch_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """tree_sha512 of the files through the chunk ledger table: (digests, failed chunks).

    A file with a failed chunk gets a NULL digest.
    """

    def run(part, tasks):
        return hash_chunks(part, root, tasks)

    chunks = file_chunks(files, chunk_bytes)
    done, failed = _hash_in_batches(
        chunks, ledger, CHUNK_KEY, "chunk_sha512", "chunk_len", run, batch_bytes
    )
    of = F.greatest(div(F.col("size") + chunk_bytes - 1, chunk_bytes), F.lit(1))
    parts = done.select(*FILE_KEY, "chunk_no", F.col("chunk_sha512").alias("digest"), of.alias("chunks"))
    largest = files.agg(F.max("size")).first()[0] or 0
    digests = tree_digest(parts, FILE_KEY, max(1, -(-largest // chunk_bytes)))
    known = files.select(*FILE_KEY).join(digests, list(FILE_KEY), "left")
    return known.withColumnRenamed("tree_digest", "tree_sha512"), failed
