"""Reading file content on the executors: whole-file digests and chunk digests.

``sha512`` is sequential, so one file is one unit of work and an interrupted run
resumes at the next unhashed file.  ``hash_chunks`` cuts files into fixed-size
chunks that are hashed independently: a file holding a large part of all bytes
is shared out, and an interrupted run resumes inside it.  The two digests are
different values and are kept in different columns.
"""

import errno
import hashlib
import heapq
import os
import stat

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import div
from .tree import even_tasks, in_batches, mounted_root, root_identity

BLOCK = 1024 * 1024
BYTES_PER_TASK = 128 * 1024 * 1024
FILES_PER_TASK = 20_000
CHUNK_BYTES = 64 * 1024 * 1024
SLOTS_PER_TASK = 16

FILE_KEY = ("relative_path", "size", "mtime_ns", "ctime_ns")
CHUNK_KEY = (*FILE_KEY, "chunk_no", "chunk_off", "chunk_len")


def _regular(path: bytes, flags: int) -> int:
    """Open a regular file; anything else now under its name must not block the task."""
    fd = os.open(path, flags | os.O_NONBLOCK)
    if not stat.S_ISREG(os.fstat(fd).st_mode):
        os.close(fd)
        raise OSError(errno.EINVAL, "not a regular file")
    return fd


def read_digest(
    path: bytes, block: memoryview, offset: int = 0, length: int | None = None
) -> tuple[bytes, int]:
    """SHA-512 of a file or of a part of it, and how many bytes were read.

    ``block`` is the buffer to read into, one for all files of a task.
    """
    state, done = hashlib.sha512(), 0
    with open(path, "rb", buffering=0, opener=_regular) as f:
        if offset:
            f.seek(offset)
        while length is None or done < length:
            want = block if length is None else block[: length - done]
            got = f.readinto(want)
            if not got:
                break
            state.update(block[:got])
            done += got
    return state.digest(), done


def task_count(files: int, total_bytes: int, cores: int) -> int:
    """Hashing tasks: even in bytes, not too many small files each, and no idle cores."""
    by_bytes, by_files = total_bytes // BYTES_PER_TASK, files // FILES_PER_TASK
    return even_tasks(max(by_bytes, by_files, min(files // 50, cores)), cores)


def _level(loads: list[int], rest: int) -> float:
    """How far ``rest`` fills tasks with these loads up."""
    held, level = 0, 0.0
    for count, load in enumerate(sorted(loads), 1):
        if count > 1 and load >= level:
            break
        held += load
        level = (held + rest) / count
    return level


def _slots(loads: list[int], rest: int) -> list[int]:
    """Tasks in the order in which small files are dealt to them: each as often as it has room left, mixed evenly."""
    room = [max(0.0, _level(loads, rest) - load) for load in loads]
    every = sum(room) or len(loads)
    wanted = [round((free if sum(room) else 1) / every * SLOTS_PER_TASK * len(loads)) for free in room]
    return [task for _, task in sorted(((i + 0.5) / n, task) for task, n in enumerate(wanted) for i in range(n))]


def dealt_by_size(files: DataFrame, tasks: int) -> DataFrame:
    """The files in ``tasks`` partitions of about the same number of bytes each.

    Files of an eighth of a task's share or more (fewer than 8 a task) are dealt on the driver, the largest first to the task with
    least.  The others are dealt by falling size to what room the tasks have left.
    """
    if tasks < 2:
        return files.coalesce(1)
    spark, key = files.sparkSession, files.columns
    total = files.agg(F.sum("size")).first()[0] or 0
    large = F.coalesce(F.col("size"), F.lit(0)) * (8 * tasks) > F.lit(total)
    # Names need not be text that Python can read.
    as_bytes = [F.col(c).cast("binary").alias(c) if c == "relative_path" else F.col(c) for c in key]
    rows = sorted(files.where(large).select(*as_bytes).collect(), key=lambda r: (-r["size"], bytes(r.relative_path)))
    loads, heap, placed = [0] * tasks, [(0, task) for task in range(tasks)], []
    for row in rows:
        load, task = heapq.heappop(heap)
        loads[task] = load + row["size"]
        heapq.heappush(heap, (loads[task], task))
        placed.append((*row, task))
    kinds = ", ".join(f"{c} {'binary' if c == 'relative_path' else 'bigint'}" for c in key)
    own = spark.createDataFrame(placed, f"{kinds}, _task int").withColumn("relative_path", F.col("relative_path").cast("string"))
    order = _slots(loads, total - sum(loads))
    turns = spark.createDataFrame(list(enumerate(order)), "_turn bigint, _task int")
    # Numbers within ranges of sizes: the files of a range are nearly alike, so each range is dealt evenly by itself.
    falling = [F.desc_nulls_last("size"), F.col("relative_path")]
    small = files.where(~large).repartitionByRange(*falling).sortWithinPartitions(*falling)
    small = small.withColumn("_at", F.monotonically_increasing_id())  # partition above 33 bits, row in it below
    turn = F.pmod(F.col("_at").bitwiseAND((1 << 33) - 1) + F.shiftright("_at", 33) * 7919, F.lit(len(order)))
    small = small.withColumn("_turn", turn).join(F.broadcast(turns), "_turn").select(*key, "_task")
    return own.select(*key, "_task").unionByName(small).repartitionById(tasks, "_task").drop("_task")


def _hash_rows(rows: DataFrame, root: str, key: tuple, part: bool) -> DataFrame:
    """Hash one file or chunk per row, each partition by one task."""
    root_bytes, inode = root_identity(root)
    types = {"relative_path": pa.binary()}
    schema = pa.schema(
        [(c, types.get(c, pa.int64())) for c in key]
        + [("digest", pa.binary()), ("error", pa.string())]
    )
    ddl = ", ".join(f"{c} {'binary' if c in types else 'bigint'}" for c in key)

    def hashed(row, block):
        path = os.path.join(root_bytes, row[0])
        try:
            if not part:
                return (*row, read_digest(path, block)[0], None)
            digest, done = read_digest(path, block, row[-2], row[-1])
            if done == row[-1]:
                return (*row, digest, None)
            return (*row, None, f"read {done} of {row[-1]} bytes")
        except OSError as e:
            return (*row, None, f"{type(e).__name__}: {e.strerror}")

    def run(batches):
        mounted_root(root_bytes, inode)
        block = memoryview(bytearray(BLOCK))
        for batch in batches:
            rows = zip(*(column.to_pylist() for column in batch.columns))
            yield from in_batches((hashed(row, block) for row in rows), schema)

    binary = rows.select(F.col(key[0]).cast("binary").alias(key[0]), *key[1:])
    out = binary.mapInArrow(run, ddl + ", digest binary, error string")
    return out.withColumn(key[0], F.col(key[0]).cast("string"))


def hash_files(files: DataFrame, root: str, tasks: int) -> DataFrame:
    """sha512 of every file below ``root``; ``error`` where it could not be read."""
    hashed = _hash_rows(dealt_by_size(files.select(*FILE_KEY), tasks), root, FILE_KEY, part=False)
    return hashed.withColumnRenamed("digest", "sha512")


def file_chunks(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk of each file; an empty file has one empty chunk."""
    last = F.greatest(div(F.col("size") - 1, chunk_bytes), F.lit(0))
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    numbered = files.select(*FILE_KEY, numbers.alias("chunk_no"))
    offset = F.col("chunk_no") * chunk_bytes
    return numbered.select(
        *FILE_KEY,
        "chunk_no",
        offset.alias("chunk_off"),
        F.least(F.lit(chunk_bytes).cast("bigint"), F.col("size") - offset).alias("chunk_len"),
    )


def hash_chunks(chunks: DataFrame, root: str, tasks: int) -> DataFrame:
    """sha512 of every chunk; ``error`` where it could not be read in full."""
    spread = chunks.select(*CHUNK_KEY).repartition(tasks, *CHUNK_KEY)  # chunks are alike in size
    hashed = _hash_rows(spread, root, CHUNK_KEY, part=True)
    return hashed.withColumnRenamed("digest", "chunk_sha512")
