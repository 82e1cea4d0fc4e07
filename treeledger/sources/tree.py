"""Listing a file tree that every executor can reach at the same mount point.

The walk runs in rounds.  A round hands each pending directory to some task,
which lists it and goes on into its subdirectories until it has seen ``budget``
names; directories still open then are left for the next round and spread over
all tasks again.  A tree whose files sit mostly under one branch is therefore
shared out after the first round.  Names only are collected this way; the
metadata is read in a second, evenly partitioned pass, so a single directory
that holds a large part of all files is also shared out.

Symbolic links are never followed and other file systems never entered.
"""

import errno
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import path_depth
from ..schemas import LISTING
from .scratch import fresh_folder, materialise

BATCH_ROWS = 10_000
NAMES_PER_DIRECTORY_TASK = 20_000
PATHS_PER_STAT_TASK = 50_000
MAX_TASKS = 20_000

_FOUND = pa.schema(
    [
        ("path", pa.binary()),
        ("is_dir", pa.bool_()),
        ("pending", pa.bool_()),
        ("opaque", pa.bool_()),
        ("error", pa.string()),
    ]
)
_FOUND_DDL = "path binary, is_dir boolean, pending boolean, opaque boolean, error string"
_DETAIL = pa.schema(
    [
        ("path", pa.binary()),
        ("kind", pa.string()),
        ("size", pa.int64()),
        ("mtime_ns", pa.int64()),
        ("ctime_ns", pa.int64()),
        ("dev", pa.int64()),
        ("target_exists", pa.bool_()),
        ("opaque", pa.bool_()),
        ("error", pa.string()),
    ]
)
_DETAIL_DDL = (
    "path binary, kind string, size bigint, mtime_ns bigint, ctime_ns bigint, "
    "dev bigint, target_exists boolean, opaque boolean, error string"
)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = BATCH_ROWS):
    """Arrow batches of at most ``size`` rows from an iterator of tuples."""
    buffer = []
    for row in rows:
        buffer.append(row)
        if len(buffer) == size:
            yield _batch(buffer, schema)
            buffer = []
    if buffer:
        yield _batch(buffer, schema)


def _batch(rows, schema):
    columns = zip(*rows)
    arrays = [pa.array(values, field.type) for values, field in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def even_tasks(wanted: int, cores: int) -> int:
    """A number of tasks that fills the cores in whole rounds."""
    rounds = -(-wanted // cores)
    return min(max(wanted, 1) if rounds <= 1 else rounds * cores, MAX_TASKS)


def is_gone(error: OSError) -> bool:
    """Did the file system say that the path is not there (rather than fail)?"""
    return error.errno in (errno.ENOENT, errno.ENOTDIR, errno.ELOOP)


def mounted_root(root: bytes, inode: int) -> int:
    """The device of the root as this executor sees it.

    Raises where the root is not the directory that the driver saw: an executor
    without the mount must fail its task and not report files as gone.  Device
    numbers differ between machines, inode numbers of a shared mount do not.
    """
    found = os.lstat(root)
    if found.st_ino != inode:
        raise OSError(f"{os.fsdecode(root)} is not the mounted root on this machine")
    return found.st_dev


def _directory(root: bytes, path: bytes, device: int, budget: int) -> Iterator[tuple]:
    """Names below one directory, until ``budget`` of them have been seen."""
    open_dirs, seen = [path], 0
    while open_dirs:
        here = open_dirs.pop()
        if seen >= budget:
            yield here, True, True, False, None
            continue
        opaque, error = False, None
        try:
            full = os.path.join(root, here)
            if os.lstat(full).st_dev != device:
                opaque = True
            else:
                with os.scandir(full) as entries:
                    for entry in entries:
                        seen += 1
                        name = os.path.join(here, entry.name)
                        if not entry.is_dir(follow_symlinks=False):
                            yield name, False, False, False, None
                        elif seen < budget:
                            open_dirs.append(name)
                        else:
                            yield name, True, True, False, None
        except OSError as e:
            if is_gone(e) and here != b"":
                continue  # removed while we were walking
            opaque, error = True, f"{type(e).__name__}: {e.strerror}"
        if here != b"":
            yield here, True, False, opaque, error
        elif error is not None:
            raise OSError(f"cannot list the root: {error}")


def _kind(mode: int) -> str:
    if stat.S_ISREG(mode):
        return "file"
    if stat.S_ISDIR(mode):
        return "dir"
    return "symlink" if stat.S_ISLNK(mode) else "other"


def _details(root: bytes, path: bytes, opaque: bool, error: str | None) -> tuple | None:
    full = os.path.join(root, path)
    try:
        found = os.lstat(full)
    except OSError as e:
        if is_gone(e):
            return None
        reason = error or f"{type(e).__name__}: {e.strerror}"
        return path, "other", None, None, None, None, None, opaque, reason
    target_exists = None
    if stat.S_ISLNK(found.st_mode):
        try:
            os.stat(full)
            target_exists = True
        except OSError as e:
            target_exists = not is_gone(e)
    return (
        path,
        _kind(found.st_mode),
        found.st_size,
        found.st_mtime_ns,
        found.st_ctime_ns,
        found.st_dev,
        target_exists,
        opaque,
        error,
    )


def recorded_root(root: str) -> str:
    """The root as a manifest records it: absolute and without a scheme, links kept."""
    path = root.removeprefix("file://") if root.startswith("file:///") else root
    if "://" in path:
        raise ValueError(f"the root must be a mounted path: {root}")
    return os.path.abspath(path)


def resolved_root(root: str) -> str:
    """The absolute path of a directory to scan; raises when it is not one."""
    full = os.path.realpath(recorded_root(root))
    if not os.path.exists(full):
        raise FileNotFoundError(f"no such root: {root}")
    if not os.path.isdir(full):
        raise NotADirectoryError(f"not a directory: {root}")
    return full


def root_identity(root: str) -> tuple[bytes, int]:
    full = os.fsencode(resolved_root(root))
    return full, os.lstat(full).st_ino


def scan_tree(
    spark: SparkSession,
    root: str,
    budget: int = NAMES_PER_DIRECTORY_TASK,
    folder: str | None = None,
) -> DataFrame:
    """The listing of ``root`` (schema ``LISTING``), written once to ``folder``, by
    default a new one in the shared folder.

    Dot files, empty files and directories are included; the root itself is not.
    """
    root_bytes, inode = root_identity(root)
    folder = folder or fresh_folder(spark)
    cores = spark.sparkContext.defaultParallelism

    def walk(batches):
        device = mounted_root(root_bytes, inode)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from in_batches(_directory(root_bytes, path, device, budget), _FOUND)

    def describe(batches):
        mounted_root(root_bytes, inode)
        for batch in batches:
            rows = zip(*(column.to_pylist() for column in batch.columns))
            found = (_details(root_bytes, *row) for row in rows)
            yield from in_batches((row for row in found if row is not None), _DETAIL)

    pending = spark.createDataFrame([(bytearray(),)], "path binary")
    rounds, waiting = [], 1
    while waiting:
        spread = pending.repartition(min(waiting, 4 * cores), "path")
        found = materialise(
            spread.mapInArrow(walk, _FOUND_DDL), f"{folder}/round={len(rounds)}"
        )
        rounds.append(found)
        pending = found.where("pending").select("path")
        waiting = pending.count()

    found = spark.read.parquet(*[f"{folder}/round={i}" for i in range(len(rounds))])
    entries = found.where(~F.col("pending")).select("path", "opaque", "error")
    names = entries.count()
    tasks = even_tasks(max(names // PATHS_PER_STAT_TASK, min(names // 500, cores)), cores)
    details = entries.repartition(tasks, "path").mapInArrow(describe, _DETAIL_DDL)
    name = F.col("path").cast("string")
    listing = details.select(
        name.alias("relative_path"),
        "kind",
        "size",
        "mtime_ns",
        "ctime_ns",
        path_depth(name).alias("depth"),
        "dev",
        "target_exists",
        "opaque",
        "error",
    )
    return materialise(listing.select(*LISTING.fieldNames()), f"{folder}/listing")


def still_present(paths: DataFrame, root: str) -> DataFrame:
    """Of ``paths`` (relative_path), those that exist below ``root``, as listing rows.

    For recorded paths that a walk did not meet: links are followed here and
    other file systems entered, and a path counts as present unless the file
    system says it is not there, so an unreadable directory never looks empty.
    """
    root_bytes, inode = root_identity(root)

    def probe(batches):
        mounted_root(root_bytes, inode)
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    os.stat(os.path.join(root_bytes, path))
                except OSError as e:
                    if is_gone(e):
                        continue
                rows.append((path,))
            if rows:
                yield _batch(rows, pa.schema([("path", pa.binary())]))

    names = paths.select(F.col("relative_path").cast("binary").alias("path"))
    names = names.repartition(paths.sparkSession.sparkContext.defaultParallelism, "path")
    found = names.mapInArrow(probe, "path binary").select(F.col("path").cast("string").alias("p"))
    filled = {
        "relative_path": F.col("p"),
        "kind": F.lit("other"),
        "depth": path_depth("p"),
    }
    return found.select(
        *[
            filled.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
            for f in LISTING.fields
        ]
    )


def list_errors(listing: DataFrame) -> DataFrame:
    """What could not be listed, as rows of ``schemas.ERRORS``."""
    rows = listing.where(F.col("error").isNotNull())
    return rows.select("relative_path", F.lit("list").alias("stage"), "error")
