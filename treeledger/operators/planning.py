"""The refresh decision: what to do with every path of a listing and a manifest."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import (
    CHANGE_BITS,
    change_label,
    change_mask,
    format_bytes,
    format_time,
    is_ignored,
    within_depth,
)
from ..functions.changes import NOT_COMPARED
from ..schemas import DELETE_ACTIONS, HASH_ACTIONS

PATH_KEY = ("relative_path",)
_METADATA = ("size", "mtime_ns", "ctime_ns")


def plan_refresh(
    listing: DataFrame,
    manifest: DataFrame,
    *,
    ignore: Sequence[str] = (),
    include: Sequence[str] = (),
    maxdepth: int | None = None,
    clean_ignored: bool = False,
    mode: str = "incremental",
    key_cols: Sequence[str] = PATH_KEY,
    digest_col: str = "sha512",
) -> DataFrame:
    """One row per path that the manifest holds or the refresh looks at.

    ``listing`` must not be filtered: depth and patterns decide what is added or
    hashed, while a recorded path is deleted only when it is not in the listing
    at all (or is a symlink to nothing).  ``mode="full"`` hashes unchanged files
    again, which is the only way to see content that changed under the same
    metadata.  ``key_cols`` has more than relative_path where several roots share
    a manifest.
    """
    keys = list(key_cols)
    if mode not in ("incremental", "full"):
        raise ValueError("mode must be 'incremental' or 'full'")
    now = listing.select(
        *keys,
        F.lit(True).alias("_listed"),
        F.col("kind").alias("_kind"),
        F.col("target_exists").alias("_target_exists"),
        *[F.col(c).alias("now_" + c) for c in _METADATA],
    )
    was = manifest.select(
        *keys,
        F.lit(True).alias("_saved"),
        *[F.col(c).alias("was_" + c) for c in _METADATA],
        F.col(digest_col).alias("was_" + digest_col),
        F.col("bytes_hashed").alias("was_bytes_hashed"),
    )
    path = F.col("relative_path")
    saved = F.col("_saved").isNotNull()
    exists = F.col("_listed").isNotNull() & (
        (F.col("_kind") != "symlink") | F.coalesce("_target_exists", F.lit(False))
    )
    candidate = F.coalesce(F.col("_kind") == "file", F.lit(False)) & within_depth(path, maxdepth)
    ignored = is_ignored(path, ignore, include)
    mask = change_mask(compared=saved & candidate)
    same = F.col("change_mask") == 0
    complete = F.col("was_bytes_hashed").isNull()
    unchanged = same & complete if mode == "incremental" else F.lit(False)

    joined = now.join(was, keys, "full_outer").withColumn("change_mask", mask)
    action = (
        F.when(saved & F.lit(clean_ignored) & ignored, "DELETE_IGNORED")
        .when(saved & ~exists, "DELETE_MISSING")
        .when(saved & ~candidate, "KEEP")
        .when(saved & unchanged, "KEEP")
        .when(candidate & ignored, "IGNORED")
        .when(candidate & ~saved, "ADD")
        .when(saved & same & ~complete, "RESUME")
        .when(saved & same, "REHASH")
        .when(saved & ~complete, "REHASH")
        .when(saved, "CHANGED")
    )
    return joined.where(saved | candidate).select(
        *keys,
        action.alias("action"),
        "change_mask",
        change_label("change_mask").alias("change_label"),
        *["was_" + c for c in _METADATA],
        "was_" + digest_col,
        "was_bytes_hashed",
        *["now_" + c for c in _METADATA],
    )


def to_hash(plan: DataFrame, key_cols: Sequence[str] = PATH_KEY) -> DataFrame:
    """The planned paths whose content must be read, with their current metadata."""
    return plan.where(F.col("action").isin(*HASH_ACTIONS)).select(
        *key_cols, *[F.col("now_" + c).alias(c) for c in _METADATA]
    )


def apply_plan(
    plan: DataFrame,
    hashed: DataFrame,
    key_cols: Sequence[str] = PATH_KEY,
    digest_col: str = "sha512",
) -> DataFrame:
    """The next manifest: rows carried over, plus rows hashed now, minus deletions.

    ``hashed`` holds the key, size, mtime_ns, ctime_ns (all as taken before
    reading) and the digest.  A path that should have been hashed and was not
    keeps its old row if it had one and gets none otherwise.
    """
    keys = list(key_cols)
    stored = (*_METADATA, digest_col, "bytes_hashed")
    compared = F.col("change_mask") != NOT_COMPARED  # so an ignored path has a saved row
    carried = plan.where(
        (F.col("action") == "KEEP") | ((F.col("action") == "IGNORED") & compared)
    ).select(*keys, *[F.col("was_" + c).alias(c) for c in stored])

    due = plan.where(F.col("action").isin(*HASH_ACTIONS))
    done = hashed.select(
        *keys,
        *_METADATA,
        F.col(digest_col),
        F.lit(None).cast("bigint").alias("bytes_hashed"),
        F.col(digest_col).isNotNull().alias("_done"),
    )
    is_done = F.coalesce("_done", F.lit(False))
    rehashed = (
        due.join(done, keys, "left")
        .where(is_done | (F.col("action") != "ADD"))
        .select(
            *keys,
            *[F.when(is_done, F.col(c)).otherwise(F.col("was_" + c)).alias(c) for c in stored],
        )
    )
    return carried.unionByName(rehashed)


def plan_changes(
    plan: DataFrame,
    hashed: DataFrame,
    key_cols: Sequence[str] = PATH_KEY,
    digest_col: str = "sha512",
) -> DataFrame:
    """What carrying out the plan changes in the manifest: key, columns, ``removed``, and ``had`` with the old
    size and digest where the path had a row.  The rows ``apply_plan`` gives are those of the manifest with
    these merged in.
    """
    keys = list(key_cols)
    was = [F.col("was_size"), F.col("was_" + digest_col)]
    had = F.col("change_mask") != NOT_COMPARED
    done = hashed.where(F.col(digest_col).isNotNull()).select(*keys, *_METADATA, digest_col)
    due = plan.where(F.col("action").isin(*HASH_ACTIONS))
    new = due.select(*keys, *was, had.alias("had")).join(done, keys).select(
        *keys, *_METADATA, digest_col, F.lit(None).cast("bigint").alias("bytes_hashed"),
        F.lit(False).alias("removed"), "had", *was,
    )
    nothing = {name: F.lit(None).cast(plan.schema["was_" + name].dataType) for name in (*_METADATA, digest_col, "bytes_hashed")}
    gone = plan.where(F.col("action").isin(*DELETE_ACTIONS)).select(
        *keys, *[value.alias(name) for name, value in nothing.items()],
        F.lit(True).alias("removed"), F.lit(True).alias("had"), *was,
    )
    return new.unionByName(gone)


def any_change(plan: DataFrame) -> DataFrame:
    """One row: does carrying out the plan change the manifest?"""
    changing = F.col("action").isin(*HASH_ACTIONS, *DELETE_ACTIONS)
    return plan.agg((F.count_if(changing) > 0).alias("any_change"))


def change_report(plan: DataFrame) -> DataFrame:
    """What changed on each changed path, before and after, in readable form."""
    shown = {"size": format_bytes, "ctime_ns": format_time, "mtime_ns": format_time}
    return plan.where(F.col("action") == "CHANGED").select(
        "relative_path",
        "change_label",
        *[
            F.when(F.col("change_mask").bitwiseAND(bit) != 0, shown[column](prefix + column)).alias(
                prefix + name
            )
            for (name, bit), column in zip(CHANGE_BITS.items(), shown)
            for prefix in ("was_", "now_")
        ],
    )


def action_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action", "change_mask", "change_label").agg(
        F.count(F.lit(1)).alias("files")
    )
