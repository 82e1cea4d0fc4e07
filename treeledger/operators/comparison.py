"""Comparing two manifests.

Any two DataFrames with the key columns and a digest column will do.  Keys must
be unique on each side (``quality.self_check`` tests it; tables without that
promise go through ``reconcile``).  A NULL digest is an unfinished row: it is
never a mismatch, it is ``unverified``.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

PATH_KEY = ("relative_path",)


def only_in(side: DataFrame, other: DataFrame, key_cols: Sequence[str] = PATH_KEY) -> DataFrame:
    """Keys of ``side`` that ``other`` lacks.  No digest is read."""
    keys = list(key_cols)
    return side.select(*keys).join(other.select(*keys), keys, "left_anti")


def mismatched(
    left: DataFrame, right: DataFrame, key_cols: Sequence[str] = PATH_KEY, digest_col: str = "sha512"
) -> DataFrame:
    """Keys on both sides whose digests are known and differ."""
    keys = list(key_cols)
    a = left.select(*keys, F.col(digest_col).alias("_left"))
    b = right.select(*keys, F.col(digest_col).alias("_right"))
    # coalesce keeps the optimizer from testing both digests for NULL below the
    # join, which would compute a derived digest twice.
    differ = F.coalesce(F.col("_left") != F.col("_right"), F.lit(False))
    return a.join(b, keys).where(differ).select(*keys)


def compare(
    left: DataFrame, right: DataFrame, key_cols: Sequence[str] = PATH_KEY, digest_col: str = "sha512"
) -> DataFrame:
    """Every key of either side with its status, from one full outer join."""
    keys = list(key_cols)
    a = left.select(*keys, F.lit(True).alias("_in_left"), F.col(digest_col).alias("_left"))
    b = right.select(*keys, F.lit(True).alias("_in_right"), F.col(digest_col).alias("_right"))
    status = (
        F.when(F.col("_in_right").isNull(), "only_left")
        .when(F.col("_in_left").isNull(), "only_right")
        .when(F.col("_left").isNull() | F.col("_right").isNull(), "unverified")
        .when(F.col("_left") != F.col("_right"), "mismatch")
        .otherwise("match")
    )
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def status_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def verdict(compared: DataFrame) -> DataFrame:
    """One row of booleans; two empty sides are equal."""

    def none(*statuses):
        return F.count_if(F.col("status").isin(*statuses)) == 0

    return compared.agg(
        none("only_left", "only_right").alias("files_identical"),
        none("mismatch").alias("checksums_identical"),
        none("only_left", "only_right", "mismatch").alias("equal"),
        none("unverified").alias("fully_verified"),
    )


def report(compared: DataFrame, key_cols: Sequence[str] = PATH_KEY) -> DataFrame:
    """The rows that are not a match, in bytewise path order."""
    return compared.where(F.col("status") != "match").orderBy("status", *key_cols)
