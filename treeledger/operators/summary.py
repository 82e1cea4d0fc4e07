"""Totals of a listing."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import format_bytes, within_depth


def tree_summary(listing: DataFrame, maxdepth: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Directories, files, symlinks, their sum, and total size of the files.

    Files deeper than ``maxdepth`` are left out; directories and symlinks are
    not.  Without ``by`` the root itself counts as a directory.
    """
    root = 0 if by else 1

    def count(condition: Column) -> Column:
        return F.count_if(condition)

    is_file = (F.col("kind") == "file") & within_depth("relative_path", maxdepth)
    totals = listing.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).alias("total_size"),
        (count(F.col("kind") == "dir") + root).alias("dirs"),
        count(is_file).alias("files"),
        count(F.col("kind") == "symlink").alias("symlinks"),
    )
    return totals.select(
        *by,
        "total_size",
        format_bytes("total_size").alias("total_size_text"),
        (F.col("dirs") + F.col("files") + F.col("symlinks")).alias("total_items"),
        "dirs",
        "files",
        "symlinks",
    )
