"""Manifests as a base and later changes, put together when they are read.

A change is a row that came or replaced another, or, with ``removed``, the key of one that went.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .comparison import PATH_KEY


def changes_between(
    old: DataFrame, new: DataFrame, value_cols: Sequence[str], key_cols: Sequence[str] = PATH_KEY
) -> DataFrame:
    """key, values and ``removed``: what turns ``old`` into ``new``.  Keys are unique on each side."""
    keys = list(key_cols)
    was = old.select(*keys, F.struct(*value_cols).alias("_was"))
    now = new.select(*keys, F.struct(*value_cols).alias("_now"))
    both = was.join(now, keys, "full_outer")
    changed = ~F.col("_was").eqNullSafe(F.col("_now"))
    removed = F.col("_now").isNull().alias("removed")
    return both.where(changed).select(*keys, *[F.col("_now")[c].alias(c) for c in value_cols], removed)


def latest_changes(
    changes: DataFrame, value_cols: Sequence[str], key_cols: Sequence[str] = PATH_KEY, order_col: str = "sequence"
) -> DataFrame:
    """Of several changes of a key the last one by ``order_col``."""
    last = F.max_by(F.struct(*value_cols, "removed"), order_col).alias("_last")
    found = changes.groupBy(*key_cols).agg(last)
    return found.select(*key_cols, *[F.col("_last")[c].alias(c) for c in (*value_cols, "removed")])


def merge_changes(
    base: DataFrame, latest: DataFrame, value_cols: Sequence[str], key_cols: Sequence[str] = PATH_KEY
) -> DataFrame:
    """The manifest that ``base`` has become by ``latest`` (one change a key).

    The base is joined with keys of changes only; where these are few, Spark sends them to the base's tasks and no row of
    the base is shuffled.
    """
    keys, cols = list(key_cols), [*key_cols, *value_cols]
    kept = base.select(*cols).join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(latest.where(~F.col("removed")).select(*cols))
