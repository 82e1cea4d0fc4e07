"""The roots a manifest was taken from."""

from pyspark.sql import DataFrame, functions as F

from ..functions import trim_trailing_slashes


def normalised(roots: DataFrame) -> DataFrame:
    """Each root once, without trailing slashes."""
    return roots.select(trim_trailing_slashes("prefix").alias("prefix")).distinct()


def unexpected_roots(saved: DataFrame, given: DataFrame) -> DataFrame:
    """Saved roots that are not among the given ones."""
    return saved.select("prefix").join(normalised(given), "prefix", "left_anti")


def merged_roots(saved: DataFrame, given: DataFrame, replace: bool = False) -> DataFrame:
    """Saved and given roots, each once; ``replace`` drops saved roots not given."""
    given = normalised(given)
    kept = saved.select("prefix")
    if replace:
        kept = kept.join(given, "prefix", "left_semi")
    return kept.union(given).dropDuplicates(["prefix"])
