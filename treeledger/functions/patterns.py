"""Ignore and include patterns as Column predicates.

Patterns are unanchored, case-sensitive searches over the relative path, in Perl
syntax.  They run as Java regular expressions, rewritten where the two differ; ``(?d)`` makes newline the only line
terminator, so ``.`` matches every other character.  What Java cannot say is refused before any job starts.  Over non-ASCII names, wildcards match
characters rather than bytes and ``\\b`` knows letters other than a-z.
"""

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession, functions as F

from .columns import as_column
from .perl_patterns import java_pattern

_NEWLINE_ONLY = "(?d)"


def check_patterns(patterns: Sequence[str]) -> None:
    """Raise ValueError for the first pattern that is not usable."""
    for pattern in patterns:
        written = _NEWLINE_ONLY + java_pattern(pattern)
        try:  # folded to a constant while planning, so no job runs
            spark = SparkSession.builder.getOrCreate()
            spark.sql("SELECT '' RLIKE :pattern", args={"pattern": written}).collect()
        except PySparkException as e:
            raise ValueError(f"unusable pattern {pattern!r}: {e}") from e


def matches_any(path, patterns: Sequence[str]) -> Column:
    """True where any pattern is found in the path; false when there are none."""
    if isinstance(patterns, str):
        raise TypeError("patterns must be a list of strings")
    path = as_column(path)
    check_patterns(patterns)
    return reduce(or_, [path.rlike(_NEWLINE_ONLY + java_pattern(p)) for p in patterns], F.lit(False))


def is_ignored(path, ignore: Sequence[str] = (), include: Sequence[str] = ()) -> Column:
    """Ignored by a pattern and not taken back by an include pattern."""
    if not ignore:
        check_patterns(include)
        return F.lit(False)
    return ~matches_any(path, include) & matches_any(path, ignore)
