from pyspark.sql import Column, functions as F


def as_column(name_or_column) -> Column:
    return F.col(name_or_column) if isinstance(name_or_column, str) else name_or_column


def div(number: Column, by: int) -> Column:
    """Integer division, exact for the whole BIGINT range."""
    return F.call_function("div", number, F.lit(by))
