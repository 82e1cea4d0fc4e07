"""Digests of bytes that are already in a column."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def digest(content, bits: int = 512) -> Column:
    """SHA-2 of a string or binary column, as bytes."""
    return F.unhex(F.sha2(content, bits))


def _marked(column: Column, kind: T.DataType) -> Column:
    return F.coalesce(_as_text(column, kind), F.lit("N"))


def _as_text(column: Column, kind: T.DataType) -> Column:
    """The value as text that cannot run into the next one; NULL for NULL."""
    if isinstance(kind, T.ArrayType):
        items = F.transform(column, lambda item: _marked(item, kind.elementType))
        return F.concat(F.size(column).cast("string"), F.lit("["), F.array_join(items, ","))
    if isinstance(kind, T.MapType):
        pairs = F.transform(
            F.map_entries(column),
            lambda e: F.concat(_marked(e["key"], kind.keyType), F.lit("="), _marked(e["value"], kind.valueType)),
        )
        return F.concat(F.size(column).cast("string"), F.lit("{"), F.array_join(F.array_sort(pairs), ","))
    if isinstance(kind, T.StructType):
        parts = [_marked(column[field.name], field.dataType) for field in kind.fields]
        return F.when(column.isNotNull(), F.concat(F.lit("("), F.concat_ws(",", *parts)))
    if isinstance(kind, T.StringType):  # as its bytes, valid or not
        return F.concat(F.octet_length(column).cast("string"), F.lit(":"), column)
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (column + F.lit(0.0).cast(kind)).cast("string")  # 0.0 and -0.0 are equal
    if isinstance(kind, T.TimestampType):  # the instant: local times repeat when clocks go back
        return F.unix_micros(column).cast("string")
    return column.cast("string")  # numbers, dates and booleans: their text holds no comma


def row_digest(df: DataFrame, value_cols: Sequence[str], bits: int = 512) -> Column:
    """Digest of several columns: free text is length-prefixed and NULL is marked, also inside arrays, maps
    and structs, so that no two different rows share an encoding and equal ones do."""
    parts = [_marked(F.col(f"`{name}`"), df.schema[name].dataType) for name in value_cols]
    return digest(F.concat_ws(",", *parts), bits)
