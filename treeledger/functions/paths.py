"""Path expressions: every function takes and returns a Column."""

from pyspark.sql import Column, functions as F

from .columns import as_column

MAX_DEPTH = 32767


def trim_trailing_slashes(path) -> Column:
    """Drop trailing slashes, but never the first character (``//`` -> ``/``)."""
    path = as_column(path)
    trimmed = F.rtrim(path, F.lit("/"))
    return F.when(trimmed == "", F.substring(path, 1, 1)).otherwise(trimmed)


def leading_slashes(path) -> Column:
    """How many slashes the path starts with."""
    path = as_column(path)
    return F.octet_length(path) - F.octet_length(F.ltrim(path, F.lit("/")))


def relative_to(path, prefix) -> Column:
    """The path below ``prefix`` without leading slashes; NULL when not below it."""
    path, prefix = as_column(path), F.rtrim(as_column(prefix), F.lit("/"))
    rest = F.substr(path, F.char_length(prefix) + 1)
    below = path.startswith(prefix) & ((rest == "") | rest.startswith("/"))
    return F.when(below, F.ltrim(rest, F.lit("/")))


def join_path(prefix, relative_path) -> Column:
    prefix = F.rtrim(as_column(prefix), F.lit("/"))
    return F.concat(prefix, F.lit("/"), as_column(relative_path))


def base_name(path) -> Column:
    return F.substring_index(trim_trailing_slashes(path), "/", -1)


def parent_path(path) -> Column:
    """The directory part; empty for a name directly under the root."""
    path = as_column(path)
    cut = F.char_length(path) - F.char_length(F.substring_index(path, "/", -1)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).otherwise(F.lit(""))


def path_depth(path) -> Column:
    """Directories between the root and the name: 0 for a file in the root."""
    path = as_column(path)
    bare = F.replace(path, F.lit("/"), F.lit(""))
    return F.octet_length(path) - F.octet_length(bare)


def within_depth(path, maxdepth: int | None) -> Column:
    """True where the path is at most ``maxdepth`` deep; None or -1 is no limit."""
    if maxdepth is None or maxdepth == -1:
        return F.lit(True)
    if not 0 <= maxdepth <= MAX_DEPTH:
        raise ValueError(f"maxdepth must be between 0 and {MAX_DEPTH}, or -1 for no limit")
    return path_depth(path) <= maxdepth
