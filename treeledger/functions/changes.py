"""Metadata change detection."""

from pyspark.sql import Column, functions as F

from .columns import as_column

# Bits of the change mask, in the order their labels are shown.
CHANGE_BITS = {"size": 1, "ctime": 2, "mtime": 4}
NOT_COMPARED = -1

_COLUMN = {"size": "size", "ctime": "ctime_ns", "mtime": "mtime_ns"}


def change_mask(was: str = "was_", now: str = "now_", compared: Column | None = None) -> Column:
    """Sum of the bits whose columns differ; 0 identical, -1 where ``compared`` is false.

    ``was`` and ``now`` are the prefixes of the two sets of metadata columns.
    """
    differs = [
        F.when(~F.col(was + _COLUMN[name]).eqNullSafe(F.col(now + _COLUMN[name])), bit).otherwise(0)
        for name, bit in CHANGE_BITS.items()
    ]
    mask = differs[0] + differs[1] + differs[2]
    return mask if compared is None else F.when(compared, mask).otherwise(NOT_COMPARED)


def change_label(mask) -> Column:
    """``size & ctime & mtime`` for the set bits; NULL when nothing changed."""
    mask = as_column(mask)
    names = [F.when(mask.bitwiseAND(bit) != 0, name) for name, bit in CHANGE_BITS.items()]
    return F.when(mask > 0, F.concat_ws(" & ", *names))
