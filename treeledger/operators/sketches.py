"""Comparing two tables by sketches, so that what is shuffled grows with their differences and not with their rows.

Every row has an identity of 96 bits, taken from the digest of its columns.  A sketch (an invertible Bloom lookup table)
has three sub-tables of cells; a row goes to one cell of each, which adds up how many rows it got, their identities in four words of 24 bits, and a check
word.  Sketches of both sides are one aggregate, with the right side counted negatively, so that equal rows cancel, repeated ones
too.  A cell left with one row, any number of times, gives its identity away; taking it from its other cells frees more of them, until
the sketch is empty.  The number of cells follows from an estimate of the differences, made the same way from small sketches of
1/2, 1/4, 1/8, ... of all rows.

The rows whose identities came out are then read from both sides and counted exactly, as ``reconcile_multiset`` does.  Where
there are too many differences for a sketch of ``max_cells``, or it does not empty, all rows are counted: the
answer is the same.
"""

import zlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import row_digest
from .reconciliation import reconcile_multiset

TABLES = 3
WORD_BITS = 24
WORDS = 4
STRATA = 32
STRATUM_CELLS = 40  # of each of the three tables: holds some 80 differences
MAX_CELLS = 40_000  # of each table: what the driver peels at most, some 100 MB
_MASK = (1 << WORD_BITS) - 1
_FIELDS = ["copies", *[f"w{i}" for i in range(WORDS)], "check"]


def _identified(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df`` with the words and the check word of each row."""
    marked = df.withColumn("_digest", row_digest(df, cols, 256))
    halves = [F.xxhash64(F.lit(i), "_digest") for i in range(2)]
    words = [F.shiftrightunsigned(half, shift).bitwiseAND(_MASK) for half in halves for shift in (40, 16)]
    marked = marked.withColumns({f"w{i}": word for i, word in enumerate(words)}).drop("_digest")
    return marked.withColumn("check", _check([F.col(f"w{i}") for i in range(WORDS)]))


def _check(words: list[Column]) -> Column:
    return F.crc32(F.concat_ws(",", *words).cast("binary")).bitwiseAND(_MASK)


def _checked(words: Sequence[int]) -> int:
    return zlib.crc32(",".join(map(str, words)).encode()) & _MASK


def _places(words: list, cells: int) -> list:
    """The cell of each table, of columns or numbers."""
    pairs = [words[i] * (1 << WORD_BITS) + words[i + 1] for i in range(TABLES)]
    return [F.pmod(p, F.lit(cells)) if isinstance(p, Column) else p % cells for p in pairs]


def _sketched(left: DataFrame, right: DataFrame, cells: int, *by: str) -> DataFrame:
    """(by, table, cell) and the sums of both sides, right ones negative; empty cells left out."""
    sides = [left.withColumn("copies", F.lit(1).cast("bigint")), right.withColumn("copies", F.lit(-1).cast("bigint"))]
    rows = sides[0].select(*by, *_FIELDS).unionByName(sides[1].select(*by, *_FIELDS))
    words = [F.col(f"w{i}") for i in range(WORDS)]
    places = F.array(*_places(words, cells))
    signed = [(F.col(name) * F.col("copies")).alias(name) for name in _FIELDS[1:]]
    spread = rows.select(*by, "copies", *signed, F.posexplode(places).alias("table", "cell"))
    sums = spread.groupBy(*by, "table", "cell").agg(*[F.sum(name).alias(name) for name in _FIELDS])
    return sums.where(reduce(Column.__or__, [F.col(name) != 0 for name in _FIELDS]))


def peeled(cells: dict[tuple[int, int], list[int]], size: int) -> dict[tuple, int] | None:
    """The identities in a sketch with their net counts, or None if it does not empty.  Empties ``cells``."""
    found: dict[tuple, int] = {}
    open_cells = list(cells)
    while open_cells:
        place = open_cells.pop()
        held = cells.get(place)
        if held is None or not held[0] or any(v % held[0] for v in held[1:]):
            continue
        copies = held[0]
        words = tuple(v // copies for v in held[1:-1])
        if any(not 0 <= w <= _MASK for w in words) or _checked(words) != held[-1] // copies:
            continue
        places = list(enumerate(_places(list(words), size)))
        if place not in places:
            continue
        found[words] = found.get(words, 0) + copies
        if not found[words]:
            del found[words]
        for other in places:
            rest = cells.setdefault(other, [0] * len(held))
            values = [copies, *[w * copies for w in words], _checked(words) * copies]
            cells[other] = [a - b for a, b in zip(rest, values, strict=True)]
            if not any(cells[other]):
                del cells[other]
            else:
                open_cells.append(other)
        if len(found) > TABLES * size:
            return None
    return None if cells else found


def _collected(sketch: DataFrame, *by: str) -> dict:
    tables: dict = {}
    for row in sketch.collect():
        key = tuple(row[name] for name in by)
        tables.setdefault(key, {})[(row.table, row.cell)] = [row[name] for name in _FIELDS]
    return tables


def estimated_differences(left: DataFrame, right: DataFrame) -> int:
    """About how many different rows tell the sides apart (both with words): from the sparsest sample up."""
    # Words past the first four bytes choose the stratum: the number of leading zeros of 24 + 8 bits.
    def stratum(df):
        low = F.col("w3") * 256 + F.pmod("w1", F.lit(256))
        bits = F.length(F.bin(low))
        return df.withColumn("stratum", F.when(low == 0, STRATA).otherwise(32 - bits).cast("int"))

    strata = _collected(_sketched(stratum(left), stratum(right), STRATUM_CELLS, "stratum"), "stratum")
    total = 0
    for number in range(STRATA, -1, -1):
        found = peeled(strata.get((number,), {}), STRATUM_CELLS)
        if found is None:  # all that is sparser has been counted: half of the rest lies in the next ones
            return max(total, 2 * STRATUM_CELLS) << (number + 1)
        total += len(found)
    return total


def reconcile_by_sketch(
    left: DataFrame, right: DataFrame, key_cols: Sequence[str], value_cols: Sequence[str], max_cells: int = MAX_CELLS
) -> DataFrame:
    """The rows of ``reconcile_multiset`` that are not a match: key, left_rows, right_rows and status."""
    keys, cols = list(key_cols), [*key_cols, *value_cols]
    rows = left.select(*cols).limit(0).unionByName(right.select(*cols).limit(0))  # brings types together
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    sides = [_identified(side.select(*[F.col(c).cast(kinds[c]).alias(c) for c in cols]), cols) for side in (left, right)]

    def exact(a, b):
        return reconcile_multiset(a, b, keys, value_cols).where(F.col("status") != "match")

    # Twice as many cells as differences in all; 1.3 times as many would do if their number were known.
    cells = 64 + 2 * estimated_differences(*sides) // TABLES
    if cells > max_cells:
        return exact(left, right)
    found = peeled(_collected(_sketched(*sides, cells)).get((), {}), cells)
    if found is None:
        return exact(left, right)
    names = [f"w{i}" for i in range(WORDS)]
    few = left.sparkSession.createDataFrame(list(found), ", ".join(f"{name} bigint" for name in names))
    few = F.broadcast(few)  # no more than there are cells, 32 bytes each
    return exact(*[side.join(few, names, "left_semi").select(*cols) for side in sides])
