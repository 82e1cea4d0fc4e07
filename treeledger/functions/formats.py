"""Human-readable bytes, durations, times and numbers."""

from pyspark.sql import Column, functions as F

from .columns import as_column, div

# Binary units by bit shift, largest first.
BYTE_UNITS = {"EB": 60, "PB": 50, "TB": 40, "GB": 30, "MB": 20, "kB": 10, "B": 0}

# Nanoseconds per unit, largest first (365-day year, a month is a twelfth).
TIME_UNITS = {
    "y": 31_536_000_000_000_000,
    "mon": 2_628_000_000_000_000,
    "w": 604_800_000_000_000,
    "d": 86_400_000_000_000,
    "h": 3_600_000_000_000,
    "min": 60_000_000_000,
    "s": 1_000_000_000,
    "ms": 1_000_000,
    "μs": 1_000,
    "ns": 1,
}


def _shown(amount, unit) -> Column:
    return F.when(amount > 0, F.concat(amount.cast("string"), F.lit(unit)))


def _whole(number) -> Column:
    """The integer part as a decimal, so that products beyond BIGINT keep every digit."""
    number = as_column(number)
    return (number - number % 1).cast("decimal(38,0)")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _units_of(number, largest: str, by: int, smallest: str, parts_below) -> Column:
    """The parts of a number: how often ``by`` fits, as a decimal, and what ``parts_below`` makes of the BIGINT left."""

    def split(whole: Column) -> Column:
        rest = whole % F.lit(by)
        return F.struct(((whole - rest) / F.lit(by)).cast("decimal(38,0)").alias("top"), rest.cast("bigint").alias("rest"))

    def text(pair: Column) -> Column:
        return F.concat_ws(" ", _shown(pair["top"], largest), *parts_below(pair["rest"]))

    return _let(
        _whole(number), lambda whole: F.when(whole == 0, f"0{smallest}").when(whole > 0, _let(split(whole), text))
    )


def format_bytes(size) -> Column:
    """``4EB 5PB 6TB 7GB 8MB 9kB 10B`` with zero parts left out; ``0B`` for 0; 1024 EB and more stay EB."""
    (top, largest), *below = BYTE_UNITS.items()

    def parts(rest: Column) -> list[Column]:
        mask = F.lit(1023).cast("bigint")
        return [_shown(F.shiftright(rest, shift).bitwiseAND(mask), unit) for unit, shift in below]

    return _units_of(size, top, 1 << largest, "B", parts)


def format_duration(nanoseconds) -> Column:
    """``10y 9mon 1w 2d 3h 4min 5s 368ms 118μs 513ns``; ``0ns`` for 0, NULL below 0."""
    (top, largest), *below = TIME_UNITS.items()

    def parts(total: Column) -> list[Column]:
        found, rest, larger = [], total, []
        for unit, length in below:
            found.append(_shown(div(rest, length), unit))
            larger.append(length)
            # Taking off every larger unit in turn is needed only where one of them
            # is not a multiple of this one (a month is not a whole number of weeks).
            nested = any(each % length for each in larger)
            rest = (rest if nested else total) % length
        return found

    return _units_of(nanoseconds, top, largest, "ns", parts)


def format_time(nanoseconds) -> Column:
    """UTC ``yyyy-MM-dd HH:mm:ss.nnnnnnnnn`` whatever the session time zone; 10^12 seconds from 1970 at most."""
    ns = _whole(nanoseconds)
    fraction = F.pmod(ns, F.lit(1_000_000_000))
    seconds = ((ns - fraction) / F.lit(1_000_000_000)).cast("decimal(18,6)")
    moment = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds
    )
    digits = F.lpad(fraction.cast("bigint").cast("string"), 9, "0")
    return F.concat(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), F.lit("."), digits)


def format_grouped(number) -> Column:
    """``1,234,567.89``: thousands grouped, at most nine decimals, no trailing zeros."""
    number = as_column(number)
    text = F.regexp_replace(F.format_number(number, 9), r"\.?0+$", "")
    return F.when(F.abs(number) < 1e-10, "0").otherwise(text)
