"""Calendar expressions used by every feature table."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Month codes as they stand in log file names and in the month column.
MONTH_CODES = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]

# Meteorological seasons and their months.
SEASONS = {"DJF": [12, 1, 2], "MAM": [3, 4, 5], "JJA": [6, 7, 8], "SON": [9, 10, 11]}

# Fixed value: mean length of a year in days, the period of the day-of-year cycle.
DAYS_PER_YEAR = 365.25


def month_number(month: Column) -> Column:
    """Month as an integer, from a number or from a three-letter code; anything else is null."""
    codes = F.create_map(*[F.lit(v) for i, code in enumerate(MONTH_CODES, 1) for v in (code, i)])
    text = F.upper(F.trim(month.cast("string")))
    number = text.try_cast("int")
    return F.when(number.between(1, 12), number).otherwise(F.try_element_at(codes, text))


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """Date of a year, month and day; null when there is no such day."""
    parts = [p.cast("int").cast("string") for p in (year, month, day)]
    # concat_ws would skip a missing part, plain concat keeps the null
    text = F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2])
    return F.try_to_date(text, "yyyy-M-d")


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def parse_time(text: Column, strict: bool = False, fmt: str | None = None) -> Column:
    """Timestamp without zone from text; bad text fails when strict and is null otherwise."""
    if strict:
        return F.to_timestamp_ntz(text, F.lit(fmt)) if fmt else text.cast("timestamp_ntz")
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz") if fmt else text.try_cast("timestamp_ntz")


def floor_to_day(time: Column) -> Column:
    return time.cast("date")


def next_month_number(month: Column) -> Column:
    return (month % 12 + 1).cast("int")


def season(month: Column) -> Column:
    """Season label of a month number."""
    label = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        label = F.when(month.isin(months), F.lit(name)).otherwise(label)
    return label


def cycle_sin(position: Column, period: float) -> Column:
    return F.sin(2 * F.pi() * position / F.lit(float(period)))


def cycle_cos(position: Column, period: float) -> Column:
    return F.cos(2 * F.pi() * position / F.lit(float(period)))


def month_short_name(date: Column) -> Column:
    return F.date_format(date, "MMM")


def month_long_name(date: Column) -> Column:
    return F.date_format(date, "MMMM")


def climatology_row_label(position: Column) -> Column:
    """Label of row 1..12 of a climatology as month name, later rows as Extra 1, Extra 2, ..."""
    name = F.date_format(F.make_date(F.lit(2001), F.least(position, F.lit(12)), F.lit(1)), "MMMM")
    return F.when(position <= 12, name).otherwise(F.concat(F.lit("Extra "), (position - 12).cast("string")))
