"""Days, seconds and milliseconds of the statistics packages as ISO text, and from one to another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from 1970-01-01 to each family's epoch.
EPOCH_DAYS = {"stata": -3653, "sas": -3653, "spss": -141428}
#: Fixed values: (family, display format) of whole-date, date-time and time-of-day numbers and their units per second (days: 0).
UNITS = {("stata", "date"): 0, ("stata", "datetime"): 1000, ("spss", "date"): 1, ("spss", "datetime"): 1, ("sas", "date"): 0, ("sas", "datetime"): 1}
#: The last year that is written if no other is asked for, and the last ones that days and date-times can have.
LAST_YEAR, FAR_DATE, FAR_TIME = 9999, 5_700_000, 292_000


def kind_of(family: str, shown: str) -> str:
    """date, datetime, time or other, by a display format's name."""
    f = shown.lower().lstrip("%").lstrip("-")
    if family == "stata":
        if f.startswith("tc"):
            # the mask's own codes: hours, minutes and seconds, or a part of a date
            mask = shown.lstrip("%-")[2:]
            return "time" if set(mask) & set("Hh") and not set(mask) & set("CYJNnDdWwo") else "datetime"
        return "date" if f.startswith(("td", "d")) else "other"
    name = f.rstrip("0123456789.")
    if family == "spss":
        return "date" if name in ("date", "adate", "edate", "jdate", "sdate") else "datetime" if name in ("datetime", "ymdhms") else "time" if name in ("time", "dtime") else "other"
    return "date" if name in ("date", "ddmmyy", "mmddyy", "yymmdd", "e8601da", "julian") else "datetime" if name in ("datetime", "e8601dt") else "time" if name in ("time", "hhmm", "tod") else "other"


def _day_of(year: int) -> int:
    """Days from 1970-01-01 to a year's first day."""
    y = year - 1
    return 365 * y + y // 4 - y // 100 + y // 400 - 719162


def _written(day: Column) -> Column:
    """YYYY-MM-DD of a count of days from 1970; years after 9999 have their own number of digits and no sign."""
    at = F.date_add(F.lit("1970-01-01").cast("date"), day)
    year = F.year(at).cast("string")
    return F.concat_ws("-", F.when(F.length(year) < 4, F.lpad(year, 4, "0")).otherwise(year), *[F.lpad(x.cast("string"), 2, "0") for x in (F.month(at), F.day(at))])


def iso_date(days: Column, family: str, last_year: int = LAST_YEAR) -> Column:
    """YYYY-MM-DD of a count of whole days; null where it is no whole number or the year is not 0 to last_year, FAR_DATE at most."""
    at = F.when((days == F.floor(days)) & (F.abs(days) < 2_100_000_000), days).cast("int") + F.lit(EPOCH_DAYS[family])
    at = F.when((at >= _day_of(0)) & (at < _day_of(min(last_year, FAR_DATE) + 1)), at)
    return F.when(at.isNotNull(), _written(at))


def iso_datetime(value: Column, family: str, last_year: int = LAST_YEAR) -> Column:
    """YYYY-MM-DD HH:MM:SS[.ffffff] of a date-time number, without zeros at the fraction's end; null where finer than a microsecond
    or the year is not 0 to last_year, FAR_TIME at most."""
    units = UNITS[(family, "datetime")]
    micros = value * F.lit(1_000_000.0 / units)
    whole = F.when((micros == F.floor(micros)) & (F.abs(micros) < 4e17), micros).cast("long")
    # beyond that the product is coarser than the number: whole units and the rest apart
    rest = (value - F.floor(value)) * F.lit(1_000_000.0 / units)
    whole = F.when((F.abs(micros) >= 4e17) & (F.abs(micros) < 9.2e18), F.when(rest == F.floor(rest), F.floor(value) * F.lit(1_000_000 // units) + rest.cast("long"))).otherwise(whole) + F.lit(EPOCH_DAYS[family] * 86_400_000_000)
    whole = F.when((whole >= _day_of(0) * 86_400_000_000) & (whole < _day_of(min(last_year, FAR_TIME) + 1) * 86_400_000_000), whole)
    rest = F.pmod(whole, F.lit(86_400_000_000))
    day = F.call_function("div", whole - rest, F.lit(86_400_000_000))
    seconds, fraction = F.floor(rest / 1_000_000).cast("long"), rest % 1_000_000
    clock = F.concat_ws(":", *[F.lpad(x.cast("string"), 2, "0") for x in (F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)])
    tail = F.regexp_replace(F.lpad(fraction.cast("string"), 6, "0"), "0+$", "")
    return F.when(whole.isNotNull(), F.concat(_written(day.cast("int")), F.lit(" "), clock, F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("."), tail))))


def recounted(value: Column, old: tuple[str, str], new: tuple[str, str]) -> Column:
    """A date or date-time number of one family and kind as that of another: other epoch, other unit."""
    seconds = value * F.lit(86400.0) if UNITS[old] == 0 else value / F.lit(float(UNITS[old]))
    seconds = seconds + F.lit((EPOCH_DAYS[old[0]] - EPOCH_DAYS[new[0]]) * 86400.0)
    return seconds / F.lit(86400.0) if UNITS[new] == 0 else seconds * F.lit(float(UNITS[new]))


def clock(seconds: Column) -> Column:
    """HH:MM:SS of a time of day in whole seconds; hours may exceed 24."""
    s = F.floor(F.abs(seconds)).cast("long")
    h = F.floor(s / 3600).cast("long")
    return F.concat(F.when(seconds < 0, F.lit("-")).otherwise(F.lit("")), F.lpad(h.cast("string"), F.greatest(F.length(h.cast("string")), F.lit(2)), "0"), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
