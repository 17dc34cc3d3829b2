"""Date building and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def event_datetime(year, month, day, hour, minute, second) -> Column:
    """Timestamp of an event (Q23).

    Year null or <= 0 -> null; missing or 0 month/day -> 1, missing hour/minute
    /second -> 0; clamp to 1-12, 1-31, 0-23, 0-59, 0-59.9; seconds truncated;
    an impossible date (31 Feb) -> null.
    """
    y = _c(year)
    mo = _clamp(F.coalesce(F.when(_c(month) != 0, _c(month)), F.lit(1)), 1, 12)
    d = _clamp(F.coalesce(F.when(_c(day) != 0, _c(day)), F.lit(1)), 1, 31)
    h = _clamp(F.coalesce(_c(hour), F.lit(0)), 0, 23)
    mi = _clamp(F.coalesce(_c(minute), F.lit(0)), 0, 59)
    s = F.floor(_clamp(F.coalesce(_c(second).cast("double"), F.lit(0.0)), 0.0, 59.9)).cast("int")
    ts = F.try_make_timestamp_ntz(y, mo, d, h, mi, s)
    return F.when(y.isNotNull() & (y > 0) & (y <= 9999), ts)


def partial_date(year, month, day) -> Column:
    """``Y[-MM[-DD]]``; no (or 0) year -> 'Unknown'. Built as text so BC years work."""
    y, m, d = _c(year), _c(month), _c(day)
    mm = F.when(m.isNotNull() & (m != 0), F.concat(F.lit("-"), F.lpad(m.cast("string"), 2, "0")))
    dd = F.when(d.isNotNull() & (d != 0), F.concat(F.lit("-"), F.lpad(d.cast("string"), 2, "0")))
    return F.when(y.isNull() | (y == 0), F.lit("Unknown")).otherwise(
        F.concat(y.cast("string"), F.coalesce(mm, F.lit("")), F.coalesce(dd, F.lit(""))))


def tsunami_date(year, month, day) -> Column:
    """``D Mon Y`` with missing parts left out; no (or 0) year -> 'Unknown'."""
    y, m, d = _c(year), _c(month), _c(day)
    names = F.array(*[F.lit(x) for x in MONTHS])
    mon = F.when(m.between(1, 12), F.element_at(names, m.cast("int")))
    dd = F.when(d.isNotNull() & (d != 0), d.cast("string"))
    return F.when(y.isNull() | (y == 0), F.lit("Unknown")).otherwise(
        F.concat_ws(" ", dd, mon, y.cast("string")))


def iso_date(ts) -> Column:
    """UTC calendar date of a timestamp as YYYY-MM-DD."""
    return F.date_format(_c(ts), "yyyy-MM-dd")


def iso_text(ts) -> Column:
    """ISO text of a timestamp as Python writes it: microseconds only where there are any; null -> ''."""
    t = _c(ts)
    micros = F.date_format(t, "SSSSSS")
    text = F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)))
    return F.coalesce(text, F.lit(""))
