"""Column expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

CALENDAR = ("hour", "day_of_week", "month", "is_weekend", "is_working_hours", "quarter", "day_of_year")

INF = float("inf")


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reading(c: str | Column) -> Column:
    """The value as DOUBLE with NaN turned into NULL."""
    return F.nanvl(as_col(c).cast("double"), F.lit(None).cast("double"))


def is_finite(c: str | Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite; never NULL."""
    c = as_col(c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(INF)), F.lit(False))


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den in DOUBLE, NULL where the divisor is 0."""
    return as_col(num).cast("double") / F.nullif(as_col(den).cast("double"), F.lit(0.0))


def ratio0(num: str | Column, den: str | Column) -> Column:
    """num / den in DOUBLE, 0.0 where the divisor is 0."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def clock_micros(ts: str | Column) -> Column:
    """Microseconds on the wall clock since 1970-01-01, whatever the session zone."""
    ts = as_col(ts)
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    sec = F.extract(F.lit("SECOND"), ts)
    return (
        day * 86_400_000_000
        + F.hour(ts).cast("long") * 3_600_000_000
        + F.minute(ts).cast("long") * 60_000_000
        + (sec * 1_000_000).cast("long")
    )


def hours_between(start: str | Column, end: str | Column) -> Column:
    return (clock_micros(end) - clock_micros(start)) / F.lit(3_600_000_000.0)


def day_block(ts: str | Column, days: int) -> Column:
    """Number of the fixed-width block of ``days`` days that holds ``ts``.

    Splitting one entity's series by this number keeps every window group
    bounded by time, however many rows the entity has.
    """
    since = F.datediff(as_col(ts).cast("date"), F.lit("1970-01-01").cast("date"))
    return F.floor(since / F.lit(days)).cast("int")


# Pandas frequency aliases accepted by the resamplers.
FREQ_UNITS = {"h": "hour", "d": "day", "t": "minute", "min": "minute", "s": "second"}


def duration(freq: str) -> str:
    """'3H' -> '3 hour'; a Spark duration such as '3 hours' passes through."""
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", freq)
    if not m:
        raise ValueError(f"not a frequency: {freq!r}")
    n, unit = m.group(1) or "1", m.group(2).lower()
    unit = FREQ_UNITS.get(unit, unit.rstrip("s"))
    if unit not in set(FREQ_UNITS.values()):
        raise ValueError(f"not a frequency: {freq!r}")
    return f"{n} {unit}"


def bin_start(ts: str | Column, freq: str) -> Column:
    """Start of the epoch-aligned bin that holds ``ts``, as TIMESTAMP_NTZ."""
    return F.window(as_col(ts).cast("timestamp_ntz"), duration(freq)).getField("start")


def calendar(ts: str | Column) -> dict[str, Column]:
    """The seven calendar features, named; types as in memory (flags are TINYINT)."""
    ts = as_col(ts)
    hour, dow = F.hour(ts), F.weekday(ts)
    weekend = dow >= 5
    return {
        "hour": hour.cast("tinyint"),
        "day_of_week": dow.cast("tinyint"),
        "month": F.month(ts).cast("tinyint"),
        "is_weekend": weekend.cast("tinyint"),
        "is_working_hours": (hour.between(8, 18) & ~weekend).cast("tinyint"),
        "quarter": F.quarter(ts).cast("tinyint"),
        "day_of_year": F.dayofyear(ts).cast("smallint"),
    }


#: Beyond every bucket of a number.
NAN_BUCKET = 1 << 30


def order_bucket(v: str | Column, per_octave: int = 64) -> Column:
    """A non-decreasing integer function of a DOUBLE; NaN, which Spark sorts last,
    has ``NAN_BUCKET``.

    ``per_octave`` buckets between each power of two and the next, mirrored
    for negative numbers, one bucket for zero. The number of buckets is fixed
    (about 272,000 at most, a few hundred in practice), so per-bucket counts
    stay small for any number of rows.
    """
    v = as_col(v).cast("double")
    # 2**-1074 is the smallest positive double and 2**1024 the overflow point.
    level = F.floor(F.least(F.log2(F.abs(v)), F.lit(1025.0)) * per_octave) + 1100 * per_octave
    known = F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * level)
    return F.when(F.isnan(v), F.lit(NAN_BUCKET)).otherwise(known).cast("int")


#: Bits of a digit of ``order_key``.
DIGIT = 23


def order_key(v: str | Column) -> Column:
    """A long that orders like the DOUBLE and is equal for equal ones: the bits of
    the number, mirrored for negative ones. NaN comes last, as in Spark.

    Its digits of ``DIGIT`` bits cut any set of numbers into buckets of bounded
    size: 2**18 first digits, and 2**23 values of each further one.
    """
    v = as_col(v).cast("double")
    a, one, least = F.abs(v), F.lit(1 << 52), F.lit(2.2250738585072014e-308)
    usual = F.when((a >= least) & (a < F.lit(float("inf"))), a).otherwise(F.lit(1.0))
    near = F.floor(F.log2(usual))
    # The logarithm may be off by one next to a power of two.
    e = F.when(F.pow(F.lit(2.0), near) > usual, near - 1).when(F.pow(F.lit(2.0), near + 1) <= usual, near + 1).otherwise(near)
    normal = (e + 1023) * one + ((usual / F.pow(F.lit(2.0), e) - 1.0) * one).cast("long")
    bits = (
        F.when(v == 0, F.lit(0))
        .when(a < least, (F.least(a, least) / F.lit(5e-324)).cast("long"))
        .when(a == F.lit(float("inf")), F.lit(2047 << 52))
        .otherwise(normal)
    ).cast("long")
    return F.when(F.isnan(v), F.lit((2047 << 52) + 1)).when(v < 0, -bits).otherwise(bits)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def first_present(columns, candidates, what: str = "column") -> str:
    """The first candidate that is present; an error names what is missing."""
    for c in candidates:
        if c in columns:
            return c
    raise ValueError(f"no {what} among {list(candidates)}; have {list(columns)}")
