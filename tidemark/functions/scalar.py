"""Time, rounding, hashing and clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_date(ts_ms: Column) -> Column:
    """The UTC date of epoch milliseconds, as yyyy-MM-dd."""
    return F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd")


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounding of the scaled value to even, as array libraries do it; SQL's ROUND differs on ties."""
    scale = 10**digits
    return F.rint(x * F.lit(float(scale))) / F.lit(float(scale)) if digits else F.rint(x)


def nan_to_null(x: Column) -> Column:
    """Null for NaN, which array libraries write for a missing number."""
    return F.when(~F.isnan(x), x)


def seems_absent(text: Column) -> Column:
    """Whether the text of a JSON value may be that of one that counts as absent: its type must tell (``json_text``)."""
    return text.rlike(r"^(|false|-?0(\.0*)?([eE][+-]?[0-9]+)?)$")


def json_text(value: Column) -> Column:
    """The text of a JSON value (a variant), or null where it counts as absent: null, false, the number 0, an empty text.

    The text "0" is a value like any other.
    """
    kind, text = F.schema_of_variant(value), value.cast("string")
    number = F.when(F.coalesce(text.try_cast("double") != 0, F.lit(True)), text)
    return F.when(kind == "STRING", F.nullif(text, F.lit(""))).when(kind == "BOOLEAN", F.nullif(text, F.lit("false"))).otherwise(number)


def parse_ts_ms(value: Column, now_ms: Column | int) -> Column:
    """Epoch milliseconds of a text: null is now; a number below 1e12 is seconds; else an ISO time, UTC unless it says.

    Null for anything else, such as NaN or a number beyond 64 bits.
    """
    text = value.cast("string")
    number = text.try_cast("double")
    parsed = F.unix_millis(F.try_to_timestamp(text))
    return F.when(value.isNull(), F.lit(now_ms)).when(number < 1e12, (number * 1000).try_cast("long")).when(number.isNotNull(), number.try_cast("long")).otherwise(parsed)


def money_to_cents(value: Column) -> Column:
    """Cents of an amount, truncated toward zero; null if it is no number that fits."""
    return (value.try_cast("double") * 100).try_cast("long")


def clean_amount(text: Column) -> Column:
    return F.regexp_replace(text.cast("string"), "[,$]", "")


def safe_pct(part: Column, whole: Column) -> Column:
    """100 part / whole, to two digits; 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * part / whole, 2))


def ab_bucket(user_id: Column) -> Column:
    """A number in [0, 1] from the first 8 hexadecimal digits of the MD5 of the id."""
    return F.conv(F.substring(F.md5(user_id), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)


def days_between_floor(later: Column, earlier: Column) -> Column:
    """Whole days from ``earlier`` to ``later``, rounded toward minus infinity."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0))


def iso_minus_days(date: Column, days: int) -> Column:
    return F.date_format(F.date_sub(F.to_date(date), days), "yyyy-MM-dd")


def first_alias(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    """The column that answers to the first alias that any column has, whatever its case."""
    by = {c.lower(): c for c in columns}
    return next((by[a] for a in aliases if a in by), None)


def impute(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Every feature in order, absent or null as 0, after the other columns."""
    rest = [c for c in df.columns if c not in features]
    return df.select(*rest, *(F.coalesce(F.col(f), F.lit(0)).alias(f) if f in df.columns else F.lit(0).cast("long").alias(f) for f in features))
