"""The data contract as column expressions: errors of a row, split, statistics, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import COUNTRY_PATTERN, DEVICE_TYPES, EVENT_COLUMNS, EVENT_TYPES, REQUIRED, TS_MAX_MS, TS_MIN_MS


def _shown(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("None"))


def _message(prefix: str, column: str, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), _shown(column), F.lit(suffix))


def checks() -> list[Column]:
    """One expression for each check, in order: its message, or null if the row passes."""
    found = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"expect_column_values_to_not_be_null: '{c}'")) for c in REQUIRED]
    for column, values in (("event_type", EVENT_TYPES), ("device_type", DEVICE_TYPES)):
        inside = F.coalesce(F.col(column).isin(*values), F.lit(False))
        found.append(F.when(~inside, _message(f"expect_column_values_to_be_in_set: {column}='", column, "'")))
    found.append(F.when(~F.col("timestamp_ms").between(TS_MIN_MS, TS_MAX_MS), _message("expect_column_values_to_be_between: timestamp_ms=", "timestamp_ms")))
    found.append(F.when(~F.coalesce(F.col("country_code").rlike(COUNTRY_PATTERN), F.lit(False)), _message("expect_column_values_to_match_regex: country_code='", "country_code", "'")))
    unpaid = (F.col("event_type") == "PURCHASE") & (F.col("amount_cents").isNull() | (F.col("amount_cents") <= 0))
    found.append(F.when(unpaid, _message("conditional_expectation: PURCHASE requires amount_cents > 0, got ", "amount_cents")))
    return found


def with_errors(events: DataFrame) -> DataFrame:
    """``events`` with ``errors``, the messages of all failed checks; empty if the row is valid."""
    return events.withColumn("errors", F.array_compact(F.array(*checks())))


def split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows without ``errors``, and invalid rows with them."""
    marked = with_errors(events)
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def statistics(events: DataFrame) -> DataFrame:
    """One row: total, valid, invalid and the share that passes (1 if there are no rows)."""
    valid = F.size("errors") == 0
    counts = with_errors(events).agg(F.count("*").alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"))
    return counts.withColumn("pass_rate", F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("valid") / F.col("total")))


def quarantine(invalid: DataFrame, processed_ms: int, reason: str = "validation_failure") -> DataFrame:
    """Rows of the quarantine table; ``ingestion_date`` is null unless the rows have it."""
    date = F.col("ingestion_date") if "ingestion_date" in invalid.columns else F.lit(None).cast("string")
    return invalid.select(
        *EVENT_COLUMNS,
        F.lit(reason).alias("quarantine_reason"),
        F.to_json("errors").alias("validation_errors"),
        F.lit(processed_ms).cast("long").alias("silver_processed_ms"),
        date.alias("ingestion_date"),
    )
