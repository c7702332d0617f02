"""Raw events to cleaned events: classify, discard, deduplicate, validate, quarantine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import event_date, nan_to_null
from ..schemas import EVENT_COLUMNS
from . import quality
from .watermark import WatermarkConfig, classify, first_per_key


@dataclass(frozen=True)
class SilverOptions:
    watermark: WatermarkConfig = WatermarkConfig()
    arrival: str = "arrival_seq"
    validate_late: bool = False
    canonicalize: bool = False


def canonicalize_enums(events: DataFrame) -> DataFrame:
    """Upper-case event types, and UNKNOWN for a device outside the contract called web."""
    return events.withColumns({"event_type": F.upper("event_type"), "device_type": F.when(F.lower("device_type") == "web", F.lit("UNKNOWN")).otherwise(F.col("device_type"))})


def outcomes(bronze: DataFrame, options: SilverOptions = SilverOptions()) -> DataFrame:  # noqa: B008
    """Every row of ``bronze`` with ``outcome`` (silver, late, quarantined, duplicate, discarded) and ``errors``.

    Discards never enter deduplication, and an invalid first copy hides a valid second one. Late
    rows skip validation unless ``validate_late``.
    """
    rows = canonicalize_enums(bronze) if options.canonicalize else bronze
    marked = classify(rows, options.watermark, options.arrival)
    marked = quality.with_errors(marked)
    live = marked.filter("watermark_classification <> 'discard'")
    first = live.groupBy(F.col("event_id").alias("_id")).agg(F.min(F.struct(options.arrival, "timestamp_ms")).alias("_first"))
    joined = marked.join(first, marked["event_id"].eqNullSafe(first["_id"]), "left")
    # Rows of one id that arrived together are few; all but one of them are duplicates. Ties as in ``first_per_key``.
    ties = [c for c in marked.columns if c not in ("event_id", options.arrival, "timestamp_ms", "errors")]
    together = Window.partitionBy("event_id", options.arrival, "timestamp_ms").orderBy(*ties)
    joined = joined.withColumn("_nth", F.row_number().over(together))
    is_first = (F.struct(F.col(options.arrival), F.col("timestamp_ms")) == F.col("_first")) & (F.col("_nth") == 1)
    checked = F.lit(options.validate_late) | (F.col("watermark_classification") == "on_time")
    outcome = (
        F.when(F.col("watermark_classification") == "discard", "discarded")
        .when(~is_first, "duplicate")
        .when(checked & (F.size("errors") > 0), "quarantined")
        .when(F.col("watermark_classification") == "late", "late")
        .otherwise("silver")
    )
    return joined.withColumn("outcome", outcome).drop("_id", "_first", "_nth")


def to_silver(events: DataFrame, processed_ms: int) -> DataFrame:
    return events.select(
        *EVENT_COLUMNS,
        F.lit(processed_ms).cast("long").alias("silver_processed_ms"),
        "watermark_classification",
        event_date(F.col("timestamp_ms")).alias("event_date"),
    )


def checked_rows(bronze: DataFrame, options: SilverOptions = SilverOptions()) -> DataFrame:  # noqa: B008
    """The first live row of each event with ``errors`` and ``quarantined``: one plan for both outputs."""
    rows = canonicalize_enums(bronze) if options.canonicalize else bronze
    if isinstance(rows.schema["amount_cents"].dataType, T.FractionalType):  # amounts from array libraries
        rows = rows.withColumn("amount_cents", nan_to_null(F.col("amount_cents")).try_cast("long"))
    marked = classify(rows, options.watermark, options.arrival)
    live = first_per_key(marked.filter("watermark_classification <> 'discard'"), "event_id", options.arrival, ("timestamp_ms",))
    checked = quality.with_errors(live)
    bad = F.size("errors") > 0
    if not options.validate_late:
        bad = bad & (F.col("watermark_classification") == "on_time")
    return checked.withColumn("quarantined", bad)


def _outputs(checked: DataFrame, processed_ms: int) -> tuple[DataFrame, DataFrame]:
    good = checked.filter(~F.col("quarantined")).drop("errors", "quarantined")
    # The silver candidate has no ingestion date.
    invalid = checked.filter("quarantined").drop("quarantined", "ingestion_date")
    return to_silver(good, processed_ms), quality.quarantine(invalid, processed_ms)


def bronze_to_silver(bronze: DataFrame, processed_ms: int, options: SilverOptions = SilverOptions()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The rows of the silver table (on time and late) and of the quarantine table.

    Writing both from here runs the steps twice; ``write_silver`` runs them once.
    """
    return _outputs(checked_rows(bronze, options), processed_ms)


def write_silver(bronze: DataFrame, root: str, processed_ms: int, options: SilverOptions = SilverOptions()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Both outputs, read back from one table below ``root`` that is written once, partitioned by ``quarantined``."""
    checked = checked_rows(bronze, options)
    checked.write.mode("overwrite").partitionBy("quarantined").parquet(f"{root}/checked")
    return _outputs(bronze.sparkSession.read.schema(checked.schema).parquet(f"{root}/checked"), processed_ms)


def outcome_counts(bronze: DataFrame, options: SilverOptions = SilverOptions()) -> DataFrame:  # noqa: B008
    """One row of counters: total, on_time, late, discarded, duplicate, quarantined, silver."""
    marked = outcomes(bronze, options)
    is_ = lambda value: F.count_if(F.col("outcome") == value)
    return marked.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("watermark_classification") == "on_time").alias("on_time"),
        F.count_if(F.col("watermark_classification") == "late").alias("late"),
        is_("discarded").alias("discarded"),
        is_("duplicate").alias("duplicate"),
        is_("quarantined").alias("quarantined"),
        F.count_if(F.col("outcome").isin("silver", "late")).alias("silver"),
    )
