"""A/B assignment, scored users, alerts, model registry and monitoring aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ab_bucket
from .quantiles import exact_quantiles

CHAMPION_SHARE = 0.90
DECISION = 0.5
ALERT = 0.7
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


def assign(users: DataFrame, champion_share: float = CHAMPION_SHARE) -> DataFrame:
    """``users`` with ``ab_group``: champion if the bucket of the id is below the share."""
    return users.withColumn("ab_group", F.when(ab_bucket(F.col("user_id")) < champion_share, "champion").otherwise("challenger"))


def split_stats(users: DataFrame, champion_share: float = CHAMPION_SHARE) -> DataFrame:
    """One row: users in each group and the champion's share (0 without users)."""
    champion = F.col("ab_group") == "champion"
    counts = assign(users, champion_share).agg(F.count("*").alias("total"), F.count_if(champion).alias("champion"), F.count_if(~champion).alias("challenger"))
    return counts.withColumn("champion_pct", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("champion") / F.col("total")))


def upsert_scores(scores: DataFrame) -> DataFrame:
    """The last score of each (tenant, user): a partial maximum by time, then by score."""
    last = scores.groupBy("tenant", "user_id").agg(F.max(F.struct("scored_ms", "score")).alias("last"))
    return last.select("tenant", "user_id", "last.score", "last.scored_ms")


def alerts(scores: DataFrame, tenant: str, threshold: float = ALERT, limit: int = 100) -> DataFrame:
    """Users at or above the threshold, the highest first, equal scores by user; a top-k report."""
    own = scores.filter((F.col("tenant") == tenant) & (F.col("score") >= threshold))
    return own.orderBy(F.desc("score"), "user_id").limit(limit).select("user_id", F.round("score", 4).alias("churn_probability"))


def total_scored(scores: DataFrame) -> DataFrame:
    return scores.groupBy("tenant").agg(F.countDistinct("user_id").alias("total_scored"))


def refresh_counts(features: DataFrame, wanted: DataFrame, scores: DataFrame, threshold: float = ALERT) -> DataFrame:
    """One row: of the wanted users how many have features, how many lack them, how many alert."""
    asked = wanted.select("user_id").distinct()
    known = features.select("user_id", F.lit(True).alias("known")).distinct()
    high = scores.filter(F.col("score") >= threshold).select("user_id", F.lit(True).alias("high")).distinct()
    joined = asked.join(known, "user_id", "left").join(high, "user_id", "left")
    return joined.agg(F.count("known").alias("scored"), F.count_if(F.col("known").isNull()).alias("failed"), F.count_if(F.col("known") & F.col("high")).alias("alerts"))


def top_contributions(names: Column, values: Column, k: int = 3) -> Column:
    """The ``k`` largest contributions by size, ties in the order of the columns, with direction."""
    entries = F.zip_with(names, values, lambda n, v: F.struct(n.alias("feature"), v.alias("value")))
    keyed = F.transform(entries, lambda e, i: F.struct((-F.abs(e["value"])).alias("size"), i.alias("place"), e.alias("e")))
    best = F.slice(F.array_sort(keyed), 1, k)
    return F.transform(
        best,
        lambda x: F.struct(
            x["e"]["feature"].alias("feature"),
            F.round(x["e"]["value"], 4).alias("shap_value"),
            F.when(x["e"]["value"] > 0, "increases_churn").otherwise("decreases_churn").alias("direction"),
        ),
    )


def alert_payloads(scored: DataFrame, threshold: float = ALERT) -> DataFrame:
    """(user_id, payload): the JSON message of each alert. Needs score, model_version, ab_group, top_features and alerted_at."""
    payload = F.struct(
        F.lit("churn_alert").alias("event"),
        "user_id",
        F.col("score").alias("churn_probability"),
        (F.col("score") >= DECISION).alias("churn_prediction"),
        "model_version",
        "ab_group",
        "top_features",
        F.col("alerted_at").alias("timestamp"),
    )
    return scored.filter(F.col("score") >= threshold).select("user_id", F.to_json(payload).alias("payload"))


def registry_roles(versions: DataFrame) -> DataFrame:
    """For each model its highest version as champion and the one before (or the same) as challenger."""
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("version")))  # a model has few versions
    top = versions.withColumn("n", rank).filter("n <= 2")
    return top.groupBy("model").agg(F.max("version").alias("champion"), F.min("version").alias("challenger"))


def risk_bands(scores: DataFrame) -> DataFrame:
    """One row: users of high (0.70 and more), medium and low (under 0.30) risk, mean and highest score."""
    s = F.col("score")
    return scores.agg(
        F.count_if(s >= 0.70).alias("high"),
        F.count_if((s >= 0.30) & (s < 0.70)).alias("medium"),
        F.count_if(s < 0.30).alias("low"),
        F.round(F.avg(s), 6).alias("mean_score"),
        F.max(s).alias("max_score"),
    )


def prediction_counters(predictions: DataFrame) -> DataFrame:
    """Predictions by model version, group and outcome."""
    return predictions.groupBy("model_version", "ab_group", (F.col("score") >= DECISION).alias("churn_prediction")).agg(F.count("*").alias("predictions"))


def cumulative_histogram(rows: DataFrame, value: str, by: list[str], bounds: tuple[float, ...] = LATENCY_BUCKETS) -> DataFrame:
    """(by..., le, n): rows at or below each bound, and at last all rows (le null)."""
    counts = rows.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("*").alias("total"))
    pairs = [F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("total").alias("n")))
    return counts.select(*by, F.explode(F.array(*pairs)).alias("p")).select(*by, "p.le", "p.n")


def rate_per_window(rows: DataFrame, ts: str, window: str = "1 day") -> DataFrame:
    """Rows and rows per second of each window."""
    grouped = rows.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n"))
    seconds = F.unix_micros("w.end") - F.unix_micros("w.start")
    return grouped.select(F.col("w.start").alias("window_start"), "n", (F.col("n") * F.lit(1_000_000.0) / seconds).alias("per_second"))


def quantiles(rows: DataFrame, value: str, by: list[str], exact: bool = True) -> DataFrame:
    """p50, p95 and p99 by group, of few groups; ``exact=False`` is one pass, with ranks off by at most 1 in 10,000."""
    points = (0.5, 0.95, 0.99)
    if exact:
        return exact_quantiles(rows, value, by, points).withColumnsRenamed({f"q{i}": f"p{int(p * 100)}" for i, p in enumerate(points)})
    return rows.groupBy(*by).agg(*[F.percentile_approx(value, F.lit(p), F.lit(10000)).alias(f"p{int(p * 100)}") for p in points])
