"""Scores of runs and statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def score_routes(events: DataFrame, penalties: DataFrame, by: str = "run_key") -> DataFrame:
    """by, score_route, score_penalty, score_composed, num_infractions, status.

    events: by, kind, percentage, completion, reached, failure. penalties: kind, value, direction (fixed, decreases, increases,
    unused). A logarithm-free product: penalties are positive, so the sum of logarithms would do, but product() is exact."""
    p, x = F.col("value"), F.col("percentage") / 100
    factor = (
        F.when(F.col("direction") == "fixed", p).when(F.col("direction") == "decreases", 1 - (1 - p) * (1 - x))
        .when(F.col("direction") == "increases", 1 - (1 - p) * x).otherwise(1.0)
    )
    rows = events.join(F.broadcast(penalties), "kind", "left").withColumn("_f", F.coalesce(factor, F.lit(1.0)))
    out = rows.groupBy(by).agg(
        F.product("_f").alias("_p"), F.max("completion").alias("_c"), F.count("kind").alias("num_infractions"),
        F.bool_or("reached").alias("_reached"), F.min("failure").alias("_failure"),
    )
    status = F.when(F.col("_reached"), F.when(F.col("num_infractions") > 0, "Completed").otherwise("Perfect")).otherwise(F.concat(F.lit("Failed"), F.coalesce(F.concat(F.lit(" - "), "_failure"), F.lit(""))))
    return out.select(by, F.round("_c", 3).alias("score_route"), F.round("_p", 3).alias("score_penalty"), F.round(F.greatest(F.col("_c") * F.col("_p"), F.lit(0.0)), 3).alias("score_composed"), "num_infractions", status.alias("status"))


def global_stats(routes: DataFrame, total: int, by: list[str] | None = None) -> DataFrame:
    """Means over the planned routes, deviation, kilometres driven, infractions per kilometre, worst status, failed routes, entry status, eligibility."""
    km = F.sum(F.col("route_length") / 1000 * F.col("score_route") / 100)
    composed = F.sum(F.col("score_composed").cast("decimal(18,3)")).cast("double")  # of three digits: exact in any order
    failed = F.col("status").contains("Failed")
    order = F.when(failed, 2).when(F.col("status") == "Perfect", 0).otherwise(1)
    out = routes.groupBy(*(by or [])).agg(
        (F.sum("score_route") / total).alias("mean_route"), (composed / total).alias("mean_composed"),
        composed.alias("_s"), F.sum(F.col("score_composed") * F.col("score_composed")).alias("_q"), F.count("*").alias("n_routes"),
        km.alias("_km"), F.sum("num_infractions").alias("_inf"), F.sum("offlane_km").alias("offlane_km"), F.max(order).alias("_worst"), F.count(F.when(failed, 1)).alias("n_exceptions"),
        F.bool_or(F.col("status").contains("Simulation crashed")).alias("_crashed"), F.bool_or(F.col("status").contains("sensors were invalid")).alias("_rejected"),
    )
    m = F.col("mean_composed")
    spread = F.col("_q") - 2 * m * F.col("_s") + F.col("n_routes") * m * m
    entry = F.when(F.col("_rejected"), "Rejected").when(F.col("_crashed"), "Crashed").otherwise("Finished")
    driven = F.greatest("_km", F.lit(0.001))
    return out.select(
        *(by or []), "n_routes", F.round("mean_route", 3).alias("mean_route"), F.round("mean_composed", 3).alias("mean_composed"),
        (F.round(F.sqrt(F.greatest(spread, F.lit(0.0)) / (total - 1)), 3) if total > 1 else F.lit(0.0)).alias("std_composed"),
        driven.alias("km_driven"), F.round(F.col("_inf") / driven, 3).alias("infractions_per_km"), F.round("offlane_km", 3).alias("offlane_km"),
        F.when(F.col("_worst") == 2, "Failed").when(F.col("_worst") == 1, "Completed").otherwise("Perfect").alias("status"), "n_exceptions",
        entry.alias("entry_status"), (entry == "Finished").alias("eligible"),
    )


def exceptions(routes: DataFrame, key: str) -> DataFrame:
    return routes.where(F.col("status").contains("Failed")).select(key, "status")


def validate_stats(values: Column, entry_status: Column, progress: Column, n_records: Column, started: Column) -> Column:
    """The first thing wrong with a statistics document; null if nothing is."""
    crashed = entry_status == "Crashed"
    return (
        F.when(values.isNull() | (F.size(values) <= 0), "no values").when(entry_status == "Started", "still started")
        .when(~crashed & (n_records == 0), "no records").when(progress.isNull() | (F.size(progress) <= 0), "no progress")
        .when(~crashed & ((F.get(progress, F.lit(0)) != F.get(progress, F.lit(1))) | (F.get(progress, F.lit(0)) != n_records)), "progress differs")
        .when(started, "record with missing data")
    )
