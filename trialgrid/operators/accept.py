"""Acceptance of runs against goldens, replicate statistics, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import config as C
from .ordered import first_rows

NAMES = ("A1", "A2", "A3", "A4")


def replicate_stats(df: DataFrame, key: str, floor: float = 1.0, k: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(key, n, lo, hi, median, spread, statuses, agreed; one row with max_spread and tolerance = max(floor, k x max_spread))."""
    per = df.groupBy(key).agg(
        F.count("*").alias("n"), F.min("driving_score").alias("lo"), F.max("driving_score").alias("hi"), F.median("driving_score").alias("median"),
        F.array_join(F.array_sort(F.collect_set("status")), "|").alias("statuses"), F.countDistinct("status").alias("_s"),
    ).withColumns({"spread": F.col("hi") - F.col("lo"), "agreed": F.col("_s") == 1}).drop("_s")
    tolerance = per.agg(F.max("spread").alias("max_spread")).withColumn("tolerance", F.greatest(F.lit(floor), F.lit(k) * F.col("max_spread")))
    return per, tolerance


def build_golden(replicates: DataFrame, key: str, floor: float = 1.0, k: float = 2.0) -> DataFrame:
    """key, status, driving_score, ds_spread, tolerance; refuses if a replicate failed or replicates disagree."""
    per, tolerance = replicate_stats(replicates, key, floor, k)
    bad = replicates.where(~F.coalesce(F.col("passed"), F.lit(False))).limit(1)
    if not bad.isEmpty() or not per.where(~F.col("agreed")).limit(1).isEmpty():
        raise ValueError("a replicate failed, or replicates of a route disagree")
    return per.crossJoin(F.broadcast(tolerance)).select(key, F.col("statuses").alias("status"), F.col("median").alias("driving_score"), F.col("spread").alias("ds_spread"), "tolerance")


def assert_golden(runs: DataFrame, golden: DataFrame, key: str, tolerance: float) -> DataFrame:
    """runs (key, status, driving_score) with status_ok, delta, score_ok."""
    g = golden.select(key, F.col("status").alias("_s"), F.col("driving_score").alias("_d"))
    out = runs.join(g, key, "left").withColumn("delta", F.abs(F.col("driving_score") - F.col("_d")))
    return out.withColumns({"status_ok": F.col("status").eqNullSafe(F.col("_s")), "score_ok": F.coalesce(F.col("delta") <= tolerance, F.lit(False))}).drop("_s", "_d")


def prior_deltas(golden: DataFrame, prior: DataFrame, key: str, tolerance: float) -> DataFrame:
    """golden (key, driving_score) with prior_delta, its distance from an earlier observation (null without one), and drifted. For information: nothing fails by it."""
    out = golden.join(prior.select(key, F.col("driving_score").alias("_prior")), key, "left").withColumn("prior_delta", F.col("driving_score") - F.col("_prior"))
    return out.withColumn("drifted", F.coalesce(F.abs("prior_delta") > tolerance, F.lit(False))).drop("_prior")


def assess(split: DataFrame, runs: DataFrame, golden: DataFrame | None, tolerance: float = 1.0) -> DataFrame:
    """path, A1 to A4 as pass, fail or skip. runs: path, found, payload, agent_type, status, driving_score.

    What is not there fails: no result, no payload, no id. Only a missing golden bundle skips, and only A4."""
    out = split.join(runs, "path", "left")
    if golden is not None:
        out = out.join(golden.select("path", F.col("status").alias("_gs"), F.col("driving_score").alias("_gd")), "path", "left")
    else:
        out = out.withColumns({"_gs": F.lit(None).cast("string"), "_gd": F.lit(None).cast("double")})
    found = F.coalesce(F.col("found"), F.lit(False))
    payload = F.coalesce(F.col("payload"), F.lit(False))
    say = lambda ok: F.when(found & F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")
    a1 = say(payload & (F.col("agent_type") != "unknown") & (F.col("agent_type") == F.col("blueprint")))
    a3 = say(F.when(F.col("_gs").isNotNull(), F.col("status") == F.col("_gs")).otherwise(F.col("status").isin(*C.COMPLETED)))
    a4 = say(F.abs(F.col("driving_score") - F.col("_gd")) <= tolerance)
    if golden is None:
        a4 = F.when(found, "skip").otherwise("fail")
    return out.withColumns({"A1": a1, "A2": say(payload), "A3": a3, "A4": a4}).select(*split.columns, *NAMES)


def tally(assessed: DataFrame) -> DataFrame:
    """assertion, n_pass, n_fail, n_skip. One pass over the routes."""
    rows = assessed.select(F.explode(F.array(*[F.struct(F.lit(n).alias("assertion"), F.col(n).alias("v")) for n in NAMES])).alias("x")).select("x.*")
    return rows.groupBy("assertion").agg(*[F.count(F.when(F.col("v") == v, 1)).alias(f"n_{v}") for v in ("pass", "fail", "skip")])


def verdict(assessed: DataFrame, golden_there: bool) -> DataFrame:
    """One row: verdict and exit code (0 pass, 1 fail, 3 inconclusive)."""
    bad = F.array_contains(F.array(*NAMES), "fail")
    out = assessed.agg(F.coalesce(F.bool_or(bad), F.lit(True)).alias("_bad"))
    word = F.when(F.col("_bad"), "FAIL").otherwise("PASS" if golden_there else "INCONCLUSIVE")
    return out.select(word.alias("verdict")).withColumn("exit_code", F.when(F.col("verdict") == "FAIL", 1).when(F.col("verdict") == "PASS", 0).otherwise(3))


def failed_routes(assessed: DataFrame) -> DataFrame:
    """The routes of which an assertion failed, and which (problem)."""
    bad = F.array_contains(F.array(*NAMES), "fail")
    return assessed.where(bad).withColumn("problem", F.array_join(F.filter(F.array(*[F.when(F.col(n) == "fail", n) for n in NAMES]), lambda n: n.isNotNull()), ","))


def acceptance_report(assessed: DataFrame, by: list[str], shown: int = 20) -> DataFrame:
    """by, n_routes, n_failed and the first failed routes in order of path, each with its failed assertions; `failed_routes` has all of them."""
    bad = F.array_contains(F.array(*NAMES), "fail")
    counts = assessed.groupBy(*by).agg(F.count("*").alias("n_routes"), F.count(F.when(bad, 1)).alias("n_failed"))
    first = first_rows(failed_routes(assessed), by, ["path", "problem"], shown)
    listed = first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "problem"))), lambda r: F.concat(r["path"], F.lit(" "), r["problem"])), "|").alias("failed"))
    return counts.join(listed, by, "left").withColumn("failed", F.coalesce("failed", F.lit("")))
