"""Size-shift classes against reference clusters, and classes by ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import config as C

DIMS = ("l", "w", "h")


def _worst(scores: dict[str, Column]) -> Column:
    """The dimension of the largest score; of equal ones the first."""
    top = F.greatest(*scores.values())
    out = F.lit(DIMS[-1])
    for d in reversed(DIMS[:-1]):
        out = F.when(scores[d] == top, d).otherwise(out)
    return out


def classify_static(df: DataFrame, anchor: dict[str, float] = C.STATIC_ANCHOR, share: float = 0.20) -> DataFrame:
    """delta per dimension, delta_max, worst, headroom (negative: overshoot), verdict."""
    delta = {d: F.abs(F.col(d) - F.lit(anchor[d])) / F.lit(anchor[d]) for d in DIMS}
    top = F.greatest(*delta.values())
    return df.withColumns({**{f"delta_{d}": c for d, c in delta.items()}, "delta_max": top, "worst": _worst(delta), "headroom": F.lit(share) - top, "verdict": F.when(top <= share, "visual_shift").otherwise("geometric_shift")})


def valid_range(anchor: dict[str, float] = C.STATIC_ANCHOR, share: float = 0.20) -> dict[str, tuple[float, float]]:
    return {d: (x * (1 - share), x * (1 + share)) for d, x in anchor.items()}


def z_scores(cluster: dict[str, tuple[float, float]], saturation: float = 2.0) -> dict[str, Column]:
    """Heights count as equal where both are above the saturation."""
    out = {d: F.abs(F.col(d) - F.lit(mu)) / F.lit(sigma) for d, (mu, sigma) in cluster.items()}
    if cluster["h"][0] > saturation:
        out["h"] = F.when(F.col("h") > saturation, 0.0).otherwise(out["h"])
    return out


def _z_verdict(top: Column, visual: float, geometric: float) -> Column:
    return F.when(top <= visual, "visual_shift").when(top > geometric, "geometric_shift").otherwise("ambiguous")


def classify_z(df: DataFrame, cluster: dict[str, tuple[float, float]] = C.CAR_CLUSTER, visual: float = 2.0, geometric: float = 3.0) -> DataFrame:
    z = z_scores(cluster)
    top = F.greatest(*z.values())
    return df.withColumns({**{f"z_{d}": c for d, c in z.items()}, "z_max": top, "worst": _worst(z), "verdict": _z_verdict(top, visual, geometric)})


def classify_clusters(df: DataFrame, clusters: DataFrame, key: str, visual: float = 2.0, geometric: float = 3.0, saturation: float = 2.0) -> DataFrame:
    """classify_z with the cluster of each row from a small table (key, dim, mu, sigma)."""
    wide = clusters.groupBy(key).pivot("dim", list(DIMS)).agg(F.first("mu").alias("mu"), F.first("sigma").alias("sigma"))
    joined = df.join(F.broadcast(wide), key)
    z = {d: F.abs(F.col(d) - F.col(f"{d}_mu")) / F.when(F.col(f"{d}_sigma") != 0, F.col(f"{d}_sigma")) for d in DIMS}
    z["h"] = F.when((F.col("h_mu") > saturation) & (F.col("h") > saturation), 0.0).otherwise(z["h"])
    top = F.greatest(*z.values())
    return joined.withColumns({"z_max": top, "worst": _worst(z), "verdict": _z_verdict(top, visual, geometric)}).select(*df.columns, "z_max", "worst", "verdict")


def classify_arms(df: DataFrame) -> DataFrame:
    """The adult arm by relative difference, the child arm by z, and their union."""
    adult = F.greatest(*[F.abs(F.col(d) - F.lit(mu)) / F.lit(mu) for d, mu in C.ADULT_MEANS.items()])
    child = F.greatest(*z_scores(C.CHILD_CLUSTER).values())
    a, c = F.when(adult <= 0.20, "visual_shift").otherwise("geometric_shift"), _z_verdict(child, 2.0, 3.0)
    return df.withColumns({"adult": a, "child": c, "verdict": union_verdict(a, c)})


def union_verdict(a: Column, b: Column) -> Column:
    """Visual if either is, geometric only if both are."""
    return F.when((a == "visual_shift") | (b == "visual_shift"), "visual_shift").when((a == "geometric_shift") & (b == "geometric_shift"), "geometric_shift").otherwise("ambiguous")


def check_declared(df: DataFrame, declared: str = "declared", verdict: str = "verdict") -> DataFrame:
    """ok where the declared class is the derived one; an ambiguous one never passes."""
    gate = F.when(F.col(verdict) == "ambiguous", "ambiguous").when(F.col(declared).eqNullSafe(F.col(verdict)), "ok").otherwise("mismatch")
    return df.withColumn("gate", gate)


def cluster_stats(df: DataFrame, key: str) -> DataFrame:
    """key, dim, n, mu, sigma, degenerate. Dimensions are aggregated side by side and then turned."""
    sums = df.groupBy(key).agg(F.count("*").alias("n"), *[f(d).alias(f"{d}_{n}") for d in DIMS for n, f in (("mu", F.avg), ("sigma", F.stddev_samp))])
    rows = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"{d}_mu").alias("mu"), F.col(f"{d}_sigma").alias("sigma")) for d in DIMS])
    return sums.select(key, "n", F.explode(rows).alias("x")).select(key, "n", "x.*").withColumn("degenerate", F.coalesce(F.col("sigma") < 1e-4, F.lit(True)))


def bands(clusters: DataFrame) -> DataFrame:
    """Admissible ranges: two and three deviations, a fifth of the mean."""
    mu, s = F.col("mu"), F.col("sigma")
    return clusters.withColumns({"lo2": mu - 2 * s, "hi2": mu + 2 * s, "lo3": mu - 3 * s, "hi3": mu + 3 * s, "lo20": mu * 0.8, "hi20": mu * 1.2})


def extent_drift(df: DataFrame, measured: Column, golden: Column, tolerance: float = 0.05) -> DataFrame:
    drift = F.array_max(F.zip_with(measured, golden, lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    return df.withColumn("drift", drift).withColumn("ok", F.coalesce(F.col("drift") <= tolerance, F.lit(False)))


def classify_roles(df: DataFrame, name: Column, table: list[tuple[str, str]]) -> DataFrame:
    """role of a name by an ordered table of (pattern, role); the first match counts."""
    role = F.lit("unknown")
    for pattern, r in reversed(table):
        role = F.when(F.lower(name).rlike(pattern), r).otherwise(role)
    return df.withColumn("role", role)
