"""Paired comparison of conditions: tables, deltas, rank tests, bootstrap, effect sizes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .ordered import running_totals

CELL = ["model", "category"]
PAIR = ["scenario", "route_id", "seed"]


def paired(df: DataFrame, base: str, shift: str, score: str = "driving_score", by: list[str] = CELL, pair: list[str] = PAIR) -> DataFrame:
    """by, pair, base, shift: variants are averaged per side, missing scores dropped, pairs need both sides. One shuffle."""
    rows = df.where(F.col("level").isin(base, shift) & F.col(score).isNotNull())
    keys = [*by, *pair]
    side = lambda level: F.avg(F.when(F.col("level") == level, F.col(score)))
    return rows.groupBy(*keys).agg(side(base).alias("base"), side(shift).alias("shift")).where("base IS NOT NULL AND shift IS NOT NULL")


def cell_deltas(pairs: DataFrame, by: list[str] = CELL) -> DataFrame:
    d = F.col("shift") - F.col("base")
    return pairs.groupBy(*by).agg(F.avg(d).alias("delta"), F.count("*").alias("n_pairs")).withColumns({"drop": -F.col("delta"), "sign": F.signum("delta").cast("int")})


def _sizes(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, size, ties, plus (how many of them are positive), rank: a row for each size of difference, with the average rank of those of that size; zero differences are dropped.

    Ranks come from counts per size, summed over ranges of sizes, so a cell of any number of pairs is no window."""
    d = F.round(F.col("shift") - F.col("base"), 9)
    sizes = pairs.withColumn("_d", d).where("_d <> 0").groupBy(*by, F.abs("_d").alias("size")).agg(F.count("*").alias("ties"), F.count(F.when(F.col("_d") > 0, 1)).alias("plus"))
    placed = running_totals(sizes, by, ["size"], F.col("ties"), "_before")
    return placed.withColumn("rank", F.col("_before") + (F.col("ties") + 1) / 2.0).drop("_before")


def signed_ranks(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Differences with average ranks of their sizes; zero differences are dropped."""
    d = pairs.withColumn("d", F.round(F.col("shift") - F.col("base"), 9)).where("d <> 0").withColumn("size", F.abs("d"))
    ranks = _sizes(pairs, by).select(*by, "size", "rank", F.col("ties").alias("_ties"))
    return d.join(ranks, [*by, "size"])


def signed_rank(pairs: DataFrame, by: list[str] = CELL) -> DataFrame:
    """by, n, w_plus, w_minus, z: z with the correction for ties, none for continuity."""
    ties = F.col("ties").cast("double")
    sums = _sizes(pairs, by).groupBy(*by).agg(
        F.sum("ties").alias("n"), F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("ties") - F.col("plus"))).alias("w_minus"),
        F.sum(ties * (ties * ties - 1)).alias("_t"), F.max("ties").alias("_most"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_t") / 48.0)
    return sums.withColumn("z", (F.col("w_plus") - n * (n + 1) / 4.0) / F.when(spread > 0, spread))


def p_values(tests: DataFrame, by: list[str] = CELL, method: str = "auto", exact_limit: int = 50) -> DataFrame:
    """tests with p (two-sided) and method: exact for n <= exact_limit without ties, else normal. One row per cell goes to Python, by batches.

    The limit is that of the protocol's reference implementation of the test; each row names the method that it got."""
    if method not in ("auto", "exact", "normal"):
        raise ValueError(f"unknown method: {method!r}")

    def exact(n: int, w: float) -> float:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n, plus, minus, most, z in zip(pdf.n, pdf.w_plus, pdf.w_minus, pdf._most, pdf.z):
                small = method == "exact" or method == "auto" and n <= exact_limit and most == 1
                rows.append((exact(int(n), min(plus, minus)), "exact") if small else (math.erfc(abs(z) / math.sqrt(2)) if z == z and z is not None else 1.0, "normal"))
            yield pdf.assign(p=[r[0] for r in rows], method=[r[1] for r in rows])

    out = tests.mapInPandas(rate, StructType([*tests.schema.fields, StructField("p", DoubleType()), StructField("method", StringType())]))
    return out.drop("_t", "_most")


def across_cells(cells: DataFrame, a: str = "visual", b: str = "geometric") -> DataFrame:
    """n, mean, sd and effect size d_z of the cells' differences of two drops, and their signed-rank test: z, p (two-sided), method.

    A row per cell is the input, so the one group is as small as there are cells."""
    d = F.col(b) - F.col(a)
    sums = cells.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd")).withColumn("d_z", F.col("mean") / F.col("sd"))
    pairs = cells.where(d.isNotNull()).select(F.lit(0).alias("_all"), F.col(a).alias("base"), F.col(b).alias("shift"))
    test = p_values(signed_rank(pairs, ["_all"]), ["_all"]).select("z", "p", "method")
    return sums.join(test, F.lit(True), "left")


def cell_drops(df: DataFrame, base: str = "base", levels: dict[str, str] | None = None) -> DataFrame:
    """model, category and a drop for each shift. Levels are compared in one pass."""
    levels = levels or {"visual": "visual_shift", "geometric": "geometric_shift"}
    keys = [*CELL, *PAIR]
    side = lambda level: F.avg(F.when(F.col("level") == level, F.col("driving_score")))
    wide = df.where("driving_score IS NOT NULL").groupBy(*keys).agg(side(base).alias("base"), *[side(v).alias(k) for k, v in levels.items()])
    return wide.groupBy(*CELL).agg(*[F.avg(F.col("base") - F.col(k)).alias(k) for k in levels])


def draw_index(seed: int, b: Column, i: Column, n: Column, key: Column) -> Column:
    """A number from 0 to n - 1 that depends on its arguments alone: bits of an MD5."""
    text = F.concat_ws(":", F.lit(seed).cast("string"), key, b.cast("string"), i.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), n.cast("long"))


def bootstrap_ci(pairs: DataFrame, draws: int, seed: int, by: list[str] = CELL, level: float = 0.95) -> DataFrame:
    """by, median, lo, hi: percentile interval of the median difference, resampled by hash. pairs x draws rows, in parallel."""
    d = pairs.select(*by, *PAIR, (F.col("shift") - F.col("base")).alias("d"))
    w = Window.partitionBy(*by)
    numbered = d.withColumns({"i": F.row_number().over(w.orderBy(*PAIR)) - 1, "n": F.count("*").over(w)})
    picks = numbered.select(*by, "i", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    picks = picks.withColumn("pick", draw_index(seed, F.col("b"), F.col("i"), F.col("n"), F.concat_ws("|", *by)))
    drawn = picks.select(*by, "b", F.col("pick").alias("i")).join(numbered.select(*by, F.col("i").cast("long").alias("i"), "d"), [*by, "i"])
    medians = drawn.groupBy(*by, "b").agg(F.percentile("d", 0.5).alias("m"))
    tail = (1 - level) / 2
    return d.groupBy(*by).agg(F.percentile("d", 0.5).alias("median")).join(medians.groupBy(*by).agg(F.percentile("m", tail).alias("lo"), F.percentile("m", 1 - tail).alias("hi")), by)


def hit_rates(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of runs that hit the object, in percentage points per level, and the differences from base."""
    rate = lambda level: F.avg(F.when(F.col("level") == level, F.col("hit").cast("double"))) * 100
    out = df.groupBy(*(by or [])).agg(rate("base").alias("base"), rate("visual_shift").alias("visual"), rate("geometric_shift").alias("geometric"))
    return out.withColumns({"visual_delta": F.col("visual") - F.col("base"), "geometric_delta": F.col("geometric") - F.col("base")})


def headline(cells: DataFrame, models: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Mean drops and their ratio, cells where the geometric drop is deeper, models without and with significant regressions."""
    c = cells.agg(F.avg("visual").alias("a"), F.avg("geometric").alias("b"), F.count(F.when(F.col("geometric") > F.col("visual"), 1)).alias("cells_deeper"), F.count("*").alias("n_cells"))
    m = models.agg(F.count(F.when((F.col("visual_p") >= alpha) | (F.col("visual_drop") <= 0), 1)).alias("robust"), F.count(F.when((F.col("geometric_p") < alpha) & (F.col("geometric_drop") > 0), 1)).alias("significant"), F.count("*").alias("n_models"))
    return c.crossJoin(m).withColumn("ratio", F.col("b") / F.col("a"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def moved(a: DataFrame, b: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Keys whose verdict at alpha differs between two tables of p."""
    x, y = a.select(*keys, F.col("p").alias("p_left")), b.select(*keys, F.col("p").alias("p_right"))
    return x.join(y, keys).where((F.col("p_left") < alpha) != (F.col("p_right") < alpha))
