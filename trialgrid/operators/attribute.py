"""Attribution of logged collisions to the object under test, renames and alignment.

Attribution comes before renames: messages carry old ids. rename() needs the column that attribute() adds, so the wrong
order fails when the plan is analysed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.window import Window

SENTINELS = ("unknown",)


def infer_unanimous(df: DataFrame, keys: list[str], value: str, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """keys, inferred (the one value, if there is one), candidates (sorted); sentinels and blanks count as absent."""
    real = df.where(F.col(value).isNotNull() & ~F.col(value).isin("", *sentinels))
    grouped = real.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("candidates"))  # a few ids per key
    return grouped.withColumn("inferred", F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0))))


def fill_agent_type(df: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """agent_type where it is empty (a sentinel is kept), and agent_type_source."""
    known = F.broadcast(fallback.select(*keys, "inferred"))
    empty = F.col("agent_type").isNull() | (F.col("agent_type") == "")
    source = F.when(~empty & F.col("agent_type").isin(*SENTINELS), "sentinel").when(~empty, "record").when(F.col("inferred").isNotNull(), "fallback").otherwise("missing")
    return df.join(known, keys, "left").withColumns({"agent_type_source": source, "agent_type": F.when(empty, F.col("inferred")).otherwise(F.col("agent_type"))}).drop("inferred")


def attribute(df: DataFrame, types: str = "collision_types") -> DataFrame:
    """Hits of the object under test among the types collided with: count, flag, alias."""
    n = F.coalesce(F.size(F.filter(types, lambda t: t == F.col("agent_type"))), F.lit(0))
    n = F.when(F.col("agent_type").isNull(), 0).otherwise(F.greatest(n, F.lit(0))).cast("long")
    return df.withColumn("hit_count", n).withColumns({"hit": F.col("hit_count") > 0, "collided_with_agent": F.col("hit_count") > 0})


def provenance(df: DataFrame) -> DataFrame:
    return df.groupBy("agent_type_source").agg(F.count("*").alias("n"))


def rename(df: DataFrame, names: DataFrame) -> DataFrame:
    """agent_type and prop (from variant) by a small map (kind, old, new); prop_raw keeps the old token."""
    df = df.withColumn("hit_count", F.col("hit_count"))  # attribution must have run
    ids = F.broadcast(names.where("kind = 'id'").select(F.col("old").alias("agent_type"), F.col("new").alias("_id")))
    tokens = F.broadcast(names.where("kind = 'token'").select(F.col("old").alias("variant"), F.col("new").alias("_token")))
    out = df.join(ids, "agent_type", "left").join(tokens, "variant", "left")
    return out.withColumns({"agent_type": F.coalesce("_id", "agent_type"), "prop": F.coalesce("_token", "variant"), "prop_raw": F.col("variant")}).drop("_id", "_token")


def leaks(renamed: DataFrame, names: DataFrame) -> DataFrame:
    """Rows that still hold an old id: none, if the map was applied."""
    moved = names.where("kind = 'id' AND old <> new").select(F.col("old").alias("agent_type"))
    return renamed.join(F.broadcast(moved), "agent_type", "left_semi")


def write_renamed(df: DataFrame, names: DataFrame, path: str) -> int:
    """Writes the renamed rows and gives their number; rows that still hold an old id are counted on the way, and any fails the call, with nothing left at path."""
    moved = names.where("kind = 'id' AND old <> new").select(F.col("old").alias("agent_type"), F.lit(True).alias("_old"))
    seen = Observation("renamed")
    marked = rename(df, names).join(F.broadcast(moved), "agent_type", "left")
    marked.observe(seen, F.count("*").alias("n"), F.count("_old").alias("leaks")).drop("_old").write.parquet(path)
    if seen.get["leaks"]:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
        raise ValueError(f"{seen.get['leaks']} rows still hold an old id")
    return seen.get["n"]


def dedupe_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def align_blank_only(df: DataFrame, frozen: DataFrame, keys: list[str], columns: list[str], guard: str, order: list, tolerance: float = 1e-6) -> DataFrame:
    """Fills columns that are blank in df from frozen rows of the same key, where the guard metric agrees; aligned tells what was done."""
    first = dedupe_first(frozen, keys, order).select(*keys, F.col(guard).alias("_guard"), *[F.col(c).alias(f"_f_{c}") for c in columns], F.lit(True).alias("_there"))
    joined = df.join(first, keys, "left")
    agrees = F.col(guard).eqNullSafe(F.col("_guard")) | (F.abs(F.col(guard) - F.col("_guard")) <= tolerance)
    state = F.when(F.col("_there").isNull(), "no_frozen").when(F.coalesce(agrees, F.lit(False)), "aligned").otherwise("guard_failed")
    filled = {c: F.when(state == "aligned", F.coalesce(c, f"_f_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumn("aligned", state).select(*[filled.get(c, F.col(c)).alias(c) for c in df.columns], "aligned")
