"""Comparison and reconciliation of tables, manifests and file sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.scalars import canon
from .ordered import first_rows, running_totals


def diff_tables(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, column, left, right, kind: rows on one side only (column null) and cells that differ in canonical form. One full join."""
    left = a.select(*keys, *[canon(F.col(c)).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_in_a"))
    right = b.select(*keys, *[canon(F.col(c)).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_in_b"))
    both = left.join(right, keys, "full")
    none = F.lit(None).cast("string")
    side = F.when(F.col("_in_b").isNull(), "only_left").when(F.col("_in_a").isNull(), "only_right")
    cells = [F.when(side.isNull() & (F.col(f"_a_{c}") != F.col(f"_b_{c}")), F.struct(F.lit(c).alias("column"), F.col(f"_a_{c}").alias("left"), F.col(f"_b_{c}").alias("right"), F.lit("cell").alias("kind"))) for c in columns]
    whole = F.when(side.isNotNull(), F.struct(none.alias("column"), none.alias("left"), none.alias("right"), side.alias("kind")))
    return both.select(*keys, F.explode(F.filter(F.array(whole, *cells), lambda x: x.isNotNull())).alias("_d")).select(*keys, "_d.*")


def explain_diffs(diffs: DataFrame, names: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """diffs with explanation: renamed (right is the rename of left), declared, or unexplained."""
    moved = F.broadcast(names.select(F.col("old").alias("left"), F.col("new").alias("right"), F.lit(True).alias("_moved")).distinct())
    listed = declared.select(*keys, "column", F.lit(True).alias("_listed"))  # grows with the rows compared: no hint
    out = diffs.join(moved, ["left", "right"], "left").join(listed, [*keys, "column"], "left")
    return out.withColumn("explanation", F.when(F.col("_moved"), "renamed").when(F.col("_listed"), "declared").otherwise("unexplained")).drop("_moved", "_listed")


def stale_declarations(diffs: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Declared differences that are not there."""
    return declared.join(diffs.where("column IS NOT NULL"), [*keys, "column"], "left_anti")


#: Positions in one bitmap of Spark's.
BITS = 32768


def reconcile(records: DataFrame, manifest: DataFrame, runs: list[str], keys: list[str]) -> DataFrame:
    """runs, keys, problem: planned routes that a run lacks, and routes of a run that no plan has.

    The plan's routes are numbered; what a run has of them is a bitmap, a bit a route, which tasks build in parts. Only numbers whose bit is missing become rows and are joined with the plan."""
    have = records.select(*runs, *keys).distinct()
    plan = running_totals(manifest.select(*keys).distinct(), [], keys, F.lit(1), "_at")
    numbered = have.join(plan, keys, "left")
    extra = numbered.where("_at IS NULL").select(*runs, *keys, F.lit("extra").alias("problem"))
    total = plan.count()
    blocks = max(1, -(-total // BITS))
    block = F.expr(f"CAST(_at DIV {BITS} AS INT)")
    bits = numbered.where("_at IS NOT NULL").groupBy(*runs, block.alias("_block")).agg(F.bitmap_construct_agg(F.col("_at") % BITS).alias("_bits"))
    grid = records.select(*runs).distinct().select(*runs, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    held = grid.join(bits.select(*[F.col(c).alias(f"_r_{c}") for c in runs], F.col("_block").alias("_b"), "_bits"), reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_r_{c}")), runs, F.col("_block") == F.col("_b")), "left")
    # bytes whose bits are not all set, then the bits
    text = F.hex("_bits")
    byte = lambda i: F.when(F.col("_bits").isNull(), F.lit(0)).otherwise(F.conv(F.substring(text, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
    size = F.least(F.lit(BITS), F.lit(total) - F.col("_block") * BITS)
    open_ = held.withColumn("_text", text).select(*runs, "_block", size.alias("_size"), F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"CAST(ceil(least({BITS}, {total} - _block * {BITS}) / 8.0) - 1 AS INT)")), lambda i: F.struct(i.alias("i"), byte(i).alias("v")))).alias("_y"))
    open_ = open_.where("_y.v <> 255").select(*runs, "_block", "_size", "_y", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_bit"))
    at = F.col("_y.i") * 8 + F.col("_bit")
    open_ = open_.where((at < F.col("_size")) & (F.expr("shiftright(_y.v, _bit) & 1") == 0)).select(*runs, (F.col("_block").cast("bigint") * BITS + at).alias("_at"))
    missing = open_.join(plan, "_at").select(*runs, *keys, F.lit("missing").alias("problem"))
    return missing.unionByName(extra)


def coverage(records: DataFrame, manifest: DataFrame, runs: list[str], keys: list[str]) -> DataFrame:
    """Per run: rows, covered, missing, extra and duplicate routes."""
    rows = records.groupBy(*runs, *keys).agg(F.count("*").alias("_n"))
    plan = manifest.select(*keys, F.lit(1).alias("_planned")).distinct()
    total = manifest.select(*keys).distinct().agg(F.count("*").alias("_total"))
    per = rows.join(plan, keys, "left").groupBy(*runs).agg(
        F.sum("_n").alias("n_rows"), F.count("_planned").alias("covered"), F.count(F.when(F.col("_planned").isNull(), 1)).alias("extra"), F.sum(F.col("_n") - 1).alias("duplicates")
    )
    return per.crossJoin(F.broadcast(total)).withColumn("missing", F.col("_total") - F.col("covered")).drop("_total")


def crosscheck_ids(records: DataFrame, manifest: DataFrame, keys: list[str], seen: str, planned: str) -> DataFrame:
    """Rows whose observed id is not the planned one; rows without an observed id cannot be checked."""
    plan = manifest.select(*keys, F.col(planned).alias("_planned")).distinct()
    return records.where(F.col(seen).isNotNull()).join(plan, keys).where(F.col(seen) != F.col("_planned")).withColumnRenamed("_planned", "planned")


def check_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, state of files (path, sha256) against a manifest (path, sha256); where either has no digest the file is unread, which says nothing of its content."""
    a = files.select("path", F.col("sha256").alias("_f"), F.lit(True).alias("_there"))
    b = manifest.select("path", F.col("sha256").alias("_m"), F.lit(True).alias("_listed"))
    state = (
        F.when(F.col("_there").isNull(), "missing").when(F.col("_listed").isNull(), "extra").when(F.col("_f").isNull() | F.col("_m").isNull(), "unread")
        .when(F.col("_f") != F.col("_m"), "modified").otherwise("ok")
    )
    return a.join(b, "path", "full").select("path", state.alias("state"))


def resurrected(df: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(excluded.select(*keys).distinct(), keys, "left_semi")


def check_parity(df: DataFrame, group: list[str], level: str, route: str, prop: str) -> DataFrame:
    """group, level, route, prop, problem: combinations that a group's level lacks, and duplicates."""
    cells = df.groupBy(*group, level, route, prop).agg(F.count("*").alias("_n"))
    grid = cells.select(*group, level, route).distinct().join(cells.select(*group, level, prop).distinct(), [*group, level])
    missing = grid.join(cells, [*group, level, route, prop], "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(cells.where("_n > 1").drop("_n").withColumn("problem", F.lit("duplicate")).select(missing.columns))


def level_parity(df: DataFrame, group: list[str], level: str, route: str) -> DataFrame:
    """Groups whose levels do not hold the same routes."""
    sets = df.groupBy(*group, level).agg(F.array_sort(F.collect_set(route)).alias("_r"))
    return sets.groupBy(*group).agg(F.countDistinct("_r").alias("n_sets"), F.count("*").alias("n_levels")).where("n_sets > 1")


def locate(split: DataFrame, files: DataFrame) -> DataFrame:
    """split (path, stem) with result and how: the mirrored path, else the one file of that name, else none or ambiguous."""
    exact = files.select(F.col("path").alias("_p"))
    named = files.groupBy("stem").agg(F.count("*").alias("_n"), F.min("path").alias("_q"))
    out = split.join(exact, F.col("path") == F.col("_p"), "left").join(named, "stem", "left")
    how = F.when(F.col("_p").isNotNull(), "exact").when(F.col("_n") == 1, "by_name").when(F.col("_n") > 1, "ambiguous").otherwise("none")
    return out.withColumns({"how": how, "result": F.when(how == "exact", F.col("_p")).when(how == "by_name", F.col("_q"))}).drop("_p", "_q", "_n")


def verify_split(split: DataFrame, files: DataFrame) -> DataFrame:
    """split (path, sha256, blueprint) against files (path, sha256, blueprint): the first thing wrong with each."""
    f = files.select("path", F.col("sha256").alias("_s"), F.col("blueprint").alias("_b"), F.lit(True).alias("_there"))
    state = (
        F.when(F.col("_there").isNull(), "missing").when(F.col("_s").isNull() | F.col("sha256").isNull(), "unread").when(F.col("_s") != F.col("sha256"), "modified")
        .when(F.col("_b").isNull(), "unparsed").when(F.col("_b") != F.col("blueprint"), "disagree").otherwise("ok")
    )
    return split.join(f, "path", "left").withColumn("state", state).drop("_s", "_b", "_there")


def undefined_refs(used: DataFrame, defined: DataFrame) -> DataFrame:
    """id, first user of ids that are used and not defined."""
    return used.groupBy("id").agg(F.min("path").alias("first_user")).join(defined.select("id").distinct(), "id", "left_anti")


def rename_closure(ids: DataFrame, names: DataFrame) -> DataFrame:
    """id, problem: old ids that survive, new ids that nobody uses."""
    used = ids.select("id").distinct()
    moved = names.where("old <> new")
    old = used.join(F.broadcast(moved.select(F.col("old").alias("id"))), "id", "left_semi").withColumn("problem", F.lit("old_id"))
    unused = names.select(F.col("new").alias("id")).distinct().join(used, "id", "left_anti").withColumn("problem", F.lit("unused"))
    return old.unionByName(unused)


def pick_record(records: Column, stem: Column) -> Column:
    """The one record whose id contains the stem; null for none or several."""
    hits = F.filter(records, lambda r: r["route_id"].contains(stem))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def reconcile_counts(df: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """expected (keys, expected) with actual and ok; keys without rows are kept."""
    have = df.groupBy(*keys).agg(F.count("*").alias("actual"))
    return expected.join(have, keys, "left").withColumn("actual", F.coalesce("actual", F.lit(0))).withColumn("ok", F.col("actual") == F.col("expected"))


def check_lossless(raw: DataFrame, typed: DataFrame, columns: list[str], key: str, examples: int = 3) -> DataFrame:
    """column, n_before, n_lost, examples: text that the typed table has lost. One join, one pass."""
    joined = raw.select(key, *[F.col(c).cast("string").alias(f"_r_{c}") for c in columns]).join(typed.select(key, *[F.col(c).isNull().alias(f"_n_{c}") for c in columns]), key)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_r_{c}").alias("text"), F.col(f"_n_{c}").alias("lost")) for c in columns])
    flat = joined.select(F.explode(cells).alias("x")).select("x.*").where(F.trim("text") != "")
    bad = flat.where("lost").select("column", "text").distinct()
    first = first_rows(bad, ["column"], ["text"], examples)
    first = first.groupBy("column").agg(F.array_sort(F.collect_list("text")).alias("examples"))
    counts = flat.groupBy("column").agg(F.count("*").alias("n_before"), F.count(F.when(F.col("lost"), 1)).alias("n_lost"))
    return counts.join(first, "column", "left").withColumn("examples", F.coalesce(F.array_join("examples", "|"), F.lit("")))


def presence_rate(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    out = df.groupBy(*by).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(f"{c}_rate") for c in columns], *[F.count(c).alias(f"{c}_n") for c in columns])
    return out


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def deep_diff(a: DataFrame, b: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Documents as (path, value): paths that one side lacks, numbers apart by more than the relative tolerance, other values that differ."""
    x, y = a.select("path", F.col("value").alias("left")), b.select("path", F.col("value").alias("right"))
    p, q = F.col("left").try_cast("double"), F.col("right").try_cast("double")
    close = F.abs(p - q) <= tolerance * F.greatest(F.abs(p), F.abs(q), F.lit(1.0))
    kind = (
        F.when(F.col("right").isNull(), "missing_right").when(F.col("left").isNull(), "missing_left")
        .when(p.isNotNull() & q.isNotNull(), F.when(~close, "number")).when(F.col("left") != F.col("right"), "value")
    )
    return x.join(y, "path", "full").withColumn("kind", kind).where(F.col("kind").isNotNull())


def frame_equal(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """Per column the number of rows that are not equal within the tolerances, rows of one side included."""
    x = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(1).alias("_in_a"))
    y = b.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(1).alias("_in_b"))
    both = x.join(y, keys, "full")
    same = {c: F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")) | F.coalesce(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")) <= atol + rtol * F.abs(F.col(f"_b_{c}")), F.lit(False)) for c in columns}
    there = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    counts = both.agg(*[F.count(F.when(~(same[c] & there), 1)).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_unequal")) for c in columns])).alias("x")).select("x.*")


def gate(values: DataFrame, locked: DataFrame) -> DataFrame:
    """values (label, value) against locked (label, expected, tolerance)."""
    out = F.broadcast(locked).join(values, "label", "left")
    return out.withColumn("ok", F.coalesce(F.abs(F.col("value") - F.col("expected")) <= F.col("tolerance"), F.lit(False)))


def examples(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def last_events(events: DataFrame, by: str, n: int, skip: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("frame"), F.desc("line"))
    return events.where(F.col("kind") != skip).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def reindex(df: DataFrame, id_col: str, by: list[str]) -> DataFrame:
    """index of rows in the order of the two numbers in their ids."""
    a, b = (F.regexp_extract(id_col, r"([0-9]+)_rep([0-9]+)", i).try_cast("int") for i in (1, 2))
    return df.withColumn("index", F.row_number().over(Window.partitionBy(*by).orderBy(a, b, id_col)) - 1)


def mixed_order(c: str) -> list[Column]:
    """Numbers by value, then other text."""
    n = F.col(c).try_cast("double")
    return [n.isNull(), n, F.col(c)]


def union_sources(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def diff_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side: left, right or both."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return x.join(y, keys, "full").select(*keys, side.alias("side"))


def vocab_gap(df: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gap: used and not in the vocabulary, in the vocabulary and not used."""
    used, known = df.select(*keys).distinct(), vocab.select(*keys).distinct()
    return used.join(known, keys, "left_anti").withColumn("gap", F.lit("unknown")).unionByName(known.join(used, keys, "left_anti").withColumn("gap", F.lit("unused")))


def uncovered(split: DataFrame, golden: DataFrame) -> DataFrame:
    return split.join(golden.select("path").distinct(), "path", "left_anti")


def breakdown(df: DataFrame, depth: int, path: str = "path") -> DataFrame:
    prefix = F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")
    return df.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"))
