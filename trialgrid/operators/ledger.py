"""The attempt ledger: what each attempt costs, when a route is settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import config as C
from .ordered import first_rows

STATE = "struct<attempts_record:bigint,attempts_tickruntime:bigint,attempts_infra:bigint,attempts_infra_total:bigint,attempts_killed:bigint,finished:boolean,used:bigint>"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.LEDGER_RULES, "outcome_class string, on_disk_case string, charged string, settles string")


def with_rules(attempts: DataFrame) -> DataFrame:
    """attempts with charged, settles, clears (a genuine record, which ends a streak of machine failures)."""
    out = attempts.join(F.broadcast(rules(attempts.sparkSession)), ["outcome_class", "on_disk_case"], "left")
    genuine = F.col("outcome_class").isin("CLEAN_EXIT", "ABNORMAL_END") & ~F.col("charged").isin("infra", "killed") & (F.col("on_disk_case") != "NO_FINAL_RECORD")
    return out.withColumn("clears", F.coalesce(genuine, F.lit(False)))


def step(s: Column, a: Column, budgets: C.Budgets) -> Column:
    """The ledger's row after one more attempt; a settled route takes none."""
    def plus(name: str, axis: str) -> Column:
        return s[name] + F.when(a["charged"] == axis, 1).otherwise(0)

    record, tick, killed = plus("attempts_record", "record"), plus("attempts_tickruntime", "tickruntime"), plus("attempts_killed", "killed")
    infra = F.when(a["clears"], F.lit(0).cast("bigint")).otherwise(plus("attempts_infra", "infra"))
    spent = F.when(a["charged"] == "record", record >= budgets.record).when(a["charged"] == "tickruntime", tick >= budgets.tickruntime).when(a["charged"] == "killed", killed >= budgets.killed).otherwise(False)
    done = (a["settles"] == "yes") | (a["settles"] == "when_spent") & spent
    new = F.struct(record.alias("attempts_record"), tick.alias("attempts_tickruntime"), infra.alias("attempts_infra"), plus("attempts_infra_total", "infra").alias("attempts_infra_total"), killed.alias("attempts_killed"), done.alias("finished"), (s["used"] + 1).alias("used"))
    return F.when(s["finished"], s).otherwise(new.cast(STATE))


def ledger(attempts: DataFrame, budgets: C.Budgets = C.Budgets()) -> DataFrame:
    """task and its counters after all attempts in order. Attempts of one task are few (budgets bound them); the stream keeps counters only."""
    row = F.struct("attempt_no", "charged", "settles", "clears")
    folded = with_rules(attempts).groupBy("task").agg(F.array_sort(F.collect_list(row)).alias("_a"))
    zero = F.from_json(F.lit('{"attempts_record":0,"attempts_tickruntime":0,"attempts_infra":0,"attempts_infra_total":0,"attempts_killed":0,"finished":false,"used":0}'), STATE)
    return folded.select("task", F.aggregate("_a", zero, lambda s, a: step(s, a, budgets)).alias("s")).select("task", "s.*")


def clear_infra(state: DataFrame, budget: int) -> DataFrame:
    """state with the machine's counter cleared where it is exhausted, and whether it was."""
    gone = (F.col("attempts_infra") > 0) & (F.col("attempts_infra") >= budget)
    return state.withColumn("cleared", gone).withColumn("attempts_infra", F.when(F.col("cleared"), 0).otherwise(F.col("attempts_infra")).cast("bigint"))


def plan_tasks(routes: DataFrame, base_seed: int, repetitions: int) -> DataFrame:
    """A task per route and repetition; its seed counts up from the base."""
    return routes.select("*", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("rep")).withColumn("seed", F.lit(base_seed) + F.col("rep"))


def outcomes(plan: DataFrame, results: DataFrame, state: DataFrame, key: str = "task") -> DataFrame:
    """plan with final, status, settled, complete, unsettled_reason; what the ledger knows is asked before what is on disk."""
    r = results.select(key, F.col("final").alias("_f"), F.col("status").alias("_s"))
    s = state.select(key, F.col("finished").alias("_done"), F.lit(True).alias("_seen"))
    out = plan.join(r, key, "left").join(s, key, "left")
    final, settled = F.coalesce("_f", F.lit(False)), F.coalesce("_done", F.lit(False))
    reason = F.when(final & settled, None).when(F.col("_seen").isNull(), "not_reached").when(final, "unrefreshed_record").otherwise("no_record")
    return out.select(*plan.columns, final.alias("final"), F.when(final, F.col("_s")).alias("status"), settled.alias("settled"), (final & settled).alias("complete"), reason.alias("unsettled_reason"))


def status_counts(outcome: DataFrame) -> DataFrame:
    """complete, status, n: settled routes apart from the others, the most frequent first."""
    shown = F.when(F.col("final"), F.coalesce("status", F.lit("(no record)"))).otherwise("(no record)")
    return outcome.groupBy("complete", shown.alias("status")).agg(F.count("*").alias("n")).orderBy(F.desc("complete"), F.desc("n"), "status")


def exit_class(outcome: DataFrame, no_workers: bool = False, interrupted: bool = False) -> DataFrame:
    """The most specific diagnosis of a sweep."""
    fatal = F.coalesce(F.bool_or(F.col("status").isin(*C.FATAL_STATUSES)), F.lit(False))
    partial = F.coalesce(F.bool_or(~F.col("complete")), F.lit(False))
    return outcome.agg(F.when(fatal, "agent_fatal").when(F.lit(no_workers), "no_workers").when(F.lit(interrupted), "interrupted").when(partial, "partial").otherwise("ok").alias("exit_class"))


def open_tasks(outcome: DataFrame) -> DataFrame:
    """Tasks that are not complete, and why."""
    return outcome.where(~F.col("complete"))


def sweep_report(outcome: DataFrame, by: list[str], shown: int = 20) -> DataFrame:
    """by, totals, statuses of complete tasks, the first incomplete tasks with their reasons; `open_tasks` has all of them."""
    per = outcome.groupBy(*by, "status").agg(F.count(F.when(F.col("complete"), 1)).alias("_n"), F.count("*").alias("_all"))
    statuses = F.array_sort(F.collect_list(F.when(F.col("_n") > 0, F.struct("status", F.col("_n").alias("n")))))  # a few for each group
    told = lambda rows, *names: F.array_join(F.transform(rows, lambda r: F.concat_ws(" ", *[r[n].cast("string") for n in names])), "|")
    sums = per.groupBy(*by).agg(F.sum("_all").alias("total"), F.sum("_n").alias("complete"), F.sum(F.col("_all") - F.col("_n")).alias("incomplete"), told(statuses, "status", "n").alias("by_status"))
    first = first_rows(open_tasks(outcome), by, ["task"], shown)
    listed = first.groupBy(*by).agg(told(F.array_sort(F.collect_list(F.struct("task", "unsettled_reason"))), "task", "unsettled_reason").alias("open"))
    return sums.join(listed, by, "left").withColumn("open", F.coalesce("open", F.lit("")))
