"""Structured Streaming: reaction detector, attempt ledger, completeness of arrivals.

State per key is small and of bounded size: the last samples of a run and the ticks that wait for earlier ones, the counters of a task
and its attempts that wait for their predecessors. A run's state goes with an event-time timer that closes the run."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import config as C
from ..functions import schemas as M
from ..operators import ledger as L
from ..operators.extract import with_path_info

#: Kinds of rows of the reaction stream; a late tick has its frame alone, a summary no frame, cause only of the first reaction.
REACTION_ROW, LATE, SUMMARY = "reaction", "late", "summary"
REACTION = (
    "run_id bigint, kind string, frame bigint, cause string, ttr double, dar double, num_reactions bigint, t_obs bigint, "
    "final_distance double, final_closing double, final_ttc double"
)
_RUN = "n bigint, last_frame bigint, t_obs bigint, last_reaction bigint, found bigint, ttr double, dar double, cause string, seen bigint, ends bigint"
_FRESH = (0, None, None, None, 0, None, None, None, -1, None)
_SAMPLES = "samples array<struct<frame: bigint, v: double, a: double, y: double, lane: bigint, d: double>>"
_WAITING = "waiting array<struct<frame: bigint, v: double, d: double, y: double, lane: bigint, collision: bigint>>"
_TICK = ("frame", "ego_velocity", "distance", "lateral_offset", "lane_id", "collision_frame")


class ReactionDetector(StatefulProcessor):
    """The rules of operators.telemetry, a tick at a time.

    Ticks wait until `lag` frames after them have come, and are then taken in order; one whose turn has passed, or that repeats a frame, is late and
    changes nothing. With an event time, a run is closed once the watermark is `idle_ms` past its last tick: what waits is
    taken, its summary given, its state cleared."""

    def __init__(self, p: C.Telemetry, lag: int = 0, idle_ms: int | None = None):
        self.p, self.lag, self.idle_ms = p, lag, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", f"{_RUN}, {_SAMPLES}, {_WAITING}")  # one value: each call of the store is a message to the executor

    def _load(self) -> tuple[dict, list, dict]:
        names = [c.split()[0] for c in _RUN.split(", ")]
        *run, samples, waiting = self.run.get() or (*_FRESH, (), ())
        return dict(zip(names, run)), [tuple(r) for r in samples], {r[0]: tuple(r) for r in waiting}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        run, kept, waiting = self._load()
        out, latest = [], None
        for data in rows:
            if self.idle_ms is not None and len(data):
                at = int(data["event_ms"].max())
                latest = at if latest is None else max(latest, at)
            for frame, v, d, y, lane, collision in zip(*(data[c].tolist() for c in _TICK)):
                frame = int(frame)
                if run["last_frame"] is not None and frame <= run["last_frame"] or frame in waiting:
                    out.append(_row(key[0], LATE, frame))
                    continue
                hit = None if collision is None or collision != collision else int(collision)
                waiting[frame] = (frame, float(v), float(d), float(y), int(lane), hit)
                run["seen"] = max(run["seen"], frame)
        self._take(key[0], run, kept, waiting, run["seen"] - self.lag, out)
        if latest is not None and (run["ends"] is None or latest + self.idle_ms > run["ends"]):
            if run["ends"] is not None:
                self.handle.deleteTimer(run["ends"])
            run["ends"] = latest + self.idle_ms
            self.handle.registerTimer(run["ends"])
        self.run.update((*run.values(), kept, list(waiting.values())))
        yield _frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        run, kept, waiting = self._load()
        out: list[tuple] = []
        self._take(key[0], run, kept, waiting, run["seen"], out)
        last = kept[-1] if kept else None
        closing = (kept[-2][5] - last[5]) / ((last[0] - kept[-2][0]) / self.p.rate) if len(kept) > 1 else None
        none = not run["found"]
        ttc = last[5] / closing if none and closing is not None and closing > 0.5 else None
        out.append((int(key[0]), SUMMARY, None, run["cause"], run["ttr"], run["dar"], run["found"], run["t_obs"], last[5] if none and last else None, closing if none else None, ttc))
        self.run.clear()
        yield _frame(out)

    def _take(self, run_id: int, run: dict, kept: list, waiting: dict, upto: int, out: list) -> None:
        """The ticks that wait no longer, in order."""
        for frame in sorted(f for f in waiting if f <= upto):
            found = self._tick(run, kept, waiting.pop(frame))
            if found:
                cause, ttr, dar = found
                out.append(_row(run_id, REACTION_ROW, frame, cause, ttr, dar))
                if not run["found"]:
                    run["ttr"], run["dar"], run["cause"] = ttr, dar, cause
                run["found"] += 1

    def _tick(self, run: dict, kept: list, tick: tuple) -> tuple[str, float, float] | None:
        """Cause, ttr and dar if the tick is a reaction; run and kept, the last samples, go on."""
        p, tau = self.p, self.p.tau_frames
        frame, v, d, y, lane, hit = tick
        a = (v - kept[-1][1]) * p.rate if kept else 0.0
        if run["t_obs"] is None and d <= p.d_obs:
            run["t_obs"] = frame
        n = run["n"]
        back = p.smooth if n >= p.smooth else 1 if n >= 2 else 0
        closing = v
        if back:
            dt = (frame - kept[-back][0]) / p.rate
            closing = (kept[-back][5] - d) / dt if dt > 0 else v
        ttc = d / closing if closing > 0.5 else float("inf")
        kept.append((frame, v, a, y, lane, d))
        cause = None
        apart = run["last_reaction"] is None or frame - run["last_reaction"] >= tau
        if run["t_obs"] is not None and (hit is None or frame < hit) and (ttc <= p.ttc_max or d < p.d_min) and n >= tau and apart:
            span = kept[-tau - 1 :]
            if p.use_p1 and span[0][1] > 0.1 and abs(v - span[0][1]) / span[0][1] >= p.rho:
                cause = "P1_speed_change"
            elif max(s[2] for s in span) <= -p.theta_a:
                cause = "P2_deceleration"
            elif abs(y - span[0][3]) / p.tau >= p.theta_y:
                cause = "P3_lateral"
            elif span[0][4] != lane:
                cause = "P3_lane_change"
        del kept[: -max(tau, p.smooth)]
        run["n"], run["last_frame"] = n + 1, frame
        if cause:
            run["last_reaction"] = frame
            return cause, (frame - run["t_obs"]) / p.rate, d
        return None

    def close(self) -> None:
        pass


def _row(run_id: int, kind: str, frame: int, cause: str | None = None, ttr: float | None = None, dar: float | None = None) -> tuple:
    return (int(run_id), kind, frame, cause, ttr, dar, None, None, None, None, None)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in REACTION.split(", ")], dtype=object)


def reaction_stream(ticks: DataFrame, p: C.Telemetry = C.Telemetry(), lag: int = 0, event_time: str | None = None, delay: str = "10 minutes", idle_ms: int = 60_000) -> DataFrame:
    """Rows of the kinds reaction, late and, with an event time, summary. Needs the RocksDB state store.

    lag: how many frames a tick may come after later ones; event_time: a column of timestamps whose watermark is `delay` behind: ticks later than that are dropped by
    Spark and counted in its progress only, so `delay` is to be far longer than the lag."""
    if event_time is None:
        return ticks.groupBy("run_id").transformWithStateInPandas(statefulProcessor=ReactionDetector(p, lag), outputStructType=REACTION, outputMode="Append", timeMode="None")
    timed = ticks.withColumn("event_ms", F.unix_millis(event_time)).withWatermark(event_time, delay)
    return timed.groupBy("run_id").transformWithStateInPandas(statefulProcessor=ReactionDetector(p, lag, idle_ms), outputStructType=REACTION, outputMode="Append", timeMode="EventTime")


LEDGER = "task bigint, attempts_record bigint, attempts_tickruntime bigint, attempts_infra bigint, attempts_infra_total bigint, attempts_killed bigint, finished boolean, used bigint"


class LedgerFold(StatefulProcessor):
    """The rules of operators.ledger, an attempt at a time in order of their numbers, which count from 1.

    An attempt that comes before its predecessor waits for it; one that has been taken already, or comes when its task is settled, changes
    nothing. Gives the task's row after each batch that holds an attempt."""

    def __init__(self, budgets: C.Budgets):
        self.budgets = budgets

    def init(self, handle: StatefulProcessorHandle) -> None:
        waiting = "waiting array<struct<attempt_no: bigint, charged: string, settles: string, clears: boolean>>"
        self.row = handle.getValueState("row", f"record bigint, tickruntime bigint, infra bigint, infra_total bigint, killed bigint, finished boolean, used bigint, {waiting}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        *row, waiting = self.row.get() or (0, 0, 0, 0, 0, False, 0, ())
        s = dict(zip(("record", "tickruntime", "infra", "infra_total", "killed", "finished", "used"), row))
        came: dict[int, tuple[str, str, bool]] = {a[0]: tuple(a[1:]) for a in waiting}
        for data in rows:
            if s["finished"]:
                continue
            for number, charged, settles, clears in zip(*(data[c].tolist() for c in ("attempt_no", "charged", "settles", "clears"))):
                if number > s["used"]:
                    came.setdefault(int(number), (charged, settles, bool(clears)))
        while not s["finished"] and s["used"] + 1 in came:
            self._apply(s, *came.pop(s["used"] + 1))
        self.row.update((*s.values(), [] if s["finished"] else [(number, *attempt) for number, attempt in came.items()]))
        yield pd.DataFrame([(int(key[0]), s["record"], s["tickruntime"], s["infra"], s["infra_total"], s["killed"], s["finished"], s["used"])], columns=[c.split()[0] for c in LEDGER.split(", ")])

    def _apply(self, s: dict, charged: str, settles: str, clears: bool) -> None:
        s["used"] += 1
        if clears:
            s["infra"] = 0
        if charged == "infra":
            s["infra"] += 1
            s["infra_total"] += 1
        elif charged != "none":
            s[charged] += 1
        spent = charged in ("record", "tickruntime", "killed") and s[charged] >= getattr(self.budgets, charged)
        s["finished"] = bool(settles == "yes" or settles == "when_spent" and spent)

    def close(self) -> None:
        pass


def ledger_stream(attempts: DataFrame, budgets: C.Budgets = C.Budgets()) -> DataFrame:
    """A task's counters whenever attempts arrive; the last row of a task counts."""
    return L.with_rules(attempts).groupBy("task").transformWithStateInPandas(statefulProcessor=LedgerFold(budgets), outputStructType=LEDGER, outputMode="Update", timeMode="None")


def result_files(spark: SparkSession, root: str, per_batch: int = 10_000, packed: bool = False) -> DataFrame:
    """Stream of the result files under root as they come: path, length, modificationTime, category, model (the first two folders under root), and what the path says of the run. Contents aren't read; a file of no bytes has not come yet.

    packed: they come as members of archives (writers.pack_tree), of which per_batch are taken at once."""
    if packed:
        files = spark.readStream.schema(M.ARCHIVE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).parquet(root)
        files = files.where(F.col("length") > 0).select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path"), "length", "modificationTime")
        return _arrived(files.where(F.col("path").rlike(r"/route_[^/]*_seed[^/]*\.json$")), root)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True)
    files = files.option("pathGlobFilter", "route_*_seed*.json").option("maxFilesPerTrigger", per_batch).load(root).select("path", "length", "modificationTime")
    return _arrived(files, root)


def _arrived(files: DataFrame, root: str) -> DataFrame:
    tail = F.split(F.substring_index("path", re.sub("^[a-z0-9]+:/+", "/", root).rstrip("/") + "/", -1), "/")
    return with_path_info(files.where(F.col("path").rlike(r"/results/[^/]+$")).withColumns({"category": F.get(tail, F.lit(0)), "model": F.get(tail, F.lit(1))}))


def completeness_stream(arrivals: DataFrame, keys: list[str], run: list[str], time: str | None = None, keep: str = "1 hour") -> DataFrame:
    """Distinct results per run so far; a result that arrives twice counts once.

    time: a column of timestamps; what was seen is then forgotten once the watermark is `keep` past it, so state is bounded by the results of that time and the runs."""
    if time is None:
        return arrivals.dropDuplicates([*run, *keys]).groupBy(*run).agg(F.count("*").alias("arrived"))
    return arrivals.withWatermark(time, keep).dropDuplicatesWithinWatermark([*run, *keys]).groupBy(*run).agg(F.count("*").alias("arrived"))


def against_plan(arrived: DataFrame, expected: DataFrame, run: list[str]) -> DataFrame:
    """run, arrived, expected, complete, foreign: every run that is planned (expected: run, expected) or has results; foreign ones nobody planned."""
    zero = F.lit(0).cast("bigint")
    out = arrived.select(*run, "arrived").join(expected.select(*run, "expected"), run, "full")
    out = out.withColumn("foreign", F.col("expected").isNull()).withColumns({"arrived": F.coalesce("arrived", zero), "expected": F.coalesce("expected", zero)})
    return out.select(*run, "arrived", "expected", (~F.col("foreign") & (F.col("arrived") >= F.col("expected"))).alias("complete"), "foreign")


def foreign(arrivals: DataFrame, seeds: list[int]) -> DataFrame:
    """Arrivals of seeds that nobody planned."""
    return arrivals.where(~F.col("seed").isin(*seeds))


@contextlib.contextmanager
def _state_parts(spark: SparkSession, parts: int | None) -> Iterator[None]:
    """A stream that starts here deals its state into so many parts (None: as the session says) and keeps to them.

    Each part costs a task with a store of its own in each batch and stateful step, however little it holds."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    if parts is not None:
        spark.conf.set(name, str(parts))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(stream: DataFrame, path: str, mode: str, keep_last: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Runs a stream over what there is now and returns its output as a table under path; parts: those of its state."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/_batch={number}")  # a batch that is run again replaces itself

    with _state_parts(spark, parts):
        q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{path}/out")
    if keep_last:
        out = out.groupBy(*keep_last).agg(F.max_by(F.struct(*[c for c in out.columns if c not in keep_last]), "_batch").alias("x")).select(*keep_last, "x.*")
    return out.drop("_batch")


def drain_kinds(stream: DataFrame, path: str, mode: str = "append", parts: int | None = None) -> dict[str, DataFrame]:
    """Runs a stream over what there is now; each kind of row goes to a table of its own under path; parts: those of its state."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/out/_batch={number}")

    with _state_parts(spark, parts):
        q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    kinds = StructType([*(f for f in stream.schema.fields if f.name != "kind"), StructField("_batch", IntegerType()), *(f for f in stream.schema.fields if f.name == "kind")])
    whole = spark.read.schema(kinds).parquet(f"{path}/out")
    return {kind: whole.where(F.col("kind") == kind).drop("_batch", "kind") for kind in (REACTION_ROW, LATE, SUMMARY)}
