"""Reaction metrics and criteria over per-tick telemetry.

All windows are partitioned by run and ordered by frame, so they share one shuffle and one sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.config import Telemetry


def _ticks():
    return Window.partitionBy("run_id").orderBy("frame")


def _run():
    return Window.partitionBy("run_id")


def with_accel(tel: DataFrame, p: Telemetry = Telemetry()) -> DataFrame:
    a = (F.col("ego_velocity") - F.lag("ego_velocity", 1).over(_ticks())) * p.rate
    return tel.withColumn("accel", F.coalesce(a, F.lit(0.0)))


def closing_velocity(tel: DataFrame, p: Telemetry = Telemetry(), fallback: bool = True) -> DataFrame:
    """Over the last `smooth` samples, else the last one if there are two, else the vehicle's speed (or null)."""
    n = F.row_number().over(_ticks()) - 1

    def back(k: int) -> Column:
        dt = (F.col("frame") - F.lag("frame", k).over(_ticks())) / p.rate
        return (F.lag("distance", k).over(_ticks()) - F.col("distance")) / F.when(dt > 0, dt)

    cv = F.when(n >= p.smooth, back(p.smooth)).when(n >= 2, back(1))
    return tel.withColumn("closing", F.coalesce(cv, F.col("ego_velocity")) if fallback else cv)


def relevance(tel: DataFrame, p: Telemetry = Telemetry()) -> DataFrame:
    ttc = F.when(F.col("closing") > 0.5, F.col("distance") / F.col("closing")).otherwise(float("inf"))
    return tel.withColumn("ttc", ttc).withColumn("relevant", (F.col("ttc") <= p.ttc_max) | (F.col("distance") < p.d_min))


def t_obs(tel: DataFrame, p: Telemetry = Telemetry()) -> DataFrame:
    return tel.withColumn("t_obs", F.min(F.when(F.col("distance") <= p.d_obs, F.col("frame"))).over(_run()))


def reaction_candidates(tel: DataFrame, p: Telemetry = Telemetry()) -> DataFrame:
    """Ticks with the primitive that holds there (cause, value, threshold as text), null where none does."""
    tel = t_obs(relevance(closing_velocity(with_accel(tel, p), p), p), p)
    k = p.tau_frames
    span = _ticks().rowsBetween(-k, 0)
    full = F.row_number().over(_ticks()) > k
    v0 = F.lag("ego_velocity", k).over(_ticks())
    change = F.abs(F.col("ego_velocity") - v0) / v0
    lateral = F.abs(F.col("lateral_offset") - F.lag("lateral_offset", k).over(_ticks())) / p.tau
    lane0 = F.lag("lane_id", k).over(_ticks())
    tel = tel.withColumns({
        "_p1": full & F.lit(p.use_p1) & (v0 > 0.1) & (change >= p.rho), "_v1": change,
        "_p2": full & (F.max("accel").over(span) <= -p.theta_a), "_v2": F.min("accel").over(span),
        "_p3": full & (lateral >= p.theta_y), "_v3": lateral,
        "_p4": full & (lane0 != F.col("lane_id")), "_v4": F.concat(lane0.cast("string"), F.lit(" -> "), F.col("lane_id").cast("string")),
    })
    row = lambda cause, value, threshold: F.struct(F.lit(cause).alias("cause"), value.cast("string").alias("value"), F.lit(str(threshold)).alias("threshold"))
    cause = (
        F.when(F.col("_p1"), row("P1_speed_change", F.col("_v1"), p.rho)).when(F.col("_p2"), row("P2_deceleration", F.col("_v2"), -p.theta_a))
        .when(F.col("_p3"), row("P3_lateral", F.col("_v3"), p.theta_y)).when(F.col("_p4"), row("P3_lane_change", F.col("_v4"), "lane_change"))
    )
    return tel.withColumn("_c", cause).select(*[c for c in tel.columns if c[:2] not in ("_p", "_v")], "_c.cause", "_c.value", "_c.threshold")


def select_reactions(candidates: DataFrame, p: Telemetry = Telemetry(), parts: int | None = None) -> DataFrame:
    """Accepted reactions: observed, relevant, before a collision, a refractory time apart; with ttr, dar and their order.

    Candidates are read once in order of run and frame; only the last accepted frame is kept, so a run may be of any length.
    parts: into how many partitions they are dealt by run; those of spark.sql.shuffle.partitions if none."""
    hits = candidates.where(F.col("cause").isNotNull() & F.col("relevant") & (F.col("frame") >= F.col("t_obs")))
    hits = hits.where(F.col("collision_frame").isNull() | (F.col("frame") < F.col("collision_frame")))
    seconds = (F.col("frame") - F.col("t_obs")) / p.rate
    rows = hits.select("run_id", F.col("frame").cast("bigint").alias("frame"), F.lit(0).alias("order"), "cause", "value", "threshold", seconds.alias("ttr"), F.col("distance").alias("dar"), "closing", "ttc", "t_obs")
    gap = p.tau_frames

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last, order, started = None, 0, 0, False
        for batch in batches:
            kept, orders = [], []
            for i, (own, frame) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if not started or own != run:
                    run, order, started = own, 0, True
                elif frame - last < gap:
                    continue
                kept.append(i)
                orders.append(order)
                last, order = frame, order + 1
            out = batch.take(pa.array(kept, pa.int64()))
            yield out.set_column(2, "order", pa.array(orders, pa.int32()))

    dealt = rows.repartition(parts, "run_id") if parts else rows.repartition("run_id")
    return dealt.sortWithinPartitions("run_id", "frame").mapInArrow(pick, rows.schema)


def reaction_summary(tel: DataFrame, reactions: DataFrame, p: Telemetry = Telemetry()) -> DataFrame:
    """A row per run: its first reaction, or the last distance, closing velocity and time to collision."""
    last = tel.withColumns({"_before": F.lag("distance", 1).over(_ticks()), "_dt": (F.col("frame") - F.lag("frame", 1).over(_ticks())) / p.rate})
    last = last.groupBy("run_id").agg(F.max_by(F.struct("distance", "_before", "_dt"), "frame").alias("x"), F.min(F.when(F.col("distance") <= p.d_obs, F.col("frame"))).alias("t_obs"))
    cv = (F.col("x._before") - F.col("x.distance")) / F.when(F.col("x._dt") > 0, F.col("x._dt"))
    first = reactions.groupBy("run_id").agg(F.count("*").alias("num_reactions"), F.min_by(F.struct("ttr", "dar", "cause", "frame"), "frame").alias("r"))
    none = F.col("num_reactions").isNull()
    return last.join(first, "run_id", "left").select(
        "run_id", "t_obs", F.coalesce("num_reactions", F.lit(0)).alias("num_reactions"), "r.ttr", "r.dar", F.col("r.cause").alias("cause"),
        F.when(none, F.col("x.distance")).alias("final_distance"), F.when(none, cv).alias("final_closing"), F.when(none & (cv > 0.5), F.col("x.distance") / cv).alias("final_ttc"),
    )


def telemetry_summary(tel: DataFrame, p: Telemetry = Telemetry()) -> DataFrame:
    """Extremes per run: speed, acceleration, distance, time to collision, lateral speed; frames logged and observed."""
    t = closing_velocity(with_accel(tel, p), p, fallback=False)
    lateral = F.abs(F.col("lateral_offset") - F.lag("lateral_offset", 1).over(_ticks())) * p.rate
    t = t.withColumns({"_ttc": F.when(F.col("closing") > 0.5, F.col("distance") / F.col("closing")), "_lat": lateral})
    return t.groupBy("run_id").agg(
        F.min("distance").alias("min_distance"), F.max("ego_velocity").alias("max_velocity"), F.min("ego_velocity").alias("min_velocity"), F.min("accel").alias("min_acceleration"),
        (-F.min("accel")).alias("max_deceleration"), F.min("_ttc").alias("min_ttc"), F.max("_lat").alias("max_lateral_velocity"), F.count("*").alias("frames"),
        F.count(F.when(F.col("distance") <= p.d_obs, 1)).alias("frames_observed"),
    )


def debounce(events: DataFrame, max_time: float, by: list[str], time: str = "t") -> DataFrame:
    """A collision with the same actor within max_time of the one before belongs to it: the first of each burst, and its size."""
    w = Window.partitionBy(*by, "actor").orderBy(time, "event_id")
    new = F.coalesce(F.col(time) - F.lag(time, 1).over(w) > max_time, F.lit(True))
    bursts = events.withColumn("_b", F.sum(new.cast("int")).over(w))
    return bursts.groupBy(*by, "actor", "_b").agg(F.min(time).alias(time), F.count("*").alias("n")).drop("_b")


def collision_kind(actor_type: Column) -> Column:
    static = (actor_type.contains("static") | actor_type.contains("traffic")) & ~actor_type.contains("sidewalk")
    return F.when(static, "collisions_layout").when(actor_type.contains("vehicle"), "collisions_vehicle").when(actor_type.contains("walker"), "collisions_pedestrian")


def blocked(tel: DataFrame, v_min: float, max_time: float, p: Telemetry = Telemetry()) -> DataFrame:
    """Stretches slower than v_min for longer than max_time: run_id, start, end, seconds."""
    slow = F.col("ego_velocity") < v_min
    isle = tel.withColumn("_slow", slow).withColumn("_g", F.sum((~slow).cast("int")).over(_ticks()))
    out = isle.where("_slow").groupBy("run_id", "_g").agg(F.min("frame").alias("start"), F.max("frame").alias("end"))
    return out.withColumn("seconds", (F.col("end") - F.col("start")) / p.rate).where(F.col("seconds") > max_time).drop("_g")


def offlane(tel: DataFrame, lane: Column, p: Telemetry = Telemetry()) -> DataFrame:
    """Metres outside the lane, their share of all metres, the message."""
    step = F.coalesce(F.col("ego_velocity") * (F.col("frame") - F.lag("frame", 1).over(_ticks())) / p.rate, F.lit(0.0))
    t = tel.withColumn("_step", step).withColumn("_out", ~lane)
    out = t.groupBy("run_id").agg(F.sum(F.when(F.col("_out"), F.col("_step")).otherwise(0.0)).alias("wrong"), F.sum("_step").alias("total"))
    share = F.when(F.col("total") > 0, F.col("wrong") / F.col("total") * 100)
    text = F.concat(F.lit("outside its lanes for about "), F.format_string("%.1f", F.round("wrong", 1)), F.lit(" meters"))
    return out.withColumns({"percentage": share, "message": F.when(F.col("wrong") > 0, text)})


def route_progress(tel: DataFrame, waypoints: DataFrame, look_ahead: int = 5) -> DataFrame:
    """run_id, frame, furthest waypoint passed, per cent of the route. tel: x, y; waypoints: run_id, idx, x, y, fx, fy (forward).

    A tick can pass the waypoints of a band around the length that it has driven; ticks and waypoints meet on the band's
    number, not all with all."""
    wp = Window.partitionBy("run_id").orderBy("idx")
    step = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x", 1).over(wp), 2) + F.pow(F.col("y") - F.lag("y", 1).over(wp), 2)), F.lit(0.0))
    w = waypoints.withColumn("_step", step).withColumn("acc", F.sum("_step").over(wp)).withColumn("total", F.sum("_step").over(Window.partitionBy("run_id")))
    width = w.groupBy("run_id").agg((F.max("total") / F.greatest(F.count("*") - 1, F.lit(1)) * look_ahead).alias("_w"))
    w = w.join(width, "run_id").withColumn("_band", F.floor(F.col("acc") / F.greatest("_w", F.lit(1e-9))))
    driven = F.sum(F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x", 1).over(_ticks()), 2) + F.pow(F.col("y") - F.lag("y", 1).over(_ticks()), 2)), F.lit(0.0))).over(_ticks())
    t = tel.withColumn("_d", driven).join(width, "run_id").withColumn("_b", F.floor(F.col("_d") / F.greatest("_w", F.lit(1e-9))))
    t = t.select("run_id", "frame", F.col("x").alias("px"), F.col("y").alias("py"), F.explode(F.array(F.col("_b") - 1, F.col("_b"))).alias("_band"))
    met = t.join(w, ["run_id", "_band"]).where((F.col("px") - F.col("x")) * F.col("fx") + (F.col("py") - F.col("y")) * F.col("fy") > 0)
    best = met.groupBy("run_id", "frame").agg(F.max(F.struct("idx", "acc", "total")).alias("m"))
    out = tel.select("run_id", "frame").join(best, ["run_id", "frame"], "left")
    top = F.max("m").over(_ticks())
    return out.select("run_id", "frame", F.coalesce(top["idx"], F.lit(0)).alias("waypoint"), F.round(F.coalesce(top["acc"] / top["total"] * 100, F.lit(0.0)), 2).alias("progress"))


def speed_ratio(tel: DataFrame, traffic: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Mean speed against that of the traffic around, in per cent; 100 without traffic."""
    ego = tel.groupBy("run_id").agg(F.avg("ego_velocity").alias("ego"))
    other = traffic.groupBy("run_id").agg(F.avg("speed").alias("background"))
    value = F.round(F.col("ego") / (ratio * F.when(F.col("background") != 0, F.col("background"))) * 100, 2)
    return ego.join(other, "run_id", "left").withColumn("checkpoint", F.coalesce(value, F.lit(100.0)))


def route_length(waypoints: DataFrame) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("idx")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x", 1).over(w), 2) + F.pow(F.col("y") - F.lag("y", 1).over(w), 2))
    return waypoints.withColumn("_s", F.coalesce(step, F.lit(0.0))).groupBy("run_id").agg(F.sum("_s").alias("length"))


def streaks(attempts: DataFrame, by: str, order: str = "attempt_no") -> DataFrame:
    """Failures of the machine in a row up to each attempt, reset by a genuine record; and all so far."""
    w = Window.partitionBy(by).orderBy(order)
    infra = F.col("infra").cast("int")
    isle = attempts.withColumn("_g", F.sum(F.col("genuine").cast("int")).over(w))
    return isle.withColumns({"streak": F.sum(infra).over(Window.partitionBy(by, "_g").orderBy(order)), "lifetime": F.sum(infra).over(w)}).drop("_g")
