"""From nested result documents to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import config as C
from ..functions import scalars as S

LEVELS = ("base", "visual_shift", "geometric_shift")


def with_path_info(df: DataFrame, path: str = "path") -> DataFrame:
    """scenario, level, route_id, variant, seed from .../{scenario}/{level}/.../results/route_{id}_{variant}_seed{n}.json.

    An unknown level is blank; a name of another form gives its stem as the id."""
    parts = F.split(F.col(path), "/")
    name = F.element_at(parts, -1)
    fits = name.rlike(S.RESULT_NAME)
    known = F.array(*map(F.lit, LEVELS))
    at = F.aggregate(F.transform(parts, lambda p, i: F.when(F.array_contains(known, p), i)), F.lit(None).cast("int"), lambda a, i: F.coalesce(a, i))
    scenario = F.when(at.isNotNull() & (at > 0), F.get(parts, at - 1)).otherwise(F.get(parts, F.size(parts) - 4))
    return df.withColumns({
        "scenario": F.coalesce(scenario, F.lit("")),
        "level": F.coalesce(F.get(parts, at), F.lit("")),
        "route_id": F.when(fits, F.regexp_extract(name, S.RESULT_NAME, 1)).otherwise(F.regexp_replace(name, r"\.json$", "")),
        "variant": F.when(fits, F.regexp_extract(name, S.RESULT_NAME, 2)).otherwise(""),
        "seed": F.when(fits, F.regexp_extract(name, S.RESULT_NAME, 3).cast("int")),
    })


def zip_labels(labels: Column, values: Column, mapping: dict[str, str]) -> dict[str, Column]:
    """Columns of doubles from parallel arrays; a short array leaves columns missing, of equal labels the last one counts."""

    def pick(label: str) -> Column:
        rows = F.filter(F.arrays_zip(labels.alias("k"), values.alias("v")), lambda x: (x["k"] == label) & x["v"].isNotNull())
        return S.try_double(F.try_element_at(F.transform(rows, lambda x: x["v"]), F.lit(-1)))

    return {column: F.when(labels.isNotNull() & values.isNotNull(), pick(label)) for label, column in mapping.items()}


def infraction_counts(kinds: Column) -> dict[str, Column]:
    """n_{key} for each known key of a map of lists, and their sum without those that never spoil a success."""
    counts = {f"n_{k}": F.coalesce(F.size(F.try_element_at(kinds, F.lit(k))), F.lit(0)).cast("long") for k in C.INFRACTION_KEYS}
    counts = {k: F.greatest(v, F.lit(0)) for k, v in counts.items()}
    scoring = [counts[f"n_{k}"] for k in C.INFRACTION_KEYS if k not in C.SKIP_KEYS]
    total = scoring[0]
    for c in scoring[1:]:
        total = total + c
    return counts | {"n_infractions_scoring": total}


def success(records: Column) -> Column:
    """The first record completed, and no list of any record that counts holds anything."""
    skip = F.array(*map(F.lit, C.SKIP_KEYS))

    def clean(r: Column) -> Column:
        entries = F.coalesce(F.map_entries(r["infractions"]), F.array().cast("array<struct<key:string,value:array<string>>>"))
        return F.forall(entries, lambda e: F.array_contains(skip, e["key"]) | e["value"].isNull() | (F.size(e["value"]) <= 0))

    done = F.coalesce(F.get(records, F.lit(0))["status"].isin(*C.COMPLETED), F.lit(False))
    return F.coalesce((F.size(records) > 0) & done & F.forall(records, clean), F.lit(False))


def collision_types(records: Column) -> Column:
    """type=... of every collision message of every record, in order."""
    def of(r: Column) -> Column:
        lists = [F.coalesce(F.try_element_at(r["infractions"], F.lit(k)), F.array().cast("array<string>")) for k in C.COLLISION_KEYS]
        return F.concat(*lists)

    messages = F.flatten(F.transform(records, of))
    return F.filter(F.transform(messages, lambda m: F.regexp_extract(m, r"type=([^\s]+)", 1)), lambda t: t != "")


def payload_flags(payload: Column, field: str = "ttr") -> dict[str, Column]:
    """Whether a payload is there, and whether it holds a measurement."""
    return {"payload_present": payload.isNotNull(), "measurement_present": payload[field].isNotNull() & ~F.isnan(payload[field])}


def num_reactions(payload: Column) -> Column:
    """The stated count, or else the length of the list."""
    return F.coalesce(payload["num_reactions"], F.when(payload["all_reactions"].isNotNull(), F.size(payload["all_reactions"]).cast("long")))


def flatten_checkpoint(df: DataFrame) -> DataFrame:
    """A row for each document: scalars of its first record, counts, success, collision types, reported rates, payload."""
    ck, first = F.col("_checkpoint"), F.get(F.col("_checkpoint.records"), F.lit(0))
    keep = [c for c in df.columns if c not in ("_checkpoint", "entry_status", "eligible", "labels", "values")]
    scores, meta, ttr = first["scores"], first["meta"], first["ttr_dar"]
    return df.select(
        *keep,
        first["route_id"].alias("record_route_id"), first["scenario_name"].alias("scenario_name"), first["town_name"].alias("town_name"), first["weather_id"].alias("weather_id"),
        first["status"].alias("status"), success(ck["records"]).alias("success"),
        *(S.nan_to_null(scores[c]).alias(c) for c in ("score_composed", "score_route", "score_penalty")),
        *(c.alias(n) for n, c in zip_labels(F.col("labels"), F.col("values"), C.LABEL_COLUMNS).items()),
        *(S.nan_to_null(meta[c]).alias(c) for c in ("route_length", "duration_game", "duration_system")),
        *(c.alias(n) for n, c in infraction_counts(first["infractions"]).items()),
        collision_types(ck["records"]).alias("collision_types"),
        ttr["agent_type"].alias("agent_type"),
        *(c.alias(n) for n, c in payload_flags(ttr).items()),
        *(S.nan_to_null(ttr[c]).alias(c) for c in ("ttr", "dar", "closing_velocity", "ttc_at_reaction", "final_distance", "final_ttc")),
        *(ttr[c].alias(c) for c in ("reaction_cause", "reaction_value", "reaction_threshold", "all_reactions")),
        num_reactions(ttr).alias("num_reactions"),
    )


def is_final(progress: Column, n_records: Column) -> Column:
    """progress: JSON texts of its entries, so that true is no number. Two entries at least, whole numbers, all of a positive total done, a record."""

    def whole(i: int) -> Column:
        text = F.get(progress, F.lit(i))
        number = text.try_cast("double")
        return F.when(text.rlike(r"^-?[0-9]") & (number == F.floor(number)), number)

    return F.coalesce((F.size(progress) >= 2) & (whole(1) > 0) & (whole(0) >= whole(1)) & (n_records > 0), F.lit(False))


def disposition(status: Column) -> Column:
    return (
        F.when(status.isin(*C.ACCEPT_STATUSES), "accept").when(status.isin(*C.RETRY_STATUSES), "retry")
        .when(status.isin(*C.TICKRUNTIME_STATUSES), "retry_tickruntime").when(status.isin(*C.FATAL_STATUSES), "fatal").otherwise("unknown")
    )


def skip_on_resume(final: Column, disposed: Column, mode: str) -> Column:
    """Whether a record alone is reason enough not to run again."""
    if mode not in ("skip_terminal", "skip_any_final", "none"):
        raise ValueError(f"unknown resume mode: {mode!r}")
    if mode == "none":
        return F.lit(False)
    return final if mode == "skip_any_final" else final & (disposed == "accept")


def decide(df: DataFrame, budgets: C.Budgets, mode: str) -> DataFrame:
    """df (final, status, attempts_record, attempts_tickruntime, attempts_infra, attempts_killed) with decision, reason, settled.

    The order of the gates is binding: fatal, skip, forced mode, the record's own budget, the machine's."""
    final, disposed = F.col("final"), disposition(F.col("status"))
    of = lambda c: F.coalesce(F.col(c), F.lit(0))
    infra_gone = (of("attempts_infra") > 0) & (of("attempts_infra") >= budgets.infra)
    killed_gone = (of("attempts_killed") > 0) & (of("attempts_killed") >= budgets.killed)
    retry = disposed.isin("retry", "unknown")
    own_gone = F.when(retry, killed_gone | (of("attempts_record") >= budgets.record)).otherwise(of("attempts_tickruntime") >= budgets.tickruntime)
    label = F.when(retry & killed_gone, "killed").when(retry, "record").otherwise("tickruntime")
    row = lambda decision, reason, settled: F.struct(F.lit(decision).alias("decision"), reason.alias("reason"), F.lit(settled).alias("settled"))
    outcome = (
        F.when(final & (disposed == "fatal"), row("fatal", F.lit("fatal status"), False))
        .when(skip_on_resume(final, disposed, mode), row("skip_done", F.lit("final record"), True))
        .when(F.lit(mode == "none"), row("run", F.lit("forced"), False))
        .when(final & (disposed == "accept"), row("skip_done", F.lit("final record"), True))
        .when(final & own_gone, row("skip_exhausted", F.concat(label, F.lit(" budget spent")), True))
        .when(final & infra_gone, row("skip_exhausted", F.lit("infra budget spent, record is old"), False))
        .when(final, row("run", F.concat(F.lit("retry, "), label, F.lit(" budget left")), False))
        .when(infra_gone, row("skip_exhausted", F.lit("infra budget spent, no record"), False))
        .otherwise(row("run", F.lit("no result yet"), False))
    )
    return df.withColumn("_o", outcome).select(*df.columns, "_o.decision", "_o.reason", "_o.settled")


def check_shape(df: DataFrame) -> DataFrame:
    """path, category, level, route_id, variant, blueprint: do the file's name, folders and id agree?"""
    parts = F.split("path", "/")
    return df.withColumns({
        "path_ok": F.col("path").startswith(F.concat_ws("/", "category", "scenario", "level")),
        "name_ok": S.stem(F.col("path")) == F.concat(F.lit("route_"), F.col("route_id"), F.lit("_"), F.col("variant")),
        "tail_ok": F.substring(S.last_dotted(F.col("blueprint")), -1, 1) == F.substring("variant", -1, 1),
        "depth_ok": F.size(parts) == 4,
    })


def check_vocab(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """df (category, token, id) against vocab (category, token, id): ok, unknown_token or wrong_id."""
    known = F.broadcast(vocab.select("category", "token", F.col("id").alias("_expected")))
    verdict = F.when(F.col("_expected").isNull(), "unknown_token").when(F.col("_expected").eqNullSafe(F.col("id")), "ok").otherwise("wrong_id")
    return df.join(known, ["category", "token"], "left").withColumn("verdict", verdict).drop("_expected")


def unsafe_path(path: Column) -> Column:
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..") | path.contains("\\")


def scaffolding(path: Column, patterns: list[str]) -> Column:
    """Whether any component of a path matches any of the patterns."""
    return F.exists(F.split(path, "/"), lambda c: c.rlike("|".join(f"(?:{p})" for p in patterns)))


def select_tier(df: DataFrame, tier: str, tiers: tuple[str, ...] = ("smoke", "core", "full")) -> DataFrame:
    if tier not in tiers:
        raise ValueError(f"unknown tier: {tier!r}")
    return df.where(F.col("tier") == tier)


def attribute_fallback(model: Column, ours: Column, family: str = "vehicle") -> Column:
    """Whether a replaced model is the one under test: the exact id or a template; for walkers any of the family."""
    if family == "walker":
        return model.startswith("walker.")
    return model.endswith(".template") | model.eqNullSafe(ours)


def valid_id(c: Column, family: str) -> Column:
    return c.rlike(rf"^{family}\.[a-z0-9_]+(\.[a-z0-9_]+)*$")


def mismatch_kind(expected: Column, observed: Column) -> Column:
    same = S.first_dotted(expected) == S.first_dotted(observed)
    return F.when(observed.isNull() | (observed == "unknown"), "absent").when(expected == observed, "match").when(same, "same_family").otherwise("wrong_family")


# Forms of log lines.
LOG_PATTERNS = {
    "fallback": r"Actor model (\S+) not available\. Using instead (\S+)",
    "skip": r"Skipping scenario '([^']*)' due to setup error: (.*)",
    "cannot_spawn": r"Cannot spawn actor (\S+) at position",
    "failed_spawn": r"Couldn't spawn (the parked vehicle|the parked actor|the leading vehicle|an obstacle actor|the vehicle in front of the ego)",
    "killed": r"\b[0-9]+\s+Killed\b|\bKilled\s+python\b",
}


def log_events(lines: DataFrame, patterns: dict[str, str] | None = None, value: str = "value") -> DataFrame:
    """lines with kind and up to two captures, for lines that match a pattern; the first in order counts. One pass."""
    patterns = patterns or LOG_PATTERNS
    kind, first, second = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, p in reversed(patterns.items()):
        groups = p.count("(") - p.count(r"\(") - p.count("(?")
        hit = F.col(value).rlike(p)
        kind = F.when(hit, name).otherwise(kind)
        first = F.when(hit, F.regexp_extract(value, p, 1) if groups >= 1 else F.lit("")).otherwise(first)
        second = F.when(hit, F.regexp_extract(value, p, 2) if groups >= 2 else F.lit("")).otherwise(second)
    return lines.withColumns({"kind": kind, "a": first, "b": second}).where(F.col("kind").isNotNull())


def route_verdict(runs: DataFrame, events: DataFrame) -> DataFrame:
    """runs (run_id, route_id, record_route_id, status, entry_status, blueprint) and their log events (run_id, kind, a): the verdict by precedence."""
    own = runs.select("run_id", "blueprint")
    seen = events.join(own, "run_id").groupBy("run_id").agg(
        F.bool_or((F.col("kind") == "fallback") & attribute_fallback(F.col("a"), F.col("blueprint"))).alias("fell_back"),
        F.bool_or((F.col("kind") == "skip") | (F.col("kind") == "cannot_spawn") & (F.col("a") == F.col("blueprint"))).alias("absent"),
    )
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    verdict = (
        F.when(~F.coalesce(F.col("record_route_id").contains(F.col("route_id")), F.lit(False)), "stale")
        .when(~F.coalesce(F.col("status").startswith("Completed") | F.col("status").startswith("Perfect"), F.lit(False)), "status")
        .when(F.col("entry_status").isNotNull() & (F.col("entry_status") != "Finished"), "harness")
        .when(no("fell_back"), "fallback").when(no("absent"), "absent").otherwise("ok")
    )
    return runs.join(seen, "run_id", "left").withColumn("verdict", verdict).drop("fell_back", "absent")
