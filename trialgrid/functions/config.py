"""Parameters that operators carry, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass, field

COMPLETED = ("Completed", "Perfect")

# Statuses by disposition.
ACCEPT_STATUSES = ("Perfect", "Completed", "Failed - Agent got blocked", "Failed - Agent deviated from the route", "Failed - Agent timed out")
RETRY_STATUSES = ("Failed", "Failed - Agent couldn't be set up", "Failed - Agent crashed", "Failed - Simulation crashed")
TICKRUNTIME_STATUSES = ("Failed - TickRuntime",)
FATAL_STATUSES = ("Failed - Agent's sensors were invalid",)

# Keys of the map of logged lists; those that never spoil a success.
INFRACTION_KEYS = (
    "collisions_layout", "collisions_pedestrian", "collisions_vehicle", "red_light", "stop_infraction", "outside_route_lanes",
    "min_speed_infractions", "yield_emergency_vehicle_infractions", "scenario_timeouts", "route_dev", "vehicle_blocked", "route_timeout",
)
SKIP_KEYS = ("min_speed_infractions", "ttr_dar", "ttr_dar_analytic", "interaction_correctness", "ic_analytic")
COLLISION_KEYS = ("collisions_layout", "collisions_pedestrian", "collisions_vehicle")

# Labels of reported rates and their columns.
LABEL_COLUMNS = {
    "Avg. driving score": "driving_score",
    "Avg. route completion": "route_completion",
    "Avg. infraction penalty": "infraction_penalty",
    "Collisions with pedestrians": "collisions_pedestrians",
    "Collisions with vehicles": "collisions_vehicles",
    "Collisions with layout": "collisions_layout",
    "Off-road infractions": "off_road_infractions",
}

# What an attempt costs and settles, by how it ended and what is on disk.
LEDGER_RULES = (
    ("CLEAN_EXIT", "NO_FINAL_RECORD", "infra", "no"),
    ("CLEAN_EXIT", "ACCEPT", "none", "yes"),
    ("CLEAN_EXIT", "RETRY_RECORD", "record", "when_spent"),
    ("CLEAN_EXIT", "RETRY_TICKRUNTIME", "tickruntime", "when_spent"),
    ("CLEAN_EXIT", "FATAL", "none", "no"),
    ("CLEAN_EXIT", "UNKNOWN", "record", "when_spent"),
    ("ABNORMAL_END", "NO_FINAL_RECORD", "infra", "no"),
    ("ABNORMAL_END", "ACCEPT", "none", "yes"),
    ("ABNORMAL_END", "RETRY_RECORD", "killed", "when_spent"),
    ("ABNORMAL_END", "RETRY_TICKRUNTIME", "tickruntime", "when_spent"),
    ("ABNORMAL_END", "FATAL", "none", "no"),
    ("ABNORMAL_END", "UNKNOWN", "killed", "when_spent"),
    ("NEVER_STARTED", "NO_FINAL_RECORD", "infra", "no"),
    ("NEVER_STARTED", "ACCEPT", "infra", "no"),
    ("NEVER_STARTED", "RETRY_RECORD", "infra", "no"),
    ("NEVER_STARTED", "RETRY_TICKRUNTIME", "infra", "no"),
    ("NEVER_STARTED", "FATAL", "infra", "no"),
    ("NEVER_STARTED", "UNKNOWN", "infra", "no"),
    ("TORN_DOWN", "NO_FINAL_RECORD", "none", "no"),
    ("TORN_DOWN", "ACCEPT", "none", "yes"),
    ("TORN_DOWN", "RETRY_RECORD", "none", "no"),
    ("TORN_DOWN", "RETRY_TICKRUNTIME", "none", "no"),
    ("TORN_DOWN", "FATAL", "none", "no"),
    ("TORN_DOWN", "UNKNOWN", "none", "no"),
)

# Reference clusters of sizes in metres, (mean, deviation) of length, width, height.
CAR_CLUSTER = {"l": (4.529180, 0.722124), "w": (1.951264, 0.163473), "h": (1.573888, 0.170715)}
CHILD_CLUSTER = {"l": (0.453275, 0.064487), "w": (0.453275, 0.064487), "h": (1.175000, 0.103510)}
ADULT_MEANS = {"l": 0.375400, "w": 0.375400, "h": 1.860000}
STATIC_ANCHOR = {"l": 2.3734, "w": 2.8706, "h": 3.5695}


# Thresholds, budgets and expected counts, which results depend on.
@dataclass(frozen=True)
class Telemetry:
    """Thresholds of the reaction detector; distances in metres, times in seconds."""

    rate: float = 20.0
    smooth: int = 5
    d_obs: float = 50.0
    ttc_max: float = 10.0
    d_min: float = 15.0
    rho: float = 0.20
    theta_a: float = 1.0
    theta_y: float = 0.5
    tau: float = 0.5
    use_p1: bool = False

    @property
    def tau_frames(self) -> int:
        return int(self.tau * self.rate)


@dataclass(frozen=True)
class Budgets:
    record: int = 2
    tickruntime: int = 0
    infra: int = 2
    killed: int = 2


@dataclass(frozen=True)
class EngineConfig:
    seeds: tuple[int, ...] = (42, 43, 44)
    expected: dict[str, int] = field(default_factory=lambda: {"pedestrian": 162, "static": 70, "vehicle": 243})
    visual_share: float = 0.20
    z_visual: float = 2.0
    z_geometric: float = 3.0
    height_saturation: float = 2.0
    telemetry: Telemetry = Telemetry()
    budgets: Budgets = Budgets()


CONFIG = EngineConfig()
