"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

# Fields of result documents and of route definitions.
REACTION = "struct<ttr:double,dar:double,t_obs_frame:bigint,t_react_frame:bigint,closing_velocity:double,ttc_at_reaction:double,reaction_cause:string,reaction_value:string,reaction_threshold:string>"

CHECKPOINT = f"""
_checkpoint struct<
  progress: array<double>,
  records: array<struct<
    route_id: string, scenario_name: string, town_name: string, weather_id: string, status: string, num_infractions: bigint,
    scores: struct<score_route: double, score_penalty: double, score_composed: double>,
    meta: struct<route_length: double, duration_game: double, duration_system: double>,
    infractions: map<string, array<string>>,
    ttr_dar: struct<ttr: double, dar: double, reaction_detected: boolean, agent_type: string, t_obs_frame: double, t_react_frame: double,
      closing_velocity: double, ttc_at_reaction: double, reaction_cause: string, reaction_value: string, reaction_threshold: string,
      v_start: double, v_end: double, final_distance: double, final_closing_velocity: double, final_ttc: double,
      num_reactions: bigint, all_reactions: array<{REACTION}>>>>>,
entry_status string, eligible boolean, labels array<string>, `values` array<string>"""

# Names of columns and fields that files of these kinds have.
MANIFEST = "path string, sha256 string, category string, scenario string, level string, base_route_id string, prop_blueprint_id string"
SPLIT = "path string, sha256 string, category string, scenario string, level string, base_route_id string, prop_blueprint_id string, tier string, asset_class string, covers string"

ROUTE = """
_id string, _town string, waypoints struct<position: array<struct<_x: double, _y: double, _z: double>>>,
scenarios struct<scenario: array<struct<_name: string, _type: string, trigger_point: struct<_x: double, _y: double, _z: double, _yaw: double>>>>,
weathers struct<weather: array<struct<_route_percentage: double, _cloudiness: double, _precipitation: double>>>"""

# Kinds of the columns of a records table: text, number, true/false/missing, and text that is sometimes a number.
IDENTITY = ("model", "category", "scenario", "route_id", "level", "prop", "prop_raw", "variant", "scenario_name", "town_name", "weather_id", "status", "agent_type", "agent_type_source", "reaction_cause", "all_reactions", "source_relpath")
TRI_STATE = ("success", "hit", "collided_with_agent", "payload_present", "measurement_present")
MIXED = ("reaction_value", "reaction_threshold")
KEY = ("model", "category", "scenario", "route_id", "level", "prop", "seed")

#: A member of an archive of files: what a listing tells of it, and its text.
ARCHIVE = "path string, length bigint, modificationTime timestamp, value string"
