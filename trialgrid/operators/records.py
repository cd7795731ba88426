"""The whole chain from result documents to the records table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import attribute as A
from .extract import flatten_checkpoint

#: What tells a run of one seed from a run of another in the same place.
PLACE = ["model", "category", "scenario", "record_route_id", "level", "prop"]


def build_records(docs: DataFrame, names: DataFrame, order: list, ceiling_seed: int, keys: list[str] = ["category", "variant"], blank: tuple[str, ...] = ("agent_type",), guard: str = "score_composed", tolerance: float = 1e-6) -> DataFrame:
    """A row for each document, with agent_type, agent_type_source, hit_count, prop, prop_raw and aligned.

    Documents are flattened; types that are missing are filled where all that is known for (category, variant) agrees; collisions are attributed under old ids; ids are renamed; columns of
    other seeds that are blank are filled from the ceiling seed's row of the same place if the guard metric agrees. aligned is 'ceiling' for that seed's own rows."""
    flat = flatten_checkpoint(docs)
    filled = A.fill_agent_type(flat, A.infer_unanimous(flat, keys, "agent_type"), keys)
    renamed = A.rename(A.attribute(filled), names)
    frozen = renamed.where(F.col("seed") == ceiling_seed)
    others = A.align_blank_only(renamed.where(~F.col("seed").eqNullSafe(ceiling_seed)), frozen, PLACE, list(blank), guard, order, tolerance)
    return others.unionByName(frozen.withColumn("aligned", F.lit("ceiling")))
