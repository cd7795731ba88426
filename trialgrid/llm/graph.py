"""Connected components of links, as joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, release

#: Links, of two numbers each, that one task joins at once; with more there are rounds.
FEW = 1 << 16


def _joined(links: DataFrame) -> DataFrame:
    """node, component for every node of at most FEW links (a, b), in one task."""
    kind = links.schema["a"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        of = None
        for batch in batches:
            of = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = sorted((root(a), root(b)))
                up[b] = a
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), of), pa.array([root(x) for x in list(up)], of)], ["node", "component"])

    return links.repartition(1).mapInArrow(join, f"node {kind}, component {kind}")


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, component for every node that has a link to another; component is the smallest node reachable.

    In each round every node hooks on to its smallest neighbour if that is smaller, links are carried over to the
    nodes that are left and links within a node go. A component's smallest node never hooks, so it is what remains.
    Only minima per node are gathered, in map-side parts; each round is written to the shared folder. Once FEW links or less are
    left, one task joins them, as a round takes the driver four jobs, whatever its size. The caller may
    release what is returned.
    """
    l, r = F.col(left), F.col(right)
    edges = links.where(l != r).select(F.least(l, r).alias("a"), F.greatest(l, r).alias("b")).distinct()
    edges = materialize(edges, "links")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    old = []
    while (n := edges.count()) > FEW:
        # a > b never holds, so only the larger end can hook through a link
        hooks = edges.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to"))
        hooks = materialize(hooks, "hooks")
        labels = labels.join(hooks, labels["component"] == hooks["from"], "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = materialize(labels, "labels")
        release(*old)
        moved = edges.join(hooks.select(F.col("from").alias("a"), F.col("to").alias("a_to")), "a", "left")
        moved = moved.join(hooks.select(F.col("from").alias("b"), F.col("to").alias("b_to")), "b", "left")
        x, y = F.coalesce("a_to", "a"), F.coalesce("b_to", "b")
        old = [edges, hooks, labels]
        edges = materialize(moved.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "links")
    if n:
        rest = _joined(edges)
        if old:
            rest = rest.select(F.col("node").alias("from"), F.col("component").alias("to"))
            rest = labels.join(rest, labels["component"] == rest["from"], "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = materialize(rest, "labels")
        release(edges, *old)
        return labels
    if not old:
        labels.stored_at = edges.stored_at
        return labels
    release(edges, *old[:2])
    return labels
