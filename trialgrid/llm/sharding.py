"""Sharding by a hierarchical weighted hash tree (native: DataFrame functions only).

A topology is a tree of regions, racks and shards with weights. A document descends it: at each level every
child draws a number from a hash of (document id, child's name), the draw is divided by the child's weight and
the smallest wins (an exponential race, so a child wins in proportion to its weight). Draws of a child depend on
nothing but the document and the child, so a changed weight moves documents only into, or out of, the subtree
whose weight changed.

Defined results: a null id is hashed as the text 'null'; rows with equal ids go to the same shard; null text has
size `overhead`, CRC 0; an empty table gives an empty result; columns beyond id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import read_table

SLOT_BUCKETS = 64


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None


def build_topology(n_shards: int, racks_per_region: int = 2, shards_per_rack: int = 5) -> tuple[Node, ...]:
    """Regions of racks of equally weighted shards, numbered from 0; a node weighs what its leaves weigh."""
    leaves = [Node(f"s{i}", 1.0, (), i) for i in range(n_shards)]
    racks = [
        Node(f"k{i // shards_per_rack}", float(len(part)), tuple(part))
        for i in range(0, n_shards, shards_per_rack)
        for part in [leaves[i : i + shards_per_rack]]
    ]
    return tuple(
        Node(f"g{i // racks_per_region}", sum(r.weight for r in part), tuple(part))
        for i in range(0, len(racks), racks_per_region)
        for part in [racks[i : i + racks_per_region]]
    )


def grow(topology: tuple[Node, ...], weight: float = 1.0) -> tuple[Node, ...]:
    """One more shard, as a region of its own: no other subtree's weight changes, so rows move only into it."""
    new = 1 + max(leaf.shard for leaf in _leaves(topology))
    return (*topology, Node(f"g+{new}", weight, (Node(f"k+{new}", weight, (Node(f"s{new}", weight, (), new),)),)))


def reweigh(topology: tuple[Node, ...], shard: int, weight: float) -> tuple[Node, ...]:
    """The topology with one shard's weight changed, and with it the weights on the path to it."""

    def change(node: Node) -> Node:
        if node.shard is not None:
            return Node(node.name, weight, (), shard) if node.shard == shard else node
        children = tuple(map(change, node.children))
        return Node(node.name, sum(c.weight for c in children), children)

    return tuple(map(change, topology))


def _leaves(nodes: tuple[Node, ...]) -> list[Node]:
    return [x for n in nodes for x in ([n] if n.shard is not None else _leaves(n.children))]


def tree_shard(key: Column, topology: tuple[Node, ...]) -> Column:
    """The shard that a string key descends to: one race per level among the children of the node reached so far."""
    nodes: list[Node] = [Node("root", 0.0, topology)]
    children: list[list[int]] = []
    for node in nodes:  # grows while it is read: breadth first
        children.append(list(range(len(nodes), len(nodes) + len(node.children))))
        nodes += node.children
    child = [
        F.array(*[F.struct(F.lit(nodes[c].name).alias("name"), F.lit(nodes[c].weight).alias("weight"), F.lit(c).alias("id")) for c in (own or [i])])
        for i, own in enumerate(children)
    ]  # a leaf is its own child, so leaves may lie at different depths
    tree = F.array(*child)

    def draw(c: Column) -> Column:
        """-ln(u) / weight, u in (0, 1) from 48 bits of MD5."""
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), c["name"])), 1, 12), 16, 10).cast("double")
        return F.struct((-F.log((bits + F.lit(1.0)) / F.lit(float(2**48 + 1))) / c["weight"]).alias("d"), c["id"].alias("id"))

    def depth(node: Node) -> int:
        return 1 + max(map(depth, node.children), default=-1)

    at: Column = F.lit(0)
    for _ in range(depth(nodes[0])):
        at = F.array_min(F.transform(F.get(tree, at), draw))["id"]
    return F.get(F.array(*[F.lit(n.shard) if n.shard is not None else F.lit(None).cast("int") for n in nodes]), at)


def assign_shards(df: DataFrame, topology: tuple[Node, ...], id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for each row.

    Slots are numbered without a sort of a whole shard in one task: rows are ranked within (shard, bucket of the
    id), and each bucket starts where the counts of those before it end. The table of counts has at most
    shards x SLOT_BUCKETS rows.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    number = F.col(id_col).cast("long") if whole else F.xxhash64(key)  # other ids are dealt by their hash, in its order
    placed = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        tree_shard(key, topology).cast("int").alias("shard"),
        tree_shard(key, grow(topology)).cast("int").alias("grown_shard"),
        F.pmod(F.coalesce(number, F.lit(0)), F.lit(SLOT_BUCKETS)).cast("int").alias("_bucket"),
    )
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32")
    return (
        placed.withColumn("_rank", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "_bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("_start") + F.col("_rank")).cast("long").alias("slot"), "grown_shard",
        )
    )


def op7_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_table(spark, sf_dir, "documents"), build_topology(40))


def _sql_draw(node: Node) -> str:
    bits = f"(('0x' || substr(md5(k || ':{node.name}'), 1, 12))::BIGINT)::DOUBLE"
    return f"(-ln(({bits} + 1.0) / {float(2**48 + 1)!r}::DOUBLE) / {node.weight!r}::DOUBLE)"


def _sql_descend(nodes: tuple[Node, ...]) -> str:
    def outcome(n: Node) -> str:
        return str(n.shard) if n.shard is not None else _sql_descend(n.children)

    if len(nodes) == 1:
        return outcome(nodes[0])
    race = f"list_position([{', '.join(map(_sql_draw, nodes))}], list_min([{', '.join(map(_sql_draw, nodes))}]))"
    return f"CASE {race} " + " ".join(f"WHEN {i + 1} THEN {outcome(n)}" for i, n in enumerate(nodes)) + " END"


def sharding_sql(n_shards: int = 40) -> str:
    """DuckDB has no CRC-32, so it is folded bit by bit: eight shift steps a byte over the hexadecimal text."""
    top = build_topology(n_shards)
    step = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
    table = "list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: " + step.format(x="a") + "))"
    return f"""
WITH crc_table AS (SELECT {table} AS tab),
hexed AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, coalesce(text, '') AS t FROM documents),
crcs AS (
  SELECT t, CASE WHEN t = '' THEN 0 ELSE xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(strlen(t)), lambda i: ('0x' || substr(hex(encode(t)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
    lambda a, b: xor(a >> 8, tab[(xor(a & 255, b) + 1)::BIGINT])), 4294967295::BIGINT) END AS crc
  FROM (SELECT DISTINCT t FROM hexed), crc_table),
placed AS (
  SELECT doc_id, CAST(strlen(h.t) + 16 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32,
         CAST({_sql_descend(top)} AS INTEGER) AS shard, CAST({_sql_descend(grow(top))} AS INTEGER) AS grown_shard
  FROM hexed h JOIN crcs c ON h.t = c.t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id % {SLOT_BUCKETS}, doc_id, text_crc32) - 1 AS slot, grown_shard
FROM placed"""
