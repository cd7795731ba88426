"""Prefix trie of conversations, with what its subtrees hold, by the Euler-tour technique.

A conversation is a sequence of turns (role, text); each distinct sequence of first d turns is a node of depth d. Turns are read
once and stand for themselves by 120 bits of a digest from then on. A prefix is told by its depth and a polynomial of its turns'
digests in four primes, 124 bits, which is put together from pieces: ranks and polynomials are found in two passes over rows in
order, first within each range of rows, then by adding what the ranges before hold of the conversation that goes on. So a
conversation may have any number of turns.

The smallest conversation that passes through a node and the node's depth name it. Each node gives an enter arc and an exit arc,
and each arc its follower: an enter arc goes on to the first child, or else to the node's exit; an exit arc to the next sibling, or
else to the parent's exit. Children stand in order of their smallest conversation, whose neighbours are found in rows in order, so
a node may have any number of children.

The tour is a linked list, which is ranked by contraction: arcs are dealt by ranges of (conversation, depth), within which each
chain of arcs becomes one longer arc that keeps the sums over its chain. As long as the list has more than `final` arcs, what is
left is dealt anew; a round that leaves over half of it is followed by one that takes out arcs by lot between neighbours, which
needs no locality. The last round is one task of at most `final` arcs. Then sums are handed back round by round, and each arc has
its position and the sums before it: the leaves and savings between a node's two arcs are those of its subtree.

Ids of conversations that end at a node are hashed in order from pieces that ranges of rows have put together, so a node at which
very many end is no list in memory.

Defined results: rows without a conv_id belong to no conversation; turns stand in order of `turn`, null first, equal ones in order of the
digest of role and text; repeated rows are turns of their own; null roles and texts are empty; a conversation whose rebuilt form has no
turns is a member of the root; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize, partitions_for, read_table, release

SPREAD, HEADS = 5, 9
ROWS, FINAL, CHUNK = 200_000, 1 << 16, 8192
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483563], np.int64)
BASES = np.array([1103515245, 69069003, 1664525017, 214013011], np.int64)
KEY = ["conv", "depth", "side"]


def head_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the one that it is built on."""
    return F.crc32(F.encode(conv.cast("string"), "UTF-8")) % HEADS


def _digest(role: Column, text: Column) -> list[Column]:
    """120 bits of MD5 over role and text, as two numbers that sort like the digest."""
    code = F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))
    return [F.conv(F.substring(code, at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "f1"), (16, "f2"))]


class _Powers:
    """Powers of the bases in their primes, grown as needed."""

    def __init__(self) -> None:
        self.table = np.ones((1, 4), np.int64)

    def __call__(self, at: np.ndarray) -> np.ndarray:
        most = int(at.max(initial=0))
        while len(self.table) <= most:
            n = len(self.table)
            self.table = np.vstack([self.table, self.table * (self.table[-1] * BASES % PRIMES) % PRIMES])
            assert len(self.table) == 2 * n
        return self.table[at]


def _power(exponent: int) -> np.ndarray:
    return np.array([pow(int(b), exponent, int(p)) for b, p in zip(BASES, PRIMES)], np.int64)


def _split(f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
    return np.stack([f1 >> 30, f1 & ((1 << 30) - 1), f2 >> 30, f2 & ((1 << 30) - 1)], axis=1)


def _pack(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (s[:, 0] << 31) | s[:, 1], (s[:, 2] << 31) | s[:, 3]


def _unpack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = (1 << 31) - 1
    return np.stack([a >> 31, a & low, b >> 31, b & low], axis=1)


SCANNED = "part int, conv long, rank long, a long, b long, pa long, pb long, f1 long, f2 long, bytes long"


def _scanned(rows: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """rows (conv, f1, f2, bytes) in order within each conversation: rank, prefix (a, b) and the prefix before (pa, pb), each counted from the start of a range of rows (part)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, last, rank, sums, part = _Powers(), None, 0, np.zeros(4, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            number, conv, f1, f2, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            part = number
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            length = np.diff(np.r_[starts, len(conv)])
            goes_on = last is not None and int(conv[0]) == last
            before = np.zeros(len(starts), np.int64)
            held = np.zeros((len(starts), 4), np.int64)
            if goes_on:
                before[0], held[0] = rank, sums
            at = np.arange(len(conv)) - np.repeat(starts, length) + 1 + np.repeat(before, length)
            run = np.cumsum(_split(f1, f2) * powers(at) % PRIMES, axis=0)
            own = run - np.repeat(np.vstack([np.zeros((1, 4), np.int64), run])[starts], length, axis=0) + np.repeat(held, length, axis=0)
            own %= PRIMES
            prior = np.vstack([held[:1], own[:-1]])
            prior[starts] = held
            last, rank, sums = int(conv[-1]), int(at[-1]), own[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, conv, at, *_pack(own), *_pack(prior), f1, f2, size)], [c.split()[0] for c in SCANNED.split(", ")])

    dealt = rows.repartitionByRange(parts, "conv", *order).sortWithinPartitions("conv", *order)
    return dealt.select(F.spark_partition_id().alias("part"), "conv", "f1", "f2", "bytes").mapInArrow(scan, SCANNED)


def _carried(scanned: DataFrame) -> dict[int, tuple[int, int, np.ndarray]]:
    """By part: its first conversation, and that one's rank and prefix in the parts before, where it goes on; from one row a part."""
    ends = scanned.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "rank", "a", "b")).alias("tail")).orderBy("part").collect()
    out: dict[int, tuple[int, int, np.ndarray]] = {}
    conv, rank, sums = None, 0, np.zeros(4, np.int64)
    for row in ends:
        tail = _unpack(np.array([row.tail.a]), np.array([row.tail.b]))[0]
        if row.first == conv:
            out[row.part] = (conv, rank, sums)
            if row.tail.conv == conv:
                rank, sums = rank + row.tail.rank, (sums + _power(rank) * tail) % PRIMES
                continue
        conv, rank, sums = row.tail.conv, row.tail.rank, tail
    return out


def _completed(scanned: DataFrame) -> DataFrame:
    """scanned with rank and prefixes counted from the start of each conversation."""
    carried = scanned.sparkSession.sparkContext.broadcast({k: (c, r, _power(r), s) for k, (c, r, s) in _carried(scanned).items()})  # an entry a part at most
    names = [c.split()[0] for c in SCANNED.split(", ")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv, rank, *prefix = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            columns = [rank.copy(), *(p.copy() for p in prefix)]
            for p in np.unique(part).tolist():
                if p in carried.value:
                    first, before, power, sums = carried.value[p]
                    here = np.flatnonzero((part == p) & (conv == first))
                    columns[0][here] += before
                    for k in (1, 3):
                        whole = (sums + power * _unpack(columns[k][here], columns[k + 1][here]) % PRIMES) % PRIMES
                        columns[k][here], columns[k + 1][here] = _pack(whole)
            arrays = [batch.column(0), batch.column(1), *map(pa.array, columns), *(batch.column(i) for i in range(7, 10))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return scanned.mapInArrow(add, SCANNED)


def rebuilt_turns(turns: DataFrame, spread: int = SPREAD, heads: Callable[[Column], Column] = head_turns) -> tuple[DataFrame, DataFrame]:
    """(turns (conv, at, f1, f2, bytes) of rebuilt conversations, at: their order; conv of all conversations).

    The first heads(c) turns of conversation c - c % spread, then c's own from the next on."""
    spark = turns.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    read = materialize(turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", *_digest(role, text), F.octet_length(text).cast("long").alias("bytes")), "turns")
    parts = partitions_for(spark, read.count(), ROWS)
    scanned = materialize(_scanned(read, [F.col("turn").asc_nulls_first(), F.col("f1"), F.col("f2")], parts), "ranked")
    ranked = _completed(scanned)
    conv = F.col("conv")
    convs = materialize(read.select("conv").distinct(), "convs")
    own = ranked.where(F.col("rank") > heads(conv)).select("conv", F.col("rank").alias("at"), "f1", "f2", "bytes")
    base = ranked.where((conv % spread == 0) & (F.col("rank") < HEADS)).select(F.col("conv").alias("base"), F.col("rank").alias("at"), "f1", "f2", "bytes")
    taken = convs.select("conv", (conv - conv % spread).alias("base"), heads(conv).alias("heads"))
    first = taken.join(base, "base").where(F.col("at") <= F.col("heads")).select("conv", "at", "f1", "f2", "bytes")
    out = materialize(own.unionByName(first), "rebuilt")
    release(read, scanned)
    return out, convs


def _end_hashes(ends: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 of the conversations (conv) that end at each prefix, by pieces of at most CHUNK ids in order."""
    key = ["depth", "a", "b"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, out = None, [], []
        for batch in batches:
            for *now, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if now != at or len(ids) >= CHUNK:
                    if ids:
                        out.append((*at, ids[0], ",".join(map(str, ids))))
                    at, ids = now, []
                ids.append(conv)
            yield rows_of(out)
            out = []
        yield rows_of([(*at, ids[0], ",".join(map(str, ids)))] if ids else [])

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string()])], [*key, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []
        for batch in batches:
            for *now, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if now != at:
                    if at:
                        out.append((*at, state.hexdigest()))
                    at, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
        if at:
            out.append((*at, state.hexdigest()))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()])], [*key, "ends_sha256"])

    parts = partitions_for(ends.sparkSession, 0, 1)
    dealt = ends.repartitionByRange(parts, *key, "conv").sortWithinPartitions(*key, "conv").select(*key, "conv")
    cut = dealt.mapInArrow(pieces, "depth long, a long, b long, first long, ids string")
    return cut.repartition(parts, *key).sortWithinPartitions(*key, "first").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def trie_nodes(rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, depth, parent (its conv; null for the root), n_convs, n_children, child (the first one's conv), next (the next sibling's conv), bytes, ends_sha256 of each node."""
    spark = rebuilt.sparkSession
    parts = partitions_for(spark, rebuilt.count(), ROWS)
    scanned = materialize(_scanned(rebuilt, [F.col("at")], parts), "prefixes")
    turns = _completed(scanned).withColumnRenamed("rank", "depth")
    named = turns.groupBy("depth", "a", "b").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("bytes").alias("bytes"))
    top = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = top.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv", "n_convs", F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), F.lit(0).cast("long").alias("bytes"))
    last = turns.groupBy("conv").agg(F.max(F.struct("depth", "a", "b")).alias("last"))
    ends = convs.join(last, "conv", "left").select("conv", *[F.coalesce(F.col("last")[c], F.lit(0).cast("long")).alias(c) for c in ("depth", "a", "b")])
    ends = materialize(ends, "ends")
    hashed = _end_hashes(ends)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    nodes = materialize(named.unionByName(root).join(hashed, ["depth", "a", "b"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)), "nodes")
    release(scanned, ends)

    # parents: the root by itself, as it may have most of the children
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent"))
    deep = nodes.where("depth > 1").join(above, ["depth", "pa", "pb"])
    lead = nodes.where("depth = 0").select(F.col("conv").alias("parent"))  # one row
    high = nodes.where("depth = 1").crossJoin(F.broadcast(lead))
    kept = ["conv", "depth", "parent", "n_convs", "bytes", "ends_sha256"]
    placed = deep.select(*kept).unionByName(high.select(*kept)).unionByName(nodes.where("depth = 0").withColumn("parent", F.lit(None).cast("long")).select(*kept))
    placed = materialize(placed, "placed")
    release(nodes)
    order = materialize(_siblings(placed.where("depth > 0").select("parent", "depth", "conv")), "siblings")
    children = placed.where("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.min("conv").alias("child"))
    out = placed.join(order, ["conv", "depth"], "left").join(children, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    out = materialize(out, "tree")
    release(placed, order)
    return out


def _siblings(nodes: DataFrame) -> DataFrame:
    """conv, depth, next: the next conv of the same parent and depth, found in rows in order; the last row of a range looks at the first of the next one."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = None, ["part", "parent", "depth", "conv", "next", "tail"]

        def told(rows: list[np.ndarray], follows: np.ndarray, tail: bool) -> pa.RecordBatch:
            same = follows >= 0
            nxt = pa.array(np.where(same, rows[3][np.maximum(follows, 0)] if len(rows[3]) else 0, 0), pa.int64(), mask=~same)
            n = len(follows)
            return pa.RecordBatch.from_arrays([*(pa.array(r[:n]) for r in rows), nxt, pa.array(np.full(n, tail))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            rows = [np.r_[h, r] for h, r in zip(held, rows)] if held else rows
            same = (rows[1][1:] == rows[1][:-1]) & (rows[2][1:] == rows[2][:-1])
            yield told(rows, np.where(same, np.arange(1, len(same) + 1), -1), False)
            held = [r[-1:] for r in rows]
        if held:
            yield told(held, np.full(1, -1), True)

    dealt = nodes.repartitionByRange(partitions_for(nodes.sparkSession, 0, 1), "parent", "depth", "conv").sortWithinPartitions("parent", "depth", "conv")
    kind = "part int, parent long, depth long, conv long, next long, tail boolean"
    seen = materialize(dealt.select(F.spark_partition_id().alias("part"), "parent", "depth", "conv").mapInArrow(look, kind), "seen")
    firsts = seen.groupBy("part").agg(F.min(F.struct("parent", "depth", "conv")).alias("f")).orderBy("part").collect()  # a row a part
    after = [(x.part, y.f.parent, y.f.depth, y.f.conv) for x, y in zip(firsts, firsts[1:])]
    follow = seen.sparkSession.createDataFrame(after, "part int, _parent long, _depth long, _next long")
    fits = F.col("tail") & (F.col("parent") == F.col("_parent")) & (F.col("depth") == F.col("_depth"))
    return seen.join(F.broadcast(follow), "part", "left").select("conv", "depth", F.when(fits, F.col("_next")).otherwise(F.col("next")).alias("next"))


def tour_arcs(tree: DataFrame) -> DataFrame:
    """The Euler tour as a linked list: an arc (conv, depth, side: 0 enter, 1 exit), the one after it (to_*; null at the end) and what it counts for."""
    arc = lambda conv, depth, side: F.struct(conv.alias("conv"), depth.alias("depth"), F.lit(side).cast("long").alias("side"))
    conv, depth, none = F.col("conv"), F.col("depth"), F.lit(None)
    down = F.when(F.col("n_children") > 0, arc(F.col("child"), depth + 1, 0)).otherwise(arc(conv, depth, 1))
    onward = F.when(F.col("next").isNotNull(), arc(F.col("next"), depth, 0)).when(depth > 0, arc(F.col("parent"), depth - 1, 1)).otherwise(none)
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    zero = F.lit(0).cast("long")
    both = F.array(F.struct(zero.alias("side"), down.alias("to"), leaf.alias("leaves"), saved.alias("saved")), F.struct((zero + 1).alias("side"), onward.alias("to"), zero.alias("leaves"), zero.alias("saved")))
    rows = tree.select("conv", "depth", F.explode(both).alias("x"))
    return rows.select("conv", "depth", "x.side", *[F.col(f"x.to.{c}").alias(f"to_{c}") for c in KEY], (zero + 1).alias("arcs"), "x.leaves", "x.saved")


SUMS = ["arcs", "leaves", "saved"]
#: An arc, the arc that stands for it in the next round, the sums before it there; of those that end a chain, what follows and their own sums.
ROUND = ", ".join(f"{c} long" for c in [*KEY, *(f"in_{c}" for c in KEY), *(f"before_{c}" for c in SUMS), *(f"to_{c}" for c in KEY), *SUMS]) + ", tail boolean"


def _contract(rows: list[np.ndarray], empty: np.ndarray) -> list[np.ndarray]:
    """A round over arcs in order of their key: rows are conv, depth, side, to_conv, to_depth, to_side, arcs, leaves, saved; empty: nothing follows."""
    conv, depth, side, to_conv, to_depth, to_side = rows[:6]
    n = len(conv)
    names = np.unique(conv)
    wide = int(depth.max(initial=0)) + 2
    key = (np.searchsorted(names, conv) * wide + depth) * 2 + side
    place = np.minimum(np.searchsorted(names, to_conv), len(names) - 1)
    here = ~empty & (names[place] == to_conv) & (to_depth < wide)
    to_key = np.where(here, (place * wide + to_depth) * 2 + to_side, -1)
    to = np.minimum(np.searchsorted(key, to_key), n - 1)
    here &= key[to] == to_key
    before = np.zeros((n, 3), np.int64)
    head = np.arange(n)
    own = np.stack(rows[6:9], axis=1)
    head[to[here]] = np.flatnonzero(here)
    before[to[here]] = own[here]
    while True:  # each turn doubles how far back an arc looks
        further = head[head]
        if (further == head).all():
            break
        before += before[head]
        head = further
    return [conv, depth, side, conv[head], depth[head], side[head], *before.T, to_conv, to_depth, to_side, *rows[6:9], ~here]


def _local_round(arcs: DataFrame, parts: int) -> DataFrame:
    names = [c.split()[0] for c in ROUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        empty = table.column("to_conv").is_null().to_numpy()
        rows = [table.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for c in [*KEY, *(f"to_{c}" for c in KEY), *SUMS]]
        out = _contract(rows, empty)
        for at in range(0, len(empty), 50_000):
            part = [pa.array(x[at : at + 50_000], mask=empty[at : at + 50_000] if 9 <= i < 12 else None) for i, x in enumerate(out)]
            yield pa.RecordBatch.from_arrays(part, names)

    dealt = arcs.repartition(1) if parts == 1 else arcs.repartitionByRange(parts, *KEY)
    return dealt.sortWithinPartitions(*KEY).select(*KEY, *[f"to_{c}" for c in KEY], *SUMS).mapInArrow(run, ROUND)


def _lot_round(arcs: DataFrame, turn: int) -> DataFrame:
    """A round that joins arcs drawn by lot to the arc before them, wherever that stands: about a quarter of all."""
    lot = F.pmod(F.xxhash64(*KEY, F.lit(turn)), F.lit(2)) == 1
    a = arcs.withColumn("lot", lot)
    prior = a.where(~F.col("lot") & F.col("to_conv").isNotNull()).select(*[F.col(f"to_{c}").alias(c) for c in KEY], *[F.col(c).alias(f"in_{c}") for c in KEY], *[F.col(c).alias(f"before_{c}") for c in SUMS])
    gone = a.where("lot").join(prior, KEY)
    zero = F.lit(0).cast("long")
    names = [c.split()[0] for c in ROUND.split(", ")]
    joined = gone.withColumn("tail", F.lit(False)).select(*names)
    skipped = gone.select(*[F.col(c).alias(f"to_{c}") for c in KEY], *[F.col(f"to_{c}").alias(f"over_{c}") for c in KEY], *[F.col(c).alias(f"more_{c}") for c in SUMS], F.lit(True).alias("met"))
    stays = a.join(gone.select(*KEY), KEY, "left_anti").join(skipped, [f"to_{c}" for c in KEY], "left")
    stays = stays.select(
        *KEY, *[F.col(c).alias(f"in_{c}") for c in KEY], *[zero.alias(f"before_{c}") for c in SUMS],
        *[F.when(F.col("met"), F.col(f"over_{c}")).otherwise(F.col(f"to_{c}")).alias(f"to_{c}") for c in KEY],
        *[(F.col(c) + F.coalesce(f"more_{c}", zero)).alias(c) for c in SUMS], F.lit(True).alias("tail"),
    )
    return joined.unionByName(stays)


def rank_list(arcs: DataFrame, rows: int = ROWS, final: int = FINAL) -> DataFrame:
    """conv, depth, side and, by a linked list of arcs, the sums of arcs, leaves and saved before each."""
    spark = arcs.sparkSession
    left, stored = materialize(arcs, "arcs"), None
    rounds: list[DataFrame] = []
    count, shrunk, turn = left.count(), True, 0
    while count:
        last = count <= final
        if last or shrunk:
            done = _local_round(left, 1 if last else partitions_for(spark, count, rows))
        else:
            done = _lot_round(left, turn)
        done = materialize(done, "round")
        rounds.append(done)
        release(left)
        if last:
            break
        merged = done.where("tail").select(*[F.col(f"in_{c}").alias(c) for c in KEY], *[f"to_{c}" for c in KEY], *[(F.col(f"before_{c}") + F.col(c)).alias(c) for c in SUMS])
        left = materialize(merged, "arcs")
        before, count, turn = count, left.count(), turn + 1
        shrunk = not shrunk or count <= before // 2
    if not rounds:
        return left.select(*KEY, *[F.col(c).alias(f"before_{c}") for c in SUMS])
    found = rounds.pop().select(*KEY, *[f"before_{c}" for c in SUMS])
    while rounds:
        own = rounds.pop()
        above = found.select(*[F.col(c).alias(f"in_{c}") for c in KEY], *[F.col(f"before_{c}").alias(f"from_{c}") for c in SUMS])
        found = own.join(above, [f"in_{c}" for c in KEY]).select(*KEY, *[(F.col(f"before_{c}") + F.col(f"from_{c}")).alias(f"before_{c}") for c in SUMS])
    return found


def conversation_trie(turns: DataFrame, spread: int = SPREAD, heads: Callable[[Column], Column] = head_turns, rows: int = ROWS, final: int = FINAL) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; enters_at and exits_at are its places on the tour."""
    rebuilt, convs = rebuilt_turns(turns, spread, heads)
    tree = trie_nodes(rebuilt, convs)
    release(rebuilt, convs)
    placed = rank_list(tour_arcs(tree), rows, final)
    of = lambda side, c: F.sum(F.when(F.col("side") == side, F.col(f"before_{c}")))
    inside = placed.groupBy("conv", "depth").agg(
        of(0, "arcs").alias("enters_at"), of(1, "arcs").alias("exits_at"), (of(1, "leaves") - of(0, "leaves")).alias("n_leaves"), (of(1, "saved") - of(0, "saved")).alias("saved_tokens")
    )
    out = tree.join(inside, ["conv", "depth"])
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "enters_at", "exits_at")


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read_table(spark, sf_dir, "conversations")).drop("enters_at", "exits_at")


def trie_sql(spread: int = SPREAD, heads: int = HEADS) -> str:
    """Prefixes as chained digests; each node hands its savings, and each leaf itself, to all prefixes of its smallest member. CRC-32 is folded bit by bit."""
    step = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
    table = "list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: " + step.format(x="a") + "))"
    return f"""
WITH crc_table AS (SELECT {table} AS tab),
turns AS (
  SELECT conv_id AS c, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS f, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT c, list({{'f': f, 'bytes': bytes}} ORDER BY turn NULLS FIRST, f) AS own, CAST(c AS VARCHAR) AS t FROM turns GROUP BY c),
drawn AS (
  SELECT c, own, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(strlen(t)), lambda i: ('0x' || substr(hex(encode(t)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
    lambda a, b: xor(a >> 8, tab[(xor(a & 255, b) + 1)::BIGINT])), 4294967295::BIGINT) % {heads} AS h
  FROM whole, crc_table),
rebuilt AS (
  SELECT d.c, list_concat(coalesce(b.own, [])[1:d.h], d.own[d.h + 1:]) AS all_turns
  FROM drawn d LEFT JOIN drawn b ON b.c = d.c - d.c % {spread}),
steps AS (
  SELECT c, d AS depth, len(all_turns) AS n, md5(array_to_string(list_transform(all_turns[1:d], lambda x: x.f), ',')) AS k,
         md5(array_to_string(list_transform(all_turns[1:d - 1], lambda x: x.f), ',')) AS pk, CASE WHEN d = 0 THEN 0 ELSE all_turns[d].bytes END AS bytes
  FROM (SELECT c, all_turns, unnest(range(len(all_turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT depth, k, any_value(pk) AS pk, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '')) AS ends
  FROM steps GROUP BY depth, k),
linked AS (
  SELECT v.*, p.c AS parent, (SELECT count(*) FROM nodes u WHERE u.depth = v.depth + 1 AND u.pk = v.k) AS n_children
  FROM nodes v LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.k = v.pk),
handed AS (
  SELECT s.depth, s.k, count(*) FILTER (v.n_children = 0) AS n_leaves, sum(v.saved) AS saved
  FROM linked v JOIN steps s ON s.c = v.c AND s.depth <= v.depth GROUP BY s.depth, s.k)
SELECT c AS conv_id, CAST(v.depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, CAST(h.n_leaves AS BIGINT) AS n_leaves,
       CAST(h.saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM linked v JOIN handed h ON v.depth = h.depth AND v.k = h.k"""
