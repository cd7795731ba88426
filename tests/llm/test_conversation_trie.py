"""The trie of conversations against brute force; list ranking of tours without locality; odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialgrid.llm import conversation_trie as T


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows, spread=5, heads=9):
    """Nodes of rows (conv_id, turn, role, text), by dictionaries of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or "")[:30], role or "", text or ""))
    for c in own:
        own[c].sort()
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % spread) * (1 if c >= 0 else -1)
        full[c] = [t[3:] for t in own.get(base, [])[:h]] + [t[3:] for t in own[c][h:]]
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    below = defaultdict(list)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in below[p]) if below[p] else 1
        saved[p] = ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0) + sum(saved[q] for q in below[p])
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in cs if len(full[c]) == len(p))
        out.append((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), len(below[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


KIND = "conv_id long, turn long, role string, text string"


def shown(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def many():
    r = random.Random(5)
    rows = []
    for c in range(-7, 60):
        for turn in range(r.choice([0, 1, 2, 3, 5, 8, 12])):
            rows.append((c, turn, r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "é" * 40, "x", f"only {c}"])))
    rows += [(300 + i, t, "user", f"the same {t}") for i in range(40) for t in range(4)]  # copies
    rows += [(1000, t, "user", str(t % 3)) for t in range(700)]  # one long conversation
    rows += [(55, 1, "user", "again")] * 3 + [(55, None, "a", "b"), (55, None, "a", "a"), (None, 1, "user", "lost"), (None, None, None, None)]
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark, many):
    df = spark.createDataFrame(many, KIND).withColumns({"depth": F.lit(1), "a": F.lit("x"), "conv": F.lit(2), "side": F.lit(0)}).repartition(7)
    got = T.conversation_trie(df, final=300).cache()  # several rounds
    assert shown(got) == brute(many)
    # positions on the tour enclose subtrees: the root all, every node twice as many places as its subtree has nodes
    rows = got.collect()
    assert sorted(x for r in rows for x in (r["enters_at"], r["exits_at"])) == list(range(2 * len(rows)))
    inside = lambda r: sum(r["enters_at"] <= x["enters_at"] <= r["exits_at"] for x in rows)
    for r in rows[:40]:
        assert inside(r) == (r["exits_at"] - r["enters_at"] + 1) // 2


def test_ids_that_end_at_a_node_are_hashed_in_pieces(spark, many, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 3)
    ends = spark.createDataFrame([(c, 1, 2, 3 + (c % 97 == 0)) for c in range(200)], "conv long, depth long, a long, b long")
    got = {r["b"]: r["ends_sha256"] for r in T._end_hashes(ends).collect()}
    for b in (3, 4):
        assert got[b] == hashlib.sha256(",".join(str(c) for c in range(200) if 3 + (c % 97 == 0) == b).encode()).hexdigest()


def test_lists_without_locality_are_ranked(spark):
    """A random order of arcs: hardly any follower stands near, so rounds by lot are needed."""
    r = random.Random(9)
    keys = [(c, d, s) for c in range(60) for d in range(5) for s in (0, 1)]
    r.shuffle(keys)
    weights = [(r.randint(0, 3), r.randint(0, 1000)) for _ in keys]
    rows = [(*k, *(keys[i + 1] if i + 1 < len(keys) else (None,) * 3), 1, *w) for i, (k, w) in enumerate(zip(keys, weights))]
    kind = ", ".join(f"{c} long" for c in ["conv", "depth", "side", "to_conv", "to_depth", "to_side", "arcs", "leaves", "saved"])
    before = np.r_[[[0, 0]], np.cumsum(weights, axis=0)[:-1]].tolist()
    want = sorted((*k, i, *b) for i, (k, b) in enumerate(zip(keys, before)))
    r.shuffle(rows)
    for final in (40, 10_000):
        got = T.rank_list(spark.createDataFrame(rows, kind), final=final)
        assert sorted(map(tuple, got.select("conv", "depth", "side", "before_arcs", "before_leaves", "before_saved").collect())) == want


def test_odd_tables(spark):
    assert T.conversation_trie(spark.createDataFrame([], KIND)).count() == 0
    assert T.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], KIND)).count() == 0
    for rows in ([(3, 1, None, None)], [(0, 0, "user", "hi")], [(-4, 0, "user", "a"), (-4, 1, "user", "b"), (0, 0, "user", "c")], [(2, 0, "u", "x")] * 20):
        assert shown(T.conversation_trie(spark.createDataFrame(rows, KIND))) == brute(rows)
