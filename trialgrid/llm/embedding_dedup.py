"""Near-duplicate vectors by counting collisions in one-dimensional projections.

Vectors of a label are dealt into cells of a few coarse projections, in several tables. Within a cell the vectors'
values in many one-dimensional projections are compared: a pair collides in a projection when one value lies in the
window centred on the other. Pairs that collide at least as often as a pair at the threshold does with the wanted
probability (a binomial quantile) are verified by their cosine in double precision. A pair that shares cells in
several tables is counted in the first of them alone.

The number of coarse projections of a table follows from the size of the largest label (cells hold about CELL vectors)
and the number of tables from the wanted recall, so the work for a vector grows with a small power of the label's
size. Equal vectors are one class with a multiplicity. Cells beyond CHUNK classes are split, and parts meet pair by
pair, so no task holds more than two parts, and tasks give sums and a spanning forest, not pairs.

Defined results: null label, null, zero, empty or non-finite vectors link with nothing; vectors of different lengths do not
link; rows with equal ids keep their own counts; the smallest id of a class stands for it; further columns are
ignored; an empty table gives an empty result. Recall at the threshold is RECALL or more by calculation, higher
above it; no pair below the threshold is linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize, partitions_for, read_table
from .graph import connected_components

THRESHOLD, RECALL = 0.93, 0.997
PROJECTIONS, CELL, CHUNK = 48, 400, 1024


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _same_cell(distance: float, width: float) -> float:
    """Probability that two vectors at a distance share a cell of a randomly shifted grid on a Gaussian projection."""
    a = width / distance
    return 1 - 2 * _phi(-a) - 2 / (math.sqrt(2 * math.pi) * a) * (1 - math.exp(-a * a / 2))


def _least_count(n: int, p: float, miss: float) -> int:
    """Largest count that a binomial falls short of with probability `miss` at most."""
    total, k = 0.0, 0
    while k < n:
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total > miss:
            break
        k += 1
    return k


class Plan:
    """Widths and counts for a threshold, a recall and a number of vectors."""

    def __init__(self, largest: int, threshold: float = THRESHOLD, recall: float = RECALL):
        self.radius = math.sqrt(2 - 2 * threshold)
        self.width = 4 * self.radius
        near, far = _same_cell(self.radius, self.width), _same_cell(math.sqrt(2), self.width)
        self.coarse = max(1, round(math.log(max(largest, 1) / CELL) / -math.log(far)))
        self.tables = max(1, math.ceil(math.log((1 - recall) / 2) / math.log(1 - near**self.coarse)))
        self.window = 1.3 * self.radius
        self.least = _least_count(PROJECTIONS, 2 * _phi(1.3) - 1, (1 - recall) / 2)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """A number for the cell of each vector in each table."""
        random = np.random.default_rng(11)
        lines = random.standard_normal((unit.shape[1], self.tables * self.coarse))
        shift = random.random(self.tables * self.coarse) * self.width
        grid = np.floor((unit @ lines + shift) / self.width).astype(np.int64).reshape(len(unit), self.tables, self.coarse)
        out = np.zeros(grid.shape[:2], np.int64)
        for k in range(self.coarse):
            out = out * 4096 + grid[:, :, k] + 2048 if k < 5 else (out * 1_000_003 + grid[:, :, k]) & (2**62 - 1)
        return out

    def projected(self, unit: np.ndarray) -> np.ndarray:
        return unit @ np.random.default_rng(12).standard_normal((unit.shape[1], PROJECTIONS))


def _unit(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _linked(plan: Plan, table: int, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each of x and each of y link and meet here first."""
    px, py = plan.projected(x), plan.projected(y)
    count = np.zeros((len(x), len(y)), np.uint8)
    for k in range(PROJECTIONS):
        count += np.abs(px[:, k][:, None] - py[:, k][None, :]) <= plan.window
    hit = count >= plan.least
    if hit.any():
        hit &= x @ y.T >= threshold
        cx, cy = plan.cells(x), plan.cells(y)
        for t in range(table):
            hit &= cx[:, t][:, None] != cy[:, t][None, :]
    return hit


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return label
        label = new


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    # adding zero makes one of the two zeros
    classes = usable.groupBy("label", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).agg(F.min("vec_id").alias("cls"), F.count("*").alias("times"))
    classes = materialize(classes, "classes")
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    plan = Plan(largest, threshold, recall)
    kind, label_kind = dict(rows.dtypes)["vec_id"], dict(rows.dtypes)["label"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(batch.column("v").offsets.to_numpy())
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                cells = plan.cells(_unit(_matrix(part.column("v"), int(dim))))
                for t in range(plan.tables):
                    n = len(cells)
                    yield pa.RecordBatch.from_arrays([part.column("cls"), part.column("label"), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(cells[:, t])], ["cls", "label", "dim", "tab", "cell"])

    key = ["label", "dim", "tab", "cell"]
    dealt = classes.select("cls", "label", "v").mapInArrow(deal, f"cls {kind}, label {label_kind}, dim int, tab int, cell long")
    sizes = dealt.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("cls"), parts).cast("int")
    cut = dealt.join(sizes, key).select("cls", *key, own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    cut = cut.select("cls", *key, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    full = cut.join(classes.select("cls", "v", "times"), "cls")

    def meet(group: pa.Table) -> pa.Table:
        dim, table = group.column("dim")[0].as_py(), group.column("tab")[0].as_py()
        group = group.sort_by("cls")
        ids, times, part = group.column("cls"), group.column("times").to_numpy(), group.column("own").to_numpy()
        x = _unit(_matrix(group.column("v"), dim))
        one = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
        left = np.arange(len(x)) if one else np.flatnonzero(part == part.min())
        right = left if one else np.flatnonzero(part != part.min())
        links, pairs_a, pairs_b = np.zeros(len(x), np.int64), [], []
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            hit = _linked(plan, table, x[rows], x[right], threshold)
            if one:
                hit &= rows[:, None] < right[None, :]
            a, b = np.nonzero(hit)
            pairs_a.append(rows[a])
            pairs_b.append(right[b])
            np.add.at(links, rows[a], times[right[b]])
            np.add.at(links, right[b], times[rows[a]])
        root = _roots(len(x), np.concatenate(pairs_a or [left[:0]]), np.concatenate(pairs_b or [left[:0]]))
        keep = np.flatnonzero(links)
        return pa.table({"cls": ids.take(pa.array(keep)), "links": pa.array(links[keep]), "root": ids.take(pa.array(root[keep]))})

    met = full.repartition(partitions_for(df.sparkSession, 0, 1), *key, "lo", "hi").groupBy(*key, "lo", "hi").applyInArrow(meet, f"cls {kind}, links long, root {kind}")
    met = materialize(met, "met")
    links = met.groupBy("cls").agg(F.sum("links").alias("links"))
    labels = connected_components(met, "cls", "root").select(F.col("node").alias("cls"), F.col("component"))
    known = classes.join(links, "cls", "left").join(labels, "cls", "left").select("label", "v", "times", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("component"))
    here = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    found = here.join(known, ["label", "v"], "left")
    component = F.coalesce("component", "vec_id")
    return found.select("vec_id", F.coalesce(F.col("links") + F.col("times") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op3_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
