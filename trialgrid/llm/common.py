"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Bits of the table that tells rows with a key from others, at most.
KEY_BITS = 1 << 25
#: Bytes of the pieces that a batch is cut into, on average; a piece has one row at least.
PIECE_BYTES = 1 << 22

_kept: dict[str, tuple[Any, Any]] = {}  # a worker's


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine (tests)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "/tmp/checkpoints/trialgrid"
        sc.setCheckpointDir(path)
    return path


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """The shuffles of a table that is written are of no further use: with this setting Spark removes their files at once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    with _tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def materialize_parts(df: DataFrame, name: str, kind: str, parts: list[int]) -> list[DataFrame]:
    """Write df in one pass and read it back as a table for each value of `kind`, so that each can be released by itself."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    with _tidy(spark):
        df.write.option("compression", "zstd").partitionBy(kind).parquet(path)
    fields = StructType([f for f in df.schema.fields if f.name != kind])
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for part in parts:
        at = f"{path}/{kind}={part}"
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(at))  # no row has this kind
        out.append(spark.read.schema(fields).parquet(at))
        out[-1].stored_at = at
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables from materialize, once nothing that is still to run reads them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_and_without(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key, a 64-bit hash, may be among keys (k); rows whose key is not), by a table of about 8 bits a key, KEY_BITS at most.

    Every task gets that table, so a join with the keys has to shuffle the first ones only. Past KEY_BITS more rows are taken for possible ones, none is missed."""
    size = min(KEY_BITS, 1 << max(6, (8 * keys.count()).bit_length()))
    place, bit = F.expr("__at DIV 64").alias("__word"), F.expr("shiftleft(1L, CAST(__at % 64 AS INT))")
    held = keys.select(F.pmod("k", F.lit(size).cast("long")).alias("__at")).groupBy(place).agg(F.bit_or(bit).alias("__bits"))
    marked = rows.withColumn("__at", F.pmod(key, F.lit(size).cast("long"))).withColumn("__word", place).join(F.broadcast(held), "__word", "left")
    marked = marked.withColumn("__may", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False)))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return marked.where("__may").select(columns), marked.where("NOT __may").select(columns)


def partitions_for(spark: SparkSession, size: float, each: float) -> int:
    """Partitions so that each holds about `each` of `size`, and no fewer than the session's shuffle setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // each) + 1)



def give_back() -> None:
    """Return freed memory to the system where the libraries can: a worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def kept_in_worker(operator: str, key: Any, make: Callable[[], Any]) -> Any:
    """What an operator keeps in a worker from one task to the next, made by make(); there is one such thing in a worker, that of the last operator and key."""
    if operator not in _kept or _kept[operator][0] != key:
        _kept.clear()
        _kept[operator] = key, make()
    return _kept[operator][1]


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, in batches of about PIECE_BYTES on average, or of one row."""
    for batch in batches:
        rows = max(1, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes))
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def sparing(operator: str, work: Callable) -> Callable:
    """work, for mapInArrow, so that a worker holds no more than its task needs: what other operators have kept in it goes first,
    texts and results are taken in pieces, and memory that is free at the end goes back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _kept and operator not in _kept:
            _kept.clear()
            give_back()
        yield from work(pieces_of(batches))
        give_back()

    return run


def sum_rows(rows: DataFrame, key: str, parts: int) -> list[list[int]]:
    """Sums by key of lists of whole numbers (key int, cells: the list as text, so of numbers of any size), added in tasks by key; a row a key for the driver, in order."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.array([int(c) for c in cells.split(",")], object)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([",".join(map(str, v)) for v in sums.values()], pa.string())], [key, "cells"])

    found = {r[key]: [int(c) for c in r["cells"].split(",")] for r in rows.repartition(parts, key).mapInArrow(add, f"{key} int, cells string").collect()}
    return [found[k] for k in sorted(found)]
