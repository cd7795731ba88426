"""Best-two-fit packing of token sequences into bins of fixed capacity.

Packing depends on lengths alone, and there are no more different lengths than the capacity, so bins are planned on
the histogram of lengths: `plan_bins` fills a bin greedily with the longest documents that fit, then takes out
its smallest one and looks for two unpacked documents that fill the widened gap more tightly, and repeats the
finished pattern as often as the counts allow. Each pattern exhausts a length, so the plan's size is bounded by the
capacity, whatever the corpus. Documents then take their places by their rank among those of equal length;
ranks are counted in buckets, so that a length held by a third of all pieces is still spread over many tasks.

Defined results: null text is empty and is one piece holding the separator alone; only sequences longer than the
capacity are cut; repeated and tied rows take different places, which of them is arbitrary; null ids are kept; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import kept_in_worker, materialize, partitions_for, read_table, sparing

CAPACITY = 2048
WORD_TABLE = 700_000
#: Characters that str.split() takes for white space and the tokenizer's pattern does not.
_odd_space = re.compile("[\x1c-\x1f]").search


def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Token ids, as little-endian unsigned 32-bit bytes, of texts whose tokenizer drops white space: each word is
    encoded by the library once and kept in a table of bounded size."""

    def __init__(self, path: str, table: int = WORD_TABLE):
        self.lib, self.table = _tokenizer(path), table
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _split(self, text: str) -> list[str] | None:
        """Words in the tokenizer's normal form; None if only the library can tell."""
        if _odd_space(text) or any(s in text for s in self.special):
            return None
        if text.isascii():
            return text.lower().split()
        # lower() looks at the place of a capital sigma, the tokenizer does not
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().split()

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text; new words of about a million characters at a time go to the library at once."""
        waiting: list[tuple[str, list[str] | None]] = []
        size = 0
        for text in texts:
            waiting.append((text or "", self._split(text or "")))
            size += len(text or "")
            if size > 1_000_000:
                yield from self._settle(waiting)
                waiting, size = [], 0
        yield from self._settle(waiting)

    def _settle(self, waiting: list[tuple[str, list[str] | None]]) -> list[bytes]:
        known = self.words
        if len(known) > self.table:
            known.clear()
        new = list(set().union(*(own for _, own in waiting if own)).difference(known))
        known.update(zip(new, self._library(new)))
        return [self._library([text])[0] if own is None else b"".join([known[w] for w in own]) for text, own in waiting]

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


def word_encoder(path: str) -> WordEncoder:
    """A worker's encoder, kept from one task to the next."""
    return kept_in_worker("packing", path, lambda: WordEncoder(path))


def token_pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's tokens and the separator, cut at the capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = word_encoder(tokenizer), np.array([separator], dtype="<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for r, own in enumerate(encoder.encode_all(batch.column(1).to_pylist())):
                ids = own + tail
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    row.append(r)
                    piece.append(at // (4 * capacity))
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(np.frombuffer(part, dtype="<u4").astype("int32"))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sparing("packing", cut), f"doc_id {dict(df.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths in a bin, number of such bins), covering the histogram exactly."""
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    plan: list[tuple[list[int], int]] = []

    def drop_used(n: int) -> None:
        if left[n] == 0:
            del lengths[bisect_right(lengths, n) - 1]
            del left[n]

    while lengths:
        bin_, gap, used = [], capacity, {}
        at = len(lengths) - 1
        while at >= 0:
            n = lengths[at]
            while n <= gap and used.get(n, 0) < left[n]:
                bin_.append(n)
                used[n] = used.get(n, 0) + 1
                gap -= n
            at = min(at - 1, bisect_right(lengths, gap) - 1)
        if gap and len(bin_) > 1:
            small = bin_[-1]
            pair = _best_two(lengths, left, used, small, gap + small)
            if pair:
                bin_.pop()
                used[small] -= 1
                for n in pair:
                    bin_.append(n)
                    used[n] = used.get(n, 0) + 1
        times = min(left[n] // u for n, u in used.items() if u)
        plan.append((bin_, times))
        for n, u in used.items():
            left[n] -= u * times
            drop_used(n)
    return plan


def _best_two(lengths: list[int], left: dict[int, int], used: dict[int, int], small: int, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths of the largest sum over `small` and within `room`; None if there are none."""
    best, pair = small, None
    i, j = 0, bisect_right(lengths, room) - 1
    while i <= j:
        a, b = lengths[i], lengths[j]
        if a + b > room:
            j -= 1
            continue
        free_a, free_b = left[a] - used.get(a, 0), left[b] - used.get(b, 0)
        if free_b < 1:
            j -= 1
        elif free_a < 1 or i == j and free_a < 2:
            i += 1
        else:
            if a + b > best:
                best, pair = a + b, (b, a)
                if best == room:
                    break
            i += 1
    return pair


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    buckets = partitions_for(spark, 0, 1)
    keyed = pieces.withColumn("_bucket", F.pmod(F.hash("doc_id", "piece"), F.lit(buckets)))
    counts = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for lengths, times in plan_bins(histogram, capacity):
        offset = 0
        for n in lengths:
            rank = taken.get(n, 0)
            slots.setdefault(n, []).append((rank, base, offset, times))
            taken[n] = rank + times
            offset += n
        base += times
    table = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*x)) for n, x in slots.items()}
    shared = spark.sparkContext.broadcast(table)  # bounded by the capacity: see the module's text
    kinds = dict(pieces.dtypes)
    columns = pieces.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(rows):
                    first, start, place, _ = slots[int(length[rows[0]])]
                    k = np.searchsorted(first, rank[rows], side="right") - 1
                    sequence[rows], offset[rows] = start[k] + rank[rows] - first[k], place[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_start") + F.col("_rank"))
    return ranked.select(*columns, "_rank").mapInArrow(sparing("packing", assign), ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset."""
    pieces = token_pieces(df, tokenizer, capacity, separator, id_col, text_col, with_ids)
    return place_pieces(materialize(pieces, "pieces"), capacity)


def op4_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
