"""Removal of repeated byte strings by suffix arrays, sharded.

Any two equal strings of `length` bytes hold the same smallest hash of their `GRAM`-byte grams at the same place, so
that gram anchors both. A document's possible starts are split into stretches of one anchor each; a stretch's context
is its starts and the `length` bytes of the last. Contexts whose anchor occurs once in the corpus hold nothing that
repeats. The others, each different one once and with its number of occurrences, are dealt out by anchor to shards
of bounded size. In each shard the contexts are one text, whose suffix array is built by induced sorting: suffixes
are classified, the leftmost-smaller ones sorted by their substrings (and, where those repeat, by the sorted order
of the shortened text), and all others follow from them in two sweeps over the buckets. Permuted common prefixes
then tell which neighbours share `length` bytes; a start is repeated when its class counts two occurrences or more.

Each possible start of each document is in one context only, so a class's count is the number of places in the corpus
where the string starts. Every covered byte is removed. Matches never cross documents.

Defined results: null text is empty; documents shorter than `length` are kept; repeated rows (equal ids and texts)
are repeats of each other and are removed like all others; further columns are ignored; an empty table gives an empty
result. Rows of one id with different texts are told apart by their text's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize, partitions_for, read_table

LENGTH, GRAM = 200, 40
SHARD_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPAN = 1 << 16


def _powers() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        one = np.ones(1, np.uint64)
        up = np.cumprod(np.concatenate((one, np.full(_SPAN - 1, _BASE, np.uint64))))
        down = np.cumprod(np.concatenate((one, np.full(_SPAN - 1, pow(_BASE, -1, 1 << 64), np.uint64))))
    return up, down


class Anchors:
    """Stretches of starts and their anchors, of one document after another."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, min(gram, length)
        self.up, self.down = _powers()
        self.sums: np.ndarray | None = None  # of the last text, if it is one span

    def _hashes(self, text: np.ndarray) -> np.ndarray:
        """Mixed polynomial hashes of all grams; long texts in overlapping spans, as powers are kept for one span."""
        out, step = [], _SPAN - self.gram
        for at in range(0, len(text) - self.gram + 1, step):
            part = text[at : at + step + self.gram - 1].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(part) + 1, np.uint64)
            part *= self.up[: len(part)]
            np.cumsum(part, out=sums[1:])
            self.sums = sums if len(part) == len(text) else None
            out.append((sums[self.gram :] - sums[: -self.gram]) * self.down[: len(part) - self.gram + 1])
        h = np.concatenate(out) if len(out) > 1 else out[0]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h

    def content(self, text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of the byte runs that start at `at`; none is longer than a span."""
        if self.sums is not None and len(self.sums) == len(text) + 1:  # stretches() has just summed it
            out = (self.sums[at + size] - self.sums[at]) * self.down[at] + size.astype(np.uint64)
            return self._mixed(out)
        out = np.empty(len(at), np.uint64)
        half = _SPAN // 2
        for lo in range(0, len(text), half):
            own = slice(*np.searchsorted(at, (lo, lo + half)))
            if own.start < own.stop:
                part = text[lo : lo + _SPAN].astype(np.uint64) + np.uint64(1)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * self.up[: len(part)])))
                a = at[own] - lo
                out[own] = (sums[a + size[own]] - sums[a]) * self.down[a] + size[own].astype(np.uint64)
        return self._mixed(out)

    @staticmethod
    def _mixed(out: np.ndarray) -> np.ndarray:
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))

    def stretches(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First start and number of starts of each stretch, and its anchor's hash."""
        starts = len(text) - self.length + 1
        h = self._hashes(text)
        window = self.length - self.gram + 1
        # smallest hash of each window: minima from the left and from the right within blocks of one window
        padded = np.full(-(-len(h) // window) * window, np.uint64(2**64 - 1))
        padded[: len(h)] = h
        blocks = padded.reshape(-1, window)
        left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(right[:starts], left[window - 1 : window - 1 + starts])
        # the leftmost place of that hash: the next place of the value that is not before the start
        change = np.concatenate(([True], least[1:] != least[:-1]))
        first = np.flatnonzero(change)
        count = np.diff(np.append(first, starts))
        # within a run of one minimum value, places of that value split the run where the leftmost one falls out
        hit = np.flatnonzero(h[:starts] == least)
        cut = np.unique(np.concatenate((first, hit + 1)))
        cut = cut[cut < starts]
        return cut, np.diff(np.append(cut, starts)), least[cut]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of a text over small integers (0 to 255) by induced sorting, in vector steps."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    t = text.astype(np.int32)
    smaller = _smaller(t)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    order = _induce(t, smaller, leftmost)
    if len(leftmost) > 1:
        is_leftmost = np.zeros(n, bool)
        is_leftmost[leftmost] = True
        by_substring = order[is_leftmost[order]]
        names = _names(t, leftmost, by_substring)
        if int(names.max()) + 1 < len(leftmost):
            leftmost = leftmost[_by_doubling(names)]
        else:
            leftmost = by_substring
        order = _induce(t, smaller, leftmost)
    return order


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the next one; equal bytes take after what follows them."""
    n = len(t)
    sign = np.zeros(n, np.int8)
    sign[:-1] = np.sign(t[1:] - t[:-1])
    sign[-1] = -1
    known = np.where(sign != 0, np.arange(n), n)
    return sign[np.minimum.accumulate(known[::-1])[::-1]] > 0


def _induce(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in the order that follows from seeds, the leftmost-smaller suffixes in their order."""
    n = len(t)
    sizes = np.bincount(t, minlength=257)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    out = np.full(n, -1, np.int32)
    seed_sizes = np.bincount(t[seeds], minlength=257)
    seed_bounds = np.concatenate(([0], np.cumsum(seed_sizes)))
    seeds = seeds[np.argsort(t[seeds], kind="stable")]
    head = bounds[:-1].copy()

    def put(places: np.ndarray, at: np.ndarray, forward: bool) -> None:
        """Append places, in this order, to their bytes' buckets: at the heads, or backwards from the tails."""
        if not len(places):
            return
        c = t[places].astype(np.uint8)
        sort = np.argsort(c, kind="stable")
        c, counts = c[sort], np.bincount(c, minlength=257)
        rank = np.arange(len(c)) - np.repeat(np.cumsum(counts) - counts, counts)
        out[at[c] + rank if forward else at[c] - 1 - rank] = places[sort]
        at += counts if forward else -counts

    # larger suffixes, from the smallest bucket up; the last suffix comes first of all
    put(np.array([n - 1], np.int32), head, True)
    for c in np.flatnonzero(sizes):
        at = int(bounds[c])
        while at < head[c]:
            part = out[at : int(head[c])]
            at = int(head[c])
            before = part[part > 0] - 1
            put(before[~smaller[before]], head, True)
        part = seeds[seed_bounds[c] : seed_bounds[c + 1]]
        before = part[part > 0] - 1
        put(before[~smaller[before]], head, True)
    # smaller suffixes, from the largest bucket down
    tail = bounds[1:].copy()
    for c in np.flatnonzero(sizes)[::-1]:
        at = int(bounds[c + 1])
        while at > tail[c]:
            part = out[int(tail[c]) : at][::-1]
            at = int(tail[c])
            before = part[part > 0] - 1
            put(before[smaller[before]], tail, False)
        part = out[int(bounds[c]) : int(head[c])][::-1]
        before = part[part > 0] - 1
        put(before[smaller[before]], tail, False)
    return out


def _names(t: np.ndarray, leftmost: np.ndarray, by_substring: np.ndarray) -> np.ndarray:
    """Rank of each leftmost-smaller substring in text order, equal ones alike."""
    n = len(t)
    stop = np.zeros(n, np.int32)
    stop[leftmost] = np.append(leftmost[1:], n - 1)
    a, b = by_substring[:-1], by_substring[1:]
    length = stop[a] - a
    differ = length != stop[b] - b
    ends = (stop[a] == n - 1) | (stop[b] == n - 1)  # the last substring runs into the end of the text: equal to none
    differ |= ends
    open_ = np.flatnonzero(~differ)
    k = 0
    while len(open_):
        open_ = open_[k <= length[open_]]
        unlike = t[a[open_] + k] != t[b[open_] + k]
        differ[open_[unlike]] = True
        open_ = open_[~unlike]
        k += 1
    rank = np.zeros(n, np.int32)
    rank[by_substring] = np.concatenate(([0], np.cumsum(differ)))
    return rank[leftmost]


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix order of the shortened text; only suffixes that are still tied are sorted again."""
    m = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(m, np.int64)
    ranked = names[order]
    # the rank of a class is the place of its first member
    rank[order] = np.maximum.accumulate(np.where(np.concatenate(([True], ranked[1:] != ranked[:-1])), np.arange(m), 0))
    step = 1
    while True:
        ordered = rank[order]
        tied = np.zeros(m, bool)
        same = ordered[1:] == ordered[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        who = order[at]
        after = who + step
        second = np.where(after < m, rank[np.minimum(after, m - 1)] + 1, 0)
        key = ordered[at] * (m + 1) + second
        sort = np.argsort(key, kind="stable")
        who, key = who[sort], key[sort]
        order[at] = who
        rank[who] = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), at, 0))
        step *= 2


def shared_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix, in text order, with the one before it in the suffix array.

    Where the bytes before both are equal the value is that of the place before, less one; only the other places are
    compared, eight bytes a step.
    """
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (before[:-1] >= 0) & (before[:-1] == before[1:] - 1) & (text[:-1] == text[np.maximum(before[1:], 1) - 1])
    todo = np.flatnonzero((before >= 0) & ~follows)
    padded = np.concatenate((text, np.zeros(17, np.uint8))).astype(np.uint64)
    words = padded[: n + 9].copy()  # eight bytes from each place, the first one lowest
    for k in range(1, 8):
        words |= padded[k : k + n + 9] << np.uint64(8 * k)
    common = np.zeros(n, np.int32)
    x, y = todo.astype(np.int64), before[todo].astype(np.int64)
    one = np.uint64(1)
    while len(todo):
        limit = n - np.maximum(x, y)
        differ = words[np.minimum(x, n)] ^ words[np.minimum(y, n)]
        run = np.bitwise_count((differ & (~differ + one)) - one).astype(np.int64) >> 3  # zero bytes below the lowest difference; 8 if none
        run = np.minimum(run, np.maximum(limit, 0))
        common[todo] += run
        on = run == 8
        todo, x, y = todo[on], x[on] + 8, y[on] + 8
    place = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(follows, np.int32(-1), place))
    return np.where(follows, common[last] - (place - last), common)


def repeated_starts(contexts: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context the starts whose `length` bytes occur twice or more, counting each context `counts` times."""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes) - sizes
    valid = np.zeros(len(text), np.int64)
    starts = np.zeros(len(text), bool)
    for b, n in zip(begin.tolist(), sizes.tolist()):
        starts[b : b + n - length + 1] = True
    valid[starts] = np.repeat(counts, sizes - length + 1)
    order = suffix_array(text)
    common = shared_prefixes(text, order)[order]
    group = np.cumsum(common < length) - 1
    total = np.bincount(group, weights=valid[order])
    repeated = np.zeros(len(text), bool)
    repeated[order] = total[group] >= 2
    repeated &= starts
    hits = np.flatnonzero(repeated)
    return [part - b for part, b in zip(np.split(hits, np.searchsorted(hits, begin[1:])), begin)]


def _runs(starts: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Covered runs [from, to) of strings of `length` at the sorted starts."""
    if not len(starts):
        return [], []
    new = np.concatenate(([True], starts[1:] > starts[:-1] + length))
    return starts[new].tolist(), (starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)] + length).tolist()


def _text_key() -> F.Column:
    return F.xxhash64("text")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, key, spans (array of [from, to) byte runs, possibly touching) of documents with repeated strings."""
    kind = dict(docs.dtypes)["doc_id"]

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Anchors(length)
        for batch in batches:
            rows, parts = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                raw = np.frombuffer(text.encode(), np.uint8)
                if len(raw) >= length:
                    at, n, h = tool.stretches(raw)
                    parts.append((at, n, h, tool.content(raw, at, n + (length - 1))))
                    rows.append(np.full(len(at), i))
            if not parts:
                continue
            at, n, h, c = (np.concatenate(x) for x in zip(*parts))
            row = pa.array(np.concatenate(rows))
            columns = [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), batch.column("doc_id").take(row), batch.column("key").take(row), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "c", "doc_id", "key", "at", "n"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Anchors(length)
        for batch in batches:
            parts = [tool.stretches(raw)[2] for text in batch.column(0).to_pylist() for raw in [np.frombuffer(text.encode(), np.uint8)] if len(raw) >= length]
            if parts:
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    found = docs.select("doc_id", "key", "text").mapInArrow(anchors, f"h long, c long, doc_id {kind}, key long, at int, n int")
    often = docs.select("text").mapInArrow(tally, "h long, n long").groupBy("h").agg(F.sum("n").alias("_n")).where("_n > 1").select("h")
    places = materialize(found.join(often, "h"), "places")
    different = places.groupBy("h", "c").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "key", "at", "n")).alias("one"))
    own = different.groupBy("one.doc_id", "one.key").agg(F.collect_list(F.struct("h", "c", "times", "one.at", "one.n")).alias("own"))  # as many as one text has
    own = own.withColumnsRenamed({"doc_id": "sid", "key": "skey"})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("own").to_pylist()):
                raw = text.encode()
                out += [(x["h"], x["c"], x["times"], raw[x["at"] : x["at"] + x["n"] - 1 + length]) for x in own]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], ["h", "c", "times", "part"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], ["h", "c", "times", "part"])

    at_text = docs["doc_id"].eqNullSafe(own["sid"]) & (docs["key"] == own["skey"])
    contexts = docs.join(own, at_text).select("text", "own").mapInArrow(cut, "h long, c long, times long, part binary")
    size = different.agg(F.sum(F.col("one.n") + length)).first()[0] or 0

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, times, keys, held, anchor = [], [], [], 0, None

        def flush() -> pa.RecordBatch:
            hits = repeated_starts(parts, np.array(times), length)
            keep = [(k, *_runs(s, length)) for k, s in zip(keys, hits) if len(s)]
            h, c = zip(*(k for k, _, _ in keep)) if keep else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array([a for _, a, _ in keep], pa.list_(pa.int32())), pa.array([b for _, _, b in keep], pa.list_(pa.int32()))], ["h", "c", "lo", "hi"])

        for batch in batches:
            for h, c, n, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if keys and keys[-1] == (h, c):  # rows of one id and text bring it again
                    continue
                if held > SHARD_BYTES and h != anchor:  # an anchor's contexts stay together
                    yield flush()
                    parts, times, keys, held = [], [], [], 0
                parts.append(part)
                times.append(n)
                keys.append((h, c))
                held += len(part)
                anchor = h
        if parts:
            yield flush()

    shards = partitions_for(docs.sparkSession, size, 2 * SHARD_BYTES)
    hits = contexts.repartition(shards, "h").sortWithinPartitions("h", "c").select("h", "c", "times", "part").mapInArrow(shard, "h long, c long, lo array<int>, hi array<int>")
    runs = places.join(hits, ["h", "c"])
    moved = F.transform(F.arrays_zip("lo", "hi"), lambda x: F.struct((x["lo"] + F.col("at")).alias("lo"), (x["hi"] + F.col("at")).alias("hi")))
    return runs.select("doc_id", "key", moved.alias("s")).groupBy("doc_id", "key").agg(F.flatten(F.collect_set("s")).alias("spans"))  # of one text


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of byte runs) and, unless digest_only, kept (binary)."""
    kind = dict(df.dtypes)[id_col]
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", _text_key())
    spans = repeated_spans(docs, length).withColumnsRenamed({"doc_id": "sid", "key": "skey"})

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, kept, removed, end = text.encode(), [], [], 0
                for lo, hi in sorted((x["lo"], x["hi"]) for x in own or ()):
                    if removed and lo <= removed[-1][1]:
                        removed[-1][1] = max(hi, removed[-1][1])
                    else:
                        removed.append([lo, hi])
                for lo, hi in removed:
                    kept.append(raw[end:lo])
                    end = hi
                left = b"".join([*kept, raw[end:]])
                for column, value in zip(columns, (len(raw), len(raw) - len(left), len(removed), hashlib.sha256(left).hexdigest(), removed, left)):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            n = 5 if digest_only else 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays[:n]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"][: n + 1])

    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["sid"]) & (docs["key"] == spans["skey"]), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(take_out, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<int>>" + ", kept binary" * (not digest_only))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), digest_only=True).drop("removed")
