"""N-gram Jaccard join of whole texts with grouped prefixes.

A document's set holds its distinct word n-grams as 64-bit hashes. All sets are ordered alike: n-grams that a count of the
whole corpus shows as frequent come last, the others by hash. Two sets as similar as asked share an n-gram within their
prefixes. Documents of equal sets are one node; nodes of equal prefix and size are one group, whose prefix is dealt out once.
Groups that share a prefix n-gram give pairs under the bound of sizes; the n-grams that a pair shares are counted, and pairs
whose prefixes share too little for what can follow them go; the rest are expanded to members.

Candidates are compared by prints first: the first bits of each hash, as many as tell a set's n-grams apart with few exceptions
(7 more than its size has, `PRINT_BITS` at most). A sorted set's prints are kept as the steps from one to the next, a byte each as
a rule in place of 8. Equal n-grams have equal prints, so prints never show less than is shared, and most candidates are
proven apart by them. They are made where texts are first read; texts are read again only for the sets that have to be verified,
which a table of bits (`WANTED_BITS` at most) tells before anything is shuffled.

No bucket gives all its pairs once it is large (more than `EXHAUST` groups; groups of many members and pairs of such groups
are buckets as well): its members are compared with one pivot, which then leaves it, and only members of different components
meet again. Pairs are compared in the same manner: each node first meets the smallest of its candidates, and pairs that
are joined meanwhile go. After `ROUNDS` rounds all pairs that are left are compared, and buckets that are still
open are compared in blocks, each of which gives a forest. A set is sent once for each hub that it meets, a hub once for
`SPOKES` of them.

The forest that prints give is then verified on full sets. Where a link of it fails, the candidates of its component that the
verified links leave apart are verified themselves. Only verified links join components. Nothing is dropped: each bound is a
proof that a pair isn't linked.

The frequency count is a table of fixed size (`CELLS` counters), whatever the corpus; any order gives right results,
so its collisions cost time at most.

Defined results: null or blank text has no n-grams and no links; fewer words than n make one n-gram of them all; each row has
the component of its text, whose id is the smallest one that is not null; rows with equal ids keep their own rows; further
columns are ignored; an empty table gives an empty result. Equal sets and equal prefixes are told by 128-bit hashes, equal
n-grams by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import kept_in_worker, materialize, materialize_parts, partitions_for, read_table, release, sparing, with_and_without
from .graph import connected_components

CELLS = 1 << 21
BLOCKS = 64
EXHAUST = 48
ROUNDS = 2
BLOCK, BLOCK_ITEMS = 512, 1 << 20
SPOKES = 64
PRINT_BITS = 24
WANTED_BITS = 1 << 27
WORD_TABLE = 300_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _Words(dict):
    """64-bit hash of a word, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_TABLE:
            self[word] = h
        return h


def _words() -> _Words:
    """A worker's, kept from one task to the next."""
    return kept_in_worker("ngram_join", None, _Words)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def ngram_hashes(text: str | None, n: int, words: dict) -> np.ndarray:
    """Hashes of all word n-grams in order; A-Z in lower case, words end at ASCII white space."""
    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    with np.errstate(over="ignore"):
        if len(w) < n:
            w = np.concatenate((w, np.full(n - len(w), len(w), np.uint64)))
        size = len(w) - n + 1
        h = np.zeros(size, np.uint64)
        for i in range(n):
            h = (h + w[i : i + size]) * _ODD[i % 5]
            h ^= h >> np.uint64(32)
        return _mixed(h)


def _ceil_share(percent: int, size: int, of: int = 100) -> int:
    return -(-percent * size // of)


def needed_overlap(a: int, b: int, percent: int) -> int:
    """Least intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    """A linked partner shares at least percent/100 of the set, so one n-gram among so many."""
    return size - _ceil_share(percent, size) + 1


def frequent_cells(docs: DataFrame, n: int) -> bytes:
    """A bit for each counter: whether n-grams that fall on it are frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cells = _words(), np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                h = ngram_hashes(text, n, words)
                np.add.at(cells, (h >> np.uint64(43)).astype(np.int64), 1)
        width = "<u1" if cells.max(initial=0) < 256 else "<i8"  # told by the length
        blocks = [zlib.compress(x.astype(width).tobytes(), 1) for x in np.split(cells, BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(blocks, pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = zlib.decompress(counts)
                part = np.frombuffer(raw, "<u1" if len(raw) == CELLS // BLOCKS else "<i8").astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], ["block", "counts"])

    kind = "block int, counts binary"
    counted = docs.select("text").mapInArrow(sparing("ngram_join", count), kind).repartition(8, "block").mapInArrow(sparing("ngram_join", add), kind)
    found = {row["block"]: row["counts"] for row in counted.collect()}  # BLOCKS rows of bounded size, unpacked one by one

    def cells(block: int) -> np.ndarray:
        return np.frombuffer(zlib.decompress(found[block]), "<i8") if block in found else np.zeros(CELLS // BLOCKS, np.int64)

    mean = sum(int(cells(k).sum()) for k in range(BLOCKS)) / CELLS
    return b"".join(np.packbits(cells(k) > mean + 8 * math.sqrt(mean) + 64).tobytes() for k in range(BLOCKS))


def _ordered(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A sorted set in the common order: bit 63 says frequent."""
    late = frequent[(h >> np.uint64(43)).astype(np.int64)]
    return np.sort((h >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63)))


def _halves(digest: int) -> tuple[int, int]:
    """A 128-bit number as two signed 64-bit ones."""
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


def _prefix(ordered: np.ndarray, percent: int) -> np.ndarray:
    """The first n-grams of a set in the common order, as signed numbers that sort alike."""
    first = ordered[: prefix_length(len(ordered), percent)] if len(ordered) else ordered
    return (first ^ np.uint64(1 << 63)).view(np.int64)


def document_sets(docs: DataFrame, n: int, percent: int, frequent: bytes, bits: int) -> DataFrame:
    """Rows of two kinds. 0, one for each document: the columns of docs but text, n_shingles, h1, h2 (hash of the set), g1, g2 (hash of prefix and size), items (prints).
    1, for each g1, g2 at least once: prefix (n-grams in the common order)."""
    import xxhash

    flags = docs.sparkSession.sparkContext.broadcast(frequent)  # CELLS bits
    rest = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)
    names = [*rest, "n_shingles", "h1", "h2", "g1", "g2", "items", "prefix", "kind"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _words(), set()
        often = np.unpackbits(np.frombuffer(flags.value, np.uint8)).astype(bool)
        for batch in batches:
            size, keys, prefix, items = [], [], {}, []
            if len(seen) > 10_000:
                seen.clear()
            for text in batch.column("text").to_pylist():
                h = np.unique(ngram_hashes(text, n, words))
                items.append(_packed_prints(h, print_bits(len(h), bits)))
                h = _ordered(h, often)
                size.append(len(h))
                first = h[: prefix_length(len(h), percent)] if len(h) else h
                group = _halves(xxhash.xxh3_128_intdigest(first.tobytes(), seed=len(h)))
                keys.append(_halves(xxhash.xxh3_128_intdigest(h.tobytes())) + group)
                if len(h) and group not in seen:
                    seen.add(group)
                    prefix[group] = _prefix(h, percent)
            hashes = [pa.array(c, pa.int64()) for c in (zip(*keys) if keys else [()] * 4)]
            none = pa.nulls(len(size), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(size, pa.int64()), *hashes, pa.array(items, pa.binary()), none, pa.array([0] * len(size), pa.int32())], names)
            m = len(prefix)
            groups = [pa.array(c, pa.int64()) for c in (zip(*prefix) if prefix else [()] * 2)]
            nothing = [pa.nulls(m, batch.column(c).type) for c in rest]
            yield pa.RecordBatch.from_arrays([*nothing, *(pa.nulls(m, pa.int64()) for _ in range(3)), *groups, pa.nulls(m, pa.binary()), pa.array(list(prefix.values()), pa.list_(pa.int64())), pa.array([1] * m, pa.int32())], names)

    return docs.mapInArrow(sparing("ngram_join", build), ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", n_shingles long, h1 long, h2 long, g1 long, g2 long, items binary, prefix array<long>, kind int")


def _numbers(cell: bytes) -> np.ndarray:
    """A set as it is stored: sorted hashes."""
    return np.frombuffer(cell, np.int64)


def print_bits(size: int, most: int) -> int:
    """Bits of a print in a set of so many n-grams: of all other n-grams about one in 128 or fewer shares a print of the set."""
    return min(most, int(size).bit_length() + 7)


def _packed_prints(h: np.ndarray, bits: int) -> bytes:
    """Prints of a sorted set of hashes: the steps between them, each as its remainder by 255 after as many bytes of 255 as it holds."""
    steps = np.diff((h >> np.uint64(64 - bits)).astype(np.int64), prepend=0)
    more, rest = np.divmod(steps, 255)
    out = np.full(int(more.sum()) + len(steps), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def _prints(cell: bytes) -> np.ndarray:
    """Stored prints as sorted numbers."""
    steps = np.frombuffer(cell, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _numbered(prints: np.ndarray) -> np.ndarray:
    """Sorted prints, those that are equal told apart by their turn."""
    return (prints << 32) + np.arange(len(prints)) - np.searchsorted(prints, prints)


def _shared_prints(n: int, x: np.ndarray, m: int, y: np.ndarray, most: int) -> int:
    """How many n-grams two sets of sizes n and m share at most, by their prints."""
    bx, by = print_bits(n, most), print_bits(m, most)
    bits = min(bx, by)
    return _shared(_numbered(x >> (bx - bits)), _numbered(y >> (by - bits)))


def _wanted_bits(keys: DataFrame) -> np.ndarray:
    """A table of bits, about 16 a row of keys (k) and WANTED_BITS at most, with one set for each."""
    size = min(WANTED_BITS, 1 << max(15, (16 * keys.count()).bit_length()))
    at = keys.select(F.pmod("k", F.lit(size)).alias("at"))
    found = at.groupBy(F.expr("CAST(at DIV 32768 AS INT)").alias("block")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(32768))).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for row in found.collect():  # blocks of 4 KB, a table of bounded size in all
        out[row["block"] * 4096 : (row["block"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _text_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node, n, items (sorted set as bytes) for wanted (node, doc_id, t1, t2), from the texts where they are; only sets are shuffled."""
    key = F.xxhash64("doc_id", "t1", "t2")
    table = docs.sparkSession.sparkContext.broadcast(_wanted_bits(wanted.select(key.alias("k"))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = _words(), table.value
        for batch in batches:
            at = batch.column(4).to_numpy() & (8 * len(held) - 1)
            batch = batch.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            sets = [np.unique(ngram_hashes(t, n, words)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([len(x) for x in sets], pa.int64()), pa.array([np.sort(x.view(np.int64)).tobytes() for x in sets], pa.binary())], ["doc_id", "t1", "t2", "n", "items"])

    made = docs.select("doc_id", "t1", "t2", "text", key.alias("k")).mapInArrow(sparing("ngram_join", build), f"doc_id {dict(docs.dtypes)['doc_id']}, t1 long, t2 long, n long, items binary")
    w = wanted.select("node", F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    return made.join(w, (made["t1"] == w["_t1"]) & (made["t2"] == w["_t2"]) & made["doc_id"].eqNullSafe(w["_id"])).select("node", "n", "items").dropDuplicates(["node"])  # repeated rows only


def bucket_pairs(entries: DataFrame, percent: int, exhaust: int) -> DataFrame:
    """Pairs of groups from entries (token, grp, n, pos), one bucket per token, read in one sorted stream.

    kind 0: a pair that the bound of sizes allows, of a bucket of at most `exhaust` groups;
    kind 1: an entry of a larger bucket, to be taken up again (b: unused).
    """

    def emit(token: int, rows: list[tuple[int, int, int]], out: list[tuple]) -> None:
        for i, (g, n, pos) in enumerate(rows):
            for h, m, at in rows[i + 1 :]:
                if 100 * min(n, m) >= percent * max(n, m):
                    out.append((0, token, *((g, h, pos, at) if g < h else (h, g, at, pos))))

    names = ["kind", "token", "a", "b", "pa", "pb"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, held, large, out = None, [], False, []  # held: the bucket's groups, `exhaust` at most; none once large
        for batch in batches:
            t, g, n, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(t):
                continue
            edges = np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)]))
            several = np.diff(edges) > 1
            several[[0, -1]] = True  # these may go on in another batch
            for k in np.flatnonzero(several).tolist():
                lo, hi = int(edges[k]), int(edges[k + 1])
                if int(t[lo]) != token:
                    emit(token, held, out)
                    token, held, large = int(t[lo]), [], False
                for row in zip(g[lo:hi].tolist(), n[lo:hi].tolist(), p[lo:hi].tolist()):
                    if large:
                        out.append((1, token, row[0], 0, 0, 0))
                        continue
                    held.append(row)
                    if len(held) > exhaust:
                        out += [(1, token, a, 0, 0, 0) for a, _, _ in held]
                        large, held = True, []
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
        emit(token, held, out)
        yield batch_of(out)

    spread = entries.repartition(partitions_for(entries.sparkSession, 0, 1), "token").sortWithinPartitions("token")
    return spread.select("token", "grp", "n", "pos").mapInArrow(sparing("ngram_join", stream), "kind int, token long, a long, b long, pa long, pb long")


def _likely(found: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups (a, b, with their sizes as sa, sb) whose prefixes share enough.

    Up to the smaller of the two last prefix n-grams both sets are known whole: what they share there is counted, but for
    n-grams of large buckets, of which the smaller number is added; what the set with the smaller last one has after it bounds the rest. No prefix is sent for this."""
    big = found.where("kind = 1").groupBy(F.col("a").alias("grp")).agg(F.count("*").alias("big"))
    shown = groups.select("grp", "n", "size", F.element_at("prefix", -1).alias("last"), F.size("prefix").alias("p")).join(big, "grp", "left")
    x = shown.select(F.col("grp").alias("a"), F.col("n").alias("na"), F.col("size").alias("sa"), F.col("last").alias("la"), (F.col("n") - F.col("p")).alias("ra"), F.coalesce("big", F.lit(0)).alias("ba"))
    y = shown.select(F.col("grp").alias("b"), F.col("n").alias("nb"), F.col("size").alias("sb"), F.col("last").alias("lb"), (F.col("n") - F.col("p")).alias("rb"), F.coalesce("big", F.lit(0)).alias("bb"))
    pairs = found.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("both"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    pairs = pairs.join(x, "a").join(y, "b")
    rest = F.least(F.when(F.col("la") <= F.col("lb"), F.col("ra")).otherwise(F.col("na") - F.col("pa") - 1), F.when(F.col("lb") <= F.col("la"), F.col("rb")).otherwise(F.col("nb") - F.col("pb") - 1))
    most = F.col("both") + F.least("ba", "bb") + rest
    return pairs.where((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b", "sa", "sb")


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The cells of a column of lists of numbers."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[i:j] for i, j in zip(at[:-1], at[1:])]


def _cells(read: Callable) -> Callable:
    """The cells of a column of bytes, each read by `read`."""
    return lambda column: [read(x) for x in column.to_pylist()]


def _met(pairs: DataFrame, sets: DataFrame, test: Callable, arrays: Callable) -> DataFrame:
    """The pairs (hub, node), as (a, b), whose sets (node, n, items), read by `arrays`, pass test(n, items, n, items); a hub's pairs are cut into parts of about SPOKES."""
    dealt = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("_parts"))
    spokes = pairs.join(dealt, "hub").select("hub", F.pmod(F.xxhash64("node"), "_parts").cast("int").alias("part"), "node")
    hubs = dealt.select("hub", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.col("hub").alias("node"))
    full = spokes.unionByName(hubs).join(sets, "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub = None, None
        for batch in batches:
            a, b = [], []
            for h, part, spoke, node, n, items in zip(*(batch.column(i).to_pylist() for i in range(5)), arrays(batch.column(5))):
                if not spoke:
                    key, hub = (h, part), (n, items.copy())
                    continue
                assert key == (h, part)
                if test(*hub, n, items):
                    a.append(h)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = full.select("hub", "part", (F.col("node") != F.col("hub")).alias("spoke"), "node", "n", "items")
    return rows.repartition(partitions_for(pairs.sparkSession, 0, 1), "hub", "part").sortWithinPartitions("hub", "part", "spoke").mapInArrow(sparing("ngram_join", meet), "a long, b long")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(x):
        return 0
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, node) whose sets are linked, as (a, b)."""
    return _met(pairs, sets, lambda n, x, m, y: _shared(x, y) >= needed_overlap(n, m, percent), _cells(_numbers))


def _possible(pairs: DataFrame, prints: DataFrame, percent: int, bits: int) -> DataFrame:
    """The pairs (hub, node) that prints don't prove apart, as (a, b)."""

    def test(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
        return 100 * min(n, m) >= percent * max(n, m) and _shared_prints(n, x, m, y, bits) >= needed_overlap(n, m, percent)

    return _met(pairs, prints, test, _cells(_prints))


def _overlapping(likely: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The rows of likely whose prefixes are seen to share enough."""

    def enough(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
        # up to the smaller last n-gram both sets are known whole; the set that has it has only so many after it
        return _shared(x, y) + min(n - len(x) if x[-1] <= y[-1] else m, m - len(y) if y[-1] <= x[-1] else n) >= needed_overlap(n, m, percent)

    pairs = _met(likely.select(F.col("a").alias("hub"), F.col("b").alias("node")), groups.select(F.col("grp").alias("node"), "n", F.col("prefix").alias("items")), enough, _lists)
    return likely.join(pairs, ["a", "b"], "left_semi")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs (a, b) without those whose nodes have the same label."""
    x = labels.select(F.col("node").alias("a"), F.col("component").alias("_ca"))
    y = labels.select(F.col("node").alias("b"), F.col("component").alias("_cb"))
    return pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")


def _text_hash(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def jaccard_links(df: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", also: list[str] | None = None, bits: int = PRINT_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: doc_id, t1 and t2 (hash of the text) if `also` asks for them, n_shingles, h1, h2; nodes: h1, h2, node, doc_id, the smallest one, and more; links: a, b between nodes, enough to connect all that is linked).

    bits: of a print, 24 at most; fewer prove less, with the same links in the end."""
    text = F.col(text_col).cast("string")
    t1, t2 = _text_hash(text)
    docs = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), t1.alias("t1"), t2.alias("t2"))
    frequent = frequent_cells(docs, n)
    sets, prefixes = materialize_parts(document_sets(docs, n, percent, frequent, bits), "sets", "kind", [0, 1])
    filled = sets.where("n_shingles > 0")
    # prefixes once for each group and task, and so a copy's prefix is never sent
    shown = materialize(prefixes.groupBy("g1", "g2").agg(F.first("prefix").alias("prefix")), "shown")
    release(prefixes)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("one")
    nodes = filled.groupBy("h1", "h2").agg(one, F.first("n_shingles").alias("n"), F.first("g1").alias("g1"), F.first("g2").alias("g2"), F.first("items").alias("items"))
    nodes = materialize(nodes.select("h1", "h2", F.monotonically_increasing_id().alias("node"), "n", "g1", "g2", "one.doc_id", "one.t1", "one.t2", "items"), "nodes")
    rows = materialize(sets.select("doc_id", *(also or []), "n_shingles", "h1", "h2"), "rows")
    release(sets)
    sized = nodes.groupBy("g1", "g2").agg(F.min("node").alias("grp"), F.first("n").alias("n"), F.count("*").alias("size"))
    groups = materialize(shown.join(sized, ["g1", "g2"]), "groups")
    release(shown)
    several = materialize(nodes.join(groups.where("size > 1").select("g1", "g2", "grp"), ["g1", "g2"]).select("grp", "node"), "members")

    entries = groups.select("grp", "n", F.posexplode("prefix").alias("pos", "token"))
    found = materialize(bucket_pairs(entries, percent, EXHAUST), "pairs")
    likely = materialize(_likely(found, groups, percent), "likely")
    likely = materialize(_overlapping(likely, groups, percent), "overlapping")
    few = F.col("sa") * F.col("sb") <= EXHAUST
    lead = likely.where("sa = 1 AND sb = 1").select("a", "b")
    some = likely.where(few & ((F.col("sa") > 1) | (F.col("sb") > 1))).select(F.col("a").alias("ga"), F.col("b").alias("gb"))
    members = several.unionByName(groups.where("size = 1").select("grp", F.col("grp").alias("node")))
    expanded = some.join(members.select(F.col("grp").alias("ga"), F.col("node").alias("x")), "ga").join(members.select(F.col("grp").alias("gb"), F.col("node").alias("y")), "gb")
    pairs = materialize(lead.unionByName(expanded.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))), "candidates")

    # buckets: large ones by token, groups of several members, and pairs of groups too many to expand
    many = likely.where(~few).select(F.xxhash64("a", "b").alias("bucket"), F.explode(F.array("a", "b")).alias("grp"))
    buckets = found.where("kind = 1").select(F.col("token").alias("bucket"), F.col("a").alias("grp")).unionByName(many)
    buckets = buckets.join(members, "grp").select("bucket", "node").unionByName(several.select(F.col("grp").alias("bucket"), "node"))
    buckets = materialize(buckets, "buckets")
    prints = nodes.select("node", "n", "items")
    sizes = prints.select("node", "n")
    release(groups, several, found, likely)

    all_pairs, all_buckets, links = pairs, buckets, None
    spent: list[DataFrame] = []  # tables that nothing after the round reads
    for turn in range(ROUNDS + 1):
        last = turn == ROUNDS
        if links is not None:
            labels = connected_components(links, "a", "b")
            pairs = materialize(_apart(pairs, labels), "candidates")
            spent += [labels, pairs]
        else:
            labels = sizes.select("node", F.col("node").alias("component"))
        meet = pairs.select(F.col("a").alias("hub"), F.col("b").alias("node"))
        if not last:
            meet = meet.groupBy("node").agg(F.min("hub").alias("hub")).select("hub", "node")
            tried = materialize(meet, "tried")
            spent.append(tried)
            pairs = pairs.join(tried.select(F.col("hub").alias("a"), F.col("node").alias("b")), ["a", "b"], "left_anti")
            meet = tried
        held = buckets.join(sizes, "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = held.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "component")).alias("pivot"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x2"), F.count("*").alias("held")).where("lo != hi")
        # buckets of the same nodes are one
        open_ = materialize(open_.groupBy("x1", "x2", "held").agg(F.min("bucket").alias("bucket"), F.first("pivot").alias("pivot")), "open")
        held = materialize(held.join(open_.select("bucket", "pivot"), "bucket"), "held")
        spent += [open_, held]
        if last:
            held = materialize(_clustered(held.select("bucket", "node", "component", "n")), "blocks")
            spent.append(held)
            links_now = [_possible(meet, prints, percent, bits), block_links(held, prints, percent, _print_overlaps(bits, percent))]
        else:
            fits = (100 * F.least("n", "pivot.n") >= percent * F.greatest("n", "pivot.n")) & (F.col("component") != F.col("pivot.component"))
            spokes = held.where(fits).select(F.col("pivot.node").alias("hub"), "node")
            links_now = [_possible(meet.unionByName(spokes).distinct(), prints, percent, bits)]
            buckets = held.where(F.col("node") != F.col("pivot.node")).select("bucket", "node")
        spent += [links] if links is not None else []
        for more in links_now:
            links = more if links is None else links.unionByName(more)
        links = materialize(links, "possible")
    release(*spent)
    possible = links
    links = _settled(docs, nodes, possible, all_pairs, all_buckets, prints, n, percent, bits)
    release(possible, all_pairs, all_buckets)
    return rows, nodes, links


def _settled(docs: DataFrame, nodes: DataFrame, possible: DataFrame, pairs: DataFrame, buckets: DataFrame, prints: DataFrame, n: int, percent: int, bits: int) -> DataFrame:
    """Links (a, b), enough to connect all that is linked, from the possible ones that connect all that prints leave possible.

    Linked nodes share a component of possible links. Where one of these falls apart on full sets, the candidates of its nodes
    (pairs a, b; buckets bucket, node) are verified themselves."""

    def full(wanted: DataFrame) -> DataFrame:
        return materialize(_text_sets(docs, nodes.join(wanted.distinct(), "node").select("node", "doc_id", "t1", "t2"), n), "full")

    ends = full(possible.select(F.explode(F.array("a", "b")).alias("node")))
    links = materialize(_verified(possible.select(F.col("a").alias("hub"), F.col("b").alias("node")).distinct(), ends, percent), "verified")
    release(ends)
    whole = connected_components(possible, "a", "b").withColumnRenamed("component", "whole")
    parts = whole.join(connected_components(links, "a", "b"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    broken = parts.groupBy("whole").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("whole")
    doubt = materialize(parts.join(broken, "whole"), "doubt")
    if doubt.isEmpty():
        return links
    x, y = (doubt.select(F.col("node").alias(c), F.col("whole").alias(f"w{c}"), F.col("component").alias(f"c{c}")) for c in "ab")
    again = pairs.join(x, "a").join(y, "b").where("wa = wb AND ca != cb").select(F.col("a").alias("hub"), F.col("b").alias("node"))
    again = materialize(_possible(again, prints, percent, bits), "again")
    held = buckets.join(doubt, "node").select(F.xxhash64("bucket", "whole").alias("bucket"), "node", "component")
    apart = held.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("bucket")
    sizes = prints.select("node", "n")
    held = materialize(_clustered(held.join(apart, "bucket").join(sizes, "node").select("bucket", "node", "component", "n")), "held")
    held = materialize(_meeting(held, prints, percent, bits).join(held, ["bucket", "node"]), "meeting")
    ends = full(again.select(F.explode(F.array("a", "b")).alias("node")).unionByName(held.select("node")))
    more = _verified(again.select(F.col("a").alias("hub"), F.col("b").alias("node")), ends, percent)
    links = materialize(links.unionByName(more).unionByName(block_links(held, ends, percent, _full_overlaps)), "verified")
    release(ends)
    return links


def _parts() -> Column:
    """Blocks that a bucket's rows make: of at most about BLOCK sets and BLOCK_ITEMS n-grams."""
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ITEMS)).cast("int")


def _clustered(held: DataFrame) -> DataFrame:
    """held (bucket, node, component, n) with buckets that hang together by their nodes made one, where that sends fewer sets than the buckets do."""
    held = materialize(held, "held")
    cost = held.groupBy("bucket").agg(F.min("node").alias("lead"), (F.count("*") * _parts()).alias("apart"))
    cost = materialize(cost, "cost")
    whole = connected_components(held.join(cost, "bucket").select("node", "lead"), "node", "lead")
    whole = materialize(cost.join(whole.withColumnRenamed("node", "lead"), "lead", "left").select("bucket", "apart", F.coalesce("component", "lead").alias("cluster")), "clusters")
    nodes = materialize(held.join(whole, "bucket").select("cluster", "node", "component", "n").distinct(), "clustered")
    good = nodes.groupBy("cluster").agg((F.count("*") * _parts()).alias("together")).join(whole.groupBy("cluster").agg(F.sum("apart").alias("apart")), "cluster").where("together <= apart").select("cluster")
    good = materialize(good, "good")
    kept = held.join(whole.join(good, "cluster", "left_anti").select("bucket"), "bucket").select("bucket", "node", "component", "n")
    return nodes.join(good, "cluster").select(F.col("cluster").alias("bucket"), "node", "component", "n").unionByName(kept)


def _blocks(buckets: DataFrame, sets: DataFrame, task: Callable, kind: str) -> DataFrame:
    """task(rows) for each two blocks of a bucket (bucket, node, n, and what sets has by node).

    A bucket's sets are cut into blocks, and blocks meet two by two, so a set is sent once for each block of its bucket and not
    once for each pair."""
    sizes = materialize(buckets.groupBy("bucket").agg(_parts().alias("_parts")), "parts")
    own = F.pmod(F.xxhash64("node"), "_parts").cast("int")
    cut = buckets.join(sizes, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    cut = cut.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other")
    full = cut.join(sets, "node")
    keys = ["bucket", "lo", "hi"]
    rest = [c for c in full.columns if c not in keys]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for *at, row in zip(*(batch.column(c).to_pylist() for c in keys), batch.select(rest).to_pylist()):
                if at != key:
                    if len(held) > 1:
                        yield task(key[0], key[1] == key[2], held)
                    key, held = at, []
                held.append(row)
        if len(held) > 1:
            yield task(key[0], key[1] == key[2], held)

    dealt = full.repartition(partitions_for(buckets.sparkSession, 0, 1), *keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, *rest).mapInArrow(sparing("ngram_join", meet), kind)


def _hits(rows: list[dict], same: bool, percent: int, overlaps: Callable) -> np.ndarray:
    """Which two rows of different components share enough, within one block or between the two; overlaps: of sizes and stored sets."""
    n, own, component = (np.array([r[c] for r in rows]) for c in ("n", "own", "component"))
    both = overlaps(n, [r["items"] for r in rows])
    hit = ((100 + percent) * both >= percent * (n[:, None] + n[None, :])) & (component[:, None] != component[None, :])
    return hit if same else hit & (own[:, None] != own[None, :])


def _meeting(held: DataFrame, prints: DataFrame, percent: int, bits: int) -> DataFrame:
    """bucket, node: the members of buckets (bucket, node, component, n) that prints don't prove apart from all members of other components."""

    def mark(bucket: int, same: bool, rows: list[dict]) -> pa.RecordBatch:
        node = [r["node"] for r, h in zip(rows, _hits(rows, same, percent, _print_overlaps(bits, percent)).any(axis=1).tolist()) if h]
        return pa.RecordBatch.from_arrays([pa.array([bucket] * len(node), pa.int64()), pa.array(node, pa.int64())], ["bucket", "node"])

    return _blocks(held, prints.select("node", "items"), mark, "bucket long, node long").distinct()


def block_links(buckets: DataFrame, sets: DataFrame, percent: int, overlaps: Callable) -> DataFrame:
    """a, b: enough links to connect all that is linked among nodes of one bucket (bucket, node, component, n) but of different components: a spanning forest of each two blocks' links."""
    return _blocks(buckets, sets.select("node", "items"), lambda _, same, rows: _forest(rows, _hits(rows, same, percent, overlaps)), "a long, b long")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all two sets."""
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, item, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[item] > 1
    row, item = row[keep], item[keep]
    _, item = np.unique(item, return_inverse=True)
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 1 << 12
    for lo in range(0, int(item.max(initial=-1)) + 1, width):
        here = (item >= lo) & (item < lo + width)
        part = np.zeros((len(sets), width), np.float32)
        part[row[here], item[here] - lo] = 1
        both += part @ part.T
    return both.astype(np.int64)


def _full_overlaps(n: np.ndarray, cells: list[bytes]) -> np.ndarray:
    return _overlaps([_numbers(c) for c in cells])


def _print_overlaps(most: int, percent: int) -> Callable:
    """What stored prints show to be shared at most, among sets whose sizes are near enough for a link, so whose prints have about as many bits."""
    apart = (100 // percent).bit_length()

    def overlaps(n: np.ndarray, cells: list[bytes]) -> np.ndarray:
        own = np.array([print_bits(x, most) for x in n.tolist()])
        both = np.zeros((len(n), len(n)), np.int64)
        for bits in np.unique(own).tolist():
            rows = np.flatnonzero((own >= bits) & (own <= bits + apart))
            part = _overlaps([_numbered(_prints(cells[i]) >> (own[i] - bits)) for i in rows.tolist()])
            fits = np.minimum(own[rows][:, None], own[rows][None, :]) == bits
            both[np.ix_(rows, rows)] = np.where(fits, part, both[np.ix_(rows, rows)])
        return both

    return overlaps


def _forest(rows: list[dict], hit: np.ndarray) -> pa.RecordBatch:
    """A spanning forest of hits, as (node, node); each tree is grown level by level from its first node."""
    nodes, free = np.array([r["node"] for r in rows]), hit.any(axis=1)
    a, b = [], []
    while free.any():
        level = np.flatnonzero(free)[:1]
        free[level] = False
        while len(level):
            reached = np.flatnonzero(free & hit[level].any(axis=0))
            a.append(nodes[level[hit[np.ix_(level, reached)].argmax(axis=0)]])
            b.append(nodes[reached])
            free[reached] = False
            level = reached
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flat], ["a", "b"])


def _classes(df: DataFrame, n: int, percent: int, id_col: str, text_col: str, also: list[str] | None = None, bits: int = PRINT_BITS) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, the columns `also`, n_shingles, component_id, component, a number for each class, null without words; tables that this reads)."""
    docs, nodes, links = jaccard_links(df, n, percent, id_col, text_col, also, bits)
    labels = connected_components(links, "a", "b")
    placed = nodes.select("h1", "h2", "node", "doc_id").join(labels.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("_least"))
    placed = materialize(placed.join(least, "component").select("h1", "h2", "component", "_least"), "classes")
    release(labels, links, nodes)
    out = docs.join(placed, ["h1", "h2"], "left").withColumn("component", F.when(F.col("n_shingles") > 0, F.col("component")))
    return out.select("doc_id", *(also or []), "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("_least")), "doc_id").alias("component_id"), "component"), [docs, placed]


def jaccard_classes(df: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", bits: int = PRINT_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable over links."""
    return _classes(df, n, percent, id_col, text_col, bits=bits)[0].drop("component")


def keep_one(df: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", left: list[DataFrame] | None = None) -> DataFrame:
    """One row of each class, that of the smallest id (null ids last, then that of the smallest hash of its text; any of rows that repeat id and text); rows without words all stay.

    left: gets the tables to release once the result is written."""
    key = ["doc_id", "t1", "t2"]
    found, read = _classes(df, n, percent, id_col, text_col, key[1:])
    keys = materialize(found.where("component is not null").groupBy("component", *key).agg(F.count("*").alias("n")), "keys")
    release(*read)
    first = keys.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *key)).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))
    fate = keys.join(first, "component").select(*[F.col(c).alias(f"__{c}") for c in key], stays.alias("__stays"), "n").where(~F.col("__stays") | (F.col("n") > 1)).drop("n")
    fate = materialize(fate, "fate")
    release(keys)
    if left is not None:
        left.append(fate)
    text = F.col(text_col).cast("string")
    same = F.col(id_col).eqNullSafe(F.col("__doc_id")) & (_text_hash(text)[0] == F.col("__t1")) & (_text_hash(text)[1] == F.col("__t2"))
    some, whole = with_and_without(df, F.xxhash64(id_col, *_text_hash(text)), fate.select(F.xxhash64("__doc_id", "__t1", "__t2").alias("k")))
    told = some.join(fate.hint("merge"), same, "left")  # both sides grow with the table; rows that stay are not sent
    repeated = told.where("__stays").dropDuplicates(["__doc_id", "__t1", "__t2"])
    return told.where("__stays is null").unionByName(repeated).select(*[F.col(f"`{c}`") for c in df.columns]).unionByName(whole)


def op10_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents"))
