"""GIF images: a decoder to timed frames with colour histograms, and a lossless writer of 8-bit samples.

The LZW decoder works on whole runs of codes between two clear codes. The width of a code follows from its place in
its run, so a run is read at once; an entry made at code i is the i-th string and the byte after it, that is a
stretch of the output itself. The lengths of strings and the sources of bytes are therefore chains of references,
which are followed by pointer doubling in a few vector steps.

Defined results: null text is empty; the payload is padded with spaces to a positive multiple of 192 bytes; equal
texts give equal files. Truncated code streams give the pixels they hold, the rest of a frame stays 0. Codes after those that fill a frame are
not read. Files that are not GIF give no frames; a frame or canvas of more than MAX_PIXELS gives a row with its place and time and a problem. Rows are independent, a long text is many frames; nothing is shuffled; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read_table

WIDTH, ROWS = 192, 256
_LIMIT = 4096


@dataclass
class Frame:
    """One image as stored (indices) and as shown (canvas, RGBA)."""

    number: int
    left: int
    top: int
    delay_ms: int
    disposal: int
    transparent: int | None
    indices: np.ndarray | None
    canvas: np.ndarray | None
    width: int = 0
    height: int = 0
    problem: str | None = None

    def histogram(self) -> np.ndarray:
        """Counts of the shown colours in 64 cells of two bits a channel; unpainted pixels are left out."""
        rgba = self.canvas.reshape(-1, 4)
        cell = (rgba[:, 0] >> 6 << 4) | (rgba[:, 1] >> 6 << 2) | (rgba[:, 2] >> 6)
        return np.bincount(cell if rgba[:, 3].all() else cell[rgba[:, 3] > 0], minlength=64)


@functools.lru_cache(maxsize=8)
def _offsets(least: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where, in bits after a clear code, the first n codes start, and their masks."""
    made = np.minimum((1 << least) + 1 + np.arange(n), _LIMIT - 1)
    widths = np.maximum(np.floor(np.log2(made)).astype(np.int64) + 1, least + 1)
    return np.concatenate(([0], np.cumsum(widths))), ((1 << widths) - 1).astype(np.uint32)


def lzw_decode(data: bytes, least: int, n_pixels: int) -> np.ndarray:
    clear, end = 1 << least, (1 << least) + 1
    total = 8 * len(data)
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    raw = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    out, have, bit, size = [], 0, 0, _LIMIT
    while have < n_pixels and bit < total:
        offsets, masks = _offsets(least, size)
        n = min(size, int(np.searchsorted(offsets, total - bit, side="right")) - 1)
        if n < 1:
            break
        at = offsets[:n] + bit
        codes = (raw[at >> 3] >> (at & 7).astype(np.uint32)) & masks[:n]
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        if stop == size:  # the run goes on with a full table: read it again, further
            size *= 4
            continue
        size = _LIMIT
        if stop:
            pixels = _strings(codes[:stop].astype(np.int32), end + 1, n_pixels - have)
            out.append(pixels)
            have += len(pixels)
        if stop == n or codes[stop] == end:
            break
        bit += int(offsets[stop + 1])
    pixels = np.concatenate(out)[:n_pixels] if out else np.zeros(0, np.uint8)
    return pixels if len(pixels) == n_pixels else np.concatenate((pixels, np.zeros(n_pixels - len(pixels), np.uint8)))


def _strings(codes: np.ndarray, first: int, want: int) -> np.ndarray:
    """The bytes that a run of codes without clear codes stands for; codes after those that give `want` bytes are left out before anything of the output's size is made."""
    parent = codes - np.int32(first)
    early = parent >= np.arange(len(codes), dtype=np.int32)
    if early.any():  # refers to what is not made yet: keep what comes before
        codes = codes[: int(np.argmax(early))]
        parent = parent[: len(codes)]
        if not len(codes):
            return np.zeros(0, np.uint8)
    made = parent >= 0
    todo = np.flatnonzero(made)
    length, hop = made.astype(np.int64), np.where(made, parent, np.int32(-1))
    chain = todo
    while len(chain):
        to = hop[chain]
        more, then = length[to], hop[to]
        length[chain] += more
        hop[chain] = then
        chain = chain[then >= 0]
    length += 1
    ends = np.cumsum(length)
    enough = int(np.searchsorted(ends, want)) + 1  # strings refer to earlier ones only
    codes, parent, made, length, start = codes[:enough], parent[:enough], made[:enough], length[:enough], (ends - length)[:enough]
    todo = todo[todo < enough]
    values = np.zeros(int(start[-1] + length[-1]), np.uint8)
    values[start[~made]] = codes[~made]
    if not len(todo):
        return values
    # the bytes that are copied, and where from
    n = length[todo]
    place = np.repeat(start[todo] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()), dtype=np.int64)
    source = np.arange(len(values), dtype=np.int64)
    source[place] = place + np.repeat(start[parent[todo]] - start[todo], n)
    copied = np.zeros(len(values), bool)
    copied[place] = True
    while len(place):
        then = source[source[place]]
        source[place] = then
        place = place[copied[then]]
    return values[source]


def _packed(codes: np.ndarray) -> bytes:
    """A clear code, codes of one run, the end code."""
    offsets, _ = _offsets(8, max(_LIMIT, 1 << len(codes).bit_length()))
    at = np.concatenate(([0], offsets[: len(codes) + 2] + 9))
    value = np.concatenate(([256], codes, [257])).astype(np.uint64) << (at[:-1] & 7).astype(np.uint64)
    out = np.zeros((int(at[-1]) >> 3) + 4, np.int64)
    for k in range(3):  # codes touch three bytes at most, and no bit twice
        out += np.bincount((at[:-1] >> 3) + k, ((value >> np.uint64(8 * k)) & np.uint64(255)).astype(np.float64), minlength=len(out)).astype(np.int64)
    return out[: (int(at[-1]) + 7) >> 3].astype(np.uint8).tobytes()


def lzw_encode(pixels: bytes, literals: int = 1536) -> bytes:
    """LZW of 8-bit pixels in vector steps, one run of codes.

    The first pixels go out as they are, which makes table entries of the pairs seen; from there on known pairs go
    out as one code. Any choice of codes is valid LZW; this one needs no step for each pixel.
    """
    p = np.frombuffer(pixels, np.uint8).astype(np.int32)
    m = min(len(p), literals, _LIMIT - 258)
    if len(p) - m < 2:
        return _packed(p)
    entry = np.full(65536, -1, np.int32)
    entry[p[: m - 1] << 8 | p[1:m]] = np.arange(258, 257 + m)
    rest = p[m:]
    pair = np.append(entry[rest[:-1] << 8 | rest[1:]], np.int32(-1))
    known = pair >= 0
    place = np.arange(len(rest), dtype=np.int32)
    begin = np.maximum.accumulate(np.where(known, -1, place + 1))  # of the stretch of known pairs
    takes = known & ((place - np.maximum(begin, 0)) & 1 == 0)
    skipped = np.concatenate(([False], takes[:-1]))
    return _packed(np.concatenate((p[:m], np.where(takes, pair, rest)[~skipped])))


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part)]) + part for i in range(0, len(data), 255) for part in [data[i : i + 255]]) + b"\0"


#: The writer's palette: every index its own colour, spread over the cube.
PALETTE = bytes(c for i in range(256) for c in (i, i * 37 % 256, 255 - i))


def write_gif(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_ms: int = 100, palette: bytes = PALETTE) -> bytes:
    """Samples as palette indices, in timed frames of at most `rows` lines of `width`."""
    height = min(rows, len(samples) // width)
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    for at in range(0, len(samples), rows * width):
        part = samples[at : at + rows * width]
        parts += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, delay_ms // 10, 0, 0)]
        parts += [b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*parts, b"\x3b"])


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    """The bytes of a chain of sub-blocks, and what follows it."""
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


#: A larger frame isn't decoded and a larger canvas isn't painted, as a header of a few bytes could else claim any memory; such frames have a row that says so.
MAX_PIXELS = 1 << 25


def read_gif(data: bytes) -> Iterator[Frame]:
    """Frames in order, composed under palettes, transparency and disposal; reading ends where a file is cut short or no GIF.

    A frame of more than MAX_PIXELS has no indices, one on a canvas of more than that no shown pixels; `problem` says so, and reading goes on."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        common, at = data[at : at + n], at + n
    canvas = np.zeros((high, wide, 4), np.uint8) if wide * high <= MAX_PIXELS else None
    delay, disposal, transparent, number = 0, 0, None, 0
    while at < len(data):
        mark = data[at]
        if mark == 0x21 and at + 1 < len(data):
            body, after = _joined(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                delay, disposal = 10 * (body[1] | body[2] << 8), body[0] >> 2 & 7
                transparent = body[3] if body[0] & 1 else None
            at = after
        elif mark == 0x2C and at + 11 <= len(data):
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = common
            if flags & 0x80:
                n = 3 << ((flags & 7) + 1)
                palette, at = data[at : at + n], at + n
            if at >= len(data) or not 1 <= data[at] <= 11:
                return
            least = data[at]
            body, at = _joined(data, at + 1)
            problem = f"frame of more than {MAX_PIXELS} pixels" if w * h > MAX_PIXELS else f"canvas of more than {MAX_PIXELS} pixels" if canvas is None else None
            if problem:
                indices = lzw_decode(body, least, w * h).reshape(h, w) if w * h <= MAX_PIXELS else None
                yield Frame(number, left, top, delay, disposal, transparent, indices if not flags & 0x40 else None, None, w, h, problem)
                number, delay, disposal, transparent = number + 1, 0, 0, None
                continue
            indices = lzw_decode(body, least, w * h).reshape(h, w)
            if flags & 0x40:
                order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                whole = np.empty_like(indices)
                whole[order] = indices
                indices = whole
            colours = np.zeros((256, 4), np.uint8)
            if palette:
                table = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)
                colours[: len(table), :3] = table
            colours[:, 3] = 255
            saved = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            shown = indices[: area.shape[0], : area.shape[1]]
            if transparent is None:
                area[...] = colours[shown]
            else:
                area[shown != transparent] = colours[shown[shown != transparent]]
            yield Frame(number, left, top, delay, disposal, transparent, indices, canvas, w, h)
            number += 1
            if disposal == 2:
                area[...] = 0
            elif saved is not None:
                canvas = saved
            delay, disposal, transparent = 0, 0, None
        else:
            return


FRAME_FIELDS = "frame int, delay_ms int, left int, top int, width int, height int, disposal int, transparent int, indices binary, rgba binary, histogram array<long>, problem string"


def gif_frames(df: DataFrame, id_col: str, gif_col: str) -> DataFrame:
    """A row for each frame of each file: time, place, stored indices, shown pixels and colour histogram."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["frame", "delay_ms", "left", "top", "width", "height", "disposal", "transparent", "indices", "rgba", "histogram", "problem"]
        kinds = [*[pa.int32()] * 8, pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.string()]
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                for f in read_gif(data or b""):
                    shown = (f.canvas.tobytes(), f.histogram()) if f.canvas is not None else (None, None)
                    row = [f.number, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, f.transparent, f.indices.tobytes() if f.indices is not None else None, *shown, f.problem]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([v], k) for v, k in zip(row, kinds))], [id_col, *names])

    return df.select(id_col, gif_col).mapInArrow(decode, f"`{id_col}` {dict(df.dtypes)[id_col]}, {FRAME_FIELDS}")


def _store(text: str | None) -> tuple[bytes, bytes]:
    payload = (text or "").encode()
    return payload, payload + b" " * (-len(payload) % WIDTH if payload else WIDTH)


def text_gifs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, gif: each text as the file that stores it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw, payload = _store(text)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([len(raw)], pa.int64()), pa.array([write_gif(payload)], pa.binary())], ["doc_id", "n_bytes", "gif"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, f"doc_id {dict(df.dtypes)[id_col]}, n_bytes long, gif binary")


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a GIF, decodes the file and describes both; one pass, the files stay in the worker."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                raw, payload = _store(text)
                gif = write_gif(payload)
                counts, samples = np.zeros(64, np.int64), []
                for frame in read_gif(gif):
                    samples.append(frame.indices.tobytes())
                    # a last, shorter frame leaves what was shown below it, so its own area is what is new
                    counts += Frame(0, 0, 0, 0, 0, None, frame.indices, frame.canvas[: frame.indices.shape[0]]).histogram()
                back = b"".join(samples)
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(gif), hashlib.sha256(gif).hexdigest(), ",".join(map(str, counts)))
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(describe, f"doc_id {dict(df.dtypes)[id_col]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(read_table(spark, sf_dir, "documents"))
