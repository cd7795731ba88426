"""Exact byte-pair encoding by per-prefix dynamic programming, and decoding.

Every prefix of a piece has exactly one token that ends its encoding. An automaton over the vocabulary gives the
tokens that end at each position; a token is the last one of a prefix when it may follow the last token of what
is before it, that is when merging could never have joined the two differently (`Vocabulary.compatible`).
Following the stored tokens back from the end gives the ids that applying merges in rank order would give, in
time linear in the piece and without a merge loop.

Texts are cut into pieces as the byte-level pre-tokenizer does. As pieces never cross a single space that stands
between two other characters, the words between such spaces are encoded once per worker and kept in a table of
bounded size. Each worker streams Arrow batches; nothing is shuffled and no group is gathered.

Defined results: null text is the empty text: no tokens, digests of the empty string. The file's special tokens in
a text become their ids, as the tokenizers library has it by default. Very long texts need memory for their own
ids only. Repeated rows give repeated results; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read_table

#: Fixed value: the byte-level pre-tokenizer's pattern.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_TABLE, PIECE_TABLE = 500_000, 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens as bytes, the pair each was merged from, and the tables the dynamic programme needs."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_alphabet()
        self.tokens = [b""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", ()))]))
        for token, i in model["vocab"].items():
            self.tokens[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.pattern = regex.compile(PIECE_PATTERN)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: rank of a merge by the pair it joins; parts and rank of a token by its id
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.result: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (model["vocab"][x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = model["vocab"][self._text(left, model) + self._text(right, model)]
            self.merged[left, right] = rank
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), rank
        #: tokens that encode to themselves
        self.own: set[int] = set()
        self.memo: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}
        for i in sorted(model["vocab"].values(), key=lambda i: self.rank.get(i, -1)):
            parts = self.parts.get(i)
            if parts is None:
                if len(self.tokens[i]) == 1:
                    self.own.add(i)
            elif parts[0] in self.own and parts[1] in self.own and self._apart(*parts, self.rank[i]):
                self.own.add(i)
        self.automaton = ahocorasick.Automaton()
        for i in self.own:
            self.automaton.add_word(self.tokens[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.lengths = [len(t) for t in self.tokens]
        #: each id's decimal form, and its bytes, special tokens included
        self.shown = [str(i) for i in range(len(self.tokens))]
        self.spelled = list(self.tokens)
        for content, i in self.special.items():
            self.spelled[i : i + 1] = [content.encode()]

    def _text(self, i: int, model: dict, names: dict = {}) -> str:  # noqa: B006
        if id(model) not in names:
            names.clear()
            names[id(model)] = {v: k for k, v in model["vocab"].items()}
        return names[id(model)][i]

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Whether merges of a rank below limit leave the border between the two tokens where it is.

        The last merges made on the two sides are undone, latest first; a merge across the border that ranks
        before all that has been undone so far would have come first and would have removed the border.
        """
        merged, rank, parts = self.merged, self.rank, self.parts
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            # on a tie of ranks (one token on both sides) merging goes from the left, so the right side is undone first
            if a > b:
                limit, left = a, parts[left][1]
            else:
                limit, right = b + 1, parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        """Whether right may follow left."""
        key = left << 20 | right
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= 1_000_000:
                self.memo.clear()
            known = self.memo[key] = self._apart(left, right, len(self.merged) + 1)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        n, lengths, memo = len(piece), self.lengths, self.memo
        last = [-1] * (n + 1)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - lengths[token]
                if start == 0:
                    last[end] = token
                else:
                    before = last[start]
                    if before >= 0:
                        fits = memo.get(before << 20 | token)
                        if fits if fits is not None else self.compatible(before, token):
                            last[end] = token
        token = last[n]
        if lengths[token] == n:
            return [token]
        ids, at = [], n
        while at:
            token = last[at]
            ids.append(token)
            at -= lengths[token]
        ids.reverse()
        return ids

    def encode_plain(self, text: str) -> list[int]:
        out: list[int] = []
        pieces = self.pieces
        for piece in self.pattern.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                if len(pieces) >= PIECE_TABLE:
                    pieces.clear()
                ids = pieces[piece] = self.encode_piece(piece.encode())
            out += ids
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.spelled[i] for i in ids])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_two_spaces = re.compile(r"\s\s").search
_lone_space = re.compile(r"(?<=\S) (?=\S)").split


class Encoder:
    """Whole texts through a table of words. The table has two halves: words met since the last turn, and those from
    before it that have not been met again; a full half makes the other one go."""

    def __init__(self, path: str, table: int = WORD_TABLE):
        self.vocab, self.table = vocabulary(path), table
        self.words: dict[str, tuple[str, bytes, int]] = {}
        self.older: dict[str, tuple[str, bytes, int]] = {}

    def _entry(self, text: str) -> tuple[str, bytes, int]:
        vocab = self.vocab
        ids = vocab.encode_plain(text)
        return ",".join([vocab.shown[i] for i in ids]), vocab.decode_bytes(ids), len(ids)

    def parts(self, text: str) -> list[tuple[str, bytes, int]]:
        """(ids as decimals, decoded bytes, count) of consecutive stretches of text."""
        special = self.vocab.special_pattern
        if special is None or not special.search(text):
            return self._words(text)
        out: list[tuple[str, bytes, int]] = []
        for bit in special.split(text):
            if bit in self.vocab.special:
                i = self.vocab.special[bit]
                out.append((str(i), self.vocab.decode_bytes([i]), 1))
            elif bit:
                out += self._words(bit)
        return out

    def _words(self, text: str) -> list[tuple[str, bytes, int]]:
        if not text:
            return []
        words = _lone_space(text) if text[0] == " " or text[-1] == " " or _two_spaces(text) else text.split(" ")
        out, known = [self._entry(words[0])], self.words
        try:
            out += [known[w] for w in words[1:]]
        except KeyError:
            older = self.older
            for w in words[1:]:
                if w not in known:
                    known[w] = older[w] if w in older else self._entry(f" {w}")
            del out[1:]
            out += [known[w] for w in words[1:]]
            if len(known) > self.table:
                self.words, self.older = {}, known
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _, _ in self.parts(text or "") for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        return self.vocab.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker's encoder, kept from one task to the next."""
    return Encoder(path)


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """doc_id, ids (array<int>), decoded; or with digest_only doc_id, n_tokens and the digests of both."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids, decoded, n = zip(*parts) if (parts := own.parts(text or "")) else ((), (), ())
                counts.append(sum(n))
                ids_sha.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(b"".join(decoded).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            ids = [own.encode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if digest_only:
        return rows.mapInArrow(digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return rows.mapInArrow(whole, f"doc_id {kind}, ids array<int>, decoded string")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest_only=True)
