"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks, over sentences.

The kernel of two strings sums over all common subsequences of ORDER letters, each weighted by DECAY to the power of the
stretches it spans, so gaps and inserted letters cost a little and do not break a match; it is normalised, and its DEGREE-th
power, a kernel as well, is taken, and less than LEAST counts as 0, so that many weak matches don't add up to a strong one. A
word's kernel with a landmark is
the greatest over the word's windows of the landmark's length and of up to GAP letters more, where one is 0 if the longest
common subsequence of the two holds less than SHARE of the landmark; a sentence's kernel is the greatest of its words'. With K
the kernel among landmarks, a sentence's features are K^(-1/2) times its kernels with the landmarks, and a linear machine with
squared hinge loss works on them. A text is as toxic as its worst sentence.

Landmarks are strings of LENGTHS letters that stand in words of toxic training rows and tell them from the others by more than
chance: the one that tells most is taken, the words that hold it are put aside, and so on until what is left tells nothing; so
stems with any endings are found as well as words. The machine is trained on sentences: all of clean rows are negative, and of each toxic row the worst one, chosen
anew in each round, is positive, together with copies of the landmarks that have a letter put in. Three quarters of the rows choose landmarks and train;
a logistic curve through the margins of the other quarter, its classes weighted by their counts among all labelled rows, makes
scores of margins; what has nothing suspicious gets the rate at which such rows are toxic there.

Words are tokens between white space, in lower case and without all but letters and digits, so that marks between letters
vanish; runs of single characters are also read as one word; words of more than LETTERS letters are read in windows of so many
that overlap by half, so a landmark over a border lies whole in the next window. Kernels are found once per worker and word.
Only fitting uses a sample: the first `max_rows` labelled rows of each class in order of a hash of their id, of texts of at most
MAX_CHARS characters. Every text is scored whole.

Defined results: null and empty texts have no words and the score of a row without a suspicious word; a null id is not
held out; rows without a label, or with one other than 0 and 1, train nothing; rows that repeat an id or a text train again; where the training
rows lack one of the classes all scores are 0; repeated rows get equal scores; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import kept_in_worker, read_table, sparing

ORDER, DECAY, DEGREE, SHARE, LEAST, GAP = 3, 0.7, 3, 0.75, 0.1, 2
LENGTHS, LETTERS = range(4, 9), 24
MAX_ROWS, MAX_CHARS = 2000, 50_000
WORD_TABLE = 250_000
THRESHOLD = 0.7

_spelled = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)").findall
_sentences = re.compile(r"[.!?]+\s+|\n+").split


def windows(token: str) -> list[str]:
    """The words to score for a token: its letters and digits, in overlapping windows if they are many."""
    word = token if token.isalnum() else "".join(filter(str.isalnum, token))
    if len(word) < ORDER:
        return []
    if len(word) <= LETTERS:
        return [word]
    return [word[i : i + LETTERS] for i in range(0, len(word) - LETTERS // 2, LETTERS // 2)]


def tokens(text: str | None) -> set[str]:
    text = (text or "").lower()
    found = set(text.split())
    found.update(_spelled(text))
    return found


def _coded(words: list[str], size: int) -> np.ndarray:
    """Code points in rows, padded with 0."""
    out = np.zeros((len(words), size), np.int32)
    flat = np.frombuffer("".join(w.ljust(size, "\0") for w in words).encode("utf-32-le"), np.int32)
    out[...] = flat.reshape(len(words), size)
    return out


def common_subsequence(words: np.ndarray, landmark: np.ndarray, alphabet: int = 256) -> np.ndarray:
    """Lengths of the longest common subsequences of words (rows of small codes) and one landmark, bit-parallel; code 0 matches nothing."""
    m = len(landmark)
    ones = np.uint32((1 << m) - 1)
    places = np.zeros(alphabet, np.uint32)
    for j, c in enumerate(landmark):
        if c:
            places[c] |= np.uint32(1 << j)
    v = np.full(len(words), ones, np.uint32)
    for column in words.T:
        u = v & places[column]
        v = (v + u) | (v - u)
    return m - np.bitwise_count(v & ones).astype(np.int64)


def subsequence_kernel(words: np.ndarray, other: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Unnormalised kernel of each word (row, padded with 0) with other: one string, or a row of its own for each."""
    other = np.broadcast_to(other, (len(words), other.shape[-1]))
    b, m = other.shape
    real = other != 0
    prefix = [np.ones((b, m + 1)), *(np.zeros((b, m + 1)) for _ in range(order - 1))]  # K'_i(s so far, t[:j])
    total = np.zeros(b)
    for column in words.T:
        same = (column[:, None] == other) & real
        total += decay**2 * (same * prefix[order - 1][:, :m]).sum(axis=1)
        for i in range(order - 1, 0, -1):
            inner = np.zeros((b, m + 1))
            gain = decay**2 * same * prefix[i - 1][:, :m]
            for j in range(m):
                inner[:, j + 1] = decay * inner[:, j] + gain[:, j]
            prefix[i] = decay * prefix[i] + inner
    return total


def _self_kernel(words: np.ndarray) -> np.ndarray:
    return subsequence_kernel(words, words)


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # on normalised kernels: K^(-1/2) is folded in
    bias: float
    floor: float  # the score of what has no suspicious word
    slope: float
    offset: float

    def kernels(self, words: list[str]) -> np.ndarray:
        """Normalised kernels of words with the landmarks; 0 where they aren't near."""
        out = np.zeros((len(words), len(self.landmarks)))
        if not words:
            return out
        coded = _coded(words, LETTERS)
        letters = sorted({ord(c) for w in self.landmarks for c in w})
        table = np.zeros(0x110000, np.uint8 if len(letters) < 256 else np.uint16 if len(letters) < 65536 else np.int32)
        table[letters] = np.arange(1, len(letters) + 1)
        small, lengths = table[coded], np.array([len(w) for w in words])
        for k, z in enumerate(self.landmarks):
            codes = table[_coded([z], len(z))[0]]
            least = max(ORDER, math.ceil(SHARE * len(z)))
            for width in (8, 16, LETTERS):
                rows = np.flatnonzero((lengths <= width) & (lengths > {8: 0, 16: 8, LETTERS: 16}[width]))
                rows = rows[common_subsequence(small[rows, :width], codes, len(letters) + 1) >= least]
                if len(rows):
                    out[rows, k] = _windowed(coded[rows, :width], lengths[rows], z, small[rows, :width], lambda part: common_subsequence(part, codes, len(letters) + 1) >= least)
        return out

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))) if margin > self.bias else self.floor


def _windowed(coded: np.ndarray, lengths: np.ndarray, landmark: str, small: np.ndarray, near: Callable) -> np.ndarray:
    """Greatest kernel of each word's windows with a landmark; small are the words as `near` takes them."""
    z = _coded([landmark], len(landmark))[0]
    padded, small = (np.pad(x, ((0, 0), (0, len(z) + GAP))) for x in (coded, small))
    out = np.zeros(len(coded))
    # a window that is the landmark has a kernel of 1, and no other is greater
    whole = np.zeros(len(coded), bool)
    for at in range(coded.shape[1] - len(z) + 1):
        whole |= (padded[:, at : at + len(z)] == z).all(axis=1)
    out[whole] = 1
    rest = np.flatnonzero(~whole)
    for width in range(len(z) + 1, len(z) + GAP + 1) if len(rest) else ():
        n = np.maximum(lengths[rest] - width, 0) + 1
        first = np.concatenate(([0], np.cumsum(n)))
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(first[-1]) - first[row]
        cut = rest[row][:, None], at[:, None] + np.arange(width)
        like = np.flatnonzero(near(small[cut]))
        part = padded[cut][like]
        value = np.zeros(len(row))
        value[like] = subsequence_kernel(part, z) / np.sqrt(np.maximum(_self_kernel(part), 1e-300) * _self_kernel(z[None, :])[0])
        value = np.maximum.reduceat(value, first[:-1]) ** DEGREE
        out[rest] = np.maximum(out[rest], np.where(value >= LEAST, value, 0))
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, turns: int = 50) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, by Newton's steps; x has a constant column."""
    w = np.zeros(x.shape[1])
    for _ in range(turns):
        slack = 1 - y * (x @ w)
        on = slack > 0
        part = x[on] * cost[on, None]
        new = np.linalg.solve(part.T @ x[on] + np.eye(len(w)), part.T @ y[on])
        if np.abs(new - w).max() < 1e-9:
            break
        w = (w + new) / 2 if _ > 20 else new
    return w


def _tail(k: int, n: int, p: float) -> float:
    """Probability of k or more of n at a rate p."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    return math.fsum(map(math.exp, logs))


def _with_insertions(word: str) -> list[str]:
    """The word with one letter put in at each inner place: the one before it, or one that is no part of the word."""
    other = next((c for c in "xqzjkv" if c not in word), "0")
    return sorted({word[:i] + c + word[i:] for i in range(1, len(word)) for c in (word[i - 1], other)})


def _copies_joined(words: list[list[str]], y: np.ndarray) -> list[tuple[list[str], int]]:
    """Words, sorted like those of rows, and label of each class of rows that share the four smallest of three hashes of their words."""
    label = list(range(len(words)))

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    seen: dict[tuple, int] = {}
    for i, own in enumerate(words):
        codes = [w.encode() for w in own]
        for seed in range(3) if len(own) >= 12 else ():
            first = seen.setdefault((int(y[i]), seed, *sorted(zlib.crc32(c, seed * 7919) for c in codes)[:4]), i)
            a, b = sorted((root(i), root(first)))
            label[b] = a
    out: dict[int, list[int]] = {}
    for i in range(len(words)):
        out.setdefault(root(i), []).append(i)
    return [(words[i] if len(rows) == 1 else sorted({w for k in rows for w in words[k]}), int(y[i])) for i, rows in out.items()]


def _logistic(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's steps, slightly shrunk."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = weight * (p - label), weight * p * (1 - p) + 1e-9
        g = np.array([(d * margin).sum() + 1e-2 * a, d.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-2, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def _words_of(text: str | None) -> set[str]:
    return {w for t in tokens(text) for w in windows(t)}


def _substrings(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word, start and length as one number) of all substrings of words of LENGTHS letters."""
    size = np.array([len(w) for w in words], np.int64)
    text = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size + 1)
    hashes, at, spans = [], [], []
    with np.errstate(over="ignore"):
        for length in LENGTHS:
            n = len(text) - length + 1
            if n <= 0:
                continue
            h, whole = np.full(n, length, np.uint64), np.ones(n, bool)
            for i in range(length):
                h = (h ^ text[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                whole &= text[i : i + n] != 0
            hashes.append(h[whole])
            at.append(word[:n][whole])
            spans.append(np.flatnonzero(whole) * 16 + length)
    none = np.zeros(0, np.int64)
    return np.concatenate([none.astype(np.uint64), *hashes]), np.concatenate([none, *at]), np.concatenate([none, *spans])


def _landmarks(words: list[list[str]], y: np.ndarray) -> list[str]:
    """Strings that tell toxic rows by more than chance, each from words that hold none before it."""
    alone = _copies_joined(words, y)  # rows that are near copies are no further evidence
    toxic, clean = [own for own, label in alone if label], [own for own, label in alone if not label]
    n1, n0 = len(toxic), len(clean)

    def counted(rows: list[list[str]], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        sums = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for at in range(0, len(rows), 200):  # some rows at a time
            each = [np.unique(_substrings(own)[0]) for own in rows[at : at + 200]]
            if known is not None:
                each = [e[np.isin(e, known, assume_unique=True)] for e in each]
            h, n = np.unique(np.concatenate([sums[0], *each]), return_inverse=True)
            total = np.bincount(n, weights=np.concatenate([sums[1], *(np.ones(len(e)) for e in each)]), minlength=len(h))
            sums = (h, total.astype(np.int64))
        return sums

    h, t = counted(toxic)
    tried = len(h)
    h, t = h[t >= 3], t[t >= 3]
    c = np.zeros(len(h), np.int64)
    found, n = counted(clean, h)
    c[np.searchsorted(h, found)] = n
    rate = n1 / (n1 + n0)

    def telling(t: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Far more often in toxic rows than in clean ones, and so by a chance that is rare even among so many strings."""
        ok = (t >= 3) & (t * n0 > 10 * c * n1)
        for i in np.flatnonzero(ok):
            ok[i] = _tail(int(t[i]), int(t[i] + c[i]), rate) * 10 * tried < 1
        return ok

    ok = telling(t, c)
    h, c = h[ok], c[ok]
    rows, held, names, strings = [], [], [], {}
    place: dict[str, int] = {}
    for i, own in enumerate(toxic):
        code, word, span = _substrings(own)
        hit = np.isin(code, h)
        text = "\0".join([*own, ""])
        for k, w, s in zip(np.searchsorted(h, code[hit]).tolist(), word[hit].tolist(), span[hit].tolist()):
            strings.setdefault(k, text[s // 16 : s // 16 + s % 16])
            rows.append(i)
            held.append(k)
            names.append(place.setdefault(own[w], len(place)))
    rows, held, names = np.array(rows, np.int64), np.array(held, np.int64), np.array(names, np.int64)
    out: list[str] = []
    while len(rows):
        t = np.bincount(np.unique(rows * len(h) + held) % len(h), minlength=len(h))
        deviation = np.where(t > 0, (t / n1 - c / n0) / np.sqrt((t + c) * (1 - (t + c) / (n1 + n0)) + 1), -np.inf)
        best = sorted(np.flatnonzero(deviation >= deviation.max() - 1e-12).tolist(), key=lambda k: (-len(strings[k]), strings[k]))[0]
        if not telling(t[[best]], c[[best]])[0]:
            # what tells most is no longer telling: nor is anything that is rarer
            t[best] = 0
            rest = np.flatnonzero(telling(t, c))
            if not len(rest):
                break
            best = min(rest.tolist(), key=lambda k: (-deviation[k], -len(strings[k]), strings[k]))
        out.append(strings[best])
        gone = np.isin(names, names[held == best])
        rows, held, names = rows[~gone], held[~gone], names[~gone]
    return out


def _sentence_kernels(model: Model, texts: list[str | None]) -> list[np.ndarray]:
    """For each text the kernels of its sentences with a word near a landmark."""
    near = _near_words(model, {t for text in texts for t in tokens(text)})
    return [_of_sentences(text, near)[0] for text in texts]


def _near_words(model: Model, new: set[str]) -> dict[str, np.ndarray]:
    """Kernels of the tokens that are near a suspicious landmark."""
    out: dict[str, np.ndarray] = {}
    parts = [(w, t) for t in sorted(new) for w in windows(t)]
    for at in range(0, len(parts), 20_000):
        some = parts[at : at + 20_000]
        values = model.kernels([w for w, _ in some])
        for i in np.flatnonzero(values.any(axis=1)).tolist():
            t = some[i][1]
            out[t] = np.maximum(out[t], values[i]) if t in out else values[i]
    return out


def _of_sentences(text: str | None, near: dict[str, np.ndarray]) -> tuple[np.ndarray, list[str]]:
    rows, words = [], []
    for sentence in _sentences(text or ""):
        own = sorted(t for t in tokens(sentence) if t in near)
        if own:
            rows.append(np.max([near[t] for t in own], axis=0))
            words.append(" ".join(own))
    return np.array(rows), words


def fit(rows: list[tuple[str | None, int]], totals: dict[int, int] | None = None) -> Model:
    """rows: a labelled row's text and its label; totals: how many rows of each label there are in all."""
    rows = sorted(rows, key=lambda r: (r[1], r[0] or ""))
    y = np.array([label for _, label in rows])
    empty = Model([], np.zeros(0), 0.0, 0.0, 0.0, -40.0)
    aside = np.arange(len(rows)) % 4 == 3  # for the curve
    if not len(rows) or y.min() == y.max() or len(set(y[~aside].tolist())) < 2:
        return empty
    texts = [text for text, _ in rows]
    same: dict[str, str] = {}
    words = [sorted(same.setdefault(w, w) for w in _words_of(text)) for text in texts]  # a word that many rows have is held once
    use = np.flatnonzero(~aside).tolist()
    chosen = _landmarks([words[i] for i in use], y[use])
    if not chosen:
        return empty
    model = Model(chosen, np.zeros(len(chosen)), 0.0, 0.0, 1.0, 0.0)
    gram = model.kernels(chosen)
    value, vector = np.linalg.eigh((gram + gram.T) / 2 + 1e-6 * np.eye(len(gram)))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T

    def features(kernels: np.ndarray) -> np.ndarray:
        return np.hstack([kernels.reshape(-1, len(chosen)) @ root, np.ones((len(kernels), 1))])

    each = [features(k) for k in _sentence_kernels(model, texts)]
    none = features(np.zeros((1, len(chosen))))
    clean = {w for i in use if not y[i] for w in words[i]}
    gapped = sorted({v for w in chosen for v in _with_insertions(w)} - clean)
    spelled = features(model.kernels(gapped))
    negative = np.vstack([none, *(each[i] for i in use if not y[i])])
    weight = np.concatenate(([max(1.0, float((y[use] == 0).sum()))], np.ones(len(negative) - 1)))
    rating = np.concatenate((root @ np.ones(len(chosen)), [0.0]))
    for _ in range(3):
        worst = [each[i][np.argmax(each[i] @ rating)] for i in use if y[i] and len(each[i])]
        positive = np.vstack([*worst, spelled])
        share = np.concatenate((np.ones(len(worst)), np.full(len(spelled), max(1.0, len(worst)) / max(1, len(spelled)))))
        data, sign = np.vstack([positive, negative]), np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
        rating = _svm(data, sign, np.concatenate((share, weight)))
    model.weights, model.bias = root @ rating[:-1], float(rating[-1])
    kept = np.flatnonzero(aside).tolist()
    share = {label: (totals or {}).get(label, int((y == label).sum())) / int((y == label).sum()) for label in (0, 1)}
    weight = np.array([share[label] for label in y[kept].tolist()])
    margin = np.array([max([model.bias, *(each[i] @ rating)]) for i in kept])
    told = margin > model.bias
    model.slope, model.offset = _logistic(np.r_[margin[told], spelled @ rating], np.r_[y[kept][told], np.ones(len(spelled))], np.r_[weight[told], np.full(len(spelled), 1 / max(1, len(spelled)))])
    model.floor = float((weight * y[kept])[~told].sum() / (weight[~told].sum() + 1))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """A model from at most max_rows labelled rows of each class that are not held out, of texts of at most max_chars characters."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= max_chars)
    own = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1)).where(~held_out(F.col("doc_id"))).distinct()
    totals = {int(r["toxic"]): r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    picked = [own.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for label in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 x max_rows ids: the texts stay where they are
    return _fit_in_task(texts.join(sample, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), totals)


def _fit_in_task(rows: DataFrame, totals: dict[int, int]) -> Model:
    """fit, for rows (text, toxic) of train, in one task: the driver holds the model only, not the texts and their words."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(found, totals))], pa.binary())], ["model"])

    made = rows.repartition(1).mapInArrow(sparing("toxicity", learn), "model binary").collect()  # a row
    return pickle.loads(made[0]["model"]) if made else fit([], totals)


def _word_table(model: str) -> tuple[set[str], dict[str, np.ndarray]]:
    """Words that a worker has met with a model, and the kernels of those near a landmark, kept from one task to the next."""
    return kept_in_worker("toxicity", model, lambda: (set(), {}))


def rate_texts(model: Model, texts: list[str | None]) -> tuple[list[float], list[str | None]]:
    """Score of each text, and the suspicious words of its worst sentence; words that were met before are looked up."""
    met, near = _word_table(repr(model.landmarks))
    floor = model.score(model.bias)
    best: list[float] = []
    worst: list[str | None] = []
    new: set[str] = set()
    waiting: list[tuple[str | None, set[str]]] = []

    def settle() -> None:
        near.update(_near_words(model, new))
        met.update(new)
        suspicious = set(near)
        for text, own in waiting:
            rows, words = _of_sentences(text, near) if not suspicious.isdisjoint(own) else ((), ())
            margins = rows @ model.weights + model.bias if len(rows) else np.zeros(0)
            top = int(margins.argmax()) if len(margins) and margins.max() > model.bias else None
            best.append(floor if top is None else model.score(margins[top]))
            worst.append(None if top is None else words[top])
        new.clear()
        waiting.clear()
        if len(met) > WORD_TABLE:
            met.clear()
            near.clear()

    for text in texts:
        own = tokens(text)
        new.update(own - met)
        waiting.append((text, own))
        if len(new) > 30_000 or len(waiting) > 1_000:
            settle()
    settle()
    return best, worst


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, worst (the words of the worst sentence that are near a landmark; null if none raise the score)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # words and weights from a sample of bounded size

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, worst = rate_texts(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(best, pa.float64()), pa.array([int(s >= threshold) for s in best], pa.int32()), pa.array(worst, pa.string())], ["doc_id", "held_out", "score", "predicted", "worst"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(sparing("toxicity", rate), f"doc_id {dict(df.dtypes)[id_col]}, held_out boolean, score double, predicted int, worst string")


def filter_clean(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df without the rows that are predicted toxic, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = rate_texts(shared.value, batch.column(text_col).to_pylist())[0]
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return df.mapInArrow(sparing("toxicity", keep), df.schema)


def op9_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, model).drop("worst")
