"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides on spans.

Spans that the base patterns accept always stand. Looser patterns give candidates beside them: card-like numbers
that fail the check digit, telephone numbers without a country code, addresses spelled with "at" and "dot", network
addresses with their dots in brackets or of the newer form, and secrets (values given to words such as password or token,
key ids of known forms, private keys), a kind without a base pattern. Labelers look at a candidate's form, at gazetteers of words and top-level domains, and at what stands around it; each votes for,
against, or not at all. Votes of all candidates of all texts are counted by pattern (a table whose size is bounded by the
number of labelers). Expectation-maximisation on the counts estimates how reliable each labeler is, and a logistic
classifier of spans is trained on the patterns, weighted by their counts, with the estimated posteriors as its targets.
Candidates it rates 0.5 or more become spans unless they overlap a base span of their kind.

Places are code points, ends exclusive. Defined results: null text is empty; a null id is kept; repeated rows give
repeated results; long texts are read whole, in time linear in their length; further columns are ignored (redaction
passes them through); an empty table gives an empty result, with a classifier that adds nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize, read_table, sparing

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELERS = ("form", "length", "gazetteer", "domain", "context", "lone", "inside", "neighbours")

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_ip = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)").finditer
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_loose_phone = re.compile(r"(?<![0-9+).])(?<![0-9+] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])").finditer
_loose_email = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{1,63}){1,4}").finditer
_loose_ip = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot )[0-9]{1,3}){3}(?![0-9A-Za-z])").finditer
_new_ip = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){1,7}(?:::)?|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![0-9A-Za-z:])").finditer
_assigned = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|bearer)[\"']?(?: ?[=:] ?| )[\"']?([A-Za-z0-9+/_~-]{8,512})").finditer
_set = re.compile(r"(?i)(?:password|passwd|pwd|secret)[\"']?(?: ?= ?|: ?)[\"']?([A-Za-z+/_~-]{8,512})(?=[\"';,\s]|\Z)").finditer
_key_id = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,251}|sk-[A-Za-z0-9-]{20,200}|xox[abprs]-[A-Za-z0-9-]{10,200}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,2000}\.[A-Za-z0-9_-]{8,1000}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)(?![A-Za-z0-9])").finditer
_secret_word = re.compile(r"(?i)pass|pwd|secret|token|key|bearer").search
_digit = re.compile("[0-9]").search
_word = re.compile(r"[A-Za-z]+").findall

#: Words that announce personal data, by kind.
GAZETTEER = {
    "email": {"email", "mail", "contact", "write", "address", "reach"},
    "ip": {"ip", "host", "server", "address", "client", "from"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "account", "payment", "pay"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "number", "cell"},
    "secret": {"password", "passwd", "pwd", "secret", "token", "key", "bearer", "credential", "credentials", "login", "auth"},
}
#: Words that announce a number of another kind than a network address.
NUMBERED = {"version", "v", "release", "section", "chapter", "figure", "table"}
DOMAINS = {"com", "org", "net", "edu", "gov", "io", "co", "info", "de", "fr", "es", "uk", "eu"}


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2]))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) that the base patterns accept, by kind, then place."""
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _domain(text, at + 1) if start < at else None
        if match:
            out.append((0, start, match.end()))
            end = match.end()
        at = text.find("@", max(at + 1, end))
    if _digit(text):
        out += [(1, m.start(), m.end()) for m in _ip(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
        for m in _card(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _phone(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def candidate_spans(text: str) -> list[tuple[int, int, int]]:
    """Looser matches that base_spans may lack."""
    out = []
    if "dot" in text and "at" in text:
        out += [(0, m.start(), m.end()) for m in _loose_email(text)]
    if _digit(text):
        for m in _card(text):
            if 13 <= sum(c.isdigit() for c in m.group()) <= 19:
                out.append((2, m.start(), m.end()))
        out += [(3, m.start(), m.end()) for m in _loose_phone(text)]
        if "dot" in text or "[.]" in text or "(.)" in text:
            out += [(1, m.start(), m.end()) for m in _loose_ip(text)]
        if ":" in text:
            out += [(1, m.start(), m.end()) for m in _new_ip(text) if _digit(m.group()) and _is_new_ip(m.group())]
        if _secret_word(text):
            out += [(4, m.start(1), m.end(1)) for m in _assigned(text) if _digit(m.group(1))]
    if _secret_word(text):
        out += [(4, m.start(1), m.end(1)) for m in _set(text)]
    if _key_mark(text):
        out += [(4, m.start(), m.end()) for m in _key_id(text)]
    return out


_key_mark = re.compile("AKIA|ASIA|AIza|gh[pousr]_|sk-|xox[abprs]-|eyJ|PRIVATE KEY").search


def _is_new_ip(text: str) -> bool:
    """Eight groups, or fewer with one gap of any length; times of day such as 10:20:30 have neither."""
    left, gap, right = text.partition("::")
    groups = [g for part in (left, right) for g in part.split(":") if part]
    return "" not in groups and (len(groups) < 8 and "::" not in right if gap else len(groups) == 8)


def votes(text: str, span: tuple[int, int, int]) -> tuple[int, ...]:
    """One vote per labeler: 1 for, -1 against, 0 none."""
    kind, start, end = span
    body, left, right = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    digits = "".join(c for c in body if c.isdigit())
    near = {w.lower() for w in _word(left)[-4:]}
    last = re.split(r"[^a-z0-9-]+", body.lower())[-1]
    before, after = left[-1:] or " ", right[:1] or " "
    if kind == 2:
        form = 1 if _luhn(digits) else 0
        length = 1 if len(digits) == 16 else -1 if len(digits) < 15 else 0
    elif kind == 3:
        form = 1 if body[0] in "+(" else 0
        length = 1 if 10 <= len(digits) <= 12 else -1
    elif kind == 1:
        parts = [p for p in re.split("[^0-9A-Fa-f]+", body) if p and p != "d"]  # "dot" leaves its d
        form = 1 if ":" in body else 1 if all(len(p) <= 3 and int(p) <= 255 and (p == "0" or p[0] != "0") for p in parts if p.isdigit()) else -1
        length = -1 if right[:1] == "." and right[1:2].isdigit() or left[-1:] == "." else 1
    elif kind == 4:
        form = 1 if next(_key_id(body), None) or len({c.isdigit() for c in body}) == 2 and len(set(body)) >= 6 else -1
        length = 1 if 12 <= len(body) <= 200 else -1 if len(body) < 10 else 0
    else:
        form = 1 if "@" in body or "(" in body or "[" in body else 0
        length = 1 if 6 <= len(body) <= 60 else -1
    return (
        form,
        length,
        1 if near & GAZETTEER[KINDS[kind]] else -1 if kind == 1 and near & NUMBERED else 0,
        (1 if last in DOMAINS else -1) if kind == 0 else 0,
        1 if re.search(r"[:=]\s*[\"']?\Z", left) else 0,
        1 if before in (" \t\n\"'(=:" if kind == 4 else " \t\n\"'(") and after in " \t\n.,;:!?\"')" else -1,
        -1 if before.isalnum() or after.isalnum() else 0,
        -1 if len(re.findall("[0-9]", left[-12:] + right[:12])) > 6 else 1 if not re.search("[0-9]", left[-12:] + right[:12]) else 0,
    )


@dataclass
class Model:
    weights: np.ndarray  # kinds, then for and against of each labeler
    reliability: dict[str, float]

    def rate(self, kind: int, vote: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-np.clip(_features(kind, vote) @ self.weights, -40, 40))))


def _features(kind: int, vote: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(KINDS) + 2 * len(LABELERS))
    out[kind] = 1
    for i, v in enumerate(vote):
        if v:
            out[len(KINDS) + 2 * i + (v < 0)] = 1
    return out


def estimate(counts: dict[tuple[int, tuple[int, ...]], int], rounds: int = 100) -> Model:
    """Reliabilities by expectation-maximisation on vote patterns, then the classifier on the posteriors."""
    if not counts:
        return Model(np.concatenate((np.full(len(KINDS), -40.0), np.zeros(2 * len(LABELERS)))), {})
    keys = sorted(counts)
    kind = np.array([k for k, _ in keys])
    vote = np.array([v for _, v in keys])
    n = np.array([counts[k] for k in keys], float)
    posterior = np.clip(0.5 + 0.12 * vote.sum(axis=1), 0.05, 0.95)
    prior = np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        # P(vote | class) for each labeler and class, smoothed; a labeler is taken to be better than chance
        like = np.zeros((2, len(LABELERS), 3))
        for c, p in enumerate((1 - posterior, posterior)):
            for v in (-1, 0, 1):
                like[c, :, v + 1] = ((vote == v) * (n * p)[:, None]).sum(axis=0) + (2.0 if v == 2 * c - 1 else 1.0)
            like[c] /= like[c].sum(axis=1, keepdims=True)
        for v, order in ((2, 1), (0, -1)):  # no vote speaks against what it says
            wrong = order * (like[1, :, v] - like[0, :, v]) < 0
            like[:, wrong, v] = like[:, wrong, v].mean(axis=0)
        like[:, :, 1] = like[:, :, 1].mean(axis=0)  # and silence says nothing
        for k in range(len(KINDS)):
            own = kind == k
            prior[k] = min(max(((n * posterior)[own].sum() + 1) / (n[own].sum() + 2), 0.2), 0.8)
        logit = np.log(prior[kind] / (1 - prior[kind]))
        for j in range(len(LABELERS)):
            logit = logit + np.log(like[1, j, vote[:, j] + 1] / like[0, j, vote[:, j] + 1])
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    x = np.array([_features(k, v) for k, v in keys])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - posterior)) + 0.1 * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    right = [float((n * np.where(vote[:, j] > 0, posterior, np.where(vote[:, j] < 0, 1 - posterior, 0))).sum() / max(1e-9, (n * (vote[:, j] != 0)).sum())) for j in range(len(LABELERS))]
    return Model(w, dict(zip(LABELERS, right)))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (array of [kind, start, end]), loose (the same, of candidates beside the base), votes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, looses, given = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                loose = _beside(base, candidate_spans(text))
                bases.append(base)
                looses.append(loose)
                given.append([list(votes(text, s)) for s in [*base, *loose]])
            spans = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([[list(s) for s in x] for x in v], spans) for v in (bases, looses, given))], ["doc_id", "base", "loose", "votes"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(sparing("pii", find), f"doc_id {dict(df.dtypes)[id_col]}, base array<array<int>>, loose array<array<int>>, votes array<array<int>>")


def _beside(base: list, loose: list) -> list[tuple[int, int, int]]:
    """Loose spans that overlap no base span and no earlier loose one of their kind, and lie within no base span or earlier one of another kind.

    Kinds are taken in turn. Spans of a kind don't overlap each other, so each list is in order of both ends and a loose span is held against one or two of each."""
    out: list[tuple[int, int, int]] = []
    taken: dict[int, list[tuple[int, int]]] = {}
    for k, a, b in base:
        taken.setdefault(k, []).append((a, b))
    for k in taken:
        taken[k].sort()
    by_kind: dict[int, list[tuple[int, int]]] = {}
    for k, a, b in sorted(loose, key=lambda s: (s[0], s[1], -s[2])):  # of two from one place the longer one
        by_kind.setdefault(k, []).append((a, b))
    for k, spans in by_kind.items():
        own, others, end, new = taken.get(k, []), [v for kk, v in taken.items() if kk != k], -1, []
        for a, b in spans:
            i = bisect_right(own, (a, b))
            if a < end or i and own[i - 1][1] > a or i < len(own) and own[i][0] < b:
                continue
            # a national number inside an international one, a card inside a telephone number: not their own
            if any((j := bisect_right(v, (a, _FAR))) and v[j - 1][1] >= b for v in others):
                continue
            new.append((a, b))
            out.append((k, a, b))
            end = b
        taken[k] = sorted([*own, *new])
    return out


_FAR = 1 << 60


def learn(scanned: DataFrame) -> Model:
    """The model from the vote patterns of every text."""
    spans = F.concat("base", "loose")
    pairs = scanned.select(F.explode(F.arrays_zip(F.transform(spans, lambda s: s[0]).alias("kind"), F.col("votes").alias("vote"))).alias("x"))
    counts = pairs.groupBy("x.kind", "x.vote").agg(F.count("*").alias("n"))
    return estimate({(r["kind"], tuple(r["vote"])): r["n"] for r in counts.collect()})  # at most kinds x 3^labelers rows


def _decided(base: list, loose: list, vote: list, model: Model) -> list[tuple[int, int, int]]:
    rated = vote[len(vote) - len(loose) :] if loose else []
    return sorted([tuple(s) for s in base] + [tuple(s) for s, v in zip(loose, rated) if model.rate(s[0], tuple(v)) >= 0.5])


def _shown(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added (spans beside those of the base)."""
    scanned = materialize(scan(df, id_col, text_col), "spans")
    model = learn(scanned)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, shown, added = [[] for _ in BASE_KINDS], [], [], []
            for base, loose, vote in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                for k, column in enumerate(counts):
                    column.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(_shown(sorted(map(tuple, base))).encode()).hexdigest())
                spans = _decided(base, loose, vote, model)
                shown.append(_shown(spans))
                added.append(len(spans) - len(base))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(shown, pa.string()), pa.array(added, pa.int64())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"])

    return scanned.mapInArrow(sparing("pii", decide), f"doc_id {dict(df.dtypes)[id_col]}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with each span of personal data replaced by its kind in angle brackets."""
    model = learn(scan(df, id_col, text_col))
    names = df.columns

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(text_col).to_pylist():
                if text:
                    base = base_spans(text)
                    loose = _beside(base, candidate_spans(text))
                    parts, end = [], 0
                    for k, a, b in sorted(_decided(base, loose, [votes(text, s) for s in loose], model), key=lambda s: (s[1], -s[2])):
                        if a >= end:
                            parts += [text[end:a], f"<{KINDS[k]}>"]
                        end = max(end, b)
                    text = "".join([*parts, text[end:]]) if parts else text
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(sparing("pii", replace), df.schema)


def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read_table(spark, sf_dir, "documents"))
