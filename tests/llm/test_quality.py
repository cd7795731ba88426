"""Positive-unlabelled quality: sums and risk against brute force, held-out labels, odd input."""

import random
import zlib

import numpy as np
import pytest

from trialgrid.llm import quality as Q


def prose(r, n=60):
    syllables = ["an", "ther", "lo", "mi", "sta", "ren", "do", "ka", "é"]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def junk(r, n=60):
    kind = r.randrange(4)
    if kind == 0:
        return prose(r, n).upper().replace(" ", "!! ")
    if kind == 1:
        return " ".join(r.choice("#$%&*") * 3 + w for w in prose(r, n).split())
    if kind == 2:
        return " | ".join(prose(r, n).split())
    return "click here " * n


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(11)
    rows = [(i, junk(r, r.randint(5, 90)), 0) if r.random() < 0.25 else (i, prose(r, r.randint(5, 90)), 1) for i in range(900)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, x string, score double").repartition(5)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_features_cover_whole_texts():
    assert not Q.text_features(None).any() and not Q.text_features("").any()
    long = prose(random.Random(1), 20_000)
    assert (Q.text_features(long) != Q.text_features(long + " @#$%^" * 4000)).any()
    x = Q.text_features("ab AB\nab")
    assert x.shape == (Q.DIMS,) and 0 <= x.min() and x.max() <= Q.UNIT
    # "ab AB\nab": of seven neighbours two are small letters after small letters
    assert x[0] == round((2 / 7) ** 0.5 * Q.UNIT)
    assert Q.text_features("\ud800 odd").shape == (Q.DIMS,)


def test_sums_against_brute_force(spark, corpus):
    rows, docs, labels = corpus
    features = Q.featured(docs)
    got = Q.moments(features)
    x = np.c_[np.ones(len(rows), int), [Q.text_features(t).astype(int) for _, t, _ in rows]]
    assert (got.astype(int) == x.T @ x).all()
    own = [i for i, _, q in rows if i % 2 and q == 1 and zlib.crc32(str(i).encode()) % 4 != 2]
    assert Q.trusted(features, labels).count() == len(own)
    twice = labels.unionByName(labels.selectExpr("doc_id", "1 - quality AS quality", "toxic").limit(5)).unionByName(labels.limit(7))
    assert len(own) - 5 <= Q.trusted(features, twice).count() <= len(own)


def test_least_risk_against_rows(corpus):
    """No small change of the weights, at the prior given, has a smaller risk over the rows themselves."""
    rows, _, _ = corpus
    x = np.array([Q.text_features(t).astype(float) for _, t, _ in rows])
    good = x[[q == 1 for _, _, q in rows]][:300]
    sums = lambda a: np.c_[np.ones(len(a)), a].T @ np.c_[np.ones(len(a)), a]
    w, b = Q.minimise(sums(x).astype(object), sums(good).astype(object), 0.75)
    scale = x.std(axis=0) + Q.FLOOR * Q.UNIT

    def risk(w, b):
        f, p = x @ w + b, good @ w + b
        negative = ((1 + f) ** 2).mean() / 4 - 0.75 * ((1 + p) ** 2).mean() / 4
        return 0.75 * ((1 - p) ** 2).mean() / 4 + max(0, negative) + (Q.RIDGE + Q.FEW / len(good)) / 2 * (((w * scale) ** 2).sum())

    base = risk(w, b)
    r = np.random.default_rng(2)
    for _ in range(200):
        d = r.normal(size=len(w)) / scale * 1e-2
        # b moves with the weights, so that it is the mean of the margin that stays
        assert risk(w + d, b - x.mean(axis=0) @ d) > base - 1e-6
    assert base < risk(np.zeros(len(w)), 0.0)


def test_prior_from_counts():
    at = np.arange(Q.BINS)
    shape = lambda mid: np.exp(-((at - mid) ** 2) / 200)
    good, bad = shape(300) / shape(300).sum(), shape(100) / shape(100).sum()
    for prior in (0.2, 0.5, 0.9):
        found = Q.class_prior(np.rint(1e6 * (prior * good + (1 - prior) * bad)), np.rint(1e5 * good))
        assert abs(found - prior) < 0.02
        slope, offset = Q.curve(1e6 * (prior * good + (1 - prior) * bad), 1e5 * good, prior)
        middle = 1 / (1 + np.exp(-(slope * np.array([-2.0, 2.0]) + offset)))
        assert middle[0] < 0.05 and middle[1] > 0.95


def test_held_out_labels(corpus):
    rows, docs, labels = corpus
    got = {r["doc_id"]: r for r in Q.score_quality(docs, labels).collect()}
    assert len(got) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    aside = [(got[i]["predicted"], q) for i, _, q in rows if got[i]["held_out"]]
    assert np.mean([p for p, q in aside if q]) > 0.95 and np.mean([p for p, q in aside if not q]) < 0.05


def test_marks_of_bad_rows_and_held_out_rows_teach_nothing(spark, corpus):
    rows, docs, labels = corpus
    one = {r["doc_id"]: r["score"] for r in Q.score_quality(docs, labels).collect()}
    other = labels.where("quality = 1").unionByName(spark.createDataFrame([(i, 1, 0) for i, _, q in rows if not q and zlib.crc32(str(i).encode()) % 4 == 2], "doc_id long, quality int, toxic int"))
    assert {r["doc_id"]: r["score"] for r in Q.score_quality(docs, other).collect()} == one


def test_odd_input(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 1), (5, 1), (7, 0), (7, 1), (9, None), (None, 1), (10, 5)], "doc_id long, quality int")
    out = Q.score_quality(odd_docs, labels).collect()
    assert len(out) == 14 and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 6}) == 1
    none = Q.score_quality(odd_docs, labels.limit(0)).collect()
    assert len(none) == 14 and {r["score"] for r in none} == {0.0}
    assert Q.score_quality(no_docs, labels).count() == 0
