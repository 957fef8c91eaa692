"""op4_toxicity on a small table against a plain form of its features, their choice, the likelihood and the score."""

import math
from collections import Counter

import numpy as np
import pytest

from noveltide.llm import toxicity
from noveltide.llm.queries import op4_toxicity


def plain_features(text):
    words = {w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in (text or "").encode().lower().split()} - {b""}
    out = {b"w" + w for w in words}
    for k in (4, 5, 6, 7, 8):
        for stem in {w[:k] for w in words if len(w) > k}:
            sharing = sum(len(w) > k and w[:k] == stem for w in words)
            out |= {b"%d" % n + stem for n in (2, 4) if sharing >= n}
    return out


def log_likelihood(bags, grades, columns, weights, thetas):
    total = -0.5 * float((weights**2).sum())
    for f, g in zip(bags, grades, strict=True):
        eta = sum(weights[columns[x]] for x in f if x in columns)
        above = [1.0, *(1 / (1 + math.exp(-(eta - t))) for t in thetas), 0.0]
        total += math.log(max(above[g] - above[g + 1], 1e-9))
    return total


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    common = [f"word{k}" for k in range(60)] + ["Plain,", "(text)", "naïve", "漢字"]
    docs, labels = [], []
    for i in range(420):
        grade = int(rng.choice(3, p=[0.7, 0.2, 0.1]))
        said = list(rng.choice(common, int(rng.integers(5, 40))))
        if grade and rng.random() < 0.9:
            said += list(rng.choice(["Vilestuff!", "vilethings", "vilepeople...", "grimword"], grade * 2))
        docs.append((i, " ".join(rng.permutation(said))))
        if i < 350:
            labels.append((i, 0 if grade == 2 else 2, int(grade > 0)))
    docs += [(900, None), (901, ""), (None, "vilestuff grimword"), (7, docs[7][1]), (902, "clean vilestuff " + "padding " * 40_000)]
    labels += [(7, 2, 0), (8, None, None), (None, 0, 1), (5000, 0, 1)]
    folder = f"file://{tmp_path_factory.mktemp('op4')}"
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    grade_of = {}
    for i, q, t in labels:
        if i is not None and t is not None:
            grade_of[i] = max(grade_of.get(i, 0), 0 if not t else 2 if q == 0 else 1)
    return folder, docs, grade_of


@pytest.fixture(scope="module")
def model(spark, table):
    read = lambda name: spark.read.parquet(f"{table[0]}/{name}.parquet")
    return toxicity.fit(read("documents"), read("labels"))


def labelled(table):
    _, docs, grade_of = table
    rows = {i: t for i, t in docs if i in grade_of}  # repeats have one text
    return [plain_features(rows[i]) for i in sorted(rows)], [grade_of[i] for i in sorted(rows)]


def test_features_are_chosen_by_their_gain(table, model):
    bags, grades = labelled(table)
    n, k = Counter(), Counter()
    for f, g in zip(bags, grades, strict=True):
        n.update(f)
        k.update(f if g else ())
    rate = sum(g > 0 for g in grades) / len(grades)

    def gain(f):
        p = k[f] / n[f]
        return 2 * n[f] * sum(a * math.log(a / b) for a, b in ((p, rate), (1 - p, 1 - rate)) if a > 0)

    best = sorted((f for f in n if n[f] >= 8 and gain(f) > 16), key=lambda f: (-round(gain(f), 9), f))
    assert 3 < len(best) < 1024 and {b"wvilestuff", b"2vile"} <= set(best)
    assert sorted(model.columns, key=model.columns.get) == best


def test_weights_are_at_the_top_of_the_likelihood(table, model):
    bags, grades = labelled(table)
    rng = np.random.default_rng(22)
    assert list(model.thetas) == sorted(model.thetas)
    best = log_likelihood(bags, grades, model.columns, model.weights, model.thetas)
    assert best > log_likelihood(bags, grades, model.columns, 0 * model.weights, model.thetas) + 50
    for step in (0.02, 0.1, 0.5):
        for _ in range(15):
            w, t = model.weights + step * rng.normal(size=model.weights.shape), np.sort(model.thetas + step * rng.normal(size=2))
            assert log_likelihood(bags, grades, model.columns, w, t) < best + 1e-3


def test_severities_are_those_of_the_plain_form(spark, table, model):
    want = []
    for i, text in table[1]:
        found = [model.columns[f] for f in plain_features(text) if f in model.columns]
        above = [1 / (1 + math.exp(-(sum(model.weights[c] for c in found) - t))) for t in model.thetas]
        want.append((-1 if i is None else i, sum(above), above[0], len(found), above[0] >= 0.5))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["severity"], r["p_toxic"], r["n_hits"], r["toxic"]) for r in op4_toxicity(spark, table[0]).collect()]
    got, want = sorted(got), sorted(want)
    assert [(r[0], r[3], r[4]) for r in got] == [(r[0], r[3], r[4]) for r in want]
    assert np.allclose([r[1:3] for r in got], [r[1:3] for r in want], rtol=0, atol=1e-9)
    assert {r[0] for r in got if r[4]} >= {-1} and not {900, 901} & {r[0] for r in got if r[4]}
