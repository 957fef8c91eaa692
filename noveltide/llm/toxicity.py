"""Toxicity: cumulative-link ordinal regression on sparse word features.

One weight vector is shared by all thresholds: P(grade > k) = sigmoid(w.x - theta_k) with rising thetas, and the
expected severity is the sum of these over k. Features are the presence of words, and of word stems that at least two
(or four) different words of the text share. Those that tell the grades apart are chosen, and the model is fitted, on
at most `sample` labelled rows (those with the smallest hash of doc_id).
Scoring reads every whole text once and shuffles nothing.

Grades from the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality.
Defined cases: null or empty text has no features and gets the severity of the thresholds alone. Null and repeated
doc_ids are scored as rows of their own; of several labels the highest grade counts, null toxic is no label. With no
labels or one grade only, the severity is 0 and nothing is toxic. An empty table gives an empty table. Extra columns
are not read. A text is read whole at any length, as one set of words. A p_toxic of exactly 0.5 is toxic.
"""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, saved, slices

TRIM = string.punctuation.encode()  # all of ASCII


STEMS = range(4, 9)  # lengths in bytes
SHARED = (2, 4)  # different words that share a stem


def words_of(text: bytes) -> set[bytes]:
    """The distinct words of a text, A-Z lowered, without outer ASCII punctuation."""
    out = {w.strip(TRIM) for w in set(text.lower().split())}
    out.discard(b"")
    return out


def features_of(text: bytes) -> list[bytes]:
    """b"w" and a word, or the number of words that share a stem and the stem."""
    words = words_of(text)
    stems = Counter(w[:k] for w in words for k in STEMS if len(w) > k)
    return [b"w" + w for w in words] + [b"%d" % n + s for s, c in stems.items() if c > 1 for n in SHARED if c >= n]


@dataclass
class Ordinal:
    """words -> column; weights by column; rising thresholds."""

    columns: dict[bytes, int]
    weights: np.ndarray
    thetas: np.ndarray

    def __post_init__(self):
        self.stems = {f[1:] for f in self.columns if f[:1] != b"w"}
        self.memo: dict[bytes, tuple] = {}

    def known(self, word: bytes) -> tuple:
        """The features of the model that a raw word touches: (stripped word, its column or -1, its stems)."""
        w = word.strip(TRIM)
        got = (w, self.columns.get(b"w" + w, -1), tuple(w[:k] for k in STEMS if len(w) > k and w[:k] in self.stems))
        if got[1] < 0 and not got[2]:
            got = ()
        if len(self.memo) >= 300_000:
            self.memo.clear()
        self.memo[word] = got
        return got

    def hits(self, text: bytes) -> list[int]:
        words = set(text.lower().split())
        memo = self.memo
        touched = {got for w in words if (got := memo[w] if w in memo else self.known(w))}
        stems = Counter(s for _, _, some in touched for s in some)
        out = [c for _, c, _ in touched if c >= 0]
        for s, n in stems.items():
            out += [c for k in SHARED if n >= k and (c := self.columns.get(b"%d" % k + s)) is not None]
        return out

    def above(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """P(grade > k) for each text and k, and the number of features present."""
        found = [self.hits(t) for t in texts]
        eta = np.array([self.weights[f].sum() if f else 0.0 for f in found])
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thetas, -50, 50))), np.array([len(f) for f in found], dtype=np.int64)


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, width: int, top: int, ridge: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated gradient descent on the penalised likelihood."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], dtype=np.int64)
    n = len(rows)
    share = np.array([(grades > k).mean() for k in range(top)])
    share = np.clip(share, 1e-4, 1 - 1e-4)
    w, gaps = np.zeros(width), None
    theta = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(theta), 1e-2))  # thetas stay in order
    first = theta[0]
    m = [np.zeros(width), np.zeros(1), np.zeros_like(gaps)]
    v = [np.zeros(width), np.zeros(1), np.zeros_like(gaps)]
    for t in range(1, rounds + 1):
        theta = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        eta = np.bincount(at, w[col], n) if len(col) else np.zeros(n)
        s = 1 / (1 + np.exp(-np.clip(eta[:, None] - theta, -50, 50)))
        upper = np.concatenate([np.ones((n, 1)), s], axis=1)  # P(y >= k)
        lower = np.concatenate([s, np.zeros((n, 1))], axis=1)
        d_upper, d_lower = upper * (1 - upper), lower * (1 - lower)
        i = np.arange(n)
        like = np.maximum(upper[i, grades] - lower[i, grades], 1e-9)
        a, b = d_upper[i, grades] / like, d_lower[i, grades] / like
        g_eta = a - b
        g_w = (np.bincount(col, g_eta[at], width) if len(col) else np.zeros(width)) - ridge * w
        g_theta = np.zeros(top)
        for k in range(top):
            g_theta[k] = b[grades == k].sum() - a[grades == k + 1].sum()
        g_first = g_theta.sum()
        g_gaps = np.array([g_theta[k + 1 :].sum() * np.exp(gaps[k]) for k in range(top - 1)])
        for j, grad in enumerate((g_w, np.array([g_first]), g_gaps)):
            m[j] = 0.9 * m[j] + 0.1 * grad
            v[j] = 0.999 * v[j] + 0.001 * grad**2
            move = 0.1 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
            if j == 0:
                w = w + move
            elif j == 1:
                first += float(move[0])
            else:
                gaps = gaps + move
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, width: int = 1024, least: int = 8) -> Ordinal | None:
    """The model from at most `sample` labelled rows and `width` words that at least `least` of them hold."""
    grade = F.when(F.col("toxic") > 0, F.when(F.col("quality") == 0, 2).otherwise(1)).otherwise(0)
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(grade).alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id")

    def bag(part):
        return part["doc_id"], part["grade"].cast(pa.int32()), pa.array([features_of(t) for t in as_bytes(part["text"])], pa.list_(pa.binary()))

    def tally(batches):
        for part in slices(batches, 2000):
            n, k = Counter(), Counter()
            for g, f in zip(part["grade"].to_pylist(), part["found"].to_pylist(), strict=True):
                n.update(f)
                if g > 0:
                    k.update(f)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([k[f] for f in n], pa.int64())], names=["feature", "n", "k"])

    bags = map_arrow(rows.select("doc_id", "text", "grade"), bag, "doc_id long, grade int, found array<binary>")
    bags = saved(bags.groupBy("doc_id", "grade").agg(F.min("found").alias("found")))  # one row a doc_id, whatever the order
    n, bad = bags.agg(F.count("*"), F.count_if(F.col("grade") > 0)).first()
    if bad == 0 or bad == n:
        return None
    rate = bad / n
    seen = bags.mapInArrow(tally, "feature binary, n long, k long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    share = F.col("k") / F.col("n")
    part = lambda p, q: F.when(p > 0, p * F.log(p / F.lit(q))).otherwise(0.0)
    gain = 2 * F.col("n") * (part(share, rate) + part(1 - share, 1 - rate))  # the likelihood-ratio statistic
    best = seen.where((F.col("n") >= least) & (gain > 16)).orderBy(gain.desc(), "feature").limit(width)
    columns = {bytes(x["feature"]): i for i, x in enumerate(best.select("feature").collect())}

    def pick(part):
        return part["doc_id"], part["grade"], pa.array([[columns[f] for f in r if f in columns] for r in part["found"].to_pylist()], pa.list_(pa.int32()))

    # bounded by the sample and the width
    chosen = map_arrow(bags, pick, "doc_id long, grade int, found array<int>").orderBy("doc_id").collect()
    w, thetas = fit_ordinal([x["found"] for x in chosen], np.array([x["grade"] for x in chosen], dtype=np.int64), max(len(columns), 1), 2)
    return Ordinal(columns, w, thetas)


def score(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """(doc_id, severity, p_toxic, n_hits, toxic): expected grade, P(grade > 0), features present, and the verdict."""

    def run(part):
        texts = as_bytes(part["text"])
        if model is None:
            p, hits = np.zeros((len(texts), 2)), np.zeros(len(texts), dtype=np.int64)
        else:
            p, hits = model.above(texts)
        return part["doc_id"], p.sum(axis=1), p[:, 0].copy(), hits, p[:, 0] >= 0.5

    schema = "doc_id long, severity double, p_toxic double, n_hits long, toxic boolean"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
