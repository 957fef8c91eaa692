"""Quality rules: gradient-boosted trees over document statistics, scored as flat numpy node arrays.

The statistics of every whole text are taken in Arrow batches next to the scoring; nothing is shuffled, and only the
text column goes to Python. The trees are
fitted on at most `sample` labelled rows (those with the smallest hash of doc_id), of which only the statistics come
to the driver. On chosen statistics (repetition, symbols) the score may only fall.

Defined cases: null or empty text has no words and fails the base rules. Null and repeated doc_ids are scored as rows
of their own; a label counts for all rows of its doc_id, the lowest one if there are several, null ones not at all. Of several
labelled rows with one doc_id, the one of smallest statistics is learned from.
With no labels, or labels of one class only, there is no model and the base rules decide. An empty table gives an
empty table. Extra columns are carried through by keep_good and not read otherwise. A text is read whole at any
length; its task holds a hash for each of its words. A score of exactly 0 is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, let_go, map_arrow, shingle_hashes

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics in the model, with the direction in which quality may go as they rise (0: either).
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_rate": -1,
    "dup_line_rate": -1,
    "repeat_rate": -1,
    "distinct_rate": 0,
    "digit_rate": 0,
    "upper_rate": 0,
    "top_word_rate": -1,
    "words_a_line": 0,
    "pipe_rate": -1,
    "stop_rate": 0,
    "longest_word": 0,
    "ascii_rate": 0,
}
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")


def statistics(text: bytes, hashes: WordHashes) -> tuple[list[int], list[float]]:
    """The base statistics and the model's features of one text."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= int(np.count_nonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) == 0x80))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else [text] * bool(n)
    dup = len(lines) - len(set(lines))
    repeat, distinct, top = 0, 0, 0
    if n:
        h = hashes.of(words)
        _, counts = np.unique(h, return_counts=True)
        distinct, top = len(counts), int(counts.max())
    if n > 8:
        windows = shingle_hashes(h, 8)
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        if len(counts) < len(windows):
            at = np.flatnonzero(counts[inverse] > 1)
            step = np.zeros(n + 1, dtype=np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + 8, -1)
            repeat = int(np.count_nonzero(np.cumsum(step[:-1])))
    size = max(len(text), 1)
    raw = np.frombuffer(text, dtype=np.uint8)
    kinds = np.bincount(raw, minlength=256)
    features = [
        float(np.log1p(n)),
        chars / max(n, 1),
        symbols / size,
        dup / max(len(lines), 1),
        repeat / max(n, 1),
        distinct / max(n, 1),
        float(kinds[48:58].sum()) / size,
        float(kinds[65:91].sum()) / size,
        top / max(n, 1) if n >= 20 else 0.0,
        n / max(len(lines), 1),
        float(kinds[124]) / size,
        float(kinds[46]) / max(n, 1),
        float(max(map(len, words), default=0)),
        float(kinds[:128].sum()) / size,
    ]
    return [n, chars, symbols, dup, repeat], features


@dataclass
class Trees:
    """All trees as flat node arrays; a leaf has feature -1."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality for the rows of x."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            f = self.feature[node]
            go_left = x[rows, np.maximum(f, 0)] <= self.threshold[node]
            node = np.where(f < 0, node, np.where(go_left, self.left[node], self.right[node]))
        return self.start + self.value[node].sum(axis=1)


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 5.0) -> Trees:
    """Logistic boosting on binned features; a split that breaks a sign is not taken and children stay on their side."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    p = y.mean()
    start = float(np.log(p / (1 - p)))
    f = np.full(n, start)
    roots, feature, threshold, left, right, value = [], [], [], [], [], []

    def leaf(v: float) -> int:
        for a, b in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, v)):
            a.append(b)
        return len(feature) - 1

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        here = leaf(rate * float(np.clip(gs / (hs + ridge), low, high)))
        best = (1e-3, None)
        if level == depth or len(rows) < 40:
            f[rows] += value[here]
            return here
        for j in range(m):
            b = binned[rows, j]
            gl = np.cumsum(np.bincount(b, g[rows], len(cuts[j]) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(cuts[j]) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(cuts[j]) + 1))[:-1]
            vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((gs - gl) / (hs - hl + ridge), low, high)
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            ok = (nl >= 20) & (len(rows) - nl >= 20) & (signs[j] * (vr - vl) >= 0)
            if ok.any() and (k := int(np.where(ok, gain, -1).argmax())) >= 0 and ok[k] and gain[k] > best[0]:
                best = (gain[k], (j, k, float(vl[k]), float(vr[k])))
        if best[1] is None:
            f[rows] += value[here]
            return here
        j, k, vl, vr = best[1]
        mid = (vl + vr) / 2
        sides = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[signs[j]]
        goes = binned[rows, j] <= k
        a = grow(rows[goes], level + 1, *sides[0])
        b = grow(rows[~goes], level + 1, *sides[1])
        feature[here], threshold[here], left[here], right[here] = j, float(cuts[j][k]), a, b
        return here

    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, q * (1 - q)
        roots.append(grow(np.arange(n), 0, -4.0, 4.0))
    a = lambda v, kind: np.array(v, dtype=kind)
    return Trees(a(roots, int), a(feature, int), a(threshold, float), a(left, int), a(right, int), a(value, float), depth, start)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Trees | None:
    """Trees from at most `sample` labelled documents."""
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id")  # at most `sample` labels

    def run(part):
        hashes = WordHashes()
        x = [statistics(t, hashes)[1] for t in as_bytes(part["text"])]
        return part["doc_id"], part["quality"].cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))

    got = map_arrow(rows.select("doc_id", "text", "quality"), run, "doc_id long, quality int, x array<double>")
    got = got.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")  # at most `sample` rows
    if got["quality"].nunique() < 2:
        return None
    return fit_trees(np.array(got["x"].tolist()), (got["quality"].to_numpy() > 0).astype(float), list(FEATURES.values()))


def verdicts(texts: list[bytes], trees: Trees | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base statistics, base_failed and kept of texts."""
    found = [statistics(t, hashes) for t in texts]
    base = np.array([a for a, _ in found], dtype=np.int64).reshape(-1, len(BASE))
    failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
    good = np.ones(len(base), dtype=bool)
    if trees is not None and len(base):
        good = trees.score(np.array([b for _, b in found])) >= 0
    return base, failed, good & ~failed


def assess(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row."""
    hashes = WordHashes()

    def run(part):
        base, failed, kept = verdicts(as_bytes(part["text"]), trees, hashes)
        return [part["doc_id"], *(base[:, i].copy() for i in range(len(BASE))), failed, kept]

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def keep_good(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The rows of docs that the rules keep, with all columns."""

    @F.arrow_udf("boolean")
    def good(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        hashes = WordHashes()
        for part in parts:
            kept = [verdicts(as_bytes(part.slice(i, 1000)), trees, hashes)[2] for i in range(0, len(part), 1000)]
            yield pa.array(np.concatenate(kept) if kept else [], pa.bool_())
        hashes = part = None
        let_go()

    return docs.where(good(docs["text"]))
