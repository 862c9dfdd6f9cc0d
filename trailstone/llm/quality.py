"""Text quality by histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts inside the tasks; trees are grown on the driver from a bounded labelled sample
(labelled.SAMPLE_ROWS rows of each class, weighted back to the classes' true shares), on 64 quantile bins a feature, and
flattened into arrays that a task walks for all its rows at once.

Defined cases: null and empty texts have all statistics 0 and get the score those lead to; with no labelled rows, or of
one class only, every score is the (smoothed) share of label 1; repeated rows score alike; other columns of the input
don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import pick, text_blocks
from .labelled import SAMPLE_ROWS, class_counts, labelled_sample

FEATURES = ("log_chars", "log_words", "word_mean", "word_std", "distinct_words", "top_word", "repeats_next", "short_words", "long_words", "space", "upper", "lower", "digit", "high", "pipe", "symbol", "exclaim", "stop", "comma", "lines", "line_mean", "distinct_lines", "top_line_chars", "bare_lines", "packed", "entropy", "distinct_pairs", "marked_words")
_CLASS = np.zeros(256, np.int64)  # of a byte: 0 other, then as named below
for _k, _chars in enumerate((b" \t\n\r\x0b\x0c", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), bytes(range(128, 256)), b"|", b"#$%&*@^~<>{}[]\\/=+_", b"!?", b".", b",;:"), 1):
    _CLASS[list(_chars)] = _k


def statistics(text: str) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_CLASS, counts, 11) / len(raw)
    words = text.split()
    n = max(len(words), 1)
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else 1
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    line_tally: dict[str, int] = {}
    for x in lines:
        line_tally[x] = line_tally.get(x, 0) + 1
    bare = sum(x.rstrip()[-1:] not in (".", "!", "?", '"') for x in lines)
    p = counts[counts > 0] / len(raw)
    marked = sum(not w[-1].isalnum() for w in words) / n
    return [
        np.log1p(len(text)), np.log1p(len(words)), sizes.mean(), sizes.std(), len(tally) / n, max(tally.values(), default=0) / n, again / n, (sizes <= 3).mean(), (sizes >= 12).mean(),
        *share[[1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], np.log1p(len(lines)), len(text) / len(lines), len(line_tally) / len(lines), max(k * len(x) for x, k in line_tally.items()) / len(text),
        bare / len(lines), len(zlib.compress(raw, 1)) / len(raw), float(-(p * np.log2(p)).sum()), pairs / max(n - 1, 1), marked,
    ]


def statistics_table(texts: list[str]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], float).reshape(-1, len(FEATURES))


@dataclass
class BoostedTrees:
    """All trees back to back: feature < 0 marks a leaf; children are absolute positions."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                below = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 2.0, least: float = 8.0) -> BoostedTrees:
    """Logistic loss, second-order splits found on histograms, leaf by level."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    flat = binned + np.arange(x.shape[1]) * bins
    share = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    roots, feature, threshold, left, right, value = [], [], [], [], [], []

    def leaf(g: float, h: float) -> int:
        for column, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, -rate * g / (h + ridge))):
            column.append(v)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        roots.append(leaf(g.sum(), h.sum()))
        level = [(roots[-1], np.arange(len(y)))]
        ends = []
        for d in range(depth + 1):
            following = []
            for node, rows in level:
                best = None
                if d < depth and len(rows) >= 2 * least:
                    where = flat[rows].ravel()
                    wide = x.shape[1]
                    gs = np.bincount(where, np.repeat(g[rows], wide), wide * bins).reshape(wide, bins).cumsum(1)
                    hs = np.bincount(where, np.repeat(h[rows], wide), wide * bins).reshape(wide, bins).cumsum(1)
                    ns = np.bincount(where, minlength=wide * bins).reshape(wide, bins).cumsum(1)
                    G, H, N = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + ridge) + (G - gs) ** 2 / (H - hs + ridge) - G**2 / (H + ridge)
                    gain[(ns < least) | (N - ns < least)] = -1
                    j, k = divmod(int(gain.argmax()), bins)
                    if gain[j, k] > 1e-3 and k < len(cuts[j]):
                        best = j, k
                if best is None:
                    ends.append((node, rows))
                    continue
                j, k = best
                low = binned[rows, j] <= k
                feature[node], threshold[node] = j, cuts[j][k]
                for side, part in ((left, rows[low]), (right, rows[~low])):
                    child = leaf(g[part].sum(), h[part].sum())
                    side[node] = child
                    following.append((child, part))
            level = following
        for node, rows in ends:
            margin[rows] += value[node]
    return BoostedTrees(base, np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))


def _constant(zeros: int, ones: int) -> BoostedTrees:
    base = float(np.log((ones + 0.5) / (zeros + 0.5)))
    return BoostedTrees(base, np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0, int), np.empty(0, int), np.empty(0))


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", rows: int = SAMPLE_ROWS) -> BoostedTrees:
    """Trees from at most `rows` labelled rows of each class; `learn` selects on doc_id which labels may be seen."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            x = statistics_table(block.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), block.column("label").cast(pa.float64()), block.column("doc_id")], [*FEATURES, "label", "doc_id"])

    zeros, ones = class_counts(labels, label, learn)
    if not zeros or not ones:
        return _constant(zeros, ones)
    sample = labelled_sample(docs, labels, label, learn, rows)
    measured = sample.mapInArrow(measure, ", ".join(f"{c} double" for c in (*FEATURES, "label")) + f", doc_id {dict(sample.dtypes)['doc_id']}")
    measured = measured.toArrow().sort_by("doc_id")  # 2 * rows at most
    x, y = np.stack([measured[c].to_numpy() for c in FEATURES], 1), measured["label"].to_numpy()
    if not 0 < y.sum() < len(y):
        return _constant(zeros, ones)
    weight = np.where(y == 1, ones / y.sum(), zeros / (len(y) - y.sum()))
    return grow_trees(x, y, weight / weight.mean())


def score_quality(docs: DataFrame, model: BoostedTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(shared.value.score(statistics_table(block.column("text").to_pylist())))], ["doc_id", "score"])

    rows = pick(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
