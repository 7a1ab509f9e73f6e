"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Statistics are computed where the texts are; only those of a bounded sample of labelled rows come to
the driver, where numpy grows the trees. All trees are full to the same depth and flattened into
arrays of features, thresholds and leaves, which the tasks walk for a batch of rows at once.

The sample: per class the first `per_class` labelled documents in the order of a hash of their id.
Both classes weigh the same, so scores mean the same at every size of the table.

Defined results: null and empty texts have statistics of 0 and a score like any other; repeated
rows score alike; without labels of both classes every score is 0.5 or the label there is; a null id
is in no fold; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airtoll.llm.common import in_fold, one_text_each, training_ids

UPPER_BYTES, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
SYMBOLS, MARKS = b"*#$%&@^~=<>{}[]\\_+", b"!?"
STATISTICS = [
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks_per_word", "bars_per_word", "symbols_per_word",
    "other_signs", "beyond_ascii", "distinct_words", "repeated_in_a_row", "top_word", "log_lines", "line_length",
    "repeated_lines", "most_upper_in_line", "most_symbols_in_line", "most_bars_in_line", "most_repeats_in_line", "shouting_lines",
]


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text, in the order of STATISTICS."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    seen = Counter(words)
    w = max(len(words), 1)
    upper, digits = int(counts[65:91].sum()), int(counts[48:58].sum())
    symbols, marks, bars = int(counts[list(SYMBOLS)].sum()), int(counts[list(MARKS)].sum()), int(counts[124])
    signs = int(counts[33:127].sum()) - upper - digits - int(counts[97:123].sum()) - symbols - marks - bars
    lines = raw.split(b"\n")
    full = [x for x in lines if x.strip()]
    most = [0.0] * 4
    shouting = 0
    for line in full:
        size = len(line)
        caps = (size - len(line.translate(None, UPPER_BYTES))) / size
        shouting += caps > 0.5
        if size >= 20:
            parts = line.split()
            found = (caps, (size - len(line.translate(None, SYMBOLS))) / size, line.count(b"|") / size,
                     1 - len(set(parts)) / len(parts) if len(parts) >= 8 else 0.0)
            most = [max(a, b) for a, b in zip(most, found)]
    return [
        math.log1p(n), math.log1p(len(words)), sum(map(len, words)) / w, upper / n, digits / n, marks / w, bars / w, symbols / w,
        signs / n, int(counts[128:].sum()) / n, len(seen) / w, sum(map(eq, words, words[1:])) / w, max(seen.values(), default=0) / w,
        math.log1p(len(lines)), n / len(lines), 1 - len(set(full)) / max(len(full), 1), *most, shouting / max(len(full), 1),
    ]


class Trees:
    """Full trees of one depth as arrays: feature and threshold of inner nodes, values of leaves."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while len(x) and at[0] < inner:  # all rows are on one level
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner] if len(x) else 0
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
         smooth: float = 1.0, least: float = 4.0) -> Trees:
    """Boosted trees on logistic loss by histograms of gradients; both classes weigh the same."""
    inner = 2 ** depth - 1
    if len(set(y.tolist())) < 2:
        base = 0.0 if not len(y) else (8.0 if y[0] else -8.0)
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    n, f = x.shape
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], axis=1)  # bin <= k iff x <= edge k
    features, thresholds, leaves = [], [], []
    margin = np.zeros(n)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            cell = (((at - first)[:, None] * f + np.arange(f)) * bins + binned).ravel()
            shape = (count, f, bins)
            gs = np.bincount(cell, np.repeat(g, f), count * f * bins).reshape(shape)
            hs = np.bincount(cell, np.repeat(h, f), count * f * bins).reshape(shape)
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = gt - gl, ht - hl
            gain = gl ** 2 / (hl + smooth) + gr ** 2 / (hr + smooth) - gt ** 2 / (ht + smooth)
            gain[(hl < least / 4) | (hr < least / 4)] = 0
            for k in range(count):
                best = int(gain[k].argmax())
                j, b = divmod(best, bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        cell = at - inner
        value = -rate * np.bincount(cell, g, inner + 1) / (np.bincount(cell, h, inner + 1) + smooth)
        margin += value[cell]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Trees(0.0, np.array(features), np.array(thresholds), np.array(leaves))


def train(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = 10_000, doc: str = "doc_id", text: str = "text") -> Trees:
    """Trees from the labels whose column doc_id is allowed; per_class bounds the sample and what the driver gets.

    Of rows that share an id one is an example.
    """
    ids = training_ids(labels, "quality", allowed, per_class)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"label": part["label"], "x": [statistics(t) for t in part["text"]]})

    got = one_text_each(docs, ids, doc, text).select("label", "text").mapInPandas(run, "label int, x array<double>").toPandas()
    got = got.iloc[np.lexsort(np.array(got["x"].tolist()).reshape(len(got), len(STATISTICS)).T)] if len(got) else got  # any order of tasks
    return grow(np.array(got["x"].tolist()).reshape(len(got), len(STATISTICS)), got["label"].to_numpy(float))


def score(docs: DataFrame, model: Trees, threshold: float = 0.3, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.array([statistics(t) for t in part["text"]]).reshape(len(part), len(STATISTICS))
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": model.score(x)})

    scored = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = 10_000, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): learnt from the rows outside the held-out fold."""
    held_out = in_fold(F.col("doc_id"), 5, 0)
    return score(docs, train(docs, labels, ~held_out, per_class), threshold).select("doc_id", held_out.alias("held_out"), "score", "predicted")
