"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax, in numpy.

A word is the mean of the vectors of its character n-grams (hashed into buckets), a window of a text the
mean of its words, and a linear softmax tells the classes apart; a text is as toxic as its most toxic window.
Vectors and softmax are trained jointly, so a misspelling that training never saw shares most of its
n-grams with the word it stands for.

A bounded sample of labelled rows comes to the driver (the first `per_class` documents of each class
in the order of a hash of their id; of a very long text so many pieces). Both classes weigh the same. As averaging and softmax are
linear, the margin of a window is the mean of one number per word, which is what the tasks add up
over whole texts.

Defined results: null texts and texts without a letter have the score of the bias, but at most that
of an empty bag, 0.5 or below; repeated rows score alike; without labels of both classes every score
is 0; a null id is in no fold; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airtoll.llm.common import in_fold, one_text_each, training_ids

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SIZES = (4, 5)
#: Words of a window.
WINDOW = 12
#: Fixed: bytes that are letters after lower-casing (a-z and all bytes beyond ASCII).
LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


class Grams:
    """n-grams of the framed words of whole texts: bucket and word; of each word its window, of each window its text.

    Texts are lower-cased; every run of letters is a word with a blank before and behind it. n-grams
    are of UTF-8 bytes, lie in one framed word and hold its frame at their ends only. A text is cut
    into windows of so many words; None stands for one window per text.
    """

    def __init__(self, texts: list[str | None], window: int | None = WINDOW):
        raw = [f" {t or ''} ".lower().encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        letter = LETTER[data]
        b = np.where(letter, data, np.uint8(32)).astype(np.uint32)
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        word = np.cumsum(first, dtype=np.int32) - 1  # of each letter
        starts = np.cumsum([0, *map(len, raw[:-1])])
        text = np.searchsorted(starts, np.flatnonzero(first), side="right") - 1  # of each word
        self.words = np.bincount(text, minlength=len(raw))  # of each text
        before = np.cumsum(self.words) - self.words
        windows = np.ceil(self.words / window).astype(np.int64) if window else (self.words > 0).astype(np.int64)
        self.first_window = np.cumsum(windows) - windows  # of each text
        self.window = self.first_window[text] + ((np.arange(len(text)) - before[text]) // window if window else 0)  # of each word
        self.window_text = np.repeat(np.arange(len(raw)), windows)
        self.window_words = np.bincount(self.window, minlength=len(self.window_text))
        buckets, words = [], []
        n = len(b)
        h = (b[:-1] * np.uint32(0x01000193) + b[1:]) if n > 1 else b[:0]  # hash of two bytes
        inner = np.ones(len(h), bool)  # whether all bytes but the first and the last are letters
        for k in range(3, max(SIZES) + 1):
            if n < k:
                break
            h = h[:n - k + 1] * np.uint32(0x01000193) + b[k - 1:]
            inner = inner[:n - k + 1] & letter[k - 2:n - 1]
            if k in SIZES:
                at = np.flatnonzero(inner)
                x = h[at] + np.uint32(k)
                x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
                buckets.append((x >> np.uint32(32 - BUCKET_BITS)).astype(np.uint16))
                words.append(word[at + 1])
        self.bucket = np.concatenate(buckets) if buckets else np.zeros(0, np.uint16)
        self.word = np.concatenate(words) if words else np.zeros(0, np.int32)
        self.per_word = np.bincount(self.word, minlength=len(self.window)).astype(np.int32)

    def means(self, margin: np.ndarray) -> np.ndarray:
        """Mean over the words of each window of the mean margin of their n-grams."""
        per_word = np.bincount(self.word, margin[self.bucket], len(self.window)) / np.maximum(self.per_word, 1)
        return np.bincount(self.window, per_word, len(self.window_text)) / np.maximum(self.window_words, 1)

    def bags(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, weight) of the chosen windows, a row each; the weights of a row add up to 1 at most."""
        row_of = np.full(len(self.window_text), -1)
        row_of[chosen] = np.arange(len(chosen))
        window = self.window[self.word]
        mine = np.flatnonzero(row_of[window] >= 0)
        cell = row_of[window[mine]].astype(np.int64) * BUCKETS + self.bucket[mine]
        weight = 1 / (self.per_word[self.word[mine]] * self.window_words[window[mine]])
        cells, at = np.unique(cell, return_inverse=True)
        return (cells // BUCKETS).astype(np.int32), (cells % BUCKETS).astype(np.int32), np.bincount(at, weight, len(cells))


class Model:
    """Margin per bucket (its embedding times the difference of the softmax rows) and the bias."""

    def __init__(self, per_bucket: np.ndarray, bias: float):
        self.per_bucket, self.bias = per_bucket, bias


def descend(row: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, steps: int, rate: float,
            scale: float, shrink: float) -> Model:
    """Embeddings and softmax, trained jointly by gradient descent with momentum; both classes weigh the same.

    With two classes the gradient of the embeddings is the outer product of one sum per bucket and
    the difference of the softmax rows, so a step costs two passes over the bags. scale makes up for
    the smallness of averages over many words.
    """
    n, value = len(y), value * scale
    mean = np.bincount(column, value, BUCKETS) / n
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum()))) / n
    random = np.random.default_rng(7)
    embedding, softmax, bias = random.normal(0, 0.01, (BUCKETS, width)), random.normal(0, 0.5, (width, 2)), 0.0
    push, last = [0.0, 0.0, 0.0], np.inf
    before = (embedding, softmax, bias)
    for _ in range(steps):
        difference = softmax[:, 1] - softmax[:, 0]
        per_bucket = embedding @ difference
        margin = np.bincount(row, value * per_bucket[column], n) - mean @ per_bucket + bias
        loss = float(weight @ np.logaddexp(0, np.where(y == 1, -margin, margin)))
        if loss > 1.02 * last:  # too long a step: back, and shorter ones from here
            (embedding, softmax, bias), push, rate = before, [0.0, 0.0, 0.0], rate / 2
            continue
        last, before = loss, (embedding, softmax, bias)
        residual = weight * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y)
        sums = np.bincount(column, value * residual[row], BUCKETS) - mean * residual.sum()
        turn = (embedding.T @ sums)[:, None] * np.array([-1.0, 1.0])
        gradients = [np.outer(sums, difference) + shrink * embedding, turn + shrink * softmax, residual.sum()]
        push = [0.9 * p - rate * g for p, g in zip(push, gradients)]
        embedding, softmax, bias = embedding + push[0], softmax + push[1], bias + push[2]
    embedding, softmax, bias = before
    per_bucket = embedding @ (softmax[:, 1] - softmax[:, 0])
    return Model(per_bucket * scale, float(bias - mean @ per_bucket))


def fit(texts: list[str | None], y: np.ndarray, width: int = 8, rounds: int = 5) -> Model:
    """Model of windows, from labels of whole texts.

    The first round learns from whole texts. Each further one learns from windows: the one that the
    round before finds most toxic of each toxic text, and of every other text one at random and those
    that any round finds most toxic. In the end margins are scaled to probabilities of whole texts.
    """
    y = np.asarray(y, float)
    some = np.array([len(Grams([t], None).window_text) > 0 for t in texts], bool)
    texts, y = [t for t, k in zip(texts, some) if k], y[some]
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 30.0 if len(y) and y[0] else -30.0)
    parts = list(grouped(texts))
    rows, base = [], 0
    for part in parts:
        row, column, value = Grams(part, None).bags(np.arange(len(part)))
        rows.append((row + base, column, value))
        base += len(part)
    model = descend(*map(np.concatenate, zip(*rows)), y, width, 100, 0.1, 100.0, 1e-4)
    del rows
    grams, random = [Grams(part) for part in parts], np.random.default_rng(11)
    sizes = [len(g.window_text) for g in grams]
    first = np.concatenate([g.first_window + sum(sizes[:i]) for i, g in enumerate(grams)])  # window of each text
    ends = np.append(first[1:], sum(sizes))
    text = np.repeat(np.arange(len(texts)), ends - first)
    other = first + (random.random(len(texts)) * (ends - first)).astype(np.int64)
    calm = other[y == 0]  # windows of texts that are not toxic

    def bags(chosen: np.ndarray) -> list[np.ndarray]:
        out, low, done = [], 0, 0
        for g, n in zip(grams, sizes):
            mine = chosen[(chosen >= low) & (chosen < low + n)]
            row, column, value = g.bags(mine - low)
            out.append((row + done, column, value))
            low, done = low + n, done + len(mine)
        return [np.concatenate(c) for c in zip(*out)]

    for _ in range(rounds):
        order = np.lexsort([np.concatenate([g.means(model.per_bucket) for g in grams]), text])
        best = order[ends - 1]  # of each text
        calm = np.union1d(calm, best[y == 0])
        chosen = np.union1d(best[y == 1], calm)
        model = descend(*bags(chosen), np.isin(chosen, best[y == 1]).astype(float), width, 150, 0.3, 30.0, 1e-4)
    best = np.maximum.reduceat(np.concatenate([g.means(model.per_bucket) for g in grams]), first) + model.bias
    slope, shift = calibrated(best, y)
    return Model(model.per_bucket * slope, model.bias * slope + shift)


def calibrated(margin: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """(slope, shift) of a logistic curve of one variable, classes weighing the same, by Newton's method."""
    n = len(y)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    x, beta = np.stack([margin, np.ones(n)], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 0.05 * n * 0.01 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * n * 0.01 * np.eye(2)
        beta = beta - np.linalg.solve(curve, gradient)
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 and np.isfinite(beta).all() else (1.0, 0.0)


def margins(texts: list[str | None], model: Model, most_chars: int = 1 << 20) -> np.ndarray:
    """Margins of whole texts, each that of its most toxic window; texts without a word have the bias, but not above 0."""
    out = [np.zeros(0)]
    for held in grouped(texts, most_chars):
        grams = Grams(held)
        m = np.full(len(held), min(model.bias, 0.0))
        if len(grams.window_text):
            some = grams.words > 0
            m[some] = np.maximum.reduceat(grams.means(model.per_bucket), grams.first_window[some]) + model.bias
        out.append(m)
    return np.concatenate(out)


def grouped(texts: list[str | None], most_chars: int = 1 << 20) -> Iterator[list[str | None]]:
    """Neighbouring texts of about so many characters together, one text at least."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > most_chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield held


def example(text: Column, piece_chars: int, pieces: int) -> Column:
    """What of a text is an example: all of it, or of a text of more pieces than that so many whole ones, by their hash, in order."""
    many = F.ceil(F.char_length(text) / piece_chars).cast("int")
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.struct(F.xxhash64(i).alias("hash"), i.alias("i"))))
    chosen = F.array_sort(F.transform(F.slice(ranked, 1, pieces), lambda r: r["i"]))
    cut = F.array_join(F.transform(chosen, lambda i: F.substr(text, i * piece_chars + 1, F.lit(piece_chars))), " ")
    return F.when(many > pieces, cut).otherwise(text)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = 1000, most_chars: int | None = None,
          doc: str = "doc_id", text: str = "text", piece_chars: int = 100_000, pieces: int = 8) -> Model:
    """Model from the labels whose column doc_id is allowed.

    per_class bounds the rows of the sample, and pieces of piece_chars characters each what of a very
    long text is learnt from, and so what the driver gets; texts up to pieces * piece_chars are taken as a whole, and all are
    scored as a whole. most_chars, if given, leaves longer texts out of the sample. Of rows that share an id
    one is an example.
    """
    short = docs if most_chars is None else docs.where(F.char_length(F.col(text)) <= most_chars)
    known = short.where(F.col(text).isNotNull()).select(F.col(doc).cast("long").alias("doc_id")).distinct()
    ids = training_ids(labels.join(known, "doc_id", "left_semi"), "toxic", allowed, per_class)
    chosen = one_text_each(short, ids, doc, text).select("doc_id", "label", example(F.col("text"), piece_chars, pieces).alias("text"))
    got = chosen.toPandas().sort_values("doc_id", kind="stable")
    return fit(got["text"].tolist(), got["label"].to_numpy())


def score(docs: DataFrame, model: Model, threshold: float = 0.7, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            m = margins(part["text"].tolist(), model)
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": 1 / (1 + np.exp(-np.clip(m, -500, 500)))})

    scored = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = 1000, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted): learnt from the rows outside the held-out fold."""
    held_out = in_fold(F.col("doc_id"), 3, 1)
    return score(docs, train(docs, labels, ~held_out, per_class), threshold).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def drop_rejected(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """docs below the threshold, with all their columns: one pass, no join."""
    columns = list(docs.columns)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(text)
        for part in parts:
            m = margins(part.column(at).to_pylist(), model)
            yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(m, -500, 500))) < threshold))

    return docs.mapInArrow(run, docs.schema)
