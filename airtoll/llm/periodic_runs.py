"""Runs of words that repeat with a period, by a dictionary of basic factors.

The dictionary names, per power of two, the factors of that many words: a factor's name follows from
those of its halves, and a factor that occurs once is left out at all greater lengths. A run with
smallest period q, L <= q < 2L for the power L, has the factor of L words at its start again q words
later. Occurrences of a factor at most L/2 apart form arithmetic progressions of its own smallest period;
other progressions are more than L/2 away, so that four successors of a progression at most begin
within 2L. All differences from L to 2L between two such progressions are proposed as periods, one
pair of places each: a pair in one progression can't be that of a run, as its root would be a power.
A proposal is extended to both sides by comparing names from the greatest length down; equal stretches
are deduplicated, the smallest period of a stretch counts.

Documents are independent of each other, so nothing is shuffled. Those of an Arrow batch are put one
behind another and worked on together, with names that differ by document. Memory is that of a
batch (about `batch_words` words) or of the longest text: four bytes per word and level for names and
some dozens of bytes per word besides.

Defined results: null, empty and blank texts have no words, no runs and an empty kept text; ids are
handed on and may be null or repeat, each row is judged alone; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal keys, and whether each key occurs twice or more."""
    names, distinct = pd.factorize(keys)
    return names, np.bincount(names, minlength=len(distinct))[names] > 1


def dictionary(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, names, places of factors that occur twice or more) for lengths 1, 2, 4, ... as long as there are such.

    Names compare factors; a factor that occurs once has its place plus the number of codes as its name.
    """
    n, length = len(codes), 1
    alone = np.arange(n, 2 * n, dtype=np.int64)
    found, again = named(codes)
    places = np.flatnonzero(again)
    names = np.where(again, found, alone).astype(np.int32 if 2 * n < 1 << 31 else np.int64)
    while len(places):
        yield length, names, places
        left = places[places + length < n]
        left = left[names[left + length] < n]  # both halves occur twice or more
        found, again = named(names[left].astype(np.int64) * n + names[left + length])
        places, length = left[again], 2 * length
        names = alone.astype(names.dtype)
        names[places] = found[again]


def proposals(names: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): pairs of equal factors `length` to 2 * length - 1 words apart, one for each stretch of neighbouring pairs."""
    order = places[np.argsort(names[places], kind="stable")]
    name = names[order]
    gap = np.diff(order, prepend=0)
    new = np.append(True, (name[1:] != name[:-1]) | (2 * gap[1:] > length))
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(order)))
    first, of = order[at], name[at]
    step = np.where(count > 1, gap[np.minimum(at + 1, len(order) - 1)], 0)
    last = first + (count - 1) * step
    out = []
    for ahead in range(1, len(at)):
        low = np.flatnonzero((of[:-ahead] == of[ahead:]) & (first[ahead:] - last[:-ahead] < 2 * length))
        if not len(low):
            break
        high = low + ahead
        p = np.maximum(step[low], step[high])  # of the same factor: alike, or none where it stands alone
        base = first[high] - first[low]
        one = np.maximum(p, 1)
        least = np.maximum(1 - count[low], -((base - length) // one))  # differences are base + t * p
        most = np.minimum(count[high] - 1, (2 * length - 1 - base) // one)
        least, most = (np.where(p > 0, x, 0) for x in (least, most))
        n = np.maximum(most - least + 1, 0)
        t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(least, n)
        period = np.repeat(base, n) + t * np.repeat(p, n)
        place = np.repeat(first[low], n) + np.maximum(-t, 0) * np.repeat(p, n)
        good = (period >= length) & (period < 2 * length)
        out.append((place[good], period[good]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, period = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort([place, period])
    place, period = place[order], period[order]
    lead = np.append(True, (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)) if len(place) else np.zeros(0, bool)
    return place[lead], period[lead]


def runs(codes: np.ndarray, min_length: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of a sequence, by start, then period."""
    levels, place, period = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length, names, places in dictionary(codes):
        levels.append((length, names))
        i, q = proposals(names, places, length)
        place.append(i)
        period.append(q)
    place, period = np.concatenate(place), np.concatenate(period)
    n, low, high = len(codes), place.copy(), place.copy()
    for length, names in reversed(levels):  # no two factors of twice the greatest length are equal
        some = np.flatnonzero(high + period + length <= n)
        some = some[names[high[some]] == names[(high + period)[some]]]
        high[some] += length
    for length, names in reversed(levels):
        some = np.flatnonzero(low >= length)
        some = some[names[low[some] - length] == names[(low + period)[some] - length]]
        low[some] -= length
    size = high + period - low
    good = size >= np.maximum(min_length, 2 * period)
    low, size, period = low[good], size[good], period[good]
    order = np.lexsort([period, size, low])
    low, size, period = low[order], size[order], period[order]
    if len(low):
        new = np.append(True, (low[1:] != low[:-1]) | (size[1:] != size[:-1]))
        low, size, period = low[new], size[new], period[new]
    order = np.lexsort([period, low])
    return low[order], size[order], period[order]


def periodic_runs(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_length: int = 12, batch_words: int = 200_000) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (start, length, period in words, by start, then period), kept_text.

    Words are runs of characters other than ASCII white space. A run is a stretch of min_length words
    at least and of twice its smallest period at least that no neighbouring word extends. kept_text
    has, joined by single spaces, the words that no run contains after its first period.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("kept_text", pa.string())])

    def judged(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        words = np.empty(ends[-1], object)
        words[:] = [w for t in texts for w in t]
        codes, distinct = pd.factorize(words)
        start, size, period = runs(codes + np.repeat(np.arange(len(texts)), sizes) * np.int64(max(len(distinct), 1)), min_length)
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, start + period, 1)
        np.add.at(cover, start + size, -1)
        kept = np.cumsum(cover)[:-1] <= 0
        owner = np.searchsorted(ends, start, side="right")
        offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
        struct = pa.StructArray.from_arrays([pa.array(start - begins[owner]), pa.array(size), pa.array(period)], ["start", "length", "period"])
        full = np.logical_and.reduceat(np.append(kept, True), begins) | (sizes == 0)
        out = [b" ".join(t) if whole else b" ".join(words[a:b][kept[a:b]].tolist())
               for t, whole, a, b in zip(texts, full, begins.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct),
                                           pa.array([x.decode() for x in out], pa.string())], schema=schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts, held = [], [], 0
            for i in range(part.num_rows):
                words = (part.column(1)[i].as_py() or "").encode().split()  # of bytes: ASCII white space only
                ids.append(part.column(0)[i].as_py())
                texts.append(words)
                held += len(words)
                if held > batch_words:
                    yield judged(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield judged(ids, texts)

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string")
