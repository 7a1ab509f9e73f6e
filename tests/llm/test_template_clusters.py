"""Texts of one template don't chain into one cluster that is compared text by text."""

import random

import numpy as np
import pytest

from airtoll.llm import near_dedup


def templated(n, seed=3):
    """Texts of 120 words: 80 of a template, 40 of their own; shingles of two are alike by about half."""
    r = random.Random(seed)
    head = [f"t{i}" for i in range(84)]
    return [(i, " ".join(head + [f"w{r.randrange(10 ** 9)}" for _ in range(40)])) for i in range(n)]


def test_a_template_is_no_cluster(spark, monkeypatch):
    rows = templated(5000)
    a, b = ({hash(tuple(w[i:i + 5])) for i in range(len(w) - 4)} for w in (rows[0][1].split(), rows[1][1].split()))
    assert 0.45 < len(a & b) / len(a | b) < 0.55
    copies = [(10_000 + i, rows[i][1] + " and") for i in range(0, 5000, 100)]  # near copies are still found
    seen = []
    confirm, split = near_dedup.confirmed, near_dedup.likely
    monkeypatch.setattr(near_dedup, "confirmed", lambda nodes, *rest: (_ for _ in ()).throw(AssertionError(len(nodes))) if len(nodes) > 30 else confirm(nodes, *rest))
    got = near_dedup.near_dedup(spark.createDataFrame(rows + copies, "doc_id long, text string"), block_rows=256).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {**{i: i for i, _ in rows}, **{i: i - 10_000 for i, _ in copies}}


def test_pairs_of_blocks_of_sketches_find_all_likely_links(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 256, (12, 128), dtype=np.uint8)
    sketches = base[np.arange(300) % 12].copy()
    change = r.random(sketches.shape) < 0.12
    sketches[change] = r.integers(0, 256, int(change.sum()))
    members = spark.createDataFrame([(i, 7, 300, s.tobytes()) for i, s in enumerate(sketches)], "node long, cluster long, rows long, sketch binary")
    for rows in (1000, 37):
        links = [tuple(x) for x in near_dedup.likely_links(members, 128, 70, rows).collect()]
        assert len(links) < 300 * 10 and all(a % 12 == b % 12 for a, b in links)
        parent = list(range(300))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            u, v = sorted((root(a), root(b)))
            parent[v] = u
        assert [root(i) for i in range(300)] == [i % 12 for i in range(300)]


@pytest.mark.parametrize("similarity", [0.86, 0.9])
def test_recall_at_the_threshold(spark, similarity):
    """Pairs just above the threshold: all are found, also where clusters are split by sketches."""
    r = random.Random(11)
    rows, want = [], set()
    for i in range(200):
        words = [f"v{r.randrange(10 ** 9)}" for _ in range(204)]
        other = words[:round(204 * 2 * similarity / (1 + similarity)) + 1] + [f"u{r.randrange(10 ** 9)}" for _ in range(60)]
        other = other[:204]
        a, b = ({tuple(w[k:k + 5]) for k in range(200)} for w in (words, other))
        if 100 * len(a & b) >= 85 * len(a | b):
            want.add(i)
        rows += [(i, " ".join(words)), (1000 + i, " ".join(other))]
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=1).collect()}
    assert {i for i in range(200) if got[1000 + i] == i} == want and len(want) > 150
