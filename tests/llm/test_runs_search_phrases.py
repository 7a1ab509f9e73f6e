"""Periodic runs, exact search and collocations against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from airtoll.llm import collocations, exact_topk, periodic_runs, queries

FOLDER = "/root/testdata/sf0.001"


def runs_by_brute_force(words, least=12):
    out = set()
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at + q < len(words):
            start = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            size = at + q - start
            if at - start >= q and size >= least and not any(
                    q % p == 0 and all(words[i] == words[i + p] for i in range(start, start + size - p)) for p in range(1, q)):
                out.add((start, size, q))
            at += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def as_tuples(found):
    return [tuple(int(v) for v in run) for run in zip(*found)]


@pytest.mark.parametrize("letters", [1, 2, 3, 4])
def test_runs_by_brute_force(letters):
    r = random.Random(letters)
    for _ in range(400):
        words = [r.randrange(letters) for _ in range(r.randint(0, 70))]
        if words and r.random() < 0.5:
            a = r.randrange(len(words))
            p = 1 + (len(words) - a) // r.randint(2, 6)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        least = r.choice([2, 12])
        assert as_tuples(periodic_runs.runs(np.array(words, np.int64), least)) == runs_by_brute_force(words, least)


@pytest.mark.parametrize("seeds", ["ab", "aab", "abaab"])
def test_runs_of_nested_repeats(seeds):
    a, b = seeds[0], seeds
    for _ in range(6):
        a, b = b, b + a
    words = [ord(c) for c in b[:160]]
    assert as_tuples(periodic_runs.runs(np.array(words, np.int64), 2)) == runs_by_brute_force(words, 2)


def planted(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        a = h // 10 % len(words)
        p = 1 + (len(words) - a) // (3 + h // 10 % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    return words


def test_run_query_by_brute_force(spark):
    def judged(doc_id, text):
        words = planted(doc_id, text)
        found = runs_by_brute_force(words)
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (
            "".join(f"{s},{n},{p}\n" for s, n, p in found), " ".join(w for i, w in enumerate(words) if i not in gone))]
        return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, *digest)

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = sorted(judged(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    assert sorted(map(tuple, queries.op13_periodic_runs(spark, FOLDER).collect())) == want
    assert sum(row[1] > 0 for row in want) > 10


def test_runs_of_odd_rows(spark):
    circle = "a b c " * 30_000 + "d"
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "x y " * 6), (5, "x y " * 6), (5, "x y " * 6), (6, circle), (7, "é é " * 12), (8, "x y " * 5)]
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, runs string, n_words int")
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["kept_text"]) for r in
           periodic_runs.periodic_runs(docs, batch_words=10).collect()]
    nothing = [(i, 0, [], "") for i in (1, 2, 3)]
    pair = (12, [(0, 12, 2)], "x y")
    want = nothing + [(None, *pair), (5, *pair), (5, *pair), (6, 90_001, [(0, 90_000, 3)], "a b c d"),
                      (7, 12, [(0, 12, 1)], "é é"), (8, 10, [], "x y x y x y x y x y")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []


def best_by_brute_force(rows, k=20, every=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(good):
        if i is not None and i % every == 0:
            others = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for m, (j, w) in enumerate(good) if m != n)
            out += [(i, rank, None if no_id else j, max(-1 << 63, min((1 << 63) - 1, -s))) for rank, (s, no_id, j) in enumerate(others[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"block_rows": 20, "query_rows": 5, "dims": 3}])
def test_search_by_brute_force(spark, limits):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(r.choice([8, 8, 8, 5, 0]))]) for i in range(200)]
    rows += [(400 + i, [1.0] * 8) for i in range(60)] + [(20, [1.0] * 8)] * 3  # many ties, repeated rows
    rows += [(None, [2.0] * 8), (None, None), (40, None), (60, [None, 1.0]), (80, [math.nan]), (100, [math.inf]), (-20, [0.5] * 8)]
    vectors = spark.createDataFrame([(i, v, 1, "of") for i, v in rows], "vec_id long, embedding array<double>, score int, of string")
    assert sorted(map(tuple, exact_topk.exact_topk(vectors, **limits).collect()), key=str) == best_by_brute_force(rows)


def test_search_of_large_components(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([1e10, -1e10, 3e9]) * r.random() for _ in range(6)]) for i in range(50)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, exact_topk.exact_topk(vectors).collect()), key=str) == best_by_brute_force(rows)


def test_search_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert exact_topk.exact_topk(spark.createDataFrame([], schema)).collect() == []
    assert exact_topk.exact_topk(spark.createDataFrame([(20, [1.0])], schema)).collect() == []
    assert exact_topk.exact_topk(spark.createDataFrame([(1, [1.0]), (2, [1.0])], schema)).collect() == []
    got = exact_topk.exact_topk(spark.createDataFrame([(20, []), (40, [1.0])], schema)).collect()
    assert sorted(map(tuple, got)) == [(20, 1, 40, 0), (40, 1, 20, 0)]


def phrases_by_brute_force(rows, least=30, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for i in range(len(words)) for k in range(1, min(4, len(words) - i) + 1))
    found = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    inside = {(lang, p[i:i + k]) for (lang, p), a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
              if 100 * a >= 80 * found[lang, p[i:i + k]]}
    out = []
    for (lang, p), a in found.items():
        if (lang, p) not in inside:
            score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    place, result = collections.Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            result.append((lang, place[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return result


@pytest.mark.parametrize("how", [{"min_count": 3, "top": 50}, {"min_count": 2, "hot": 5, "route_rows": 500, "chunk_bytes": 3000}])
def test_phrases_by_brute_force(spark, how):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    got = sorted(map(tuple, collocations.collocations(docs, **how).collect()))
    assert got == phrases_by_brute_force(rows, how["min_count"], how.get("top", 2000)) and got


def test_phrases_of_odd_rows(spark):
    r = random.Random(6)
    long = " ".join(r.choice("abc") for _ in range(30_000)) + ". " + "Ä ä x É\ty " * 40
    rows = [("en", None), ("en", ""), (None, "a b c " * 40), ("und", "A b\tc " * 40), ("", "x y;x y\x0bx y" * 40), ("de", long), ("de", ".,;"), ("de", "one")]
    rows += [("fr", "s t u v w")] * 35
    docs = spark.createDataFrame([(lang, t, 1, "n", "p") for lang, t in rows], "lang string, text string, a int, n string, phrase string")
    for how in ({}, {"hot": 100, "chunk_bytes": 64, "route_rows": 50}):
        assert sorted(map(tuple, collocations.collocations(docs, **how).collect())) == phrases_by_brute_force(rows)
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_scores_beyond_64_bits(spark):
    """The share of two decimals, as used for scores, for counts near the end of a long."""
    row = spark.sql("SELECT 9000000000000000000L a, 9100000000000000001L l, 9200000000000000007L r").selectExpr(
        "cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint) score").first()
    assert row["score"] == 2_000_000 * 9000000000000000000 // (9100000000000000001 + 9200000000000000007)
