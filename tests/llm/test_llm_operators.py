"""Operators for training data: against SQL or brute force, and on odd rows."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from airtoll.llm import (bwt, chat, components, decontamination, exact_dedup, line_dedup, mixing, near_dedup, quality, queries,
                         suffix_dedup, toxicity, url_filter)
from check_queries import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, node string, at string, text_key string"
BASE = " ".join(f"word{i}" for i in range(40))
ODD = [(1, BASE), (2, BASE.upper()), (2, BASE.upper()), (3, BASE.replace("word39", "other")), (4, None), (5, ""), (6, " \n\t "), (None, BASE),
       (None, None), (7, "one two"), (8, "x" * 300_000), (9, (BASE + "\n") * 300), (10, "ÄÖ É"), (11, "äö é")]


def docs(spark, rows):
    """Documents with further columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", "a" if i is None or i % 2 else None, 0, "k", "n", "a", "t") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    assert canonical(queries.QUERIES[name](spark, FOLDER).toPandas()).equals(canonical(duck.execute(queries.SQL[name]).df()))


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def linked(rows):
    """Smallest id reachable by brute force."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                u, v = root(i), root(j)
                parent[max(u, v)] = min(u, v)
    return {i: (root(i), len(s)) for i, s in sets}


def edited(seed, n=120):
    """Chains and groups of edited copies of a few texts."""
    r = random.Random(seed)
    texts = [[f"w{r.randrange(500)}" for _ in range(r.randrange(30, 160))] for _ in range(6)]
    out = []
    for i in range(n):
        words = list(r.choice(texts))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            words[r.randrange(len(words))] = f"v{r.randrange(9)}"
        out.append((i * 3 % 361, " ".join(words)))
    return out


@pytest.mark.parametrize("rows, limits", [(edited(1), {}), (edited(2), {"block_rows": 7, "block_chars": 2000})])
def test_near_duplicates_by_brute_force(spark, rows, limits):
    got = near_dedup.near_dedup(docs(spark, rows), **limits).collect()
    want = linked(rows)
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


def test_transforms_by_brute_force():
    r = random.Random(5)
    for _ in range(20):
        depth = r.choice([2, 3, 5, 8])
        strings = list({bytes(r.choice(b"ab") for _ in range(r.randint(depth, 14))) for _ in range(r.randint(1, 25))})
        owners = np.array([r.randint(0, 9) for _ in strings])
        starts, least = bwt.window_owners(strings, owners, depth, shard_bytes=r.choice([10, 40, 1000]))
        best = {}
        for s, o in zip(strings, owners):
            for i in range(len(s) - depth + 1):
                best[s[i:i + depth]] = min(best.get(s[i:i + depth], 99), o)
        for k, s in enumerate(strings):
            assert [best[s[i:i + depth]] for i in range(len(s) - depth + 1)] == least[starts[k]:starts[k + 1]].tolist()


def removed_by_brute_force(rows, depth=50):
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        for p in range(len(b) - depth + 1):
            first.setdefault(b[p:p + depth], float("inf") if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - depth + 1):
            if first[b[p:p + depth]] < (float("inf") if i is None else i):
                gone[p:p + depth] = True
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.append([0], gone.astype(int))) == 1).sum()),
                    np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("rows, limits", [
    ([x for x in ODD if x[0] != 8] + edited(3, 30), {}),
    ([x for x in ODD if x[0] != 8], {"pack_bytes": 500, "bucket_bytes": 300, "gram_bytes": 700})])
def test_repeated_substrings_by_brute_force(spark, rows, limits):
    got = suffix_dedup.suffix_dedup(docs(spark, rows), **limits).collect()
    assert (collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got)
            == collections.Counter(removed_by_brute_force(rows)))


def test_suffixes_of_whole_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op7_suffix_array_dedup(spark, FOLDER).collect()
    want = {i: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in removed_by_brute_force(rows)}
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


def test_exact_copies_on_odd_rows(spark):
    for keep in ("largest", "smallest"):
        got = exact_dedup.exact_dedup(docs(spark, ODD), keep).collect()
        assert len(got) == len(ODD)
        groups = collections.defaultdict(list)
        for i, t in ODD:
            groups[(t or "").encode().lower()].append(i)
        for r in got:
            ids = next(g for k, g in groups.items() if hashlib.sha256(k).hexdigest() == r["text_sha256"])
            pick = (max if keep == "largest" else min)(ids, key=lambda i: (i is not None, i or 0))
            assert (r["keep_id"], r["group_size"], r["kept"]) == (pick, len(ids), r["doc_id"] == pick)
    left = exact_dedup.keep_owners(docs(spark, ODD)).collect()
    assert len(left) == len({(t or "").encode().lower() for _, t in ODD}) and left[0].asDict().keys() == docs(spark, ODD).first().asDict().keys()


def test_tries_spill_by_subtree():
    trie = exact_dedup.Trie(True)
    for i, text in enumerate([b"abc", b"abd", b"ab", b"x", b"", b"abc"]):
        trie.insert(text, (i, 1, 1))
    assert trie.root.entry == (4, 1, 1)
    gone = list(trie.largest_subtree())
    assert sorted(gone) == [(b"ab", 2, 1, 1), (b"abc", 5, 1, 2), (b"abd", 1, 1, 1)]
    assert sorted(trie.all()) == [(b"", 4, 1, 1), (b"x", 3, 1, 1)]


def test_spilled_tries_give_the_same(spark):
    rows = edited(4, 60) + [(1000 + i, BASE) for i in range(50)]
    whole, spilled = (sorted(map(tuple, exact_dedup.owners(docs(spark, rows), spill_bytes=n).collect())) for n in (1 << 26, 600))
    assert whole == spilled


def test_contamination_on_odd_rows(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)), "x"), (2, "Short item", "x"), (None, "lonely words", "x"),
                                   (3, None, "x"), (4, "", "x"), (5, "Short item", "x")], "item_id long, text string, doc_id string")
    rows = [(1, "see w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 end"), (2, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (3, "a SHORT, item and lonely-words"), (4, None),
            (None, "short item"), (None, "short item"), (5, "w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 x w0 w1"), (6, "")]
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"])
                              for r in decontamination.decontaminate(docs(spark, rows), items).collect())
    assert got == collections.Counter([
        (1, 12, 10, ("1",), True), (2, 9, 0, (), False), (3, 6, 4, ("2", "5"), True), (4, 0, 0, (), False), (None, 2, 2, ("2", "5"), True),
        (None, 2, 2, ("2", "5"), True), (5, 13, 10, ("1",), True), (6, 0, 0, (), False)])
    assert decontamination.decontaminate(docs(spark, rows), items.limit(0)).where("contaminated").count() == 0
    assert {r["doc_id"] for r in decontamination.drop_contaminated(docs(spark, rows), items).collect()} == {2, 4, 6}


def test_lines_on_odd_rows(spark):
    rows = [(1, "a b c d e\nkeep this\nA  B C D E\nlast"), (2, "x\na b c d e"), (3, None), (None, "a b c d e\n"), (4, "one line of five words"), (5, "")]
    got = {(r["doc_id"], r["n_removed"], r["kept_text"]) for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert got == {(1, 1, "a b c d e\nkeep this\nlast"), (2, 1, "x\n"), (3, 0, ""), (None, 1, ""), (4, 0, "one line of five words"), (5, 0, "")}
    parts = line_dedup.line_dedup(docs(spark, [(1, "a b c d e\nf\n\nnext"), (2, "a b c d e\nf\n\nz")]), by="paragraph").collect()
    assert {(r["doc_id"], r["kept_text"]) for r in parts} == {(1, "a b c d e\nf\n\nnext"), (2, "z")}


def test_urls_on_odd_rows(spark):
    urls = [None, "", "no scheme", "http://NET/", "https://a.net", "http://www.example.net/en/1?x", "https://example.com/de/", "x://notexample.com/de/",
            "http://b.org/fr/#t", "http://org", "a\nb://c.example.com/de/x"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] * 2, "page_id long, url string, html string, rule string")
    model = url_filter.train(url_filter.labelled_urls(spark), steps=5)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.RULES, model).collect()}
    assert [got[i][:3] for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("net", "/", "net/"), ("a.net", "", None), ("www.example.net", "/en/1", "example.net/en/"),
        ("example.com", "/de/", "example.com/de/"), ("notexample.com", "/de/", None), ("b.org", "/fr/", "org/fr/"), ("org", "", None),
        ("c.example.com", "/de/x", "example.com/de/")]
    assert url_filter.judge(pages, url_filter.RULES, model).count() == 2 * len(urls)
    assert url_filter.train(url_filter.labelled_urls(spark).limit(0)) == ([0.0] * (1 << 14), 0.0)
    block = url_filter.judge(url_filter.labelled_urls(spark).withColumn("page_id", F.col("label")), [], url_filter.train(url_filter.labelled_urls(spark)),
                             threshold=0.5).groupBy("page_id").agg(F.avg((F.col("verdict") == "block").cast("int"))).collect()
    assert dict(block)[1] > 0.8 > 0.2 > dict(block)[0]


def test_classifiers_on_held_out_rows(spark):
    r = random.Random(1)
    syllables = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    rows, labels = [], []
    for i in range(500):
        words = [word() for _ in range(r.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                words.insert(r.randrange(len(words)), "gruntle" + r.choice(["", "s", "r", "d", "st"]))
        junk = i % 5 == 1
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words)))
        labels.append((i, int(not junk), int(bad), "x"))
    labels += [(None, 1, 1, "x"), (0, 0, None, "x"), (3, 1, 0, "x"), (3, 1, 1, "x")]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    for module, label, column in ((quality, lambda i: int(i % 5 != 1), "predicted"), (toxicity, lambda i: int(i % 4 == 0), "predicted")):
        got = module.classify(docs(spark, rows + ODD), labels).collect()
        assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
        modulus, rest = (5, 0) if module is quality else (3, 1)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in got)
        test = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] > 20]
        assert sum(r[column] == label(r["doc_id"]) for r in test) >= 0.9 * len(test)
    nothing = labels.limit(0)
    assert {r["score"] for r in quality.classify(docs(spark, ODD), nothing).collect()} == {0.5}
    assert max(r["score"] for r in toxicity.classify(docs(spark, ODD), nothing).collect()) < 1e-6


def test_chat_on_odd_rows(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b<|im_end|>", "x"), (1, 0, "user", "a<\\|x", "x"), (2, 0, None, None, "x"), (None, None, "us\ner", "é", "x"),
                                  (1, 1, "assistant", "b<|im_end|>", "x"), (3, 0, "assistant", "z" * 100_000, "x")],
                                 "conv_id long, turn long, role string, text string, ids string")
    vocab = chat.vocabulary()
    formatted = chat.format_chat(rows, vocab)
    assert sorted((r["place"], r["start"] > 0) for r in formatted.where("conv_id = 1").collect()) == [(0, False), (1, True), (2, True)]
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(formatted, vocab).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {
        1: (3, digest("user\na<\\|x\n" + "assistant\nb<|im_end|>\n" * 2), 22, digest("b<|im_end|>" * 2)), 2: (1, digest("\n\n"), 0, digest("")),
        None: (1, digest("us\ner\né\n"), 0, digest("")), 3: (1, digest("assistant\n" + "z" * 100_000 + "\n"), 100_000, digest("z" * 100_000))}
    for text in ("<|", "<\\|", "<\\\\|x<||>", "\\n\n", "<\\", "|<|"):
        assert chat.unescape(chat.escape(text)) == text and chat.unescape_role(chat.escape_role(text)) == text
        assert "<|" not in chat.escape(text)


def test_mixture_meets_its_budget(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(1, 30)), ["a", "b", "c", None][min(int(r.expovariate(1.2)), 3)]) for i in range(4000)] + [
        (None, None, "a"), (5000, "", "b")]
    table = spark.createDataFrame([(i, t, s, "k") for i, t, s in rows], "doc_id long, text string, source string, key string")
    out = mixing.mix(table, repeats=1.5, block_tokens=500)
    assert out.count() == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    total = sum(sizes.values())
    for row in mixing.shares(out).collect():
        target = row["weight"] * total
        assert row["n_tokens"] == sizes[row["source"]] and target <= 1.5 * sizes[row["source"]] * 1.001
        assert target - 31 <= row["mixed_tokens"] <= target + 1
    spread = mixing.shares(mixing.mix(table, entropy=0.9, block_tokens=500)).collect()
    entropy = -sum(x["weight"] * np.log(x["weight"]) for x in spread)
    assert abs(entropy - 0.9 * np.log(len(spread))) < 1e-3


def test_empty_tables(spark):
    none = docs(spark, [])
    bench = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (near_dedup.near_dedup(none), exact_dedup.exact_dedup(none), suffix_dedup.suffix_dedup(none), line_dedup.line_dedup(none),
                decontamination.decontaminate(none, bench), mixing.mix(none, repeats=2.0), quality.classify(none, labels),
                toxicity.classify(none, labels), near_dedup.keep_smallest(none), exact_dedup.keep_owners(none)):
        assert out.count() == 0


def test_near_duplicates_on_odd_rows(spark):
    got = near_dedup.near_dedup(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["component_id"], r["n_shingles"]))
    assert by[1] == by[2] == {(1, 36)} and by[3] == {(1, 36)} and by[None] == {(1, 36), (None, 0)} and by[5] == {(5, 0)} and by[7] == {(7, 1)}
    left = near_dedup.keep_smallest(docs(spark, ODD)).collect()
    assert sorted(r["doc_id"] or 0 for r in left) == [0, 1, 4, 5, 6, 7, 8, 10, 11] and set(left[0].asDict()) == set(SCHEMA.replace(",", "").split()[::2])


def test_pipeline_stages(spark, tmp_path):
    planted = [(1, BASE), (2, BASE), (3, BASE.replace("word39", "other")), (4, " ".join(f"b{i}" for i in range(30))), (5, "quite another text"), (6, None)]
    table = docs(spark, planted)
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(15)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, now = [], table
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert name == "mixing" or now.columns == table.columns
        seen.append({r["doc_id"] for r in now.collect()})
    assert seen == [{1, 2, 3, 4, 5, 6}, {2, 3, 4, 5, 6}, {2, 4, 5, 6}, {2, 5, 6}, {2, 5, 6}]
