"""Empty tables, clashing names, very long texts and repeated rows where other tests leave them out."""

import corpus_pipeline
from airtoll.llm import chat, collocations, common, decontamination, exact_dedup, exact_topk, mixing, near_dedup, periodic_runs, url_filter
from pyspark.sql import functions as F

CLASH = "doc_id long, text string, lang string, source string, n_chars long, `__id` long, `__key` long, `__n` long, `__k` string, node long, text_key long, kept int, `key 0` int"
LONG = " ".join(f"word{i % 977}x{i % 1013}" for i in range(30_000))


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 0, 1, 2, 3, "k", 4, 5, n, 6) for n, (i, t) in enumerate(rows)], CLASH)


def test_empty_pages_conversations_and_pipeline(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = url_filter.train(url_filter.labelled_urls(spark), steps=2)
    assert url_filter.judge(pages, url_filter.RULES, model).collect() == []
    vocab = chat.vocabulary()
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chat(none, vocab), vocab).collect() == []
    assert [r["conv_id"] for r in chat.read_back(chat.format_chat(chat.with_probe(none, spark), vocab), vocab).collect()] == [-1]
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"),
                         ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and {"doc_id", "copies", "shortfall"} <= set(out.columns)


def test_filters_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k"), (3, "l m n o p q r s t u v w"), (None, None), (4, "x")]
    table = clashing(spark, rows)
    items = spark.createDataFrame([(9, "l m n o p q r s t u", 1)], "item_id long, text string, `__id` int")
    assert decontamination.drop_contaminated(table, items).columns == table.columns
    assert {r["doc_id"] for r in decontamination.drop_contaminated(table, items).collect()} == {1, 2, None, 4}
    kept = near_dedup.keep_smallest(table)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, None, 4}
    owners = exact_dedup.keep_owners(table)
    assert owners.columns == table.columns and {r["doc_id"] for r in owners.collect()} == {2, 3, None, 4}
    assert mixing.mix(table, repeats=2.0).count() == 5 and periodic_runs.periodic_runs(table).count() == 5
    assert collocations.collocations(table, min_count=2).count() == 8  # the phrases of four words


def test_of_repeated_rows_the_first_stays(spark):
    text = "one two three four five six"
    table = clashing(spark, [(1, text)] * 5 + [(2, "other")] * 3)
    for filtered in (near_dedup.keep_smallest(table), exact_dedup.keep_owners(table)):
        assert sorted((r["doc_id"], r["kept"]) for r in filtered.collect()) == [(1, 0), (2, 5)]
    assert common.one_of_repeated(table, F.col("doc_id")).columns == table.columns


def test_very_long_texts(spark):
    assert len(LONG) > 300_000
    words = LONG.split()
    table = clashing(spark, [(1, LONG), (2, LONG + " end"), (3, "short")])
    items = spark.createDataFrame([(1, " ".join(words[28_000:28_012]))], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontamination.decontaminate(table, items).collect()}
    assert got == {1: (30_000, 12), 2: (30_001, 12), 3: (1, 0)}
    near = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(table).collect()}
    assert near == {1: 1, 2: 1, 3: 3}
    mixed = mixing.mix(table, budget_share=0.4, repeats=1.0).collect()
    assert sum(r["n_tokens"] * r["copies"] for r in mixed) == 1 and {r["shortfall"] for r in mixed} == {int(0.4 * 60_002) - 1}
    url = "http://" + "a." * 200 + "net/" + "x" * 50_000
    pages = spark.createDataFrame([(1, url), (2, "http://b.net/")], "page_id long, url string")
    model = url_filter.train(url_filter.labelled_urls(spark), steps=2)
    judged = {r["page_id"]: (len(r["host"]), len(r["path"]), r["verdict"]) for r in url_filter.judge(pages, url_filter.RULES, model).collect()}
    assert judged == {1: (403, 50_001, "block"), 2: (5, 1, "block")}


def test_searches_read_only_their_columns(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0], i, "x") for i in range(50)], "vec_id long, embedding array<double>, rank int, query long".replace(", query long", ", query string"))
    got = exact_topk.exact_topk(vectors, k=1).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(0, 1), (20, 49), (40, 49)}


def test_ngrams_of_urls_by_brute_force(spark):
    urls = spark.createDataFrame([("ab.c", "/é"), ("", ""), ("x", "/abcabc")], "host string, path string")
    got = [sorted(r["g"]) for r in url_filter.with_letters(urls).select(url_filter.grams((3, 4), 1 << 30).alias("g")).collect()]
    want = []
    for host, path in (("ab.c", "/é"), ("", ""), ("x", "/abcabc")):
        parts = {(m, t[i:i + k]) for m, t in (("h", f"^{host}$"), ("p", f"^{path}$")) for k in (3, 4) for i in range(max(len(t) - k, 0) + 1)}
        frame = spark.createDataFrame(sorted(parts), "m string, t string")
        want.append(sorted(r[0] for r in frame.select(F.pmod(F.xxhash64("m", "t"), F.lit(1 << 30)).cast("int")).distinct().collect()))
    assert got == want
