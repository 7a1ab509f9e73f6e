"""The threshold of the pipeline's near-copy stage."""

import corpus_pipeline


def pair(first, n, tag):
    """Two texts of n distinct words that differ in one: (n - 9) of (n + 1) shingles are shared."""
    words = [f"{tag}{i}" for i in range(n)]
    return [(first, " ".join(words)), (first + 1, " ".join([*words[:20], "other", *words[21:]]))]


def test_pairs_between_80_and_85_percent_go(spark):
    sizes = range(49, 65)  # 40 of 50 shingles to 55 of 65
    rows = [r for k, n in enumerate(sizes) for r in pair(2 * k, n, f"t{k}x")] + pair(100, 48, "below")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, table, "").collect()}
    assert left == {2 * k for k in range(len(sizes))} | {100, 101}
