"""What the driver gets to train on: one row per sampled id, of texts that may be examples."""

import numpy as np
from pyspark.sql import functions as F

from airtoll.llm import quality, toxicity


def test_repeated_ids_are_one_example(spark, monkeypatch):
    rows = [(i, f"text number {i}") for i in range(6)] + [(1, f"another text {k}") for k in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.update(toxic=sorted(y.tolist())))
    monkeypatch.setattr(quality, "grow", lambda x, y: seen.update(quality=sorted(y.tolist())))
    toxicity.train(table, labels, F.lit(True))
    quality.train(table, labels, F.lit(True))
    assert seen == {"toxic": [0, 0, 0, 1, 1, 1], "quality": [0, 0, 0, 1, 1, 1]}


def test_long_texts_take_no_place_in_the_sample(spark, monkeypatch):
    table = spark.createDataFrame([(i, "long " * 50 if i < 38 else "short") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.extend(zip(texts, np.asarray(y).tolist())))
    toxicity.train(table, labels, F.lit(True), per_class=1, most_chars=100)
    assert sorted(seen) == [("short", 0), ("short", 1)]
