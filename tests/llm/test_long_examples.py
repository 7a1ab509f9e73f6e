"""Long texts: encoded as they would be as a whole, learnt from in whole pieces."""

import random

import numpy as np
from pyspark.sql import functions as F

from airtoll.llm import chat, toxicity


def test_long_texts_have_the_ids_of_the_whole_text(monkeypatch):
    codec = chat.Codec.of(chat.vocabulary())
    r = random.Random(1)
    alphabet = ["a", "word", "it's", " ", "  ", "\n", "\n\n ", "1", "23", "é", "漢字", "!'s", ".", "\t", " ", "\x1c", "　", "'", "_"]
    for size in (3, 20, 100):
        monkeypatch.setattr(chat, "PIECE", size)
        for _ in range(300):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 150)))
            assert "".join(chat.pieces(text)) == text
            assert codec.encode(text) == codec.encoding.encode_ordinary(text)


def test_very_long_words_and_white_space():
    codec = chat.Codec.of(chat.vocabulary())
    plain = " ".join(f"word{i}" for i in range(40_000))
    assert codec.encode(plain) == codec.encoding.encode_ordinary(plain) and len(list(chat.pieces(plain))) > 3
    for text in ("x" * 300_000, " " * 700_000, "a" + "\n" * 250_001 + "b " * 50_000 + " " * 200_000 + "c", "漢" * 150_000):
        assert "".join(chat.pieces(text)) == text and codec.decode(codec.encode(text)) == text


def test_very_long_texts_are_examples(spark, monkeypatch):
    long = "".join(f"{i:04d} " for i in range(200))  # a thousand characters
    table = spark.createDataFrame([(0, long), (1, long[:80]), (2, None), (3, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.extend(zip(texts, np.asarray(y).tolist())))
    toxicity.train(table, labels, F.lit(True), piece_chars=10, pieces=8)
    assert ("short", 1) in seen and (long[:80], 1) in seen and len(seen) == 3
    pieces = next(t for t, y in seen if y == 0)
    assert len(pieces) == 8 * 10 + 7 and all(pieces[k:k + 10] in long for k in range(0, len(pieces), 11))
    starts = [long.index(pieces[k:k + 10]) for k in range(0, len(pieces), 11)]
    assert starts == sorted(set(starts)) and all(s % 10 == 0 for s in starts)
