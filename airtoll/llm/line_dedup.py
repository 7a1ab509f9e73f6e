"""Substring deduplication by hashing lines, sentences or paragraphs.

A text is cut into units, each with the break that follows it. Units are normalised (A-Z
lower-cased, white space collapsed) and digested; over the whole corpus the occurrence with the
smallest (document, place) of each digest stays, all others are repeats. Repeats that follow each other
in a document make a run, and runs of min_words words or more are removed. Shorter ones stay: a line
alone is a heading, a greeting or a stock phrase that many clean documents share, while neighbouring
repeats are a passage, however short its lines are. Units without words belong to no run and end
none; inside a run they go with it. Offsets are those of the original text, in characters.

Only digests travel, never unit texts. They are reduced to their first occurrence (combined before
the shuffle) and then looked up by the units, a join whose large side adaptive execution may split,
so that a line that a third of all documents share is no large task. Runs are formed per document.

Defined results: null and empty texts have no units; null ids rank last; equal rows (id and text)
are treated alike, both keep what one of them would; a very long text is cut like any other, its
repeats are one group of the run step; an empty table gives an empty result; further columns are ignored. Units are
compared by 96 bits of their digest. The text is a part of a row's key only where ids repeat, as a hash of it
takes a fifth of what a unit sends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airtoll.sources.staging import staged

#: Fixed: what ends a unit.
ENDS = {"line": re.compile(r"\n"), "sentence": re.compile(r"[.!?][ \t\r\x0b\x0c]+|\n"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*")}


def cut(text: str, by: str = "line") -> Iterator[tuple[int, int]]:
    """(start, end) of each unit; together they cover the text."""
    start = 0
    for m in ENDS[by].finditer(text):
        yield start, m.end()
        start = m.end()
    if start < len(text):
        yield start, len(text)


def unit_key(unit: str) -> tuple[int, bytes]:
    """(words, digest) of the normalised unit."""
    words = unit.encode("utf-8", "surrogatepass").lower().split()
    return len(words), hashlib.blake2b(b" ".join(words), digest_size=12).digest()


def text_key(docs: DataFrame, doc: str, text: str) -> Column:
    """What tells apart rows that share an id: a hash of the text, or 0 where no id repeats."""
    repeated = docs.groupBy(doc).count().where("count > 1").limit(1).count()
    return F.xxhash64(F.col(text)) if repeated else F.lit(0).cast("long")


def units(docs: DataFrame, key: Column, doc: str = "doc_id", text: str = "text", by: str = "line") -> DataFrame:
    """(doc_id, text_key, place, words, start, end, digest): the units that have words, numbered by place."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("place", pa.int32()), ("words", pa.int32()), ("start", pa.int32()),
                        ("end", pa.int32()), ("digest", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for i in range(part.num_rows):
                content = part.column(2)[i].as_py()
                if not content:
                    continue
                doc_id, key = part.column(0)[i].as_py(), part.column(1)[i].as_py()
                place = 0
                for start, end in cut(content, by):
                    n, digest = unit_key(content[start:end])
                    if n:
                        rows.append((doc_id, key, place, n, start, end, digest))
                        place += 1
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(doc).cast("long").alias("doc_id"), key.alias("text_key"), F.col(text).alias("text")
                       ).mapInArrow(run, "doc_id long, text_key long, place int, words int, start int, end int, digest binary")


def repeated_runs(found: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_key, start, end, units): runs of neighbouring repeats with so many words."""
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "place")
    firsts = staged(found.groupBy("digest").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    repeats = (found.join(firsts, "digest").where(at != F.col("first")).groupBy("doc_id", "text_key", "place")
               .agg(F.min("words").alias("words"), F.min("start").alias("start"), F.min("end").alias("end")))  # once for equal rows
    number = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("place"))
    return (repeats.withColumn("run", F.col("place") - number).groupBy("doc_id", "text_key", "run")
            .agg(F.sum("words").alias("words"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("units"))
            .where(F.col("words") >= min_words).drop("words", "run"))


def line_dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", by: str = "line", min_words: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, n_removed (units), removed_chars, spans (start, end of runs), kept_text."""
    key = text_key(docs, doc, text)
    extra = (repeated_runs(staged(units(docs, key, doc, text, by)), min_words).groupBy("doc_id", "text_key")
             .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"), F.sum("units").alias("__units")))
    rows = docs.select(F.col(doc).cast("long").alias("__id"), key.alias("__key"), F.col(text).alias("__text"))
    joined = rows.join(extra, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__key") == F.col("text_key")), "left")
    whole = F.coalesce("__text", F.lit(""))
    spans = F.coalesce("__spans", F.array().cast("array<struct<start:int,end:int>>"))
    # What is kept: from the end of each removed span to the start of the next.
    edges = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.substr(
        F.col("__t"), F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["end"]) + 1,
        F.when(i == F.size("spans"), F.char_length("__t")).otherwise(F.get("spans", i)["start"])
        - F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["end"])))
    return (joined.select(F.col("__id").alias("doc_id"), whole.alias("__t"), spans.alias("spans"), F.coalesce("__units", F.lit(0)).alias("n_removed"))
            .select("doc_id", F.char_length("__t").cast("long").alias("n_chars"), "n_removed",
                    F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("removed_chars"), "spans",
                    F.when(F.size("spans") == 0, F.col("__t")).otherwise(F.array_join(edges, "")).alias("kept_text")))
