"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text is a sequence of words. A benchmark item is cut into windows of `span` consecutive words; an
item of fewer words, but not none, is one window of its own length. A document word is hit when it
lies inside an occurrence of such a window.

Per span length: the hashes of all k-grams of a text are winnowed (the smallest of each w
neighbouring k-grams is kept, with k + w - 1 = span), so that any shared run of span words leaves a
common fingerprint at the same place of the run. Document fingerprints are joined with benchmark
fingerprints; each meeting is extended to all windows of span words around it, and those are
compared with the item windows as text. Hash collisions cost time, not correctness.

Defined results: null and empty texts have no words and no hits; a null item id takes part in
hits but is not listed; repeated rows are computed alike and each returns its own row; an empty
benchmark hits nothing; a very long text is one array of words, of up to 2**31 places, and is held as a whole by
its task; empty tables give empty results; other columns of either table are ignored. A row is identified by its id
and a hash of its text, so repeated ids with different texts stay apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airtoll.llm.common import ascii_lower
from airtoll.sources.staging import staged

#: Fixed: everything that is not part of a word, after A-Z were lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A fingerprint is a number of 64 bits: 33 of the hash, 31 of the place of the k-gram.
PLACE_BITS = 31


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def gram_and_window(span: int) -> tuple[int, int]:
    """k and w with k + w - 1 = span, about equal."""
    k = (span + 1) // 2
    return k, span - k + 1


def fingerprints(df: DataFrame, hashes: str, span: int, *keep: str) -> DataFrame:
    """(keep, print, place) of the winnowed k-grams of an array of word hashes; null prints where there are none.

    explode_outer and when() instead of filters: a filter on the array would be moved below its
    definition and compute it a second time.
    """
    k, w = gram_and_window(span)
    h, n = F.col(hashes), F.size(hashes)
    mask = (1 << PLACE_BITS) - 1

    def gram(i: Column) -> Column:
        parts = [h[i + j] for j in range(k)]
        return F.xxhash64(F.lit(span), *parts).bitwiseAND(F.lit(-(mask + 1))).bitwiseOR(i.cast("long"))

    grams = df.select(*keep, F.when(n >= span, F.transform(F.sequence(F.lit(0), n - k), gram)).alias("__grams"))
    g = F.col("__grams")
    chosen = g if w == 1 else F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(g) - w),
                                                           lambda i: F.least(*[g[i + j] for j in range(w)])))
    return grams.select(*keep, F.explode_outer(F.when(g.isNotNull(), chosen)).alias("__p")).select(
        *keep, F.shiftright("__p", PLACE_BITS).alias("print"), F.col("__p").bitwiseAND(F.lit(mask)).cast("int").alias("place"))


def item_windows(benchmark: DataFrame, span: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, span, window): distinct windows of all items, as words joined by blanks."""
    w, n = F.col("__w"), F.size("__w")
    length = F.least(F.lit(span), n)
    return (benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("__w")).where(n > 0)
            .select("item", length.alias("span"),
                    F.explode(F.transform(F.sequence(F.lit(0), n - length),
                                          lambda i: F.array_join(F.slice(w, i + 1, length), " "))).alias("window"))
            .distinct())


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 10, doc: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, n_items, items (sorted texts), contaminated.

    text_key is the hash of the text that, with the id, identifies a row.
    """
    rows = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"),
                       words(F.col(text)).alias("__w"))
    windows = staged(item_windows(benchmark, span, item, item_text))
    spans = sorted(r["span"] for r in windows.select("span").distinct().collect())  # at most `span` numbers

    hashed = rows.select("doc_id", "text_key", F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"))
    # Items are fingerprinted window by window: each window of exactly s words has one fingerprint at least.
    item_hashes = windows.select("span", F.transform(F.split("window", " "), lambda x: F.xxhash64(x)).alias("__h"))
    meetings = []
    for s in spans:
        known = staged(fingerprints(item_hashes.where(F.col("span") == s), "__h", s).select("print").distinct())
        k, _ = gram_and_window(s)
        meetings.append(fingerprints(hashed, "__h", s, "doc_id", "text_key").join(known, "print", "left_semi")
                        .select("doc_id", "text_key", F.struct(F.lit(s).alias("span"), F.lit(s - k).alias("back"), "place").alias("at")))
    if meetings:
        met = (reduce(DataFrame.unionByName, meetings).groupBy("doc_id", "text_key")
               .agg(F.collect_set("at").alias("at")))  # bounded by the words of one document
    else:
        met = rows.sparkSession.createDataFrame([], "doc_id long, text_key long, at array<struct<span:int,back:int,place:int>>")
    met = staged(met)

    # Extend: all windows of the span around each meeting, as text.
    w, n = F.col("__w"), F.size("__w")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    near = rows.join(met, same(rows, met)).select(rows["doc_id"], rows["text_key"], w, n.alias("__n"), "at")
    starts = F.array_distinct(F.flatten(F.transform("at", lambda a: F.transform(
        F.sequence(F.greatest(a["place"] - a["back"], F.lit(0)), F.least(a["place"], F.col("__n") - a["span"])),
        lambda s: F.struct(s.alias("start"), a["span"].alias("span"))))))
    tried = (near.select("doc_id", "text_key", "__w", "__n", starts.alias("starts"))
             .select("doc_id", "text_key", F.explode(F.transform("starts", lambda s: F.struct(
                 s["start"].alias("start"), s["span"].alias("span"),
                 F.array_join(F.slice(w, s["start"] + 1, s["span"]), " ").alias("window")))).alias("t"))
             .select("doc_id", "text_key", F.col("t.start").alias("start"), F.col("t.span").alias("span"),
                     F.col("t.window").alias("window")).distinct())
    found = tried.join(windows, ["span", "window"])
    hits = staged(found.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "span")).alias("at"), F.collect_set("item").alias("items")))

    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a["start"], a["start"] + a["span"] - 1)))))
    hits = hits.select("doc_id", "text_key", covered.cast("long").alias("n_hit"), F.array_sort("items").alias("items"))
    counted = rows.select("doc_id", "text_key", n.cast("long").alias("n_words"))
    return (counted.join(hits, same(counted, hits), "left")
            .select(counted["doc_id"], counted["text_key"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"))
            .withColumn("n_items", F.greatest("n_items", F.lit(0).cast("long")))
            .withColumn("contaminated", F.col("n_hit") > 0))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = 10, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without a hit, with all their columns."""
    bad = staged(decontaminate(docs, benchmark, span, doc, text).where("contaminated").select("doc_id", "text_key").distinct())
    key = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(bad, docs[doc].eqNullSafe(bad["doc_id"]) & (key == bad["text_key"]), "left_anti")
