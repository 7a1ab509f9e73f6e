"""Mixing sources to target weights by temperature.

Source shares of tokens are raised to an exponent and normalised. The exponent is found by
bisection: the flattest mixture whose entropy does not exceed a target share of the greatest
possible one, or in which no source is repeated more often than a limit. One aggregation over the table of
sources tries 17 exponents at once, which are four halvings of the interval, so that table, too,
may be of any size.

Weights are realised as budgeted block permutations: a source with weight w and n tokens is passed
w * budget / n times. Whole passes take every document. For the rest of a pass the documents of a
source are dealt into blocks by a seeded hash, and blocks are taken in a seeded order as long as they fit
into the rest of the budget. Of the block that doesn't fit, documents are taken in the order of their hash,
those that are too long for what room is left being passed over. What is left then, less than any other document of
that block, goes to the shortest other documents of the source. So a source stays below its budget by less
than its shortest document that got no place; `shortfall` tells by how much. A source has at most
`most_blocks` blocks, so neither the order of blocks nor that of documents in one block needs more than a small
part of a source in a task.

Tokens are words (runs of characters other than white space) of whole texts.

Defined results: a null source is a source of its own; null and empty texts have no tokens, are
copied with every whole pass and get a place in the rest of one, if there is a rest; equal rows (id and text)
share their place and are taken together, as one document; null ids are hashed like any other; an empty table
gives an empty result, one without tokens copies of 1; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airtoll.sources.staging import staged

#: Places of a hash: thirteen hexadecimal digits.
DIGITS = 13


def place(*parts: Column) -> Column:
    """A number from 0 to 1 by the digest of some values."""
    digest = F.md5(F.concat_ws("|", *(c.cast("string") for c in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16 ** DIGITS))


def measured(docs: DataFrame, doc: str, text: str, source: str, seed: int) -> DataFrame:
    """(doc_id, source, key, n_tokens, at): at is the place of a document in its source, 0 to 1."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"),
                       F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("key"),
                       F.regexp_count(whole, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
                       place(F.lit(seed), F.col(doc), whole).alias("at"))


def find_exponent(sources: DataFrame, budget_share: float, entropy: float | None, repeats: float | None, sections: int = 16,
                  passes: int = 8) -> float:
    """The smallest exponent from 0 to 1 that keeps the limit; 1 (shares as they are) if none does.

    entropy: at most this part of the logarithm of the number of sources. repeats: no source is
    passed more often. Both fall as the exponent rises from 0 to 1 if shares differ.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give a target entropy or a repetition limit")
    p = F.col("p")
    shares = sources.where("n_tokens > 0").select((F.col("n_tokens") / F.col("total")).alias("p"))
    low, high = 0.0, 1.0
    for step in range(passes):  # each is log2(sections) halvings
        tried = [low + (high - low) * i / sections for i in range(sections + 1)]
        found = []
        for i, a in enumerate(tried):
            found += [F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{i}"),
                      F.max(F.pow(p, F.lit(a - 1))).alias(f"r{i}")]
        got = shares.agg(F.count("*").alias("n"), *found).first()
        if not got["n"]:
            return 1.0

        def kept(i: int) -> bool:
            z = got[f"z{i}"]
            if repeats is not None:
                return budget_share * got[f"r{i}"] / z <= repeats
            h = max(0.0, math.log(z) - tried[i] * got[f"l{i}"] / z)
            return h <= entropy * math.log(got["n"]) + 1e-12

        first = next((i for i in range(sections + 1) if kept(i)), None)
        if first is None:
            return 1.0
        if first == 0:
            return tried[0]
        low, high = tried[first - 1], tried[first]
    return high


def first_fit(frame: pd.DataFrame) -> pd.DataFrame:
    """The documents of one block that get a place: in their order, each that fits into what room is left."""
    frame = frame.sort_values("at")
    room, fits = int(frame["room"].iloc[0]), []
    for size in frame["size"].tolist():
        fits.append(size <= room)
        room -= size if fits[-1] else 0
    return frame.loc[np.array(fits), ["key", "at", "size"]]


def shortest_first(left: DataFrame, rooms: DataFrame) -> DataFrame:
    """(key, at, size) of the shortest documents left that fit into the room of their source, equal sizes by place."""
    small = staged(left.join(rooms, "key").where((F.col("room") > 0) & (F.col("size") <= F.col("room"))))
    sizes = small.groupBy("key", "size", "room").agg(F.count("*").alias("n"))
    before = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    fit = F.when(F.col("size") == 0, F.col("n")).otherwise(F.floor((F.col("room") - F.coalesce("before", F.lit(0))) / F.col("size")))
    many = sizes.withColumn("before", before).withColumn("many", fit).where("many > 0").select("key", "size", "n", "many")
    some = small.join(many, ["key", "size"])
    # Of the one size that doesn't fit as a whole the first places: per block, then of all.
    cut = some.where("many < n")
    for keys in (("key", "block"), ("key",)):
        cut = (cut.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("at")))
               .where(F.col("nth") <= F.col("many")))
    return some.where("many >= n").select("key", "at", "size").unionByName(cut.select("key", "at", "size"))


def mix(docs: DataFrame, budget_share: float = 1.0, entropy: float | None = None, repeats: float | None = None, seed: int = 17,
        block_tokens: int = 100_000, most_blocks: int = 4096, doc: str = "doc_id", text: str = "text",
        source: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, n_tokens, weight, block, copies (0 and more), block_rank, place, shortfall.

    weight and shortfall (tokens of the budget that no document filled) are those of the source.
    block_rank (from 1) is that of the block in the seeded order of its source, place (0 to 1) that of the
    document in the source's hash order, more by 1 where the document was passed over, so that those of
    its block that got a place go first: sorted by (block_rank, place) a source is permuted.
    """
    rows = staged(measured(docs, doc, text, source, seed))
    totals = rows.groupBy("key").agg(F.sum("n_tokens").alias("n_tokens"))
    total = totals.agg(F.sum("n_tokens")).first()[0] or 0
    totals = staged(totals.withColumn("total", F.lit(max(total, 1)).cast("double")))
    exponent = find_exponent(totals, budget_share, entropy, repeats)
    power = F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens") / F.col("total"), F.lit(exponent))).otherwise(0.0)
    z = totals.agg(F.sum(power)).first()[0] or 1.0
    passes = F.when(F.col("n_tokens") > 0, F.col("weight") * F.lit(budget_share * total) / F.col("n_tokens")).otherwise(1.0)
    blocks = F.least(F.greatest(F.ceil(F.col("n_tokens") / block_tokens), F.lit(1)), F.lit(most_blocks)).cast("int")
    whole = F.floor(F.col("passes") + 1e-9)
    plan = staged(totals.withColumn("weight", power / F.lit(z)).withColumn("passes", passes).select(
        "key", F.round("weight", 9).alias("weight"), blocks.alias("blocks"), whole.cast("long").alias("whole"),
        F.greatest(F.floor((F.col("passes") - whole) * F.col("n_tokens") + 1e-3), F.lit(0)).cast("long").alias("rest")))
    placed = rows.join(plan, "key").withColumn("block", F.least(F.floor(F.col("at") * F.col("blocks")), F.col("blocks") - 1).cast("int"))

    # Blocks in a seeded order; those that end within the rest are taken whole, the next one is cut.
    sums = staged(placed.groupBy("key", "block").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest")))
    order = Window.partitionBy("key").orderBy(place(F.lit(seed + 1), F.col("key"), F.col("block")), "block")
    behind = (sums.withColumn("end", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("block_rank", F.row_number().over(order)))
    start = F.col("end") - F.col("tokens")
    taken = staged(behind.select("key", "block", "block_rank", ((F.col("rest") > 0) & (F.col("end") <= F.col("rest"))).alias("taken"),
                                 ((F.col("end") > F.col("rest")) & (start < F.col("rest"))).alias("cut"), (F.col("rest") - start).alias("room")))
    documents = staged(placed.groupBy("key", "block", "at").agg(F.sum("n_tokens").alias("size"))
                       .join(taken.where("not taken"), ["key", "block"]).select("key", "block", "at", "size", "cut", "room"))
    fitting = staged(documents.where("cut").groupBy("key").applyInPandas(first_fit, "key string, at double, size long"))
    rooms = _less(taken.where("cut").select("key", "room"), fitting)
    left = documents.select("key", "block", "at", "size").join(fitting.select("key", "at"), ["key", "at"], "left_anti")
    short = staged(shortest_first(left, rooms))
    shortfall = _less(rooms, short).withColumnRenamed("room", "shortfall")
    chosen = fitting.unionByName(short).select("key", "at", F.lit(True).alias("chosen"))
    extra = F.col("taken") | F.coalesce("chosen", F.lit(False))
    behind_others = (F.col("cut") & ~extra).cast("double")
    return (placed.join(taken.select("key", "block", "block_rank", "taken", "cut"), ["key", "block"]).join(chosen, ["key", "at"], "left")
            .join(shortfall, "key", "left").select(
                "doc_id", "source", "n_tokens", "weight", "block", (F.col("whole") + extra.cast("long")).alias("copies"),
                "block_rank", (F.col("at") + behind_others).alias("place"), F.coalesce("shortfall", F.lit(0)).cast("long").alias("shortfall")))


def _less(rooms: DataFrame, used: DataFrame) -> DataFrame:
    """rooms (key, room) without what the documents of a source used."""
    sizes = used.groupBy("key").agg(F.sum("size").alias("used"))
    return staged(rooms.join(sizes, "key", "left").select("key", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")))


def shares(mixed: DataFrame) -> DataFrame:
    """(source, n_docs, n_tokens, mixed_tokens, weight, shortfall): what a mixture gives per source."""
    return mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"),
                                       F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.first("weight").alias("weight"),
                                       F.first("shortfall").alias("shortfall"))
