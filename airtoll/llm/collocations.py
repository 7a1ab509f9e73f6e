"""Phrase collocations by multikey three-way quicksort of suffixes, routed by their leading words.

A suffix is a word and those behind it in its piece, to a depth of `most_words` words. Two scans of the texts are made.

The first counts words, and pairs of words by a hash of 64 bits. Every part of a frequent phrase is
frequent, so a suffix counts only as far as its neighbouring pairs do. The second scan tests that by a bit
map of the hashes of frequent pairs. Its size is bounded, so it may let rare pairs pass, which costs rows
but no results. Equal suffixes are summed up where they are read and go, as text with a number, to a
route that the hash of their two leading words names. Pairs with more than `hot` occurrences are told
by a second bit map; their suffixes are routed by all their words instead, and their counts are sums
over routes.

On a route the suffixes, as pointers into columns of word numbers, are sorted by three-way partitioning
one word at a time. The weight of an equal partition is the count of its phrase; partitions lighter than the least
count are abandoned, but for phrases of two and three words behind hot pairs, of which every route has a part.

What follows works on the table of frequent phrases alone: joins with the counts of their parts, the
lowest score of all cuts, phrases inside longer ones, ranks per language. Products are decimals, as they may pass 64
bits.

Defined results: null texts count as empty, texts without words give nothing; a null language is `und`,
together with rows that name it so; each row counts, also if it repeats another; ids are not read; an
empty table gives an empty result; further columns are ignored. A text is cut at the ends of pieces into
parts of `chunk_bytes`; only a single piece longer than that is held as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airtoll.llm.near_dedup import mix
from airtoll.sources.staging import staged

#: Fixed: characters that end a piece; words are separated by the two others.
PIECE_ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
PLAIN = bytes.maketrans(PIECE_ENDS + BLANKS, b"\n" * len(PIECE_ENDS) + b" " * len(BLANKS))
TOKEN = re.compile(rb"[^ \n]+|\n")
#: Bits of the largest map, 16 MB.
MOST_BITS = 27
NO_WORD = -1


def chunks(parts: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[str, bytes]]:
    """(language, text) of neighbouring texts of one language, A-Z lower-cased, piece ends as line feeds, blanks as spaces."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for part in parts:
        for i in range(part.num_rows):
            data = (part.column(1)[i].as_py() or "").encode().lower().translate(PLAIN)
            lang = part.column(0)[i].as_py()
            while len(data) > chunk_bytes:
                at = data.rfind(b"\n", 0, chunk_bytes)
                at = at if at >= 0 else data.find(b"\n", chunk_bytes)
                if at < 0:
                    break
                yield lang, data[:at]
                data = data[at + 1:]
            held.setdefault(lang, []).append(data)
            size += len(data)
            if size > chunk_bytes:
                yield from ((k, b"\n".join(v)) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


class Words:
    """The words of a chunk as numbers: codes by place (NO_WORD between pieces), the distinct words and their hashes."""

    def __init__(self, lang: str, data: bytes):
        self.tokens = np.array(TOKEN.findall(data), dtype=object)
        codes, distinct = pd.factorize(self.tokens)
        end = np.flatnonzero(distinct == b"\n")
        if len(end):
            codes = np.where(codes == end[0], NO_WORD, codes - (codes > end[0]))
            distinct = np.delete(distinct, end[0])
        self.codes, self.distinct = codes, distinct
        head = lang.encode() + b"\n"
        self.hash = np.array([int.from_bytes(hashlib.blake2b(head + w, digest_size=8).digest(), "little") for w in distinct], np.uint64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the words that another word of their piece follows."""
        at = np.flatnonzero((self.codes[:-1] != NO_WORD) & (self.codes[1:] != NO_WORD))
        first, second = self.hash[self.codes[at]], self.hash[self.codes[at + 1]]
        return at, mix(first + mix(second))


def summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of them, number) of equal keys."""
    of, distinct = pd.factorize(keys)
    place = np.empty(len(distinct), np.int64)
    place[of] = np.arange(len(of))
    return place, np.bincount(of, minlength=len(distinct))


def first_counts(chunk_bytes: int):
    """(key, lang, word, n): words, hashed pairs (no lang, no word), all words of a language (no word)."""
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in chunks(parts, chunk_bytes):
            words = Words(lang, data)
            if not len(words.distinct):
                continue
            n = np.bincount(words.codes[words.codes != NO_WORD], minlength=len(words.distinct))
            _, hashes = words.pairs()
            place, many = summed(hashes)
            keys = np.concatenate([words.hash, [np.uint64(0)], hashes[place]]).view(np.int64)
            none = pa.nulls(len(place), pa.string())
            yield pa.RecordBatch.from_arrays([
                pa.array(keys), pa.concat_arrays([pa.array([lang] * (len(n) + 1), pa.string()), none]),
                pa.concat_arrays([pa.array(words.distinct, pa.binary()).cast(pa.string()), pa.nulls(1, pa.string()), none]),
                pa.array(np.concatenate([n, [n.sum()], many]))], schema=schema)
    return run


def bit_map(keys: DataFrame) -> np.ndarray:
    """64 bits a number, as many numbers as keep the map sparse, within the bound: a bit is set for each key."""
    bits = 1 << min(MOST_BITS, max(12, (8 * keys.count()).bit_length()))
    place = F.pmod("key", F.lit(bits))
    words = keys.groupBy(F.floor(place / 64).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {bits}) % 64 as int))")).alias("word"))
    found = words.toPandas()  # at most 2 ** (MOST_BITS - 6) rows
    out = np.zeros(bits // 64, np.uint64)
    out[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64).view(np.uint64)
    return out


def in_map(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(64 * len(words) - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def suffixes(frequent, hot, most_words: int, chunk_bytes: int):
    """(route, hot, lang, suffix, n): distinct suffixes of a chunk, as far as their neighbouring pairs are frequent."""
    schema = pa.schema([("route", pa.int64()), ("hot", pa.bool_()), ("lang", pa.string()), ("suffix", pa.string()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in chunks(parts, chunk_bytes):
            words = Words(lang, data)
            at, hashes = words.pairs()
            good = in_map(frequent.value, hashes)
            at, hashes = at[good], hashes[good]
            if not len(at):
                continue
            n = len(words.codes)
            goes_on = np.zeros(n + most_words, bool)
            goes_on[at] = True
            codes = np.concatenate([words.codes, np.full(most_words, NO_WORD)])
            size, more, key = np.full(len(at), 2), np.ones(len(at), bool), pd.factorize(hashes)[0]
            for k in range(1, most_words - 1):
                more = more & goes_on[at + k]
                size += more
                follower = np.where(more, codes[at + k + 1] + 1, 0)
                key = pd.factorize(key.astype(np.int64) * (len(words.distinct) + 1) + follower)[0]
            place, many = summed(key)
            at, size, route = at[place], size[place], hashes[place]
            deeper = in_map(hot.value, route)
            for k in range(2, most_words):
                behind = np.where(k < size, words.hash[np.maximum(codes[at + k], 0)], np.uint64(0))
                route = np.where(deeper, mix(route + behind), route)
            text = [b" ".join(words.tokens[a:a + s].tolist()) for a, s in zip(at.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(deeper), pa.array([lang] * len(text), pa.string()),
                                              pa.array(text, pa.binary()).cast(pa.string()), pa.array(many)], schema=schema)
    return run


def frequent_prefixes(columns: list[np.ndarray], weight: np.ndarray, least: int, whole: np.ndarray, from_depth: int) -> list[tuple[int, int, int]]:
    """(pointer, depth, weight) of the common prefixes of rows by multikey three-way quicksort.

    columns[d] has the number of the word at depth d of each row, NO_WORD behind the end. Partitions
    lighter than `least` are abandoned, but where the rows aren't whole: of those, prefixes short of the
    whole depth are told whatever they weigh. Prefixes are told from from_depth columns on.
    """
    out, depth_of_all = [], len(columns)
    todo = [(np.arange(len(weight)), 0)]
    while todo:
        rows, depth = todo.pop()
        if weight[rows].sum() < least and (whole[rows[0]] or depth + 1 == depth_of_all):
            continue
        keys = columns[depth][rows]
        pivot = keys[len(keys) // 2]
        below, above = keys < pivot, keys > pivot
        equal = rows[~(below | above)]
        todo += [(part, depth) for part in (rows[below], rows[above]) if len(part)]
        if pivot == NO_WORD:
            continue
        if depth + 1 >= from_depth:
            total = int(weight[equal].sum())
            if total >= least or not whole[equal[0]] and depth + 1 < depth_of_all:
                out.append((int(equal[0]), depth + 1, total))
        if depth + 1 < depth_of_all:
            todo.append((equal, depth + 1))
    return out


def sorted_counts(min_count: int, most_words: int):
    """(lang, phrase, words, n) of the suffixes of a route."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p for p in parts if p.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        del parts
        langs = rows["lang"].combine_chunks().dictionary_encode()
        words = pc.split_pattern(rows["suffix"].combine_chunks(), " ")
        offsets = words.offsets.to_numpy().astype(np.int64)
        codes = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
        begin, size = offsets[:-1] - offsets[0], np.diff(offsets)
        whole = ~rows["hot"].to_numpy()
        first = langs.indices.to_numpy().astype(np.int64) * 2 + whole  # rows of one partition are all whole or all in parts
        columns = [first] + [np.where(k < size, codes[np.minimum(begin + k, len(codes) - 1)], NO_WORD) for k in range(most_words)]
        found = frequent_prefixes(columns, rows["n"].to_numpy(), min_count, whole, 3)
        del columns
        if found:
            at, depth, total = (np.array(x) for x in zip(*found))
            texts = rows["suffix"].take(pa.array(at)).to_pylist()
            phrases = [" ".join(t.split(" ")[:d - 1]) for t, d in zip(texts, depth.tolist())]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(at)).cast(pa.string()), pa.array(phrases, pa.string()),
                                              pa.array(depth - 1, pa.int32()), pa.array(total, pa.int64())], schema=schema)
    return run


def frequent_phrases(docs: DataFrame, text: str, lang: str, min_count: int, most_words: int, hot: int, route_rows: int,
                     chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of up to most_words words that occur min_count times, and (lang, n) of all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counted = rows.mapInArrow(first_counts(chunk_bytes), "key long, lang string, word string, n long")
    is_all = F.col("word").isNull() & F.col("lang").isNotNull()
    counts = staged(counted.groupBy("key", "lang", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= min_count) | is_all))
    pairs = counts.where("lang is null")
    maps = [spark.sparkContext.broadcast(bit_map(p)) for p in (pairs, pairs.where(F.col("n") > hot))]
    routes = max(1, -(-(pairs.agg(F.sum("n")).first()[0] or 0) // route_rows))
    sent = rows.mapInArrow(suffixes(*maps, most_words, chunk_bytes), "route long, hot boolean, lang string, suffix string, n long")
    found = sent.repartition(routes, "route").mapInArrow(sorted_counts(min_count, most_words), "lang string, phrase string, words int, n long")
    phrases = found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    singles = counts.where("word is not null").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n")
    return staged(phrases.unionByName(singles)), counts.where(is_all).select("lang", F.col("n").alias("all_words"))


def decimal(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 30, most_words: int = 4, covered_percent: int = 80,
                 top: int = 2000, hot: int = 100_000, route_rows: int = 100_000, chunk_bytes: int = 2 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` best phrases of 2 to most_words words of each language.

    a is the count of the phrase, l and r those of the parts at its weakest cut, n the words of the
    language, score floor(2,000,000 a / (l + r)). Phrases whose words lie in a longer frequent phrase with covered_percent
    of their count are left out.
    """
    known, totals = frequent_phrases(docs, text, lang, min_count, most_words, hot, route_rows, chunk_bytes)
    phrases = known.where("words > 1")
    words = F.split("phrase", " ")
    numbers = F.sequence(F.lit(1), F.col("words") - 1)
    cuts = phrases.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(numbers).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice(words, F.col("k") + 1, F.col("words")), " ").alias("rest"))
    for part, n in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("n").alias(n)), ["lang", part])
    share = F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    scored = (cuts.withColumn("score", share).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
              .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    # Phrases inside longer ones: every part of two words or more.
    inner = F.explode(F.sequence(F.lit(2), F.col("words") - 1))
    parts = (phrases.where("words > 2").select("lang", "phrase", "words", "n", inner.alias("size"))
             .select("lang", "phrase", "n", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("from"))
             .select("lang", F.array_join(F.slice(words, F.col("from"), F.col("size")), " ").alias("phrase"), "n"))
    longer = parts.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    alone = F.col("longer").isNull() | (decimal("longer") * 100 < decimal("a") * covered_percent)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.join(longer, ["lang", "phrase"], "left").where(alone).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score")
