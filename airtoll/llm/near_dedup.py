"""Near-duplicate detection: MinHash with tensored banding, candidates confirmed on full sets.

A text's set holds its distinct shingles of five words (hashes of 64 bits). Two collections of `m`
small keys are computed, each key from `a` minhashes: 2 m a minhashes in all. Every pair of a left
and a right key forms the key of one of m * m tables of 2 a minhashes each, which would otherwise
need 2 a m * m minhashes. Texts collide if they share a left and a right key; at similarity s that
fails with a chance below 2 (1 - s^a)^m: 1.5e-5 at 0.85 for a = 4 and m = 16, and 4e-8 at 0.9.

Equal sets are one node from the start, so copies are never paired. Left keys that only one set has
are dropped before pairs of keys are formed. Each table key then links its sets to the smallest of
them; the components of these links are the candidate clusters, and every pair that collides is in
one. Texts of one template, alike by half, collide often enough to chain into one cluster; so clusters larger than
a block are first split by the minhashes themselves, a byte of each: pairs that agree in fewer than the
threshold less `slack` points don't chain (a pair at the threshold is lost by that with a chance of about 1e-6). Clusters are
confirmed on full sets recomputed from the texts: small ones are packed into bins
of bounded size, large ones are cut into blocks by hash, and each pair of blocks is a task of its
own. Inside a task an inverted index gives the exact intersections; only links that join two groups
leave it, never all pairs. Components of the confirmed links are the result.

Defined results: null texts, empty texts and texts of white space have an empty set and link with
nothing; a text of fewer words than a shingle is one shingle; rows that share an id are one document
for linking, each with its own n_shingles; rows with a null id link like others but never name a
component (component_id is null if no row of it has an id); very long texts are one set like others, in a block of
their own if need be; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airtoll.llm.common import one_of_repeated
from airtoll.llm.components import components
from airtoll.sources.staging import staged

#: Fixed: odd multipliers that mix 64 bits.
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Rows without an id are nodes beyond this number.
NO_ID = 1 << 62


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX_1
    x = (x ^ (x >> np.uint64(33))) * MIX_2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """Stable 64-bit hashes of words, remembered up to a bound."""

    MOST = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_set(text: str | None, known: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    k = min(size, n)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total = mix(total + h[i:n - k + 1 + i])
    return np.unique(total)


def parameters(functions: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed random (addend, odd factor) of each minhash function."""
    seeds = mix(np.arange(1, 2 * functions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:functions], seeds[functions:] | np.uint64(1)


def tensor_keys(sets: list[np.ndarray], a: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(len(sets), 2 m) small keys of non-empty sets, m left ones, then m right ones, and a byte of each of their 2 m a minhashes."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    add, factor = parameters(2 * m * a)
    keys, sketch = np.zeros((len(sets), 2 * m), np.uint64), np.empty((len(sets), 2 * m * a), np.uint8)
    for f in range(2 * m * a):
        hashed = (flat ^ add[f]) * factor[f]
        hashed ^= hashed >> np.uint64(32)
        hashed *= MIX_1
        least = np.minimum.reduceat(hashed, starts)
        keys[:, f // a] = mix(keys[:, f // a] + least + np.uint64(f))
        sketch[:, f] = mix(least) & np.uint64(255)
    return keys, sketch


def features(docs: DataFrame, doc: str, text: str, size: int, a: int, m: int) -> DataFrame:
    """(doc_id, node, text_key, n_shingles, n_chars, signature, left, right, sketch) of every row; no keys for empty sets."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()

        def done(rows, sets):
            frame = pd.DataFrame(rows, columns=["doc_id", "node", "text_key", "n_shingles", "n_chars", "signature"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            full = [i for i, s in enumerate(sets) if len(s)]
            left, right, sketch = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                keys, bytes_ = tensor_keys([sets[i] for i in full], a, m)
                for i, row, line in zip(full, keys.view(np.int64), bytes_):
                    left[i], right[i], sketch[i] = row[:m], row[m:], line.tobytes()
            frame["left"], frame["right"], frame["sketch"] = left, right, sketch
            return frame

        for part in parts:
            rows, sets, held = [], [], 0
            for doc_id, node, key, content in zip(part["doc_id"], part["node"], part["text_key"], part["text"]):
                s = shingle_set(content, known, size)
                signature = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                rows.append((None if pd.isna(doc_id) else int(doc_id), int(node), int(key), len(s), len(content or ""), signature))
                sets.append(s)
                held += len(s)
                if held > 1 << 18:
                    yield done(rows, sets)
                    rows, sets, held = [], [], 0
            if rows:
                yield done(rows, sets)

    return numbered(docs, doc, text).mapInPandas(run, "doc_id long, node long, text_key long, n_shingles long, n_chars long, signature binary, "
                                                      "left array<long>, right array<long>, sketch binary")


def node_of(doc: str, text: str) -> Column:
    """The id, or a large number from the text where it is null."""
    return F.coalesce(F.col(doc).cast("long"), F.shiftrightunsigned(F.xxhash64(F.col(text)), 2) + F.lit(NO_ID))


def numbered(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).cast("long").alias("doc_id"), node_of(doc, text).alias("node"), F.xxhash64(F.col(text)).alias("text_key"),
                       F.col(text).alias("text"))


def candidate_links(sets: DataFrame) -> DataFrame:
    """(a, b): each set and the smallest set that shares a left and a right key with it, for all pairs of keys."""
    lefts = sets.select("node", F.posexplode("left").alias("i", "key")).select("node", F.xxhash64("i", "key").alias("left_key"))
    shared = lefts.groupBy("left_key").agg(F.count("*").alias("n")).where("n > 1").select("left_key")
    alive = lefts.join(shared, "left_key", "left_semi")
    pairs = staged(alive.join(sets.select("node", "right"), "node").select("node", "left_key", F.posexplode("right").alias("j", "key"))
                   .select("node", F.xxhash64("left_key", "j", "key").alias("table_key")))
    least = pairs.groupBy("table_key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("table_key", "a")
    return pairs.join(least, "table_key").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def confirmed(nodes: list[int], sets: list[np.ndarray], side: list[int] | None, percent: int) -> list[tuple[int, int]]:
    """Links of sets with 100 * intersection >= percent * union that join two groups of them.

    side, if given, holds 0 or 1 per set, and only sets of different sides are compared.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    token = np.empty(len(flat), np.int64)
    token[order] = np.cumsum(first) - 1
    starts = np.concatenate([np.flatnonzero(first), [len(flat)]])
    posting = owner[order]  # by token, in the order of the sets
    ends = np.cumsum(sizes)
    group = np.arange(n)
    links = []
    sides = None if side is None else np.array(side)
    for x in range(1, n):
        mine = token[ends[x] - sizes[x]:ends[x]]
        low, length = starts[mine], starts[mine + 1] - starts[mine]
        low, length = low[length > 1], length[length > 1]
        if not len(low):
            continue
        steps = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        common = np.bincount(posting[np.repeat(low, length) + steps], minlength=n)[:x]
        union = sizes[x] + sizes[:x] - common
        good = (100 * common >= percent * union) & (group[:x] != group[x])
        if sides is not None:
            good &= sides[:x] != sides[x]
        for y in np.flatnonzero(good):
            if group[y] != group[x]:
                links.append((nodes[y], nodes[x]))
                group[group == group[x]] = group[y]
    return links


def likely(nodes: list[int], sketches: np.ndarray, side: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Links of sets of different sides, if there are two, that agree in so many minhashes and join two groups of them."""
    group, links, two = np.arange(len(nodes)), [], side.min() != side.max()
    for x in range(1, len(nodes)):
        good = (sketches[:x] == sketches[x]).sum(axis=1) >= least
        good &= group[:x] != group[x]
        if two:
            good &= side[:x] != side[x]
        for y in np.flatnonzero(good):
            if group[y] != group[x]:
                links.append((nodes[y], nodes[x]))
                group[group == group[x]] = group[y]
    return links


def likely_links(members: DataFrame, functions: int, percent: int, sketch_rows: int) -> DataFrame:
    """(a, b) of members (node, cluster, rows, sketch): pairs of a cluster whose share of equal minhashes is percent or more.

    A cluster is compared in pairs of blocks of sketch_rows sketches, a byte for each minhash; links that join two
    groups of a pair of blocks leave it.
    """
    blocks = F.ceil(F.col("rows") / sketch_rows).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = members.select("node", "cluster", "sketch", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    spread = spread.select("node", "cluster", "sketch", low.alias("low"), high.alias("high"), (F.col("own") == high).cast("int").alias("side"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        sketches = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), functions)
        inside = frame["low"].iloc[0] == frame["high"].iloc[0]
        side = np.zeros(len(frame), int) if inside else frame["side"].to_numpy()
        found = likely(frame["node"].tolist(), sketches, side, -(-functions * percent // 100)) if inside or len(set(side.tolist())) > 1 else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return spread.groupBy("cluster", "low", "high").applyInPandas(compare, "a long, b long")


def near_dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85, a: int = 4, m: int = 16,
               block_rows: int = 1024, block_chars: int = 4 << 20, sketch_rows: int = 8192, slack: int = 15) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id), signature."""
    rows = staged(features(docs, doc, text, size, a, m))
    sets = staged(rows.where("signature is not null").groupBy("signature").agg(
        F.min("node").alias("node"), F.max("n_chars").alias("n_chars"), F.first("left").alias("left"), F.first("right").alias("right"), F.first("sketch").alias("sketch")))
    clusters = components(candidate_links(sets))
    clustered = sets.select("node", "n_chars").join(clusters, "node").select("node", F.col("component").alias("cluster"), "n_chars")
    clustered = staged(clustered)

    def sized() -> DataFrame:
        totals = clustered.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))
        blocks = F.greatest(F.ceil(F.col("rows") / block_rows), F.ceil(F.col("chars") / block_chars)).cast("int")
        return staged(totals.select("cluster", "rows", "chars", F.least(blocks, F.col("rows")).cast("int").alias("blocks")))

    totals = sized()
    large = totals.where("blocks > 1").select("cluster", "rows")
    if large.limit(1).count():  # those fall apart by their sketches first
        members = clustered.join(large, "cluster").join(sets.select("node", "sketch"), "node")
        fine = components(staged(likely_links(members, 2 * a * m, percent - slack, sketch_rows)))
        parts = clustered.join(fine, "node").select("node", F.col("component").alias("cluster"), "n_chars")
        clustered = staged(clustered.join(large, "cluster", "left_anti").select("node", "cluster", "n_chars").unionByName(parts))
        totals = sized()
    bins = max(1, 8 * (totals.where("blocks = 1").agg(F.sum("chars")).first()[0] or 0) // block_chars)
    # A row of a cluster in one block goes to a bin; otherwise to the pairs of blocks that hold its own.
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = clustered.join(totals.select("cluster", "blocks"), "cluster").select("node", "cluster", "blocks", own.alias("own"), other.alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    place = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.xxhash64("cluster", low, high))
    spread = spread.select("node", "cluster", (F.col("blocks") > 1).alias("cut"), low.alias("low"), high.alias("high"),
                           (F.col("own") == F.col("high")).cast("int").alias("side"), place.alias("place"))

    def confirm(frame: pd.DataFrame) -> pd.DataFrame:
        known, out = WordHashes(), []
        frame = frame.sort_values(["cluster", "low", "high", "node"])
        rows_ = zip(frame["cluster"], frame["low"], frame["high"], frame["node"], frame["text"], frame["side"])
        for (_, i, j), members in groupby(rows_, key=lambda r: r[:3]):
            members = list(members)
            found = [shingle_set(r[4], known, size) for r in members]
            at = [k for k, s in enumerate(found) if len(s)]
            if len(at) > 1:
                out += confirmed([members[k][3] for k in at], [found[k] for k in at],
                                 [members[k][5] for k in at] if i != j else None, percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    texts = numbered(docs, doc, text).select("node", "text").join(spread, "node")
    links = texts.groupBy("cut", "place").applyInPandas(confirm, "a long, b long")
    final = components(staged(links)).where("node <> component")
    named = staged(sets.select("signature", "node").join(final, "node").select(F.col("signature").alias("__s"), "component"))
    # Equal sets without further links: the smallest node of several rows.
    same = staged(rows.where("signature is not null").groupBy("signature").agg(F.min("node").alias("node"), F.count("*").alias("n"))
                  .where("n > 1").select(F.col("signature").alias("__s"), F.col("node").alias("component")))
    label = same.join(named.withColumnRenamed("component", "linked"), "__s", "full").select(
        "__s", F.coalesce("linked", "component").alias("component"))
    component = F.coalesce("component", "node")
    return (rows.join(label, rows["signature"] == F.col("__s"), "left")
            .select("doc_id", "n_shingles", F.when(component < NO_ID, component).alias("component_id"),
                    (F.col("node") == component).alias("kept"), "node", "text_key"))


def keep_smallest(docs: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one document of each group, the smallest id, and its own columns.

    Of rows that repeat id and text the one whose columns come first as JSON stays.
    """
    judged = staged(near_dedup(docs, doc, text, **how).select("node", "text_key", "kept"))
    gone = judged.where("not kept").select("node", "text_key").distinct()
    stay = docs.join(gone, (node_of(doc, text) == gone["node"]) & (F.xxhash64(docs[text]) == gone["text_key"]), "left_anti")
    if judged.where("kept").groupBy("node", "text_key").count().where("count > 1").limit(1).count():
        stay = one_of_repeated(stay, F.col(doc), F.col(text))
    return stay
