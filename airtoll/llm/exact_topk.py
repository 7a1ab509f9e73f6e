"""Exact search for the k largest inner products, by columnar branch and bound.

Components are turned into whole numbers, floor(scale * x). Vectors lie in blocks in vertical layout,
one row per dimension. A query adds up products dimension block by dimension block, those in which the
block's queries have the most mass first. After each, what is left of a product is bounded by the product of
the remaining norms: the k-th largest lower bound is a score that k candidates reach, and candidates
whose upper bound is below it are dropped, the columns of the others moved together. What is left after the last
dimensions is exact.

Rows are dealt evenly into blocks, whatever their ids, norms or contents, and queries (the rows whose
id a number divides) likewise. Each block of queries meets each group of candidate blocks in a task of
its own, which keeps k candidates per query; a window keeps the k best of those. So a task holds one block of
queries and one group of candidates, and the bytes moved grow with the number of query blocks. The pairs
of blocks are the whole work of a search of a stated set of queries against all rows.

Sums stay exact: of doubles as long as no partial sum can pass 2**53, else of Python's integers.

Defined results: vectors that are null or hold null, NaN or infinite components take no part; shorter
vectors count as filled up by zeros, an empty one scores 0; a null id is no query and ranks behind
other ids as a candidate; rows that repeat an id, vector included, are rows of their own, each with its own list,
and candidates of each other; ties go to the smaller id; scores beyond 64 bits are ranked by
their first 125 bits and returned as the nearest long; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airtoll.sources.staging import staged

#: Doubles hold whole numbers exactly up to here; the range of a long.
EXACT, LONG = float(1 << 53), (1 << 63) - 1
BLOCK = "block long, n long, dims long, kind string, ids binary, no_id binary, of binary, data binary"
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("dims", pa.int64()), ("kind", pa.string()),
                          *((c, pa.binary()) for c in ("ids", "no_id", "of", "data"))])


def smallest_kind(data: np.ndarray) -> str:
    """The narrowest type that holds whole numbers."""
    most = np.abs(data).max(initial=0)
    return "int16" if most < 1 << 15 else "int32" if most < 1 << 31 else "float64"


def block_row(block: int, ids: np.ndarray, no_id: np.ndarray, of: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """One block; data has a row per dimension, of numbers the rows that ids belong to."""
    kind = smallest_kind(data)
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
        (block, len(ids), len(data), kind, ids.tobytes(), no_id.tobytes(), of.tobytes(),
         np.ascontiguousarray(data.astype(kind)).tobytes()), BLOCK_SCHEMA)], schema=BLOCK_SCHEMA)


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, no_id, of, data (dimensions x vectors, doubles) of a block."""
    data = np.frombuffer(row["data"], row["kind"]).reshape(int(row["dims"]), int(row["n"])).astype(np.float64)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["no_id"], bool), np.frombuffer(row["of"], np.int64), data


def filled(vectors: list[np.ndarray]) -> np.ndarray:
    """Dimensions x vectors; shorter vectors end in zeros."""
    out = np.zeros((max((len(v) for v in vectors), default=0), len(vectors)))
    for i, v in enumerate(vectors):
        out[:len(v), i] = v
    return out


def pack(scale: float):
    """Rows of a partition as one block; vectors by id, those without one last."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, columns = [], []
        for part in parts:
            lists = part.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
            with np.errstate(over="ignore"):
                values = np.floor(values * scale)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = (bad[ends] == bad[ends - sizes]) & lists.is_valid().to_numpy(zero_copy_only=False)
            names = part.column(0).to_pylist()
            for i in np.flatnonzero(good).tolist():
                ids.append(names[i])
                columns.append(values[ends[i] - sizes[i]:ends[i]])
        if ids:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            no_id = np.array([ids[i] is None for i in order])
            block = TaskContext.get().partitionId()
            yield block_row(block, np.array([ids[i] or 0 for i in order], np.int64), no_id, (np.int64(block) << 32) + np.arange(len(order)),
                            filled([columns[i] for i in order]))
    return run


def pick_queries(every: int):
    """The vectors whose id `every` divides, as rows (id, of, vector)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                ids, no_id, of, data = opened(row)
                mine = np.flatnonzero(~no_id & (ids % every == 0))
                if len(mine):
                    yield pa.RecordBatch.from_pydict({"id": ids[mine], "of": of[mine], "vector": [data[:, i].tobytes() for i in mine.tolist()]})
    return run


def pack_queries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, of, vectors = [], [], []
    for part in parts:
        ids += part.column(0).to_pylist()
        of += part.column(1).to_pylist()
        vectors += [np.frombuffer(v, np.float64) for v in part.column(2).to_pylist()]
    if ids:
        yield block_row(TaskContext.get().partitionId(), np.array(ids, np.int64), np.zeros(len(ids), bool), np.array(of, np.int64), filled(vectors))


def best(query: np.ndarray, rest: np.ndarray, data: list[np.ndarray], norms: np.ndarray, out: np.ndarray, k: int,
         least: float) -> tuple[np.ndarray, np.ndarray]:
    """(columns, scores) of the candidates that can be among the k best, scores of at least `least`, columns in order.

    data holds the candidates by dimension block, norms those of the dimensions after each block; rest and
    query likewise. out marks a column that takes no part.
    """
    alive, total = np.flatnonzero(~out), np.zeros(len(out) - int(out.sum()))
    whole, at = not out.any(), 0
    for step, block in enumerate(data):
        part = query[at:at + len(block)]
        total = total + part @ (block if whole else block[:, alive])
        at += len(block)
        left = rest[step] * norms[step][alive] * (1 + 1e-9) if rest[step] else np.zeros(len(alive))
        if len(total) > k:
            lower = total - left
            least = max(least, np.partition(lower, len(lower) - k)[len(lower) - k])
        stay = total + left >= least
        if not stay.all():
            alive, total, whole = alive[stay], total[stay], False
    return alive, total


def ranked(score: np.ndarray, ids: np.ndarray, no_id: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if score.dtype == object:
        return np.array(sorted(range(len(score)), key=lambda j: (-score[j], no_id[j], ids[j], of[j]))[:k], np.int64)
    return np.lexsort([of, ids, no_id, -score])[:k]


def search(k: int, dims: int):
    """For one block of queries and one group of candidate blocks: the k best of the group, per query."""
    def run(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(blocks):
            q_ids, _, q_of, q_data = opened(queries.iloc[0].to_dict())
            n = len(q_ids)
            order = np.argsort(-np.square(q_data).sum(axis=1), kind="stable")
            held: list[list[tuple]] = [[] for _ in range(n)]
            least = np.full(n, -np.inf)
            for row in blocks.sort_values("block").to_dict("records"):
                ids, no_id, of, data = opened(row)
                used = order[order < len(data)]
                mine, data = q_data[used].T, data[used]
                if np.abs(mine).max(initial=0) * np.abs(data).max(initial=0) * max(len(used), 1) >= EXACT:
                    wide = np.vectorize(int, otypes=[object])
                    mine, data = wide(mine), wide(data)
                    chosen = [(np.flatnonzero(of != q_of[i]), (mine[i] @ data)[of != q_of[i]]) for i in range(n)]
                else:
                    cuts = range(0, max(len(used), 1), dims)
                    norms = [np.sqrt(np.square(data[c + dims:]).sum(axis=0)) for c in cuts]
                    rests = np.stack([np.sqrt(np.square(mine[:, c + dims:]).sum(axis=1)) for c in cuts], axis=1)
                    parts = [np.ascontiguousarray(data[c:c + dims]) for c in cuts]
                    chosen = [best(mine[i], rests[i], parts, norms, of == q_of[i], k, least[i]) for i in range(n)]
                for i, (at, score) in enumerate(chosen):
                    top = ranked(score, ids[at], no_id[at], of[at], k)
                    at, score = at[top], score[top]
                    if len(at) == k and score.dtype != object:
                        least[i] = max(least[i], score[-1])
                    held[i].append((score, ids[at], no_id[at], of[at]))
            for i in range(n):
                score, ids, no_id, of = (np.concatenate(x) for x in zip(*held[i]))
                top = ranked(score, ids, no_id, of, k)
                found += zip([int(q_ids[i])] * len(top), [int(q_of[i])] * len(top), [None if x else y for x, y in zip(no_id[top].tolist(), ids[top].tolist())],
                             of[top].tolist(), map(int, score[top].tolist()))
        out = pd.DataFrame(found, columns=["query_id", "query", "vec_id", "of", "score"], dtype=object)
        exact = out["score"].tolist()
        out["score"] = [max(-LONG - 1, min(LONG, s)) for s in exact]
        out["high"] = [max(-LONG - 1, min(LONG, s >> 62)) for s in exact]
        out["low"] = [s & ((1 << 62) - 1) for s in exact]
        return out.astype({c: "Int64" for c in out.columns})
    return run


def exact_topk(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, vec: str = "vec_id", embedding: str = "embedding",
               block_rows: int = 8192, query_rows: int = 4096, dims: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id `every` divides its k best other rows."""
    rows = vectors.select(F.col(vec).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    blocks = staged(rows.repartition(max(1, -(-rows.count() // block_rows))).mapInArrow(pack(scale), BLOCK))
    chosen = staged(blocks.mapInArrow(pick_queries(every), "id long, of long, vector binary"))
    queries = staged(chosen.repartition(max(1, -(-chosen.count() // query_rows))).mapInArrow(pack_queries, BLOCK))
    n_blocks, n_queries = (t.agg(F.max("block")).first()[0] for t in (blocks, queries))
    n_blocks, n_queries = (0 if n is None else n + 1 for n in (n_blocks, n_queries))
    together = min(8, max(1, n_blocks * n_queries // 1024))  # candidate blocks in a group, more if there are many pairs
    groups = max(1, -(-n_blocks // together))
    many = F.explode(F.sequence(F.lit(0), F.lit(max(n_queries - 1, 0))))
    candidates = blocks.withColumn("group", F.floor(F.col("block") / together).cast("int")).withColumn("queries", many)
    asked = queries.withColumn("queries", F.col("block").cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = asked.groupBy("queries", "group").cogroup(candidates.groupBy("queries", "group")).applyInPandas(
        search(k, dims), "query_id long, query long, vec_id long, of long, score long, high long, low long")
    order = Window.partitionBy("query").orderBy(F.desc("high"), F.desc("low"), F.col("vec_id").asc_nulls_last(), "of")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
