"""Exact deduplication with Patricia tries as owners of groups.

Texts are normalised (A-Z lower-cased, null as empty) and inserted as full byte strings into
compressed radix tries, whose terminal nodes keep the owner's id and the number of rows. Every input
partition first fills tries of its own, so that a text that holds a third of all rows leaves it as
one entry; the entries are then dealt by length and content hash and merged in tries again. When a
trie grows beyond `spill_bytes`, its largest subtree is handed on and dropped; what belongs together
is summed up at the end, by length and sha256. No task holds more than the budget and one text.

Defined results: a null id is smaller than any other; rows that share text and owner's id are all
marked as kept, and owner_rows counts them; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airtoll.llm.common import ascii_lower, one_of_repeated
from airtoll.sources.staging import staged

ENTRY = "text binary, owner long, owner_rows long, n long"


class Node:
    __slots__ = ("edge", "children", "entry")

    def __init__(self, edge: bytes, entry=None):
        self.edge, self.children, self.entry = edge, {}, entry


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def better(a: tuple, b: tuple, largest: bool) -> tuple:
    """The entry of two for one text: (owner, rows of the owner, rows)."""
    n = a[2] + b[2]
    if a[0] == b[0]:
        return a[0], a[1] + b[1], n
    first = b[0] is None or (a[0] is not None and a[0] > b[0])
    return (a if first == largest else b)[:2] + (n,)


class Trie:
    """Compressed radix trie over byte strings."""

    NODE_BYTES = 300

    def __init__(self, largest: bool):
        self.root, self.largest, self.size = Node(b""), largest, 0

    def insert(self, text: bytes, entry: tuple) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = Node(text[at:], entry)
                self.size += len(text) - at + self.NODE_BYTES
                return
            if not text.startswith(child.edge, at):
                k = common_prefix(child.edge, text[at:at + len(child.edge)])
                middle = Node(child.edge[:k])
                child.edge = child.edge[k:]
                middle.children[child.edge[0]] = child
                node.children[text[at]] = middle
                self.size += self.NODE_BYTES
                child = middle
            at += len(child.edge)
            node = child
        node.entry = entry if node.entry is None else better(node.entry, entry, self.largest)

    @staticmethod
    def entries(node: Node, prefix: bytes) -> Iterator[tuple]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            text = prefix + node.edge
            if node.entry is not None:
                yield text, *node.entry
            stack.extend((child, text) for child in node.children.values())

    @staticmethod
    def weight(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.edge) + Trie.NODE_BYTES
            stack.extend(node.children.values())
        return total

    def largest_subtree(self) -> Iterator[tuple]:
        """Entries below the heaviest child of the root, which is dropped."""
        first, node = max(self.root.children.items(), key=lambda x: self.weight(x[1]))
        self.size -= self.weight(node)
        del self.root.children[first]
        return self.entries(node, b"")

    def all(self) -> Iterator[tuple]:
        return self.entries(self.root, b"")


def batches(entries: Iterator[tuple], schema: pa.Schema, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for row in entries:
        rows.append(row)
        size += len(row[0]) + 32
        if size > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


FULL = pa.schema([("text", pa.binary()), ("owner", pa.int64()), ("owner_rows", pa.int64()), ("n", pa.int64())])
SHORT = pa.schema([("text_sha256", pa.string()), ("n_bytes", pa.int64()), ("owner", pa.int64()),
                   ("owner_rows", pa.int64()), ("n", pa.int64())])


def merged(parts: Iterator[pa.RecordBatch], largest: bool, spill_bytes: int, first: bool) -> Iterator[tuple]:
    """Entries of the tries that a task fills with its rows."""
    trie = Trie(largest)
    for part in parts:
        columns = [part.column(i) for i in range(part.num_columns)]
        for i in range(part.num_rows):
            text = columns[0][i].as_py()
            if first:
                trie.insert(text.lower(), (columns[1][i].as_py(), 1, 1))  # lower() of bytes changes A-Z only
            else:
                trie.insert(text, tuple(c[i].as_py() for c in columns[1:]))
            while trie.size > spill_bytes and trie.root.children:
                yield from trie.largest_subtree()
    yield from trie.all()


def owners(docs: DataFrame, keep: str = "largest", doc: str = "doc_id", text: str = "text",
           spill_bytes: int = 64 << 20) -> DataFrame:
    """(text_sha256, n_bytes, keep_id, owner_rows, group_size): one row per distinct normalised text, staged.

    owner_rows counts the rows that hold keep_id; more than one means repeated rows.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is 'largest' or 'smallest', not {keep!r}")
    largest = keep == "largest"
    raw = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.col(doc).cast("long").alias("owner"))
    local = raw.mapInArrow(lambda parts: batches(merged(parts, largest, spill_bytes, True), FULL), ENTRY)
    dealt = local.repartition(F.octet_length("text"), F.xxhash64("text"))

    def digest(parts):
        for t, *entry in merged(parts, largest, spill_bytes, False):
            yield hashlib.sha256(t).hexdigest(), len(t), *entry

    pieces = dealt.mapInArrow(lambda parts: batches(digest(parts), SHORT),
                              "text_sha256 string, n_bytes long, owner long, owner_rows long, n long")
    by_owner = pieces.groupBy("text_sha256", "n_bytes", "owner").agg(F.sum("owner_rows").alias("owner_rows"), F.sum("n").alias("n"))
    rank = F.struct(F.col("owner").isNotNull(), F.col("owner"), F.col("owner_rows"))
    best = F.max(rank) if largest else F.min(rank)
    return staged(by_owner.groupBy("text_sha256", "n_bytes").agg(best.alias("best"), F.sum("n").alias("group_size"))
                  .select("text_sha256", "n_bytes", F.col("best.owner").alias("keep_id"),
                          F.col("best.owner_rows").alias("owner_rows"), "group_size"))


def mark(docs: DataFrame, groups: DataFrame, doc: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with the owner of each row's text; carry names further columns of docs to return.

    The groups of one row need no join partner: a row without one is alone.
    """
    several = groups.where("group_size > 1").select(F.col("text_sha256").alias("__sha"), "keep_id", "owner_rows", "group_size")
    normal = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc).alias("__id"), F.sha2(normal.cast("binary"), 256).alias("text_sha256"),
                       *[F.col(c).alias(f"__{i}") for i, c in enumerate(carry or [])])
    joined = rows.join(several, rows["text_sha256"] == several["__sha"], "left")
    alone = F.col("__sha").isNull()
    return joined.select(
        F.col("__id").alias("doc_id"), F.when(alone, F.col("__id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("__id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256",
        F.coalesce("owner_rows", F.lit(1).cast("long")).alias("owner_rows"),
        *[F.col(f"__{i}").alias(f"carried_{i}") for i in range(len(carry or []))])


def exact_dedup(docs: DataFrame, keep: str = "largest", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, owner_rows."""
    return mark(docs, owners(docs, keep, doc, text), doc, text)


def keep_owners(docs: DataFrame, keep: str = "largest", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without copies, with its own columns; of rows that repeat id and text the one whose columns come first as JSON."""
    groups = owners(docs, keep, doc, text)
    marked = mark(docs, groups, doc, text, docs.columns).where("kept")
    if groups.where("owner_rows > 1").limit(1).count():
        once, more = marked.where("owner_rows = 1"), one_of_repeated(marked.where("owner_rows > 1"), F.col("text_sha256"))
        marked = once.unionByName(more)
    return marked.select(*[F.col(f"carried_{i}").alias(c) for i, c in enumerate(docs.columns)])
