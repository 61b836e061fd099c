"""Exact deduplication: Patricia tries whose terminal nodes hold the owner of a text.

Each input task first folds its rows in a trie of its own and sends one row per
distinct text (so a text that fills a third of the table leaves every task
once). Those rows are dealt by length and content hash, and the tasks insert
the full byte strings into compressed radix tries. A trie that outgrows its
memory moves a whole subtree to a file of its own and folds that one later.

Defined results: a null text counts as the empty text; texts are equal when
identical; the owner is the row with the largest (or smallest) id, a null id
losing to any other; among rows with the same id the largest row by its printed
columns owns. Columns of any name pass.
"""

from __future__ import annotations

import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

# Bytes of labels that a trie holds before a subtree is moved to a file.
BUDGET = 64 << 20
# Bytes of text in one batch on its way out.
OUT_BYTES = 8 << 20
NODE_BYTES = 300


def shared_prefix(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of `label` stand in `text` from `at` on."""
    if text.startswith(label, at):
        return len(label)
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    __slots__ = ("label", "children", "entry", "file")

    def __init__(self, label: bytes, entry=None):
        self.label, self.children, self.entry, self.file = label, {}, entry, None


class Trie:
    """Texts with their owners; `merge(entry, entry)` decides between two."""

    def __init__(self, merge, budget: int = BUDGET, root: bytes = b""):
        self.merge, self.budget, self.held, self.top, self.spilled = merge, budget, 0, Node(root), False

    @property
    def full(self) -> bool:
        return self.held > self.budget

    def add(self, text: bytes, entry) -> None:
        node, at = self.top, 0
        while True:
            if node.file is not None:
                pickle.dump((text[at:], entry), node.file)
                return
            if at == len(text):
                node.entry = entry if node.entry is None else self.merge(node.entry, entry)
                return
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = Node(text[at:], entry)
                self.held += len(text) - at + NODE_BYTES
                return
            n = shared_prefix(child.label, text, at)
            if n < len(child.label):  # the edge parts here
                fork = Node(child.label[:n])
                child.label = child.label[n:]
                fork.children[child.label[0]] = child
                node.children[text[at]] = child = fork
                self.held += NODE_BYTES
            node, at = child, at + n

    def _sizes(self) -> dict[int, int]:
        order, sizes = [self.top], {}
        for node in order:
            order.extend(node.children.values())
        for node in reversed(order):
            sizes[id(node)] = NODE_BYTES + len(node.label) + sum(sizes[id(c)] for c in node.children.values())
        return sizes

    def spill(self) -> None:
        """Moves the heaviest subtree of at most half the held bytes to a file; later texts below it follow."""
        sizes, node = self._sizes(), self.top
        while True:
            child = max(node.children.values(), key=lambda c: sizes[id(c)], default=None)
            if child is None:
                return  # one single text: nothing to part from
            node = child
            if not node.children or sizes[id(node)] <= self.held // 2:
                break
        out = tempfile.TemporaryFile()  # this task's own; gone with it
        for record in self._below(node):
            pickle.dump(record, out)
        self.held -= sizes[id(node)] - len(node.label) - NODE_BYTES
        node.children, node.entry, node.file, self.spilled = {}, None, out, True

    def _below(self, top: Node):
        """(rest of text, entry) of everything below a node, its own entry with an empty rest."""
        stack = [(top, b"")]
        while stack:
            node, path = stack.pop()
            if node.entry is not None:
                yield path, node.entry
            if node.file is not None:
                yield from ((path + rest, entry) for rest, entry in self._records(node.file))
            stack.extend((c, path + c.label) for c in node.children.values())

    @staticmethod
    def _records(file):
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                file.close()
                return

    def items(self):
        """(text, entry) of all texts, each once; files are folded in tries of their own, one after the other."""
        stack = [(self.top, self.top.label)]
        while stack:
            node, path = stack.pop()
            if node.file is not None:
                below = Trie(self.merge, self.budget)
                for rest, entry in self._records(node.file):
                    below.add(rest, entry)
                    if below.full:
                        below.spill()
                yield from ((path + rest, entry) for rest, entry in below.items())
            if node.entry is not None:
                yield path, node.entry
            stack.extend((c, path + c.label) for c in node.children.values())


def owners(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", budget: int = BUDGET) -> DataFrame:
    """One row per distinct text: `row` (the owner's columns as a struct), `bytes` (its text) and `group_size`."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns if c != text], F.col(text).isNull().alias("_null_text")).alias("row"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"), F.lit(1).cast("bigint").alias("group_size"))
    schema = StructType([rows.schema["row"], StructField("bytes", BinaryType()), StructField("group_size", LongType())])
    sign = 1 if keep == "largest" else -1

    def order(row: dict):
        key = row[doc_id]
        return (key is not None, key * sign if key is not None else 0, repr(row))

    def merge(a, b):
        return (a[0] if order(a[0]) >= order(b[0]) else b[0], a[1] + b[1])

    def packed(items, fields: pa.Schema):
        held, size = [], 0
        for content, (row, n) in items:
            held.append({"row": row, "bytes": content, "group_size": n})
            size += len(content) + NODE_BYTES
            if size >= OUT_BYTES:
                yield pa.RecordBatch.from_pylist(held, schema=fields)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=fields)

    def fold(partial: bool):
        def run(batches):
            trie, fields = Trie(merge, budget), None
            for batch in batches:
                fields = batch.schema
                for row, content, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    trie.add(content.as_py(), (row, n))
                    if trie.full and partial:
                        yield from packed(trie.items(), fields)
                        trie = Trie(merge, budget)
                    elif trie.full:
                        trie.spill()
            if fields is not None:
                yield from packed(trie.items(), fields)
        return run

    dealt = rows.mapInArrow(fold(True), schema).repartition(F.length("bytes"), F.xxhash64("bytes"))
    return dealt.mapInArrow(fold(False), schema)


def unique_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """The owner's row of each distinct text, with the columns of `docs` in their order."""
    found = owners(docs, text, doc_id, keep)
    content = F.when(~F.col("row")["_null_text"], F.col("bytes").cast("string"))
    return found.select(*[content.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def judged(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """Every row with the owner of its text: doc_id, keep_id, group_size, kept, text_sha256.

    Rows meet their owner by the text's SHA-256; a row stays if its id is the
    owner's, so rows repeated with the same id and text count as one that stays.
    """
    own = owners(docs.select("doc_id", "text"), keep=keep).select(
        F.unhex(F.sha2("bytes", 256)).alias("sha"), F.col("row")["doc_id"].alias("keep_id"), "group_size")
    rows = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("sha"))
    return rows.join(own, "sha").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))
