"""SimHash near-deduplication by a self-join of binary tries.

The fingerprint of a text has a bit set where over half of the XXH64 hashes of
its word shingles have it. Distinct fingerprints are linked when they differ in
at most `budget` bits: two such fingerprints agree in one of `budget + 1`
blocks of bits, so Spark deals them by (block, its value), and every task walks
the binary trie of its fingerprints against itself. Pairs of nodes go down
together, the differing bits of a pair add up, and a pair over the budget is
dropped with everything below it. A block value that very many fingerprints
share is dealt as pairs of its subtrees instead, of which again only those
within the budget exist. A task returns the links that connect what it found,
never all pairs of a dense group.

Defined results: null and empty texts, and texts without words, have
fingerprint zero, which links like any other; texts of fewer words than a
shingle hash their whole word sequence; equal fingerprints link; null ids take
part, but never name a component unless it holds nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components, forest
from .tables import staged, whole_text

SHINGLE = 3
SEED = 42
BITS = 64
BUDGET = 3
# Words hashed at once, node pairs held at once, fingerprints in one trie walk.
WORDS = 50_000
FRONTIER = 2_000_000
FOREST = 400_000
# A block value shared by more distinct fingerprints is dealt as pairs of subtrees.
HOT = 100_000
SPLIT_BITS = 6


def bit_counts(words: list[bytes], size: int) -> tuple[np.ndarray, int]:
    """How many shingles have each bit (highest first), and the number of shingles."""
    counts, total = np.zeros(BITS, np.int64), max(len(words) - size + 1, 1)
    digest = xxhash.xxh64_digest
    if len(words) < size:
        hashes = [digest(b" ".join(words), SEED)]
        return np.unpackbits(np.frombuffer(hashes[0], np.uint8)).astype(np.int64), 1
    for first in range(0, total, WORDS):
        part = words[first:first + WORDS + size - 1]
        line = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = (np.concatenate(([0], ends[:-1] + 1)))[:len(part) - size + 1].tolist()
        hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return counts, total


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint. bytes.lower and bytes.split know A-Z and the six ASCII spaces only."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    counts, total = bit_counts(words, size)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """`row` (all columns as a struct) and `fp`, the signed fingerprint."""
    packed = docs.select(F.struct("*").alias("row"), whole_text(text).alias("work"))
    out = packed.select("row", F.lit(0).cast("bigint").alias("fp")).schema

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["row", "fp"])

    return packed.mapInArrow(run, out)


def marked(docs: DataFrame, key: str, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """`key` and `fp` only; texts are held one at a time."""
    packed = docs.select(key, whole_text(text).alias("work"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py(), size) for t in batch.column(1)], pa.int64())], [key, "fp"])

    return packed.mapInArrow(run, packed.select(key, F.lit(0).cast("bigint").alias("fp")).schema)


class Levels:
    """The tries of several groups over sorted (group, key) rows, level by level.

    A node of depth d is a run of rows that share group and the first d bits; it
    is named by its number among the nodes of its depth.
    """

    def __init__(self, group: np.ndarray, key: np.ndarray):
        self.group, self.key, self.n = group, key, len(key)
        differ = key[1:] ^ key[:-1]
        # shared leading bits of neighbours, by halves as floats round; -1 where the group changes
        high = differ >> np.uint64(32)
        shared = np.where(high > 0, 32 - np.frexp(high.astype(np.float64))[1], 64 - np.frexp((differ & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])
        self.shared = np.concatenate(([-1], np.where(group[1:] != group[:-1], -1, shared)))
        self.cache: dict[int, np.ndarray] = {}

    def starts(self, depth: int) -> np.ndarray:
        if depth not in self.cache:
            self.cache[depth] = np.flatnonzero(self.shared < depth)
        return self.cache[depth]

    def children(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per node of `depth`: its first child, its number of children; per child its bit."""
        below = self.starts(depth + 1)
        first = np.searchsorted(below, self.starts(depth))
        number = np.diff(np.append(first, len(below)))
        bit = ((self.key[below] >> np.uint64(BITS - 1 - depth)) & np.uint64(1)).astype(np.int8)
        return first, number, bit


def walk(levels: Levels, depth: int, u: np.ndarray, v: np.ndarray, spent: np.ndarray, budget: int, limit: int = FRONTIER):
    """Yields row pairs (a, b) within the budget below the node pairs (u, v), which have `spent` bits."""
    tables = {}
    stack = [(depth, u, v, spent)]
    while stack:
        depth, u, v, spent = stack.pop()
        while depth < BITS and len(u):
            if len(u) > limit:
                for at in range(limit, len(u), limit):
                    stack.append((depth, u[at:at + limit], v[at:at + limit], spent[at:at + limit]))
                u, v, spent = u[:limit], v[:limit], spent[:limit]
            if depth not in tables:
                tables[depth] = levels.children(depth)
            first, number, bit = tables[depth]
            us, vs, ss = [], [], []
            for i in (0, 1):
                for j in (0, 1):
                    has = (number[u] > i) & (number[v] > j)
                    if i > j:
                        has &= u != v  # a node against itself: each pair of children once
                    a, b = first[u[has]] + i, first[v[has]] + j
                    s = spent[has] + (bit[a] != bit[b])
                    near = s <= budget
                    us.append(a[near]), vs.append(b[near]), ss.append(s[near])
            u, v, spent, depth = np.concatenate(us), np.concatenate(vs), np.concatenate(ss), depth + 1
            starts = levels.starts(depth)
            pairs = (u != v) | (np.diff(np.append(starts, levels.n))[u] > 1)  # a single row has no pair left
            u, v, spent = u[pairs], v[pairs], spent[pairs]
        if len(u):
            rows = levels.starts(BITS)
            apart = u != v
            yield rows[u[apart]], rows[v[apart]]


def connect(group: np.ndarray, pair: np.ndarray, key: np.ndarray, fp: np.ndarray, budget: int, block_bits: int, split_bits: int = SPLIT_BITS):
    """(fp, fp) links that connect what is linked within the groups; rows sorted by (group, key).

    `pair` is -1 for a whole group; else it names two subtrees, `split_bits`
    below the block, as high * 2**split_bits + low: only the pairs between them count.
    """
    levels = Levels(group, key)
    whole_nodes, deep = levels.starts(block_bits), block_bits + split_bits
    whole = np.flatnonzero(pair[whole_nodes] < 0)
    found_a, found_b = [], []

    def take(pairs):
        for a, b in pairs:
            found_a.append(a), found_b.append(b)
            if sum(map(len, found_a)) > FRONTIER:
                shrink()

    def shrink():
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        root = forest(len(key), a, b)
        moved = np.flatnonzero(root != np.arange(len(key)))
        found_a[:], found_b[:] = [moved], [root[moved]]

    take(walk(levels, block_bits, whole, whole, np.zeros(len(whole), np.int64), budget))
    if len(whole) < len(whole_nodes):
        nodes = levels.starts(deep)
        prefix = (key[nodes] >> np.uint64(BITS - deep)).astype(np.int64) & ((1 << split_bits) - 1)
        own, asked = group[nodes], pair[nodes]
        low, high = asked & ((1 << split_bits) - 1), asked >> split_bits
        lefts, rights = (np.flatnonzero((asked >= 0) & (prefix == side)) for side in (low, high))
        place = np.searchsorted(own[rights], own[lefts])
        met = (place < len(rights)) & (own[rights[np.minimum(place, len(rights) - 1)]] == own[lefts]) if len(rights) else np.zeros(len(lefts), bool)
        u, v = lefts[met], rights[place[met]]
        spent = np.bitwise_count((prefix[u] ^ prefix[v]).astype(np.uint64)).astype(np.int64)
        take(walk(levels, deep, u, v, spent, budget))
    if not found_a:
        return fp[:0], fp[:0]
    shrink()
    return fp[found_a[0]], fp[found_b[0]]


def links(distinct: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """(a, b) links between the distinct fingerprints `fp` that connect all within `budget` bits."""
    blocks = budget + 1
    width = BITS // blocks
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    turned = F.expr(f"shiftleft(fp, block * {width}) | shiftrightunsigned(fp, 64 - block * {width})")
    # shifts count modulo 64, so block 0 gives fp | fp
    rows = distinct.select("fp", block.alias("block")).withColumn("key", turned)
    rows = rows.withColumn("value", F.shiftrightunsigned("key", BITS - width))
    crowded = rows.groupBy("block", "value").count().filter(F.col("count") > hot).select("block", "value", F.lit(True).alias("hot"))
    rows = rows.join(crowded, ["block", "value"], "left")
    prefix = F.shiftrightunsigned("key", BITS - width - SPLIT_BITS).bitwiseAND((1 << SPLIT_BITS) - 1)
    partner = F.filter(F.transform(F.sequence(F.lit(0), F.lit((1 << SPLIT_BITS) - 1)), lambda i: i.cast("bigint")),
                       lambda i: F.bit_count(i.bitwiseXOR(F.col("prefix"))) <= budget)
    pairs = F.transform(partner, lambda i: F.greatest(i, F.col("prefix")) * (1 << SPLIT_BITS) + F.least(i, F.col("prefix")))
    rows = rows.withColumn("prefix", prefix).withColumn("pair", F.explode(F.when(F.col("hot"), pairs).otherwise(F.array(F.lit(-1).cast("bigint")))))
    dealt = rows.select("block", "value", "pair", "key", "fp").repartition("block", "value", "pair").sortWithinPartitions("block", "value", "pair", F.col("key").bitwiseXOR(F.lit(-1 << 63)))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            held.append(columns)
            size += len(columns[0])
            if size >= FOREST:
                joined = [np.concatenate(c) for c in zip(*held)]
                group = (joined[0] != joined[0][-1]) | (joined[1] != joined[1][-1]) | (joined[2] != joined[2][-1])
                cut = int(np.count_nonzero(group))  # the last group may go on
                if cut:
                    yield from answer([c[:cut] for c in joined])
                held, size = [[c[cut:] for c in joined]], len(joined[0]) - cut
        if size:
            yield from answer([np.concatenate(c) for c in zip(*held)])

    def answer(columns):
        block, value, pair, key, fp = columns
        fresh = np.concatenate(([True], (block[1:] != block[:-1]) | (value[1:] != value[:-1]) | (pair[1:] != pair[:-1])))
        a, b = connect(np.cumsum(fresh), pair, key.view(np.uint64), fp, budget, width)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def named(marked: DataFrame, doc_id: str = "doc_id", budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """(fp, root, component_id) of every fingerprint in `marked` (doc_id, fp)."""
    distinct = marked.groupBy("fp").agg(F.min(doc_id).alias("least"))
    roots = components(links(distinct.select("fp"), budget, hot))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(best, "root").select("fp", "root", "component_id")


def judged(docs: DataFrame, size: int = SHINGLE, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row."""
    marked = fingerprints(docs.select("doc_id", "text"), size=size).select(F.col("row")["doc_id"].alias("doc_id"), "fp")
    marked = staged(marked, "fingerprints")
    return marked.join(named(marked, "doc_id", budget, hot), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
