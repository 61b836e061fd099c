"""Near copies by exact Jaccard similarity of shingle sets.

A text is the set of its shingles (runs of `SHINGLE` words, each by a 64-bit
hash); repeats within a text count once. Two texts are near copies where the
sets share `SIMILARITY` or more of their union. Every such pair is found:
with one order of all shingles, sets at 4/5 share one of the first n/5 + 1
of each (prefix filter), so texts meet by those. Any order is right; rare
shingles first is fast, so shingles that a sample of the texts repeats come
last, the most usual at the very end. Pairs whose sizes, or places of what
they share, rule the similarity out leave; all others are counted in full.

Groups are the components of the pairs, so a pair of texts that are connected
already is never counted. SimHash fingerprints (`simhash`) come first: each text is
counted with one that they link it to, and only what is similar becomes a group.
They miss pairs at 0.8, so what they leave apart is looked for by shingles. Shingles of few texts make pairs by a join, at most
`CROWDED` for each row; of these every text is first counted with the partner
it shares most with. Shingles of many texts make no pairs in a join: their texts
are compared with one of them, a few times with another one each time, and what is
then not connected meets in blocks inside tasks. A task looks at prefixes first,
counts whole sets as bits for the pairs that these leave possible, and returns one
edge per text and block pair at most, however many pairs are similar.

Defined results: a text of fewer words is one shingle; texts without words are
alike; null counts as the empty text. Long texts are held one at a time. Other
columns of any name stay as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import simhash
from .components import components, forest
from .embeddings import grouped
from .tables import staged

SHINGLE = 5
# Least Jaccard similarity as a fraction.
SIMILARITY = (4, 5)
# One text of so many is in the sample, and the usual shingles that tasks hold at most. Neither changes a result.
SAMPLE, USUAL = 8, 1 << 20
# A shingle in the prefixes of more texts is crowded; its texts are compared with one of them so many times.
CROWDED, STARS = 64, 3
# Texts whose sets a task holds at once, texts and shingles of a block, and cells of the table of a block's prefixes held at once.
TEXTS, BLOCK, WEIGHT, TABLE = 256, 2_048, 1 << 20, 1 << 22
# Pairs of a block that are counted before the groups take them in.
PAIRS = 1 << 17


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    own = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    size = min(size, len(own))
    total = np.full(len(own) - size + 1, size, np.uint64)
    for k in range(size):
        total = _mixed(total + own[k:len(own) - size + 1 + k])
    return np.unique(total.view(np.int64))


def _set_batches(batches, size: int):
    """(batch, start, sets) some texts at a time; texts are in the last column."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.column(batch.num_columns - 1).slice(at, TEXTS)
            yield batch, at, [shingles(one.as_py(), size) for one in part]


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))


def _usual(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that texts of the sample repeat, and in how many of them they are."""
    def run(batches):
        for _, _, sets in _set_batches(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], ["h"])

    some = texts.filter(F.pmod(F.xxhash64("work"), F.lit(SAMPLE)) == 0).select("work")
    counts = staged(some.mapInArrow(run, "h bigint").groupBy("h").count().filter("count > 1"), "usual-shingles")
    least, held = 2, 0
    for n, rows in sorted(map(tuple, counts.groupBy("count").agg(F.count("*")).collect()), reverse=True):
        held += rows
        if held > USUAL:
            least = n + 1
            break
    kept = counts.filter(F.col("count") >= least).toArrow().sort_by("h")
    return kept["h"].to_numpy(), kept["count"].to_numpy()


def _marked(texts: DataFrame, size: int) -> DataFrame:
    """texts (uid, work) -> (uid, n, key, prefix): number of shingles, digest of the set, its first shingles in their order."""
    shared = texts.sparkSession.sparkContext.broadcast(_usual(texts, size))
    p, q = SIMILARITY

    def run(batches):
        usual, times = shared.value
        for batch, at, sets in _set_batches(batches, size):
            prefix = []
            for h in sets:
                rank = np.zeros(len(h), np.int64)
                if len(usual):
                    place = np.minimum(np.searchsorted(usual, h), len(usual) - 1)
                    rank = np.where(usual[place] == h, times[place], 0)
                prefix.append(h[np.argsort(rank, kind="stable")[:len(h) + p * len(h) // -q + 1 if len(h) else 0]])
            keys = pa.array([hashlib.md5(h.tobytes()).digest() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array([len(h) for h in sets], pa.int32()), keys, _lists(prefix)],
                                             ["uid", "n", "key", "prefix"])

    return texts.mapInArrow(run, "uid bigint, n int, key binary, prefix array<bigint>")


def _sets(texts: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(uid, n, held) of the asked uids: their whole sets."""
    def run(batches):
        for batch, at, sets in _set_batches(batches, size):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array([len(h) for h in sets], pa.int32()), _lists(sets)], ["uid", "n", "held"])

    return texts.join(asked, "uid", "left_semi").select("uid", "work").mapInArrow(run, "uid bigint, n int, held array<bigint>")


def _may(na: str, nb: str, shared, place_a: str, place_b: str):
    """Whether two sets of these sizes can be similar with `shared` up to these places and what may follow."""
    p, q = SIMILARITY
    rest = F.least(F.col(na) - F.col(place_a), F.col(nb) - F.col(place_b)) - 1
    return (p + q) * (shared + rest) >= p * (F.col(na) + F.col(nb))


def _like_sizes(na: str, nb: str):
    p, q = SIMILARITY
    return (q * F.col(na) >= p * F.col(nb)) & (q * F.col(nb) >= p * F.col(na))


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    p, q = SIMILARITY
    pairs = staged(pairs.select("a", "b"), "asked-pairs")
    asked = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()
    sets = staged(_sets(texts, asked, size), "asked-sets")
    side = lambda c: sets.select(F.col("uid").alias(c), F.col("n").alias(f"n{c}"), F.col("held").alias(f"held_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("held_a", "held_b"))
    return staged(both.filter((p + q) * common >= p * (F.col("na") + F.col("nb"))).select("a", "b"), "similar-pairs")


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows (uid, ..) with the root of each text's group so far."""
    if roots is None:
        return rows.withColumn("root", F.col("uid"))
    return rows.join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))


def _apart(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs (a, b, ..) that no group holds yet."""
    if roots is None:
        return pairs
    for c in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    return pairs.filter("root_a != root_b").drop("root_a", "root_b")


def _rare_pairs(rare: DataFrame, crowds: DataFrame) -> DataFrame:
    """(a, b, shared) that may be similar, of shingles with few texts; `crowds` tells how many crowded ones a prefix has."""
    rare = rare.join(crowds, "uid", "left").withColumn("crowds", F.coalesce("crowds", F.lit(0)))
    side = lambda c: rare.select("h", F.col("uid").alias(c), *[F.col(n).alias(f"{n}_{c}") for n in ("n", "place", "crowds")])
    pairs = side("a").join(side("b"), "h").filter((F.col("a") < F.col("b")) & _like_sizes("n_a", "n_b"))
    counted = pairs.groupBy("a", "b").agg(F.any_value("n_a").alias("n_a"), F.any_value("n_b").alias("n_b"), F.count("*").alias("shared"),
                                          F.max("place_a").alias("place_a"), F.max("place_b").alias("place_b"),
                                          F.least(F.any_value("crowds_a"), F.any_value("crowds_b")).alias("more"))
    # rare ones up to the last shared place are counted whole, crowded ones may all be shared
    return counted.filter(_may("n_a", "n_b", F.col("shared") + F.col("more"), "place_a", "place_b")).select("a", "b", "shared")


def _star_pairs(crowded: DataFrame, turn: int) -> DataFrame:
    """Of each crowded shingle, one text with all others that it is not connected with."""
    first = F.min(F.struct(F.xxhash64("uid", F.lit(turn)).alias("draw"), F.col("uid").alias("b"), F.col("n").alias("nb"),
                           F.col("place").alias("place_b"), F.col("root").alias("other"))).alias("hub")
    hubs = crowded.groupBy("h").agg(first).select("h", "hub.*")
    pairs = crowded.select("h", F.col("uid").alias("a"), F.col("n").alias("na"), F.col("place").alias("place_a"), "root").join(hubs, "h")
    before = F.least("place_a", "place_b") + 1
    pairs = pairs.filter((F.col("root") != F.col("other")) & _like_sizes("na", "nb") & _may("na", "nb", before, "place_a", "place_b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _possible(one: dict, two: dict, columns: int, same: bool):
    """Row pairs of two blocks of texts in different groups whose prefixes leave the similarity possible."""
    p, q = SIMILARITY
    step = max(1, TABLE // max(len(two["n"]), 1) // 8)
    wide = max(1, TABLE // max(len(two["n"]), step, 1))
    for at in range(0, len(one["n"]), step):
        part = slice(at, at + step)
        na, nb = one["n"][part, None], two["n"][None, :]
        good = (one["root"][part, None] != two["root"][None, :]) & (q * na >= p * nb) & (q * nb >= p * na)
        if same:
            good &= np.arange(len(one["n"]))[part, None] < np.arange(len(two["n"]))[None, :]
        if not good.any():
            continue
        shared = np.zeros(good.shape, np.float32)
        for c in range(0, columns, wide):
            shared += _dense(one["prefix"], at, len(na), c, min(wide, columns - c)) @ _dense(two["prefix"], 0, nb.shape[1], c, min(wide, columns - c)).T
        # beyond the prefix that ends first in the order, at most the rest of that set is shared
        rest = np.maximum(na - one["length"][part, None], nb - two["length"][None, :])
        i, j = np.nonzero(good & ((p + q) * (shared + rest) >= p * (na + nb)))
        yield i + at, j


def _dense(cells: tuple[np.ndarray, np.ndarray], row: int, rows: int, column: int, columns: int) -> np.ndarray:
    """A part of the 0-1 matrix whose ones stand at `cells` (row, column)."""
    own = (cells[0] >= row) & (cells[0] < row + rows) & (cells[1] >= column) & (cells[1] < column + columns)
    out = np.zeros((rows, columns), np.float32)
    out[cells[0][own] - row, cells[1][own] - column] = 1
    return out


def _repeated(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column) of the values that several rows hold, and the number of columns."""
    lengths = lists.value_lengths().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), lengths)
    _, number, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    several = times > 1
    kept = several[number]
    return owner[kept], (np.cumsum(several) - 1)[number[kept]], int(several.sum())


def _similar(n: np.ndarray, owner: np.ndarray, column: np.ndarray, columns: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of rows are similar, by the bits of their whole sets, 16,384 columns at a time."""
    p, q = SIMILARITY
    shared = np.zeros(len(i), np.int64)
    for c in range(0, columns, 1 << 14):
        some = (column >= c) & (column < c + (1 << 14))
        words = min(columns - c, 1 << 14) // 64 + 1
        bits = np.zeros((len(n), words), np.uint64)
        place = column[some] - c
        np.bitwise_or.at(bits, (owner[some], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        step = max(1, (1 << 19) // words)
        for at in range(0, len(i), step):
            shared[at:at + step] += np.bitwise_count(bits[i[at:at + step]] & bits[j[at:at + step]]).sum(axis=1, dtype=np.int64)
    return (p + q) * shared >= p * (n[i] + n[j])


def _joined(n: int, possible, similar) -> np.ndarray:
    """The smallest row that each of n reaches over the similar ones of the possible pairs; pairs that are connected already are not counted."""
    label = np.arange(n)
    for i, j in possible:
        for at in range(0, len(i), PAIRS):
            a, b = i[at:at + PAIRS], j[at:at + PAIRS]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            good = similar(a, b)
            label = forest(n, np.concatenate([np.arange(n), a[good]]), np.concatenate([label, b[good]]))
    return label


def _block_links(crowded: DataFrame, rows: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b): edges that connect what is similar among the texts of a crowded shingle that are in different groups."""
    # all but the texts of the largest group meet all others; those of the largest do not meet each other
    who = [F.bit_xor(F.xxhash64("uid", F.lit(k))).alias(f"who_{k}") for k in (0, 1)]
    parts = crowded.groupBy("h", "root").agg(F.count("*").alias("m"), F.sum("n").alias("weight"), *who)
    sizes = parts.groupBy("h").agg(F.max_by(F.struct("root", "m", "weight"), F.struct("m", "root")).alias("major"), F.sum("m").alias("all"),
                                   F.sum("weight").alias("weight"), *[F.bit_xor(f"who_{k}").alias(f"who_{k}") for k in (0, 1)])
    blocks = lambda m, weight: F.ceil(F.greatest(m / BLOCK, weight / WEIGHT)).cast("int")
    # shingles with the same texts have the same pairs: one of them is enough
    sizes = sizes.filter("major.m < all").groupBy("who_0", "who_1", "all").agg(F.min(F.struct("h", "major", "weight")).alias("s")).select(
        "s.h", F.col("s.major.root").alias("major"), blocks(F.col("s.major.m"), F.col("s.major.weight")).alias("majors"),
        blocks(F.col("all") - F.col("s.major.m"), F.col("s.weight") - F.col("s.major.weight")).alias("minors"))
    met = staged(crowded.select("h", "uid", "root").join(sizes, "h"), "crowded-texts")
    sets = staged(_sets(texts, met.select("uid").distinct(), size), "crowded-sets")
    dealt = met.join(rows.select("uid", "prefix"), "uid").join(sets, "uid")
    drawn, minor = F.xxhash64("uid"), F.col("root") != F.col("major")
    dealt = dealt.withColumn("block", F.when(minor, F.pmod(drawn, F.col("minors"))).otherwise(F.col("minors") + F.pmod(drawn, F.col("majors"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(minor, F.col("minors") + F.col("majors")).otherwise(F.col("minors")) - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    keys = ["h", "low", "high"]
    dealt = dealt.select(*keys, "block", "uid", "root", "n", "prefix", "held").repartition(*keys).sortWithinPartitions(*keys, "block")

    def run(batches):
        held, now = [], None
        for batch in batches:
            for part, key in grouped(batch, keys):
                if key != now and held:
                    yield answer(held, now)
                    held = []
                now = key
                held.append(part)
        if held:
            yield answer(held, now)

    def answer(parts, key):
        table = pa.Table.from_batches(parts).combine_chunks()
        uid, root, n, block = (table[c].to_numpy() for c in ("uid", "root", "n", "block"))
        n = n.astype(np.int64)
        prefix, whole = (table[c].combine_chunks() for c in ("prefix", "held"))
        length = prefix.value_lengths().to_numpy().astype(np.int64)
        owner, column, columns = _repeated(prefix)

        def side(some):
            at = np.full(len(uid), -1)
            at[some] = np.arange(len(some))
            own = at[owner] >= 0
            return {"n": n[some], "root": root[some], "length": length[some], "prefix": (at[owner[own]], column[own])}

        one, two = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
        bits = _repeated(whole)
        possible = ((one[i], two[j]) for i, j in _possible(side(one), side(two), columns, key[1] == key[2]))
        label = _joined(len(uid), possible, lambda i, j: _similar(n, *bits, i, j))
        linked = np.flatnonzero(label != np.arange(len(uid)))
        return pa.RecordBatch.from_arrays([pa.array(uid[linked]), pa.array(uid[label[linked]])], ["a", "b"])

    return staged(dealt.mapInArrow(run, "a bigint, b bigint"), "block-links")


def _fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): each text with the first one of its fingerprint and the first one of all that fingerprints link."""
    marked = staged(simhash.marked(texts, "uid", "work"), "fingerprints")
    groups = marked.join(simhash.named(marked, "uid"), "fp")
    same = marked.groupBy("fp").agg(F.min("uid").alias("b"))
    pairs = groups.select(F.col("component_id").alias("b"), F.col("uid").alias("a")).unionByName(marked.join(same, "fp").select("b", F.col("uid").alias("a")))
    return pairs.filter("a != b").distinct()


def links(rows: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """rows (uid, n, key, prefix), texts (uid, work) -> (node, root) of all texts that are similar to another, by their groups."""
    copies = rows.groupBy("key").agg(F.min("uid").alias("b"), F.count("*").alias("times")).filter("times > 1").select("key", "b")
    equal = staged(rows.select("uid", "key").join(copies, "key").filter("uid != b").select(F.col("uid").alias("a"), "b"), "equal-sets")
    single = rows.select("uid", "n", "prefix").join(equal.select(F.col("a").alias("uid")), "uid", "left_anti")
    firsts = single.select("uid", "n", F.posexplode("prefix").alias("place", "h"))
    often = firsts.groupBy("h").agg(F.count("*").alias("texts")).filter("texts > 1")
    met = staged(firsts.join(often, "h"), "shared-shingles")
    rare, crowded = met.filter(F.col("texts") <= CROWDED), met.filter(F.col("texts") > CROWDED)
    crowds = crowded.groupBy("uid").agg(F.count("*").cast("int").alias("crowds"))

    def grown(roots: DataFrame, found: DataFrame) -> DataFrame:
        """Groups with further links: one edge per text stands for what is known."""
        return components(roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))

    pairs = staged(_rare_pairs(rare, crowds), "rare-pairs")
    roots = components(equal.unionByName(_confirmed(_fingerprint_pairs(texts), texts, size)))
    pairs = staged(_apart(pairs, roots), "apart-pairs")
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    roots = grown(roots, _confirmed(best, texts, size))
    roots = grown(roots, _confirmed(_apart(pairs.join(best, ["a", "b"], "left_anti"), roots), texts, size))
    if crowded.isEmpty():
        return roots
    for turn in range(STARS):
        found = _confirmed(_star_pairs(_rooted(crowded, roots), turn), texts, size)
        if found.isEmpty():
            break
        roots = grown(roots, found)
    return grown(roots, _block_links(_rooted(crowded, roots), rows, texts, size))


def representatives(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per group of near copies, that of the smallest id (nulls last; of repeated ids any one); columns as in `docs`."""
    packed = staged(docs.select(F.struct("*").alias("row")).withColumn("uid", F.monotonically_increasing_id()), "numbered")
    texts = packed.select("uid", F.coalesce(F.col("row")[text], F.lit("")).alias("work"))
    roots = links(staged(_marked(texts, size), "shingled"), texts, size).withColumnRenamed("node", "uid")
    # alone: in no group
    grouped = packed.select("uid", F.col("row")["doc_id"].alias("doc_id")).join(roots, "uid")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))["uid"].alias("keep")
    picked = grouped.groupBy("root").agg(first).select("keep")
    gone = grouped.select("uid").join(picked, F.col("uid") == F.col("keep"), "left_anti")
    return packed.join(gone, "uid", "left_anti").select("row.*")
