"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions. Each of the 255 decision points (bits of
the byte so far) has a context tree over the bytes before it, up to `DEPTH`
back; a node keeps how often 0 and 1 followed, which gives its
Krichevsky-Trofimov estimate. A node's weighted probability is half its own
estimate and half the product of its children's, so the mixture over all
depths and all prunings of the tree has closed weights, and the probability of
a bit is the sum over the depths on its path.

All training text is counted: tasks fold their byte grams, Spark adds them up,
and every node counts, however rare. All nodes from depth `NEAR` on below one
context of `NEAR` bytes stand together, so the grams are dealt by these bytes, and
tasks fold the trees there from the leaves up. Only the sums of the depths above,
whose number the alphabet bounds, are folded on the driver. Each gram that any text
has thus gets its log probability as a row of a table. The usual ones are
broadcast (`GRAMS` at most) and tasks score whole texts with them; the rare grams
of a text leave the task and get theirs by a join.

A text ends with an end symbol, begins after start symbols, and its score is
the log10 probability of its bytes and the end. A smoothed unigram model of
words is given beside it.

Defined results: null and empty texts are the end alone; without training text
every bit has probability one half and the base is 0; ids with null bucket as
the empty text; repeated rows are trained on and scored each.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .tables import bucket_of, staged, whole_text

FOLDS, HELD_OUT = 10, 0
DEPTH = 5
# Symbols outside UTF-8: before the first byte, and after the last.
START, END = b"\xfe", b"\xff"
# Least share of a word whose count goes to the tasks, and grams whose values go there at most. Neither changes a result.
WORD_SHARE, GRAMS = 2.0 ** -20, 1 << 21
# Bytes of context that the grams are dealt by, and grams whose trees a task folds at once (those of one context together).
NEAR, FOLD = 3, 1 << 17
# Bytes in one array, distinct grams and words a task holds before it sends them, and slots of the table of grams.
CHUNK, HELD, HELD_WORDS, SLOTS = 1 << 20, 2_000_000, 500_000, 22
ALPHA = 0.1
LN10 = math.log(10)


# ---- symbols and words ---------------------------------------------------------------------------

def segments(texts: list[bytes], depth: int = DEPTH):
    """Lists of (row, bytes) of about CHUNK bytes; the first `depth` bytes of each are context only."""
    held, size = [], 0
    for row, text in enumerate(texts):
        data = START * depth + text + END
        for at in range(0, len(text) + 1, CHUNK):
            part = data[at:at + CHUNK + depth]
            held.append((row, part))
            size += len(part)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def grams(held: list[tuple[int, bytes]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Per symbol its row, and its context and itself as one number (itself in the lowest byte)."""
    data = np.frombuffer(b"".join(part for _, part in held), np.uint8).astype(np.int64)
    code = data.copy()
    for k in range(1, depth + 1):
        code[k:] |= data[:-k] << (8 * k)
    sizes = np.array([len(part) for _, part in held])
    own = np.ones(len(data), bool)
    begin = np.cumsum(sizes) - sizes
    for k in range(depth):
        own[begin + k] = False
    return np.repeat([row for row, _ in held], sizes)[own], code[own]


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # A-Z, and the six ASCII spaces


def word_hashes(words) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh64_digest(w) for w in words]), np.int64)


END_WORD = int(word_hashes([b""])[0])


# ---- counting ------------------------------------------------------------------------------------

def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.add.reduceat(counts, first)


def counted(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, code, n) of all grams (kind 0) and words (kind 1, by hash) of the column `bytes`.

    A second column, if there is one, tells which texts are held out; only their grams are counted, as kind 2.
    """
    def run(batches):
        parts, words, held = {0: [], 2: []}, Counter(), {0: 0, 2: 0}
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column(0)]
            apart = batch.column(1).to_pylist() if batch.num_columns > 1 else [False] * len(texts)
            learnt = [t for t, x in zip(texts, apart) if not x]
            for text in learnt:
                words.update(words_of(text))
            words[b""] += len(learnt)
            for kind, own in ((0, learnt), (2, [t for t, x in zip(texts, apart) if x])):
                for some in segments(own, depth):
                    found = np.unique(grams(some, depth)[1], return_counts=True)
                    parts[kind].append(found)
                    held[kind] += len(found[0])
                    if held[kind] > HELD:
                        parts[kind] = [merged(parts[kind])]
                        held[kind] = len(parts[kind][0][0])
                        if held[kind] > HELD:
                            yield rows(kind, *parts[kind][0])
                            parts[kind], held[kind] = [], 0
            if len(words) > HELD_WORDS:
                yield word_rows(words)
                words = Counter()
        for kind in parts:
            if parts[kind]:
                yield rows(kind, *merged(parts[kind]))
        words = +words
        if words:
            yield word_rows(words)

    def word_rows(words):
        return rows(1, word_hashes(words), np.fromiter(words.values(), np.int64, len(words)))

    def rows(kind, codes, counts):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), kind, np.int8)), pa.array(codes), pa.array(counts)], ["kind", "code", "n"])

    return texts.mapInArrow(run, "kind tinyint, code bigint, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def tree_nodes(counts: DataFrame, least: float, depth: int = DEPTH) -> DataFrame:
    """(node, zeros, ones) of the nodes with `least` symbols or more, and of all roots, for `Trees`, which holds them in one place.

    `node` is depth, context and decision point in one number. `judged` uses neither: `gram_values` folds all nodes.
    """
    by_depth = counts.filter("kind = 0").select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"), "code", "n")
    cut = F.expr("code & (shiftleft(1L, 8 * (depth + 1)) - 1)")
    by_depth = by_depth.select("depth", cut.alias("code"), "n").groupBy("depth", "code").agg(F.sum("n").alias("n"))
    bits = by_depth.select("depth", "code", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    symbol, context = F.expr("cast(code & 255 as int)"), F.expr("shiftright(code, 8)")
    bits = bits.select("depth", context.alias("context"), symbol.alias("symbol"), "k", "n")
    point = F.expr("shiftleft(1, k) | shiftright(symbol, 8 - k)")
    node = F.expr("shiftleft(cast(depth as bigint), 48)").bitwiseOR(F.shiftleft("context", 8)).bitwiseOR(F.col("point").cast("bigint"))
    bits = bits.withColumn("point", point).select("depth", node.alias("node"), F.expr("shiftright(symbol, 7 - k) & 1").alias("bit"), "n")
    found = bits.groupBy("depth", "node").agg(F.sum(F.expr("if(bit = 0, n, 0)")).alias("zeros"), F.sum(F.expr("if(bit = 1, n, 0)")).alias("ones"))
    return found.filter((F.col("zeros") + F.col("ones") >= least) | (F.col("depth") == 0)).select("node", "zeros", "ones")


# ---- the trees -----------------------------------------------------------------------------------

def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, x.tolist()), np.float64, len(x))


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    out = np.full(len(zeros), -math.log(math.pi))
    for at in range(0, len(zeros), 1 << 16):  # few boxed numbers at once
        z, o = zeros[at:at + (1 << 16)], ones[at:at + (1 << 16)]
        out[at:at + len(z)] += _log_gamma(z + 0.5) + _log_gamma(o + 0.5) - _log_gamma(z + o + 1.0)
    return out


# log gamma of n + 1/2 and of n + 1 for the counts that most nodes have
_HALVES, _WHOLES = (np.array([math.lgamma(n + x) for n in range(1 << 12)]) for x in (0.5, 1.0))


def kt_counts(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """`kt_log` of whole numbers, most of them small."""
    both = zeros + ones
    small = both < len(_WHOLES)
    out = np.empty(len(both))
    out[small] = _HALVES[zeros[small]] + _HALVES[ones[small]] - _WHOLES[both[small]] - math.log(math.pi)
    out[~small] = kt_log(zeros[~small].astype(np.float64), ones[~small].astype(np.float64))
    return out


def _weighted(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of nodes whose children's trees multiply to `below` (leaves: None): estimate of a one, weight of the own estimate, log of the tree."""
    own = kt_counts(zeros, ones)
    one = (ones + 0.5) / (zeros + ones + 1)
    if below is None:
        return one, np.ones(len(own)), own
    tree = np.logaddexp(own, below) + math.log(0.5)
    return one, np.exp(math.log(0.5) + own - tree), tree


def _first(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))


def paths(code: np.ndarray, depth: int) -> list[np.ndarray]:
    """Per decision, the grams' deepest nodes: decision point and context, nearest byte first, so that 8 bits less name the parent."""
    symbol, context = code & 255, np.zeros(len(code), np.int64)
    for k in range(1, depth + 1):
        context = (context << 8) | ((code >> (8 * k)) & 255)
    return [(((1 << k) | (symbol >> (8 - k))) << (8 * depth)) | context for k in range(8)]


def folded(code: np.ndarray, n: np.ndarray, depth: int, near: int):
    """Trees of grams from the leaves up to depth `near`, whose contexts must be whole.

    Gives the chance of a one of each gram's decisions from there on (a row per gram), and the nodes at `near` (id, zeros, ones, log
    of the tree). Grams that no training text has (n = 0) change nothing: the estimate of an empty node is one half.
    """
    chance, nodes = np.empty((len(code), 8)), []
    for k, path in enumerate(paths(code, depth)):
        order = np.argsort(path, kind="stable")
        at, bit, times = path[order], ((code >> (7 - k)) & 1)[order], n[order]
        zeros, ones, tree, above, value = np.where(bit, 0, times), np.where(bit, times, 0), None, None, None
        for d in range(depth, near - 1, -1):
            first = _first(at)
            zeros, ones = np.add.reduceat(zeros, first), np.add.reduceat(ones, first)
            one, weight, tree = _weighted(zeros, ones, None if tree is None else np.add.reduceat(tree, first))
            number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
            above = number if above is None else number[above]
            value = one[above] if value is None else weight[above] * one[above] + (1 - weight[above]) * value
            ids, at = at[first], at[first] >> 8
        chance[order, k] = value
        nodes.append((ids, zeros, ones, tree))
    return chance, tuple(np.concatenate(c) for c in zip(*nodes))


def gram_values(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(code, times, value) of all counted grams: how often any text has them, and their log10 probability by the training texts."""
    near = min(NEAR, depth)
    dealt = counts.filter("kind != 1").withColumn("near", F.expr(f"shiftright(code, 8) & {(1 << 8 * near) - 1}"))
    dealt = dealt.repartition("near").sortWithinPartitions("near")
    bits = [f"b{k}" for k in range(8)]

    def run(batches):
        held, size, limit = [], 0, FOLD
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= limit:
                table = pa.Table.from_batches(held)
                contexts = table["near"].to_numpy()
                whole = int(np.searchsorted(contexts, contexts[-1]))
                if whole:
                    yield from answers(table.slice(0, whole))
                held, size = table.slice(whole).to_batches(), len(table) - whole
                limit = max(FOLD, 2 * size)
        if size:
            yield from answers(pa.Table.from_batches(held))

    def answers(table):
        code, number = np.unique(table["code"].to_numpy(), return_inverse=True)
        n, learnt = table["n"].to_numpy(), table["kind"].to_numpy() == 0
        times, own = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        np.add.at(times, number, n)
        np.add.at(own, number[learnt], n[learnt])
        chance, (ids, zeros, ones, tree) = folded(code, own, depth, near)
        none, void = pa.nulls(len(code), pa.int64()), pa.nulls(len(ids), pa.float64())
        names = ["id", "times", "zeros", "ones", "tree", *bits]
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(times), none, none, pa.nulls(len(code), pa.float64()), *[pa.array(chance[:, k].copy()) for k in range(8)]], names)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(zeros), pa.array(ones), pa.array(tree), *[void] * 8], names)

    out = "id bigint, times bigint, zeros bigint, ones bigint, tree double, " + ", ".join(f"{b} double" for b in bits)
    found = staged(dealt.mapInArrow(run, out), "folded")
    # contexts of fewer bytes than NEAR: as many as the alphabet makes, however long the texts are
    upper = found.filter("times is null").groupBy(F.expr("shiftright(id, 8)").alias("id")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "tree")]).toArrow().sort_by("id")
    ids, zeros, ones, below = (upper[c].to_numpy() for c in ("id", "zeros", "ones", "tree"))
    levels = []
    for _ in range(near):
        one, weight, tree = _weighted(zeros, ones, below)
        levels.append((ids, one, weight))
        first = _first(ids >> 8) if len(ids) else np.zeros(0, np.int64)
        ids = ids[first] >> 8
        zeros, ones, below = (np.add.reduceat(c, first) if len(first) else c for c in (zeros, ones, tree))
    shared = counts.sparkSession.sparkContext.broadcast(levels)

    def finish(batches):
        for batch in batches:
            code = batch.column(0).to_numpy()
            total = np.zeros(len(code))
            for k, path in enumerate(paths(code, depth)):
                chance = batch.column(2 + k).to_numpy()
                for up, (ids, one, weight) in enumerate(shared.value, depth - near + 1):
                    at = np.searchsorted(ids, path >> (8 * up))
                    chance = weight[at] * one[at] + (1 - weight[at]) * chance
                total += np.log10(np.where((code >> (7 - k)) & 1, chance, 1 - chance))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total)], ["code", "times", "value"])

    rows = found.filter("times is not null").select("id", "times", *bits)
    return staged(rows.mapInArrow(finish, "code bigint, times bigint, value double"), "gram-values")


class Trees:
    """Sorted nodes with the estimate of a one, the weight of the own estimate, and the rest's estimate."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, depth: int = DEPTH):
        self.depth, order = depth, np.argsort(node)
        self.node, zeros, ones = node[order], zeros[order].astype(np.float64), ones[order].astype(np.float64)
        own = kt_log(zeros, ones) if len(node) else np.zeros(0)
        level = self.node >> 48
        self.one = (ones + 0.5) / (zeros + ones + 1)
        self.weight, self.rest = np.ones(len(node)), np.full(len(node), 0.5)
        below, rest = np.zeros(len(node)), np.stack([zeros, ones])
        has = np.zeros(len(node), bool)
        for d in range(depth, -1, -1):
            at = np.flatnonzero(level == d)
            inner = at[has[at]]
            left = rest[:, inner]
            self.rest[inner] = (left[1] + 0.5) / (left.sum(axis=0) + 1)
            tree = own.copy()
            half = math.log(0.5)
            tree[inner] = np.logaddexp(half + own[inner], half + below[inner] + (kt_log(*left) if len(inner) else 0))
            self.weight[inner] = np.exp(half + own[inner] - tree[inner])
            if d:
                parent = np.searchsorted(self.node, self.above(self.node[at], d - 1))
                np.add.at(below, parent, tree[at])
                np.add.at(rest, (slice(None), parent), -np.stack([zeros[at], ones[at]]))
                has[parent] = True

    @staticmethod
    def above(node: np.ndarray, depth: int) -> np.ndarray:
        """The ancestors of nodes at `depth`."""
        return (node & ((1 << (8 * (depth + 1))) - 1)) | (depth << 48)

    def log10(self, code: np.ndarray) -> np.ndarray:
        """Log10 probability of the last byte of each gram after the others."""
        symbol, context = code & 255, (code >> 8) << 8
        total = np.zeros(len(code))
        if not len(self.node):
            return total + 8 * math.log10(0.5)
        for k in range(8):
            point, bit = (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1
            chance, left = np.zeros(len(code)), np.ones(len(code))
            rest, alive = np.full(len(code), 0.5), np.ones(len(code), bool)
            for d in range(self.depth + 1):
                want = self.above(context | point, d)
                at = np.minimum(np.searchsorted(self.node, want), len(self.node) - 1)
                found = alive & (self.node[at] == want)
                chance += np.where(alive & ~found, left * rest, 0)  # below the nodes that exist
                weight = self.weight[at]
                chance += np.where(found, left * weight * self.one[at], 0)
                left = np.where(found, left * (1 - weight), left)
                rest, alive = np.where(found, self.rest[at], rest), found
            total += np.log10(np.where(bit == 1, chance, 1 - chance))
        return total


class Table:
    """Log probabilities of grams seen before, in slots that newer grams take over."""

    def __init__(self, trees: Trees, bits: int = SLOTS):
        self.trees, self.bits = trees, bits
        self.code, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)

    def log10(self, code: np.ndarray) -> np.ndarray:
        slot = ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out, new = self.value[slot], np.flatnonzero(self.code[slot] != code)
        if len(new):
            fresh, where = np.unique(code[new], return_inverse=True)
            value = self.trees.log10(fresh)
            out[new] = value[where]
            self.code[slot[new]], self.value[slot[new]] = code[new], out[new]
        return out


class Known:
    """Values of grams, looked up by slots in which the most usual gram stands, and by search where another one does."""

    def __init__(self, code: np.ndarray, value: np.ndarray, order: np.ndarray, bits: int = SLOTS):
        """`code` ascends; `order` are its places, the most usual last."""
        self.code, self.value, self.bits = code, value, bits
        self.at = np.zeros(1 << bits, np.int32)
        self.at[self.slot(code[order])] = order

    def slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def values(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, whether it is known) of each gram; 0 where it is not."""
        if not len(self.code):
            return np.zeros(len(code)), np.zeros(len(code), bool)
        at = self.at[self.slot(code)]
        other = np.flatnonzero(self.code[at] != code)
        at[other] = np.minimum(np.searchsorted(self.code, code[other]), len(self.code) - 1)
        known = np.ones(len(code), bool)
        known[other] = self.code[at[other]] == code[other]
        return np.where(known, self.value[at], 0.0), known


# one table per worker and model
_KNOWN: dict[int, Known] = {}


def _known(model) -> Known:
    if model.id not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[model.id] = Known(*(model.value[c] for c in ("gram", "value", "order")))
    return _KNOWN[model.id]


# ---- scoring -------------------------------------------------------------------------------------

class _Shared:
    """A broadcast with a name, so that workers know it again."""

    def __init__(self, spark, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def _usual(values: DataFrame, most: int):
    """The values of the most usual grams, at most so many, by code, with their places from the least usual on."""
    bucket = F.floor(F.log2(F.col("times")) * 8).cast("int")
    least, held = 0, 0
    for n, rows in sorted(map(tuple, values.groupBy(bucket).count().collect()), reverse=True):
        held += rows
        if held > most:
            least = n + 1
            break
    kept = values.filter(bucket >= least).toArrow().sort_by("code")
    return kept["code"].to_numpy(), kept["value"].to_numpy(), np.argsort(kept["times"].to_numpy(), kind="stable").astype(np.int32)


def fit(rows: DataFrame, depth: int = DEPTH) -> tuple[_Shared, DataFrame, DataFrame, dict]:
    """rows (bytes, held_out) -> the broadcast model, the values of all grams of any row (code, value), the counts of all words
    (code, n), and the sizes of the training text."""
    counts = staged(counted(rows, depth), "counts")
    spark = rows.sparkSession
    sizes = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()}
    tokens, distinct = (sizes[1]["n"], sizes[1]["distinct"]) if 1 in sizes else (0, 0)
    values = gram_values(counts, depth)
    gram, value, order = _usual(values, GRAMS)
    words = counts.filter("kind = 1").select("code", "n")
    usual = words.filter(F.col("n") >= tokens * WORD_SHARE).toArrow().sort_by("code")
    model = {"gram": gram, "value": value, "order": order, "hash": usual["code"].to_numpy(), "count": usual["n"].to_numpy(), "tokens": tokens, "distinct": distinct}
    return _Shared(spark, model), values.select("code", "value"), words, {"tokens": tokens, "distinct": distinct}


def scored(docs: DataFrame, model: _Shared, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """Every row: `row` (all columns but the text), n_tokens, and score and base so far.

    `base` and `n_known` cover the words whose counts the model has; `rare` and
    `times` are the hashes and numbers of the others. So do `score`, `grams` and `often` with grams.
    """
    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*others).alias("row") if others else F.struct(F.lit(None).alias("none")).alias("row"), whole_text(text).cast("binary").alias("bytes"))
    long, real = F.lit(0).cast("bigint"), F.lit(0.0)
    out = packed.select("row", long.alias("n_tokens"), long.alias("n_known"), real.alias("base"), real.alias("score"),
                        F.array(long).alias("rare"), F.array(F.lit(0)).alias("times"), F.array(long).alias("grams"), F.array(long).alias("often")).schema

    def run(batches):
        own, table = model.value, _known(model)
        hashes, counts = own["hash"], own["count"]
        unit = math.log10(own["tokens"] + ALPHA * (own["distinct"] + 1))
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column(1)]
            score, new = np.zeros(len(texts)), [[] for _ in texts]
            for some in segments(texts, depth):
                row, code = grams(some, depth)
                value, known = table.values(code)
                part = np.bincount(row - row[0], weights=value)
                score[row[0]:row[0] + len(part)] += part
                row, code = row[~known], code[~known]
                starts = _first(row) if len(row) else np.zeros(0, np.int64)
                for first, last in zip(starts, np.append(starts[1:], len(row))):
                    new[row[first]].append(np.unique(code[first:last], return_counts=True))
            tokens, known, base, rare, times = [], [], [], [], []
            for text in texts:
                words = Counter(words_of(text))
                words[b""] = 1
                h, n = word_hashes(words), np.fromiter(words.values(), np.int64, len(words))
                at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                has = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
                tokens.append(int(n.sum()))
                known.append(int(n[has].sum()))
                base.append(float((n[has] * (np.log10(counts[at[has]] + ALPHA) - unit)).sum()) if has.any() else 0.0)
                rare.append(h[~has])
                times.append(n[~has].astype(np.int32))
            new = [merged(parts) if parts else (np.zeros(0, np.int64),) * 2 for parts in new]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                 pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32())), *[pa.array([x[i] for x in new], pa.list_(pa.int64())) for i in (0, 1)]],
                ["row", "n_tokens", "n_known", "base", "score", "rare", "times", "grams", "often"])

    return packed.mapInArrow(run, out)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row."""
    held_out = (bucket_of("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    rows = docs.select("doc_id", "text", held_out)
    model, values, words, sizes = fit(rows.select(whole_text().cast("binary").alias("bytes"), "held_out"))
    found = scored(rows.withColumn("n_bytes", F.octet_length(whole_text())), model)
    found = staged(found.withColumn("uid", F.monotonically_increasing_id()), "scored")
    rare = found.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("code"), F.col("r.times").alias("times"))
    met = rare.join(words, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    unit = math.log10(sizes["tokens"] + ALPHA * (sizes["distinct"] + 1))
    added = met.groupBy("uid").agg(F.sum(F.col("times") * (F.log10(F.col("n") + ALPHA) - F.lit(unit))).alias("more"),
                                   F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("met"))
    grams = found.select("uid", F.explode(F.arrays_zip("grams", "often")).alias("g")).select("uid", F.col("g.grams").alias("code"), F.col("g.often").alias("often"))
    left = grams.join(values, "code").groupBy("uid").agg(F.sum(F.col("often") * F.col("value")).alias("left"))
    slim = found.drop("rare", "times", "grams", "often").join(added, "uid", "left").join(left, "uid", "left")
    score = F.col("score") + F.coalesce("left", F.lit(0.0))
    return slim.select(
        F.col("row")["doc_id"].alias("doc_id"), F.col("row")["held_out"].alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(sizes["tokens"]).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), score.alias("score"),
        (-score * (LN10 / math.log(2)) / (F.col("row")["n_bytes"] + 1)).alias("bits_per_byte"))
