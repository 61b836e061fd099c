"""Hard negatives by exact integer products of packed vectors (Kronecker substitution).

Components become whole numbers. Of a block of candidates, several components
are made non-negative by a bias and packed into separated fields of one wide
integer; that is multiplied once per component of an anchor (biased as well)
and summed, and the fields of the sum hold the products with all candidates
packed, exactly. What the biases added is known from the sums of components and
taken off again. A field has as many bits as the sum of the block can take, so
no field reaches into the next. Where two fields or more fit into the 53 bits
that a double holds exactly, the wide integers are doubles and the products a
matrix product; else they are Python integers of any width.

Anchors are a set of stated queries. They are dealt into blocks, all rows into
runs, and a task meets one block with one run: it holds the block, reads the run
batch by batch and keeps only the rows that still count, so neither a hot label
nor many equal vectors gather in a task. First each anchor meets the rows of
its own label (positives), then the others, with the window of scores that its
positives allow. Runs of an anchor are merged by rank.

Defined results: rows with null label, null or empty vector, or null or
non-finite components take no part, nor do vectors so long (squared length of
2^56 or more in whole numbers) that a score would leave a long; vectors of
different lengths do not meet; rows with the anchor's own id are no others;
null ids come last among equal scores and are never anchors; repeated rows
count as rows of their own; an empty table has no results. Other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.skew import lookup_join, measure
from .embeddings import grouped
from .tables import staged

SCALE = 256
ANCHOR_STEP, RELABEL_STEP, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
# Hundredths of the positive's score times 100 that a negative may have: least and most.
LEAST, MOST, WHOLE = 30, 90, 100
# Anchors of a block, rows of a run, and rows multiplied at once.
BLOCK, RUN, BATCH = 2_048, 16_384, 1_024
LONGEST = 1 << 56
# Bits that a double holds exactly, and fields of a Python integer.
EXACT_BITS, WIDE_FIELDS = 53, 32
NO_ID = np.iinfo(np.int64).max
LOWEST = np.iinfo(np.int64).min


def pack(block: np.ndarray, bias: int, bits: int, fields: int, whole: bool) -> np.ndarray:
    """Rows of `block` packed `fields` at a time: one row of wide integers per group, row j of a group in bits j*bits.

    `whole` makes Python integers, else doubles.
    """
    n, d = block.shape
    groups = -(-n // fields)
    padded = np.zeros((groups * fields, d), np.int64)
    padded[:n] = block - bias
    parts = padded.reshape(groups, fields, d)
    parts = parts.astype(object if whole else np.float64)
    return sum(parts[:, j] * (1 << (bits * j)) for j in range(fields))


def unpack(sums: np.ndarray, n: int, bits: int, fields: int) -> np.ndarray:
    """The fields of the sums (anchors x groups) as anchors x n."""
    mask = (1 << bits) - 1
    if sums.dtype == object:
        parts = [((sums >> (bits * j)) & mask) for j in range(fields)]
        return np.stack(parts, axis=2).reshape(len(sums), -1)[:, :n]
    left = sums.astype(np.int64)
    out = np.empty((*sums.shape, fields), np.int64)
    for j in range(fields):
        out[:, :, j] = (left >> (bits * j)) & mask
    return out.reshape(len(sums), -1)[:, :n]


def products(anchors: np.ndarray, block: np.ndarray) -> np.ndarray:
    """anchors x rows: exact inner products of whole numbers that fit a long."""
    if not len(anchors) or not len(block):
        return np.zeros((len(anchors), len(block)), np.int64)
    low_a, low_b = int(anchors.min()), int(block.min())
    most = anchors.shape[1] * (int(anchors.max()) - low_a) * (int(block.max()) - low_b)
    bits = max(most.bit_length(), 1)
    whole = 2 * bits > EXACT_BITS
    kind, fields = (object, WIDE_FIELDS) if whole else (np.float64, EXACT_BITS // bits)
    sums = (anchors - low_a).astype(kind) @ pack(block, low_b, bits, fields, whole).T
    # the fields hold the sums of (a - la)(b - lb) = ab - lb a - la (b - lb)
    count = object if whole else np.int64
    added = low_b * anchors.astype(count).sum(axis=1)[:, None] + low_a * (block - low_b).astype(count).sum(axis=1)[None, :]
    return (unpack(sums, len(block), bits, fields) + added).astype(np.int64)


class Best:
    """Per slot the first `k` (score falling, id rising) of what was added."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.worst = np.full(slots, LOWEST, np.int64)  # score a full slot's last one has
        self.rows = [np.zeros(0, np.int64)] * 4  # slot, score, id, uid

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray, uid: np.ndarray) -> None:
        slot, score, ident, uid = (np.concatenate(p) for p in zip(self.rows, (slot, score, ident, uid)))
        order = np.lexsort((uid, ident, -score, slot))
        slot, score, ident, uid = slot[order], score[order], ident[order], uid[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        kept = rank < self.k
        last = rank == self.k - 1
        self.worst[slot[last]] = score[last]
        self.rows = [c[kept] for c in (slot, score, ident, uid)]

    def meet(self, scores: np.ndarray, allowed: np.ndarray, slots: np.ndarray, ident: np.ndarray, uid: np.ndarray) -> None:
        """Adds of scores (slots x rows) what is allowed and not below the slot's last one."""
        good = allowed & (scores >= self.worst[slots][:, None])
        if np.count_nonzero(good) > 4 * self.k * len(slots) and scores.shape[1] > self.k:
            # the k-th of the batch bounds what can stay
            at = scores.shape[1] - self.k
            good &= scores >= np.partition(np.where(good, scores, LOWEST), at, axis=1)[:, at][:, None]
        i, j = np.nonzero(good)
        if len(i):
            self.add(slots[i], scores[i, j], ident[j], uid[j])


def participants(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(uid, id, label, size, comps) of the rows that take part."""
    given = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("own"),
                           F.col(vector).cast("array<double>").alias("given"))
    # of this size at most, or the squared length is beyond the limit anyway
    usable = F.forall("given", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LONGEST)))
    label_now = F.when(F.col("id") % RELABEL_STEP == 0, (F.col("own") + 1) % LABELS).otherwise(F.col("own"))
    rows = given.filter(F.col("own").isNotNull() & F.col("given").isNotNull() & (F.size("given") > 0) & usable).select(
        "id", label_now.alias("label"), F.size("given").alias("size"), F.transform("given", lambda x: F.floor(x * SCALE)).alias("comps"))
    squared = F.aggregate("comps", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return rows.filter(squared < float(LONGEST)).select(F.monotonically_increasing_id().alias("uid"), "id", "label", "size", F.col("comps").cast("array<int>").alias("comps"))


def _dealt(people: DataFrame, anchors: DataFrame, place: list[str], block: int, run: int) -> DataFrame:
    """Anchors and rows of equal `place`, dealt so that each block of anchors meets each run of rows in one group."""
    runs = people.groupBy(*place).agg(F.ceil(F.count("*") / run).cast("int").alias("runs"))
    blocks = anchors.groupBy(*place).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    number = staged(runs.join(blocks, place), "meeting-blocks")
    size = measure(number, fixed_bytes=64)
    drawn = lambda c: F.pmod(F.xxhash64("uid"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = lookup_join(anchors, number, place, size=size).withColumn("block", drawn("blocks")).withColumn("run", each("runs"))
    met = lookup_join(people, number, place, size=size).withColumn("run", drawn("runs")).withColumn("block", each("blocks"))
    columns = [*place, "block", "run"]
    extra = [c for c in anchors.columns if c not in people.columns]
    both = asked.withColumn("row", F.lit(False)).unionByName(met.withColumn("row", F.lit(True)), allowMissingColumns=True)
    kept = [c for c in ("uid", "id", "label", "comps", *extra) if c not in columns]
    return both.select(*columns, "row", *kept).repartition(*columns).sortWithinPartitions(*columns, "row")


def _vectors(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """comps as a matrix of longs, ids (NO_ID for null) and uids."""
    flat = part.column("comps").flatten().to_numpy().astype(np.int64)
    return flat.reshape(part.num_rows, -1), part.column("id").fill_null(NO_ID).to_numpy(), part.column("uid").to_numpy()


def _meetings(batches, keys: list[str], begin):
    """For each group: `begin(anchors)` makes (take, results) from the anchors' batch; `take` gets each batch of rows."""
    held, now, take, results = [], None, None, None
    for batch in batches:
        for part, key in grouped(batch, [*keys, "row"]):
            if key[:-1] != now:
                if take:
                    yield results()
                held, now, take = [], key[:-1], None
            if not key[-1]:
                held.append(part)
                continue
            if not held:  # no anchor was drawn into this block
                continue
            if take is None:
                anchors = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                take, results = begin(anchors)
            for at in range(0, part.num_rows, BATCH):
                take(part.slice(at, BATCH))
    if take:
        yield results()


def positives(people: DataFrame, anchors: DataFrame, k: int = POSITIVES, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """(anchor_uid, positives): the first k other rows of the anchor's label as an array of (place, id, score)."""
    keys = ["label", "size", "block", "run"]

    def begin(batch):
        x, ident, uid = _vectors(batch)
        best, slots = Best(len(x), k), np.arange(len(x))

        def take(part):
            y, its, uids = _vectors(part)
            best.meet(products(x, y), its[None, :] != ident[:, None], slots, its, uids)

        def results():
            slot, score, its, uids = best.rows
            return pa.RecordBatch.from_arrays([pa.array(uid[slot]), pa.array(its, mask=its == NO_ID), pa.array(uids), pa.array(score)], ["anchor_uid", "id", "uid", "score"])

        return take, results

    met = _dealt(people, anchors, ["label", "size"], block, run).mapInArrow(
        lambda batches: _meetings(batches, keys, begin), "anchor_uid bigint, id bigint, uid bigint, score bigint")
    order = Window.partitionBy("anchor_uid").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    first = met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return first.groupBy("anchor_uid").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))


def negatives(people: DataFrame, anchors: DataFrame, k: int = NEGATIVES, window: tuple[int, int, int] = (LEAST, MOST, WHOLE),
              block: int = BLOCK, run: int = RUN) -> DataFrame:
    """anchors with `positives` -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    least, most, whole = window
    keys = ["size", "block", "run"]

    def begin(batch):
        x, ident, uid = _vectors(batch)
        label = batch.column("label").to_numpy()
        lists = batch.column("positives")
        number = lists.value_lengths().to_numpy()
        owner = np.repeat(np.arange(len(x)), number)
        its = lists.flatten()
        place, score = its.field("place").to_numpy(), its.field("score").to_numpy()
        low, high = -(-least * score // whole), most * score // whole
        best = Best(len(owner), k)
        # one positive of each anchor at a time
        turns = [np.flatnonzero(place == p) for p in np.unique(place)]

        def take(part):
            y, ids, uids = _vectors(part)
            scores = products(x, y)
            other = part.column("label").to_numpy()[None, :] != label[:, None]
            for slots in turns:
                own = scores[owner[slots]]
                fit = other[owner[slots]] & (own >= low[slots][:, None]) & (own <= high[slots][:, None])
                best.meet(own, fit, slots, ids, uids)

        def results():
            slot, found, ids, uids = best.rows
            columns = [pa.array(uid[owner[slot]]), pa.array(ident[owner[slot]]), pa.array(place[slot], pa.int32()), its.field("id").take(pa.array(slot)),
                       pa.array(score[slot]), pa.array(ids, mask=ids == NO_ID), pa.array(uids), pa.array(found)]
            return pa.RecordBatch.from_arrays(columns, ["anchor_uid", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "uid", "negative_score"])

        return take, results

    met = _dealt(people, anchors, ["size"], block, run).mapInArrow(
        lambda batches: _meetings(batches, keys, begin),
        "anchor_uid bigint, anchor_id bigint, place int, positive_id bigint, positive_score bigint, negative_id bigint, uid bigint, negative_score bigint")
    order = Window.partitionBy("anchor_uid", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "uid")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def judged(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", step: int = ANCHOR_STEP,
           block: int = BLOCK, run: int = RUN) -> DataFrame:
    """The hard negatives of every anchor and positive."""
    people = staged(participants(vectors, vec_id, vector, label), "vectors-taking-part")
    anchors = people.filter(F.col("id") % step == 0)
    found = staged(positives(people, anchors, block=block, run=run), "anchors-positives")
    # as many rows as there are anchors; both sides by uid
    asked = anchors.join(found.withColumnRenamed("anchor_uid", "uid"), "uid")
    return negatives(people, asked, block=block, run=run)


def oracle_sql() -> str:
    return f"""
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % {RELABEL_STEP} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % {ANCHOR_STEP} = 0 AND a.vec_id <> b.vec_id),
firsts AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}),
ranked AS (SELECT f.*, s.other AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY f.anchor_id, positive_id ORDER BY s.score DESC, s.other)::INTEGER AS rank
  FROM firsts f JOIN scored s ON f.anchor_id = s.anchor_id AND NOT s.same AND {LEAST} * positive_score <= {WHOLE} * s.score AND {WHOLE} * s.score <= {MOST} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {NEGATIVES}"""
