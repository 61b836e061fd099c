"""Removal of long repeated passages with a column-wise Burrows-Wheeler construction.

A byte goes if it lies in a string of `window` bytes that also starts elsewhere,
in any document. All texts as one suffix array would need a round per byte of
the longest text, each over the whole transform. So texts are first cut into
bounded pieces: every window is filed under its anchor, the gram of `GRAM`
bytes with the least hash in it, and a piece is a run of windows with the same
anchor. Equal windows have equal anchors at the same place in them. Anchors that
occur once in the corpus cannot hold a repeat and end there; pieces of the
others meet by anchor.

There the collection transform is built column by column: all pieces lie
aligned at their anchors, each round reads one column from a sequential file,
inserts one symbol per piece, and updates the order of the suffixes (whose
symbols are that round's Burrows-Wheeler transform) and the common prefix of
each with its neighbour. A window is repeated where a common prefix reaches its
length. Equal pieces are folded before they are sent, with a count.

An anchor in very many pieces is not sent as one group: its windows are filed
one by one under their whole content.

Defined results: null counts as empty; texts under `window` bytes, and empty
tables, lose nothing; a row repeated with its id is an occurrence like any
other; ids may be null or repeated, as rows are matched by text.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tables import staged, whole_text

WINDOW, GRAM = 200, 48
# Bytes hashed at once, pieces in one transform, and pieces of an anchor that are sent as one group.
CHUNK = 1 << 18
PIECES = 20_000
HOT = 50_000
OUT_BYTES = 8 << 20

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", MULTIPLIER), ("down", INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes that start at each place."""
    up, down = _powers(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
    h = (sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def least_places(h: np.ndarray, span: int) -> np.ndarray:
    """For each place the place of the least hash (the first of equals) among `span` from there on."""
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[:len(low) - (span - size)], low[span - size:])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(data: np.ndarray, document: np.ndarray, window: int, gram: int):
    """(first, last, anchor place, anchor hash) of the runs of windows in joined documents, numbered per byte."""
    if len(data) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    h = gram_hashes(data, gram)
    at = least_places(h, window - gram + 1)
    starts = np.flatnonzero(document[:len(at)] == document[window - 1:window - 1 + len(at)])
    at = at[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1) | (document[starts[1:]] != document[starts[:-1]])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last], at[first], h[at[first]].view(np.int64)


def _chunks(texts: list[bytes], window: int):
    """(row, offset, bytes) parts of texts in lists of about CHUNK bytes; parts of a text share window - 1 bytes."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - window + 1, 0), CHUNK):
            part = text[at:at + CHUNK + window - 1]
            held.append((row, at, part))
            size += len(part)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchors_of(texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """Yields (row, first, last, anchor, hash) arrays; places count from the text's start."""
    for held in _chunks(texts, window):
        lengths = [len(p) for _, _, p in held]
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        part = np.repeat(np.arange(len(held)), lengths)
        first, last, at, h = runs(data, part, window, gram)
        own = part[first]
        shift = (np.array([o for _, o, _ in held]) - np.concatenate(([0], np.cumsum(lengths)[:-1])))[own]
        yield np.array([r for r, _, _ in held])[own], first + shift, last + shift, at + shift, h


def text_key(text: str = "text") -> Column:
    """Sixteen bytes of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(whole_text(text).cast("binary"), 256), 1, 32))


def _anchors(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """rows (key, bytes) -> (key, hash, place): place packs the run's first window, its length and its anchor."""
    if window - gram > 255:
        raise ValueError("a window holds at most 255 bytes more than a gram")

    def run(batches):
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column(1)]
            for row, first, last, at, h in anchors_of(texts, window, gram):
                place = (first << 16) | ((last - first) << 8) | (at - first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(h), pa.array(place)], ["key", "hash", "place"])

    return rows.mapInArrow(run, "key binary, hash bigint, place bigint")


def _pieces(located: DataFrame, window: int) -> DataFrame:
    """(bytes, found: array of (place, hash, hot)) with key -> one row per distinct piece of a batch and where it stands."""
    def run(batches):
        for batch in batches:
            held, size = {}, 0
            for key, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_buffer().to_pybytes()
                for f in found:
                    place, h = f["place"], f["hash"]
                    first, more, left = place >> 16, (place >> 8) & 255, place & 255
                    if f["hot"]:  # each window by itself, under its content
                        parts = [(at, 0, text[at:at + window]) for at in range(first, first + more + 1)]
                    else:
                        parts = [(first, left, text[first:first + more + window])]
                    for at, left, piece in parts:
                        digest = hashlib.md5(bytes([left]) + piece).digest()
                        row = held.get(digest)
                        if row is None:
                            own = int.from_bytes(digest[:8], "big", signed=True) if f["hot"] else h
                            row = held[digest] = {"hash": own, "left": left, "piece": piece, "digest": digest, "stands": []}
                            size += len(piece)
                        row["stands"].append({"key": key, "at": at})
                        size += 24
                    if size >= OUT_BYTES:
                        yield pa.RecordBatch.from_pylist(list(held.values()), schema=fields)
                        held, size = {}, 0
            if held:
                yield pa.RecordBatch.from_pylist(list(held.values()), schema=fields)

    fields = pa.schema([("hash", pa.int64()), ("left", pa.int32()), ("piece", pa.binary()), ("digest", pa.binary()),
                        ("stands", pa.list_(pa.struct([("key", pa.binary()), ("at", pa.int64())])))])
    return located.mapInArrow(run, "hash bigint, left int, piece binary, digest binary, stands array<struct<key: binary, at: bigint>>")


def repeated_windows(pieces: list[bytes], left: list[int], window: int, gram: int) -> np.ndarray:
    """[piece, column]: whether the window that starts at that column stands in another piece too.

    Column `window - gram` holds the anchors. Columns go to a file, the last
    one first, and are read back one per round.
    """
    n, lead = len(pieces), window - gram
    grid = np.zeros((n, lead + window), np.uint16)
    for i, (piece, before) in enumerate(zip(pieces, left)):
        grid[i, lead - before:lead - before + len(piece)] = np.frombuffer(piece, np.uint8)
    for i, (piece, before) in enumerate(zip(pieces, left)):
        grid[i, lead - before:lead - before + len(piece)] += 1  # 0 stands for no symbol
    repeated = np.zeros((n, lead + 1), bool)
    with tempfile.TemporaryFile() as columns:  # this task's own; gone with it
        np.ascontiguousarray(grid.T[::-1]).tofile(columns)
        del grid
        columns.seek(0)
        order, common = np.arange(n), np.zeros(n, np.uint8)
        for column in range(lead + window - 1, -1, -1):
            symbol = np.fromfile(columns, np.uint16, n)[order]
            moved = np.argsort(symbol, kind="stable")
            symbol = symbol[moved]
            same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0))
            after = np.zeros(n, np.uint8)
            if len(same):
                # neighbours of one symbol share it and what all suffixes between them share
                spans = np.empty(2 * len(same), np.int64)
                spans[::2], spans[1::2] = moved[same] + 1, moved[same + 1] + 1
                least = np.minimum.reduceat(np.append(common, np.uint8(255)), spans)[::2]
                after[same + 1] = np.minimum(least, window - 1) + 1
            order, common = order[moved], after
            if column <= lead:
                equal = common >= window
                equal[:-1] |= equal[1:]
                repeated[order[equal], column] = True
    return repeated


def _repeats(pieces: DataFrame, window: int, gram: int) -> DataFrame:
    """(digest, begin, end): windows of a piece, counted from its first, that are repeated."""
    dealt = pieces.select("hash", "left", "piece", "digest", F.size("stands").alias("times")).repartition("hash").sortWithinPartitions("hash", "digest")

    def run(batches):
        # distinct pieces of whole anchors, PIECES or more at once
        held, last = {}, None
        for batch in batches:
            for h, left, piece, digest, times in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if h != last and len(held) >= PIECES:
                    yield answer(held)
                    held = {}
                last = h
                if digest in held:
                    held[digest][2] += times
                else:
                    held[digest] = [piece, left, times]
        if held:
            yield answer(held)

    def answer(held):
        digests, (pieces, left, times) = list(held), zip(*held.values())
        repeated = repeated_windows(pieces, left, window, gram)
        lead = window - gram
        out_digest, begins, ends = [], [], []
        edges = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        where, begin = np.nonzero(edges == 1)
        end = np.nonzero(edges == -1)[1]
        for i, b, e in zip(where.tolist(), begin.tolist(), end.tolist()):
            if times[i] == 1:
                first = lead - left[i]
                out_digest.append(digests[i]), begins.append(b - first), ends.append(e - first)
        for i, n in enumerate(times):
            if n > 1:
                out_digest.append(digests[i]), begins.append(0), ends.append(len(pieces[i]) - window + 1)
        return pa.RecordBatch.from_arrays([pa.array(out_digest, pa.binary()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["digest", "begin", "end"])

    return dealt.mapInArrow(run, "digest binary, begin bigint, end bigint")


def spans(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(key, spans): per distinct text (by `text_key`) the windows [begin, end) whose starts are repeated, unmerged."""
    rows = docs.select(text_key(text).alias("key"), whole_text(text).cast("binary").alias("bytes"))
    rows = rows.filter(F.length("bytes") >= window)
    found = _anchors(rows, window, gram)
    shared = staged(found.groupBy("hash").count().filter("count > 1").select("hash", (F.col("count") > hot).alias("hot")), "anchors")
    where = found.join(shared, "hash").groupBy("key").agg(F.collect_set(F.struct("place", "hash", "hot")).alias("found"))
    pieces = staged(_pieces(rows.join(where, "key").select("key", "bytes", "found"), window), "pieces")
    stands = pieces.select("digest", F.explode("stands").alias("s")).select("digest", "s.key", "s.at")
    removed = stands.join(_repeats(pieces, window, gram), "digest")
    removed = removed.select("key", (F.col("at") + F.col("begin")).alias("begin"), (F.col("at") + F.col("end")).alias("end")).distinct()
    return removed.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def cut(text: bytes, found: list[tuple[int, int]], window: int) -> tuple[bytes, int]:
    """The text without the bytes of the windows that start in `found`, and the number of runs removed."""
    kept, at, number = [], 0, 0
    for begin, end in sorted(found):
        stop = end - 1 + window
        if number and begin <= at:
            at = max(at, stop)
            continue
        kept.append(text[at:begin])
        at, number = stop, number + 1
    kept.append(text[at:])
    return b"".join(kept), number


def cleaned(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Every row: `row` (all columns but the text, as a struct), n_bytes, kept (bytes that stay), n_spans."""
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("row") if others else F.struct(F.lit(None).alias("none")).alias("row"),
                       text_key(text).alias("key"), whole_text(text).cast("binary").alias("bytes"))
    found = staged(spans(docs, text, window, gram, hot), "spans")
    joined = rows.join(found, "key", "left").select("row", "bytes", "spans")
    out = joined.select("row", F.lit(0).cast("bigint").alias("n_bytes"), F.lit(b"").alias("kept"), F.lit(0).cast("bigint").alias("n_spans")).schema

    def run(batches):
        for batch in batches:
            kept, sizes, numbers = [], [], []
            for content, found in zip(batch.column(1), batch.column(2).to_pylist()):
                content = content.as_buffer().to_pybytes()
                rest, number = cut(content, [(f["begin"], f["end"]) for f in found or ()], window)
                kept.append(rest), sizes.append(len(content)), numbers.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(numbers, pa.int64())],
                                             ["row", "n_bytes", "kept", "n_spans"])

    return joined.mapInArrow(run, out)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return cleaned(docs.select("doc_id", "text")).select(
        F.col("row")["doc_id"].alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
