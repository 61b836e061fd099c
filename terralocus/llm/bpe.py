"""Byte-level BPE encoding and decoding with a local rank file.

Encoding runs the tiktoken library per Arrow batch. A long text is cut before
encoding, at places that lie between two matches of the splitting pattern in
any case, so the ids equal those of the uncut text. Decoding joins the raw
bytes of the ids.

Defined results: a null text counts as empty and has no ids; ids outside the
vocabulary make decoding fail; null ids decode to empty bytes; other columns,
whatever their names, are not touched.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StructField, StructType

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
# A text is cut into parts of at least this many characters.
PART = 20_000
# Rows whose texts hold this many characters leave a task together.
BATCH_CHARS = 4_000_000

# No match of the pattern covers two characters around such a place: a space
# may only open a match, and letters, digits and other signs never share one,
# but for an apostrophe before its letters (which is why signs must come second).
SAFE = re.compile(r"(?<=\S)(?=[ \t\r\n])|(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[int, bytes]]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return ranks, {rank: token for token, rank in ranks.items()}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=vocabulary(path)[0], special_tokens={})


def parts(text: str, size: int = PART):
    """The text in consecutive parts of `size` characters or more, cut at safe places only."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode_text(text: str, ranks: str = RANKS, pattern: str = PATTERN, size: int = PART) -> list[int]:
    own = encoding(ranks, pattern)
    if len(text) <= size:
        return own.encode_ordinary(text)
    return [token for part in parts(text, size) for token in own.encode_ordinary(part)]


def _packed(docs: DataFrame, column: str) -> DataFrame:
    """One struct of all columns, and the one to work on: no name can clash."""
    return docs.select(F.struct("*").alias("row"), F.col(column).alias("work"))


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", ranks: str = RANKS, pattern: str = PATTERN, checked: str | None = None) -> DataFrame:
    """`docs` with the column `ids` (array of int) in place of any column of that name.

    With `checked`, a boolean column of this name says whether the ids decode to the text's bytes.
    """
    packed = _packed(docs.drop(ids, *([checked] if checked else [])), text)
    out = StructType([packed.schema["row"], StructField("ids", ArrayType(IntegerType())), StructField("same", BooleanType())])

    def run(batches):
        token = vocabulary(ranks)[1] if checked else None
        for batch in batches:
            start, held, found, same = 0, 0, [], []
            for i, text in enumerate(batch.column(1)):  # one text at a time: lists of ids are large
                text = text.as_py() or ""
                tokens = encode_text(text, ranks, pattern)
                found.append(np.array(tokens, np.int32))
                same.append(b"".join(map(token.__getitem__, tokens)) == text.encode("utf-8", "surrogatepass") if checked else None)
                held += len(text)
                if held >= BATCH_CHARS or i + 1 == batch.num_rows:
                    yield out_batch(batch.column(0).slice(start, len(found)), found, same)
                    start, held, found, same = i + 1, 0, [], []

    def out_batch(rows, found, same):
        offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([rows, lists, pa.array(same, pa.bool_())], ["row", "ids", "same"])

    more = [F.col("same").alias(checked)] if checked else []
    return packed.mapInArrow(run, out).select("row.*", F.col("ids").alias(ids), *more)


def decode(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded", ranks: str = RANKS) -> DataFrame:
    """`encoded` with the raw bytes of its ids in the binary column `decoded`."""
    packed = _packed(encoded.drop(decoded), ids)
    out = StructType([packed.schema["row"], StructField("decoded", BinaryType())])

    def run(batches):
        token = vocabulary(ranks)[1]
        for batch in batches:
            bytes_ = []
            for row in batch.column(1):
                bytes_.append(b"".join(map(token.__getitem__, row.values.to_numpy().tolist())) if row.is_valid else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bytes_, pa.binary())], ["row", "decoded"])

    return packed.mapInArrow(run, out).select("row.*", F.col("decoded").alias(decoded))


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    # the ids are needed only until they are decoded, so the text is left behind
    tokens = encode(docs.select("doc_id", "text")).select("doc_id", "ids")
    return decode(tokens).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
