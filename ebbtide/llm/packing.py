"""Best-fit packing of tokenised documents, planned on the length histogram.

Documents are tokenised once, in tasks; only documents longer than a sequence
are cut.  The plan (best fit, longest first) is made over counts per length: at
most ``capacity`` numbers leave Spark however many documents there are.  Pieces
then take the planned places by joining on their rank within their length.

Nulls and edge cases: a null or empty text is the end token alone; equal texts
and repeated rows are packed separately, ties in length in the order of doc_id,
piece and row; a document without doc_id is packed like any other; a very long
text is cut into as many pieces as it needs; columns other than doc_id and text
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import textkit
from ebbtide.operators.ranking import global_rank

CAPACITY = 1024
END_ID = 2
#: Special token of the vocabulary file.
SPECIAL = "<|endoftext|>"
#: Up to here both encoders are known to split alike; other texts go to the slower one.
_OTHER = re.compile("[^\x00-ɏ]")


def tokenizer_files() -> tuple[str, str, str]:
    """Vocabulary file, rank file of the same vocabulary, and its word pattern."""
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def _slow(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@lru_cache(maxsize=4)
def _fast(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_ids(text: str, vocabulary: str, ranks: str, pattern: str) -> np.ndarray:
    """The ids that ``vocabulary`` gives, without added special tokens.

    The rank file holds the same vocabulary; its encoder is about four times as
    fast, and takes the texts on which both agree.
    """
    if SPECIAL in text or _OTHER.search(text):
        return np.array(_slow(vocabulary).encode(text, add_special_tokens=False).ids, dtype="<u4")
    return _fast(ranks, pattern).encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4")


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the remainder comes first."""
    first = length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def tokenized_pieces(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document, written."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], [[], [], [], []]
            for n, text in enumerate(batch.column(1)):
                ids = np.append(token_ids(text.as_py() or "", vocabulary, ranks, pattern), np.uint32(END_ID)).astype("<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    row.append(n)
                    for column, value in zip(out, (piece, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return textkit.map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", "pieces")


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: runs (length, first rank, end rank, first bin, offset).

    The pieces of a run lie at one offset in consecutive bins.  Bins of one
    filling are handled as intervals, so the work depends on the number of
    lengths only.
    """
    left: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first bin, bins)
    runs, bins = [], 0
    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            room = next((r for r in range(length, capacity + 1) if left[r]), None)
            if room is None:
                room, first, many = capacity, bins, -((rank - end) // (capacity // length))
                bins += many
            else:
                first, many = left[room].pop()
            deep = room // length
            whole = min(many, (end - rank) // deep)  # bins that take as many as fit
            each = deep
            if not whole:
                whole, each = 1, end - rank
            for layer in range(each):
                runs.append((length, rank, rank + whole, first, capacity - room + layer * length))
                rank += whole
            left[room - each * length].append((first, whole))
            if whole < many:
                left[room].append((first + whole, many - whole))
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with doc_id, piece and length."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, begins, before = plan_bins(counts, capacity), {}, 0
    for length in sorted(counts):
        begins[length] = before
        before += counts[length]
    plan = [(n, begins[n] + lo, begins[n] + hi, first, at) for n, lo, hi, first, at in runs]
    planned = spark.createDataFrame(plan, "__length long, __first long, __end long, __bin long, offset long")
    ranked = global_rank(
        pieces.withColumn("__row", F.monotonically_increasing_id()), ["length", "doc_id", "piece", "__row"], "__rank"
    )
    # the plan's size is bounded by the capacity, not by the documents
    return (
        ranked.join(
            F.broadcast(planned),
            (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__end")),
        )
        .withColumn("sequence_id", F.col("__bin") + F.col("__rank") - F.col("__first"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: where it comes from and where it lies in the packed sequences."""
    return pack(tokenized_pieces(docs, vocabulary, ranks, pattern, capacity), capacity)
