"""Pack token sequences of documents into fixed-length sequences by best-two-fit.

Only lengths decide a packing, and a piece has at most ``capacity`` tokens, so the plan is made from the count of
pieces per length: at most ``capacity`` numbers, however many documents there are. The plan fills a sequence with the
largest piece left that fits, again and again, then replaces the smallest piece of the sequence by two pieces left
that fit its widened gap more tightly, and repeats the sequence found while its lengths last. Pieces take their places
by their rank among the pieces of their length. Ranks come from counted blocks of hashed ids, so a length that a third
of all pieces share is still numbered by many tasks.

Defined cases: null or empty text is the closing id alone; repeated rows are packed as often as they come; extra
columns are ignored; an empty table gives no rows. A null id stays null.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from base64 import b64decode
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.bytescan import in_small_batches
from freshet.session import durable

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SLOTS = "length long, low long, high long, per_sequence long, first_sequence long, first_offset long"
#: a space beside other white space: the text is then tokenized as a whole
_NEAR_SPACE = (re.compile(r" \s"), re.compile(r"[^\S ] "))


@dataclass(frozen=True)
class PackParams:
    """``vocabulary``: file of a byte-level BPE tokenizer, a path or a name of the public tokenizers' folder."""

    capacity: int = 2048
    vocabulary: str = "byte_bpe_50k.json"
    block_rows: int = 200_000


def _file(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class TextIds(dict):
    """Token ids of texts as little-endian 32-bit numbers.

    The split pattern of the vocabulary never joins characters across the border before a single space, so a text is
    the concatenation of its space-separated words, whose ids are remembered. The words come from the rank file of the
    same vocabulary; texts with other space borders or special tokens go through the tokenizer file itself.
    """

    SIZE = 400_000

    def __init__(self, vocabulary: str):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = _file(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.word_ids = self.slow_word
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.word_ids = fast.encode_ordinary

    def slow_word(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: str) -> bytes:
        found = array("I", self.word_ids(" " + word)).tobytes()
        if len(self) < self.SIZE:
            self[word] = found
        return found

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special) or any(p.search(text) for p in _NEAR_SPACE):
            return array("I", self.slow_word(text)).tobytes()
        words = text.split(" ")
        head = array("I", self.word_ids(words[0])).tobytes() if words[0] else b""
        if len(words) > 1 and not words[-1]:  # one space at the end is a token of its own
            words.pop()
            return head + b"".join(map(self.__getitem__, words[1:])) + array("I", self.word_ids(" ")).tobytes()
        return head + b"".join(map(self.__getitem__, words[1:]))


@cache
def text_ids(vocabulary: str) -> TextIds:
    return TextIds(vocabulary)


def token_pieces(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """Pieces of each document's ids with the closing id 0; only the first piece of a cut document may be short."""
    capacity, vocabulary = params.capacity, params.vocabulary

    def run(batches):
        ids_of = text_ids(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                out = [[], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = ids_of(text.as_py() or "") + b"\0\0\0\0"
                    total = len(ids) // 4
                    start, piece = 0, 0
                    length = total if total <= capacity else total % capacity or capacity
                    while start < total:
                        row = (doc, piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                        start, piece, length = start + length, piece + 1, capacity
                yield pa.record_batch(
                    [
                        pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
                        pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_two_fit(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Slots of the packing of ``counts`` pieces per length.

    A row gives the pieces of one length with rank ``low`` to ``high`` (exclusive) places in consecutive sequences,
    ``per_sequence`` pieces in each, one after another from ``first_offset``.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(capacity + 1, dtype=np.int64)
    rows, sequence = [], 0

    def largest(have: np.ndarray) -> np.ndarray:
        """For each size the largest length left that fits, 0 if none does."""
        return np.maximum.accumulate(np.where(have > 0, np.arange(capacity + 1), 0))

    fits = largest(left)
    while fits[capacity]:
        take: dict[int, int] = {}
        gap = capacity
        while gap and (length := int(fits[gap])):
            free = int(left[length]) - take.get(length, 0)
            while length and free <= 0:  # all pieces of this length are taken by this sequence
                length = int(fits[length - 1])
                free = int(left[length]) - take.get(length, 0) if length else 0
            if not length:
                break
            n = min(free, gap // length)
            take[length] = take.get(length, 0) + n
            gap -= n * length
        if gap and take:
            small = min(take)
            have = left.copy()
            for length, n in take.items():
                have[length] -= n
            room = gap + small
            one = np.flatnonzero(have[:room] > 0)
            one = one[one > 0]
            if len(one):
                two = largest(have)[room - one]
                same = (two == one) & (have[one] < 2)
                if same.any():
                    below = largest(have)
                    two = np.where(same, below[np.maximum(one - 1, 0)], two)
                total = np.where(two > 0, one + two, 0)
                best = int(np.argmax(total))
                if total[best] > small:
                    take[small] -= 1
                    if not take[small]:
                        del take[small]
                    for length in (int(one[best]), int(two[best])):
                        take[length] = take.get(length, 0) + 1
        times = min(int(left[length]) // n for length, n in take.items())
        offset = 0
        for length in sorted(take, reverse=True):
            n = take[length]
            rows.append((length, int(used[length]), int(used[length]) + n * times, n, sequence, offset))
            used[length] += n * times
            left[length] -= n * times
            offset += n * length
        sequence += times
        fits = largest(left)
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SLOTS.split(", ")], dtype="int64")


def ranked(pieces: DataFrame, params: PackParams) -> DataFrame:
    """``pieces`` with ``place``, their number from 0 among the pieces of their length."""
    blocks = pieces.count() // params.block_rows + 1
    marked = pieces.withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)) if blocks > 1 else F.lit(0)
    )
    sizes = marked.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    return (
        marked.withColumn("number", F.row_number().over(within))
        .join(starts, ["length", "block"])
        .withColumn("place", F.col("before") + F.col("number") - 1)
        .drop("block", "number", "before")
    )


def pack(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    pieces = durable(token_pieces(in_small_batches(docs), params))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_two_fit(counts, params.capacity)
    # a few rows for each of the capacity's lengths, whatever the number of pieces
    slots = F.broadcast(spark.createDataFrame(plan, SLOTS) if len(plan) else spark.createDataFrame([], SLOTS))
    place = F.col("place")
    rows = ranked(pieces, params).join(slots, "length").filter((place >= F.col("low")) & (place < F.col("high")))
    nth = place - F.col("low")
    return rows.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
    )
