"""Log-probabilities of texts by context-tree weighting over bytes, beside a smoothed word model.

Method. The bytes of the training texts are counted with their ``depth`` preceding bytes over the whole corpus. Each
byte is decomposed into eight binary decisions; each decision has a context tree whose nodes are the contexts of 0 to
``depth`` bytes seen before it, with a Krichevsky-Trofimov estimate of its counts. A node weights its own estimate
against the product of its children's evidence, one half each a priori, so a prediction mixes all depths along the path.
Every context of the training texts is a node, so the tree grows with the corpus.

The tree is one Spark table a depth, a row for each context and decision. Evidence is summed from the deepest contexts
up, the mixture is carried from the root down, and each distinct (context, byte) of all texts takes its log-probability
from the deepest nodes of its path. Texts look up frequent pairs (each at least ``1/cached`` of all bytes, so at most
``cached`` of them) in every task; distinct others of a text are joined with the table. Bytes are those of the text
with A-Z in lower case, followed by one end symbol.

The word model (``base_score``) is log10((c + 1) / (N + V + 1)) summed over tokens. Words with at least ``1/2**20`` of
all tokens, at most 2**20 of them, are looked up in each task; occurrences of the others are joined with the counts.

Defined cases: null or empty text is the end symbol alone; a null id belongs to the training part; repeated rows are
counted and scored each; without training rows both models are uniform; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.bytescan import _LOWER, in_small_batches, mix, pieces, word_bounds, word_codes
from freshet.session import durable

#: bytes that UTF-8 never holds: before the start of a text, and its end
PAD, END = 0xC0, 0xC1
#: symbols handled at once
STEP = 1 << 19
SCORED = (
    "doc_id long, text_code long, held_out boolean, n_tokens long, n_known long, known_sum double, score double, "
    "n_bytes long"
)


@dataclass(frozen=True)
class TreeParams:
    depth: int = 4
    cached: int = 1 << 21
    frequent: int = 1 << 20


def held_out() -> Column:
    """Rows whose crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def padded(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes of all rows with ``depth`` start marks before and an end mark behind each; first byte of each."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    first = offsets[:-1] + depth + np.arange(rows) * (depth + 1)
    stream = np.full(len(data) + rows * (depth + 1), PAD, dtype=np.uint8)
    stream[np.arange(len(data)) + np.repeat(first - offsets[:-1], sizes)] = _LOWER[data]
    stream[first + sizes] = END
    return stream, first


def grams(stream: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (keys, places in the stream) of symbols with their contexts, ``STEP`` at a time.

    In a key the symbol is the lowest byte, the nearest context byte the next.
    """
    for a in range(0, len(stream) - depth, STEP):
        part = stream[a:a + STEP + depth]
        key = np.zeros(len(part) - depth, dtype=np.int64)
        for back in range(depth, -1, -1):
            key <<= 8
            key |= part[depth - back:len(part) - back]
        at = np.flatnonzero(part[depth:] != PAD)
        yield key[at], at + (a + depth)


def corpus_counts(docs: DataFrame, params: TreeParams) -> DataFrame:
    """(kind, key, n, uses): 0 byte contexts with their symbol, 1 words, 2 rows and words of the training rows.

    ``n`` counts the training rows, ``uses`` all rows.
    """
    depth = params.depth

    def run(batches):
        def counted(kind, keys, held):
            keys, n = np.unique(np.concatenate(keys), return_counts=True)
            return pa.record_batch(
                [
                    pa.array(np.full(len(keys), kind, dtype=np.int8)), pa.array(keys.view(np.int64)),
                    pa.array(n * (not held)), pa.array(n),
                ],
                names=["kind", "key", "n", "uses"],
            )

        found: dict[tuple[int, bool], list] = {}
        size = texts = n_words = 0
        for batch in batches:
            for held in (False, True):
                rows = batch.filter(pc.equal(batch.column(0), held))
                for first_row, last_row, data, offsets in pieces(rows.column(1)):
                    stream, first = padded(data, offsets, depth)
                    for keys, _ in grams(stream, depth):
                        found.setdefault((0, held), []).append(keys)
                    if not held:
                        starts, ends, _ = word_bounds(data, offsets)
                        found.setdefault((1, held), []).append(word_codes(data, starts, ends))
                        texts, n_words = texts + last_row - first_row, n_words + len(starts)
                    size += len(stream)
                    if size > 4 << 20:
                        yield from (counted(kind, keys, of_held) for (kind, of_held), keys in found.items())
                        found, size = {}, 0
        yield from (counted(kind, keys, of_held) for (kind, of_held), keys in found.items())
        yield pa.record_batch(
            [pa.array([2, 2], pa.int8()), *[pa.array(x, pa.int64()) for x in ([0, 1], [texts, n_words], [texts, n_words])]],
            names=["kind", "key", "n", "uses"],
        )

    rows = docs.select(held_out().alias("held"), "text").mapInArrow(run, "kind byte, key long, n long, uses long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"))


def _decisions(key: str) -> Column:
    """Rows (dec, bit) of the eight binary decisions that make the lowest byte of ``key``."""
    return F.explode(F.array(*[
        F.struct(
            F.expr(f"cast({1 << k} + shiftright({key} & 255, {8 - k}) AS int)").alias("dec"),
            F.expr(f"cast(shiftright({key}, {7 - k}) & 1 AS int)").alias("bit"),
        ) for k in range(8)
    ]))


def _shorter(context: str, depth: int) -> Column:
    """The nearest ``depth`` bytes of a context."""
    return F.expr(f"{context} & {(1 << (8 * depth)) - 1}L")


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5, by Stirling's series at x + 8."""
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def _evidence(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - math.log(math.pi)


def weighted(level: DataFrame, deepest: bool) -> DataFrame:
    """(ctx, dec, zeros, ones, total, stay, one) of nodes with their counts and the evidence ``below`` them.

    ``total`` is the log of a node's weighted evidence, ``stay`` the posterior weight of its own estimate ``one`` of a 1.
    """

    def run(batches):
        for batch in batches:
            zeros, ones, below = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            own = _evidence(zeros.astype(np.float64), ones.astype(np.float64))
            total = own if deepest else np.logaddexp(own, below) - math.log(2)
            stay = np.ones(len(own)) if deepest else np.exp(np.minimum(0.0, own - math.log(2) - total))
            one = (ones + 0.5) / (zeros + ones + 1.0)
            yield pa.record_batch(
                [*batch.columns[:4], pa.array(total), pa.array(stay), pa.array(one)],
                names=["ctx", "dec", "zeros", "ones", "total", "stay", "one"],
            )

    return level.select("ctx", "dec", "zeros", "ones", "below").mapInArrow(
        run, "ctx long, dec int, zeros long, ones long, total double, stay double, one double"
    )


def tree_levels(counts: DataFrame, params: TreeParams) -> list[DataFrame]:
    """For each depth (ctx, dec, mixed, left, p) of its nodes.

    ``mixed`` is the part of the prediction settled down to the node, ``left`` the weight that goes further down and ``p``
    the probability of a 1 where nothing was seen below.
    """
    seen = counts.filter("kind = 0 AND n > 0").select(F.expr("shiftright(key, 8)").alias("ctx"), "n", _decisions("key").alias("x"))
    level = seen.groupBy("ctx", F.col("x.dec").alias("dec")).agg(
        F.sum(F.when(F.col("x.bit") == 0, F.col("n")).otherwise(0)).alias("zeros"),
        F.sum(F.when(F.col("x.bit") == 1, F.col("n")).otherwise(0)).alias("ones"), F.lit(0.0).alias("below"),
    )
    nodes = [durable(weighted(level, deepest=True))]
    for depth in range(params.depth - 1, -1, -1):
        level = nodes[0].groupBy(_shorter("ctx", depth).alias("ctx"), "dec").agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("total").alias("below")
        )
        nodes.insert(0, durable(weighted(level, deepest=False)))
    levels: list[DataFrame] = []
    for depth, level in enumerate(nodes):
        if depth:
            above = levels[-1].select(F.col("ctx").alias("up"), "dec", F.col("mixed").alias("mixed_up"), F.col("left").alias("left_up"))
            level = level.withColumn("up", _shorter("ctx", depth - 1)).join(above, ["up", "dec"])
        else:
            level = level.withColumns({"mixed_up": F.lit(0.0), "left_up": F.lit(1.0)})
        mixed = F.col("mixed_up") + F.col("left_up") * F.col("stay") * F.col("one")
        left = F.col("left_up") * (1 - F.col("stay"))
        levels.append(level.select("ctx", "dec", mixed.alias("mixed"), left.alias("left"), (mixed + left / 2).alias("p")))
    return levels


def symbol_logs(counts: DataFrame, params: TreeParams) -> DataFrame:
    """(key, uses, log10 probability of its byte) of each context with a byte in any text."""
    levels = tree_levels(counts, params)
    levels[-1] = durable(levels[-1])

    def logs(seen: bool) -> DataFrame:
        # what was trained on has all its decisions among the deepest nodes, the others lack some
        rows = counts.filter("kind = 0").filter((F.col("n") > 0) == F.lit(seen)).select("key", "uses", _decisions("key").alias("x"))
        rows = rows.select("key", "uses", "x.*")
        depths = range(params.depth, params.depth - 1 if seen else -1, -1)
        for depth in depths:
            level = levels[depth].select("ctx", "dec", F.col("p").alias(f"p{depth}"))
            rows = rows.withColumn("ctx", _shorter("shiftright(key, 8)", depth)).join(level, ["ctx", "dec"], "left")
        one = F.coalesce(*[f"p{depth}" for depth in depths], F.lit(0.5))
        return rows.groupBy("key").agg(
            F.first("uses").alias("uses"), F.sum(F.log10(F.when(F.col("bit") == 1, one).otherwise(1 - one))).alias("value")
        )

    return logs(True).union(logs(False))


@dataclass
class Cache:
    """Values of keys in a table of fixed size; a key stands in one of two slots or, where both are taken, in none."""

    keys: np.ndarray
    values: np.ndarray

    def slot(self, keys: np.ndarray, second: bool) -> np.ndarray:
        spread, size = mix(keys.view(np.uint64)), len(self.keys)
        place = spread & np.uint64(size - 1) if second else spread >> np.uint64(65 - size.bit_length())
        return place.view(np.int64)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0 of each key, places of those that are not held)."""
        at = self.slot(keys, False)
        values = self.values[at]
        other = np.flatnonzero(self.keys[at] != keys)
        at = self.slot(keys[other], True)
        held = self.keys[at] == keys[other]
        values[other] = np.where(held, self.values[at], 0.0)
        return values, other[~held]


def cache(keys: np.ndarray, values: np.ndarray) -> Cache:
    """Cache of these keys (not negative); of those that meet in a slot the first one stays."""
    size = 1 << max(4, (2 * len(keys)).bit_length())
    made = Cache(np.full(size, -1, dtype=np.int64), np.zeros(size))
    left = np.arange(len(keys))
    for second in (False, True):
        slot = made.slot(keys, second)
        free = left[made.keys[slot[left]] < 0]
        places, first = np.unique(slot[free], return_index=True)
        made.keys[places], made.values[places] = keys[free[first]], values[free[first]]
        left = np.setdiff1d(left, free[first])
    return made


def _distinct(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, times) of the distinct pairs."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    return rows[first], keys[first], np.diff(np.append(first, len(rows)))


def _text_codes(stream: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A code of each row's bytes."""
    digests = [hashlib.blake2b(stream[a:a + n], digest_size=8).digest() for a, n in zip(first.tolist(), sizes.tolist())]
    return np.frombuffer(b"".join(digests), dtype=np.int64)


def score_texts(docs: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """Scores of both models for every row of ``docs`` (doc_id, text), with the code length in bits per byte."""
    spark, depth = docs.sparkSession, params.depth
    own = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = durable(corpus_counts(own, params))
    facts = {(r.kind, r.key): r.n for r in counts.filter("kind = 2").collect()}
    texts, n_words = facts.get((2, 0), 0), facts.get((2, 1), 0)
    tokens = n_words + texts
    totals = counts.groupBy("kind").agg(F.sum("uses").alias("uses"), F.count("*").alias("keys")).collect()
    distinct = sum(r.keys for r in totals if r.kind == 1) + (1 if texts else 0)
    words = counts.filter("kind = 1").select(F.col("key").alias("code"), F.col("n").alias("c"))
    often = words.filter(F.col("c") * params.frequent >= tokens).toPandas().sort_values("code")  # at most params.frequent
    logs = durable(symbol_logs(counts, params))
    symbols = sum(r.uses for r in totals if r.kind == 0)
    near = logs.filter(F.col("uses") * params.cached >= symbols).toPandas().sort_values(["uses", "key"], ascending=False)
    model = spark.sparkContext.broadcast((
        cache(near["key"].to_numpy(dtype=np.int64), near["value"].to_numpy(dtype=np.float64)),  # at most params.cached
        often["code"].to_numpy(dtype=np.int64), often["c"].to_numpy(dtype=np.int64),
    ))
    log_all = math.log10(tokens + distinct + 1)
    log_end, end_known = math.log10(texts + 1), int(texts > 0)

    def known(codes):
        often, c = model.value[1:]
        if not len(often):
            return np.zeros(len(codes), dtype=bool), np.zeros(len(codes))
        at = np.minimum(np.searchsorted(often, codes), len(often) - 1)
        hit = often[at] == codes
        return hit, np.where(hit, np.log10(c[at] + 1), 0.0)

    def score(batches):
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(2)):
                n = b - a
                stream, first = padded(data, offsets, depth)
                sizes = np.diff(offsets) + 1
                starts, ends, rows = word_bounds(data, offsets)
                codes = word_codes(data, starts, ends)
                hit, word_logs = known(codes.view(np.int64))
                symbol_sums = np.zeros(n)
                for keys, at in grams(stream, depth):
                    values = model.value[0].look(keys)[0]
                    begin, end = np.searchsorted(first, at[[0, -1]], side="right")
                    symbol_sums[begin - 1:end] += np.add.reduceat(values, np.searchsorted(at, first[begin - 1:end]))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, n), pa.array(_text_codes(stream, first, sizes)),
                        batch.column(1).slice(a, n), pa.array(np.bincount(rows, minlength=n) + 1),
                        pa.array(np.bincount(rows[hit], minlength=n) + end_known),
                        pa.array(np.bincount(rows, weights=word_logs, minlength=n) + log_end),
                        pa.array(symbol_sums), pa.array(sizes - 1),
                    ],
                    names=[c.split()[0] for c in SCORED.split(", ")],
                )

    def rare(batches):
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(0)):
                starts, ends, rows = word_bounds(data, offsets)
                codes = word_codes(data, starts, ends)
                left = ~known(codes.view(np.int64))[0]
                found = [(1, *_distinct(rows[left], codes[left].view(np.int64)))]
                stream, first = padded(data, offsets, depth)
                texts = _text_codes(stream, first, np.diff(offsets) + 1)
                for keys, at in grams(stream, depth):
                    left = model.value[0].look(keys)[1]
                    found.append((0, *_distinct(np.searchsorted(first, at[left], side="right") - 1, keys[left])))
                for kind, of, keys, times in found:
                    yield pa.record_batch(
                        [
                            pa.array(texts[of]), pa.array(np.full(len(of), kind, dtype=np.int8)), pa.array(keys),
                            pa.array(times.astype(np.int32)),
                        ],
                        names=["text_code", "kind", "key", "times"],
                    )

    scored = durable(own.select("doc_id", held_out(), "text").mapInArrow(score, SCORED))
    values = words.select(F.lit(1).cast("byte").alias("kind"), F.col("code").alias("key"), F.log10(F.col("c") + 1).alias("value"))
    values = values.union(logs.select(F.lit(0).cast("byte"), "key", "value"))
    joined = own.select("text").mapInArrow(rare, "text_code long, kind byte, key long, times int").join(values, ["kind", "key"])
    word, part = F.col("kind") == 1, F.col("times") * F.col("value")
    sums = joined.groupBy("text_code").agg(
        F.sum(F.when(word, F.col("times")).otherwise(0)).alias("times"),
        F.sum(F.when(word, part).otherwise(0.0)).alias("rare_words"), F.sum(F.when(word, 0.0).otherwise(part)).alias("rare_symbols"),
    )
    # equal texts share a code and their sums, so each takes its share
    copies = scored.groupBy("text_code").agg(F.count("*").alias("copies"))
    per_text = sums.join(copies, "text_code").select(
        "text_code", (F.col("times") / F.col("copies")).cast("long").alias("times"), F.col("rare_words") / F.col("copies"),
        F.col("rare_symbols") / F.col("copies"),
    ).toDF("text_code", "times", "rare_words", "rare_symbols")
    score = F.col("score") + F.coalesce("rare_symbols", F.lit(0.0))
    return scored.join(per_text, "text_code", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("times", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("known_sum") + F.coalesce("rare_words", F.lit(0.0)) - F.col("n_tokens") * log_all).alias("base_score"),
        score.alias("score"), "n_bytes",
        (-score / math.log10(2) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
