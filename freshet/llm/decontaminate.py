"""Benchmark passages in documents, found by CGK walks with sampled steps and verified by edit distance.

An item of n words is in a document if some passage is within ``floor(max_edits * n)`` word edits of it. Words are
runs of letters, digits and non-ASCII characters, in lower case (A-Z); each character of a script without spaces
(Chinese, Japanese, Thai, Lao, Burmese, Khmer) is a word. An item of fewer than ``min_words`` words is searched exactly.

Method. A CGK walk reads a word at each step and moves on to the next word or stays, by a random bit of (step, word).
Two walks over texts that differ by an edit part there and meet again by chance, so few edits become few steps that
differ. A signature holds the words read at the sampled steps of one walk; repetitions are independent walks. Walks
over whole long items drift apart as edits add up, so an item is looked up by the windows that start at each of its
words, and a document by those at each of its words. Where ``need`` signatures of one item stand at about the same
place, the item-sized window around is compared by exact edit distance.

The number of walks of an item is chosen by its size: ``walks_needed`` edits random items of that size band up to the
limit, by replacements, insertions, deletions and a mix, and takes the fewest walks that find ``target`` of each kind.
A signature of fewer than three different places is left out on both sides, as it says too little.

The benchmark goes to the tasks in blocks of at most about ``block_items`` items and ``block_bytes`` of text; a larger
benchmark takes more passes over the documents. One item is never split.

Defined cases: null or empty texts and items hold nothing; an item without words is not searched; repeated rows are
searched each; extra columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.bytescan import MARKS, in_small_batches, mix, pieces, word_bounds, word_codes

FOUND = "doc_id long, item_id long, distance int, item_words int, start long, end long"


@dataclass(frozen=True)
class LeakParams:
    """``min_words``: fewest words of an item that may be edited. ``sampled``: the steps of a walk that make a signature.

    ``max_pairs``: signatures of one place handled at once in a task; it bounds memory and changes no result.
    """

    max_edits: float = 0.2
    min_words: int = 8
    sampled: tuple[int, ...] = (0, 2, 4, 6)
    need: int = 2
    target: float = 0.995
    most_walks: int = 16
    block_items: int = 20_000
    block_bytes: int = 16 << 20
    max_pairs: int = 1 << 21

    def edits(self, words: int) -> int:
        return int(self.max_edits * words) if words >= self.min_words else 0

    def least(self, words: int) -> int:
        """Signatures that must stand together for an item of ``words`` words."""
        return self.need if words >= self.min_words else 1


@dataclass
class Signatures:
    """Signatures of one walk, or of whole short items of one length: hashes in order, with their items and places,
    and a table of the hashes' low bits."""

    walk: int | None
    length: int
    keys: np.ndarray
    owners: np.ndarray
    places: np.ndarray
    filter: np.ndarray


BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def run_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words, the same for the same words wherever they stand."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    powers = np.full(len(codes), BASE)
    back = np.full(n, INVERSE)
    powers[0] = back[0] = 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes * np.cumprod(powers))])
    return mix((sums[length:] - sums[:n]) * np.cumprod(back))


def walk_keys(codes: np.ndarray, walk: int, sampled: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, last place, hash) of the signatures of a walk from each word; walks end before the end of ``codes``."""
    n = len(codes)
    bits = np.append(mix(codes + mix(np.array([walk + 1], dtype=np.uint64) * BASE)), np.uint64(0))
    words = np.append(codes, np.uint64(0))
    at, key, moved, seen = np.arange(n), np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int8), np.arange(n)
    for step in range(sampled[-1] + 1):
        if step in sampled:
            key = mix(key * BASE + words[at])
            moved += at != seen
            seen = at
        if step < sampled[-1]:
            at = np.minimum(at + ((bits[at] >> np.uint64(step)) & np.uint64(1)).astype(np.int64), n)
    good = np.flatnonzero((at < n) & (moved >= 2))
    return good, at[good], key[good]


def _edited(item: list[int], kind: str, edits: int, rng: random.Random) -> list[int]:
    words = list(item)
    for _ in range(edits):
        how = rng.choice(["replace", "insert", "delete"]) if kind == "mixed" else kind
        at = rng.randrange(len(words))
        words[at:at + (how != "insert")] = [] if how == "delete" else [rng.getrandbits(62)]
    return words


def _keys_by_row(texts: list[list[int]], walk: int, sampled: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of a walk over each of ``texts``; equal signatures of different rows differ here."""
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    start, last, keys = walk_keys(np.array([w for t in texts for w in t], dtype=np.uint64), walk, sampled)
    own = rows[start] == rows[last]
    row = rows[start[own]]
    return row, mix(keys[own] + mix(row.astype(np.uint64) + np.uint64(1)))


@cache
def walks_needed(words: int, params: LeakParams, trials: int = 200) -> int:
    """Fewest walks by which ``target`` of the items of ``words`` words are found at the edit limit, for each kind of edit."""
    rng = random.Random(words)
    wanted = 1
    for kind in ("replace", "insert", "delete", "mixed"):
        items = [[rng.getrandbits(62) for _ in range(words)] for _ in range(trials)]
        texts = [_edited(item, kind, params.edits(words), rng) for item in items]
        hits, walks = np.zeros(trials, dtype=int), 0
        while walks < params.most_walks and (walks < wanted or (hits >= params.need).mean() < params.target):
            row, keys = _keys_by_row(texts, walks, params.sampled)
            hits += np.bincount(row[np.isin(keys, _keys_by_row(items, walks, params.sampled)[1])], minlength=trials)
            walks += 1
        wanted = walks
    return wanted


def _band(words: int) -> int:
    """The size that stands for items of ``words`` words: all up to 16, then some eight sizes for each doubling."""
    step = max(1, 1 << max(0, words.bit_length() - 4))
    return min(words // step * step, 256)


def _signatures(items: list[np.ndarray], params: LeakParams) -> list[Signatures]:
    found: dict[tuple, list] = {}
    for owner, item in enumerate(items):
        if len(item) < params.min_words:
            found.setdefault((None, len(item)), []).append((run_hashes(item, len(item)), np.array([owner]), np.array([0])))
            continue
        # repeated words give an item fewer different signatures than a random one: one walk more
        for walk in range(walks_needed(_band(len(item)), params) + 1):
            places, _, keys = walk_keys(item, walk, params.sampled)
            found.setdefault((walk, 0), []).append((keys, np.full(len(keys), owner), places))
    out = []
    for (walk, length), parts in found.items():
        keys, owners, places = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        bits = np.uint64((1 << max(10, int(len(keys) * 8).bit_length())) - 1)
        table = np.zeros(int(bits) + 1, dtype=bool)
        table[keys & bits] = True
        out.append(Signatures(walk, length, keys[order], owners[order].astype(np.int32), places[order].astype(np.int32), table))
    return out


def _met(codes, rows, groups, sampled):
    """(group, place, first signature, number) of the places whose signature some item has, in order of places."""
    found = [[], [], [], []]
    for g, group in enumerate(groups):
        if group.walk is None:
            hashes = run_hashes(codes, group.length)
            start = np.arange(len(hashes))
            last = start + group.length - 1
        else:
            start, last, hashes = walk_keys(codes, group.walk, sampled)
        own = np.flatnonzero(group.filter[hashes & np.uint64(len(group.filter) - 1)])
        own = own[rows[start[own]] == rows[last[own]]]
        low = np.searchsorted(group.keys, hashes[own], side="left")
        times = np.searchsorted(group.keys, hashes[own], side="right") - low
        good = times > 0
        for column, x in zip(found, (np.full(int(good.sum()), g), start[own[good]], low[good], times[good]), strict=True):
            column.append(x)
    group, place, low, times = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in found)
    order = np.argsort(place, kind="stable")
    return group[order], place[order], low[order], times[order]


def _least_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(edits, end) of the passage of ``text`` that is closest to ``item``, the first one of several."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    end = int(np.argmin(row))
    return int(row[end]), end


def closest_passage(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the passage of ``text`` closest to ``item``, in words."""
    edits, end = _least_edits(item, text)
    _, back = _least_edits(item[::-1], text[:end][::-1])
    return edits, end - back, end


def _close_places(row, item, shift, need, reach):
    """(row, item, first shift, last shift) of groups with ``need`` signatures of an item within ``reach`` words."""
    order = np.lexsort((shift, item, row))
    row, item, shift = row[order], item[order], shift[order]
    at = np.arange(len(row))
    last = np.minimum(at + need[item] - 1, len(row) - 1)
    good = (at + need[item] <= len(row)) & (row[last] == row) & (item[last] == item) & (shift[last] - shift <= reach[item])
    at, last = at[good], last[good]
    if not len(at):
        return
    new = np.ones(len(at), dtype=bool)
    # groups that share a signature are one
    new[1:] = (row[at[1:]] != row[at[:-1]]) | (item[at[1:]] != item[at[:-1]]) | (at[1:] > last[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    yield from zip(row[at[heads]], item[at[heads]], shift[at[heads]], shift[last[tails]], strict=True)


def _search(codes, first_word, rows, groups, items, params):
    """(row, item, edits, start word, end word) of the closest passage for each row and item."""
    size = np.array([len(x) for x in items])
    limits = np.array([params.edits(n) for n in size])
    need = np.array([params.least(n) for n in size])
    near = []
    group, own, lo, times = _met(codes, rows, groups, params.sampled)
    owners, places = [np.concatenate([getattr(g, x) for g in groups]) for x in ("owners", "places")]
    lo = lo + np.concatenate([[0], np.cumsum([len(g.keys) for g in groups])])[group]
    # whole rows at a time; a row with more places than that is taken by itself
    total = np.cumsum(times)
    borders = np.flatnonzero(np.diff(rows[own])) + 1
    a = 0
    while a < len(own):
        done = int(total[a - 1]) if a else 0
        ends = np.append(borders[borders > a], len(own))
        fits = ends[total[ends - 1] <= done + params.max_pairs]
        b = int(fits[-1] if len(fits) else ends[0])
        n, start = times[a:b], lo[a:b]
        place = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        item = owners[place]
        shift = np.repeat(own[a:b], n) - places[place]
        near.extend(_close_places(np.repeat(rows[own[a:b]], n), item, shift, need, 2 * limits))
        a = b
    best = {}
    for row, item, low, high in near:
        row, item, limit = int(row), int(item), int(limits[item])
        a = max(int(first_word[row]), int(low) - limit)
        b = min(int(first_word[row + 1]), int(high) + int(size[item]) + 2 * limit)
        if np.isin(codes[a:b], items[item]).sum() < size[item] - limit:
            continue
        edits, start, end = closest_passage(items[item], codes[a:b])
        if edits <= limit and (edits, a + start) < best.get((row, item), (limit + 1, 0))[:2]:
            best[row, item] = (edits, a + start, a + end)
    for (row, item), (edits, start, end) in sorted(best.items()):
        yield row, item, edits, start, end


#: fixed values: first and last code points of scripts without spaces between words, CJK marks included
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3000, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _characters_apart(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray):
    """(start, end, row) of words, after characters of scripts without spaces have become words of their own."""
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return starts, ends, rows
    wide = data[lead] >= 0xF0
    byte = lambda k: (data[np.minimum(lead + k, len(data) - 1)] & 0x3F).astype(np.int64)
    three = ((data[lead].astype(np.int64) & 0x0F) << 12) | (byte(1) << 6) | byte(2)
    four = ((data[lead].astype(np.int64) & 0x07) << 18) | (byte(1) << 12) | (byte(2) << 6) | byte(3)
    point = np.where(wide, four, three)
    own = np.zeros(len(lead), dtype=bool)
    for low, high in UNSPACED:
        own |= (point >= low) & (point <= high)
    lead, after = lead[own], (lead + np.where(wide, 4, 3))[own]
    word = np.searchsorted(starts, lead, side="right") - 1
    cut = np.unique(np.concatenate([starts, lead, after[after < ends[word]]]))
    word = np.searchsorted(starts, cut, side="right") - 1
    return cut, np.minimum(np.append(cut[1:], len(data)), ends[word]), rows[word]


def _codes(texts: pa.Array):
    for first, last, data, offsets in pieces(texts):
        starts, ends, rows = _characters_apart(data, *word_bounds(data, offsets, MARKS))
        first_word = np.searchsorted(rows, np.arange(last - first + 1))
        yield first, data, offsets, starts, ends, rows, first_word, word_codes(data, starts, ends, MARKS)


def benchmark_passages(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """(doc_id, item_id, distance, item_words, start, end): the closest passage of each item that a document holds.

    start and end count code points of the text, end exclusive.
    """
    spark = docs.sparkSession
    own = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], FOUND)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size.n // params.block_items), -(-size.bytes // params.block_bytes))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow().combine_chunks()
        ids, words = [], []
        for first, _, _, _, _, _, first_word, codes in _codes(part.column("text")):
            for i in range(len(first_word) - 1):
                item = codes[first_word[i]:first_word[i + 1]]
                if len(item):
                    ids.append(part.column("item_id")[first + i].as_py())
                    words.append(item)
        if words:
            out = out.unionByName(_passages(own, ids, words, params))
    return out


def _passages(own: DataFrame, ids: list, items: list[np.ndarray], params: LeakParams) -> DataFrame:
    table = own.sparkSession.sparkContext.broadcast((ids, items, _signatures(items, params)))

    def run(batches):
        ids, items, groups = table.value
        for batch in batches:
            for first, data, offsets, starts, ends, rows, first_word, codes in _codes(batch.column(1)):
                if not len(codes):
                    continue
                out = [[] for _ in range(6)]
                for row, item, edits, a, b in _search(codes, first_word, rows, groups, items, params):
                    text = data[offsets[row]:offsets[row + 1]]
                    points = np.cumsum((text & 0xC0) != 0x80)
                    start, end = int(starts[a] - offsets[row]), int(ends[b - 1] - offsets[row])
                    values = (
                        batch.column(0)[first + row].as_py(), ids[item], edits, len(items[item]),
                        int(points[start]) - 1, int(points[end - 1]),
                    )
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                yield pa.record_batch(
                    [pa.array(x, t) for x, t in zip(out, [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64()] * 2, strict=True)],
                    names=[c.split()[0] for c in FOUND.split(", ")],
                )

    return own.mapInArrow(run, FOUND)
