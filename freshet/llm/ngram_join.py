"""Near-duplicate documents by an exact Jaccard join of word shingles with PartEnum signatures.

Method. Sizes are cut into bands whose ends differ by at most the threshold, so linked sets lie in the same band or in
neighbouring ones. In a band, a Jaccard threshold bounds the number k of shingles in which two linked sets can differ.
The shingle domain is cut into ``n1 > k`` partitions (ranges of the shingle hash): linked sets agree in at least
``n1 - k`` partitions, and the projection of a set on a partition is a signature that both then share. A set shows only
its ``k + 1`` first signatures in one fixed order, which still guarantees a common one; signatures made of widespread
shingles alone come last in that order, so passages that many documents share do not gather their documents. A set
with so many empty partitions that only empty ones might agree shows all its signatures, the empty ones included. No
link is lost at any size.

Sets that share a signature are candidates. Their links are verified on the whole sets: first between the smallest
member of a signature group and the others, so a group of copies costs links in proportion to its size. Members still in
different components are compared with each other in groups up to ``large_group``, which is linear in the members.
Larger open groups are refined on the shingles themselves (prefix filter with places): shingles are put in one order,
those in few of these sets first, and linked sets share one among their first ``n - ceil(n * percent / 100) + 1``. From
the first one they share, each must have enough shingles left for the overlap that both sizes ask for. So the sets meet
by shingle and by the two sizes of a pair, a key whose sets are in one component is done, and in the others all sets
are first compared with the one that has the fewest rarer shingles, then those left in different components with each
other. No link between components is missed.

Text goes through Arrow batches and numpy; exchange, grouping, joins and components are Spark's. Sets are compared by
64-bit codes of their shingles.

Defined cases: null or empty text and text of white space have no shingle and link with nothing; fewer than five words
make one shingle; repeated rows and equal sets share a class; extra columns are ignored; an empty table gives no rows.
Rows whose id is null are left out, as links and classes are between ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.bytescan import in_small_batches, mix, pieces, shingle_sets, word_bounds, word_codes
from freshet.llm.components import components
from freshet.session import durable

#: signature rows held before they are sorted and handed on
FLUSH_ROWS = 1 << 17
#: signature rows of a bucket, which is grouped at once
BUCKET_ROWS = 1 << 17
#: members of a signature group in one row
GROUP_ROWS = 10_000
#: fewest 64-bit words of a set's parity bits
PARITY_LONGS = 16
#: 64-bit words of the fixed-size filter of wanted ids
FILTER_LONGS = 1 << 17
_HOT = np.uint64(1 << 63)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class JoinParams:
    """``percent``: Jaccard threshold; ``words``: words of a shingle.

    ``sample_docs`` and ``widespread``: a shingle found in ``widespread`` of about ``sample_docs`` documents counts as
    widespread. It only orders signatures and changes no result. ``large_group``: most members of a signature group
    that are compared pair by pair; it changes no result either.
    """

    percent: int = 75
    words: int = 5
    sample_docs: int = 16_384
    widespread: int = 4
    large_group: int = 64


class Bands:
    """Size bands, allowed differences and partition counts for a threshold."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ends = [0]

    def _grow(self, size: int) -> None:
        while self.ends[-1] < size:
            self.ends.append((self.ends[-1] + 1) * 100 // self.percent)

    def instances(self, size: int) -> list[tuple[int, int, int]]:
        """(instance, allowed differences, partitions) in which a set of ``size`` shows signatures.

        The differences follow from the set's own size and the largest partner it can have there; the partitions from
        the instance alone, as all its sets must be cut alike.
        """
        self._grow(size)
        band = int(np.searchsorted(self.ends, size))
        self._grow(self.ends[band] + 1)
        p, largest = self.percent, size * 100 // self.percent
        own, above = self.ends[band], self.ends[band + 1]
        out = [(band, (size + min(own, largest)) * (100 - p) // (100 + p), self._partitions(own))]
        if largest > own:
            out.append((band + 1, (size + min(above, largest)) * (100 - p) // (100 + p), self._partitions(above)))
        return out

    def _partitions(self, largest: int) -> int:
        k = 2 * largest * (100 - self.percent) // (100 + self.percent)
        return 2 * k + 6


def set_code(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix(sums ^ (sizes.astype(np.uint64) * _C3))


def _row_sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sum of each row's values; rows may be empty."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[borders[1:]] - total[borders[:-1]]


def _sets(texts: pa.Array, words: int):
    for first, last, data, offsets in pieces(texts):
        starts, ends, rows = word_bounds(data, offsets)
        u, borders = shingle_sets(word_codes(data, starts, ends), rows, last - first, words)
        yield first, last, u, borders


def signatures(u: np.ndarray, spread: np.ndarray, wide: np.ndarray, instance: int, k: int, n1: int) -> np.ndarray:
    """Signatures that the sorted set ``u`` shows; ``spread`` are its mixed codes, ``wide`` marks widespread ones."""
    part = ((u >> np.uint64(32)) * np.uint64(n1)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    at = part[starts]
    name = np.uint64(instance * int(_C2) & 0x7FFFFFFFFFFFFFFF)
    own = mix(np.add.reduceat(spread, starts) + (at + np.uint64(1)) * _C1 + name) >> np.uint64(1)
    own |= np.where(np.logical_and.reduceat(wide, starts), _HOT, np.uint64(0))
    if n1 - len(at) < n1 - k:
        return np.partition(own, k)[:k + 1] if len(own) > k + 1 else own
    empty = np.setdiff1d(np.arange(n1, dtype=np.uint64), at)
    return np.concatenate([own, (mix((empty + np.uint64(1)) * _C3 + name) >> np.uint64(1)) | _HOT])


def shingle_counts(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """(doc_id, n_shingles, code, parity): size, code and parity bits of each document's shingle set.

    Bit i of ``parity`` tells whether an odd number of shingles falls on i, so two sets differ in at least as many
    shingles as their parities have different bits. There are about as many bits as shingles, a power of two.
    """
    words = params.words

    def run(batches):
        for batch in batches:
            sizes, codes, bits, longs = [], [], [], []
            for _, _, u, borders in _sets(batch.column(1), words):
                n, spread = np.diff(borders), mix(u + _C1)
                sizes.append(n)
                codes.append(set_code(_row_sums(spread, borders), n))
                size = PARITY_LONGS << np.ceil(np.log2(np.maximum(n, 1) / (64 * PARITY_LONGS))).clip(0).astype(np.int64)
                begin = np.concatenate([[0], np.cumsum(size)])
                odd = np.zeros(begin[-1], dtype=np.uint64)
                bit = spread & np.repeat(64 * size - 1, n).astype(np.uint64)
                at = np.repeat(begin[:-1], n) + (bit >> np.uint64(6)).astype(np.int64)
                np.bitwise_xor.at(odd, at, np.uint64(1) << (bit & np.uint64(63)))
                bits.append(odd.view(np.int64))
                longs.append(size)
            if sizes:
                edges = np.concatenate([[0], np.cumsum(np.concatenate(longs))]).astype(np.int32)
                parity = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(bits)))
                size, code = np.concatenate(sizes), np.concatenate(codes).view(np.int64)
                yield pa.record_batch(
                    [batch.column(0), pa.array(size), pa.array(code), parity],
                    names=["doc_id", "n_shingles", "code", "parity"],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return own.mapInArrow(run, "doc_id long, n_shingles long, code long, parity array<long>")


def widespread_shingles(docs: DataFrame, params: JoinParams = JoinParams()) -> np.ndarray:
    """Sorted codes of widespread shingles, at most 50,000: a hint for the order of signatures."""
    words = params.words

    def run(batches):
        for batch in batches:
            for _, _, u, _ in _sets(batch.column(0), words):
                yield pa.record_batch([pa.array(u.view(np.int64))], names=["shingle"])

    every = max(1, docs.count() // params.sample_docs)
    found = (
        docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
        .mapInArrow(run, "shingle long")
        .repartition("shingle")  # nearly all are different: counting them before the exchange only takes memory
        .groupBy("shingle").count().filter(F.col("count") >= params.widespread)
        .orderBy(F.desc("count"), "shingle").limit(50_000)
        .select("shingle").toPandas()
    )
    return np.sort(found["shingle"].to_numpy(dtype=np.int64).view(np.uint64))


def signature_groups(docs: DataFrame, shingles: int, params: JoinParams = JoinParams()) -> DataFrame:
    """(grp, code): sets that share a signature, one row per member, groups of equal members once.

    ``shingles``, the size of all sets together, sets the number of buckets: a set shows fewer signatures than it has
    shingles, but for the smallest ones. Tasks take one bucket after another, so their memory does not follow the input.
    """
    spark = docs.sparkSession
    words, percent = params.words, params.percent
    wide_codes = spark.sparkContext.broadcast(widespread_shingles(docs, params))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * tasks, min(shingles // BUCKET_ROWS, 1 << 20))

    def flush(sigs, codes):
        """Rows of a bucket in one: 6 bytes of each signature, and the sets' codes with their numbers of rows."""
        sig, code = np.concatenate(sigs), np.concatenate(codes)
        # the low bits are even for common and for widespread signatures alike
        bucket = (sig & np.uint64((1 << 20) - 1)) % np.uint64(buckets)
        order = np.lexsort((code, bucket))
        sig, code = (sig[order] >> np.uint64(16)), code[order]
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        short = sig.view(np.uint8).reshape(-1, 8)[:, :6]
        names, out = [], ([], [], [])
        for b in np.flatnonzero(cut[1:] > cut[:-1]):
            own = code[cut[b]:cut[b + 1]]
            at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            names.append(b)
            out[0].append(short[cut[b]:cut[b + 1]].tobytes())
            out[1].append(own[at].tobytes())
            out[2].append(np.diff(np.append(at, len(own))).astype(np.uint32).tobytes())
        return pa.record_batch(
            [pa.array(names, pa.int32()), *[pa.array(x, pa.binary()) for x in out]],
            names=["bucket", "sigs", "codes", "counts"],
        )

    def show(batches):
        bands, hot = Bands(percent), wide_codes.value
        sigs, codes, held, seen = [], [], 0, set()
        for batch in batches:
            for _, _, u, borders in _sets(batch.column(0), words):
                spread = mix(u + _C1)
                wide = np.zeros(len(u), dtype=bool)
                if len(hot):
                    at = np.searchsorted(hot, u)
                    wide = hot[np.minimum(at, len(hot) - 1)] == u
                own = set_code(_row_sums(spread, borders), np.diff(borders))
                for r in range(len(borders) - 1):
                    a, b = borders[r], borders[r + 1]
                    if a == b or own[r] in seen:
                        continue
                    seen.add(own[r])
                    for instance, k, n1 in bands.instances(int(b - a)):
                        shown = signatures(u[a:b], spread[a:b], wide[a:b], instance, k, n1)
                        sigs.append(shown)
                        codes.append(np.full(len(shown), own[r]))
                        held += len(shown)
                    if held >= FLUSH_ROWS:
                        yield flush(sigs, codes)
                        sigs, codes, held, seen = [], [], 0, set()
        if held:
            yield flush(sigs, codes)

    def group(batches):
        """Groups of each bucket; its rows follow one another."""
        sigs, codes, at = [], [], None
        for batch in batches:
            for bucket, s, c, n in zip(*batch.columns, strict=True):
                if bucket.as_py() != at and sigs:
                    yield from grouped(np.concatenate(sigs), np.concatenate(codes))
                    sigs, codes = [], []
                at = bucket.as_py()
                short = np.frombuffer(s.as_py(), dtype=np.uint8).reshape(-1, 6)
                wide = np.zeros((len(short), 8), dtype=np.uint8)
                wide[:, :6] = short
                sigs.append(wide.reshape(-1).view(np.uint64))
                counts = np.frombuffer(n.as_py(), dtype=np.uint32)
                codes.append(np.repeat(np.frombuffer(c.as_py(), dtype=np.uint64), counts))
        if sigs:
            yield from grouped(np.concatenate(sigs), np.concatenate(codes))

    def grouped(sig, code):
        order = np.argsort(sig)
        sig, code = sig[order], code[order]
        same = sig[1:] == sig[:-1]
        shared = np.zeros(len(sig), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        sig, code = sig[shared], code[shared]
        if not len(sig):
            return
        order = np.lexsort((code, sig))
        sig, code = sig[order], code[order]
        keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (code[1:] != code[:-1])])
        sig, code = sig[keep], code[keep]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        sizes = np.diff(np.append(starts, len(sig)))
        named = mix(np.add.reduceat(mix(code + _C2), starts) + sizes.astype(np.uint64))
        _, at = np.unique(named[sizes > 1], return_index=True)
        starts, sizes, named = starts[sizes > 1][at], sizes[sizes > 1][at], named[sizes > 1][at]
        for a in range(0, len(starts), 2000):
            names, chunks, members = [], [], []
            for s, n, g in zip(starts[a:a + 2000], sizes[a:a + 2000], named[a:a + 2000], strict=True):
                for j in range(0, n, GROUP_ROWS):
                    names.append(g)
                    chunks.append(j // GROUP_ROWS)
                    members.append(code[s + j:min(s + n, s + j + GROUP_ROWS)].view(np.int64))
            yield pa.record_batch(
                [
                    pa.array(np.array(names, dtype=np.uint64).view(np.int64)),
                    pa.array(chunks, pa.int32()),
                    pa.array(members, pa.list_(pa.int64())),
                ],
                names=["grp", "chunk", "members"],
            )

    rows = docs.select("text").mapInArrow(show, "bucket int, sigs binary, codes binary, counts binary")
    groups = (
        rows.repartition(tasks, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(group, "grp long, chunk int, members array<long>")
        .groupBy("grp", "chunk").agg(F.first("members").alias("members"))
    )
    return groups.select("grp", F.explode("members").alias("code"))


def _of_wanted(docs: DataFrame, ids: DataFrame, made: Callable, schema: str, params: JoinParams) -> DataFrame:
    """Batches ``made(ids, sets, borders)`` of the documents whose id is in ``ids`` (id), and of a few others.

    ``ids`` become a bit filter of fixed size, so that texts are not exchanged to be selected.
    """
    words, spark = params.words, docs.sparkSession
    code = F.xxhash64("id")
    place = F.pmod(code, F.lit(FILTER_LONGS))
    found = (
        ids.groupBy(place.cast("int").alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(xxhash64(id), 40) & 63 as int))")).alias("bits"))
        .toPandas()
    )
    bits = np.zeros(FILTER_LONGS, dtype=np.int64)
    bits[found["at"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    wanted = spark.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches):
        for batch in batches:
            place, shift = (np.asarray(batch.column(i)) for i in (2, 3))
            mine = (wanted.value[place] >> shift.astype(np.uint64)) & np.uint64(1) == 1
            batch = batch.filter(pa.array(mine))
            for first, last, u, borders in _sets(batch.column(1), words):
                yield made(batch.column(0).slice(first, last - first), u, borders)

    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    shift = F.expr("shiftrightunsigned(xxhash64(id), 40) & 63")
    return own.select("id", "text", place, shift).mapInArrow(run, schema)


def shingle_arrays(docs: DataFrame, ids: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """(doc_id, shingles): shingle sets of the documents whose id is in ``ids`` (id), and of a few others."""

    def made(own, u, borders):
        lists = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(u.view(np.int64)))
        return pa.record_batch([own, lists], names=["doc_id", "shingles"])

    return _of_wanted(docs, ids, made, "doc_id long, shingles array<long>", params)


def shingle_prefixes(docs: DataFrame, ids: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """(shingle, rep, n, room): the shingles by which each wanted document meets all that it can link to.

    The order is that of the code, but at most 50,000 shingles found in more than ``large_group`` of these documents come
    last, the most frequent at the end. ``n`` is the size of the set, ``room`` counts its shingles from this one on.
    """
    percent = params.percent

    def every(own, u, borders):
        return pa.record_batch([pa.array(u.view(np.int64))], names=["shingle"])

    frequent = (
        _of_wanted(docs, ids, every, "shingle long", params)
        .groupBy("shingle").count().filter(F.col("count") > params.large_group)
        .orderBy(F.desc("count"), "shingle").limit(50_000)
        .select("shingle").toPandas()
    )
    codes = frequent["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    by_code = np.argsort(codes)
    late = docs.sparkSession.sparkContext.broadcast((codes[by_code], len(codes) - by_code))

    def shown(own, u, borders):
        hot, ranks = late.value
        n = np.diff(borders)
        row, size = np.repeat(np.arange(len(n)), n), np.repeat(n, n)
        rank = np.zeros(len(u), dtype=np.int64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
            rank = np.where(hot[at] == u, ranks[at], 0)
        order = np.lexsort((u, rank, row))
        room = size - (np.arange(len(u)) - np.repeat(borders[:-1], n))
        first = room >= (size * percent + 99) // 100
        return pa.record_batch(
            [pa.array(u[order][first].view(np.int64)), own.take(pa.array(row[first])), pa.array(size[first]), pa.array(room[first])],
            names=["shingle", "rep", "n", "room"],
        )

    return _of_wanted(docs, ids, shown, "shingle long, rep long, n long, room long", params)


def _may_link(n: str, n2: str, parity: str, parity2: str, percent: int) -> Column:
    """False only for sets that cannot link: sizes and parity bits bound their differences from below."""
    size = F.least(F.size(parity), F.size(parity2))

    def folded(p: str) -> Column:
        """Parity on half as many bits where the other set has only those; sizes of linked sets differ by less than two."""
        halves = F.zip_with(F.slice(p, F.lit(1), size), F.slice(p, size + 1, size), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(p) == 2 * size, halves).when(F.size(p) == size, F.col(p))

    bits = F.zip_with(folded(parity), folded(parity2), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    # most sets have the smallest parity, which is compared in generated code
    small = sum((F.bit_count(F.get(parity, F.lit(i)).bitwiseXOR(F.get(parity2, F.lit(i)))) for i in range(PARITY_LONGS)), F.lit(0))
    differ = F.when(F.greatest(F.size(parity), F.size(parity2)) == PARITY_LONGS, small).otherwise(
        F.aggregate(bits, F.lit(0), lambda a, x: a + x)
    )
    return (F.least(n, n2) * 100 >= F.greatest(n, n2) * percent) & (
        differ * (100 + percent) <= (F.col(n) + F.col(n2)) * (100 - percent)
    )


def _verified(pairs: DataFrame, docs: DataFrame, params: JoinParams) -> DataFrame:
    """Pairs (a, b) of ``pairs`` whose sets reach the threshold."""
    p = params.percent
    of = lambda x: shingle_arrays(docs, pairs.select(F.col(x).alias("id")), params).select(
        F.col("doc_id").alias(x), F.col("shingles").alias(f"of_{x}")
    )
    both = pairs.join(of("b"), "b").join(of("a"), "a").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    return both.filter(
        F.col("common") * 100 >= (F.size("of_a") + F.size("of_b") - F.col("common")) * p
    ).select("a", "b")


def _open_meetings(prefixes: DataFrame, params: JoinParams) -> DataFrame:
    """(shingle, n_a, n_b, rep, n, room, label): sets of each shingle and pair of sizes that may hold a missing link.

    Sets of the sizes ``n_a <= n_b`` link by a first common shingle only if both have room for their least overlap.
    """
    p = params.percent
    key = ["shingle", "n_a", "n_b"]

    def fits(room: Column) -> Column:
        return room * (100 + p) >= (F.col("n_a") + F.col("n_b")) * p

    sizes = prefixes.groupBy("shingle", "n").agg(
        F.max("room").alias("room"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    pairs = (
        sizes.toDF("shingle", "n_a", "room_a", "lo_a", "hi_a").join(sizes.toDF("shingle", "n_b", "room_b", "lo_b", "hi_b"), "shingle")
        .filter((F.col("n_a") <= F.col("n_b")) & fits(F.least("room_a", "room_b"))
                & (F.least("lo_a", "lo_b") < F.greatest("hi_a", "hi_b")))
        .select(*key, F.explode(F.array_distinct(F.array("n_a", "n_b"))).alias("n"))
    )
    rows = prefixes.join(pairs, ["shingle", "n"]).filter(fits(F.col("room")))
    still = rows.groupBy(*key).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    return rows.join(still.select(*key), key, "left_semi").select(*key, "rep", "n", "room", "label")


def near_duplicates(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach, the document's own included.
    """
    docs = in_small_batches(docs)
    counts = durable(shingle_counts(docs, params))
    distinct = durable(counts.filter("n_shingles > 0").groupBy("code").agg(
        F.min_by(F.struct("doc_id", "n_shingles", "parity"), "doc_id").alias("x")
    ).select("code", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n"), "x.parity"))
    shingles = counts.agg(F.sum("n_shingles")).first()[0] or 0
    members = durable(signature_groups(docs, shingles, params).join(distinct.select("code", "rep", "n"), "code").drop("code"))
    parity = distinct.select("rep", "parity")

    def may_link(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of ``pairs`` (a, n_a, b, n_b), each once, that sizes and parity bits allow."""
        return (
            pairs.select("a", "n_a", "b", "n_b").distinct()
            .join(parity.toDF("a", "parity_a"), "a").join(parity.toDF("b", "parity_b"), "b")
            .filter(_may_link("n_a", "n_b", "parity_a", "parity_b", params.percent)).select("a", "b")
        )

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn(
            "label", F.coalesce("component", "rep")
        ).drop("component")

    pivots = members.groupBy("grp").agg(F.min(F.struct("rep", "n")).alias("least")).select(
        "grp", F.col("least.rep").alias("a"), F.col("least.n").alias("n_a")
    )
    stars = durable(may_link(
        members.join(pivots, "grp")
        .filter((F.col("rep") != F.col("a")) & (F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * params.percent))
        .withColumnsRenamed({"rep": "b", "n": "n_b"})
    ))
    links = durable(_verified(stars, docs, params))
    labels = components(links)

    named = durable(labelled(members, labels).select("grp", "rep", "n", "label"))
    open_groups = durable(
        named.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("rep").alias("size"))
        .filter("lo < hi").select("grp", "size")
    )
    several = F.col("size") > params.large_group
    left = named.join(open_groups.filter(~several), "grp", "left_semi").join(parity, "rep")
    right = left.select(*[F.col(c).alias(c if c == "grp" else f"{c}2") for c in left.columns])
    rest = (
        left.join(right, (left["grp"] == right["grp"]) & (F.col("label") < F.col("label2"))
                  & _may_link("n", "n2", "parity", "parity2", params.percent))
        .select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))
    )
    large = durable(named.join(open_groups.filter(several), "grp", "left_semi").select("rep").distinct())
    if not large.isEmpty():
        prefixes = durable(shingle_prefixes(docs, large.withColumnRenamed("rep", "id"), params).join(large, "rep", "left_semi"))
        key = ["shingle", "n_a", "n_b"]
        met = durable(_open_meetings(labelled(prefixes, labels), params))
        hubs = met.groupBy(*key).agg(F.min(F.struct(F.col("n") - F.col("room"), "rep", "n", "label")).alias("hub"))
        around = durable(may_link(
            met.join(hubs, key).filter(F.col("label") != F.col("hub.label"))
            .select(F.col("hub.rep").alias("a"), F.col("hub.n").alias("n_a"), F.col("rep").alias("b"), F.col("n").alias("n_b"))
        ))
        stars = stars.unionByName(around)
        links = durable(links.unionByName(_verified(around, docs, params)))
        labels = components(links)
        met = durable(_open_meetings(labelled(prefixes, labels), params).join(distinct.select("rep", "n", "parity"), ["rep", "n"]))
        one = met.filter("n = n_a").select(*key, "rep", "label", "parity")
        two = met.filter("n = n_b").select(*key, F.col("rep").alias("rep2"), F.col("label").alias("label2"), F.col("parity").alias("parity2"))
        rest = rest.unionByName(
            one.join(two, key).filter(
                (F.col("label") != F.col("label2")) & ((F.col("n_a") < F.col("n_b")) | (F.col("label") < F.col("label2")))
                & _may_link("n_a", "n_b", "parity", "parity2", params.percent)
            ).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))
        )
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = durable(rest.distinct()).join(tried, ["a", "b"], "left_anti")
    more = durable(_verified(durable(rest), docs, params))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    classes = distinct.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "code", F.coalesce("component", "rep").alias("component")
    )
    return counts.select("doc_id", "n_shingles", "code").join(classes, "code", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )
