"""Secrets in texts: base forms and character Markov models, in DataFrame functions only.

Base kinds: ``assign`` (a value given to a name such as password or token), ``access`` (access key ids) and ``hex``
(long hexadecimal runs). The method adds ``random``: a run of at least ``min_length`` key characters whose mean
log-likelihood ratio per character step, between a Markov model of random strings and one of ordinary words, exceeds
``min_ratio``. Where the mean of the whole run does not, or a base span lies within, the pieces between / . = _ and - are
scored by their means, and beside them the stretches of the run that have the largest sums of step ratios less ``min_gain`` each: one linear scan ends a stretch where its sum falls to zero or by ``max_drop``
below its largest value, and the stretch goes up to that value. A stretch of at least ``min_length`` characters whose
mean exceeds ``min_ratio`` is added. Nothing added overlaps a base span.

Both models are bigram counts, smoothed towards their character shares, which have add-one smoothing. They are trained on a sample of about
``sample_docs`` documents, labelled by the base forms: matched values are random strings; other words of at least
``min_word`` key characters that occur twice or more are ordinary, since a random string hardly repeats. Each string
counts once. Without a sample the models are equal and nothing is added.

Positions count code points, end exclusive. Defined cases: null text is empty; repeated rows are searched each; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
#: fixed values: the base forms; runs of the same characters cannot be matched twice, so lengths stand in the pattern
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KEY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
PIECE = r"[A-Za-z0-9+]{{{},}}+"
SIZE = len(KEY_CHARS) + 1


@dataclass(frozen=True)
class SecretParams:
    min_length: int = 20
    min_ratio: float = 0.7
    min_gain: float = 0.35
    max_drop: float = 20.0
    min_word: int = 6
    smoothing: float = 10.0
    sample_docs: int = 20_000


def _let(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _run(least: int) -> str:
    return rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{{{least},}}+"


def _spans(text: Column, pattern: str, kind: int, valid=None) -> Column:
    """Array of (start, kind, end, value) of all matches of ``pattern``, from the lengths of what lies between them."""
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    total = lambda lengths: F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)

    def placed(matches: Column) -> Column:
        own = F.transform(matches, lambda x: F.length(x).cast("long"))

        def one(m: Column, i: Column, before: Column, lengths: Column) -> Column:
            start = total(F.slice(before, F.lit(1), i + 1)) + total(F.slice(lengths, F.lit(1), i))
            return F.struct(
                start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"), m.alias("value")
            )

        return _let(between, lambda b: _let(own, lambda n: F.transform(matches, lambda m, i: one(m, i, b, n))))

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    if valid is not None:
        found = valid(found)
    return F.when(text.rlike(pattern), found).otherwise(empty)


def _base(docs: DataFrame) -> DataFrame:
    """(doc_id, text, assign, access, hex): base spans by kind."""
    text = F.col("text")

    def long_values(found: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
        checked = _let(values, lambda v: F.transform(
            found, lambda m, i: F.when(F.length(F.get(v, i)) >= 6, m.withField("value", F.get(v, i)))
        ))
        return F.filter(checked, lambda m: m.isNotNull())

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.select(
        "doc_id", "text", _spans(text, ASSIGN, 0, long_values).alias("assign"), _spans(text, ACCESS, 1).alias("access"),
        _spans(text, HEX, 2).alias("hex"),
    )


def _steps(value: Column, use) -> Column:
    """``use`` of the array of (character, next character) numbers of ``value``; 0 stands for any other character."""
    numbers = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(KEY_CHARS), c))
    return _let(numbers, lambda n: use(F.transform(F.slice(n, F.lit(1), F.size(n) - 1), lambda x, i: x * SIZE + F.get(n, i + 1))))


def step_ratios(docs: DataFrame, params: SecretParams = SecretParams()) -> list[float]:
    """Log-likelihood ratio of each character step, random strings over ordinary words."""
    every = max(1, docs.count() // params.sample_docs)
    part = _base(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0))
    values = F.concat(*[F.transform(k, lambda m: m.getField("value")) for k in KINDS[:3]])
    words = F.regexp_extract_all("text", F.lit(_run(params.min_word)), F.lit(0))
    # words that hold a matched value are no ordinary ones
    ordinary = _let(values, lambda v: F.filter(words, lambda w: ~F.exists(v, lambda x: F.contains(w, x))))
    rows = part.select(F.explode(F.array(
        F.struct(F.lit(1).alias("random"), values.alias("strings")), F.struct(F.lit(0).alias("random"), ordinary.alias("strings")),
    )).alias("x")).select("x.random", F.explode("x.strings").alias("string"))
    counts = (
        rows.filter(F.length("string") >= params.min_word)
        .groupBy("random", "string").count().filter("random = 1 OR count >= 2")
        .select("random", F.explode(_steps(F.col("string"), lambda s: s)).alias("step"))
        .groupBy("random", "step").count().collect()
    )
    table = np.zeros((2, SIZE, SIZE))
    for r in counts:
        table[r.random, r.step // SIZE, r.step % SIZE] += r["count"]
    single = table.sum(axis=1, keepdims=True) + 1
    single /= single.sum(axis=2, keepdims=True)
    logs = np.log((table + params.smoothing * single) / (table.sum(axis=2, keepdims=True) + params.smoothing))
    return [round(float(x), 6) for x in (logs[1] - logs[0]).reshape(-1)]


def _random_spans(run: Column, base: Column, ratios: Column, params: SecretParams) -> Column:
    """Array of (start, kind, end) of the random strings in ``run`` that overlap no span of ``base``."""
    start, end = run.getField("start"), run.getField("end")
    span = lambda a, z: F.struct(a.alias("start"), F.lit(3).alias("kind"), z.alias("end"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    never = F.lit(-1e9)
    near = F.filter(base, lambda x: (x.getField("start") < end) & (start < x.getField("end")))

    def stretches(scores: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            at, first, last, out = (a.getField(k) for k in ("at", "first", "last", "out"))
            total, best = a.getField("total") + x - params.min_gain, a.getField("best")
            stop = (total <= 0) | (total < best - params.max_drop)
            good = stop & (last - first + 1 >= params.min_length) & (best > (params.min_ratio - params.min_gain) * (last - first))
            ahead = total > best
            return F.struct(
                (at + 1).alias("at"), F.when(stop, at + 1).otherwise(first).alias("first"),
                F.when(stop | ahead, at + 1).otherwise(last).alias("last"),
                F.when(stop, F.lit(0.0)).otherwise(total).alias("total"),
                F.when(stop, F.lit(0.0)).when(ahead, total).otherwise(best).alias("best"),
                F.when(good, F.concat(out, F.array(span(start + first, start + last + 1)))).otherwise(out).alias("out"),
            )

        zero, nought = F.lit(0).cast("long"), F.lit(0.0)
        begin = F.struct(zero.alias("at"), zero.alias("first"), zero.alias("last"), nought.alias("total"), nought.alias("best"), none.alias("out"))
        return F.aggregate(F.concat(scores, F.array(never)), begin, step, lambda a: a.getField("out"))

    def scored(near: Column) -> Column:
        def chosen(scores: Column) -> Column:
            mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(x), F.lit(1))
            inner = lambda p: F.slice(scores, (p.getField("start") + 1).cast("int"), (p.getField("end") - p.getField("start") - 1).cast("int"))
            parts = F.filter(_spans(run.getField("value"), PIECE.format(params.min_length), 3), lambda p: mean(inner(p)) > params.min_ratio)
            placed = F.transform(parts, lambda p: span(start + p.getField("start"), start + p.getField("end")))
            apart = lambda found: F.filter(stretches(scores), lambda x: ~F.exists(
                found, lambda p: (p.getField("start") < x.getField("end")) & (x.getField("start") < p.getField("end"))
            ))
            pieces = _let(placed, lambda found: F.concat(found, apart(found)))
            return F.when((F.size(near) == 0) & (mean(scores) > params.min_ratio), F.array(span(start, end))).otherwise(pieces)

        # a step lies on two characters
        taken = lambda i: F.exists(near, lambda x: (x.getField("start") <= start + i + 1) & (start + i < x.getField("end")))
        plain = lambda s: F.transform(s, lambda x: F.get(ratios, x))
        free = lambda s: F.transform(s, lambda x, i: F.when(taken(i), never).otherwise(F.get(ratios, x)))
        return _steps(run.getField("value"), lambda s: _let(F.when(F.size(near) == 0, plain(s)).otherwise(free(s)), chosen))

    return _let(near, scored)


def secrets(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """Counts of base spans, a digest of them and all spans, for every document of ``docs`` (doc_id, text)."""
    ratios = F.from_json(F.lit(json.dumps(step_ratios(docs, params))), "array<double>")
    found = _base(docs).select(
        "doc_id", "assign", "access", "hex", _spans(F.col("text"), _run(params.min_length), 3).alias("runs")
    )
    plain = lambda column: F.transform(column, lambda m: m.dropFields("value"))
    both = found.withColumns({
        "base": F.array_sort(F.concat(plain("assign"), plain("access"), plain("hex"))),
    }).withColumn("added", _let(F.col("base"), lambda b: F.flatten(
        F.transform(F.col("runs"), lambda r: _random_spans(r, b, ratios, params))
    )))
    spelled = lambda spans: F.array_join(F.transform(spans, lambda m: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), m.getField("kind") + 1), m.getField("start"), m.getField("end")
    )), ",")
    return both.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.array_sort(F.concat(F.col("base"), F.col("added")))).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
    )
