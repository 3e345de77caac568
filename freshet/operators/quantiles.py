"""Exact interpolated quantiles of groups of any size, from brackets that are proved before they are used.

A sketch proposes a bracket of values around each wanted rank. Counts then prove it: it holds the rank when the rows
below it are no more than the rank and those up to its end are more. Wider brackets are counted in the same pass and
take the place of one that misses; the widest is the whole group. Only the rows inside a proved bracket are ranked,
by a range exchange that spreads even one bracket over many tasks. There is one route for groups of all sizes, and the
sketch decides what it costs, never what it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.operators.groups import join_groups
from freshet.operators.ranks import cumulated, value_counts
from freshet.session import durable

ACCURACY = 10_000  # the sketch's ranks are off by at most n / ACCURACY
REACHES = (2, 128)  # half-widths of the brackets, in units of 1 / ACCURACY
_OPEN = float("inf")


def sketched_ends(df: DataFrame, levels: list[float], by: list[str]) -> DataFrame:
    """(by, rows, n, ends): group sizes with and without unknown ``x``, and the ends of the brackets as the sketch has
    them, low and high by turns, for each level in each reach."""
    shares = [
        min(max(p + side * reach / ACCURACY, 0.0), 1.0) for reach in REACHES for p in levels for side in (-1, 1)
    ]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count("x").alias("n"), F.percentile_approx("x", shares, ACCURACY).alias("ends")
    )


def proved_brackets(df: DataFrame, levels: list[float], by: list[str], groups: DataFrame) -> DataFrame:
    """(by, rows, n, brackets): for each level the narrowest bracket that holds its rank, as (low, high, below)."""
    k = len(levels)
    end = lambda r, i, side: f"ends[{2 * (r * k + i) + side}]"
    counts = [
        f"count_if(x < {end(r, i, 0)}) AS _below_{r}_{i}, count_if(x <= {end(r, i, 1)}) AS _upto_{r}_{i}"
        for r in range(len(REACHES)) for i in range(k)
    ]
    counted = join_groups(df.where("x IS NOT NULL"), groups, by).groupBy(*by, "rows", "n", "ends").agg(
        *[F.expr(c) for pair in counts for c in pair.split(", ")]
    )

    def bracket(i: int) -> str:
        rank = f"({float(levels[i])!r}D * (n - 1))"
        entry = lambda low, high, below: f"named_struct('low', {low}, 'high', {high}, 'below', {below})"
        proved = [
            f"WHEN _below_{r}_{i} <= floor({rank}) AND ceil({rank}) < _upto_{r}_{i} "
            f"THEN {entry(end(r, i, 0), end(r, i, 1), f'_below_{r}_{i}')}"
            for r in range(len(REACHES))
        ]
        return f"CASE {' '.join(proved)} ELSE {entry('-double(\'inf\')', 'double(\'inf\')', '0L')} END"

    return counted.select(*by, "rows", "n", F.expr(f"array({', '.join(bracket(i) for i in range(k))}) AS brackets"))


def exact_quantiles(
    df: DataFrame, value: str, levels: list[float], by: list[str], groups: DataFrame | None = None
) -> DataFrame:
    """(by, rows, n, q): linearly interpolated quantiles of each group as an array in the order of ``levels``.

    ``rows`` counts the group's rows, ``n`` those with a known value; q is null where there is none. NaN counts as
    unknown. ``groups`` replaces the sketch's proposals. The table is scanned three times, and what is exchanged is some
    4 / ACCURACY of the rows per level where the sketch keeps its promise.
    """
    x = F.col(value).cast("double")
    own = df.select(*by, F.when(~F.isnan(x), F.when(x == 0, 0.0).otherwise(x)).alias("x"))
    groups = durable(sketched_ends(own, levels, by) if groups is None else groups)
    known = own.where("x IS NOT NULL")
    brackets = durable(proved_brackets(known, levels, by, groups))
    held = [f"CASE WHEN x BETWEEN brackets[{i}].low AND brackets[{i}].high THEN {i} END" for i in range(len(levels))]
    kept = join_groups(known, brackets, by).select(*by, "x", F.expr(f"explode(array({', '.join(held)})) AS _level"))
    counts = value_counts(kept.where("_level IS NOT NULL"), "x", [*by, "_level"])
    shares = ", ".join(f"{float(p)!r}D" for p in levels)
    ranked = join_groups(cumulated(counts, [*by, "_level"]), brackets, by).selectExpr(
        *[f"`{c}`" for c in by], "_level", "x", "c", f"array({shares})[_level] * (n - 1) AS _rank",
        "brackets[_level].below + before AS _first",
    )
    holds = lambda r: f"_first <= {r} AND {r} < _first + c"
    of = lambda i, when, what: f"max(CASE WHEN _level = {i} AND {when} THEN {what} END)"
    cells = [
        f"struct({of(i, holds('floor(_rank)'), 'x')} AS a, {of(i, holds('ceil(_rank)'), 'x')} AS b, "
        f"{of(i, 'true', '_rank - floor(_rank)')} AS s)"
        for i in range(len(levels))
    ]
    ends = ranked.groupBy(*by).agg(F.expr(f"array({', '.join(cells)}) AS _q"))
    # equal ends stand for themselves: the difference of two infinite ones is no number
    between = F.expr("transform(_q, e -> CASE WHEN e.a = e.b THEN e.a ELSE e.a + (e.b - e.a) * e.s END) AS q")
    return join_groups(groups.select(*by, "rows", "n"), ends, by).select(*by, "rows", "n", between)


def quantile_name(level: float) -> str:
    """q05 for 0.05, q975 for 0.975."""
    digits = f"{level:.3f}"[2:]
    return "q" + (digits[:2] if digits.endswith("0") else digits)


def named(levels: list[float]) -> list:
    """The entries of ``q`` as columns."""
    return [F.col("q")[i].alias(quantile_name(p)) for i, p in enumerate(levels)]


def pooled_quantiles(df: DataFrame, value: str, levels: list[float], by: list[str]) -> DataFrame:
    """Quantiles per group, one column per level, and the number ``n`` of known values; groups without any are left out."""
    return exact_quantiles(df, value, levels, by).where(F.col("n") > 0).select(*by, "n", *named(levels))


def quantile_table(df: DataFrame, value: str, levels: list[float], sets: list[list[str]], keys: list[str]) -> DataFrame:
    """Quantiles and group sizes for several groupings in one pass.

    ``keys`` lists every grouping column; a key outside a row's grouping is null there, and ``grouping`` tells which: the
    bits of the keys left out, the last key lowest.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    bit = lambda k: 1 << (len(keys) - 1 - keys.index(k))
    cells = [
        F.struct(
            F.lit(sum(bit(k) for k in keys if k not in s)).cast("long").alias("grouping"),
            *[(F.col(k) if k in s else F.lit(None).cast(kinds[k])).alias(k) for k in keys],
        )
        for s in sets
    ]
    spread = df.select(F.explode(F.array(*cells)).alias("_g"), F.col(value).alias("_value"))
    spread = spread.select(*[F.col("_g")[k].alias(k) for k in keys], F.col("_g")["grouping"].alias("grouping"), "_value")
    found = exact_quantiles(spread, "_value", levels, [*keys, "grouping"])
    return found.select(*keys, "grouping", F.col("rows").alias("n"), *named(levels))


def winsorized(df: DataFrame, value: str, p: float, name: str, series: list[str] = ("series_id",)) -> DataFrame:
    """Add ``value`` clipped to its p and 1 - p quantiles within the series."""
    ends = durable(exact_quantiles(df, value, [p, 1 - p], list(series)).select(*series, F.col("q").alias("_ends")))
    low, high = F.col("_ends")[0], F.col("_ends")[1]
    clipped = F.when(F.col(value) < low, low).when(F.col(value) > high, high).otherwise(F.col(value))
    return join_groups(df, ends, list(series)).withColumn(name, clipped).drop("_ends")


def train_quantiles(df: DataFrame, value: str, levels: dict[str, float], series: list[str] = ("series_id",)) -> DataFrame:
    """Add quantiles of the series' training rows as columns; null for a series without any."""
    train = df.where(F.col("split") == "train")
    ends = durable(exact_quantiles(train, value, list(levels.values()), list(series)).select(*series, F.col("q").alias("_q")))
    return join_groups(df, ends, list(series)).withColumns({c: F.col("_q")[i] for i, c in enumerate(levels)}).drop("_q")
