"""URL verdicts: rules of host and path, and for the other urls gradient-boosted trees on lexical features.

Method. The longest rule that fits a url decides. The urls that rules judge are the labelled samples from which the trees
learn to judge the rest. Features are lexical: lengths, depth, digit shares, character entropy, counts of parameters
and separators, plus statistics of suffixes: for the last label of the host, its last two labels and the first
directory of the path, how many pages have it and which share of the labelled ones is blocked, drawn towards the share
of all labelled urls where there are few. A labelled url sees the shares of the other folds only, so that no url's own
label reaches its features.

On Spark: features are DataFrame expressions, statistics are grouped aggregations over all pages, joined as tables
(Spark broadcasts a side whose written size is small, and splits hot keys of the join otherwise). The trees are
spark.ml's, fitted on a bounded sample of labelled urls chosen by hash.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; it is judged by its other
features, null like an empty text; features of very long urls take time in proportion to their length, but for a sort
of their characters; urls that repeat are judged alike; where the labelled urls hold one verdict only, it is the verdict
of all others, and without any labelled url the verdict is allow; extra columns are ignored; an empty table gives no
rows; a null page_id keeps its row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.session import durable

# The rules of the registered query, as verdict, host and path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

KEYS = ("suffix", "site", "directory")
LEXICAL = (
    "url_length", "host_length", "path_length", "query_length", "labels", "depth", "hyphens", "host_digits", "digit_ratio",
    "entropy", "parameters", "fragment", "dots_in_path", "last_segment", "last_digits", "secure",
)


@dataclass(frozen=True)
class FilterParams:
    """``max_labelled``: about so many labelled urls fit the trees; ``smoothing``: weight of the overall blocked share."""

    rules: tuple[tuple[str, str, str], ...] = RULES
    max_labelled: int = 20_000
    folds: int = 5
    smoothing: float = 10.0
    trees: int = 20
    depth: int = 4
    rate: float = 0.3


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; of equally long ones that with the longer host, then a block."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r))
    fits = [((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)) for _, h, p in order]
    null = F.lit(None).cast("string")
    first = lambda values: F.coalesce(*[F.when(fit, F.lit(v)) for fit, v in zip(fits, values, strict=True)], null)
    return first([h + p for _, h, p in order]), first([v for v, _, _ in order])


def _entropy(text: Column) -> Column:
    """Bits a character: runs of the sorted characters are their counts."""
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))
    close = lambda s: F.when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(0.0)

    def step(s, c):
        same = s["last"] == c
        return F.struct(
            c.alias("last"), F.when(same, s["run"] + 1).otherwise(1.0).alias("run"),
            F.when(same, s["total"]).otherwise(s["total"] + close(s)).alias("total"),
        )

    n = F.char_length(text)
    total = F.aggregate(F.array_sort(F.split(text, "")), start, step, lambda s: s["total"] + close(s))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def _without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def url_features(pages: DataFrame, params: FilterParams = FilterParams()) -> DataFrame:
    """(page_id, url, host, path, rule, ruled, the keys of suffix statistics, lexical features)."""
    url = F.coalesce("url", F.lit(""))
    own = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, ruled = rule_of(F.col("host"), F.col("path"), params.rules)
    host, path = F.col("host"), F.col("path")
    size = F.char_length(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    last = F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)
    digits = size - _without(url, "[0-9]")
    return own.select("page_id", "url", "host", "path", rule.alias("rule"), ruled.alias("ruled")).withColumns({
        "suffix": F.substring_index(host, ".", -1),
        "site": F.substring_index(host, ".", -2),
        "directory": F.regexp_extract(path, "(?s)^/([^/]*)/", 1),
        "url_length": size,
        "host_length": F.char_length(host),
        "path_length": F.char_length(path),
        "query_length": F.char_length(query),
        "labels": F.char_length(host) - _without(host, r"\."),
        "depth": F.char_length(path) - _without(path, "/"),
        "hyphens": F.char_length(host) - _without(host, "-"),
        "host_digits": F.char_length(host) - _without(host, "[0-9]"),
        "digit_ratio": F.when(size > 0, digits / size).otherwise(0.0),
        "entropy": _entropy(url),
        "parameters": F.when(query != "", F.char_length(query) - _without(query, "&") + 1).otherwise(0),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
        "dots_in_path": F.char_length(path) - _without(path, r"\."),
        "last_segment": F.char_length(last),
        "last_digits": F.char_length(last) - _without(last, "[0-9]"),
        "secure": F.startswith(url, F.lit("https")).cast("int"),
    })


def with_suffix_statistics(rows: DataFrame, params: FilterParams = FilterParams()) -> DataFrame:
    """``rows`` of ``url_features`` with ``{key}_pages`` (log2) and ``{key}_blocked`` for each key."""
    folds = range(params.folds)
    known, blocked = F.col("ruled").isNotNull(), F.col("ruled") == "block"
    fold = F.pmod(F.xxhash64("url"), F.lit(params.folds)).cast("int")
    dealt = rows.withColumn("fold", F.when(known, fold))
    count = lambda what: F.count(F.when(what, 1)).cast("double")
    of_folds = lambda what: F.array(*[count(what & (F.col("fold") == i)) for i in folds])
    share = rows.agg((count(blocked) / F.nullif(count(known), F.lit(0.0))).alias("p")).first()["p"]
    share = 0.0 if share is None else float(share)
    for key in KEYS:
        found = durable(dealt.groupBy(F.col(key).alias("_key")).agg(
            F.count("*").alias("_pages"), of_folds(known).alias("_known"), of_folds(blocked).alias("_blocked")
        ))
        dealt = dealt.join(found, F.col(key) == F.col("_key"), "left")
        others = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) - F.coalesce(F.get(c, F.col("fold")), F.lit(0.0))
        dealt = dealt.withColumns({
            f"{key}_pages": F.log2(F.col("_pages").cast("double")),
            f"{key}_blocked": (others(F.col("_blocked")) + share * params.smoothing) / (others(F.col("_known")) + params.smoothing),
        }).drop("_key", "_pages", "_known", "_blocked")
    return dealt


def fitted(rows: DataFrame, params: FilterParams = FilterParams(), features: str = "features"):
    """The boosted trees of a bounded sample of the labelled rows, or the one verdict (1 block, 0 allow) these hold."""
    counts = {r["ruled"]: r["n"] for r in rows.filter("ruled is not null").groupBy("ruled").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return float("block" in counts)
    every = -(-sum(counts.values()) // params.max_labelled)
    sample = rows.filter(F.col("ruled").isNotNull() & (F.pmod(F.xxhash64(F.lit("fit"), "url"), F.lit(every)) == 0))
    sample = durable(sample.select(features, (F.col("ruled") == "block").cast("double").alias("y")))
    trees = GBTClassifier(
        featuresCol=features, labelCol="y", maxIter=params.trees, maxDepth=params.depth, stepSize=params.rate, maxBins=64, seed=1
    )
    return trees.fit(sample)


def judged(pages: DataFrame, params: FilterParams = FilterParams()) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) of every page; ``p_block`` is the trees' probability."""
    rows = with_suffix_statistics(url_features(pages, params), params)
    names = [*LEXICAL, *[f"{k}_{x}" for k in KEYS for x in ("pages", "blocked")]]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    rows = durable(rows.select("page_id", "url", "host", "path", "rule", "ruled", "features"))
    model = fitted(rows, params)
    if isinstance(model, float):
        scored = rows.withColumn("p_block", F.lit(model))
    else:
        scored = model.transform(rows).withColumn("p_block", vector_to_array("probability")[1])
    method = F.when(F.col("p_block") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.round("p_block", 6).alias("p_block")
    )
