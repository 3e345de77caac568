"""Quality rules by divergence from language references, in DataFrame functions only.

Base counts describe a document's words, symbols and repeats. The verdict compares two histograms of a document with
those of its declared language over the whole corpus, by Jensen-Shannon distance (base 2, 0 to 1): character classes,
and frequent words of the language. Short documents have no steady histogram, so each comparison has a minimum length.

References are sums over all documents of a language that pass the base rules, by one aggregation with partial sums.
They have one row per language.

A fixed word limit that holds for all languages is rarely passed. The rules in use (``STRICT``, of the query and of
``kept_documents``) therefore also reject a text whose distance exceeds ``max_none_share`` of the distance of a text
without any listed word from the same reference, and one whose words stand in another language's list more often than
in its own.

Defined cases: null text is empty; a document without words fails the base rules; a null language is a language of its
own, and a language without a word list is compared by character classes only; repeated rows are judged each; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.session import durable

#: fixed values: frequent function words by language
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans sur par au pas plus avec il elle".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo es más como".split(),
}
SLOTS = max(map(len, COMMON_WORDS.values())) + 1
LISTED = sorted({w for v in COMMON_WORDS.values() for w in v})
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[:SLOTS - 1]
WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class QualityParams:
    """Largest distances that are kept, and the fewest words from which each histogram counts.

    ``max_none_share``: largest word distance as a share of that of a text without listed words; None for no such limit
    and no comparison with other languages' lists.
    """

    max_char_distance: float = 0.22
    max_word_distance: float = 0.6
    min_words_chars: int = 20
    min_words_common: int = 60
    max_none_share: float | None = None


#: the rules in use
STRICT = QualityParams(max_none_share=0.85)


def _let(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in windows of eight words that occur twice or more, the first occurrence included."""
    codes = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(
        codes,
        lambda c: F.when(
            F.size(c) >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size(c) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(c, i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    )

    def covered(sorted_windows: Column) -> Column:
        def repeated(e: Column, i: Column) -> Column:
            near = [F.get(sorted_windows, j).getField("h") == e.getField("h") for j in (i - 1, i + 1)]
            return F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False))

        places = F.array_sort(F.transform(F.filter(sorted_windows, repeated), lambda e: e.getField("p")))
        return _let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
                F.lit(0).cast("long"), lambda a, x: a + x,
            ),
        )

    return _let(
        windows,
        lambda h: F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            _let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), covered),
        ).otherwise(F.lit(0).cast("long")),
    )


def _removed(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _facts(docs: DataFrame, others: bool = False) -> DataFrame:
    """``docs`` with struct column ``facts``: base counts and the two histograms as counts.

    With ``others``, ``most_listed`` is the largest number of words that one language's list holds.
    """
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.withColumns({
        "__words": F.array_remove(F.split(text, WHITE), ""),
        "__list": F.coalesce(F.get(F.array(lists[F.coalesce("lang", F.lit(""))]), F.lit(0)), F.array().cast("array<string>")),
        "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    words = F.col("__words")
    counted = split.withColumns({
        "__hits": F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(LISTED)),
        "__n": F.size(words).cast("long"),
        "__word_chars": F.length(F.array_join(words, "")).cast("long"),
        "__symbols": _removed(text, SYMBOLS),
        "__repeat": _repeat_words(words),
        "__dup": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__upper": _removed(text, r"\p{Lu}+"),
        "__digit": _removed(text, r"[0-9]+"),
        "__mark": _removed(text, r"[.,;:!?'\"()\-]+"),
    })
    n, chars, symbols, repeat = (F.col(c) for c in ("__n", "__word_chars", "__symbols", "__repeat"))
    space = F.length(text) - chars
    letters = chars - symbols - F.col("__upper") - F.col("__digit") - F.col("__mark")
    # the places of the words in the list as letters of one text, in which a letter is counted by taking it out
    place = lambda w: F.substring(F.lit("." + LETTERS), F.array_position(F.col("__list"), w).cast("int") + 1, F.lit(1))
    held = lambda places: [(F.length(places) - F.length(F.translate(places, c, ""))).cast("double") for c in LETTERS]
    common = _let(
        F.replace(F.array_join(F.transform("__hits", place), ""), F.lit("."), F.lit("")),
        lambda places: F.array((n - F.length(places)).cast("double"), *held(places)),
    )
    of_list = lambda listed: F.size(F.filter("__hits", lambda w: w.isin(listed)))
    listed = F.greatest(*map(of_list, COMMON_WORDS.values()))
    facts = F.struct(
        n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), F.col("__dup").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"), ((n < 20) | (100 * repeat > 30 * n)).alias("base_failed"),
        F.array(*[c.cast("double") for c in (letters, F.col("__upper"), F.col("__digit"), F.col("__mark"), symbols, space)])
        .alias("classes"),
        F.when(F.size("__list") > 0, common).alias("common"), *([listed.alias("most_listed")] if others else []),
    )
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns], facts.alias("facts"))


def _distance(one: Column, other: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; null where one is null or empty."""
    share = lambda c: _let(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), lambda s: F.when(s > 0, F.transform(c, lambda x: x / s)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(share(one), share(other), lambda x, y: part(x, (x + y) / 2) / 2 + part(y, (x + y) / 2) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def judged(docs: DataFrame, keep: list[str], params: QualityParams = QualityParams()) -> DataFrame:
    """Columns ``keep`` of ``docs`` (text, lang) with struct column ``facts``: counts, distances and ``kept``."""
    strict = params.max_none_share is not None
    facts = durable(_facts(docs, strict).select(*[F.col(f"`{c}`") for c in keep], F.coalesce("lang", F.lit("")).alias("__lang"), "facts"))
    sums = lambda name, size: F.array(*[F.sum(F.get(F.col(f"facts.{name}"), F.lit(i))) for i in range(size)])
    references = (
        facts.filter(~F.col("facts.base_failed")).groupBy("__lang")
        .agg(sums("classes", 6).alias("__classes"), sums("common", SLOTS).alias("__common"))
    )
    none = F.array(F.lit(1.0), *[F.lit(0.0)] * (SLOTS - 1))
    references = references.withColumn("__none", _distance(none, F.col("__common")))
    both = facts.join(references, "__lang", "left").withColumns({
        "__c": _distance(F.col("facts.classes"), F.col("__classes")),
        "__w": _distance(F.col("facts.common"), F.col("__common")),
    })
    n = F.col("facts.n_words")
    odd = F.coalesce((n >= params.min_words_chars) & (F.col("__c") > params.max_char_distance), F.lit(False)) | F.coalesce(
        (n >= params.min_words_common) & (F.col("__w") > params.max_word_distance), F.lit(False)
    )
    if strict:
        own = n - F.get(F.col("facts.common"), F.lit(0))
        far = (F.col("__w") > params.max_none_share * F.col("__none")) | (F.col("facts.most_listed") > own)
        odd = odd | F.coalesce((n >= params.min_words_common) & far, F.lit(False))
    verdict = ~F.col("facts.base_failed") & ~odd
    full = F.col("facts").withField("char_distance", F.col("__c")).withField("word_distance", F.col("__w"))
    return both.select(*[F.col(f"`{c}`") for c in keep], full.withField("kept", verdict).alias("facts"))


def quality(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, base counts, base_failed, kept and the two distances of every document."""
    own = docs.select("doc_id", "text", "lang")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(own, ["doc_id"], params).select(
        "doc_id", *[F.col(f"facts.{c}") for c in names], F.col("facts.char_distance"), F.col("facts.word_distance")
    )


def kept_documents(docs: DataFrame, params: QualityParams = STRICT) -> DataFrame:
    """Rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # free names, whatever the table has
    named = plain.withColumns({"text": F.col(f"c{columns.index('text')}"), "lang": F.col(f"c{columns.index('lang')}")})
    out = judged(named, plain.columns, params).filter("facts.kept").select(*plain.columns)
    return out.toDF(*columns)
