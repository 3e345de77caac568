"""Language of web pages by Bayesian fusion of evidence.

The posterior of a page's language is the product of

* the likelihood of its main text under byte-trigram models, counted over all labelled documents, raised to
  ``text_power`` since overlapping trigrams repeat evidence;
* the likelihood of the language that its markup declares, given the true language;
* a prior of its host, smoothed towards its domain, then its address suffix, then all pages.

Declaration likelihoods and priors are grouped aggregations over all pages with text, labelled by their text alone; a
page without any evidence from its text has no label and no vote. Trigrams are
hashed to a fixed number of slots, so the text model has a fixed size for each language. The host join is salted: a
host that holds a third of all pages is spread over ``salts`` keys.

Defined cases: null or empty html gives no text evidence and a null ``text_lang``, a null url the empty host; a language is taken from the
labels of the documents, null labels are left out; more than ``max_languages`` labels are an error; without labelled
documents there is no row; repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.bytescan import _LOWER, in_small_batches, pieces
from freshet.llm.html_text import main_text, read_page
from freshet.session import durable

#: the language of the root element (lang or xml:lang), or of a header given in the markup
_DECLARED = re.compile(
    r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})"
    r"|<meta\b(?=[^<>]*\bhttp-equiv\s*=\s*[\"']?content-language\b)[^<>]*?\bcontent\s*=\s*[\"']?([A-Za-z]{2,3})",
    re.IGNORECASE,
)


@dataclass(frozen=True)
class LanguageParams:
    """``weight``: pages that a prior of the next wider level counts for."""

    slots: int = 1 << 15
    text_power: float = 0.25
    weight: float = 10.0
    max_languages: int = 64
    salts: int = 16


def _slots(data: np.ndarray, offsets: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of every byte trigram within a row."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low = _LOWER[data].astype(np.uint32)
    key = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    slot = ((key * np.uint32(0x9E3779B1)) >> np.uint32(8)).astype(np.int64) & (slots - 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = row[:-2] == row[2:]
    return slot[whole], row[:-2][whole]


def text_model(docs: DataFrame, params: LanguageParams = LanguageParams()) -> tuple[list[str], np.ndarray]:
    """Languages of the labelled documents and the log-probability of each trigram slot in each of them."""
    labelled = docs.filter("lang is not null and text is not null")
    languages = sorted(r.lang for r in labelled.select("lang").distinct().limit(params.max_languages + 1).collect())
    if len(languages) > params.max_languages:
        raise ValueError(f"more than {params.max_languages} languages")
    slots, number = params.slots, {x: i for i, x in enumerate(languages)}

    def run(batches):
        total = np.zeros(len(number) * slots, dtype=np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            for a, b, data, offsets in pieces(batch.column(1)):
                slot, row = _slots(data, offsets, slots)
                total += np.bincount(lang[a:b][row] * slots + slot, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    counts = np.ones(len(languages) * slots)
    if languages:
        found = (
            labelled.select("lang", "text").mapInArrow(run, "slot long, n long")
            .groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most slots for each language
        )
        counts[found["slot"].to_numpy(dtype=np.int64)] += found["n"].to_numpy(dtype=np.float64)
    counts = counts.reshape(len(languages), slots)
    return languages, np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))


def _text_evidence(pages: DataFrame, languages: list[str], logs: np.ndarray, params: LanguageParams) -> DataFrame:
    """(page_id, url, declared, evidence): the declared language code and the log-likelihood for each language."""
    model = pages.sparkSession.sparkContext.broadcast(logs)
    slots, power = params.slots, params.text_power

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sources = [x or "" for x in part.column(2).to_pylist()]
                texts = ["\n".join(main_text(x, {}) or read_page(x).blocks) for x in sources]
                declared = [(m[1] or m[2]).lower() if (m := _DECLARED.search(x)) else "" for x in sources]
                rows = np.zeros((len(texts), len(model.value)))
                for first, last, data, offsets in pieces(pa.array(texts, pa.string())):
                    slot, row = _slots(data, offsets, slots)
                    for i, log in enumerate(model.value):
                        rows[first:last, i] = power * np.bincount(row, weights=log[slot], minlength=last - first)
                yield pa.record_batch(
                    [
                        part.column(0), part.column(1), pa.array(declared, pa.string()),
                        pa.array(list(rows), pa.list_(pa.float64())),
                    ],
                    names=["page_id", "url", "declared", "evidence"],
                )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(
        run, "page_id long, url string, declared string, evidence array<double>"
    )


def _posterior(logs: Column) -> Column:
    top = F.array_max(logs)
    return F.get(F.transform(F.array(top), lambda t: F.transform(logs, lambda x: F.exp(x - t))), F.lit(0))


def _add(one: Column, other: Column) -> Column:
    return F.zip_with(one, other, lambda x, y: x + y)


def _prior(table: DataFrame, key: str, wider: Column, languages: list[str], weight: float) -> Column:
    """Shares of the languages among a key's pages, with ``weight`` pages of the wider shares."""
    return F.array(*[
        (F.col(f"n{i}") + weight * F.get(wider, F.lit(i))) / (F.col("n") + weight) for i in range(len(languages))
    ]).alias(f"{key}_prior")


def page_languages(pages: DataFrame, docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared_lang, host) of every page of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    out = "page_id long, lang string, probability double, text_lang string, declared_lang string, host string"
    languages, logs = text_model(in_small_batches(docs), params)
    if not languages:
        return spark.createDataFrame([], out)
    names = F.array(*map(F.lit, languages))
    best = lambda values: F.array_position(values, F.array_max(values)).cast("int") - 1
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    domain = F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0)
    suffix = F.regexp_extract("host", r"[^.]*$", 0)
    known = F.when(F.col("declared").isin(languages), F.col("declared")).otherwise(
        F.when(F.col("declared") == "", F.lit("none")).otherwise(F.lit("other"))
    )
    told_by_text = F.when(F.exists("evidence", lambda x: x != 0), best(F.col("evidence")))
    seen = durable(
        _text_evidence(pages, languages, logs, params)
        .withColumn("host", host).withColumns({"domain": domain, "suffix": suffix, "known": known, "label": told_by_text})
    )

    counted = [F.count("label").alias("n")] + [F.count(F.when(F.col("label") == i, 1)).alias(f"n{i}") for i in range(len(languages))]
    # one row for each language and two more
    told = {r.known: r for r in seen.groupBy("known").agg(*counted).collect()}
    true = [sum(r[f"n{i}"] for r in told.values()) for i in range(len(languages))]
    forms = [*languages, "none", "other"]
    declaration = {
        form: [math.log(((told[form][f"n{i}"] if form in told else 0) + 1) / (true[i] + len(forms))) for i in range(len(languages))]
        for form in forms
    }
    overall = F.array(*[F.lit((n + 1) / (sum(true) + len(true))) for n in true])
    by_host = seen.groupBy("host", "domain", "suffix").agg(*counted)
    sums = [F.sum(c).alias(c) for c in ("n", *[f"n{i}" for i in range(len(languages))])]
    suffixes = by_host.groupBy("suffix").agg(*sums)
    suffixes = suffixes.select("suffix", _prior(suffixes, "suffix", overall, languages, params.weight))
    domains = by_host.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    domains = domains.select("domain", _prior(domains, "domain", F.col("suffix_prior"), languages, params.weight))
    hosts = by_host.join(domains, "domain")
    hosts = hosts.select(
        "host", F.transform(_prior(hosts, "host", F.col("domain_prior"), languages, params.weight), lambda x: F.log(x)).alias("prior"),
        F.explode(F.sequence(F.lit(0), F.lit(params.salts - 1))).alias("salt"),
    )
    told_map = F.create_map(*[
        x for form in forms for x in (F.lit(form), F.array(*map(F.lit, declaration[form])))
    ])
    fused = (
        seen.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(params.salts)).cast("int"))
        .join(hosts, ["host", "salt"])
        .withColumn("logs", _add(_add(F.col("evidence"), F.col("prior")), told_map[F.col("known")]))
        .withColumn("shares", _posterior(F.col("logs")))
    )
    return fused.select(
        "page_id", F.get(names, best(F.col("shares"))).alias("lang"),
        (F.array_max("shares") / F.aggregate("shares", F.lit(0.0), lambda a, x: a + x)).alias("probability"),
        F.get(names, F.col("label")).alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared_lang"), "host",
    )
