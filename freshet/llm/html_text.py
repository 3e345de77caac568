"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score by the block that holds them, tags score below zero, and one linear
scan finds the contiguous region with the largest sum. The scores are counted on labelled pages: pages with exactly one
article element, whose inside is the label. A word scores the log-odds of lying inside for words of its kind of block; a
tag costs ``border_cost`` times the share of its occurrences at which the label changes, and a little in any case. So
the tags around an article are dear to cross by what was learned, and pages without them are read by the same scores.
Counting is a grouped aggregation over a sample of about ``sample_pages`` pages; its result has two rows for each
element name of ``BLOCKS`` and two for all others.

Menus, adverts, forms and the like (by element name, or by class or id) score nothing and are left out of the text,
also inside the region. The text of a block has single spaces, blocks are joined by line breaks; line-break elements
end a block. Character references are decoded once, after the markup is read.

Defined cases: null or empty html and pages without a word have empty text; unclosed elements end with what holds
them or where the next element implies it; reading takes time in proportion to the page; repeated rows are read
each; extra columns are ignored; an empty table gives no rows. Without labelled pages all words score the same.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.bytescan import in_small_batches

TEXTS = "page_id long, url string, text string, n_chars long, n_blocks int"
#: fixed values: elements by their part in a page, and words in class or id that mark what is no main text
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
LEFT_OUT = frozenset(
    "nav menu aside footer form script style noscript template iframe object svg button select textarea dialog head "
    "title".split()
)
LEFT_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer footer header menu modal nav navbar navigation newsletter notice notices popup promo related "
    "share sidebar social sponsor sponsored subscribe widget".split()
)
PLAIN_NAMES = frozenset(
    "area bar block box bottom button container content footer group header inner item items left link links list main outer "
    "overlay page panel right row section site slot text title top unit wrap wrapper".split()
)
#: fixed values: elements whose end tag may be left out, with the elements that shelter one and those whose start ends it
IMPLIED_END = {
    "li": (("ul", "ol", "menu"), ("li",)),
    "dt": (("dl",), ("dt", "dd")),
    "dd": (("dl",), ("dt", "dd")),
    "td": (("table",), ("td", "th", "tr", "tbody", "tfoot")),
    "th": (("table",), ("td", "th", "tr", "tbody", "tfoot")),
    "tr": (("table",), ("tr", "tbody", "tfoot")),
    "option": (("select", "datalist"), ("option", "optgroup")),
}
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# a quoted value has at most 10,000 characters, so that a stray quote costs no scan of the page
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>?|"
    r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]{0,10000}+\"|'[^']{0,10000}+'|[\"'])*+)(?:>|(?=<)|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class ExtractParams:
    sample_pages: int = 2_000
    border_cost: float = 60.0
    word_limit: float = 2.0
    tag_cost: float = 0.1


@dataclass
class Page:
    """Words and tags of a page in order: blocks as (text, context, inside article), and events that point at them."""

    blocks: list = field(default_factory=list)
    events: list = field(default_factory=list)  # (block number or -1, number of words, tag, inside article)
    articles: int = 0


class OpenElements:
    """Names of the elements that are open; one lookup and one removal for each tag, however deep they nest."""

    def __init__(self, *names: str):
        self.names, self.count = list(names), Counter(names)

    def open(self, name: str) -> None:
        self.names.append(name)
        self.count[name] += 1

    def close(self, name: str) -> None:
        """End the innermost element of that name and all that it holds."""
        while self.names:
            last = self.names.pop()
            self.count[last] -= 1
            if last == name:
                return

    def __contains__(self, name: str) -> bool:
        return self.count[name] > 0

    def __bool__(self) -> bool:
        return bool(self.names)


def _ends(name: str, inside: OpenElements, new: str) -> bool:
    """Whether the start of ``new`` ends an element ``name`` whose end tag may be left out."""
    if name == "p":
        return new in BLOCKS and new != "br"
    holders, followers = IMPLIED_END.get(name, ((), ()))
    return new in followers and not any(h in inside for h in holders)


def _left_out(name: str, attributes: str, inside: int) -> bool:
    """Whether an element and all it holds is no main text, by its name or by a class, id or role of it."""
    if name in LEFT_OUT or (name == "header" and not inside):
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for value in _NAMES.finditer(attributes):
        for word in value[1].strip("\"'").lower().split():
            parts = _PART.findall(word)
            if name == "article":
                if "comment" in parts or "comments" in parts:
                    return True
            # a compound says so only where its other parts say nothing else
            elif any(p in LEFT_OUT_NAMES for p in parts) and all(p in LEFT_OUT_NAMES or p in PLAIN_NAMES for p in parts):
                return True
    return False


def read_page(source: str) -> Page:
    """Blocks and tags of ``source`` outside of the elements that are left out.

    One pass: a tag ends at its ``>``, or before the next ``<`` that no quotes hold. An element that is left out ends at its
    end tag, where the end tag of what holds it stands, or where the next element implies its end.
    """
    page = Page()
    parts: list[str] = []
    context, inside, out_name, at = "body", 0, "", 0
    holders, held = OpenElements(), OpenElements()

    def close() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            page.events.append((len(page.blocks), text.count(" ") + 1, context, inside > 0))
            page.blocks.append(text)

    n = len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            if not out_name:
                parts.append(source[at:])
            break
        if not out_name:
            parts.append(source[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        closing, name = m[1] == "/", m[2].lower()
        single = name in VOID or m[3].endswith("/")
        if name in RAW and not closing and not single:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(source, at)
            at = end.end() if end else n
            if not out_name:
                close()
            continue
        if out_name:
            if closing and name in held:
                held.close(name)
                out_name = out_name if held else ""
                continue
            ended = closing and name in holders or not closing and (
                _ends(out_name, held, name) or name in ("article", "main") and out_name != name
            )
            if not ended:
                if not closing and not single:
                    held.open(name)
                continue
            out_name = ""
        if closing and name in holders:
            holders.close(name)
        if not closing and not single:
            if _left_out(name, m[3], inside):
                close()
                out_name, held = name, OpenElements(name)
                continue
            holders.open(name)
        if name in BLOCKS:
            close()
            if name in ("article", "main"):
                inside = max(0, inside + (-1 if closing else 1))
                page.articles += name == "article" and not closing
            if name != "br":
                context = "body" if closing else name
        page.events.append((-1, 0, ("/" if closing else "") + name, inside > 0))
    close()
    return page


def _kind(tag: str) -> str:
    """Name under which a tag is counted: free names share one for opening and one for closing tags."""
    return tag if tag.lstrip("/") in BLOCKS else "/" if tag[0] == "/" else ""


def best_region(scores: list[float]) -> tuple[int, int]:
    """(first, after the last) of the contiguous scores with the largest sum, the first and shortest of several."""
    best, region, run, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > best:
            best, region = run, (start, i + 1)
    return region


def main_text(source: str, weights: dict[str, float], params: ExtractParams = ExtractParams()) -> list[str]:
    """Blocks of the best region; ``weights`` has the score of a word by "word:context" and of a tag by "tag:name"."""
    page = read_page(source)
    scores = []
    for block, words, name, _ in page.events:
        if block < 0:
            scores.append(weights.get("tag:" + _kind(name), -params.tag_cost))
        else:
            scores.append(words * weights.get("word:" + name, params.word_limit / 4))
    first, last = best_region(scores)
    return [page.blocks[block] for block, *_ in page.events[first:last] if block >= 0]


def learned_weights(pages: DataFrame, params: ExtractParams = ExtractParams()) -> dict[str, float]:
    """Scores of words by their block and of tags by their name, from pages with one article element.

    Counted are words inside and outside of it, and tags at which the label changes or stays.
    """

    def run(batches):
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for source in batch.column(0):
                page = read_page(source.as_py() or "")
                if page.articles != 1:
                    continue
                before = False
                for block, words, name, inside in page.events:
                    if block >= 0:
                        counts.setdefault("word:" + name, [0, 0])[not inside] += words
                    else:
                        counts.setdefault("tag:" + _kind(name), [0, 0])[inside == before] += 1
                        before = inside
            yield pa.record_batch(
                [
                    pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
                    pa.array([c[1] for c in counts.values()], pa.int64()),
                ],
                names=["name", "yes", "no"],
            )

    every = max(1, pages.count() // params.sample_pages)
    rows = (
        pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).select("html")
        .mapInArrow(run, "name string, yes long, no long")
        .groupBy("name").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()  # names of BLOCKS and two more
    )
    weights = {}
    for r in rows:
        if r.name.startswith("word:"):
            odds = math.log(r.yes + 0.5) - math.log(r.no + 0.5)
            weights[r.name] = max(-params.word_limit, min(params.word_limit, odds))
        else:
            weights[r.name] = -params.tag_cost - params.border_cost * r.yes / (r.yes + r.no)
    return weights


def extracted(pages: DataFrame, params: ExtractParams = ExtractParams()) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) of every page of ``pages`` (page_id, url, html)."""
    weights = learned_weights(in_small_batches(pages), params)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                blocks = [main_text(x.as_py() or "", weights, params) for x in part.column(2)]
                texts = ["\n".join(x) for x in blocks]
                yield pa.record_batch(
                    [
                        part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()),
                        pa.array([len(x) for x in texts], pa.int64()), pa.array([len(x) for x in blocks], pa.int32()),
                    ],
                    names=[c.split()[0] for c in TEXTS.split(", ")],
                )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, TEXTS)
