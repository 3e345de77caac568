"""Page operators, the pipeline and the SQL counterparts."""

import math
import random
import re
import sys
import time
from pathlib import Path

import duckdb
import pytest

from freshet.llm import html_text, language
from freshet.llm.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT / "tools"))
SF_DIR = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, text string, lang string"

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><script>var t="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">Buy  this</div><article><h1>A &amp; B</h1>
<p><b>First   line.<br><p>Second&nbsp;one &lt;x&gt;</p><div class="ad-box ad">buy</div><form><input>send</form><p>Last.</p></article>
<div id="comments"><p>So good</p></div><footer>&copy; x</footer>"""


def test_main_text_of_cases():
    read = lambda x: html_text.main_text(x, {})
    assert read(PAGE) == ["A & B", "First line.", "Second one <x>", "Last."]
    assert read("") == [] and read("<p></p><br>") == [] and read("only words") == ["only words"]
    assert read("<nav>menu never closed<article><p>text</p></article>") == ["text"]
    assert read("<div><p>Long words of a text without article element here.</p><aside>no</aside><p>More of the words.</p></div>") == [
        "Long words of a text without article element here.", "More of the words."]
    assert read("<p>&amp;lt;b&amp;gt;</p>") == ["&lt;b&gt;"]
    assert len(read("<article>" + "<p>w w</p>" * 20_000 + "</article>")) == 20_000


def test_left_out_elements_end_where_their_holder_does():
    read = lambda x: html_text.read_page(x).blocks
    assert read('<article><h1>Title here now</h1><p class="notice">Sale<p>Body one two.</p><p>More of it</article>') == [
        "Title here now", "Body one two.", "More of it"]
    assert read('<p>Before text</p><ul><li class="share">Share<li>kept</ul><p>After') == ["Before text", "kept", "After"]
    assert read('<ul><li class="menu">A<ul><li>inner<li>more</ul><li>kept</ul>') == ["kept"]
    assert read('<table><tr><td class="ad">Buy<td>cell<tr class="promo"><td>x<tr><td>next</table>') == ["cell", "next"]
    assert read('<dl><dt class="ad">Buy<dd>told</dl>') == ["told"]
    assert read('<div><span class="ad">Buy<b>now</div><p>text') == ["text"]
    assert read('<article><div class="post-social-proof"><p>All of the text</p></div></article>') == ["All of the text"]
    assert read('<div class="ad-free story" id="comment-policy"><p>All of the text</p></div>') == ["All of the text"]
    assert read('<div class="ad-box"><p>buy</p></div><div id=site_footer>x</div><p>text</p>') == ["text"]
    assert read('<p title="a > b" data-x=\'<i>\'>one</p><a href="x"two</a><p>three < four</p>') == ["one", "three < four"]


@pytest.mark.parametrize("piece", ["a <b ", "<a \"", "<a '", "<p class=ad>x", "<div><b></i>", "<!x ", "<li class=menu>", "</p>", "<script>"])
def test_reading_takes_time_in_proportion(piece):
    start = time.process_time()
    html_text.main_text(piece * (1_000_000 // len(piece)), {})
    assert time.process_time() - start < 20


def test_best_region_is_the_largest_sum():
    rng = random.Random(0)
    for _ in range(300):
        scores = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        a, b = html_text.best_region(scores)
        sums = [sum(scores[i:j]) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1)]
        assert sum(scores[a:b]) == max(sums)


def test_learned_scores_find_articles_without_their_tags(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_text.learned_weights(pages)
    assert weights["tag:/article"] < weights["tag:/p"] < 0 < weights["word:p"]
    same = stripped = 0
    rows = pages.select("html").collect()
    for r in rows:
        page = html_text.read_page(r.html or "")
        article = [page.blocks[b] for b, *_, inside in page.events if b >= 0 and inside]
        same += html_text.main_text(r.html or "", weights) == article
        bare = re.sub("</?(?:article|main)[^>]*>", "", r.html or "")
        stripped += html_text.main_text(bare, weights) == article
    assert same == len(rows) and stripped >= 0.95 * len(rows)


def test_border_tags_keep_short_outside_text_away():
    weights = {"tag:article": -60.0, "tag:/article": -60.0, "word:p": 2.0, "word:body": 2.0}
    inside = " ".join(["word"] * 80)
    page = f"<p>Some lines before it</p><article><p>{inside}</p></article><p>Some lines after it</p>"
    assert html_text.main_text(page, weights) == [inside]
    assert len(html_text.main_text(page.replace("article", "div"), weights)) == 3


def test_extracted_rows(spark):
    rows = [(1, "u", PAGE, "x", "y"), (1, "u", PAGE, "x", "y"), (2, None, None, None, None), (None, "u", "", "", "")]
    got = html_text.extracted(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r.page_id or 0, r.n_chars, r.n_blocks) for r in got) == [(0, 0, 0), (1, 38, 4), (1, 38, 4), (2, 0, 0)]
    assert html_text.extracted(spark.createDataFrame([], PAGES)).collect() == []


def test_language_follows_the_evidence(spark):
    rng = random.Random(6)
    vocabulary = {"en": "the and river with house", "de": "der und fluss mit haus", "fr": "le et rivière avec maison"}
    say = lambda x, n: " ".join(rng.choice(vocabulary[x].split()) for _ in range(n))
    docs = spark.createDataFrame([(x, say(x, 200)) for x in vocabulary for _ in range(5)] + [(None, "x"), ("en", None)], "lang string, text string")
    html = lambda x, text: f"<html lang='{x}'><body><article><p>{text}</p></article></body></html>"
    rows = [(3 * i + k, f"https://h{x}.example.{x}/a", html(x, say(x, 40)), "", "") for i in range(60) for k, x in enumerate(sorted(vocabulary))]
    rows += [(900, "https://hde.example.de/b", html("de", ""), "", ""), (901, None, None, None, None), (902, "https://hen.example.en/c", html("fr", say("en", 60)), "", "")]
    got = {r.page_id: r for r in language.page_languages(spark.createDataFrame(rows, PAGES), docs).collect()}
    assert len(got) == len(rows) and all(got[i].lang == sorted(vocabulary)[i % 3] for i in range(180))
    assert got[900].lang == "de" and got[902].lang == "en" and got[902].declared_lang == "fr" and 0 < got[901].probability <= 1
    empty = spark.createDataFrame([], PAGES)
    assert language.page_languages(empty, docs).collect() == []
    assert language.page_languages(spark.createDataFrame(rows, PAGES), docs.filter("lang = 'x'")).collect() == []


def test_pages_without_text_have_no_vote(spark):
    rng = random.Random(7)
    vocabulary = {"de": "der und fluss mit haus", "en": "the and river with house"}
    say = lambda x, n: " ".join(rng.choice(vocabulary[x].split()) for _ in range(n))
    docs = spark.createDataFrame([(x, say(x, 200)) for x in vocabulary for _ in range(5)], "lang string, text string")
    text = lambda i, x: (i, "https://a.example.org/x", f"<html><body><p>{say(x, 40)}</p></body></html>", "", "")
    rows = [text(i, "en") for i in range(40)] + [text(i, "de") for i in range(40, 45)]
    empty = [(100 + i, "https://new.example.net/x", "<html><body></body></html>", "", "") for i in range(60)]
    told = [(200, None, "<html xml:lang='de-AT'></html>", "", ""), (201, None, '<meta http-equiv="Content-Language" content="de">', "", "")]
    of = lambda rs: {r.page_id: r for r in language.page_languages(spark.createDataFrame(rs, PAGES), docs).collect()}
    few, many = of(rows + empty[:1] + told), of(rows + empty + told)
    assert {many[i].lang for i in range(100, 160)} == {"en"} and all(many[i].text_lang is None for i in range(100, 160))
    assert [many[i].declared_lang for i in (200, 201)] == ["de", "de"]
    assert all(few[i].probability == pytest.approx(many[i].probability, abs=1e-12) for i in few)


def test_fusion_equals_its_definition(spark):
    """Evidence, declarations and host priors added up again in plain Python."""
    rng = random.Random(8)
    vocabulary = {"de": "der und fluss mit haus", "en": "the and river with house", "fr": "le et avec maison pont"}
    say = lambda x, n: " ".join(rng.choice(vocabulary[x].split()) for _ in range(n))
    docs = spark.createDataFrame([(x, say(x, 100)) for x in vocabulary for _ in range(3)], "lang string, text string")
    names, params = sorted(vocabulary), language.LanguageParams()
    rows = []
    for i in range(120):
        x = rng.choice(names)
        declared = rng.choice(["", f" lang={x}", f" lang={rng.choice(names)}", " lang=xx"])
        host = rng.choice(["a.one.org", "b.one.org", "c.two.net", "two.net", ""])
        body = say(x, rng.choice([0, 2, 3, 30]))
        rows.append((i, f"https://{host}/" if host else None, f"<html{declared}><p>{body}</p></html>", declared[6:], host))
    frame = spark.createDataFrame(rows, PAGES)
    got = {r.page_id: r for r in language.page_languages(frame, docs, params).collect()}
    languages, logs = language.text_model(docs, params)
    assert languages == names
    evidence = {r.page_id: r.evidence for r in language._text_evidence(frame, languages, logs, params).collect()}
    label = {i: max(range(3), key=lambda k: (e[k], -k)) if any(e) else None for i, e in evidence.items()}
    form = {r[0]: "none" if not r[3] else r[3] if r[3] in names else "other" for r in rows}
    host = {r[0]: r[4] for r in rows}
    voters = [i for i in label if label[i] is not None]
    true = [sum(label[i] == k for i in voters) for k in range(3)]
    declare = {f: [math.log((sum(label[i] == k and form[i] == f for i in voters) + 1) / (true[k] + 5)) for k in range(3)] for f in [*names, "none", "other"]}
    levels = (lambda h: h.rsplit(".", 1)[-1], lambda h: ".".join(h.rsplit(".", 2)[-2:]), lambda h: h)
    for i in evidence:
        prior = [(t + 1) / (len(voters) + 3) for t in true]
        for of in levels:
            mine = [label[j] for j in voters if of(host[j]) == of(host[i])]
            prior = [(mine.count(k) + params.weight * prior[k]) / (len(mine) + params.weight) for k in range(3)]
        total = [evidence[i][k] + declare[form[i]][k] + math.log(prior[k]) for k in range(3)]
        shares = [math.exp(t - max(total)) for t in total]
        assert got[i].lang == names[shares.index(max(shares))]
        assert got[i].probability == pytest.approx(max(shares) / sum(shares), rel=1e-9)


@pytest.fixture(scope="module")
def duck():
    if not Path(SF_DIR).exists():
        pytest.skip("driver tables are not here")
    import check_sql

    con = duckdb.connect()
    for t in check_sql.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    import check_sql

    ok, note = check_sql.compare(spark, duck, name, SF_DIR)
    assert ok, note


def test_every_dealt_query_is_registered():
    numbers = sorted(int(q[2:].split("_")[0]) for q in QUERIES)
    assert numbers == list(range(1, 14))


def test_pipeline_stages(spark, duck):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = p.durable(stage(spark, docs, SF_DIR))
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    packed = p.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.select("doc_id").distinct().count() == before
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert rows(p.run(spark, SF_DIR)) == rows(packed)


def test_stages_take_odd_tables(spark, duck):
    import corpus_pipeline as p

    schema = spark.read.parquet(f"{SF_DIR}/documents.parquet").schema
    words = " ".join(f"w{i}" for i in range(40)) + " the of and to in"
    for rows in ([], [(None, None, None, None, None), (1, words, "en", "s", 5), (1, words, "en", "s", 5), (None, words + " x", "en", None, None), (2, "", None, None, 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in p.STAGES:
            docs = stage(spark, docs, SF_DIR)
        assert {r.doc_id for r in docs.collect()} == ({1} if rows else set())


def test_rows_without_an_id_and_repeated_ids_are_judged_like_others(spark, duck):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    say = lambda a: " ".join(f"{a}{i}" for i in range(60))
    rows = [(7, say("a"), "en", "s", 1), (3, say("a"), "en", "t", 1), (None, say("a") + " end", "en", "s", 1), (3, say("b"), "en", "s", 1),
            (3, say("b"), "en", "s", 1), (None, say("c"), "en", "s", 1), (None, say("c"), None, "s", 1), (9, None, "en", "s", 1), (9, "", "en", "s", 1)]
    kept = p.one_of_each_group(spark, spark.createDataFrame(rows, schema), SF_DIR).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:2]) for r in kept) == [(0, "c0"), (3, "a0"), (3, "b0"), (9, ""), (9, "")]
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").filter("length(text) > 200").first().text
    leaks = [(None, item, "en", "s", 1), (4, "so " + item + " it", "en", "s", 1), (4, say("d"), "en", "s", 1), (None, say("e"), "en", "s", 1)]
    clean = p.without_benchmark(spark, spark.createDataFrame(leaks, schema), SF_DIR).collect()
    assert sorted((r.doc_id or 0, r.text[:2]) for r in clean) == [(0, "e0"), (4, "d0")]
