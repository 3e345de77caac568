"""Hard negatives, k-means and URL verdicts beside brute force, and their odd cases."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from freshet.llm import hard_negatives, ns_kmeans, rtree, url_filter
from pyspark.sql import functions as F

ROWS = "vec_id long, embedding array<float>, label int, rank int, v string, chunk string, score long"


def row(i, vector, label):
    return (i, vector, label, 1, "x", "c", 2)


def random_vectors(n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in v] for v in rng.normal(0, spread, (n, dim))]


def whole(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, scale=256):
    own = {(i, label, tuple(whole(v, scale))) for i, v, label, *_ in rows if i is not None and label is not None and fine(v)}
    out = []
    for a, la, va in [x for x in own if x[0] % 100 == 0]:
        scored = [(-sum(p * q for p, q in zip(va, v)), i, label) for i, label, v in own if len(v) == len(va)]
        positives = sorted((s, i) for s, i, label in scored if label == la and i != a)[:5]
        for ps, p in positives:
            fits = sorted((s, i) for s, i, label in scored if label != la and 80 * -ps <= 100 * -s <= 100 * -ps)
            out += [(a, p, r, n, -ps, -s) for r, (s, n) in enumerate(fits[:5], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rows = [row(i, v, i * 7 % 3) for i, v in enumerate(random_vectors(700, 6, 3))]
    same = [0.5, 0.25, 0.0, -0.5, 0.125, 1.0]
    rows += [row(1000 + i, same, i % 4) for i in range(300)]  # one very common vector
    rows += [row(2000, [0.0] * 6, 1), row(2001, [0.1] * 3, 1), row(2100, [0.2] * 3, 1), row(2002, [0.3] * 3, 2), row(2003, [], 1)]
    rows += [row(None, same, 1), row(2200, None, 1), row(2300, same, None), row(2400, [None] * 6, 1), row(2500, [float("nan")] * 6, 1)]
    rows += [row(2600, [float("inf")] + [0.0] * 5, 1), row(2700, [1e30] * 6, 1), rows[5], rows[0], row(600, same, 2)]
    return rows


def test_hard_negatives_equal_brute_force(spark, vectors):
    kept = [r for r in vectors if r[0] != 2700]
    df = spark.createDataFrame(kept, ROWS).repartition(3)
    tree = rtree.TreeParams(leaf_rows=8, fan_out=3, chunk_rows=64, block_bytes=500)
    rows = hard_negatives.vector_rows(df, F.col("label"), 256)
    out = hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, hard_negatives.MiningParams(tree=tree))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(kept)
    assert len(want) > 100
    assert sorted(map(tuple, out.collect())) == want


def test_hard_negatives_hold_huge_components_and_empty_tables(spark, vectors):
    df = spark.createDataFrame([r for r in vectors if r[0] in (2700, 2600, 3, 4, 5)], ROWS)
    rows = hard_negatives.vector_rows(df, F.col("label"), 256)
    assert max(abs(x) for r in rows.collect() for x in r["v"]) == 1 << 20
    hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0).collect()
    nothing = hard_negatives.vector_rows(spark.createDataFrame([], ROWS), F.col("label"), 256)
    assert hard_negatives.hard_negatives(nothing, F.col("vec_id") % 100 == 0).collect() == []


def test_tiles_hold_every_row_once():
    rng = np.random.default_rng(1)
    for n, dim in ((1, 3), (7, 1), (100, 2), (1000, 5), (50, 0)):
        leaves = list(rtree.tiles(rng.integers(-9, 9, (n, dim)), 8))
        assert sorted(np.concatenate(leaves)) == list(range(n))
        assert max(map(len, leaves)) <= 8


def test_boxes_bound_products_and_search_leaves_boxes_out():
    rng = np.random.default_rng(2)
    centres = rng.integers(-300, 300, (40, 3))
    points = np.repeat(centres, 30, axis=0) + rng.integers(-3, 4, (1200, 3))
    leaves = [points[x].astype(float) for x in rtree.tiles(points, 16)]
    ids = np.split(np.arange(1200), np.cumsum([len(x) for x in leaves])[:-1])
    label = np.zeros(len(leaves), dtype=np.int64)
    tree = rtree.Tree(
        np.array([x.min(axis=0) for x in leaves]), np.array([x.max(axis=0) for x in leaves]), label, label,
        np.array([x[0] for x in ids]), 4,
    )
    queries = rng.integers(-300, 300, (20, 3)).astype(float)
    low, high = tree.bounds(queries)
    everything = [queries @ x.T for x in leaves]
    for i, scores in enumerate(everything):
        assert (low[:, tree.first_leaf + i] <= scores.min(axis=1)).all()
        assert (high[:, tree.first_leaf + i] >= scores.max(axis=1)).all()
    assert (low[:, 0] <= low[:, 1:].min(axis=1)).all()
    windows = np.tile(np.array([-(1 << 61), 1 << 61]), (20, 1, 1))
    found = rtree.Found(windows, 5)
    own = {"id": np.full(20, -1), "label": np.zeros(20, dtype=np.int64), "v": queries}
    read = rtree.visit(tree, [(i, np.zeros(len(i), dtype=np.int64), x) for i, x in zip(ids, leaves)], own, found, True)
    best = -np.sort(-np.concatenate(everything, axis=1), axis=1)[:, :5]
    assert (found.scores[:, 0] == best).all()
    assert read < 20 * len(leaves) / 4


def brute_clusters(vectors, seeds, rounds):
    """Lloyd's rounds on Python's whole numbers."""
    centres = [list(x) for x in seeds]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((distance(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for v in vectors:
            members[near(v)[1]].append(v)
        for j, own in members.items():
            centres[j] = [sum(x) // len(own) for x in zip(*own)]
    return [near(v)[::-1] for v in vectors], centres


def test_kmeans_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    found = [[float(np.float32(x)) for x in c + rng.normal(0, 0.2, 8)] for c in rng.normal(0, 1, (9, 8)) for _ in range(70)]
    rows = [row(i, v, 0) for i, v in enumerate(found)] + [row(10_000 + i, [0.25] * 8, 0) for i in range(200)]
    odd = [row(1, None, 0), row(2, [0.1] * 7, 0), row(3, [None] * 8, 0), row(4, [float("nan")] * 8, 0), row(5, [float("-inf")] * 8, 0)]
    rows += [rows[3], row(None, [0.5] * 8, None)]
    params = ns_kmeans.ClusterParams(clusters=6, dim=8, scale=64, rounds=4, seed=3)
    df = spark.createDataFrame(rows + odd, ROWS).repartition(4)
    out = ns_kmeans.clustered(df, params).collect()
    own = [(i, whole(v, 64)) for i, v, *_ in rows]
    key = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    seeds = [v for _, v in sorted((key(i), v) for i, v in own if i is not None)[:6]]
    want, centres = brute_clusters([v for _, v in own], seeds, 4)
    order = lambda x: (x[0] is None, x)
    got = sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in out), key=order)
    assert got == sorted(((i, c, d) for (i, _), (c, d) in zip(own, want)), key=order)
    total = collections.Counter()
    for c, d in want:
        total[c] += d
    for r in out:
        assert (r["cluster_inertia"], r["inertia"]) == (total[r["cluster"]], sum(total.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


def test_kmeans_of_few_vectors_and_none(spark):
    params = ns_kmeans.ClusterParams(clusters=4, dim=2)
    two = spark.createDataFrame([row(1, [1e30, 0.0], 0), row(2, [0.5, 0.5], 0)], ROWS)
    assert [(r["cluster"] in (0, 1), r["distance"]) for r in ns_kmeans.clustered(two, params).collect()] == [(True, 0)] * 2
    assert ns_kmeans.clustered(spark.createDataFrame([], ROWS), params).collect() == []
    ties = spark.createDataFrame([row(i, [0.0, 0.0], 0) for i in range(9)], ROWS)
    assert {r["cluster"] for r in ns_kmeans.clustered(ties, params).collect()} == {0}


def test_bounds_save_evaluations_and_lose_nothing():
    rng = np.random.default_rng(8)
    v = np.concatenate([c + rng.integers(-20, 21, (300, 5)) for c in rng.integers(-200, 200, (8, 5))])
    history, state, evaluations = [v[rng.choice(len(v), 8, replace=False)]], (None, None, None), 0
    for turn in range(8):
        *state, read = ns_kmeans.assigned(v, *state, history)
        evaluations += read if turn else 0
        d = ns_kmeans.squared(v, history[-1])
        assert (state[0] == d.argmin(axis=1)).all()
        history.append(np.array([v[state[0] == j].sum(axis=0) // max(1, (state[0] == j).sum()) for j in range(8)]))
    assert evaluations < 0.5 * 7 * v.shape[0] * 8
    assert (state[1] >= 0).all() and state[2].min() < 7  # some distances are still those of earlier rounds


URLS = "page_id long, url string, host string, rule string, verdict string, fold int, features string, _key string"


def brute_rule(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[3:] if fits else (None, None))


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(4)
    rules = url_filter.RULES + (("block", "a.example.com", "/"), ("allow", "m.com", "/fr/x"), ("block", "com", "/fr/x.y"))
    hosts = ["example.org", "EXAMPLE.org", "a.b.example.org", "badexample.org", "org", "x.com", "a.example.com", "M.com", "m.com:80", "É.org", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/fr/", "/fr/x.y", "/fr/xy", "/de/#a", "?a=/de/", "#/de/", "/DE/", "/de/\n/es/"]
    urls = [f"{s}{h}{p}" for s in ("http://", "a\nb://", "//", "x://y://") for h in hosts for p in paths] + [None, "", "://", "plain"]
    rows = [(i, u, "h", "r", "v", 1, "f", "k") for i, u in enumerate(urls)] + [(None, urls[0], "h", "r", "v", 1, "f", "k")] * 2
    rng.shuffle(rows)
    found = url_filter.judged(spark.createDataFrame(rows, URLS), url_filter.FilterParams(rules=rules, trees=2)).collect()
    assert len(found) == len(rows)
    url = dict((r[0], r[1]) for r in rows)
    for r in found:
        host, path, rule, verdict = brute_rule(url[r["page_id"]], rules)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    good = lambda s: f"https://{word()}.{s}/{word()}/{word()}-{word()}.html"
    bad = lambda s: f"http://{word()}-{word()}-{word()}.{s}/{rng.randrange(10**9)}?id={rng.randrange(10**9)}&u={word()}&v=1"
    urls = [(good("good"), "allow") for _ in range(300)] + [(bad("bad"), "block") for _ in range(300)]
    held_out = [(good("new"), "allow") for _ in range(200)] + [(bad("new"), "block") for _ in range(200)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls + held_out)], "page_id long, url string")
    params = url_filter.FilterParams(rules=(("allow", "good", "/"), ("block", "bad", "/")))
    verdict = {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, params).collect()}
    wanted = [v for _, v in urls + held_out]
    assert all(verdict[i] == wanted[i] for i in range(600))
    assert sum(verdict[i] == wanted[i] for i in range(600, 1000)) >= 0.95 * 400


def test_labels_of_a_url_do_not_reach_its_own_features(spark):
    pages = [(i, f"http://h{i}.good/a/{i}") for i in range(20)] + [(50, "http://one.lone/x/1")]
    params = url_filter.FilterParams(rules=(("allow", "good", "/"), ("block", "lone", "/")))
    rows = url_filter.with_suffix_statistics(url_filter.url_features(spark.createDataFrame(pages, "page_id long, url string"), params), params)
    lone = rows.filter("page_id = 50").first()
    assert lone["suffix_blocked"] == pytest.approx(1 / 21) and lone["suffix_pages"] == 0


def test_url_features_of_odd_urls(spark):
    long = "http://x.org/" + "ab1/" * 50_000
    rows = [(1, long), (2, "http://é.net/ä?b=1&c=2#f"), (3, None), (4, "aabb")]
    found = {r["page_id"]: r for r in url_filter.url_features(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    counts = collections.Counter(long)
    assert found[1]["entropy"] == pytest.approx(-sum(c / len(long) * math.log2(c / len(long)) for c in counts.values()))
    assert (found[1]["depth"], found[1]["url_length"]) == (50_001, len(long))
    assert (found[2]["parameters"], found[2]["fragment"], found[2]["suffix"], found[2]["query_length"]) == (2, 1, "net", 7)
    assert (found[3]["entropy"], found[3]["url_length"], found[3]["host"]) == (0.0, 0, "")
    assert found[4]["entropy"] == pytest.approx(1.0)


def test_verdicts_without_trees(spark):
    pages = lambda urls: spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    verdicts = lambda urls: [r["verdict"] for r in url_filter.judged(pages(urls)).orderBy("page_id").collect()]
    assert verdicts([]) == []
    assert verdicts(["http://a.net/", None]) == ["allow", "allow"]
    assert verdicts(["http://a.com/de/1", "http://a.net/"]) == ["block", "block"]
