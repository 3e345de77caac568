"""SQL counterparts of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from freshet.llm.quality import COMMON_WORDS, SLOTS, STRICT

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, c.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) c ON a = doc_id"""

_P = STRICT
_LISTS = "CASE lang " + " ".join(
    f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON_WORDS.items()
) + " ELSE [] END"
_MOST_LISTED = "greatest(" + ", ".join(
    f"len(list_filter(w, lambda x: lower(x) IN ({', '.join(repr(x) for x in v)})))" for v in COMMON_WORDS.values()) + ")"
_REMOVED = lambda pattern: f"(length(text) - length(regexp_replace(text, '{pattern}', '', 'g')))"


def _distance_sql(name: str, by: str) -> str:
    """Jensen-Shannon distance of each document's histogram from the sum of its language's."""
    return f"""{name}_cells AS (
  SELECT doc_id, lang, base_failed, unnest(range({by})) AS i, unnest({name}) AS v FROM facts WHERE {name} IS NOT NULL),
{name}_sums AS (SELECT lang, i, sum(v) AS v FROM {name}_cells WHERE NOT base_failed GROUP BY 1, 2),
{name}_shares AS (
  SELECT c.doc_id, c.v / nullif(sum(c.v) OVER (PARTITION BY c.doc_id), 0) AS p,
         s.v / nullif(sum(s.v) OVER (PARTITION BY c.doc_id), 0) AS q
  FROM {name}_cells c JOIN {name}_sums s ON c.lang = s.lang AND c.i = s.i),
{name}_distance AS (
  SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
                                      + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
  FROM {name}_shares GROUP BY 1 HAVING count(p) > 0)"""


QUALITY = f"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, {_LISTS} AS list,
         {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i,
         unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS x FROM d WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY 1),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
b AS (
  SELECT d.doc_id, lang, list, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) AS n_chars,
         {_REMOVED('[#*$%&|<>]')} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, {_REMOVED('\\p{Lu}+')} AS upper, {_REMOVED('[0-9]+')} AS digit,
         {_REMOVED('[.,;:!?' + "''" + '"()\\-]+')} AS mark
  FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
facts AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         [word_chars - n_symbols - upper - digit - mark, upper, digit, mark, n_symbols, n_chars - word_chars] AS classes,
         CASE WHEN len(list) > 0 THEN list_transform(range(0, {SLOTS}), lambda k: len(list_filter(w,
           lambda x: coalesce(list_position(list, lower(x)), 0) = k))) END AS common,
         {_MOST_LISTED} AS most_listed
  FROM b),
{_distance_sql('classes', '6')},
{_distance_sql('common', str(SLOTS))},
bare AS (
  SELECT lang, sqrt(greatest(0, log2(2 / (1 + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (1 + q)) ELSE 0 END + 1 - q) / 2) AS d
  FROM (SELECT lang, (sum(v) FILTER (i = 0))::DOUBLE / nullif(sum(v), 0) AS q FROM common_sums GROUP BY 1))
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_words >= {_P.min_words_chars} AND c.d > {_P.max_char_distance}, false)
    AND NOT coalesce(n_words >= {_P.min_words_common} AND m.d > {_P.max_word_distance}, false)
    AND NOT coalesce(n_words >= {_P.min_words_common}
                     AND (m.d > {_P.max_none_share} * bare.d OR most_listed > n_words - common[1]), false) AS kept,
  round(c.d, 6) AS char_distance, round(m.d, 6) AS word_distance
FROM facts f LEFT JOIN classes_distance c ON c.doc_id = f.doc_id LEFT JOIN common_distance m ON m.doc_id = f.doc_id
  LEFT JOIN bare ON bare.lang = f.lang"""

#: components that are known and finite
_FINE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

HARD_NEGATIVES = f"""WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINE}),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""


def _kmeans(clusters: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds written out: cells (centroid number, component, value) and nearest centroids by turns."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT n, arg_min(c, d * {clusters} + c) AS c, min(d) AS d
  FROM (SELECT x.n, y.c, sum((x.x - y.x) * (x.x - y.x))::BIGINT AS d FROM cells x JOIN c{r} y USING (i) GROUP BY 1, 2) GROUP BY 1)""")
        if r < rounds:
            steps.append(f"""s{r} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM cells JOIN a{r} USING (n) GROUP BY 1, 2),
c{r + 1} AS (
  SELECT c, i, CASE WHEN s.n IS NULL THEN x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x FROM c{r} LEFT JOIN s{r} s USING (c, i))""")
    return f"""WITH kept AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND {_FINE}),
cells AS (SELECT n, unnest(range(64)) AS i, unnest(v) AS x FROM kept),
c0 AS (
  SELECT c - 1 AS c, unnest(range(64)) AS i, unnest(v) AS x FROM (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) AS c, v FROM kept WHERE vec_id IS NOT NULL) WHERE c <= {clusters}),
{', '.join(steps)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (n) JOIN h USING (c)"""


KMEANS = _kmeans()
