"""DuckDB statements for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       d.text_sha256, true AS in_history
FROM d JOIN g USING (text_sha256)
"""

_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, list_slice(w, s, s + 9) AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(phrase) AS n FROM windows),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, s, n, item_id FROM places JOIN windows USING (phrase)),
hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS at FROM found) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

# Bytes as pairs of hexadecimal digits: byte k of a text is at 2k + 1.
SUFFIX_DEDUP = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
strings AS (
  SELECT doc_id, k, substr(h, 2 * k + 1, 200) AS s
  FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS k FROM docs WHERE n >= 100)),
later AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS r FROM strings)
  WHERE r > 1),
marked AS (
  SELECT doc_id, k, CASE WHEN k <= lag(k) OVER w + 100 THEN 0 ELSE 1 END AS opens FROM later
  WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
spans AS (
  SELECT doc_id, min(k) AS a, max(k) + 100 AS b
  FROM (SELECT doc_id, k, sum(opens) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM marked) GROUP BY doc_id, run),
before AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM spans),
kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS e,
         string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS head
  FROM before JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

_GAPLESS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

# All pairs with a common shingle, and what is reachable over links.
NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_GAPLESS.format(_LOWER)} AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS s FROM w),
classes AS MATERIALIZED (SELECT list_sort(s) AS s, min(doc_id) AS class FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
members AS MATERIALIZED (SELECT doc_id, len(sets.s) AS n, class FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s),
shingles AS MATERIALIZED (SELECT class, len(s) AS n, unnest(s) AS shingle FROM classes),
links AS MATERIALIZED (
  SELECT a.class AS a, b.class AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.class <> b.class
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.class, b.class HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT class, class AS other FROM classes UNION SELECT r.class, l.b FROM reach r JOIN links l ON r.other = l.a),
named AS (SELECT class, min(other) AS component_id FROM reach GROUP BY class)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       doc_id IS NOT DISTINCT FROM coalesce(component_id, doc_id) AS kept
FROM members LEFT JOIN named USING (class)
"""


def _clusters(n_clusters: int = 40, dims: int = 64, rounds: int = 5, seed: int = 2) -> str:
    """A pair of steps for each round: the nearest centroids, then their floored means."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (
    SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {n_clusters}))"""]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, v, min(struct_pack(d := d, c := c)) AS b FROM (
    SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM v, c{k})
  GROUP BY vec_id, v)""")
        if k < rounds:
            steps.append(f"""
c{k + 1} AS MATERIALIZED (
  SELECT c, coalesce(s, m) AS m FROM c{k} LEFT JOIN (
    SELECT c, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY i) AS s FROM (
      SELECT c, i, sum(x) AS t, count(*) AS n FROM (
        SELECT b.c AS c, unnest(v) AS x, unnest(range({dims})) AS i FROM a{k}) GROUP BY c, i) GROUP BY c) USING (c))""")
    return f"""
WITH {",".join(steps)}
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance,
       CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON b.c = c
"""


FILTER_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_GAPLESS.format("t")} AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
fails AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e FROM w),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS MATERIALIZED (
  SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM fails LEFT JOIN said USING (doc_id) GROUP BY part, a, b, c, d, e),
failing AS MATERIALIZED (
  SELECT part, list_filter([CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END,
         CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END], lambda x: x IS NOT NULL) AS f, n, good, toxic FROM masks),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT o, k AS step, substr(o, k, 1) AS x, list_transform(range(1, k), lambda i: substr(o, i, 1)) AS before
          FROM orders, (SELECT unnest(range(1, 6)) AS k)),
rows AS (
  SELECT part, o, step, x,
         sum(n) FILTER (NOT list_contains(f, x) AND NOT list_has_any(f, before)) AS kept,
         sum(n) FILTER (list_contains(f, x) AND NOT list_has_any(f, before)) AS removed,
         sum(n) FILTER (list_contains(f, x) AND list_has_any(f, before)) AS redundant,
         sum(n) FILTER (f = [x]) AS unique_fails,
         sum(good) FILTER (list_contains(f, x) AND NOT list_has_any(f, before)) AS good_lost,
         sum(toxic) FILTER (list_contains(f, x) AND NOT list_has_any(f, before)) AS toxic_lost
  FROM failing, steps GROUP BY part, o, step, x)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step,
       {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley,
       CAST(dense_rank() OVER (ORDER BY o) - 1 AS INTEGER) AS rank, x AS filter
FROM rows
"""

ORACLES = {
    "op1_exact_dedup": EXACT_DEDUP,
    "op2_suffix_dedup": SUFFIX_DEDUP,
    "op6_decontamination": DECONTAMINATION,
    "op11_minhash": NEAR_DUPLICATES,
    "op12_clusters": _clusters(),
    "op13_filter_audit": FILTER_AUDIT,
}
