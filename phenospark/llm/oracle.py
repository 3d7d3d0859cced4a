"""SQL twins of the corpus queries that SQL can express."""

from __future__ import annotations

from phenospark.llm.decontaminate import NAME, NUM, UNIT, UNITS

_FIELDS = ", ".join(f"CASE WHEN r * {k + 1} // 4 > r * {k} // 4 THEN t[4 + r * {k} // 4 : 3 + r * {k + 1} // 4] END AS f{k}" for k in range(4))
_WIDTH = "r * (spot + 1) // 4 - r * spot // 4"
_LOOSE = ", ".join(f"CASE WHEN open = 1 AND n - ({_WIDTH}) >= 8 AND spot = {k} THEN ['*', '{k}', '*'] ELSE f{k} END AS g{k}" for k in range(4))

LINES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
w AS (SELECT doc_id, text, pos, line, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS w FROM l),
z AS (SELECT *, len(w) + length(regexp_replace(line, '[^\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Thai}}\\p{{Lao}}\\p{{Khmer}}\\p{{Myanmar}}]+', '', 'g')) // 3 AS size,
 list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m FROM w WHERE len(w) > 0),
k AS MATERIALIZED (SELECT doc_id, text, pos, size, w, CASE WHEN 3 * len(list_filter(m, lambda x: x = '<*>')) <= len(m) THEN m ELSE w END AS t FROM z WHERE size >= 3),
p AS (SELECT doc_id, text, pos, len(t) AS n, t[1:3] AS head, greatest(len(t) - 3, 0) AS r, t FROM k),
s AS (SELECT doc_id, text, pos, n, r, head, {_FIELDS} FROM p),
kinds AS (SELECT n, r, head, f0, f1, f2, f3, count(DISTINCT text) AS c FROM s GROUP BY ALL),
v AS (SELECT n, r, head, f0, f1, f2, f3, c, unnest([0, 1, 2, 3]) AS k, unnest([f0, f1, f2, f3]) AS v FROM kinds),
often AS (SELECT n, head, k, v FROM v WHERE v IS NOT NULL GROUP BY ALL HAVING sum(c) >= 3),
m AS (SELECT v.n, v.r, v.head, f0, f1, f2, f3, count(*) FILTER (v.v IS NOT NULL AND o.v IS NULL) AS open, max(v.k) FILTER (v.v IS NOT NULL AND o.v IS NULL) AS spot
 FROM v LEFT JOIN often o ON v.n = o.n AND v.head = o.head AND v.k = o.k AND v.v = o.v GROUP BY ALL),
g AS (SELECT n, head, f0, f1, f2, f3, {_LOOSE} FROM m),
placed AS (SELECT s.doc_id, s.text, s.pos, g.n, g.head, g0, g1, g2, g3 FROM s JOIN g ON s.n = g.n AND s.head = g.head AND {" AND ".join(f"s.f{k} IS NOT DISTINCT FROM g.f{k}" for k in range(4))}),
low AS (SELECT n, head, g0, g1, g2, g3, text, min(doc_id) AS low FROM placed GROUP BY ALL),
again AS (SELECT n, head, g0, g1, g2, g3, arg_min(text, low) AS first FROM low GROUP BY ALL HAVING count(*) >= 3),
gone AS (SELECT DISTINCT p.text, p.pos FROM placed p JOIN again a ON p.n = a.n AND p.head = a.head AND {" AND ".join(f"p.g{k} IS NOT DISTINCT FROM a.g{k}" for k in range(4))} WHERE p.text <> a.first
 UNION SELECT k.text, k.pos FROM k JOIN (SELECT w, arg_min(text, low) AS first FROM (SELECT w, text, min(doc_id) AS low FROM k WHERE size >= 20 GROUP BY ALL) GROUP BY 1 HAVING count(*) >= 2) o ON k.w = o.w
  WHERE k.size >= 20 AND k.text <> o.first),
per AS (SELECT text, list(pos) AS pos FROM gone GROUP BY 1)
SELECT doc_id, len(string_split(d.text, chr(10))) AS n_lines, coalesce(len(per.pos), 0) AS n_dropped,
 CASE WHEN per.pos IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(per.pos, i)), chr(10)) END AS text
FROM d LEFT JOIN per USING (text)"""

_END = "[.,;:!?)]"
_STRIP = r"^[.,;:!?\"''()\[\]]+|[.,;:!?\"''()\[\]]+$"
_ANY = f"'{NUM}', '{NAME}', '{UNIT}'"


def _words(source: str, id_: str) -> str:
    """Raw words (r) and template words (t) of each text."""
    named = rf"CASE WHEN i > 1 AND regexp_matches(w[i - 1], '[^.!?:]$') AND regexp_matches(x, '^\p{{Lu}}[\p{{Ll}}\p{{M}}''’-]+({_END}|$)') THEN regexp_replace(x, '^\p{{Lu}}[\p{{Ll}}\p{{M}}''’-]+', '{NAME}') ELSE x END"
    number = rf"CASE WHEN regexp_matches(x, '^[^0-9\p{{L}}]*[0-9][0-9.,:/$€£%+-]*$') THEN '{NUM}' ELSE x END"
    unit = rf"CASE WHEN i > 1 AND b[i - 1] = '{NUM}' AND regexp_matches(x, '(?i)^({'|'.join(UNITS)}){_END}*$') THEN regexp_replace(x, '(?i)^({'|'.join(UNITS)})', '{UNIT}') ELSE x END"
    bare = rf"regexp_replace(lower(x), '{_STRIP}', '', 'g')"
    return f"""SELECT id, list_transform(w, lambda x: {bare}) AS r, list_transform(list_transform(b, lambda x, i: {unit}), lambda x: {bare}) AS t FROM (
 SELECT id, w, list_transform(list_transform(w, lambda x, i: {named}), lambda x: {number}) AS b FROM (
 SELECT {id_} AS id, string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' ') AS w FROM {source}))"""


DECONTAMINATE = f"""
WITH dw AS MATERIALIZED (SELECT id AS doc_id, r, t, len(t) AS n FROM ({_words("documents", "doc_id")})),
b0 AS MATERIALIZED (SELECT id AS item_id, r, t FROM ({_words("(SELECT * FROM benchmark WHERE item_id IS NOT NULL)", "item_id")})),
b1 AS (SELECT item_id, r, t, unnest(range(len(t) - 4)) AS q FROM b0 UNION ALL
 SELECT item_id, r, ['{NAME}'] || t[2:] AS t, 0 AS q FROM b0 JOIN (SELECT item_id, text FROM benchmark) USING (item_id) WHERE regexp_matches(ltrim(text), '^\\p{{Lu}}') AND t[1] <> '{NAME}' AND len(t) >= 5),
b AS MATERIALIZED (SELECT item_id, q, t[q + 1 : q + 5] AS win, r, t FROM b1 WHERE len(list_filter(t[q + 1 : q + 5], lambda x: x NOT IN ({_ANY}, ''))) >= 2),
tot AS (SELECT item_id, count(DISTINCT q) AS total FROM b GROUP BY 1),
dp AS (SELECT doc_id, r, t, unnest(range(n - 4)) AS p FROM dw WHERE n >= 5),
hit AS MATERIALIZED (SELECT doc_id, p, item_id, q, dp.r AS ours, b.r AS theirs, b.t AS bt FROM dp JOIN b ON dp.t[p + 1 : p + 5] = b.win),
whole AS (SELECT doc_id, item_id, total, count(DISTINCT q) AS n_windows FROM hit JOIN tot USING (item_id) GROUP BY ALL HAVING count(DISTINCT q) >= least(0.8 * total, greatest(total - 5, 0.5 * total, least(total, 3)))),
pair AS (SELECT DISTINCT doc_id, item_id, bt[q + i] AS kind, q + i AS spot, theirs[q + i] AS theirs, p, ours[p + i] AS ours FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS i FROM hit JOIN whole USING (doc_id, item_id)) WHERE bt[q + i] IN ({_ANY})),
one AS (SELECT DISTINCT doc_id, item_id, kind, spot, theirs, ours FROM pair),
votes AS (SELECT doc_id, item_id, kind, theirs, ours, count(*) AS n FROM one GROUP BY ALL),
ot AS (SELECT doc_id, item_id, sum(n) AS ok FROM (SELECT doc_id, item_id, kind, theirs, max(n) AS n FROM votes GROUP BY ALL) GROUP BY ALL),
oo AS (SELECT doc_id, item_id, sum(n) AS ok FROM (SELECT doc_id, item_id, kind, ours, max(n) AS n FROM votes GROUP BY ALL) GROUP BY ALL),
j AS (SELECT v.doc_id, v.item_id, sum(v.n) AS n_slots, sum(v.n) FILTER (theirs <> ours) AS n_changed, any_value(ot.ok) AS a, any_value(oo.ok) AS c FROM votes v JOIN ot USING (doc_id, item_id) JOIN oo USING (doc_id, item_id) GROUP BY ALL)
SELECT doc_id, item_id, n_windows, n_windows / total AS share, CAST(coalesce(n_slots, 0) AS BIGINT) AS n_slots, CAST(coalesce(n_changed, 0) AS BIGINT) AS n_changed
FROM whole LEFT JOIN j USING (doc_id, item_id) WHERE n_slots IS NULL OR least(a, c) >= 0.9 * n_slots"""



def _bisector(k: int = 8, rounds: int = 10) -> str:
    """Integer k-means by plain distances to all centroids, one round after the other."""
    nearest = """SELECT id, n, x, arg_min(num, (d, num)) AS cluster, min(d) AS distance FROM (
 SELECT p.id, p.n, p.x, c.num, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p CROSS JOIN c{r} c) GROUP BY ALL"""
    parts = ["""p AS MATERIALIZED (SELECT vec_id AS id, row_number() OVER () AS n, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64)""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS num, x FROM (SELECT sha256('3:' || CAST(id AS VARCHAR)) AS h, x FROM p ORDER BY 1 NULLS LAST, 2 LIMIT {k}))"]
    for r in range(rounds):
        parts.append(f"""c{r + 1} AS MATERIALIZED (WITH a AS ({nearest.format(r=r)}),
 m AS (SELECT cluster, i, sum(v) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS v, unnest(range(64)) AS i FROM a) GROUP BY 1, 2),
 f AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m GROUP BY 1)
 SELECT c.num, coalesce(f.x, c.x) AS x FROM c{r} c LEFT JOIN f ON f.cluster = c.num)""")
    return "WITH " + ",\n".join(parts) + f""",
a AS ({nearest.format(r=rounds)})
SELECT a.id AS vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
 CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM a JOIN c{rounds} ON c{rounds}.num = a.cluster"""


ORACLE = {"op4_linededup": LINES, "op9_decontaminate": DECONTAMINATE, "op11_bisector": _bisector()}
