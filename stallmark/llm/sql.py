"""DuckDB SQL for the queries that SQL can express; the method differs, the rows do not."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

OP1 = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {WORDS} AS w FROM benchmark),
iwin AS (SELECT DISTINCT item, len(w[p:p + 9]) AS n, w[p:p + 9] AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iwin),
docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
dwin AS (SELECT r, p, n, w[p:p + n - 1] AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, sizes WHERE len(w) >= n)),
met AS (SELECT d.r, d.p, d.n, i.item FROM dwin d JOIN iwin i ON d.win = i.win AND d.n = i.n),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS k FROM met) GROUP BY r),
who AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN who USING (r)
"""

_REACH = """
walk AS (SELECT a, b FROM pairs UNION SELECT w.a, p.b FROM walk w JOIN pairs p ON w.b = p.a),
comp AS (SELECT id, least(id, coalesce(min(w.b), id)) AS component FROM nodes LEFT JOIN walk w ON w.a = id GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n FROM pairs GROUP BY a)"""

OP4 = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
good AS (SELECT * FROM nodes WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.id <> y.id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95),{_REACH}
SELECT c.id AS vec_id, coalesce(n, 0) AS n_links, component AS component_id, component = c.id AS kept FROM comp c LEFT JOIN degree d ON d.id = c.id
"""

OP6 = f"""
WITH RECURSIVE nodes AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
grams AS (SELECT DISTINCT id, hash(array_to_string(w[p:p + 4], ' ')) AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM nodes WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.id <> y.id GROUP BY ALL),
pairs AS (SELECT a, b FROM common JOIN sizes s ON s.id = a JOIN sizes t ON t.id = b WHERE c::DOUBLE / (s.n + t.n - c) >= 0.8),{_REACH}
SELECT c.id AS doc_id, component AS class_id, coalesce(n, 0) AS n_links, component = c.id AS kept FROM comp c LEFT JOIN degree d ON d.id = c.id
"""

_SUFFIXES = "('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk')"
_LAST = "array_to_string(list_slice(string_split({0}, '.'), -{1}, -1), '.')"


def _strength(level: str) -> str:
    return f"""k_{level} AS (SELECT CASE WHEN coalesce(n, 0) = 0 OR k < 2 THEN 10.0 ELSE least(1e4, greatest(1.0, 1 / greatest(CASE WHEN p * (1 - p) * (n - n2 / n - (k - 1)) > 0
    THEN ((q - n * p * p) - p * (1 - p) * (k - 1)) / (p * (1 - p) * (n - n2 / n - (k - 1))) ELSE 0.0 END, 1e-9) - 1)) END AS k
  FROM (SELECT *, s / n AS p FROM (SELECT count(*) AS k, sum(n) AS n, sum(s) AS s, sum(n * n) AS n2, sum(s * s / n) AS q FROM (SELECT {level}, sum(n) AS n, sum(s) AS s FROM counts GROUP BY {level}))))"""


OP7 = f"""
WITH seen AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
parts AS (SELECT DISTINCT host, CASE WHEN {_LAST.format('host', 2)} IN {_SUFFIXES} THEN {_LAST.format('host', 3)} ELSE {_LAST.format('host', 2)} END AS domain,
    CASE WHEN {_LAST.format('host', 2)} IN {_SUFFIXES} THEN {_LAST.format('host', 2)} ELSE {_LAST.format('host', 1)} END AS suffix FROM seen),
outcomes AS (SELECT host, quality AS good FROM seen JOIN labels ON try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.html|/)?$', 1) AS BIGINT) = doc_id WHERE quality IS NOT NULL),
counts AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS s FROM outcomes JOIN parts USING (host) GROUP BY ALL),
{_strength('suffix')}, {_strength('domain')}, {_strength('host')},
overall AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(s) + 1) / (sum(n) + 2) ELSE 0.5 END AS o, coalesce(sum(n), 0) AS total FROM counts),
known AS (SELECT p.host, coalesce(c.n, 0.0) AS n, coalesce(c.s, 0.0) AS s, coalesce(d.n, 0.0) AS nd, coalesce(d.s, 0.0) AS sd, coalesce(x.n, 0.0) AS ns, coalesce(x.s, 0.0) AS ss
  FROM parts p LEFT JOIN counts c ON c.host = p.host LEFT JOIN (SELECT domain, sum(n) AS n, sum(s) AS s FROM counts GROUP BY 1) d ON d.domain = p.domain LEFT JOIN (SELECT suffix, sum(n) AS n, sum(s) AS s FROM counts GROUP BY 1) x ON x.suffix = p.suffix),
rated AS (SELECT host, n, o, total, kh.k AS h, (kh.k * ((kd.k * ((ks.k * o + ss - sd) / (ks.k + ns - nd)) + sd - s) / (kd.k + nd - n)) + s) / (kh.k + n) AS rate FROM known, overall, k_suffix ks, k_domain kd, k_host kh),
verdicts AS (SELECT host, total = 0 OR rate - 1.64 * sqrt(greatest(rate * (1 - rate), 0.0) / (h + n + 1)) >= 0.75 * o AS good FROM rated),
rules(action, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (SELECT page_id, host, path, (SELECT arg_max({{'r': h || p, 'a': action}}, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS f FROM seen)
SELECT page_id, f.host, path, f.f.r AS rule, coalesce(f.f.a, CASE WHEN v.good THEN 'allow' ELSE 'block' END) AS verdict FROM fits f JOIN verdicts v ON v.host = f.host
"""

_MARK = r"'^[ \t]*(?:>[ \t]*)+'"
_LEVEL = f"length(regexp_replace(regexp_extract(l, {_MARK}), '[^>]', '', 'g'))"
OP8 = rf"""
WITH RECURSIVE base AS (SELECT conv_id AS c, turn AS t, role AS r, list_filter(string_split_regex(coalesce(text, ''), '\r?\n'), lambda y: NOT regexp_matches(y, '^On .*wrote:\s*$')) AS x FROM conversations),
marked AS (SELECT c, t, list_transform(x, lambda l: {_LEVEL}) AS lv, list_transform(x, lambda l: trim(regexp_replace(lower(regexp_replace(l, {_MARK}, '')), '\s+', ' ', 'g'))) AS bd FROM base WHERE c IS NOT NULL AND t IS NOT NULL),
starts AS (SELECT *, list_filter(range(1, len(lv) + 1), lambda i: i = 1 OR lv[i] <> lv[i - 1] OR bd[i - 1] = '') AS s FROM marked),
runs AS (SELECT c, t, unnest(list_transform(range(1, len(s) + 1), lambda k: {{'level': lv[s[k]], 'lines': list_filter(bd[s[k]:coalesce(s[k + 1], len(lv) + 1) - 1], lambda y: y <> '')}})) AS p FROM starts),
parts AS (SELECT c, t, p.level AS level, p.lines AS lines, string_split(regexp_replace(array_to_string(p.lines, ' '), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS sentences FROM runs WHERE len(p.lines) > 0),
quoted AS (SELECT c, t, level, p, count(*) AS n FROM (SELECT c, t, level, unnest(sentences) AS p FROM parts WHERE level > 0) GROUP BY ALL),
own AS (SELECT c, p, min(t) AS source FROM (SELECT c, t, unnest(list_concat(sentences, lines)) AS p FROM parts WHERE level = 0) GROUP BY ALL),
met AS (SELECT q.c, q.t, level, n, CASE WHEN source < q.t THEN source END AS source FROM quoted q LEFT JOIN own o ON o.c = q.c AND o.p = q.p),
votes AS (SELECT c, t, level, source, sum(n) AS n FROM met GROUP BY ALL),
link AS (SELECT c, t, max(level) AS level, sum(n) AS n_quoted, sum(CASE WHEN source IS NOT NULL THEN n ELSE 0 END) AS n_linked FROM votes GROUP BY ALL),
parent AS (SELECT c, t, arg_min(source, (level, -n, -source)) AS parent FROM votes WHERE source IS NOT NULL GROUP BY ALL),
paths AS (SELECT c, t, [parent, t] AS path FROM parent p WHERE NOT EXISTS (SELECT 1 FROM parent o WHERE o.c = p.c AND o.t = p.parent)
  UNION ALL SELECT p.c, p.t, list_append(path, p.t) FROM paths w JOIN parent p ON p.c = w.c AND p.parent = w.t),
out AS (SELECT b.c AS conv_id, b.t AS turn, r AS role, trim(array_to_string(list_filter(x, lambda l: {_LEVEL} = 0), chr(10))) AS text,
  coalesce(l.level, 0) AS level, coalesce(n_quoted, 0)::BIGINT AS n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked, parent, coalesce(path[1], b.t) AS thread, coalesce(path, [b.t]) AS path
  FROM base b LEFT JOIN link l ON l.c = b.c AND l.t = b.t LEFT JOIN parent p ON p.c = b.c AND p.t = b.t LEFT JOIN paths w ON w.c = b.c AND w.t = b.t)
SELECT * EXCLUDE (path), CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, turn IS NULL ORDER BY path, role NULLS FIRST, text) END AS position FROM out
"""

OP13 = r"""
WITH texts AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT d, lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM texts),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, cut, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:c.k], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, a AS f, array_to_string(w[s:s + m - 1], ' ') AS phrase FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM cand WHERE k > 2))) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest l JOIN totals USING (lang) WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = l.lang AND i.phrase = l.phrase AND 100 * i.f >= 80 * l.a)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

SQL = {"op1_decontamination": OP1, "op4_embedding_dedup": OP4, "op6_jaccard_join": OP6, "op7_url_filters": OP7, "op8_quotations": OP8, "op13_collocations": OP13}
