"""DuckDB SQL for the queries that SQL can express over whole tables."""

SQL: dict[str, str] = {}

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op2_line_dedup"] = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
ex AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT doc_id, pos, line, {LOWER.format(f"trim(line, {BLANKS})")} AS k FROM ex),
shared AS (SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
flagged AS (SELECT d.doc_id, d.pos, d.line, s.k IS NOT NULL AND d.doc_id < s.last_id AS gone FROM keyed d LEFT JOIN shared s ON d.k = s.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

SQL["op7_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p LEFT JOIN firsts f USING (payload_digest)
"""


def _pii() -> str:
    """The base patterns as they are, and the added kinds, with positions from the texts between matches."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
        "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    doubled = "(CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * d > 9 THEN 2 * d - 9 ELSE 2 * d END ELSE d END)"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: (SELECT {doubled} FROM (SELECT substr(reverse({digits}), i, 1)::INT AS d)))) % 10 = 0"
    luhn = f"(SELECT sum({doubled}) % 10 = 0 FROM (SELECT i, substr(reverse({digits}), i::BIGINT, 1)::INT AS d FROM range(1, length({digits}) + 1) t(i)))"
    spelt = "list_aggregate(list_transform(string_split(substr(m, 5) || substr(m, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), 'string_agg', '')"
    mod97 = f"list_reduce(list_prepend(0, list_transform(string_split({spelt}, ''), lambda c: c::INT)), lambda a, x: (a * 10 + x) % 97) = 1"
    octets = "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(x AS HUGEINT), 999) <= 255))"
    valid = {"email": "true", "ip": octets, "card": f"length({digits}) BETWEEN 14 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 10 AND 15", "iban": mod97, "ssn": "regexp_matches(lower(substr(text, greatest(1, s - 39)::BIGINT, least(s, 40)::BIGINT) || ' ' || substr(text, e + 1, 40)), 'ssn|social|security')"}
    parts = []
    for i, (kind, pattern) in enumerate(patterns.items()):
        parts.append(f"""
        SELECT doc_id, {i} AS k, '{kind}' AS kind, s, e FROM (
          SELECT doc_id, text, hits[i] AS m,
                 (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, (s + length(m))::BIGINT AS e
          FROM (SELECT doc_id, text, hits, parts, unnest(range(1, len(hits) + 1)) AS i FROM (
            SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS parts FROM d) WHERE len(hits) > 0))
        WHERE {valid[kind]}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)}),
kept AS (SELECT * FROM found f WHERE k < 4 OR NOT EXISTS (SELECT 1 FROM found b WHERE b.k < 4 AND b.doc_id = f.doc_id AND b.s < f.e AND f.s < b.e)),
listed AS (SELECT doc_id, {", ".join(f"count_if(k = {i}) AS n{i}" for i in range(4))},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (WHERE k < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n{i}, 0)::BIGINT AS n_{k}" for i, k in enumerate(list(patterns)[:4]))},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed l ON d.doc_id = l.doc_id
"""


SQL["op8_pii"] = _pii()

SQL["op4_url_filters"] = f"""
WITH p AS (SELECT page_id, url, {LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
stated(kind, h, s) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fits AS (SELECT DISTINCT url, arg_max(h || s, length(h || s)) AS rule, arg_max(kind, length(h || s)) AS verdict FROM (SELECT DISTINCT url, host, path FROM p)
         JOIN stated ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY url),
tok AS (SELECT url, list_distinct(list_filter(string_split_regex(regexp_replace({LOWER.format("url")}, '^[a-z]+://', ''), '[^a-z0-9]+'), lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+'))) AS tokens FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)),
lab AS (SELECT row_number() OVER () AS i, p.url, toxic = 1 AS bad FROM p JOIN labels l ON l.doc_id = p.page_id WHERE p.url IS NOT NULL AND toxic IS NOT NULL),
item AS (SELECT i, bad, unnest(tokens) AS t FROM lab JOIN tok USING (url)),
n AS (SELECT ceil(0.002::DOUBLE * count(*)) AS least FROM lab),
ones AS (SELECT t, count(*) AS n, count_if(bad) AS nb FROM item GROUP BY t),
one AS (SELECT t FROM ones, n WHERE nb >= least AND nb::DOUBLE / ones.n >= 0.3::DOUBLE),
pairs AS (SELECT a.t AS t, b.t AS u, count(*) AS n, count_if(a.bad) AS nb FROM item a JOIN item b ON a.i = b.i AND a.t < b.t GROUP BY ALL),
two AS (SELECT t, u FROM pairs, n WHERE nb >= least AND nb::DOUBLE / pairs.n >= 0.3::DOUBLE),
hit AS (SELECT url FROM tok JOIN one ON list_contains(tokens, t) UNION SELECT url FROM tok JOIN two ON list_contains(tokens, t) AND list_contains(tokens, u))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN p.url IN (SELECT url FROM hit) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits f ON p.url = f.url
"""

SQL["op4_url_filters_any_length"] = f"""
WITH RECURSIVE p AS (SELECT page_id, url, {LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
stated(kind, h, s) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fits AS (SELECT DISTINCT url, arg_max(h || s, length(h || s)) AS rule, arg_max(kind, length(h || s)) AS verdict FROM (SELECT DISTINCT url, host, path FROM p)
         JOIN stated ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY url),
tok AS (SELECT url, list_distinct(list_filter(string_split_regex(regexp_replace({LOWER.format("url")}, '^[a-z]+://', ''), '[^a-z0-9]+'), lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+'))) AS tokens FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)),
lab AS MATERIALIZED (SELECT row_number() OVER () AS i, tokens, toxic = 1 AS bad FROM p JOIN labels l ON l.doc_id = p.page_id JOIN tok ON tok.url = p.url WHERE toxic IS NOT NULL),
n AS (SELECT ceil(0.002::DOUBLE * count(*)) AS least FROM lab),
item AS MATERIALIZED (SELECT i, unnest(tokens) AS t FROM lab WHERE bad),
grown AS (SELECT [t] AS s, t, i FROM item WHERE t IN (SELECT t FROM item GROUP BY t HAVING count(*) >= (SELECT least FROM n))
          UNION ALL SELECT s, t, i FROM (SELECT s, t, i, count(*) OVER (PARTITION BY s) AS c FROM (SELECT list_append(g.s, b.t) AS s, b.t AS t, b.i AS i FROM grown g JOIN item b ON g.i = b.i AND b.t > g.t)), n WHERE c >= least),
sets AS (SELECT s, count(*) AS nb FROM grown GROUP BY s),
fit AS (SELECT s, nb, count(*) AS n FROM sets JOIN lab ON list_has_all(tokens, s) GROUP BY s, nb),
rules AS (SELECT s FROM fit WHERE nb::DOUBLE / fit.n >= 0.3::DOUBLE),
hit AS (SELECT DISTINCT url FROM tok JOIN rules ON list_has_all(tokens, s))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN p.url IN (SELECT url FROM hit) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits f ON p.url = f.url
"""
