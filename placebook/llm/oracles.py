"""SQL that a plain engine runs over the whole tables, for the queries that SQL can express."""

from __future__ import annotations

from placebook.llm.blob_ledger import KEYWORDS
from placebook.llm.redirect_equivalence import RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_lowered('text')}, '{_WORDS}'), []) AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_lowered('text')}, '{_WORDS}') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 13) AS n FROM items WHERE len(w) > 0),
passages AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS p
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM sized)),
windows AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS p
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM passages) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, n, k, item_id FROM windows JOIN passages USING (n, p)),
hit_words AS (SELECT doc_id, count(DISTINCT i) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + n)) AS i FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _rule(host: str, path: str, wanted: str) -> str:
    """The longest rule that fits, or its verdict."""
    cases = ""
    for rule in sorted(RULES, key=lambda r: (-len(r.host + r.path), r.host + r.path)):
        value = rule.verdict if wanted == "verdict" else rule.host + rule.path
        cases += f" WHEN ({host} = '{rule.host}' OR ends_with({host}, '.{rule.host}')) AND starts_with({path}, '{rule.path}') THEN '{value}'"
    return f"CASE{cases} END"


def _without_dots(path: str) -> str:
    segments = f"string_split(substr({path}, 2), '/')"
    stack = (
        f"list_reduce(list_transform({segments}, lambda x: [x]), lambda kept, one: CASE one[1] WHEN '..' THEN list_slice(kept, 1, len(kept) - 1) "
        f"WHEN '.' THEN kept ELSE list_concat(kept, one) END, CAST([] AS VARCHAR[]))"
    )
    last = rf"CASE WHEN regexp_matches({path}, '/\.\.?$') THEN [''] ELSE CAST([] AS VARCHAR[]) END"
    clean = f"'/' || array_to_string(list_concat({stack}, {last}), '/')"
    return rf"CASE WHEN regexp_matches({path}, '/\.\.?(?:/|$)') THEN {clean} ELSE {path} END"


def _node(url: str) -> str:
    part = [f"regexp_extract({url}, '{_URL}', {i})" for i in range(5)]
    scheme, host = _lowered(part[1]), _lowered(part[2])
    port = f"CASE {scheme} WHEN 'http' THEN ':80' WHEN 'https' THEN ':443' ELSE ':' END"
    host = f"CASE WHEN ends_with({host}, {port}) THEN left({host}, length({host}) - length({port})) ELSE {host} END"
    path = _without_dots(f"coalesce(nullif({part[3]}, ''), '/')")
    return f"CASE WHEN contains({url}, '://') THEN {scheme} || '://' || {host} || {path} || {part[4]} END"


_ATTRIBUTE = r"""([^\s"''<>/=]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''<>]+)"""


def _attribute(tag: str, name: str) -> str:
    names = f"list_transform(regexp_extract_all({tag}, '{_ATTRIBUTE}', 1), lambda n: lower(n))"
    value = f"regexp_extract_all({tag}, '{_ATTRIBUTE}', 2)[list_position({names}, '{name}')]"
    return f"trim({value}, '\"''')"


def _seen_from(link: str, base: str) -> str:
    scheme, site, path = (f"regexp_extract({base}, '{_URL}', {i})" for i in (1, 2, 3))
    return f"""CASE
    WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {link}
    WHEN starts_with({link}, '//') THEN {scheme} || ':' || {link}
    WHEN starts_with({link}, '/') THEN {scheme} || '://' || {site} || {link}
    WHEN starts_with({link}, '?') THEN {scheme} || '://' || {site} || {path} || {link}
    WHEN starts_with({link}, '#') THEN {base}
    ELSE {scheme} || '://' || {site} || coalesce(nullif(regexp_extract({path}, '(?s)^(.*/)', 1), ''), '/') || {link} END"""


OP3 = rf"""
WITH RECURSIVE parsed AS (SELECT page_id, url, html,
    {_lowered(f"coalesce(regexp_extract(url, '{_URL}', 2), '')")} AS host,
    coalesce(regexp_extract(url, '{_URL}', 3), '') AS path FROM pages),
tagged AS (SELECT url, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g'), '(?i)<(?:link|meta|base)\b[^<>]*(?:>|\z)') AS tags
  FROM pages WHERE contains(url, '://')),
based AS (SELECT url, tags, list_filter(list_transform(list_filter(tags, lambda t: regexp_matches(t, '(?i)^<base')),
    lambda t: trim({_attribute('t', 'href')})), lambda b: b IS NOT NULL)[1] AS base FROM tagged),
tags AS (SELECT url, base, unnest(tags) AS t FROM based),
links AS (SELECT url, CASE WHEN base IS NULL THEN url ELSE {_seen_from('base', 'url')} END AS near, replace(CASE
    WHEN regexp_matches(t, '(?i)^<link') AND list_contains(regexp_split_to_array(lower({_attribute('t', 'rel')}), '[\s/]+'), 'canonical')
      THEN trim({_attribute('t', 'href')})
    WHEN regexp_matches(t, '(?i)^<meta') AND lower({_attribute('t', 'http-equiv')}) = 'refresh'
      THEN regexp_extract({_attribute('t', 'content')}, '(?is)^\s*[\d.]+\s*[;,]\s*url\s*=\s*["'']?([^"''>\s]+)', 1) END, '&amp;', '&') AS link
  FROM tags),
seen AS (SELECT url, CASE WHEN contains(near, '://') THEN near ELSE url END AS near, link FROM links WHERE link <> ''),
edges AS (SELECT {_node('url')} AS a, {_seen_from('link', 'near')} AS target FROM seen),
both_ways AS (SELECT a, {_node('target')} AS b FROM edges UNION SELECT {_node('target')}, a FROM edges),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
judged AS (SELECT node, {_rule(_lowered(f"regexp_extract(other, '{_URL}', 2)"), f"regexp_extract(other, '{_URL}', 3)", 'verdict')} AS own
  FROM reach WHERE node IS NOT NULL),
taken AS (SELECT node, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' ELSE 'allow' END AS verdict
  FROM judged GROUP BY node)
SELECT page_id, host, path, {_rule('host', 'path', 'rule')} AS rule,
       coalesce({_rule('host', 'path', 'verdict')}, verdict, 'allow') AS verdict
FROM parsed LEFT JOIN taken ON node = {_node('url')}
"""

_RUNS = r"[^\x20\x09-\x0D]+"
OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_RUNS}'), []) AS w FROM documents),
windows AS (SELECT doc_id, k, array_to_string(list_slice(w, k, k + 49), ' ') AS p
  FROM (SELECT *, unnest(range(1, len(w) - 48)) AS k FROM d)),
firsts AS (SELECT p, min(doc_id) AS first FROM windows GROUP BY p),
gone AS (SELECT doc_id, list(DISTINCT i) AS gone FROM
  (SELECT doc_id, unnest(range(k, k + 50)) AS i FROM windows JOIN firsts USING (p) WHERE first < doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

_ANY_CASE = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in KEYWORDS)
_FOUND = {
    # Longest runs need no check of their length after matching: a shorter one never hides a longer one.
    "assign": (rf"""({_ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": ("AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": ("[0-9a-f]{16,}", 0, 16),
}
_MATCHES = " UNION ALL ".join(
    f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {least} AS least, string_split_regex(x, '{pattern}') AS gaps,
    regexp_extract_all(x, '{pattern}', 0) AS whole, regexp_extract_all(x, '{pattern}', {group}) AS part FROM t"""
    for rank, (kind, (pattern, group, least)) in enumerate(_FOUND.items())
)
OP7 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
each AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM ({_MATCHES})),
spans AS (SELECT doc_id, kind, rank, length(whole[i]) AS size,
    list_sum(list_transform(gaps[1:i], lambda g: length(g)))
    + coalesce(list_sum(list_transform(whole[1:i - 1], lambda m: length(m))), 0) AS start
  FROM each WHERE length(part[i]) >= least),
told AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256,
       coalesce(spans, '') AS spans, sha256(x) AS blob
FROM t LEFT JOIN told USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(text, '{_RUNS}') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared s JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE 5 * s.n >= 4 * (a.n + b.n - s.n)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
groups AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
texts AS (SELECT doc_id, array_to_string(w, ' ') AS t FROM d),
counts AS (SELECT x, count(*) AS n, count(DISTINCT b.t) FILTER (WHERE a.t <> b.t) AS m
  FROM links JOIN texts a ON x = a.doc_id JOIN texts b ON y = b.doc_id GROUP BY x)
SELECT doc_id, class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(coalesce(m, 0) AS BIGINT) AS n_text_links
FROM documents JOIN groups g ON doc_id = g.x LEFT JOIN counts c ON doc_id = c.x
"""

#: CRC-32 by its table of 256 entries, which the polynomial gives.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(len(hex(f)) // 2), lambda k: CAST('0x' || substr(hex(f), 2 * k + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
OP11 = f"""
WITH tab AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, coalesce(regexp_extract_all({_lowered('text')}, '{_WORDS}'), []) AS w FROM documents),
df AS (SELECT doc_id, unnest(w) AS f FROM d),
bf AS (SELECT unnest(regexp_extract_all({_lowered('text')}, '{_WORDS}')) AS f FROM benchmark),
known AS (SELECT f, {_CRC} % 10000 AS b FROM (SELECT f FROM df UNION SELECT f FROM bf), tab),
s AS (SELECT b, count(*) AS n FROM df JOIN known USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bf JOIN known USING (f) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * ((SELECT CAST(count(*) AS DOUBLE) FROM df) + 10000)
    / ((CAST(s.n AS DOUBLE) + 1) * ((SELECT CAST(count(*) AS DOUBLE) FROM bf) + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b)),
weighed AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS total, count(*) AS n FROM df JOIN known USING (f) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features,
    CAST(coalesce(CASE WHEN total < 0 THEN -((n - 1 - total) // n) ELSE total // n END, 0) AS BIGINT) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS noise
  FROM d LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CAST(CASE WHEN place <= 10 * n // 100 THEN place END AS BIGINT) AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM
    (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM pairs WHERE same) WHERE place <= 5),
ranked AS (SELECT p.anchor_id, positive_id, n.id AS negative_id, positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id) AS place
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE place <= 5
"""
