"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: All pairs of documents that share a shingle, then the smallest doc_id reachable.
NEAR_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3),
      lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b
  WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM sizes
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
)
SELECT s.doc_id, s.n AS n_shingles, min(r.seen) AS component_id, s.doc_id = min(r.seen) AS kept
FROM sizes s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.n
"""

#: Every rule against every URL.
URL_FILTER = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages
)
SELECT p.page_id, p.host, p.path,
  arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
  coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM parts p LEFT JOIN rules r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
GROUP BY p.page_id, p.host, p.path
"""

#: Digests straight from the rows, lengths from the number of escaped characters.
CHAT_FORMAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                   (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + 2 * length(role || text) - length(translate(role, '\#<:', '') || translate(text, '\#<', '')))
    AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

#: Every document scored for every item it shares a term with.
LEXICAL_SEARCH = r"""
WITH doc_terms AS (
  SELECT row_number() OVER () AS row_no, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), sizes AS (SELECT row_no, doc_id, len(t) AS n FROM doc_terms WHERE len(t) > 0),
totals AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sizes),
counts AS (
  SELECT row_no, term, count(*) AS tf
  FROM (SELECT row_no, unnest(t) AS term FROM doc_terms) GROUP BY row_no, term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM counts, totals GROUP BY term, nd
), scored AS (
  SELECT a.item_id, s.row_no, s.doc_id,
    CAST(sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (50 + (50 * s.n * nd) // l)))) AS BIGINT) AS score
  FROM asked a JOIN weights w USING (term) JOIN counts c USING (term) JOIN sizes s USING (row_no), totals
  GROUP BY a.item_id, s.row_no, s.doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank,
    doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

#: All phrases of up to four words counted, cut in two in all ways and compared.
COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece
  FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), counts AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, i,
    array_to_string(string_split(c.phrase, ' ')[1:i], ' ') AS lp,
    array_to_string(string_split(c.phrase, ' ')[i + 1:], ' ') AS rp
  FROM counts c, (SELECT unnest([1, 2, 3]) AS i) WHERE i < c.k
), scored AS (
  SELECT x.lang, x.phrase, x.k, x.a,
    min(struct_pack(score := (2000000 * x.a::HUGEINT) // (lc.a + rc.a), i := x.i, l := lc.a, r := rc.a)) AS cut
  FROM cuts x JOIN counts lc ON lc.lang = x.lang AND lc.phrase = x.lp
    JOIN counts rc ON rc.lang = x.lang AND rc.phrase = x.rp
  GROUP BY x.lang, x.phrase, x.k, x.a
), inner_parts AS (
  SELECT c.lang, array_to_string(string_split(c.phrase, ' ')[s:s + z - 1], ' ') AS phrase, max(c.a) AS longer
  FROM counts c, (SELECT unnest([1, 2, 3]) AS s), (SELECT unnest([2, 3]) AS z)
  WHERE z < c.k AND s + z - 1 <= c.k GROUP BY 1, 2
), ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.cut.score DESC, s.a DESC, s.phrase) AS rank,
    s.phrase, s.a, s.cut.l AS l, s.cut.r AS r, t.n, CAST(s.cut.score AS BIGINT) AS score
  FROM scored s JOIN totals t ON t.lang = s.lang
    LEFT JOIN inner_parts p ON p.lang = s.lang AND p.phrase = s.phrase
  WHERE p.longer IS NULL OR 100 * p.longer < 80 * s.a
)
SELECT * FROM ranked WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_url_filter": URL_FILTER,
    "op3_chat_format": CHAT_FORMAT,
    "op8_near_dedup": NEAR_DEDUP,
    "op11_lexical_search": LEXICAL_SEARCH,
    "op12_collocations": COLLOCATIONS,
}
