"""SQL that computes the registered queries a second way, over the same tables.

Written for DuckDB from the rules, not from the Spark code: all pairs are compared,
all words of a text are laid out, windows run over whole groups.
"""

from __future__ import annotations

from cueglass.functions.screen import SYSTEM_PHRASES
from cueglass.functions.text import PLAIN_STOP_WORDS, RANKED_STOP_WORDS

ORACLES: dict[str, str] = {}


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w + "'" for w in words)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def norm(x: str) -> str:
    return rf"regexp_replace({trim(f'lower({x})')}, '[^\w\s]', '', 'g')"


def noisy(x: str) -> str:
    return (
        rf"CASE WHEN length({x}) % 2 = 0 THEN regexp_replace({x}, '(\d)\d ', '\1 ', 'g') "
        rf"ELSE regexp_replace({x}, '^\S+ ', '', 'g') END"
    )


def half_up(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


def shown(seconds: str) -> str:
    """Seconds as M:SS."""
    return (
        f"CAST(CAST(floor(({seconds}) / 60) AS BIGINT) AS VARCHAR) || ':' || "
        f"lpad(CAST(CAST(({seconds}) AS BIGINT) % 60 AS VARCHAR), 2, '0')"
    )


# --- building blocks ------------------------------------------------------------------

PART_TITLES = """part_titles AS (
  SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS title FROM part)"""

PODCASTS = """podcasts AS (SELECT p_partkey AS podcast_id, title FROM part_titles)"""

TERMS = f"""terms AS (SELECT podcast_id, {noisy('title')} AS term FROM podcasts)"""

EPISODES = """named_items AS (
  SELECT l.*, p.podcast_id, t.title AS podcast_title,
         CASE WHEN l_orderkey % 5 = 4 THEN t.title || ' Bonus'
           ELSE o_orderpriority || ' ' || s_name || ' ' || strftime(o_orderdate, '%B') END AS title
  FROM lineitem l JOIN part_titles t ON l_partkey = t.p_partkey
  JOIN podcasts p ON p.podcast_id = l_partkey
  JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
episodes AS (
  SELECT podcast_id, title, min(l_orderkey * 10 + l_linenumber) AS episode_id,
         max(l_shipdate) AS release_date
  FROM named_items GROUP BY podcast_id, title),
listing AS (
  SELECT *, row_number() OVER (PARTITION BY podcast_id
    ORDER BY release_date DESC NULLS LAST, episode_id) AS ord FROM episodes)"""

NOISY_EPISODE = r"""CASE WHEN length(title) % 2 = 0 THEN regexp_replace(title, '^\d-', '')
    ELSE regexp_replace(title, '.$', '') END"""

EPISODE_TERMS = f"""episode_terms AS (SELECT DISTINCT podcast_id, {NOISY_EPISODE} AS term FROM episodes),
last_episode_terms AS (SELECT podcast_id, {NOISY_EPISODE} AS term
  FROM (SELECT podcast_id, max(title) AS title FROM episodes GROUP BY podcast_id))"""

CATALOG = [PART_TITLES, PODCASTS, TERMS]
FULL_CATALOG = [*CATALOG, EPISODES, EPISODE_TERMS]

TITLE_PAIRS = """title_pairs AS (
  SELECT a_id, b_id, x.title AS a, y.title AS b
  FROM (SELECT DISTINCT l_partkey AS a_id, l_suppkey AS b_id FROM lineitem)
  JOIN part_titles x ON x.p_partkey = a_id JOIN part_titles y ON y.p_partkey = b_id)"""


def similarity(source: str, a: str, b: str, out: str) -> str:
    """CTEs ending in ``out``: all columns of ``source`` and ``sim`` of a (search) and b."""
    return rf"""{out}_n AS (
  SELECT *, {norm(a)} AS _na, {norm(b)} AS _nb FROM {source}),
{out}_w AS (
  SELECT *, regexp_split_to_array(_na, '\s+') AS _wa, regexp_split_to_array(_nb, '\s+') AS _wb
  FROM {out}_n),
{out}_m AS (
  SELECT *,
    list_sum(list_transform(_wa, lambda x: len(list_filter(_wb, lambda y: y = x)))) AS _exact,
    list_sum(list_transform(_wa, lambda x: len(list_filter(_wb, lambda y: y <> x
      AND length(x) >= 2 AND length(y) >= 2 AND (starts_with(x, y) OR starts_with(y, x)))))) AS _part
  FROM {out}_w),
{out}_b AS (
  SELECT *, (_exact + 0.6 * _part)::DOUBLE / greatest(len(_wa), len(_wb)) AS _base FROM {out}_m),
{out} AS (
  SELECT *, CASE
    WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.0
    WHEN _na = _nb THEN 1.0
    WHEN contains(_na, _nb) OR contains(_nb, _na)
      THEN 0.8 + 0.2 * (least(length(_na), length(_nb)) / greatest(length(_na), length(_nb)))
    WHEN _exact > 0 AND _part > 0 THEN least(1.0, _base + 0.15)
    WHEN _part > 0 AND 0.6 * _part >= 0.5 * len(_wa) THEN least(1.0, _base + 0.1)
    ELSE _base END::DOUBLE AS sim
  FROM {out}_b)"""


def plain_keywords(x: str) -> str:
    return (
        rf"list_filter(regexp_split_to_array(regexp_replace({trim(f'lower({x})')}, '[^\w\s]', ' ', 'g'), "
        rf"'\s+'), lambda w: length(w) > 2 AND w NOT IN ({quoted(PLAIN_STOP_WORDS)}))"
    )


def ranked_keywords(source: str, key: str, x: str, out: str) -> str:
    """CTEs ending in ``out(key, kws)``: top eight words by uniqueness, length, place."""
    return rf"""{out}_t AS (
  SELECT {key}, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
    SELECT {key}, regexp_split_to_array({trim(rf"regexp_replace(lower({x}), '[^\w\s]', ' ', 'g')")},
      '\s+') AS w FROM {source})),
{out}_f AS (
  SELECT *, count(*) OVER (PARTITION BY {key}, word) AS n FROM {out}_t
  WHERE length(word) >= 2 AND word NOT IN ({quoted(RANKED_STOP_WORDS)})),
{out}_r AS (
  SELECT *, row_number() OVER (PARTITION BY {key}
    ORDER BY CASE WHEN n > 1 THEN 1 ELSE 0 END, length(word) DESC, pos) AS r FROM {out}_f),
{out} AS (
  SELECT {key}, list(word ORDER BY r) AS kws FROM {out}_r WHERE r <= 8 GROUP BY {key})"""


def hits(title: str, kws: str) -> tuple[str, str]:
    """SQL lists of exact and prefix-related keywords."""
    words = rf"regexp_split_to_array(lower({title}), '\s+')"
    exact = f"list_filter({kws}, lambda k: contains(lower({title}), k))"
    part = (
        f"list_filter({kws}, lambda k: len(list_filter({words}, "
        f"lambda w: starts_with(w, k) OR starts_with(k, w))) > 0)"
    )
    return exact, part


def kw_score(title: str, kws: str) -> str:
    exact, part = hits(title, kws)
    return f"CASE WHEN len({kws}) > 0 THEN (len({exact}) + 0.5 * len({part}))::DOUBLE / len({kws}) END"


def tier(search: str, title: str) -> str:
    s = trim(f"lower({search})")
    return (
        f"CASE WHEN coalesce({search}, '') = '' OR coalesce({title}, '') = '' THEN NULL "
        f"WHEN {trim(f'lower({title})')} = {s} THEN 1 WHEN contains(lower({title}), {s}) THEN 2 "
        f"WHEN contains({s}, lower({title})) THEN 3 END"
    )


# --- text -----------------------------------------------------------------------------

def edit_norm(x: str) -> str:
    return trim(rf"regexp_replace(lower({x}), '[^\w\s]', '', 'g')")


ORACLES["levenshtein_sim"] = f"""{with_(PART_TITLES, TITLE_PAIRS)}
SELECT a_id, b_id, round(CASE WHEN x = y THEN 1.0
  ELSE 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END, 6) AS similarity
FROM (SELECT a_id, b_id, {edit_norm('a')} AS x, {edit_norm('b')} AS y FROM title_pairs)"""

ORACLES["title_similarity"] = f"""{with_(
    PART_TITLES, TITLE_PAIRS,
    f"noisy_pairs AS (SELECT *, {noisy('b')} AS c FROM title_pairs)",
    similarity('noisy_pairs', 'a', 'b', 's1'), similarity('noisy_pairs', 'a', 'c', 's2'))}
SELECT s1.a_id, s1.b_id, round(s1.sim, 6) AS similarity, round(s2.sim, 6) AS noisy_similarity
FROM s1 JOIN s2 USING (a_id, b_id)"""

ORACLES["keyword_score"] = f"""{with_(PART_TITLES, TITLE_PAIRS,
    f"k AS (SELECT *, {plain_keywords('b')} AS kws FROM title_pairs)",
    f"s AS (SELECT *, {kw_score('a', 'kws')} AS score FROM k)")}
SELECT a_id, b_id, round(score, 6) AS score, round(0.5 + 0.3 * score, 6) AS confidence FROM s"""

_EXACT, _PART = hits("a", "kws")
ORACLES["matched_keywords"] = f"""{with_(PART_TITLES, TITLE_PAIRS,
    ranked_keywords('part_titles', 'p_partkey', 'title', 'kw'),
    "k AS (SELECT t.*, coalesce(kws, []) AS kws FROM title_pairs t LEFT JOIN kw ON p_partkey = b_id)",
    f"h AS (SELECT *, {_EXACT} AS exact, {_PART} AS part FROM k)")}
SELECT a_id, b_id,
  array_to_string(list_concat(exact, list_filter(part, lambda k: NOT list_contains(exact, k))), ' ') AS matched,
  round(CASE WHEN len(kws) > 0 THEN (len(exact) + 0.5 * len(part))::DOUBLE / len(kws) END, 6) AS score
FROM h"""

ORACLES["match_tier"] = f"""{with_(PART_TITLES, TITLE_PAIRS,
    f"n AS (SELECT *, {noisy('b')} AS c FROM title_pairs)")}
SELECT a_id, b_id, coalesce({tier('c', 'a')}, 0) AS tier, coalesce({tier('a', 'c')}, 0) AS reverse_tier FROM n"""

ORACLES["top_keywords"] = f"""{with_(ranked_keywords('documents', 'doc_id', 'text', 'kw'))}
SELECT doc_id, coalesce(array_to_string(kws, ' '), '') AS keywords FROM documents LEFT JOIN kw USING (doc_id)"""

ORACLES["keywords_all"] = f"""
SELECT doc_id, array_to_string({plain_keywords('text')}, ' ') AS keywords FROM documents"""

CLEANED = (
    rf"list_filter(regexp_split_to_array(regexp_replace({trim('lower(text)')}, '[^\w\s]', ' ', 'g'), "
    r"'\s+'), lambda w: length(w) > 1 AND NOT ends_with(w, 'w'))"
)
ORACLES["clean_title"] = f"SELECT doc_id, array_to_string({CLEANED}, ' ') AS cleaned FROM documents"

ORACLES["middle_words"] = f"""
WITH w AS (SELECT doc_id, {CLEANED} AS w FROM documents),
m AS (SELECT doc_id, w, array_to_string(w[2:len(w) - 1], ' ') AS inside FROM w)
SELECT doc_id, CASE WHEN len(w) >= 3 AND length(inside) >= 3 THEN inside ELSE '' END AS middle FROM m"""

ORACLES["word_counts"] = r"""
SELECT doc_id, word, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^\w\s]', ' ', 'g'), '\s+')) AS word
  FROM documents) WHERE word <> '' GROUP BY doc_id, word"""

ORACLES["word_index"] = r"""
SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS word_index, unnest(w) AS token
FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)"""

# --- catalog --------------------------------------------------------------------------

ALL_PAIRS = [
    f"""norm_terms AS (SELECT DISTINCT {norm('term')} AS term FROM terms)""",
    f"""norm_titles AS (SELECT {norm('title')} AS title, min(podcast_id) AS podcast_id FROM podcasts GROUP BY 1)""",
    "all_pairs AS (SELECT term, title FROM norm_terms, norm_titles)",
    similarity("all_pairs", "term", "title", "scored"),
]

ORACLES["fuzzy_catalog_join"] = f"""{with_(*CATALOG, *ALL_PAIRS)}
SELECT term, title, round(sim, 6) AS similarity FROM scored WHERE sim > 0.7"""

# Above 0.7 one text contains the other, or a word of one begins with a word of the other.
SHORT_TITLES = [
    f"""short_words AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \\n]')) AS term FROM documents)""",
    r"""short_lines AS (SELECT * FROM (SELECT DISTINCT unnest(string_split(text, chr(10))) AS title FROM documents)
  WHERE len(string_split(title, ' ')) <= 2)""",
    f"""short_terms AS (SELECT term, {norm('term')} AS nt FROM short_words)""",
    f"""short_titles AS (SELECT title, {norm('title')} AS nl FROM short_lines)""",
    r"""short_pairs AS (SELECT term, title FROM short_terms, short_titles
  WHERE contains(nt, trim(nl)) OR contains(nl, trim(nt))
    OR list_has_any(list_transform(string_split_regex(trim(nt), '\s+'), lambda w: w[1]),
                    list_transform(string_split_regex(trim(nl), '\s+'), lambda w: w[1])))""",
    similarity("short_pairs", "term", "title", "scored"),
]

# Texts without ASCII letters or digits are matched by their lowered, trimmed originals.
ORACLES["short_title_join"] = rf"""{with_(*SHORT_TITLES)}
SELECT DISTINCT _na AS term, _nb AS title, round(sim, 6) AS similarity FROM scored
WHERE regexp_matches(_na, '\S') AND regexp_matches(_nb, '\S') AND sim > 0.7
UNION SELECT DISTINCT chr(0) || {trim('lower(term)')}, chr(0) || {trim('lower(title)')}, 1.0 FROM scored
WHERE NOT regexp_matches(_na, '\S') AND NOT regexp_matches(_nb, '\S')
  AND {trim('lower(term)')} = {trim('lower(title)')} AND {trim('lower(term)')} <> ''"""

BEST_PODCAST = f"""best_podcast AS (
  SELECT term, podcast_id, sim FROM (
    SELECT term, podcast_id, sim, row_number() OVER (PARTITION BY term ORDER BY sim DESC, podcast_id) AS r
    FROM scored JOIN norm_titles USING (title)) WHERE r = 1 AND sim > 0.7)"""

ORACLES["podcast_match"] = f"""{with_(*CATALOG, *ALL_PAIRS, BEST_PODCAST)}
SELECT term, podcast_id, round(sim, 6) AS similarity FROM best_podcast"""

TITLE_IDS = f"title_ids AS (SELECT {norm('title')} AS title, podcast_id FROM podcasts)"
SEARCHED = """searched AS (SELECT * FROM (
  SELECT term, podcast_id, sim, row_number() OVER (PARTITION BY term ORDER BY sim DESC, podcast_id) AS rank
  FROM scored JOIN title_ids USING (title) WHERE sim > 0) WHERE rank <= 10)"""

ORACLES["podcast_search"] = f"""{with_(*CATALOG, *ALL_PAIRS, TITLE_IDS, SEARCHED)}
SELECT term, podcast_id, round(sim, 6) AS similarity, rank FROM searched"""

ORACLES["podcast_suggestions"] = f"""{with_(*CATALOG, *ALL_PAIRS, TITLE_IDS, SEARCHED)}
SELECT term, string_agg(podcast_id::VARCHAR, ' ' ORDER BY rank) AS suggestions
FROM searched WHERE rank <= 3 GROUP BY term"""

ORACLES["episode_listing"] = f"""{with_(*CATALOG, EPISODES)}
SELECT podcast_id, ord, episode_id, title FROM listing WHERE ord <= 200"""

ASKED = """asked AS (SELECT podcast_id, term, episode_id, title, release_date, ord
  FROM episode_terms JOIN listing USING (podcast_id))"""
SCORED_EPISODES = [*FULL_CATALOG, ASKED, similarity("asked", "term", "title", "scored")]


def ranked_episodes(where: str, limit: str) -> str:
    return f"""{with_(*SCORED_EPISODES)}
SELECT podcast_id, term, episode_id, round(sim, 6) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY podcast_id, term ORDER BY sim DESC, ord) AS rank
  FROM scored WHERE {where}) WHERE {limit}"""


ORACLES["best_match"] = f"SELECT * EXCLUDE (rank) FROM ({ranked_episodes('true', 'rank = 1')})"
ORACLES["episode_match"] = f"SELECT * EXCLUDE (rank) FROM ({ranked_episodes('sim > 0.2', 'rank = 1')})"
ORACLES["episode_search_topk"] = ranked_episodes("sim > 0.1", "rank <= 10")
ORACLES["episode_rank"] = ranked_episodes("sim > 0.3", "true")

ORACLES["keyword_episode"] = f"""{with_(*FULL_CATALOG, ASKED,
    "numbered AS (SELECT *, row_number() OVER () AS request FROM episode_terms)",
    ranked_keywords('numbered', 'request', 'term', 'kw'),
    f"""s AS (SELECT a.*, {kw_score('title', 'kws')} AS score
  FROM asked a JOIN numbered USING (podcast_id, term) JOIN kw USING (request))""")}
SELECT podcast_id, term, episode_id, round(0.5 + 0.3 * score, 6) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY podcast_id, term ORDER BY score DESC, ord) AS r
  FROM s WHERE score >= 0.3) WHERE r = 1"""

BY_KEYWORDS = [
    f"kw AS (SELECT *, {plain_keywords('term')} AS kws FROM asked)",
    f"s AS (SELECT *, {kw_score('title', 'kws')} AS score, {tier('term', 'title')} AS tier FROM kw)",
]
NEWEST = "score DESC, coalesce(release_date, TIMESTAMP '1970-01-01') DESC, ord"

ORACLES["keyword_best_episode"] = f"""{with_(*FULL_CATALOG, ASKED, *BY_KEYWORDS)}
SELECT podcast_id, term, episode_id, round(score, 6) AS score, round(0.5 + 0.3 * score, 6) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY podcast_id, term ORDER BY {NEWEST}) AS r
  FROM s WHERE score >= 0.00001) WHERE r = 1"""


def fuzzy_episode(source: str, keys: str, out: str) -> str:
    """CTEs ending in ``out``: per keys the tier match, else the best keyword match.
    ``source`` has keys, term, and the listing columns."""
    return f"""{out}_k AS (SELECT *, {plain_keywords('term')} AS kws FROM {source}),
{out}_s AS (SELECT *, {kw_score('title', 'kws')} AS score, {tier('term', 'title')} AS tier FROM {out}_k),
{out}_t AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY tier, ord) AS r
  FROM {out}_s WHERE tier IS NOT NULL),
{out}_w AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {NEWEST}) AS r
  FROM {out}_s WHERE score >= 0.00001),
{out} AS (
  SELECT {keys}, episode_id, title, 0.9::DOUBLE AS confidence FROM {out}_t WHERE r = 1
  UNION ALL
  SELECT {keys}, episode_id, title, 0.5 + 0.3 * score FROM {out}_w w WHERE r = 1
    AND NOT EXISTS (SELECT 1 FROM {out}_t t WHERE {' AND '.join(f't.{k.strip()} = w.{k.strip()}' for k in keys.split(','))}))"""


ORACLES["fuzzy_episode_match"] = f"""{with_(*FULL_CATALOG, ASKED, fuzzy_episode('asked', 'podcast_id, term', 'f'))}
SELECT podcast_id, term, episode_id, round(confidence, 6) AS confidence FROM f"""

TEXT_PAIRS = """text_pairs AS (SELECT DISTINCT t.term AS podcast_text, e.term AS episode_text
  FROM terms t JOIN last_episode_terms e USING (podcast_id))"""


def cleaned(x: str) -> str:
    return (
        rf"list_filter(regexp_split_to_array(regexp_replace({trim(f'lower({x})')}, '[^\w\s]', ' ', 'g'), "
        r"'\s+'), lambda w: length(w) > 1 AND NOT ends_with(w, 'w'))"
    )


FUZZY_PODCAST = [
    f"cleaned AS (SELECT podcast_text, {cleaned('podcast_text')} AS w FROM (SELECT DISTINCT podcast_text FROM text_pairs))",
    """searches AS (
  SELECT podcast_text, 1 AS phase, array_to_string(w, ' ') AS search FROM cleaned
  UNION ALL
  SELECT podcast_text, 2, array_to_string(w[2:len(w) - 1], ' ') FROM cleaned WHERE len(w) >= 3)""",
    "usable AS (SELECT * FROM searches WHERE length(search) >= 3)",
    f"""page_pairs AS (SELECT search, title, podcast_id FROM (SELECT DISTINCT search FROM usable),
  (SELECT podcast_id, title FROM podcasts))""",
    similarity("page_pairs", "search", "title", "page_scored"),
    """pages_found AS (
  SELECT search, podcast_id, sim, row_number() OVER (PARTITION BY search ORDER BY sim DESC, podcast_id) AS rank
  FROM page_scored WHERE sim >= 0.85)""",
    """tries AS (SELECT p.podcast_text, p.episode_text AS term, u.phase, f.rank, f.podcast_id, f.sim
  FROM text_pairs p JOIN usable u USING (podcast_text) JOIN pages_found f USING (search))""",
    """try_asked AS (SELECT podcast_id, term, episode_id, title, release_date, ord
  FROM (SELECT DISTINCT podcast_id, term FROM tries) JOIN listing USING (podcast_id))""",
    fuzzy_episode("try_asked", "podcast_id, term", "ff"),
    """fuzzy_found AS (SELECT * FROM (
  SELECT t.podcast_text, t.term AS episode_text, t.podcast_id, t.sim, ff.episode_id, ff.confidence,
    row_number() OVER (PARTITION BY t.podcast_text, t.term ORDER BY phase, rank) AS r
  FROM tries t JOIN ff ON ff.podcast_id = t.podcast_id AND ff.term = t.term) WHERE r = 1)""",
]

ORACLES["fuzzy_podcast_match"] = f"""{with_(*FULL_CATALOG, TEXT_PAIRS, *FUZZY_PODCAST)}
SELECT podcast_text, episode_text, podcast_id, round(sim, 6) AS similarity, episode_id,
  round(confidence, 6) AS episode_confidence FROM fuzzy_found"""

ORACLES["validate_pair"] = f"""{with_(*FULL_CATALOG, TEXT_PAIRS, *FUZZY_PODCAST, *ALL_PAIRS, BEST_PODCAST,
    f'''exact AS (SELECT p.podcast_text, p.episode_text, b.podcast_id, b.sim
  FROM text_pairs p JOIN best_podcast b ON b.term = {norm('p.podcast_text')})''',
    '''ex_asked AS (SELECT podcast_id, term, episode_id, title, ord
  FROM (SELECT DISTINCT podcast_id, episode_text AS term FROM exact) JOIN listing USING (podcast_id))''',
    similarity('ex_asked', 'term', 'title', 'ex_scored'),
    '''ex_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY podcast_id, term
  ORDER BY sim DESC, ord) AS r FROM ex_scored) WHERE r = 1 AND sim > 0.2)''',
    '''found AS (
  SELECT p.podcast_text, p.episode_text, coalesce(e.podcast_id, f.podcast_id) AS podcast_id,
    coalesce(e.sim, f.sim) AS podcast_confidence,
    CASE WHEN e.podcast_id IS NOT NULL THEN b.episode_id ELSE f.episode_id END AS episode_id,
    CASE WHEN e.podcast_id IS NOT NULL THEN b.sim ELSE f.confidence END AS episode_confidence
  FROM text_pairs p LEFT JOIN exact e USING (podcast_text, episode_text)
  LEFT JOIN ex_best b ON b.podcast_id = e.podcast_id AND b.term = e.episode_text
  LEFT JOIN fuzzy_found f ON f.podcast_text = p.podcast_text AND f.episode_text = p.episode_text)''')}
SELECT podcast_text, episode_text, coalesce(podcast_id, -1) AS podcast_id,
  round(podcast_confidence, 6) AS podcast_confidence, coalesce(episode_id, -1) AS episode_id, round(episode_confidence, 6) AS episode_confidence,
  podcast_id IS NOT NULL AND episode_id IS NOT NULL AS validated,
  CASE WHEN podcast_id IS NULL THEN 0.0 WHEN episode_id IS NOT NULL THEN 1.0 ELSE 0.6 END::DOUBLE AS confidence
FROM found"""

# --- layout ---------------------------------------------------------------------------

LINE_ORDER = "(l_linenumber * 10000000000000000 + l_partkey * 100000000 + l_suppkey * 10)"

LINES = f"""lines AS (
  SELECT l_orderkey AS image_id, {LINE_ORDER} AS line_key, title AS text, l_quantity * 40 AS avg_y,
    CASE WHEN l_discount > 0.08 THEN l_extendedprice ELSE l_extendedprice / 10 END AS avg_area
  FROM lineitem JOIN part_titles ON l_partkey = p_partkey)"""

HEIGHTS = """heights AS (SELECT o_orderkey AS image_id,
  CAST(floor(o_totalprice % 2000) AS INTEGER) + 800 AS height FROM orders)"""

WORDS = f"""item_words AS (
  SELECT l.*, string_split(p_name || CASE WHEN p_type = 'PROMO' THEN ' :' ELSE '' END, ' ') AS w
  FROM lineitem l JOIN part ON l_partkey = p_partkey),
placed_words AS (
  SELECT *, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS pos FROM item_words),
words AS (
  SELECT l_orderkey AS image_id, {LINE_ORDER} + pos AS word_idx, {LINE_ORDER} AS line_key, text,
    pos * 120 + l_suppkey AS x0, CAST(l_quantity * 8 AS INTEGER) AS y0,
    length(text) * 10 AS width, 20 + l_partkey % 5 * 8 AS height
  FROM placed_words)"""



def folded(source: str) -> str:
    """Recursive CTEs ending in ``fold``: each word of ``source`` with its ``line_key``."""
    return rf"""seq AS (
  SELECT image_id, word_idx, y0::DOUBLE AS y, height::DOUBLE AS h, regexp_matches(text, '^[^\w\s]+$') AS mark,
    row_number() OVER (PARTITION BY image_id ORDER BY word_idx) AS rn FROM {source}),
fold AS (
  SELECT image_id, 0::BIGINT AS rn, NULL::BIGINT AS word_idx, NULL::BIGINT AS line_key,
    []::STRUCT(y DOUBLE, h DOUBLE, n INTEGER, k BIGINT)[] AS lines
  FROM (SELECT DISTINCT image_id FROM seq)
  UNION ALL
  SELECT image_id, rn, word_idx,
    CASE WHEN p IS NULL THEN word_idx ELSE lines[p].k END,
    CASE WHEN p IS NULL THEN list_append(lines, {{'y': y, 'h': h, 'n': 1, 'k': word_idx}})
      ELSE list_transform(lines, lambda l, i: CASE WHEN i = p
        THEN {{'y': l.y, 'h': l.h + h, 'n': l.n + 1, 'k': l.k}} ELSE l END) END
  FROM (
    SELECT s.*, f.lines, list_position(list_transform(f.lines, lambda l: abs(l.y - s.y) < 18 AND (s.mark
      OR least(s.h, l.h / l.n) / greatest(s.h, l.h / l.n) >= 0.8)), true) AS p
    FROM fold f JOIN seq s ON s.image_id = f.image_id AND s.rn = f.rn + 1))"""


ORACLES["line_grouping"] = f"""WITH RECURSIVE {WORDS}, {folded('words')}
SELECT image_id, word_idx, line_key FROM fold WHERE rn > 0"""

ORACLES["line_rollup"] = f"""{with_(WORDS)}
SELECT image_id, line_key, trim(string_agg(text, ' ' ORDER BY x0, word_idx)) AS text,
  min(y0)::DOUBLE AS avg_y, round(avg(x0), 6) AS avg_x, round(avg(width * height), 6) AS avg_area,
  count(*) AS word_count
FROM words GROUP BY image_id, line_key"""


def cascade(source: str) -> str:
    """Kept lines of ``source`` flagged a (primary), j (joined), u (upper), r (rest)."""
    return f"""counted AS (
  SELECT *, count(*) FILTER (WHERE a) OVER w AS na, count(*) FILTER (WHERE j) OVER w AS nj,
    count(*) FILTER (WHERE u) OVER w AS nu FROM {source} WINDOW w AS (PARTITION BY image_id)),
kept AS (
  SELECT image_id, line_key, 'primary' AS tier, 0 AS part FROM counted WHERE na >= 2 AND a
  UNION ALL SELECT image_id, line_key, 'primary+upper', 0 FROM counted WHERE na = 1 AND nj >= 1 AND a
  UNION ALL SELECT image_id, line_key, 'primary+upper', 1 FROM counted WHERE na = 1 AND nj >= 1 AND j
  UNION ALL SELECT image_id, line_key, 'upper', 0 FROM counted
    WHERE NOT (na >= 2 OR (na = 1 AND nj >= 1)) AND nu >= 2 AND u
  UNION ALL SELECT image_id, line_key, 'full', 0 FROM counted
    WHERE NOT (na >= 2 OR (na = 1 AND nj >= 1)) AND nu < 2 AND r)"""


ORACLES["position_filter_image"] = f"""{with_(PART_TITLES, LINES, HEIGHTS,
    '''flagged AS (SELECT *,
    avg_y BETWEEN height * 0.45::DOUBLE AND height * 0.875::DOUBLE AND avg_area <= 50000 AS a,
    avg_y BETWEEN height * 0.08::DOUBLE AND height * 0.20::DOUBLE AND avg_area <= 5000 AS j,
    avg_y BETWEEN height * 0.08::DOUBLE AND height * 0.20::DOUBLE AND avg_area <= 5000 AS u,
    avg_y BETWEEN height * 0.05::DOUBLE AND height AND avg_area <= 10000 AS r
  FROM lines JOIN heights USING (image_id))''', cascade('flagged'))}
SELECT * FROM kept"""

ORACLES["position_filter_content"] = f"""{with_(PART_TITLES, LINES,
    '''spans AS (SELECT *, min(avg_y) OVER (PARTITION BY image_id) AS lo,
    max(avg_y) OVER (PARTITION BY image_id) AS hi FROM lines)''',
    '''flagged AS (SELECT image_id, line_key,
    avg_y BETWEEN lo + (hi - lo) * 0.50::DOUBLE AND lo + (hi - lo) * 1.00::DOUBLE AND avg_area <= 50000 AS a,
    avg_y BETWEEN lo + (hi - lo) * 0.20::DOUBLE AND lo + (hi - lo) * 0.50::DOUBLE AND avg_area <= 5000 AS j,
    avg_y BETWEEN lo + (hi - lo) * 0.10::DOUBLE AND lo + (hi - lo) * 0.20::DOUBLE AND avg_area <= 5000 AS u,
    avg_y BETWEEN lo + (hi - lo) * 0.15::DOUBLE AND hi - (hi - lo) * 0.05::DOUBLE AND avg_area <= 10000 AS r
  FROM spans)''', cascade('flagged'))}
SELECT * FROM kept"""

TEXT_LINES = r"""raw_lines AS (
  SELECT 'document' AS kind, doc_id AS id, generate_subscripts(w, 1) - 1 AS n, unnest(w) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents)
  UNION ALL
  SELECT 'order', o_orderkey, 0, CASE o_orderpriority
    WHEN '1-URGENT' THEN strftime(o_orderdate, '%d/%m/%Y') WHEN '2-HIGH' THEN strftime(o_orderdate, '%-d %B')
    WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%B %-d')
    WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%-d de %B') ELSE strftime(o_orderdate, '%H:%M') END
  FROM orders
  UNION ALL
  SELECT 'part', p_partkey, 0, title FROM part_titles),
text_lines AS (
  SELECT *, ((id * 37 + n * 101 + 1900) % 9000)::DOUBLE AS avg_area,
    len(regexp_extract_all(text, '\S+')) AS word_count, """ + trim("lower(text)") + """ AS low,
    """ + trim("text") + """ AS shown FROM raw_lines)"""

IS_TIME = r"regexp_matches(low, '^\d{1,2}:\d{2}(:\d{2})?(\s*(am|pm|a\.m\.|p\.m\.))?$')"
IS_DATE = r"""(
  (regexp_matches(low, '\d+[/.\-]\d+') AND (NOT regexp_matches(low, '\d+\.\d+') OR length(low) < 10))
  OR (regexp_matches(low, '\d{1,2}\s+\w+') AND length(low) < 25 AND NOT regexp_matches(low, '\d+\.\d+'))
  OR (regexp_matches(low, '\w+\s+\d{1,2}') AND length(low) < 25)
  OR regexp_matches(low, '\d+\s+de\s+\w+'))"""
IS_VALID = rf"""(length(low) BETWEEN 6 AND 80 AND word_count >= 1
  AND len(list_filter([{quoted(SYSTEM_PHRASES)}], lambda p: contains(low, p))) = 0
  AND avg_area >= 2500 AND NOT {IS_TIME} AND NOT {IS_DATE}
  AND NOT regexp_matches(low, '\b\d+%') AND NOT regexp_matches(low, '^[\d\s\-:]+$')
  AND NOT regexp_matches(low, '^[^\w\s]+$')
  AND length(regexp_replace(low, '\s', '', 'g')) > 2 AND NOT contains(low, '....'))"""
IS_CUT = r"""(contains(shown, '...') OR contains(shown, '…')
  OR (regexp_matches(shown, '\b\w{1,2}$') AND length(shown) > 10)
  OR regexp_matches(shown, '^[a-z]') OR regexp_matches(shown, '\w+\s+[a-z]{1,3}$'))"""


def point(test: str, value: str = "1") -> str:
    return f"CASE WHEN {test} THEN {value} ELSE 0 END"


def seen(pattern: str) -> str:
    return f"regexp_matches(lower(text), '{pattern}')"


SCORE = rf"""greatest(0.0, ((least(avg_area / 1000, 5.0)
  + CASE WHEN length(text) BETWEEN 15 AND 50 THEN 2 WHEN length(text) BETWEEN 10 AND 60 THEN 1 ELSE 0 END
  + CASE WHEN word_count BETWEEN 3 AND 8 THEN 2 WHEN word_count >= 2 THEN 1 ELSE 0 END
  + {point(seen(r'\b(episode|ep|part|pt|chapter)\b'))}
  + {point(seen(r'\b(with|featuring|interview|conversation|discussion)\b'))}
  + {point(seen(r'\?\s*$'))}
  + {point(seen(r'\b(how|what|why|where|when|who)\b'))}
  + {point(seen(r'\b(the|a|an)\b'))}
  + {point("regexp_matches(shown, '^[A-Z]') AND regexp_matches(shown, '[A-Z][a-z]')", '1.5::DOUBLE')}
  + {point("shown = upper(shown) AND length(shown) >= 15 AND word_count >= 2")}
  + {point("contains(shown, '?')")})
  * CASE WHEN {IS_CUT} THEN 0.7::DOUBLE ELSE 1 END)
  - {point(seen(r'\b\d+\s*(min|mins|minutes|hour|hours|hr|hrs)\b'), '2')}
  - {point(seen(r'\b(ago|yesterday|today|tomorrow)\b'), '2')}
  - {point(seen(r'^\d+$'), '2')})"""

ORACLES["candidate_valid"] = f"""{with_(PART_TITLES, TEXT_LINES)}
SELECT kind, id, n, {IS_VALID} AS valid FROM text_lines"""
ORACLES["date_like"] = f"""{with_(PART_TITLES, TEXT_LINES)}
SELECT kind, id, n, {IS_DATE} AS is_date, {IS_TIME} AS is_time FROM text_lines"""
ORACLES["truncated_text"] = f"""{with_(PART_TITLES, TEXT_LINES)}
SELECT kind, id, n, {IS_CUT} AS is_truncated FROM text_lines"""
ORACLES["candidate_score"] = f"""{with_(PART_TITLES, TEXT_LINES)}
SELECT kind, id, n, round({SCORE}, 6) AS score FROM text_lines"""

ORACLES["top_candidates"] = f"""{with_(PART_TITLES, TEXT_LINES,
    f"s AS (SELECT kind || ' ' || id AS image_id, n, shown, {SCORE} AS score FROM text_lines WHERE {IS_VALID})")}
SELECT image_id, ord, line_key, text, round(score, 6) AS score FROM (
  SELECT image_id, n AS line_key, shown AS text, score,
    row_number() OVER (PARTITION BY image_id ORDER BY score DESC, n) AS ord FROM s) WHERE ord <= 8"""

PLAYER_WORDS = f"""screen_items AS (
  SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, podcast_title, title FROM named_items),
shown_lines AS (
  SELECT l_orderkey AS image_id, {LINE_ORDER} * 10 + line * 20 AS first_idx, text, h,
    l_linenumber * 2600 + l_partkey % 12 * 210 + line * 70 AS y0
  FROM (SELECT *, CASE WHEN l_orderkey % 5 = 2 THEN 1 ELSE 0 END AS line, 60 AS h,
      CASE WHEN l_orderkey % 5 = 3 THEN string_split(title, ' ')[-1] || ' ' || string_split(title, ' ')[-2]
        || ' on air ab cd ef gh ij kl mn' ELSE title END AS text FROM screen_items
    UNION ALL SELECT *, CASE WHEN l_orderkey % 5 = 2 THEN 0 ELSE 1 END, 56,
      CASE WHEN l_orderkey % 5 = 4 THEN podcast_title ELSE {noisy('podcast_title')} END FROM screen_items
    UNION ALL SELECT *, 2, 30, (l_partkey % 60)::VARCHAR || ':' || lpad((l_suppkey % 60)::VARCHAR, 2, '0')
      FROM screen_items)),
player_words AS (
  SELECT image_id, first_idx + pos AS word_idx, text, pos * 300 AS x0, y0, length(text) * 14 AS width, h AS height
  FROM (SELECT * EXCLUDE (text), unnest(w) AS text, generate_subscripts(w, 1) - 1 AS pos
    FROM (SELECT *, string_split(text, ' ') AS w FROM shown_lines)))"""

PLAYER_LINES = f"""screen_lines AS (
  SELECT *, {trim('lower(text)')} AS low, {trim('text')} AS shown FROM (
    SELECT image_id, line_key, string_agg(text, ' ' ORDER BY x0, word_idx) AS text, arg_min(y0, word_idx) AS avg_y,
      avg(width * height) AS avg_area, count(*) AS word_count
    FROM fold JOIN player_words USING (image_id, word_idx) GROUP BY image_id, line_key)),
sized_lines AS (
  SELECT l.*, CASE WHEN o_orderstatus <> 'F' THEN 20000 END AS height,
    min(avg_y) OVER (PARTITION BY image_id) AS lo, max(avg_y) OVER (PARTITION BY image_id) AS hi
  FROM screen_lines l JOIN orders ON o_orderkey = image_id),
flagged AS (
  SELECT image_id, line_key,
    avg_y BETWEEN height * 0.45::DOUBLE AND height * 0.875::DOUBLE AND avg_area <= 50000 AS a,
    avg_y BETWEEN height * 0.08::DOUBLE AND height * 0.20::DOUBLE AND avg_area <= 5000 AS j,
    avg_y BETWEEN height * 0.08::DOUBLE AND height * 0.20::DOUBLE AND avg_area <= 5000 AS u,
    avg_y BETWEEN height * 0.05::DOUBLE AND height AND avg_area <= 10000 AS r
  FROM sized_lines WHERE height IS NOT NULL
  UNION ALL
  SELECT image_id, line_key,
    avg_y BETWEEN lo + (hi - lo) * 0.50::DOUBLE AND lo + (hi - lo) * 1.00::DOUBLE AND avg_area <= 50000,
    avg_y BETWEEN lo + (hi - lo) * 0.20::DOUBLE AND lo + (hi - lo) * 0.50::DOUBLE AND avg_area <= 5000,
    avg_y BETWEEN lo + (hi - lo) * 0.10::DOUBLE AND lo + (hi - lo) * 0.20::DOUBLE AND avg_area <= 5000,
    avg_y BETWEEN lo + (hi - lo) * 0.15::DOUBLE AND hi - (hi - lo) * 0.05::DOUBLE AND avg_area <= 10000
  FROM sized_lines WHERE height IS NULL),
{cascade('flagged')}"""

PLAYER_CANDIDATES = f"""good_lines AS (SELECT *, {SCORE} AS score FROM sized_lines WHERE {IS_VALID}),
first_try AS (SELECT * FROM (
  SELECT g.image_id, g.shown AS text, g.avg_y, g.score,
    row_number() OVER (PARTITION BY g.image_id ORDER BY g.score DESC, part, g.line_key) AS ord
  FROM kept JOIN good_lines g USING (image_id, line_key)) WHERE ord <= 8),
second_try AS (SELECT *, row_number() OVER (PARTITION BY image_id, text ORDER BY r) AS again FROM (
  SELECT image_id, shown AS text, avg_y, score,
    row_number() OVER (PARTITION BY image_id ORDER BY score DESC, line_key) AS r
  FROM good_lines WHERE avg_y BETWEEN height * 0.08::DOUBLE AND height * 0.20::DOUBLE AND avg_area <= 5000
    AND image_id NOT IN (SELECT image_id FROM first_try)) WHERE r <= 8),
found_candidates AS (
  SELECT image_id, ord, text, avg_y, score FROM first_try
  UNION ALL
  SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY r), text, avg_y, score
  FROM second_try WHERE again = 1)"""

ORACLES["extract_candidates"] = f"""WITH RECURSIVE {PART_TITLES}, {PODCASTS}, {EPISODES}, {PLAYER_WORDS},
{folded('player_words')}, {PLAYER_LINES}, {PLAYER_CANDIDATES}
SELECT image_id, ord, text, avg_y, round(score, 6) AS score FROM found_candidates"""

RESOLVED = f"""cands AS (SELECT *, {edit_norm('text')} AS flat FROM found_candidates),
norm_terms AS (SELECT DISTINCT {norm('text')} AS term FROM cands),
{ALL_PAIRS[1]}, {ALL_PAIRS[2]}, {ALL_PAIRS[3]}, {BEST_PODCAST},
exact AS (SELECT text, podcast_id, sim FROM (SELECT DISTINCT text FROM cands)
  JOIN best_podcast ON term = {norm('text')}),
near_pairs AS (
  SELECT *, CASE WHEN top_flat = bottom_flat THEN 1.0
    ELSE 1 - levenshtein(top_flat, bottom_flat)::DOUBLE / greatest(length(top_flat), length(bottom_flat)) END AS alike
  FROM (SELECT t.image_id, t.text AS top_text, b.text AS bottom_text, t.ord AS top_ord, b.ord AS bottom_ord,
      b.avg_y - t.avg_y AS distance, t.flat AS top_flat, b.flat AS bottom_flat,
      greatest(t.score, b.score) AS best, (t.avg_y + b.avg_y) / 2 AS mid
    FROM cands t JOIN cands b ON t.image_id = b.image_id
      AND (t.avg_y < b.avg_y OR (t.avg_y = b.avg_y AND t.ord < b.ord)) AND b.avg_y - t.avg_y <= 100)),
placed_pairs AS (SELECT *, row_number() OVER (PARTITION BY image_id
    ORDER BY best DESC, mid, distance, alike, top_ord, bottom_ord) AS ord1 FROM near_pairs WHERE alike <= 0.8),
both_ways AS (
  SELECT image_id, ord1, 1 AS ord2, bottom_text AS p, top_text AS e, 'podcast-episode' AS kind FROM placed_pairs
  UNION ALL SELECT image_id, ord1, 2, top_text, bottom_text, 'episode-podcast' FROM placed_pairs),
ways AS (SELECT w.*, x.podcast_id, x.sim FROM both_ways w LEFT JOIN exact x ON x.text = w.p),
text_pairs AS (SELECT DISTINCT p AS podcast_text, e AS episode_text FROM ways WHERE podcast_id IS NULL),
{", ".join(FUZZY_PODCAST)},
renamed_pairs AS (SELECT o.podcast_id, o.title AS own, t.title, t.podcast_id AS other
  FROM podcasts o, norm_titles t WHERE o.podcast_id IN (SELECT podcast_id FROM exact)),
{similarity('renamed_pairs', 'own', 'title', 'renamed_scored')},
renamed AS (SELECT podcast_id, other AS re_podcast_id FROM (SELECT *, row_number() OVER (PARTITION BY podcast_id
    ORDER BY sim DESC, other) AS r FROM renamed_scored) WHERE r = 1),
neighbours AS (
  SELECT c.image_id, c.ord, c.text, o.text AS e, row_number() OVER (PARTITION BY c.image_id, c.ord
    ORDER BY abs(o.avg_y - c.avg_y), o.ord) AS r
  FROM cands c JOIN cands o ON c.image_id = o.image_id AND c.text <> o.text
    AND abs(o.avg_y - c.avg_y) > 0 AND abs(o.avg_y - c.avg_y) <= 100),
beside AS (SELECT n.image_id, n.ord AS ord1, x.podcast_id, x.sim, n.e FROM neighbours n JOIN exact x USING (text) WHERE r = 1),
ep_wanted AS (
  SELECT podcast_id, e AS term FROM ways WHERE podcast_id IS NOT NULL
  UNION SELECT re_podcast_id, e FROM ways JOIN renamed USING (podcast_id)
  UNION SELECT re_podcast_id, e FROM beside JOIN renamed USING (podcast_id)),
ep_asked AS (SELECT podcast_id, term, episode_id, title, ord FROM ep_wanted JOIN listing USING (podcast_id)),
{similarity('ep_asked', 'term', 'title', 'ep_scored')},
ep_best AS (SELECT podcast_id, term, episode_id, title, sim FROM (SELECT *, row_number() OVER (PARTITION BY podcast_id, term
    ORDER BY sim DESC, ord) AS r FROM ep_scored) WHERE r = 1 AND sim > 0.2),
cand_texts AS (SELECT DISTINCT text FROM cands),
{ranked_keywords('cand_texts', 'text', 'text', 'cand_kw')},
kw_asked AS (SELECT w.podcast_id, w.term, episode_id, title, ord, kws FROM (
    SELECT podcast_id, e AS term FROM ways WHERE podcast_id IS NOT NULL UNION SELECT podcast_id, e FROM beside) w
  JOIN cand_kw k ON k.text = w.term JOIN listing l ON l.podcast_id = w.podcast_id),
kw_scored AS (SELECT *, {kw_score('title', 'kws')} AS score FROM kw_asked),
kw_best AS (SELECT podcast_id, term, episode_id, title, 0.5 + 0.3 * score AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY podcast_id, term ORDER BY score DESC, ord) AS r
  FROM kw_scored WHERE score >= 0.3) WHERE r = 1),
attempts AS (
  SELECT image_id, 1 AS stage, ord1, ord2, w.podcast_id, w.sim AS podcast_confidence, b.episode_id, b.title AS episode_title,
    b.sim AS episode_confidence, least(1.0, b.sim) AS confidence, 'spatial_pair_' || kind || '_fuzzy_podcast' AS method
  FROM ways w JOIN ep_best b ON b.podcast_id = w.podcast_id AND b.term = w.e
  UNION ALL
  SELECT image_id, 1, ord1, ord2, f.podcast_id, f.sim, f.episode_id, l.title, f.confidence, least(1.0, f.confidence),
    'spatial_pair_' || kind || '_fuzzy_podcast'
  FROM ways w JOIN fuzzy_found f ON w.podcast_id IS NULL AND f.podcast_text = w.p AND f.episode_text = w.e
  JOIN listing l ON l.podcast_id = f.podcast_id AND l.episode_id = f.episode_id
  UNION ALL
  SELECT image_id, 1, ord1, ord2, w.podcast_id, w.sim, CASE WHEN x.sim >= 0.5 THEN x.episode_id ELSE k.episode_id END,
    CASE WHEN x.sim >= 0.5 THEN x.title ELSE k.title END, CASE WHEN x.sim >= 0.5 THEN x.sim ELSE k.confidence END,
    CASE WHEN x.sim >= 0.5 THEN 0.6 ELSE least(0.6, k.confidence) END,
    'spatial_pair_' || kind || CASE WHEN x.sim >= 0.5 THEN '_exact' ELSE '_fuzzy' END
  FROM ways w JOIN renamed n ON n.podcast_id = w.podcast_id
  LEFT JOIN ep_best b ON b.podcast_id = w.podcast_id AND b.term = w.e
  LEFT JOIN ep_best x ON x.podcast_id = n.re_podcast_id AND x.term = w.e
  LEFT JOIN kw_best k ON k.podcast_id = w.podcast_id AND k.term = w.e
  WHERE b.term IS NULL AND (x.sim >= 0.5 OR k.term IS NOT NULL)
  UNION ALL
  SELECT image_id, 3, ord1, 0, s.podcast_id, s.sim, coalesce(x.episode_id, k.episode_id), coalesce(x.title, k.title),
    coalesce(x.sim, k.confidence), CASE WHEN x.term IS NOT NULL THEN 0.6 ELSE least(0.6, k.confidence) END,
    CASE WHEN x.term IS NOT NULL THEN 'individual_podcast_with_episode' ELSE 'individual_podcast_with_fuzzy_episode' END
  FROM beside s JOIN renamed n ON n.podcast_id = s.podcast_id
  LEFT JOIN ep_best x ON x.podcast_id = n.re_podcast_id AND x.term = s.e
  LEFT JOIN kw_best k ON k.podcast_id = s.podcast_id AND k.term = s.e
  WHERE x.term IS NOT NULL OR k.term IS NOT NULL
  UNION ALL
  SELECT image_id, 4, ord, 0, podcast_id, sim, NULL, 'Unknown Episode', NULL, 0.6, NULL FROM cands JOIN exact USING (text)),
winners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY stage, ord1, ord2) AS r
  FROM attempts) WHERE r = 1)"""

ORACLES["resolve_image"] = f"""WITH RECURSIVE {PART_TITLES}, {PODCASTS}, {EPISODES}, {PLAYER_WORDS},
{folded('player_words')}, {PLAYER_LINES}, {PLAYER_CANDIDATES}, {RESOLVED}
SELECT o_orderkey AS image_id, coalesce(w.podcast_id, -1) AS podcast_id, coalesce(p.title, 'Episode not found') AS podcast_title,
  round(podcast_confidence, 6) AS podcast_confidence, coalesce(episode_id, -1) AS episode_id,
  coalesce(episode_title, 'Episode not found') AS episode_title, round(episode_confidence, 6) AS episode_confidence,
  round(coalesce(confidence, 0.0), 6)::DOUBLE AS confidence,
  CASE WHEN stage IS NULL THEN 'no_validation_successful' ELSE method END AS method, stage IS NOT NULL AS validated,
  CASE WHEN stage IS NULL THEN 'unvalidated' ELSE 'validated' END AS player
FROM orders LEFT JOIN winners w ON w.image_id = o_orderkey LEFT JOIN podcasts p ON p.podcast_id = w.podcast_id"""

ORACLES["resolution_methods"] = f"""SELECT method, validated, count(*) AS images
FROM ({ORACLES["resolve_image"]}) GROUP BY method, validated"""

ORACLES["union_dedupe"] = f"""{with_(PART_TITLES, LINES, HEIGHTS,
    '''both_bands AS (SELECT *, CASE WHEN avg_y >= height * 0.45::DOUBLE THEN 0 ELSE 1 END AS part
  FROM lines JOIN heights USING (image_id))''')}
SELECT image_id, text, part, line_key FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, text ORDER BY part, line_key) AS r FROM both_bands)
WHERE r = 1"""

CANDIDATES = f"""candidates AS (SELECT * FROM (
  SELECT *, avg_area / 1000 AS score, {edit_norm('text')} AS flat,
    row_number() OVER (PARTITION BY image_id ORDER BY avg_area / 1000 DESC, line_key) AS ord
  FROM lines) WHERE ord <= 8)"""
PAIRS = """pairs AS (
  SELECT *, CASE WHEN top_flat = bottom_flat THEN 1.0
    ELSE 1 - levenshtein(top_flat, bottom_flat)::DOUBLE / greatest(length(top_flat), length(bottom_flat)) END AS sim
  FROM (SELECT t.image_id, t.ord AS top_ord, b.ord AS bottom_ord, b.avg_y - t.avg_y AS distance,
      t.flat AS top_flat, b.flat AS bottom_flat, greatest(t.score, b.score) AS best, (t.avg_y + b.avg_y) / 2 AS mid
    FROM candidates t JOIN candidates b ON t.image_id = b.image_id
      AND (t.avg_y < b.avg_y OR (t.avg_y = b.avg_y AND t.ord < b.ord)) AND b.avg_y - t.avg_y <= 100))"""

ORACLES["spatial_pairs"] = f"""{with_(PART_TITLES, LINES, CANDIDATES, PAIRS)}
SELECT image_id, top_ord, bottom_ord, distance, round(sim, 6) AS similarity FROM pairs WHERE sim <= 0.8"""
ORACLES["pair_ranking"] = f"""{with_(PART_TITLES, LINES, CANDIDATES, PAIRS)}
SELECT image_id, top_ord, bottom_ord, row_number() OVER (PARTITION BY image_id
  ORDER BY best DESC, mid, distance, sim, top_ord, bottom_ord) AS pair_rank FROM pairs WHERE sim <= 0.8"""
ORACLES["nearest_vertical"] = f"""{with_(PART_TITLES, LINES, CANDIDATES)}
SELECT image_id, ord, near_ord, gap FROM (
  SELECT c.image_id, c.ord, o.ord AS near_ord, abs(o.avg_y - c.avg_y) AS gap,
    row_number() OVER (PARTITION BY c.image_id, c.ord ORDER BY abs(o.avg_y - c.avg_y), o.ord) AS r
  FROM candidates c JOIN candidates o ON c.image_id = o.image_id AND c.text <> o.text
    AND abs(o.avg_y - c.avg_y) > 0 AND abs(o.avg_y - c.avg_y) <= 100) WHERE r = 1"""

CLOCK = r"""times AS (SELECT *, minute(ts)::VARCHAR || ':' || lpad(second(ts)::VARCHAR, 2, '0') AS short,
    hour(ts)::VARCHAR || ':' || lpad(minute(ts)::VARCHAR, 2, '0') || ':' || lpad(second(ts)::VARCHAR, 2, '0') AS long
  FROM events)"""
TIME_SCREENS = r"""screens AS (SELECT *, event_id AS image_id,
    CASE event_type WHEN 'click' THEN '-' || short WHEN 'error' THEN 'no time here' ELSE 'now ' || short END AS upper_text,
    CASE event_type WHEN 'purchase' THEN long || ' am' WHEN 'error' THEN 'nor here' ELSE long || ' left' END AS lower_text
  FROM times),
texts AS (SELECT image_id, short, upper_text || chr(10) || lower_text || CASE WHEN event_type = 'error'
    THEN ' | ' || long || ' pm | some more words in between | ' || short ELSE '' END AS full_text FROM screens),
placed AS (
  SELECT image_id, 1 AS line_key, upper_text AS text, value * 3 AS y,
    CASE WHEN event_type = 'signup' THEN 6000 ELSE 3000 END AS area FROM screens
  UNION ALL SELECT image_id, 2, lower_text, 300, 4000 FROM screens)"""


def context(text: str, part: str) -> str:
    at = f"(strpos({text}, {part}) - 1)"
    begin = f"greatest(0, {at} - 30)"
    return f"lower(substr({text}, {begin} + 1, {at} + length({part}) + 30 - {begin}))"


CLOCK_WORDS = r"'\b(4:30a\.m\.|4:30p\.m\.|am|pm)\b'"

SCREEN_TIMES = [
    r'''found AS (SELECT image_id, line_key, y, area, unnest(m) AS time, generate_subscripts(m, 1) AS hit
  FROM (SELECT *, regexp_extract_all(text, '\b\d{1,2}:\d{2}(?::\d{2})?\b') AS m FROM placed))''',
    rf'''fine AS (SELECT f.*, row_number() OVER (PARTITION BY image_id ORDER BY y DESC, line_key, hit) AS r
  FROM found f JOIN texts USING (image_id)
  WHERE area <= 5000 AND NOT contains(full_text, '-' || time)
    AND ((len(string_split(time, ':')) = 2 AND string_split(time, ':')[1]::INT <= 59 AND string_split(time, ':')[2]::INT <= 59)
      OR NOT regexp_matches({context('full_text', 'time')}, {CLOCK_WORDS})))''',
    r'''everywhere AS (SELECT image_id, full_text, unnest(m) AS time, generate_subscripts(m, 1) AS hit
  FROM (SELECT *, regexp_extract_all(full_text, '\b\d{1,2}:\d{2}(?::\d{2})?\b') AS m FROM texts))''',
    rf'''spare AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY hit) AS r FROM everywhere
  WHERE NOT contains(full_text, '-' || time) AND NOT regexp_matches({context('full_text', 'time')}, {CLOCK_WORDS}))''',
    '''screen_times AS (
  SELECT t.image_id, CASE WHEN t.image_id IN (SELECT image_id FROM found) THEN f.time ELSE s.time END AS timestamp
  FROM texts t LEFT JOIN fine f ON f.image_id = t.image_id AND f.r = 1
  LEFT JOIN spare s ON s.image_id = t.image_id AND s.r = 1)''',
]

ORACLES["timestamp_extract"] = f"""{with_(CLOCK, TIME_SCREENS, *SCREEN_TIMES)}
SELECT image_id, timestamp FROM screen_times"""

ORACLES["extract_records"] = f"""WITH RECURSIVE {PART_TITLES}, {PODCASTS}, {EPISODES}, {PLAYER_WORDS},
{folded('player_words')}, {PLAYER_LINES}, {PLAYER_CANDIDATES}, {RESOLVED},
texts AS (SELECT image_id, string_agg(text, ' ' ORDER BY word_idx) AS full_text FROM player_words GROUP BY image_id),
placed AS (SELECT image_id, line_key, text, avg_y AS y, avg_area AS area FROM kept JOIN sized_lines USING (image_id, line_key)),
{", ".join(SCREEN_TIMES)},
lists AS (SELECT image_id, string_agg(text, ' ' ORDER BY ord) AS candidates FROM found_candidates GROUP BY image_id)
SELECT o_orderkey AS image_id, coalesce(p.title, 'Episode not found') AS podcast_title,
  coalesce(episode_title, 'Episode not found') AS episode_title, timestamp,
  CASE WHEN stage IS NULL THEN 'unvalidated' ELSE 'validated' END AS player,
  round(coalesce(confidence, 0.0), 6)::DOUBLE AS confidence,
  CASE WHEN stage IS NULL THEN 'no_validation_successful' ELSE method END AS method, stage IS NOT NULL AS validated,
  candidates, full_text AS raw_text, CASE WHEN full_text IS NULL THEN 'No text detected in image' END AS error
FROM orders LEFT JOIN winners w ON w.image_id = o_orderkey LEFT JOIN podcasts p ON p.podcast_id = w.podcast_id
LEFT JOIN texts t ON t.image_id = o_orderkey LEFT JOIN screen_times s ON s.image_id = o_orderkey
LEFT JOIN lists c ON c.image_id = o_orderkey"""

ORACLES["text_context"] = f"""{with_(CLOCK, TIME_SCREENS)}
SELECT image_id, {context('full_text', 'short')} AS context,
  regexp_matches({context('full_text', 'short')}, {CLOCK_WORDS}) AS is_clock FROM texts"""

# --- times and ranges -----------------------------------------------------------------

STAMPS = """stamps AS (SELECT event_id,
    CASE event_type WHEN 'click' THEN short WHEN 'view' THEN long WHEN 'error' THEN minute(ts)::VARCHAR
      WHEN 'signup' THEN '' WHEN 'purchase' THEN short || ':x' END AS stamp,
    CAST(floor(value) AS INTEGER) AS size, -(CAST(floor(value) AS INTEGER) % 121) AS range_start,
    CAST(floor(value) AS INTEGER) % 97 AS range_end FROM times),
parsed AS (SELECT *, coalesce(CASE len(string_split(stamp, ':'))
    WHEN 2 THEN try_cast(string_split(stamp, ':')[1] AS BIGINT) * 60 + try_cast(string_split(stamp, ':')[2] AS BIGINT)
    WHEN 3 THEN try_cast(string_split(stamp, ':')[1] AS BIGINT) * 3600 + try_cast(string_split(stamp, ':')[2] AS BIGINT) * 60
      + try_cast(string_split(stamp, ':')[3] AS BIGINT) END, 0) AS sec FROM stamps)"""

ORACLES["parse_timestamp"] = f"{with_(CLOCK, STAMPS)} SELECT event_id, sec AS seconds FROM parsed"
ORACLES["format_timestamp"] = f"""{with_(CLOCK, STAMPS)}
SELECT event_id, {shown('size * 17')} AS shown,
  {shown('floor(size * 900 / 1000)')} || ' - ' || {shown('floor(size * 1900 / 1000)')} AS shown_range FROM parsed"""
ORACLES["timeframe"] = f"""{with_(CLOCK, STAMPS,
    'r AS (SELECT *, greatest(0, sec + range_start) AS a FROM parsed)')}
SELECT event_id, CASE WHEN stamp <> '' THEN {shown('a')} || '-' || {shown('greatest(a, sec + range_end)')}
  ELSE 'stored' END AS timeframe FROM r"""
ORACLES["clip_window"] = f"""{with_(CLOCK, STAMPS)}
SELECT event_id, -range_start AS before_s, range_end AS after_s, greatest(0, (sec + range_start) * 1000) AS start_ms,
  (sec + range_end) * 1000 AS end_ms, (sec + range_end) * 1000 - greatest(0, (sec + range_start) * 1000) AS duration_ms
FROM parsed"""
ORACLES["snap_increment"] = f"""{with_(CLOCK, STAMPS)}
SELECT event_id, CASE WHEN v = 0 THEN 0 ELSE sign(v) * CASE WHEN abs(v) <= 22.5 THEN 15 WHEN abs(v) <= 37.5 THEN 30
  WHEN abs(v) <= 52.5 THEN 45 WHEN abs(v) <= 75 THEN 60 WHEN abs(v) <= 105 THEN 90 ELSE 120 END END::INTEGER AS snapped
FROM (SELECT event_id, size - 150 AS v FROM parsed)"""
ORACLES["clamp_range"] = f"""{with_(CLOCK, STAMPS)}
SELECT event_id, least(least(0, greatest(-120, size - 200)), range_end) AS range_left,
  greatest(greatest(0, least(120, size - 200)), range_start) AS range_right FROM parsed"""

RESOLUTIONS = """resolutions AS (SELECT o_orderkey AS image_id,
    CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS podcast_id,
    CASE WHEN o_orderstatus <> 'F' THEN 'Show ' || o_custkey ELSE '' END AS podcast_title,
    CASE WHEN o_orderstatus = 'O' THEN o_orderkey * 3 END AS episode_id,
    CASE WHEN o_orderstatus = 'O' THEN 'Talk ' || o_orderpriority END AS episode_title,
    strftime(o_orderdate, '%-d:%m') AS timestamp, o_orderstatus = 'O' AS validated FROM orders)"""

ORACLES["deep_link"] = f"""{with_(RESOLUTIONS)}
SELECT image_id, CASE WHEN podcast_id IS NULL THEN ''
  ELSE 'https://podcasts.apple.com/podcast/id' || podcast_id || CASE WHEN episode_id IS NULL THEN ''
    ELSE '?i=' || episode_id || CASE WHEN o_totalprice > 100000
      THEN '&t=' || CAST(floor(floor(o_totalprice) / 1000) AS BIGINT) ELSE '' END END END AS link
FROM resolutions JOIN orders ON o_orderkey = image_id"""

# --- transcripts ----------------------------------------------------------------------

SPOKEN = """turns AS (SELECT conv_id AS clip_id, turn, role, text,
    CASE WHEN lag(role) OVER w IS NULL THEN '' WHEN lag(role) OVER w = role THEN ' '
      ELSE chr(10) || chr(10) END AS gap
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
spoken AS (SELECT clip_id, string_agg(gap || text, '' ORDER BY turn) AS text FROM turns GROUP BY clip_id)"""
TOKENS = r"""token_lists AS (SELECT clip_id, regexp_extract_all(text, '\S+\s*') AS items FROM spoken),
tokens AS (SELECT clip_id, CAST(generate_subscripts(items, 1) - 1 AS INTEGER) AS word_index, unnest(items) AS item,
  FROM token_lists)"""
TIMINGS = r"""spoken_counts AS (SELECT conv_id AS clip_id, sum(len(regexp_extract_all(text, '\S+'))) AS n
  FROM conversations WHERE role <> 'system' GROUP BY conv_id),
timings AS (SELECT clip_id, CAST(unnest(generate_series(0, CAST(floor(n * 9 / 10) AS BIGINT))) AS INTEGER) AS word_index
  FROM spoken_counts WHERE n > 0)"""
TIMED = r"""timed AS (SELECT clip_id AS episode_id, word_index, regexp_extract(item, '\S+') AS text,
    CAST(word_index * 400 AS BIGINT) AS start_ms, CAST(word_index * 400 + 350 AS BIGINT) AS end_ms,
    0.7::DOUBLE + word_index % 7 * 0.05::DOUBLE AS confidence FROM tokens)"""
CLIPS = """clips AS (SELECT clip_id, clip_id % 3 * 60 + clip_id * 7 % 60 AS sec, clip_id * 5 % 121 AS before_s,
    clip_id * 11 % 121 AS after_s FROM (SELECT DISTINCT conv_id AS clip_id FROM conversations)),
windows AS (SELECT *, greatest(0, (sec - before_s) * 1000) AS start_ms, (sec + after_s) * 1000 AS end_ms FROM clips)"""
SELECTED = r"selected AS (SELECT clip_id, word_index FROM tokens WHERE length(regexp_extract(item, '\S+')) > 3)"
BLOCKS = """islands AS (SELECT *, word_index - row_number() OVER (PARTITION BY clip_id ORDER BY word_index) AS block
  FROM selected),
blocks AS (SELECT clip_id, min(word_index) AS start_index, max(word_index) AS end_index,
    """ + trim("string_agg(item, '' ORDER BY word_index)") + """ AS text
  FROM islands JOIN tokens USING (clip_id, word_index) GROUP BY clip_id, block)"""

ORACLES["speaker_count"] = """
SELECT conv_id AS clip_id, count(DISTINCT role) AS speakers FROM conversations GROUP BY conv_id"""
ORACLES["speaker_transcript"] = f"{with_(SPOKEN)} SELECT clip_id, text FROM spoken"
ORACLES["positional_join"] = rf"""{with_(SPOKEN, TOKENS, TIMINGS)}
SELECT clip_id, word_index, regexp_extract(item, '\S+') AS token,
  CASE WHEN t.clip_id IS NOT NULL THEN CAST(word_index * 400 AS BIGINT) ELSE -1 END AS start_ms,
  CASE WHEN t.clip_id IS NOT NULL THEN CAST(word_index * 400 + 350 AS BIGINT) ELSE -1 END AS end_ms
FROM tokens LEFT JOIN timings t USING (clip_id, word_index)"""
ORACLES["alignment_counts"] = f"""{with_(SPOKEN, TOKENS, TIMINGS)}
SELECT clip_id, coalesce(a.n, 0) AS token_count, coalesce(b.n, 0) AS timing_count
FROM (SELECT clip_id, count(*) AS n FROM tokens GROUP BY 1) a
FULL JOIN (SELECT clip_id, count(*) AS n FROM timings GROUP BY 1) b USING (clip_id)"""
ORACLES["clip_range_join"] = f"""{with_(SPOKEN, TOKENS, TIMED, CLIPS)}
SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY word_index) - 1 AS INTEGER) AS word_index,
  text, t.start_ms
FROM windows w JOIN timed t ON t.episode_id = w.clip_id AND t.start_ms >= w.start_ms AND t.start_ms < w.end_ms"""
ORACLES["selection_blocks"] = f"""{with_(SPOKEN, TOKENS, SELECTED, BLOCKS)}
SELECT clip_id, start_index, end_index, text FROM blocks"""
ORACLES["selection_edges"] = f"""{with_(SPOKEN, TOKENS, SELECTED)}
SELECT clip_id, word_index, word_index = min(word_index) OVER w OR word_index = max(word_index) OVER w AS is_edge
FROM selected WINDOW w AS (PARTITION BY clip_id)"""
ORACLES["lone_words"] = f"""{with_(SPOKEN, TOKENS, SELECTED)}
SELECT clip_id, word_index FROM (
  SELECT *, lag(word_index) OVER w AS p, lead(word_index) OVER w AS q FROM selected
  WINDOW w AS (PARTITION BY clip_id ORDER BY word_index))
WHERE coalesce(p <> word_index - 1, true) AND coalesce(q <> word_index + 1, true)"""
ORACLES["selection_latest"] = """
WITH e AS (SELECT user_id AS clip_id, event_id AS seq, event_type IN ('click', 'purchase') AS off,
    CAST(floor(value) AS INTEGER) AS a, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
x AS (SELECT clip_id, seq, off, CAST(unnest(generate_series(a, a + k)) AS INTEGER) AS word_index FROM e),
l AS (SELECT *, row_number() OVER (PARTITION BY clip_id, word_index ORDER BY seq DESC) AS r FROM x)
SELECT clip_id, word_index FROM l WHERE r = 1 AND NOT off"""
LATEST = ORACLES["selection_latest"].strip()
ORACLES["selection_intervals"] = f"""
SELECT clip_id, min(word_index) AS start_index, max(word_index) AS end_index
FROM (SELECT *, word_index - row_number() OVER (PARTITION BY clip_id ORDER BY word_index) AS run FROM ({LATEST}))
GROUP BY clip_id, run"""
ORACLES["selection_latest_words"] = f"""{with_(SPOKEN, TOKENS)}
SELECT clip_id, word_index FROM tokens JOIN ({LATEST}) USING (clip_id, word_index)"""
# The selection of each clip after each event; a block is bounded by the nearest words
# that are not selected.
ORACLES["selection_fold"] = """WITH RECURSIVE e AS (
  SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
    CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'drag' WHEN 'error' THEN 'deselect' ELSE 'select' END AS op,
    CAST(floor(value) AS INTEGER) AS a,
    CAST(floor(value) AS INTEGER) + coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS b FROM events),
fold AS (
  SELECT clip_id, 0::BIGINT AS rn, []::INTEGER[] AS sel FROM (SELECT DISTINCT clip_id FROM e)
  UNION ALL
  SELECT clip_id, rn, CASE
    WHEN op = 'select' OR (op = 'drag' AND a <> b AND NOT held)
      THEN list_distinct(list_concat(sel, CAST(generate_series(low, high) AS INTEGER[])))
    WHEN op = 'deselect' THEN list_filter(sel, lambda x: x NOT BETWEEN low AND high)
    WHEN op = 'drag' AND a <> b THEN list_filter(sel, lambda x: x NOT BETWEEN greatest(low, first) AND least(high, last))
    WHEN op = 'click' AND NOT held THEN list_append(sel, a)
    WHEN op = 'click' AND first = last THEN list_filter(sel, lambda x: x <> a)
    WHEN op = 'click' THEN list_filter(sel, lambda x: x NOT BETWEEN a + 1 AND last)
    ELSE sel END
  FROM (
    SELECT e.*, f.sel, list_contains(f.sel, a) AS held, least(a, b) AS low, greatest(a, b) AS high,
      list_max(list_filter(range(-1, a), lambda x: NOT list_contains(f.sel, x::INTEGER))) + 1 AS first,
      list_min(list_filter(range(a + 1, list_max(list_append(f.sel, a)) + 2),
        lambda x: NOT list_contains(f.sel, x::INTEGER))) - 1 AS last
    FROM fold f JOIN e ON e.clip_id = f.clip_id AND e.rn = f.rn + 1)),
ends AS (SELECT clip_id, arg_max(sel, rn) AS sel FROM fold GROUP BY clip_id)
SELECT clip_id, unnest(sel) AS word_index FROM ends"""

ORACLES["low_confidence_words"] = f"""{with_(SPOKEN, TOKENS, TIMED)}
SELECT episode_id, word_index, text, round(confidence, 6) AS confidence FROM timed WHERE confidence < 0.8::DOUBLE"""
ORACLES["clip_stats"] = f"""{with_(SPOKEN, TOKENS, TIMED, CLIPS,
    '''per_clip AS (SELECT episode_id AS clip_id, max(end_ms) - min(start_ms) AS span, count(*) AS words,
    count(*) FILTER (WHERE confidence < 0.8::DOUBLE) AS fixes FROM timed GROUP BY 1)''')}
SELECT clip_id, {half_up('span / 1000')} AS duration_s, CAST(before_s + after_s AS INTEGER) AS total_s, fixes,
  {half_up('(1 - fixes / words) * 100')} AS confidence_percent FROM per_clip JOIN clips USING (clip_id)"""
ORACLES["map_unpivot"] = """
SELECT doc_id, quality = 0 AND toxic = 0 AS none_needed, coalesce(kind, '') AS kind, coalesce(count, 0) AS count FROM (
  SELECT doc_id, quality, toxic, 'quality' AS kind, quality AS count FROM labels WHERE quality > 0
  UNION ALL SELECT doc_id, quality, toxic, 'toxic', toxic FROM labels WHERE toxic > 0
  UNION ALL SELECT doc_id, quality, toxic, NULL, NULL FROM labels WHERE quality <= 0 AND toxic <= 0)"""
ORACLES["display_text"] = r"""
SELECT doc_id, CASE WHEN lang <> 'en' THEN regexp_replace(text, '\s+', ' ', 'g') ELSE text END AS display_text
FROM documents"""
ORACLES["correction_items"] = """
SELECT event_id, 0 AS pos, event_type AS original, upper(event_type) AS corrected, 'case' AS reason,
  NULL::DOUBLE AS confidence FROM events
UNION ALL SELECT event_id, 1, NULL, NULL, event_type, NULL FROM events
UNION ALL SELECT event_id, 2, NULL, NULL, 'Correction applied (details not available)', NULL FROM events"""

# --- requests, edits, feeds -----------------------------------------------------------

ORACLES["upload_intake"] = """
WITH f AS (SELECT doc_id // 4 AS request_id, doc_id AS image_id,
    CASE WHEN lang = 'de' AND doc_id % 7 = 0 THEN 'text/plain' ELSE 'image/png' END AS mime,
    n_chars * 900 AS length FROM documents)
SELECT request_id, image_id, round(length / 1048576, 2) AS size_mb, length / 1048576 > 5 AS is_large FROM f
WHERE request_id NOT IN (SELECT request_id FROM f WHERE mime NOT LIKE 'image/%' OR length > 10485760)
  AND request_id IN (SELECT request_id FROM f GROUP BY 1 HAVING count(*) <= 5)"""
ORACLES["status_counts"] = """
SELECT source, count(*) AS total, count(quality) AS successful, count(*) - count(quality) AS failed
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"""
ORACLES["coalesce_chain"] = f"""{with_(RESOLUTIONS)}
SELECT image_id, coalesce(nullif(episode_title, ''), nullif(podcast_title, ''), CASE WHEN podcast_title = '' THEN
  'Extraction failed' END, 'Episode ' || (image_id % 5 + 1)) AS title,
  coalesce(CASE WHEN validated THEN nullif(timestamp, '') END, '0:00') AS timestamp FROM resolutions"""
ORACLES["timestamp_options"] = f"""{with_(CLOCK,
    '''o AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN short END AS a,
    CASE WHEN event_type = 'click' THEN short ELSE long END AS b,
    CASE WHEN event_type = 'error' THEN '' ELSE short END AS c FROM times)''')}
SELECT event_id, concat_ws(' ', nullif(a, ''), CASE WHEN b IS DISTINCT FROM a THEN nullif(b, '') END,
  CASE WHEN c IS DISTINCT FROM a AND c IS DISTINCT FROM b THEN nullif(c, '') END) AS options FROM o"""
OVERRIDES = """overrides AS (SELECT o_orderkey AS image_id,
    CASE WHEN o_totalprice > 200000 THEN o_custkey + 1 END AS podcast_id,
    CASE WHEN o_totalprice > 200000 THEN 'Edited ' || o_custkey ELSE '' END AS podcast_title,
    CASE WHEN o_totalprice < 300000 THEN 'Edited talk' END AS episode_title,
    CASE WHEN o_totalprice < 100000 THEN '9:59' END AS timestamp, o_orderpriority = '5-LOW' AS deleted
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW'))"""
ORACLES["override_join"] = f"""{with_(RESOLUTIONS, OVERRIDES)}
SELECT image_id, coalesce(o.podcast_id, r.podcast_id, -1) AS podcast_id,
  coalesce(nullif(o.podcast_title, ''), r.podcast_title) AS podcast_title, coalesce(r.episode_id, -1) AS episode_id,
  coalesce(o.episode_title, r.episode_title) AS episode_title, coalesce(o.timestamp, r.timestamp) AS timestamp, validated
FROM resolutions r LEFT JOIN overrides o USING (image_id)"""
ORACLES["delete_anti"] = f"""{with_(RESOLUTIONS, OVERRIDES)}
SELECT image_id, timestamp FROM resolutions WHERE image_id NOT IN (SELECT image_id FROM overrides WHERE deleted)"""
ORACLES["transcript_eligible"] = f"""{with_(RESOLUTIONS)}
SELECT image_id, podcast_id FROM resolutions WHERE validated AND podcast_id IS NOT NULL AND timestamp <> ''"""
ORACLES["podcast_details"] = f"""{with_(PART_TITLES)}
SELECT p_partkey AS podcast_id, title, p_brand AS artist, coalesce(big, small) AS artwork_url,
  coalesce(small, big) AS list_artwork_url
FROM (SELECT *, CASE WHEN p_size % 3 <> 0 THEN 's' || p_size END AS small,
    CASE WHEN p_size % 2 = 0 THEN 'l' || p_size END AS big
  FROM part JOIN part_titles USING (p_partkey) WHERE p_partkey IN (SELECT l_suppkey FROM lineitem))"""

FEED = """items AS (SELECT podcast_id, episode_id AS pos, title, length(title) % 5 <> 0 AS has_file FROM episodes),
feed_asked AS (SELECT podcast_id, term, pos, title, has_file FROM episode_terms JOIN items USING (podcast_id))"""
FIRST_ITEM = [
    *FULL_CATALOG, FEED, similarity("feed_asked", "term", "title", "scored"),
    """first_item AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY podcast_id, term ORDER BY pos) AS r
  FROM scored WHERE sim > 0.7) WHERE r = 1)""",
]
AUDIO = """audio AS (SELECT e.podcast_id, e.term,
    CASE WHEN has_file THEN 'https://media.example/' || pos || '.mp3' END AS audio_url,
    CASE WHEN has_file THEN 'audio/mpeg' END AS audio_type,
    CASE WHEN has_file THEN length(title)::VARCHAR END AS audio_length
  FROM episode_terms e LEFT JOIN first_item f ON f.podcast_id = e.podcast_id AND f.term = e.term)"""

ORACLES["first_match_above_threshold"] = f"""{with_(*FIRST_ITEM)}
SELECT podcast_id, term, pos AS episode_id, title FROM first_item"""
ORACLES["feed_audio_url"] = f"{with_(*FIRST_ITEM, AUDIO)} SELECT * FROM audio"

ORACLES["clip_transcript"] = f"""{with_(*FIRST_ITEM, AUDIO, SPOKEN, TOKENS, TIMED, CLIPS,
    '''ready AS (SELECT concat_ws('/', w.clip_id, a.term) AS clip_id, w.clip_id AS episode_id, w.start_ms, w.end_ms,
    a.podcast_id, a.audio_url FROM windows w LEFT JOIN audio a ON a.podcast_id = w.clip_id)''',
    '''said AS (SELECT r.clip_id, string_agg(t.text, ' ' ORDER BY t.word_index) AS transcript,
    avg(t.confidence) AS confidence, count(*) AS word_count
  FROM ready r JOIN timed t ON t.episode_id = r.episode_id AND t.start_ms >= r.start_ms AND t.start_ms < r.end_ms
  WHERE r.audio_url IS NOT NULL GROUP BY r.clip_id)''')}
SELECT clip_id, coalesce(podcast_id, -1) AS podcast_id, start_ms, end_ms, audio_url, coalesce(transcript, '') AS transcript,
  round(coalesce(confidence, 0), 6) AS confidence, coalesce(word_count, 0) AS word_count,
  CASE WHEN transcript IS NULL THEN 'mock' ELSE 'assemblyai' END AS source,
  CASE WHEN transcript IS NOT NULL THEN NULL WHEN audio_url IS NULL THEN 'Audio URL not available'
    ELSE 'AssemblyAI generation failed' END AS mock_reason
FROM ready LEFT JOIN said USING (clip_id)"""

ORACLES["quote_export"] = f"""{with_(SPOKEN, TOKENS, TIMINGS, SELECTED, BLOCKS, CLIPS,
    '''bodies AS (SELECT clip_id, min(start_index) AS first_word, max(end_index) AS last_word,
    string_agg(text, chr(10) || chr(10) ORDER BY start_index) AS body FROM blocks GROUP BY clip_id)''',
    '''timed_bodies AS (SELECT b.*, CASE WHEN s.clip_id IS NOT NULL THEN first_word * 400 END AS first_ms,
    CASE WHEN e.clip_id IS NOT NULL THEN last_word * 400 + 350 END AS last_ms
  FROM bodies b LEFT JOIN timings s ON s.clip_id = b.clip_id AND s.word_index = first_word
  LEFT JOIN timings e ON e.clip_id = b.clip_id AND e.word_index = last_word)''')}
SELECT clip_id, 'Talk ' || clip_id || ' (' || CASE WHEN first_ms IS NOT NULL AND last_ms IS NOT NULL
    THEN {shown('floor(first_ms / 1000)')} || '-' || {shown('ceil(last_ms / 1000)')}
    ELSE {shown('greatest(0, sec - before_s)')} || '-' || {shown('greatest(0, sec - before_s, sec + after_s)')} END
  || ')' || chr(10) || CASE WHEN clip_id % 4 <> 0 THEN 'Show ' || clip_id ELSE 'Unknown Podcast' END || chr(10)
  || CASE WHEN clip_id % 5 = 0 THEN '' ELSE 'https://podcasts.apple.com/podcast/id' || (clip_id + 1000)
    || CASE WHEN clip_id % 3 = 0 THEN '' ELSE '?i=' || (clip_id + 2000)
      || CASE WHEN first_ms IS NULL THEN '' ELSE '&t=' || CAST(floor(first_ms / 1000) AS BIGINT) END END END
  || chr(10) || chr(10) || body AS quote
FROM timed_bodies JOIN clips USING (clip_id)"""
