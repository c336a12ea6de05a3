"""DuckDB SQL of the queries over texts, candidates and landed rows, where it is longer than the query itself."""

from __future__ import annotations

from trendloom.functions import vocabulary as V
from trendloom.operators import candidates as C
from trendloom.operators import topics as P
from trendloom.plans import base as B
from trendloom.plans.registry import ORACLE_SQL
from trendloom.plans.texts import TOKENS


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STOP = _in(V.STOPWORDS)
#: Texts of a table as lower-case words, and the dictionary of three-word aliases.
WORDS = r"""norm AS (
    SELECT {id} AS id, trim(regexp_replace(regexp_replace(replace(lower(coalesce({text}, '')), '''', ' '), '[^\p{{L}}\p{{N}}\p{{M}}_\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM {table}
), w AS (
    SELECT id, CASE WHEN s = '' THEN [] ELSE string_split(s, ' ') END AS t FROM norm
), bn AS (
    SELECT item_id, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}_\s]+', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS t FROM benchmark
), alias AS (
    SELECT t[1] || ' ' || t[2] || ' ' || t[3] AS alias, min(item_id) AS entity_id FROM bn WHERE len(t) >= 3 GROUP BY 1
), spot AS (
    SELECT id, t, unnest(range(0, len(t) - 2)) AS pos FROM w WHERE len(t) >= 3
), hit AS (
    SELECT id, pos, alias, entity_id FROM (SELECT id, pos, t[pos + 1] || ' ' || t[pos + 2] || ' ' || t[pos + 3] AS alias FROM spot) x JOIN alias USING (alias)
), m AS (
    SELECT DISTINCT ON (id, entity_id) id, entity_id, alias, pos FROM hit ORDER BY id, entity_id, pos, alias
)"""
DOCS = WORDS.format(id="doc_id", text="text", table="documents")
CHAT = WORDS.format(id="conv_id || '-' || turn", text="text", table="conversations")

ORACLE_SQL["resolved_records"] = f"WITH {DOCS} SELECT id, entity_id, 'Item ' || entity_id AS name, alias AS matched_from, row_number() OVER (PARTITION BY id ORDER BY pos, entity_id) - 1 AS place FROM m"

ALL_LENGTHS = f"""WITH {DOCS}, every AS (
    SELECT item_id, n, array_to_string(t[1 : n], ' ') AS alias FROM (SELECT item_id, t, unnest([item_id % 6 + 1, (item_id + 2) % 6 + 1]) AS n FROM bn) WHERE len(t) >= n
), d AS (
    SELECT alias, min(item_id) AS entity_id, any_value(n) AS n FROM every GROUP BY alias
), e AS (
    SELECT id, unnest(t) AS word, unnest(range(1, len(t) + 1)) AS i FROM w
), p AS (
    SELECT e.id, d.alias, d.n, d.entity_id, i - 1 AS pos, coalesce(w.t[i + d.n], '') AS next
    FROM e JOIN d ON word = split_part(d.alias, ' ', 1) JOIN w ON w.id = e.id WHERE array_to_string(w.t[i : i + d.n - 1], ' ') = d.alias
), h AS (
    SELECT * FROM p WHERE NOT (n = 1 AND (next IN {_in(V.CONTRACTION_TAILS)} OR alias IN {_in(V.BLOCKED_WORDS)})) AND alias NOT IN {_in(V.BLOCKED_PHRASES)}
), r AS (SELECT DISTINCT ON (id, entity_id) id, entity_id, alias, CAST(n AS INTEGER) AS n, CAST(pos AS INTEGER) AS pos FROM h ORDER BY id, entity_id, n DESC, pos, alias
)"""

ORACLE_SQL["resolve_all_lengths"] = ALL_LENGTHS + "SELECT * FROM r"

ORACLE_SQL["guarded_all_lengths"] = ALL_LENGTHS + """, c AS (
    SELECT r.*, list_concat(t[greatest(pos - 9, 1) : pos], t[pos + n + 1 : pos + n + 10]) AS near, entity_id % 5 AS brand FROM r JOIN w USING (id)
), g AS (SELECT * FROM c WHERE alias NOT IN (SELECT alias FROM every WHERE item_id % 2 = 0) OR list_has_any(near, ['the', 'of', 'and']))
SELECT id, entity_id, alias, n, pos FROM g
WHERE list_has_any(string_split(alias, ' '), ['brand', CAST(brand AS VARCHAR)])
   OR NOT (list_has_any(near, ['with', 'from'])) OR (brand = 1 AND list_contains(near, 'with')) OR (brand = 2 AND list_contains(near, 'from'))"""

ORACLE_SQL["guarded_resolution"] = f"""WITH {DOCS}, c AS (
    SELECT m.*, list_concat(t[greatest(pos - 9, 1) : pos], t[pos + 4 : pos + 13]) AS near, entity_id % 5 AS brand FROM m JOIN w USING (id)
), g AS (SELECT * FROM c WHERE entity_id % 2 = 1 OR list_has_any(near, ['the', 'of', 'and']))
SELECT id, entity_id, alias, CAST(pos AS INTEGER) AS pos FROM g
WHERE list_has_any(string_split(alias, ' '), ['brand', CAST(brand AS VARCHAR)])
   OR NOT (list_has_any(near, ['with', 'from'])) OR (brand = 1 AND list_contains(near, 'with')) OR (brand = 2 AND list_contains(near, 'from'))"""

ORACLE_SQL["unresolved_candidates"] = f"""WITH {CHAT}, spans AS (SELECT id, list(pos) AS ps FROM m GROUP BY id), g AS (
    SELECT w.id, t, ps, n, unnest(range(0, len(t) - n + 1)) AS pos FROM w LEFT JOIN spans USING (id), (SELECT unnest([2, 3, 4]) AS n) WHERE len(t) >= n
), p AS (
    SELECT DISTINCT id, array_to_string(t[pos + 1 : pos + n], ' ') AS phrase FROM g WHERE len(list_filter(coalesce(ps, []), lambda s: pos < s + 3 AND s < pos + n)) = 0
)
SELECT phrase, count(*) AS occurrences, count(DISTINCT split_part(id, '-', 1)) AS sources FROM p
WHERE split_part(phrase, ' ', 1) NOT IN {STOP} AND NOT regexp_matches(phrase, '^[0-9]') AND len(list_filter(string_split(phrase, ' '), lambda x: x NOT IN {_in(V.GENERIC_PERFUME_WORDS)})) > 0
GROUP BY phrase HAVING count(*) >= 3"""

ORACLE_SQL["multi_field_resolution"] = r"WITH " + WORDS.format(
    id="id", text="f", table="""(SELECT doc_id || '/title' AS id, string_split(text, chr(10))[1] AS f FROM documents UNION ALL SELECT doc_id || '/body', text FROM documents)"""
) + """, s AS (
    SELECT CAST(split_part(id, '/', 1) AS BIGINT) AS item, entity_id,
           CASE WHEN CAST(split_part(id, '/', 1) AS BIGINT) % 2 = 0 THEN CASE split_part(id, '/', 2) WHEN 'title' THEN 1.0 ELSE 0.0 END ELSE CASE split_part(id, '/', 2) WHEN 'body' THEN 1.0 ELSE 0.7 END END::DOUBLE AS weight FROM m
) SELECT item, entity_id, max(weight) AS score FROM s GROUP BY 1, 2 HAVING max(weight) >= 0.3"""

ORACLE_SQL["reresolution_gains"] = f"""WITH {DOCS}
SELECT id, CAST(0 AS INTEGER) AS lost, CAST(count(*) AS INTEGER) AS gained FROM m WHERE entity_id % 3 = 0 GROUP BY id"""

ORACLE_SQL["ingested_and_resolved"] = f"""WITH {DOCS}
SELECT CAST(id AS VARCHAR) AS id, any_value(length(text)) AS n_chars, count(*) AS n_entities, array_to_string(list('Item ' || entity_id ORDER BY pos, entity_id), ', ') AS names
FROM m JOIN documents ON doc_id = id GROUP BY id"""

ORACLE_SQL["evidence_scores"] = "WITH " + DOCS + (r""", a AS (
    SELECT doc_id AS id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM documents
), q AS (
    SELECT m.id, entity_id, a.t, list_filter(string_split(trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS al,
           ['brand'] AS brand, count(*) OVER (PARTITION BY m.id) AS n FROM m JOIN a ON a.id = m.id
), r AS (
    SELECT *, CASE WHEN len(al) = 0 THEN [''] ELSE al END AS a0 FROM q
), place AS (
    SELECT *, coalesce(
        list_filter(range(0, greatest(len(t) - len(a0) + 1, 0)), lambda i: t[i + 1 : i + len(a0)] = a0)[1],
        list_filter(range(0, greatest(len(t) - greatest(len(a0) - 1, 1) + 1, 0)), lambda i: t[i + 1 : i + greatest(len(a0) - 1, 1)] = a0[1 : greatest(len(a0) - 1, 1)])[1],
        list_filter(range(0, greatest(len(t) - greatest(len(a0) - 2, 1) + 1, 0)), lambda i: t[i + 1 : i + greatest(len(a0) - 2, 1)] = a0[1 : greatest(len(a0) - 2, 1)])[1], -1) AS p FROM r
), near AS (
    SELECT *, CASE WHEN p < 0 THEN [] ELSE t[greatest(p - 15, 0) + 1 : p + 16] END AS n15, CASE WHEN p < 0 THEN [] ELSE t[greatest(p - 30, 0) + 1 : p + 31] END AS n30,
        CASE WHEN p < 0 THEN [] ELSE t[greatest(p - 20, 0) + 1 : p + 21] END AS n20, CASE WHEN p < 0 THEN [] ELSE t[greatest(p - 8, 0) + 1 : p + 9] END AS n8 FROM place
), d AS (
    SELECT id, entity_id, CASE WHEN list_has_any(n15, brand) THEN 1.0 WHEN list_has_any(n30, brand) THEN 0.5 ELSE 0.0 END::DOUBLE AS d1,
        least(len(list_filter(n20, lambda x: x IN ('the', 'of', 'and'))) / 5.0, 1.0)::DOUBLE AS d2,
        CASE WHEN contains(array_to_string(n8, ' '), 'is the') OR contains(array_to_string(n8, ' '), 'of the') THEN 0.9
             WHEN len(list_filter(list_distinct(n8), lambda x: x IN ('thing', 'and'))) >= 2 THEN 0.8
             WHEN contains(array_to_string(n20, ' '), 'is the') OR contains(array_to_string(n20, ' '), 'of the') THEN 0.5 ELSE 0.0 END::DOUBLE AS d3,
        CASE WHEN list_has_any(al, brand) THEN 1.0 ELSE 0.0 END::DOUBLE AS d4, CASE WHEN n > 15 THEN 1.0 WHEN n <= 3 THEN 0.1 ELSE 0.1 + 0.9 * (n - 3) / 12.0 END::DOUBLE AS d5, 0.0::DOUBLE AS d6
    FROM near
), s AS (
    SELECT *, 0.35::DOUBLE * d1 + 0.25::DOUBLE * d2 + 0.20::DOUBLE * (1 - d3) + 0.10::DOUBLE * d4 + 0.10::DOUBLE * (1 - d5) + 0.10::DOUBLE * d6 AS raw FROM d
), e AS (SELECT *, round(least(greatest(CASE WHEN d1 = 0 AND d4 = 0 AND d6 = 0 THEN least(raw, 0.45::DOUBLE) ELSE raw END, 0), 1), 4) AS evidence_score FROM s)
SELECT id, entity_id, d1, d2, d3, d4, d5, d6, evidence_score, evidence_score >= 0.5 AS evidence_ok FROM e""")

GRAMS = f"""{TOKENS}, g AS (
    SELECT unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS phrase FROM toks
)"""

ORACLE_SQL["phrase_validity"] = rf"""WITH {GRAMS}, p AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS w FROM g)
SELECT phrase, len(w) >= 2 AND phrase <> 'of the' AND NOT starts_with(phrase, 'in the ') AND w[1] NOT IN {STOP} AND len(list_filter(w, lambda x: NOT regexp_full_match(x, '[0-9]+'))) > 0
    AND len(list_filter(w, lambda x: length(x) > 1)) > 0 AND len(list_filter(w, lambda x: x IN {_in(V.CONTRACTION_SUFFIXES)})) = 0 AS valid FROM p"""

CLASSIFIED = rf"""{GRAMS}, p AS (SELECT phrase, string_split(phrase, ' ') AS w, count(*) AS n FROM g GROUP BY phrase HAVING count(*) >= 3), f AS (
    SELECT *, len(list_filter(w, lambda x: x IN {STOP})) / len(w)::DOUBLE AS ratio, list_filter(w, lambda x: x NOT IN {STOP}) AS content FROM p
), r AS (
    SELECT *, CASE WHEN length(trim(phrase)) <= 1 THEN 'too_short' WHEN list_has_any(w, {_list(V.URL_TOKENS)}) THEN 'url_artifact'
        WHEN regexp_matches(trim(phrase), '^[a-z][a-z0-9]{{4,}}$') AND regexp_matches(trim(phrase), '[^aeiou]{{4}}') THEN 'social_handle'
        WHEN len(w) = 2 AND (w[1] IN {_in(V.CONTRACTION_SUFFIXES)} OR w[2] IN {_in(V.CONTRACTION_SUFFIXES)}) THEN 'contraction_fragment' WHEN len(content) = 0 THEN 'all_stopwords'
        WHEN len(w) = 2 AND phrase IN {_in(C.COMMUNITY_PAIRS)} THEN 'community_fragment'
        WHEN ratio >= 0.75 AND NOT list_has_any(w, {_list(("rose", "amber", *C.CONCENTRATION_WORDS))}) THEN printf('high_stopword_ratio_%.2f', ratio)
        WHEN w[1] IN {_in(C.PRONOUNS)} AND w[-1] IN {STOP} THEN 'sentence_fragment' WHEN regexp_matches(phrase, '^\d[\d\s]*$') THEN 'numeric_artifact'
        WHEN len(content) = 1 AND content[1] IN {_in(V.GENERIC_PERFUME_WORDS)} THEN 'generic_fragrance_word' END AS reason FROM f
), k AS (
    SELECT phrase, n, reason, len(w) AS tokens, list_has_any(w, ['thing', 'shore']) AS brand, list_has_any(w, {_list((*C.CONCENTRATION_WORDS, "rose", "amber"))}) AS perfume,
        len(list_filter(w, lambda x: x NOT IN ('rose', 'amber'))) = 0 AS note FROM r
), c AS (
    SELECT phrase, n, reason, CASE WHEN reason IS NOT NULL THEN 'noise' WHEN note THEN 'note' WHEN brand AND tokens = 1 THEN 'brand' WHEN brand OR perfume THEN 'perfume' ELSE 'unknown' END AS kind,
        CASE WHEN reason IS NOT NULL THEN 'rejected_noise' WHEN brand AND tokens >= 2 THEN 'accepted_rule_based' ELSE 'review' END AS status, CAST(tokens AS INTEGER) AS tokens FROM k
)"""
ORACLE_SQL["candidate_classification"] = f"WITH {CLASSIFIED} SELECT phrase, n, reason, kind, status, tokens FROM c"
ORACLE_SQL["review_summary"] = f"""WITH {CLASSIFIED} SELECT status, coalesce(reason, '-') AS reason, CASE WHEN ln(n + 1) >= 4 THEN 'high' WHEN ln(n + 1) >= 3 THEN 'good' WHEN ln(n + 1) >= 2 THEN 'fair' ELSE 'low' END AS bucket,
    count(*) AS n FROM c GROUP BY 1, 2, 3"""

ORACLE_SQL["query_keywords"] = f"""WITH {TOKENS}, k AS (SELECT conv_id, turn, unnest(list_distinct(list_filter(t, lambda x: x NOT IN {STOP}))) AS x FROM toks),
l AS (SELECT conv_id, turn, list(x ORDER BY length(x) DESC, x)[1 : 4] AS keywords FROM k GROUP BY ALL)
SELECT conv_id, turn, coalesce(keywords, []) AS keywords FROM toks LEFT JOIN l USING (conv_id, turn)"""

ORACLE_SQL["accent_keys"] = r"""WITH a AS (SELECT conv_id, turn, strip_accents(lower(text)) AS plain, regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g') AS ascii FROM conversations)
SELECT *, regexp_replace(regexp_replace(trim(ascii), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM a"""

_MARKED = "list_transform({t}, lambda x: x NOT IN {stops})"
_TRIM = "CASE WHEN len(list_filter({t}, lambda x: x NOT IN {a})) = 0 OR len(list_filter({t}, lambda x: x NOT IN {b})) = 0 THEN '' ELSE array_to_string({t}[list_position(list_transform({t}, lambda x: x NOT IN {a}), true) : len({t}) + 1 - list_position(list_reverse(list_transform({t}, lambda x: x NOT IN {b})), true)], ' ') END"
_FIRST = " ".join(f"WHEN regexp_matches(t, '{p}') THEN trim(regexp_replace(regexp_replace(t, '{p}', '', 'g'), '\\s+', ' ', 'g'))" for _, p in V.CONCENTRATION_PATTERNS)
ORACLE_SQL["candidate_phrases"] = rf"""WITH c AS (
    SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM conversations
), h AS (SELECT conv_id, turn, CASE {_FIRST} ELSE t END AS s FROM c), w AS (SELECT conv_id, turn, s, string_split(s, ' ') AS t FROM h WHERE s <> ''), g AS (
    SELECT conv_id, turn, array_to_string(t[i : i + n - 1], ' ') AS p FROM (SELECT conv_id, turn, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(t) >= n)
    UNION ALL SELECT conv_id, turn, s FROM w
), k AS (
    SELECT DISTINCT conv_id, turn, {_TRIM.format(t="string_split(p, ' ')", a=_in(V.GENERIC_PERFUME_WORDS), b=_in(V.GENERIC_PERFUME_WORDS))} AS phrase
    FROM g WHERE NOT regexp_matches(p, '{"|".join(V.PHRASE_BLACKLIST)}')
), f AS (
    SELECT *, string_split(phrase, ' ') AS w FROM k WHERE length(phrase) >= 2 AND NOT regexp_full_match(phrase, '\d+')
), r AS (
    SELECT *, {_TRIM.format(t="w", a=_in((*V.STOPWORDS, *V.CONTEXT_LEADS)), b=STOP)} AS cut FROM f WHERE len(list_filter(w, lambda x: x NOT IN {_in(V.PHRASE_STOP)})) > 0
) SELECT conv_id, turn, phrase, CASE WHEN length(cut) > 3 THEN cut ELSE phrase END AS form FROM r"""

ORACLE_SQL["default_topic_tags"] = rf"""WITH t AS (
    SELECT doc_id, unnest([{", ".join("CASE WHEN regexp_matches(text, '(?i){}') THEN '{}' END".format(p.replace("'", "''"), x.replace("'", "''")) for p, x in P.TOPIC_RULES)}]) AS topic_text FROM (SELECT doc_id, regexp_replace(text, '[\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{24F}}]', '_', 'g') AS text FROM documents)
) SELECT doc_id, 'topic' AS topic_type, topic_text FROM t WHERE topic_text IS NOT NULL
UNION ALL SELECT doc_id, 'query', lower(trim(lang)) FROM documents WHERE length(trim(lang)) >= 2 UNION ALL SELECT doc_id, 'subreddit', lower(trim(source)) FROM documents WHERE length(trim(source)) >= 2"""

ORACLE_SQL["note_extraction"] = f"""WITH h AS (SELECT doc_id, lower(coalesce(text, '')) AS t, unnest({_list(V.NOTE_TERMS)}) AS note FROM documents), n AS (SELECT doc_id, note FROM h WHERE contains(t, note))
SELECT doc_id, note, CASE WHEN doc_id % 2 = 0 AND note IN ('iris', 'hay') THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence, CASE note WHEN 'oudh' THEN 'oud' WHEN 'agarwood' THEN 'oud' ELSE note END AS canonical,
    CASE WHEN note IN ('rose', 'iris') THEN 'floral' WHEN note IN ('oud', 'oudh', 'agarwood', 'cedar') THEN 'woody' ELSE 'other' END AS family FROM n"""

ORACLE_SQL["normalized_urls"] = r"""WITH u AS (
    SELECT page_id, trim(url) AS t, lower(regexp_extract(trim(url), '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme,
           regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^(www\.|m\.)', '') AS host FROM pages
), p AS (
    SELECT *, regexp_replace(regexp_extract(t, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
        array_to_string(list_filter(string_split(regexp_extract(t, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN
            ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'ref')), '&') AS q FROM u
)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS normal,
    CASE WHEN contains(host, 'youtube.com') OR contains(host, 'youtu.be') THEN 'youtube' WHEN contains(host, 'tiktok.com') THEN 'tiktok' WHEN contains(host, 'instagram.com') THEN 'instagram' WHEN contains(host, 'reddit.com') THEN 'reddit' END AS platform,
    CASE WHEN host = 'youtu.be' THEN 'video' WHEN host <> 'youtube.com' THEN 'other' WHEN regexp_matches(t, '/channel/UC[A-Za-z0-9_-]{22}') THEN 'channel_direct' WHEN contains(t, '/shorts/') THEN 'shorts' WHEN contains(t, '/watch') THEN 'video' ELSE 'other' END AS kind,
    CASE WHEN regexp_matches(t, '/channel/UC[A-Za-z0-9_-]{22}') THEN regexp_extract(t, '/channel/(UC[A-Za-z0-9_-]{22})', 1) END AS channel FROM p"""

ORACLE_SQL["seed_rows"] = """WITH s AS (SELECT p_brand, p_name, min(p_size) AS y FROM part GROUP BY 1, 2)
SELECT sha256(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) || '|' || lower(p_name)) AS fragrance_id, p_brand AS brand_name, p_name AS perfume_name, CAST(y + 1970 AS INTEGER) AS release_year, 'unisex' AS gender, 'import' AS source FROM s"""

ORACLE_SQL["brand_derivation"] = """WITH n AS (SELECT DISTINCT p_brand || ' ' || p_name AS name FROM part), c AS (SELECT p_brand || ' ' || p_name AS name, min(p_brand) AS brand FROM part WHERE p_size < 25 GROUP BY 1),
g AS (SELECT DISTINCT p_brand || ' ' || split_part(p_name, ' ', 1) AS brand FROM part)
SELECT n.name, coalesce(c.brand, g.brand) AS brand, CASE WHEN c.brand IS NOT NULL THEN 'catalog' WHEN g.brand IS NOT NULL THEN 'heuristic' ELSE 'none' END AS via
FROM n LEFT JOIN c USING (name) LEFT JOIN g ON lower(regexp_replace(n.name, '\\s\\S+$', '')) = lower(g.brand)"""

ORACLE_SQL["query_risks"] = """WITH p AS (SELECT p_name AS phrase, count(DISTINCT p_brand) AS channels, avg(p_size) AS score FROM part GROUP BY 1), r AS (
    SELECT *, CASE WHEN list_contains(string_split(phrase, ' '), 'red') THEN 'high' WHEN contains(phrase, 'ring') THEN 'low' WHEN starts_with(phrase, 'old') THEN 'medium'
        WHEN channels >= 3 AND score >= 4 THEN 'low' WHEN channels >= 2 AND score >= 2 THEN 'medium' ELSE 'high' END AS risk FROM p
) SELECT phrase, risk, CASE WHEN risk = 'low' OR (risk = 'medium' AND channels >= 3) THEN 'add_to_experiments' WHEN risk = 'medium' THEN 'review_first' ELSE 'skip' END AS action FROM r"""

ORACLE_SQL["competitor_queries"] = r"""WITH q AS (SELECT p_partkey, p_name AS name, unnest([p_name || ' vs ' || p_brand, p_brand || ' versus nothing', p_brand || ' VS. ' || p_name]) AS t FROM part), x AS (
    SELECT *, trim(regexp_extract(t, '(?i)\bvs\.?\s+(.+)', 1)) AS after, trim(regexp_extract(t, '(?i)^(.+?)\s+vs\.?\b', 1)) AS before FROM q
), c AS (
    SELECT p_partkey, CASE WHEN after <> '' THEN CASE WHEN lower(after) <> lower(name) AND length(after) > 3 THEN after END WHEN before <> '' THEN CASE WHEN lower(before) <> lower(name) AND length(before) > 3 THEN before END
        WHEN NOT contains(lower(t), lower(name)) AND length(t) > 5 THEN t END AS competitor FROM x
) SELECT DISTINCT p_partkey, competitor FROM c WHERE competitor IS NOT NULL"""

ORACLE_SQL["safe_aliases"] = """WITH p AS (SELECT p_name, min(p_partkey) AS entity_id, replace(lower(min(p_brand)), '#', ' ') AS b FROM part GROUP BY 1), a AS (
    SELECT entity_id, unnest([p_name || ' eau de parfum', b || ' ' || p_name || ' eau de parfum', p_name || ' eau de parfum perfume', b || ' ' || p_name, p_name, p_name || ' perfume']) AS alias FROM p
), u AS (SELECT alias, min(entity_id) AS entity_id FROM a GROUP BY alias HAVING count(DISTINCT entity_id) = 1)
SELECT alias, entity_id FROM u WHERE len(string_split(alias, ' ')) BETWEEN 2 AND 8 AND alias NOT IN (SELECT p_name FROM part WHERE p_name < 'm')"""
