"""The SQL that each query must agree with, written for DuckDB over the plain tables."""

from __future__ import annotations

from contract.views import with_views

ORACLE: dict[str, str] = {}

# Written out here and not taken from the engine, so that a slip in one of them shows.
ACCENTED = "àáâãäåāăąçćčďđèéêëēėęěìíîïīįłñńňòóôõöøōőŕřśšşťţùúûüūůűųýÿźžż"
BASE = "aaaaaaaaacccddeeeeeeeeiiiiiilnnnoooooooorrsssttuuuuuuuuyyzzz"
DROPPED = r"[.''’`\"\x{0300}-\x{036F}]"
BLANKED = r"[^\p{L}\p{M}\p{N},*#_&/-]+"
LINE_FORM = r"^(\d+)\s+(@\S+@)?\s*(\S+)\s+(.*)"
DATE_FORM = r"^\s*(ABT\s+)?([1-3]?[0-9]{1}\s+)?((JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\s+)?(\d{3,4})"
EVENT_NAMES = {
    "DEAT": "Death", "CHR": "Christening", "BURI": "Burial", "BIRT": "Birth", "CENS": "Census",
    "MARR": "Marriage", "RESI": "Residence", "IMMI": "Immigration", "EMMI": "Emmigration", "OCCU": "Occupation",
}


def norm(x: str, commas: bool = True) -> str:
    t = f"translate(lower({x}), '{ACCENTED}', '{BASE}')"
    t = f"regexp_replace({t}, '{DROPPED}', '', 'g')"
    t = f"regexp_replace({t}, '{BLANKED}', ' ', 'g')"
    if not commas:
        return f"trim(regexp_replace({t}, '[ ,]+', ' ', 'g'))"
    return f"trim(regexp_replace({t}, ' *, *', ',', 'g'))"


def part(n: int, form: str = LINE_FORM) -> str:
    return f"regexp_extract(concat(raw, chr(10)), '{form}', {n})"


PARSED = f"""parsed AS (
SELECT file, rec, pos, raw, CASE WHEN {part(1)} = '' THEN 99 ELSE CAST({part(1)} AS INT) END AS level,
  CASE WHEN {part(1)} = '' THEN '' ELSE nullif({part(2)}, '') END AS label, {part(3)} AS tag,
  regexp_replace({part(4)}, '\\\\+$', '') AS value
FROM {{lines}})"""


def parsed(lines: str = "gedcom_lines", *views: str) -> str:
    return with_views(lines, *views) + ",\n" + PARSED.format(lines=lines)


_EVENT = "CASE tag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_NAMES.items()) + " END"
_RUN = "OVER (PARTITION BY file, rec ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_LAST = lambda x: f"coalesce(last_value(({x}) IGNORE NULLS) {_RUN}, '')"
_OWNER = "tag IN ('INDI', 'FAM') AND label IS NOT NULL"
_RECORD = f"CASE WHEN level = 0 THEN CASE WHEN {_OWNER} THEN label ELSE ' ' END END"
CONTEXT = f"""ctx AS (
SELECT *, {_LAST(_RECORD)} AS record_id,
  {_LAST(f"CASE WHEN level = 0 THEN CASE WHEN {_OWNER} THEN label ELSE '' END WHEN level = 1 AND tag IN ('NAME', 'HUSB') THEN value END")} AS person,
  {_LAST(f"CASE WHEN level = 0 THEN CASE WHEN {_OWNER} THEN tag ELSE '' END WHEN level = 1 AND {_EVENT} IS NOT NULL THEN {_EVENT} WHEN level IN (1, 2) AND tag = 'TYPE' THEN value WHEN level = 1 AND tag NOT IN ('DATE', 'PLAC') THEN tag END")} AS event_name,
  {_LAST("CASE WHEN level IN (0, 1) THEN '' WHEN level = 2 AND tag = 'DATE' THEN value END")} AS date
FROM parsed),
dated AS (
SELECT *, coalesce(TRY_CAST(regexp_extract(date, '{DATE_FORM}', 5) AS INT), 0) AS event_year, regexp_extract(date, '{DATE_FORM}', 1) <> '' AS about
FROM ctx)"""


def contexts() -> str:
    return parsed() + ",\n" + CONTEXT


ORACLE["gedcom_parse"] = parsed("rough_lines") + " SELECT rec, pos, level, label, tag, value FROM parsed"
ORACLE["gedcom_events"] = contexts() + """
SELECT rec, pos, record_id, person, event_name, date, event_year, about, value AS place_text FROM dated WHERE tag = 'PLAC'"""
ORACLE["place_count"] = parsed() + " SELECT file, count(*) AS places FROM parsed WHERE tag = 'PLAC' GROUP BY file"
ORACLE["events_by_century"] = contexts() + """
SELECT file, event_name, CAST(CASE WHEN event_year > 0 THEN (event_year + 99) // 100 ELSE 0 END AS INT) AS century,
  count(*) AS places, count(*) FILTER (WHERE about) AS about
FROM dated WHERE tag = 'PLAC' GROUP BY ALL"""

NAMES = """names AS (
SELECT file, record_id AS id, arg_max(value, (rec, pos)) AS name FROM dated
WHERE tag IN ('NAME', 'HUSB') AND trim(record_id) <> '' AND record_id <> value GROUP BY file, record_id)"""
POINTED = """chain AS (
SELECT file, id, name, 0 AS step FROM names
UNION ALL
SELECT c.file, c.id, n.name, c.step + 1 FROM chain c JOIN names n ON n.file = c.file AND n.id = c.name
WHERE c.name LIKE '@%' AND c.step < 4),
pointed AS (
SELECT file, id, name FROM (SELECT *, row_number() OVER (PARTITION BY file, id ORDER BY step DESC) AS rn FROM chain) AS x
WHERE rn = 1)"""
ORACLE["person_names"] = contexts() + ",\n" + NAMES + " SELECT file, id, name FROM names"
ORACLE["person_pointer_names"] = contexts() + ",\n" + NAMES + ",\n" + POINTED + " SELECT file, id, replace(name, '/', '') AS person FROM pointed"
ORACLE["place_people"] = contexts() + ",\n" + NAMES + ",\n" + POINTED + """
SELECT rec, pos, replace(coalesce(name, person), '/', '') AS person
FROM dated LEFT JOIN pointed ON pointed.file = dated.file AND pointed.id = dated.record_id WHERE tag = 'PLAC'"""

BLOCKS = """tags AS (
SELECT *, lag(tag, 1) OVER w AS p1, lag(tag, 2) OVER w AS p2, lag(tag, 3) OVER w AS p3,
  lag(pos, 1) OVER w AS q1, lag(pos, 2) OVER w AS q2, lag(pos, 3) OVER w AS q3
FROM parsed WINDOW w AS (PARTITION BY file, rec ORDER BY pos)),
blocks AS (
SELECT *, CASE WHEN tag = 'MAP' AND p1 = 'PLAC' THEN q1
  WHEN tag IN ('LATI', 'LONG') AND p1 = 'MAP' AND p2 = 'PLAC' THEN q2
  WHEN tag IN ('LATI', 'LONG') AND p1 IN ('LATI', 'LONG') AND p2 = 'MAP' AND p3 = 'PLAC' THEN q3 END AS owner
FROM tags)"""
ORACLE["map_block_rewrite"] = parsed() + ",\n" + BLOCKS + """
SELECT rec, pos, tag FROM blocks WHERE owner IS NOT NULL"""
ORACLE["gedcom_rewrite"] = parsed() + ",\n" + BLOCKS + """,
edits AS (
SELECT rec, pos, level, tag, CASE pos // 10 % 4 WHEN 0 THEN 'UPDATE' ELSE 'DELETE' END AS action, upper(value) AS text,
  CASE WHEN rec % 7 <> 0 THEN rec % 90 + 0.25 END AS lat, -(rec % 180) - 0.5 AS lon
FROM parsed WHERE tag = 'PLAC' AND pos // 10 % 4 IN (0, 1)),
changed AS (SELECT rec, pos FROM edits WHERE action = 'DELETE' OR lat IS NOT NULL)
SELECT b.rec, b.pos, 0 AS sub, CASE WHEN tag = 'PLAC' THEN concat_ws(' ', level, label, tag, value) ELSE raw END AS text FROM blocks b
WHERE NOT EXISTS (SELECT 1 FROM edits e WHERE e.rec = b.rec AND e.pos = b.pos)
  AND NOT EXISTS (SELECT 1 FROM changed e WHERE e.rec = b.rec AND e.pos = b.owner)
UNION ALL SELECT rec, pos, 0, concat_ws(' ', level, tag, trim(text, ', ')) FROM edits WHERE action = 'UPDATE'
UNION ALL SELECT rec, pos, 1, concat(level + 1, ' MAP') FROM edits WHERE action = 'UPDATE' AND lat IS NOT NULL
UNION ALL SELECT rec, pos, 2, concat(level + 2, ' LATI ', CAST(lat AS DOUBLE)) FROM edits WHERE action = 'UPDATE' AND lat IS NOT NULL
UNION ALL SELECT rec, pos, 3, concat(level + 2, ' LONG ', CAST(lon AS DOUBLE)) FROM edits WHERE action = 'UPDATE' AND lat IS NOT NULL"""
ORACLE["gedcom_roundtrip"] = with_views("gedcom_lines") + " SELECT rec, pos, raw AS text FROM gedcom_lines"

# --- lookup tables ---------------------------------------------------------------------------------------------------

ORACLE["replacement_build"] = with_views("decisions") + " SELECT seq, concat('@', geoid, '@', prefix) AS val FROM decisions"
_GEOID = "CASE WHEN len(string_split(val, '@')) < 2 THEN '' ELSE string_split(val, '@')[2] END"
_PREFIX = "CASE WHEN len(string_split(val, '@')) < 3 THEN '' ELSE string_split(val, '@')[3] END"
ORACLE["replacement_parse"] = with_views("repl") + f" SELECT key, {_PREFIX} AS prefix, {_GEOID} AS geoid FROM repl"

KEYED = f"""keyed AS (SELECT *, {norm('place_text')} AS key FROM raw_places),
keys AS (SELECT key, count(*) AS n, min(seq) AS first_seq, arg_min(event_year, seq) AS first_event_year, arg_min(place_text, seq) AS first_text
         FROM keyed GROUP BY key)"""
REPL = f"""rp AS (SELECT {norm('key')} AS key, {_PREFIX} AS prefix, {_GEOID} AS geoid FROM repl),
rpl AS (SELECT rp.key, rp.prefix, rp.geoid, g.geoid IS NOT NULL AS found, g.name, g.tier, g.country, g.admin1, g.admin2,
          CASE WHEN rp.geoid = '' THEN 'DELETE' WHEN g.geoid IS NOT NULL THEN 'STRONG_MATCH' ELSE 'ERROR' END AS repl_result
        FROM rp LEFT JOIN gaz g ON g.geoid = rp.geoid),
sk AS (SELECT DISTINCT {norm('key')} AS key FROM skips)"""


def keyed(*views: str) -> str:
    return with_views("raw_places", *views) + ",\n" + KEYED


ORACLE["replacement_apply"] = keyed("repl", "gaz", "skips") + ",\n" + REPL + """
SELECT key, n, repl_result, geoid AS repl_geoid, prefix AS repl_prefix, name AS repl_name FROM keys JOIN rpl USING (key)"""
ORACLE["skip_split"] = keyed("repl", "gaz", "skips") + ",\n" + REPL + """
SELECT key, n, key IN (SELECT key FROM sk) AND key NOT IN (SELECT key FROM rpl) AS skipped FROM keys"""
_PLANTED = "concat('constanta,timisoara,ha noi,angstrom αθηνα е и,\u1100\u1161\u11a8 \u1109\u1165\u110b\u116e\u11af \u304b\u3099 \u09a1\u09bc ', doc_id)"
ORACLE["normalize_text"] = f"""
SELECT doc_id, {norm('text')} AS normalized, {norm('text', False)} AS no_commas, {_PLANTED} AS composed, {_PLANTED} AS decomposed FROM documents"""
ORACLE["dict_rekey"] = with_views("repl") + f"""
SELECT {norm('key')} AS key, concat(arg_max(val, seq), '1') AS val FROM (
SELECT 0 AS seq, upper(key) AS key, val FROM repl UNION ALL SELECT 1, concat(' ', key, '. '), val FROM repl) AS x GROUP BY 1"""
ORACLE["dict_upsert"] = with_views("decisions") + f""",
base AS (SELECT DISTINCT lower(key) AS key FROM decisions),
evts AS (SELECT -1 AS seq, key, 'save' AS op, 'BASE' AS geoid, 'base' AS prefix FROM base
         UNION ALL SELECT seq, {norm('key')}, op, CASE op WHEN 'delete' THEN '' ELSE geoid END, CASE op WHEN 'delete' THEN '' ELSE prefix END
         FROM decisions WHERE op IN ('save', 'delete', 'prefix'))
SELECT 'replace' AS list, key, concat('@', arg_max(geoid, seq) FILTER (WHERE op <> 'prefix'), '@', arg_max(prefix, seq)) AS val
FROM evts GROUP BY key HAVING count(*) FILTER (WHERE op <> 'prefix') > 0
UNION ALL SELECT DISTINCT 'skip', {norm('key')}, ' ' FROM decisions WHERE op = 'skip'"""
_CODE = "left(n_name, 2)"
ORACLE["table_upsert"] = with_views("decisions", "gaz") + f""",
base AS (SELECT DISTINCT lower(key) AS key FROM decisions),
evts AS (SELECT -1 AS seq, key, 'save' AS op, 'BASE' AS geoid, 'base' AS prefix FROM base
         UNION ALL SELECT seq, {norm('key')}, op, CASE op WHEN 'delete' THEN '' ELSE geoid END, CASE op WHEN 'delete' THEN '' ELSE prefix END
         FROM decisions WHERE op IN ('save', 'delete', 'prefix')),
changes AS (
SELECT 'replacements' AS list, 1 AS seq, key, concat('@', arg_max(geoid, seq) FILTER (WHERE op <> 'prefix'), '@', arg_max(prefix, seq)) AS val
FROM evts GROUP BY key HAVING count(*) FILTER (WHERE op <> 'prefix') > 0
UNION ALL SELECT 'skips', 1, {norm('key')}, ' ' FROM decisions WHERE op = 'skip'
UNION ALL SELECT 'features', 0, upper(feature), '' FROM gaz
UNION ALL SELECT 'features', 1 + n_nationkey, upper(trim({_CODE})), CASE WHEN n_nationkey % 3 > 0 THEN '' END FROM nation
UNION ALL SELECT 'features', 1, 'ADM2', NULL
UNION ALL SELECT 'languages', 0, lower(lang), '' FROM documents
UNION ALL SELECT 'languages', 1, lower(source), '' FROM documents
UNION ALL SELECT 'languages', 2, lower({_CODE}), '' FROM nation
UNION ALL SELECT 'languages', 3, 'en', NULL
UNION ALL SELECT 'rules', 0, n_name, 'x' FROM nation
UNION ALL SELECT 'rules', 1 + n_nationkey, concat('New ', {_CODE}), concat('N', n_nationkey) FROM nation
UNION ALL SELECT 'countries', 0, lower(n_name), ' ' FROM nation
UNION ALL SELECT 'countries', 1 + n_nationkey, lower({_CODE}), lower(n_name) FROM nation)
SELECT list, key, val FROM (SELECT * FROM changes WHERE list <> 'languages' OR length(key) = 2 QUALIFY row_number() OVER (PARTITION BY list, key ORDER BY seq DESC) = 1) AS x WHERE val IS NOT NULL"""
ORACLE["dict_delete"] = with_views("repl") + " SELECT key, val FROM repl WHERE val <> '@@'"

_LONG = lambda t="": f"""concat_ws(', ', CASE WHEN {t}tier >= 3 THEN {t}name END, nullif({t}admin2, ''), nullif({t}admin1, ''), {t}country)"""
ORACLE["replacement_listing"] = with_views("repl", "gaz", "skips") + ",\n" + REPL + f"""
SELECT key, concat(CASE WHEN prefix <> '' THEN concat('[', prefix, '],') ELSE '' END,
  CASE WHEN found THEN {_LONG()} ELSE concat('Database error for GeoID ', geoid) END) AS line FROM rpl WHERE geoid <> ''"""

# --- gazetteer -------------------------------------------------------------------------------------------------------

ORACLE["gaz_filter"] = with_views("gaz", "countries") + """
SELECT geoid, lower(country) AS country_iso, feature FROM gaz
WHERE country IN (SELECT name FROM countries WHERE supported) AND feature IN ('PPL', 'ADM2', 'ADM1', 'ADM0')"""
ORACLE["feature_defaults"] = with_views("gaz") + """
SELECT lower(country) AS country_iso, feature, count(*) AS places FROM gaz GROUP BY ALL"""
ORACLE["language_filter"] = f"""SELECT CAST(doc_id AS VARCHAR) AS geoid, {norm('source')} AS alt_norm FROM documents WHERE lang IN ('fr', 'de')"""
ORACLE["admin_names"] = with_views("gaz") + """
SELECT geoid, country AS country_name, CASE WHEN tier >= 1 THEN admin1 END AS admin1_name, CASE WHEN tier >= 2 THEN admin2 END AS admin2_name FROM gaz"""
ORACLE["admin2_fill"] = with_views("matched_places", "gaz") + """
SELECT seq, coalesce(g.admin2, CASE WHEN m.admin2_name <> '' THEN ' ' ELSE '' END) AS admin2_id, coalesce(g.admin2, m.admin2_name) AS admin2_name
FROM matched_places m LEFT JOIN gaz g ON g.tier = 3 AND lower(g.name) = m.city AND g.admin1 = m.admin1_id AND lower(g.country) = m.country_iso"""

# --- matching --------------------------------------------------------------------------------------------------------

_P = lambda k: f"CASE WHEN len(p) >= {k} THEN trim(p[len(p) - {k - 1}]) ELSE '' END"
LOCATED = f"""split_places AS (SELECT *, string_split(place_text, ',') AS p FROM keyed),
named AS (SELECT *, {_P(1)} AS country, {_P(2)} AS admin1, {_P(3)} AS admin2, {_P(4)} AS city,
            CASE WHEN len(p) > 4 THEN array_to_string(list_transform(p[1:len(p) - 4], lambda x: trim(x)), ',') ELSE '' END AS prefix FROM split_places),
tiered AS (SELECT *, CASE WHEN city <> '' THEN 3 WHEN admin2 <> '' THEN 2 WHEN admin1 <> '' THEN 1 ELSE 0 END AS m_tier FROM named),
normed AS (SELECT *, {norm('country')} AS n_country, {norm('admin1')} AS n_admin1, {norm('admin2')} AS n_admin2,
             CASE m_tier WHEN 3 THEN {norm('city')} WHEN 2 THEN {norm('admin2')} WHEN 1 THEN {norm('admin1')} ELSE {norm('country')} END AS m_name FROM tiered),
located AS (SELECT *, concat_ws('|', m_tier, n_country, n_admin1, n_admin2, m_name) AS loc FROM normed),
locs AS (SELECT DISTINCT loc, m_tier, n_country, n_admin1, n_admin2, m_name FROM located),
g AS (SELECT *, {norm('country')} AS n_country, {norm('admin1')} AS n_admin1, {norm('admin2')} AS n_admin2, {norm('name')} AS m_name FROM gaz),
pairs AS (SELECT l.loc, g.geoid, g.lat, g.lon, g.country, g.admin1, g.admin2, g.name, g.tier, g.tier = l.m_tier AND l.n_admin2 = g.n_admin2 AS full_match
          FROM locs l JOIN g ON g.n_country = l.n_country AND g.n_admin1 = l.n_admin1 AND g.m_name = l.m_name
          WHERE g.tier = l.m_tier AND l.n_admin2 = g.n_admin2 OR l.m_tier >= 2 AND g.tier = 3),
kept AS (SELECT *, bool_or(full_match) OVER (PARTITION BY loc) AS any_full FROM pairs),
cands AS (SELECT *, row_number() OVER (PARTITION BY loc ORDER BY geoid) AS rk, count(*) OVER (PARTITION BY loc) AS nc,
            CAST(CASE WHEN any_full THEN 0 ELSE 5 END AS DOUBLE) AS score FROM kept WHERE full_match = any_full)"""


def located(*views: str) -> str:
    return keyed("gaz", *views) + ",\n" + LOCATED


ORACLE["first_resolution"] = keyed() + " SELECT key, n, first_seq, first_event_year FROM keys"
_SUPPORT = f"""CASE WHEN n_country NOT IN (SELECT {norm('name')} FROM countries) THEN 'NO_COUNTRY'
  WHEN n_country NOT IN (SELECT {norm('name')} FROM countries WHERE supported) THEN 'NOT_SUPPORTED' END"""
ORACLE["country_support"] = located("countries") + f" SELECT loc, {_SUPPORT} AS support FROM locs"
ORACLE["exact_match"] = located() + """
SELECT loc, CASE WHEN nc = 1 THEN 'STRONG_MATCH' ELSE 'MULTIPLE_MATCHES' END AS result, CAST(nc AS BIGINT) AS candidates, geoid, score
FROM cands WHERE rk = 1"""
ORACLE["best_match"] = located() + " SELECT seq, geoid, lat, lon FROM located JOIN cands USING (loc) WHERE rk = 1"
ORACLE["validity_flag"] = located("validity") + """
SELECT seq, geoid, CASE WHEN event_year = 0 OR v.first_year IS NULL OR event_year >= v.first_year THEN '' ELSE 'VERIFY DATE' END AS flag
FROM located JOIN cands c USING (loc) LEFT JOIN validity v ON v.country_iso = lower(c.country) AND v.admin1_id = c.admin1 WHERE rk = 1"""

HOMONYMS = f"""ranked AS (
SELECT concat('3|everywhere|||', {norm('name')}) AS loc, geoid, row_number() OVER (PARTITION BY name ORDER BY geoid) AS rank FROM part_gaz)"""
ORACLE["candidate_rank"] = with_views("part_gaz") + ",\n" + HOMONYMS + """
SELECT loc, CAST(rank AS INT) AS rank, geoid, CAST(0 AS DOUBLE) AS score FROM ranked"""
ORACLE["asof_match"] = with_views("part_gaz", "raw_places") + f""",
named AS (SELECT {norm('name')} AS m_name, geoid, CASE WHEN CAST(substr(geoid, 2) AS BIGINT) % 11 = 0 THEN NULL ELSE CAST(1993 + CAST(substr(geoid, 2) AS BIGINT) * 7 % 9 AS INT) END AS first_year FROM part_gaz),
years AS (SELECT DISTINCT event_year AS year FROM raw_places UNION SELECT 0),
ranked AS (SELECT concat_ws('|', m_name, year) AS loc, geoid, first_year, count(*) OVER (PARTITION BY m_name, year) AS n,
  row_number() OVER (PARTITION BY m_name, year ORDER BY NOT (year = 0 OR first_year IS NULL OR first_year <= year), geoid) AS rk FROM named, years)
SELECT loc, n, geoid, first_year FROM ranked WHERE rk = 1"""
ORACLE["multiple_match"] = with_views("part_gaz") + ",\n" + HOMONYMS + """
SELECT loc, CASE WHEN count(*) = 1 THEN 'STRONG_MATCH' ELSE 'MULTIPLE_MATCHES' END AS result, count(*) AS candidates
FROM ranked GROUP BY loc"""

_TOP = lambda pairs: f"""SELECT loc, CAST(rk AS INT) AS rank, geoid, score FROM (
SELECT *, row_number() OVER (PARTITION BY loc ORDER BY score, geoid) AS rk FROM ({pairs}) AS x) AS y"""  # noqa: E731
_LIKE = lambda part: f"g.{part} LIKE replace(replace(l.{part}, '_', '\\_'), '*', '%') ESCAPE '\\'"
_WILD = f"""
SELECT l.loc, g.geoid, CAST(CASE WHEN {_LIKE('n_admin2')} THEN 20 ELSE 25 END AS DOUBLE) AS score
FROM locs l JOIN g ON g.tier = l.m_tier AND {_LIKE('n_country')} AND {_LIKE('n_admin1')} AND {_LIKE('m_name')}
WHERE contains(concat(l.m_name, l.n_admin1, l.n_country), '*')"""
ORACLE["wildcard_match"] = located() + "\n" + _TOP(_WILD)
ORACLE["wildcard_parts"] = with_views("gaz", "wild_texts") + f""",
t AS (SELECT string_split({norm('place_text')}, ',') AS p FROM wild_texts),
parts AS (SELECT DISTINCT p[-1] AS n_country, coalesce(p[-2], '') AS n_admin1, coalesce(p[-3], '') AS n_admin2, coalesce(p[-4], '') AS n_city, len(p) - 1 AS m_tier FROM t),
locs AS (SELECT *, concat_ws('|', m_tier, n_country, n_admin1, n_admin2, m_name) AS loc FROM (
  SELECT *, CASE m_tier WHEN 3 THEN n_city WHEN 2 THEN n_admin2 WHEN 1 THEN n_admin1 ELSE n_country END AS m_name FROM parts) AS x),
g AS (SELECT *, {norm('country')} AS n_country, {norm('admin1')} AS n_admin1, {norm('admin2')} AS n_admin2, {norm('name')} AS m_name FROM gaz)
""" + _TOP(_WILD)
_LOC3 = "concat('3|', lower(country), '|||', name)"
ORACLE["word_match"] = with_views("misspelt", "part_gaz") + f""",
entries AS (SELECT DISTINCT country, name, {_LOC3} AS loc, string_split(name, ' ') AS ws FROM (
  SELECT country, concat(w2, ' ', w1) AS name FROM misspelt UNION ALL SELECT country, w1 FROM misspelt) AS e)
""" + _TOP("""
SELECT e.loc, p.geoid, CAST(30 + len(list_distinct(string_split(p.name, ' '))) - len(list_distinct(e.ws)) AS DOUBLE) AS score
FROM entries e JOIN part_gaz p ON p.country = e.country WHERE list_has_all(string_split(p.name, ' '), e.ws)""")
ORACLE["partial_match"] = with_views("misspelt", "part_gaz") + f""",
entries AS (SELECT DISTINCT country, name, {_LOC3} AS loc, string_split(name, ' ') AS ws FROM (
  SELECT country, concat('old ', w2, ' near ', w1) AS name FROM misspelt) AS e)
""" + _TOP("""
SELECT e.loc, p.geoid, CAST(35 + len(list_distinct(e.ws)) - len(list_distinct(string_split(p.name, ' '))) AS DOUBLE) AS score
FROM entries e JOIN part_gaz p ON p.country = e.country WHERE list_has_all(e.ws, string_split(p.name, ' '))""")

# Soundex of lower-case ASCII words: letters to digits, h and w skipped, vowels part equal digits, first letter kept.
_SOUND = lambda w: f"""(SELECT rpad(upper(left({w}, 1)) || left(string_agg(CASE WHEN i > 1 AND c <> '0' AND c <> p THEN c ELSE '' END, '' ORDER BY i), 3), 4, '0')
FROM (SELECT i, c, lag(c) OVER (ORDER BY i) AS p FROM (
SELECT i, translate(substr({w}, i, 1), 'aeiouybfpvcgjkqsxzdtlmnr', '000000111122222222334556') AS c
FROM unnest(range(1, length({w}) + 1)) AS r(i) WHERE i = 1 OR substr({w}, i, 1) NOT IN ('h', 'w')) AS a) AS b)"""  # noqa: E731
ORACLE["soundex_match"] = with_views("misspelt", "part_gaz") + f""",
entries AS (SELECT country, m1 AS name FROM misspelt UNION SELECT country, m2 FROM misspelt),
sounded AS (SELECT *, {_SOUND('name')} AS sound, {_LOC3} AS loc FROM entries),
firsts AS (SELECT geoid, country, split_part(name, ' ', 1) AS name FROM part_gaz UNION ALL SELECT geoid, country, split_part(name, ' ', 2) FROM part_gaz),
word_sounds AS (SELECT name, {_SOUND('name')} AS sound FROM (SELECT DISTINCT name FROM firsts) AS f),
gs AS (SELECT geoid, country, name, sound FROM firsts JOIN word_sounds USING (name))
""" + _TOP("""
SELECT s.loc, gs.geoid, min(CAST(40 + 10 * levenshtein(gs.name, s.name) AS DOUBLE)) AS score
FROM sounded s JOIN gs ON gs.country = s.country AND gs.sound = s.sound GROUP BY s.loc, gs.geoid""")

# --- settling --------------------------------------------------------------------------------------------------------

def _capwords(x: str) -> str:
    """Title case by runs of letters; a run after an apostrophe inside a word stays lower case."""
    title = "concat(replace(upper(left(t, 1)), 'ẞ', 'Ss'), lower(substr(t, 2)))"
    low = (r"i > 2 AND toks[i - 1] = chr(39) AND regexp_matches(toks[i - 2], '\p{L}[A-Za-z]$') "
           "AND regexp_matches(t, '^[A-Za-z]')")
    return (f"(SELECT array_to_string(list_transform(toks, lambda t, i: CASE WHEN {low} THEN lower(t) ELSE {title} END), '') "
            rf"FROM (SELECT regexp_extract_all({x}, '\p{{L}}+|\P{{L}}+') AS toks) AS cw)")


SETTLED = f"""key_locs AS (SELECT l.key, l.loc, l.prefix, l.n_country FROM located l JOIN keys k ON k.key = l.key AND k.first_seq = l.seq),
best AS (SELECT * FROM cands WHERE rk = 1),
wild_pairs AS ({_WILD} AND l.loc NOT IN (SELECT loc FROM cands)),
wild AS (SELECT loc, count(*) AS nc FROM wild_pairs GROUP BY loc),
status AS (
SELECT k.key, k.n, rpl.repl_result, k.key IN (SELECT key FROM sk) AND rpl.key IS NULL AS skipped, rpl.prefix AS repl_prefix,
  coalesce(CASE WHEN {_SUPPORT} IS NULL THEN CASE WHEN b.nc = 1 THEN 'STRONG_MATCH' WHEN b.nc > 1 THEN 'MULTIPLE_MATCHES' END END, {_SUPPORT}, CASE WHEN w.nc > 0 THEN 'WILDCARD_MATCH' END, 'NO_MATCH') AS found,
  l.prefix, {_LONG('rpl.')} AS repl_long, {_LONG('b.')} AS long,
  CASE WHEN {_SUPPORT} IS NULL AND rpl.repl_result IS NULL AND k.key <> '' AND k.key NOT IN (SELECT key FROM sk) THEN coalesce(b.nc, w.nc, 0) ELSE 0 END AS nc, b.nc AS exact, w.nc AS wilds
FROM keys k JOIN key_locs l USING (key) LEFT JOIN rpl ON rpl.key = k.key LEFT JOIN best b ON b.loc = l.loc LEFT JOIN wild w ON w.loc = l.loc),
decided AS (
SELECT *, CASE repl_result WHEN 'STRONG_MATCH' THEN 'REPLACE' WHEN 'DELETE' THEN 'DELETE' WHEN 'ERROR' THEN 'ERROR'
    ELSE CASE WHEN skipped THEN 'ASIS_SKIP' WHEN found = 'STRONG_MATCH' AND key <> '' THEN 'UPDATE' ELSE 'ASIS_REVIEW' END END AS disposition,
  CASE WHEN repl_result IS NOT NULL THEN repl_result WHEN key = '' THEN 'DELETE' WHEN skipped THEN NULL ELSE found END AS result FROM status),
texts AS (
SELECT *, CASE disposition WHEN 'REPLACE' THEN trim(concat(CASE WHEN repl_prefix <> '' THEN concat({_capwords('repl_prefix')}, ',') ELSE '' END, repl_long), ', ')
  WHEN 'UPDATE' THEN trim(concat(CASE WHEN prefix <> '' THEN concat({_capwords('prefix')}, ',') ELSE '' END, long), ', ') END AS text
FROM decided)"""


def settled() -> str:
    return located("repl", "skips", "countries") + ",\n" + REPL + ",\n" + SETTLED


ORACLE["place_disposition"] = settled() + " SELECT seq, disposition, result, text FROM keyed JOIN texts USING (key)"
ORACLE["run_stats"] = settled() + """,
done AS (SELECT file, count(*) AS total, count(*) FILTER (WHERE disposition IN ('REPLACE', 'DELETE', 'UPDATE')) AS matched,
  count(*) FILTER (WHERE disposition = 'ASIS_SKIP') AS skipped, count(*) FILTER (WHERE disposition IN ('ERROR', 'ASIS_REVIEW')) AS review
  FROM keyed JOIN texts USING (key) GROUP BY file)
SELECT file, matched, skipped, review, total - matched - skipped - review AS remaining, total,
  CAST(100.0 * (matched + skipped + review) / total AS DOUBLE) AS percent_done FROM done"""
ORACLE["diagnostics"] = settled() + f""",
capped AS (SELECT key, {_capwords('key')} AS input_text, CASE disposition WHEN 'DELETE' THEN 'DELETE' ELSE text END AS output_text FROM texts
           WHERE disposition IN ('REPLACE', 'UPDATE', 'DELETE'))
SELECT input_text, output_text FROM keyed JOIN capped USING (key)"""
ORACLE["miss_log"] = settled() + " SELECT key, n AS occurrences FROM texts WHERE disposition IN ('ERROR', 'ASIS_REVIEW')"
ORACLE["review_queue"] = settled() + """
SELECT key, n AS occurrences, result,
  CASE WHEN nc > 1 OR result IN ('MULTIPLE_MATCHES', 'NO_MATCH', 'NO_COUNTRY') THEN 'verify' WHEN result = 'NOT_SUPPORTED' THEN 'skip' ELSE 'save' END AS action,
  CASE WHEN nc > 1 OR result IN ('MULTIPLE_MATCHES', 'NO_MATCH', 'NO_COUNTRY') THEN false WHEN result = 'NOT_SUPPORTED' THEN NULL ELSE true END AS save_allowed,
  CAST(nc AS BIGINT) AS candidates
FROM texts WHERE disposition IN ('ERROR', 'ASIS_REVIEW')"""
ORACLE["review_listing"] = settled() + """,
listed AS (SELECT t.key, p.geoid, p.score FROM texts t JOIN key_locs l USING (key) JOIN (
    SELECT loc, geoid, score FROM cands UNION ALL SELECT loc, geoid, score FROM wild_pairs) AS p ON p.loc = l.loc
  WHERE t.disposition IN ('ERROR', 'ASIS_REVIEW') AND t.nc > 0)
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY score, geoid) AS INT) AS rank, geoid, score FROM listed
UNION ALL SELECT key, 1, '', CAST(9999 AS DOUBLE) FROM texts WHERE disposition IN ('ERROR', 'ASIS_REVIEW') AND nc = 0"""
ORACLE["resolve_stage"] = settled() + """
SELECT key, result, CASE WHEN nc > 0 THEN CASE WHEN exact > 0 THEN 'EXACT' ELSE 'WILDCARD' END END AS stage, CAST(nc AS BIGINT) AS candidates FROM texts"""
ORACLE["city_without_county"] = with_views("gaz") + f""",
g AS (SELECT *, {norm('country')} AS n_country, {norm('admin1')} AS n_admin1, {norm('name')} AS m_name FROM gaz),
asked AS (SELECT DISTINCT n_country, n_admin1, m_name FROM g WHERE tier = 3),
hits AS (SELECT a.*, h.geoid FROM asked a JOIN g h ON h.tier = 3 AND h.n_country = a.n_country AND h.n_admin1 = a.n_admin1 AND h.m_name = a.m_name)
SELECT concat_ws('|', '2', n_country, n_admin1, m_name, m_name) AS loc, count(*) AS candidates, min(geoid) AS geoid, CAST(5 AS DOUBLE) AS score
FROM hits GROUP BY n_country, n_admin1, m_name"""

# --- spelling --------------------------------------------------------------------------------------------------------

VOCAB = """vocab AS (SELECT word, count(*) AS freq FROM (SELECT unnest(string_split(name, ' ')) AS word FROM {names}
  WHERE NOT contains(name, 'gothland cemetery') AND name NOT IN ('died', 'buried', 'executed', 'fatally', 'wounded')) AS w
  WHERE length(word) > 2 AND word <> 'gothland' GROUP BY word)"""
ORACLE["spell_vocab"] = "WITH docs AS (SELECT lower(text) AS name FROM documents), " + VOCAB.format(names="docs") + " SELECT word, freq FROM vocab"
ORACLE["spell_eligible"] = """WITH terms AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS term FROM conversations),
t AS (SELECT term, NOT contains(term, '*') AND length(term) > 1 AS looked_up FROM terms)
SELECT term, looked_up, looked_up AND NOT regexp_matches(term, '\\d') AND NOT contains(term, 'st ') AS corrected FROM t"""
_NEAR = """near AS (
SELECT term, word, freq, CAST(damerau_levenshtein(term, word) AS INT) AS distance FROM (SELECT DISTINCT term FROM terms) AS t JOIN vocab ON abs(length(term) - length(word)) <= 2
WHERE damerau_levenshtein(term, word) <= 2 AND length(term) > 1),
closest AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY distance, freq DESC, word) AS rk, min(distance) OVER (PARTITION BY term) AS least FROM near)"""
ORACLE["spell_suggest"] = with_views("misspelt", "part_gaz") + ",\n" + VOCAB.format(names="part_gaz") + """,
terms AS (SELECT unnest([m1, m2, w1, reverse(w2)]) AS term FROM misspelt),
""" + _NEAR + """,
picked AS (SELECT term, coalesce(string_agg(CASE WHEN left(word, 1) = left(term, 1) THEN word END, ' ' ORDER BY rk), '') AS text
  FROM closest WHERE rk <= 4 AND distance = least GROUP BY term)
SELECT DISTINCT t.term, CASE WHEN p.term IS NULL THEN t.term ELSE nullif(p.text, '') END AS suggestion FROM terms t LEFT JOIN picked p ON p.term = t.term"""
ORACLE["spell_phrase"] = with_views("misspelt", "part_gaz") + ",\n" + VOCAB.format(names="part_gaz") + """,
words AS (SELECT id, unnest([m1, w2, m2]) AS term, unnest([1, 2, 3]) AS k FROM misspelt), terms AS (SELECT term FROM words),
""" + _NEAR + """
SELECT id, string_agg(coalesce(c.word, w.term), ' ' ORDER BY k) AS corrected FROM words w LEFT JOIN closest c ON c.term = w.term AND c.rk = 1 GROUP BY id"""

# Every cut of a phrase into units, spelled out; the cheapest wins.
ORACLE["spell_compound"] = with_views("misspelt", "part_gaz") + ",\n" + VOCAB.format(names="part_gaz") + """,
phrases AS (SELECT id * 10 + k AS id, phrase FROM (SELECT id, unnest([0, 1, 2, 3, 4, 5]) AS k, unnest([w1 || w2, left(w2, 2) || ' ' || substr(w2, 3), m1 || ' ' || w2, m1 || w2,
  w1 || ' ' || left(w2, 2) || ' ' || substr(w2, 3), w1 || ' ' || w1 || w2 || ' ' || m2]) AS phrase FROM misspelt) AS p),
spelt AS (SELECT id, list_filter(string_split(phrase, ' '), lambda w: w <> '') AS ws FROM phrases),
singles AS (SELECT DISTINCT unnest(ws) AS w FROM spelt),
pairs AS (SELECT DISTINCT ws[i] || ws[i + 1] AS w FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM spelt) AS p),
cuts AS (SELECT w, left(w, CAST(k AS INT)) AS a, substr(w, CAST(k AS INT) + 1) AS b FROM (SELECT w, unnest(range(1, length(w))) AS k FROM singles) AS c),
terms AS (SELECT w AS term FROM singles UNION SELECT w FROM pairs UNION SELECT a FROM cuts UNION SELECT b FROM cuts),
""" + _NEAR + """,
top AS (SELECT term, word, freq, distance FROM closest WHERE rk = 1),
options AS (
  SELECT w, 1 AS n, distance AS cost, freq, word AS text FROM singles JOIN top ON term = w
  UNION ALL SELECT w, 1, 3, 0, w FROM singles
  UNION ALL SELECT w, 1, 1 + x.distance + y.distance, x.freq + y.freq, x.word || ' ' || y.word FROM cuts JOIN top x ON x.term = a JOIN top y ON y.term = b
    WHERE w NOT IN (SELECT term FROM top WHERE distance = 0)
  UNION ALL SELECT w, 2, 1 + distance, freq, word FROM pairs JOIN top ON term = w),
units AS (SELECT w, n, cost, freq, text FROM options QUALIFY row_number() OVER (PARTITION BY w, n ORDER BY cost, freq DESC, text) = 1),
walk AS (SELECT id, ws, CAST(0 AS BIGINT) AS used, 0 AS cost, CAST(0 AS BIGINT) AS freq, '' AS text FROM spelt
  UNION ALL SELECT id, ws, used + n, walk.cost + units.cost, CAST(walk.freq + units.freq AS BIGINT), concat_ws(' ', nullif(walk.text, ''), units.text)
  FROM walk JOIN units ON (n = 1 AND w = ws[used + 1]) OR (n = 2 AND w = ws[used + 1] || ws[used + 2]))
SELECT id, text AS corrected, CAST(cost AS INT) AS cost FROM walk WHERE used = len(ws) QUALIFY row_number() OVER (PARTITION BY id ORDER BY cost, freq DESC, text) = 1"""

# --- hierarchy -------------------------------------------------------------------------------------------------------

_KEY = lambda t: f"""upper(concat_ws('_', CASE WHEN {t} >= 4 THEN nullif(trim(prefix), '') END, CASE WHEN {t} >= 3 THEN nullif(trim(city), '') END,
  CASE WHEN {t} >= 2 THEN nullif(trim(admin2_id), '') END, CASE WHEN {t} >= 1 THEN nullif(trim(admin1_id), '') END, country_iso))"""  # noqa: E731
_UP = lambda t: f"""CASE WHEN {t} > 3 AND city <> '' THEN 3 WHEN {t} > 2 AND admin2_id <> '' THEN 2 WHEN {t} > 1 AND admin1_id <> '' THEN 1 WHEN {t} > 0 THEN 0 END"""
NODES = f"""mp AS (SELECT *, CAST(CASE WHEN prefix <> '' THEN 4 WHEN city <> '' THEN 3 WHEN admin2_id <> '' THEN 2 WHEN admin1_id <> '' THEN 1 ELSE 0 END AS INT) AS tier FROM matched_places),
mp2 AS (SELECT *, {_KEY('tier')} AS key, {_UP('tier')} AS parent_tier FROM mp),
nodes AS (SELECT seq, tier, key, coalesce(nullif(id, ''), key) AS place_id, title,
  CASE tier WHEN 0 THEN country_name WHEN 1 THEN admin1_name WHEN 2 THEN admin2_name WHEN 3 THEN city ELSE prefix END AS name,
  CASE tier WHEN 0 THEN 'Country' WHEN 1 THEN 'State' WHEN 2 THEN 'County' WHEN 3 THEN 'City' ELSE 'Place' END AS type,
  CASE WHEN lat <> 99.9 THEN lat END AS lat, lon, feature, CASE WHEN tier > 0 THEN enclosed_by ELSE '' END AS enclosed_by, parent_tier, {_KEY('parent_tier')} AS parent_key FROM mp2)"""
ORACLE["hierarchy_keys"] = with_views("matched_places") + ",\n" + NODES + """
SELECT seq, tier, key, CAST(length(key) - length(replace(key, '_', '')) AS INT) AS level, parent_key, place_id,
  contains(place_id, '_') OR length(place_id) < 4 AS made_up FROM nodes"""
ORACLE["hierarchy_names"] = with_views("matched_places") + ",\n" + NODES + """,
t AS (SELECT *, string_split(title, ',') AS p FROM nodes)
SELECT seq, name, type, CASE WHEN len(p) >= 4 THEN p[len(p) - 3] END AS city_part, CASE WHEN len(p) >= 5 THEN p[len(p) - 4] END AS prefix_part,
  CASE tier WHEN 0 THEN 'ADM0' WHEN 1 THEN 'ADM1' WHEN 2 THEN 'ADM2' ELSE feature END AS up_feature FROM t"""
DEDUPE = """deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tier, key ORDER BY contains(place_id, '_') OR length(place_id) < 4,
  CASE WHEN contains(place_id, '_') OR length(place_id) < 4 THEN seq ELSE -seq END) AS rk FROM {nodes}) AS x WHERE rk = 1)"""
ORACLE["hierarchy_dedupe"] = with_views("matched_places") + ",\n" + NODES + ",\n" + DEDUPE.format(nodes="nodes") + " SELECT tier, key, place_id, seq FROM deduped"
ABOVE = f"""ups AS (SELECT mp.* EXCLUDE (tier), u.t AS tier, mp.feature AS own_feature FROM mp JOIN (VALUES (0), (1), (2), (3)) AS u(t)
  ON u.t < mp.tier AND (u.t = 0 OR CASE u.t WHEN 1 THEN admin1_id WHEN 2 THEN admin2_id ELSE city END <> '')),
upk AS (SELECT *, {_KEY('tier')} AS key, {_UP('tier')} AS parent_tier,
  CASE tier WHEN 0 THEN 'ADM1' WHEN 1 THEN 'ADM2' ELSE own_feature END AS up_feature FROM ups),
anc AS (SELECT * FROM (SELECT *, {_KEY('parent_tier')} AS parent_key, row_number() OVER (PARTITION BY tier, key ORDER BY seq) AS rn FROM upk) AS z WHERE rn = 1)"""
ORACLE["ancestor_closure"] = with_views("matched_places") + ",\n" + NODES + ",\n" + ABOVE + " SELECT CAST(tier AS INT) AS tier, key, seq, up_feature AS feature FROM anc"
TREE = ABOVE + f""",
gk AS (SELECT *, upper(concat_ws('_', CASE WHEN tier >= 3 THEN {norm('name')} END, CASE WHEN tier >= 2 THEN nullif(admin2, '') END,
  CASE WHEN tier >= 1 THEN nullif(admin1, '') END, lower(country))) AS gkey FROM gaz),
anodes AS (SELECT CAST(a.seq + 4611686018427387904 AS BIGINT) AS seq, CAST(a.tier AS INT) AS tier, a.key, a.key AS place_id,
  concat_ws(', ', CASE WHEN a.tier >= 3 THEN nullif(a.city, '') END, CASE WHEN a.tier >= 2 THEN nullif(a.admin2_name, '') END, CASE WHEN a.tier >= 1 THEN a.admin1_name END, a.country_name) AS title,
  CASE a.tier WHEN 0 THEN a.country_name WHEN 1 THEN a.admin1_name WHEN 2 THEN a.admin2_name ELSE a.city END AS name,
  CASE a.tier WHEN 0 THEN 'Country' WHEN 1 THEN 'State' WHEN 2 THEN 'County' ELSE 'City' END AS type,
  gk.lat, gk.lon, coalesce(gk.feature, a.up_feature) AS feature, '' AS enclosed_by, a.parent_tier, a.parent_key
  FROM anc a LEFT JOIN gk ON gk.tier = a.tier AND gk.gkey = a.key),
allnodes AS (SELECT * FROM nodes UNION ALL BY NAME SELECT * FROM anodes),
""" + DEDUPE.format(nodes="allnodes") + """,
tree AS (SELECT d.* EXCLUDE (enclosed_by), CASE WHEN d.tier = 0 THEN '' WHEN regexp_matches(d.enclosed_by, '^P\\d\\d\\d\\d') THEN d.enclosed_by
  ELSE coalesce(p.place_id, '') END AS enclosed_by FROM deduped d LEFT JOIN deduped p ON p.tier = d.parent_tier AND p.key = d.parent_key)"""


def tree() -> str:
    return with_views("matched_places", "gaz") + ",\n" + NODES + ",\n" + TREE


ORACLE["enclosed_by"] = tree() + " SELECT tier, key, place_id, name, feature, enclosed_by FROM tree"
ORACLE["enclosure_check"] = tree() + """,
lv AS (SELECT *, length(key) - length(replace(key, '_', '')) AS own, length(enclosed_by) - length(replace(enclosed_by, '_', '')) AS around FROM tree)
SELECT tier, key, enclosed_by FROM lv WHERE enclosed_by <> '' AND ((own <= around AND own > 0) OR (own < around AND own = 0))"""
ORACLE["hierarchy_csv"] = tree() + f"""
SELECT concat('[', place_id, ']') AS "Place", {_capwords('title')} AS "Title", {_capwords('name')} AS "Name", type AS "Type",
  CASE WHEN lat IS NULL OR lon IS NULL THEN ' ' ELSE printf('%.4f', lat) END AS latitude,
  CASE WHEN lat IS NULL OR lon IS NULL THEN ' ' ELSE printf('%.4f', lon) END AS longitude,
  CASE WHEN enclosed_by <> '' THEN concat('[', enclosed_by, ']') ELSE '' END AS enclosed_by FROM tree"""

# --- text ------------------------------------------------------------------------------------------------------------

ORACLE["capwords"] = f"SELECT doc_id, {_capwords('x')} AS titled FROM (SELECT doc_id, translate(text, 'e', chr(39)) AS x FROM documents) AS d"
ORACLE["long_name"] = with_views("gaz") + f" SELECT geoid, {_LONG()} AS long_name FROM gaz"
ORACLE["output_text"] = keyed("gaz") + ",\n" + LOCATED + f"""
SELECT seq, CAST(CASE WHEN prefix <> '' THEN 4 ELSE m_tier END AS INT) AS tier,
  trim(concat(CASE WHEN prefix <> '' THEN concat({_capwords('prefix')}, ',') ELSE '' END,
       concat_ws(', ', nullif(city, ''), nullif(admin2, ''), nullif(admin1, ''), nullif(country, ''))), ', ') AS text FROM located"""
ORACLE["output_rules"] = with_views("gaz") + f""",
rules AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS k, n_name AS orig, concat('N', n_nationkey) AS repl FROM nation),
run AS (SELECT geoid, CAST(0 AS BIGINT) AS k, {_LONG()} AS name FROM gaz
  UNION ALL SELECT geoid, rules.k, replace(name, orig, repl) FROM run JOIN rules ON rules.k = run.k + 1)
SELECT geoid, name FROM run WHERE k = (SELECT count(*) FROM rules)"""
ORACLE["coord_format"] = with_views("matched_places") + " SELECT seq, printf('%.4f', lat) AS lat, printf('%.4f', lon) AS lon FROM matched_places"
ORACLE["xml_places"] = with_views("gaz") + """
SELECT geoid AS id, concat('_', geoid) AS handle, feature AS type, CASE WHEN tier = 3 THEN name ELSE concat(name, ', ', country) END AS place_text,
  CASE WHEN tier > 0 THEN lat END AS lat, CASE WHEN tier > 0 THEN lon END AS lon, tier > 0 AS had_coord, concat('_', country) AS placerefs FROM gaz"""
ORACLE["gramps_document"] = with_views("xml_rows") + """
SELECT x.file, pos, CASE WHEN base IS NULL THEN raw ELSE concat(chr(10), '  <placeobj handle="_', geoid, '" id="', geoid, '"><ptitle>New &amp; ', name, '</ptitle><pname value="New &amp; ', name,
  '"/><coord long="', lon, '" lat="', lat + 0.5, '"/><url href="http://x/?a=1&amp;b=2"/>', chr(10), '  </placeobj') END AS text, pos = 4000000000002 AS is_tail
FROM xml_rows x LEFT JOIN (SELECT * FROM xml_objects WHERE tier = 3 AND nth % 9 <> 0) o ON x.file = o.country AND x.pos BETWEEN o.base + 1 AND o.base + 7
WHERE base IS NULL OR pos = base + 1"""
ORACLE["gramps_rewrite"] = with_views("gaz") + """
SELECT concat('<placeobj handle="_', geoid, '" change="1" id="', geoid, '" type="', feature, '">', chr(10), '  <ptitle>',
  CASE WHEN tier % 2 = 1 THEN concat('New &amp; ', name) ELSE concat(name, ', ', country) END, '</ptitle>',
  CASE WHEN tier = 3 THEN concat('<pname value="New &amp; ', name, '"/>') ELSE '' END,
  CASE WHEN tier > 0 THEN concat('<coord long="', lon, '" lat="', CASE WHEN tier % 2 = 1 THEN lat + 0.5 ELSE lat END, '"/>') ELSE '' END,
  '<placeref hlink="_', country, '"/><url href="http://x/?a=1&amp;b=', geoid, '"/><noteref hlink="_n"/></placeobj>') AS text
FROM gaz"""
