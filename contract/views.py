"""Genealogy-shaped views over the supplied tables, one text for both engines.

``{name}`` stands for a table. Row keys are unique, so results do not depend on row order.
"""

from __future__ import annotations

import re
import zlib

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

VIEWS = {}

# region > nation > segment > customer as country > admin1 > admin2 > city
VIEWS["gaz"] = """
SELECT concat('R', r_regionkey) AS geoid, r_name AS name, 'ADM0' AS feature, 0 AS tier, r_name AS country,
       '' AS admin1, '' AS admin2, '' AS city,
       CAST(r_regionkey * 10 AS DOUBLE) AS lat, CAST(r_regionkey * -20 AS DOUBLE) AS lon FROM {region}
UNION ALL
SELECT concat('N', n_nationkey), n_name, 'ADM1', 1, r_name, n_name, '', '',
       CAST(n_nationkey AS DOUBLE), CAST(n_nationkey * -2 AS DOUBLE) FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT DISTINCT concat('S', n_nationkey, c_mktsegment), c_mktsegment, 'ADM2', 2, r_name, n_name, c_mktsegment, '',
       CAST(n_nationkey AS DOUBLE), CAST(n_nationkey * -2 AS DOUBLE)
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('C', c_custkey), c_name, 'PPL', 3, r_name, n_name, c_mktsegment, c_name,
       CAST((c_custkey % 180) - 89.5 AS DOUBLE), CAST((c_custkey % 360) - 179.5 AS DOUBLE)
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# one place text per order, with planted faults by o_orderkey % 10; the priority serves as file name
VIEWS["raw_places"] = """
SELECT o_orderpriority AS file, o_orderkey AS seq, o_custkey AS cust, CAST(year(o_orderdate) AS INT) AS event_year,
  CASE o_orderkey % 10
    WHEN 1 THEN concat(c_name, ', xyz, ', n_name, ', ', r_name)
    WHEN 2 THEN concat(c_name, ', , ', n_name, ', ', r_name)
    WHEN 3 THEN concat(substring(c_name, 1, 14), '*, ', c_mktsegment, ', ', n_name, ', ', r_name)
    WHEN 4 THEN concat(substring(c_name, 1, 3), substring(c_name, 5), ', ', c_mktsegment, ', ', n_name, ', ', r_name)
    WHEN 5 THEN concat(c_name, ', ', c_mktsegment, ', ', n_name, ', NOWHERE')
    WHEN 6 THEN ''
    WHEN 7 THEN concat(o_orderpriority, ', ', c_name, ', ', c_mktsegment, ', ', n_name, ', ', r_name)
    ELSE concat(c_name, ', ', c_mktsegment, ', ', n_name, ', ', r_name) END AS place_text
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
"""

# patterns in each part of a place, from every customer and nation
VIEWS["wild_texts"] = """
SELECT concat(substring(c_name, 1, 16), '*, ', c_mktsegment, ', ', substring(n_name, 1, 2), '*, ', r_name) AS place_text
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION SELECT concat(substring(n_name, 1, 3), '*, ', r_name) FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION SELECT concat(n_name, ', ', substring(r_name, 1, 2), '*') FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION SELECT concat(substring(r_name, 1, 1), '*') FROM {region}
UNION SELECT concat('*', substring(c_mktsegment, 3), ', *', substring(n_name, 3), ', *', substring(r_name, 3))
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# one INDI per customer, one event per order; PLAC precedes DATE when o_orderkey % 3 = 0; MAP when % 4 = 0;
# one FAM per fifth customer, whose name is a pointer to the INDI; ten files
VIEWS["gedcom_lines"] = """
SELECT concat('f', rec % 10) AS file, rec, pos, raw FROM (
SELECT c_custkey AS rec, CAST(0 AS BIGINT) AS pos, concat('0 @I', c_custkey, '@ INDI') AS raw FROM {customer}
UNION ALL SELECT c_custkey, CAST(1 AS BIGINT), concat('1 NAME ', c_name, ' /Smith/') FROM {customer}
UNION ALL SELECT o_custkey, o_orderkey * 10 + 10, CASE o_orderkey % 3 WHEN 0 THEN '1 BIRT' WHEN 1 THEN '1 DEAT' ELSE '1 EVEN' END FROM {orders}
UNION ALL SELECT o_custkey, o_orderkey * 10 + CASE WHEN o_orderkey % 3 = 0 THEN 16 ELSE 11 END,
  concat('2 DATE ', CASE WHEN o_orderkey % 5 = 0 THEN 'ABT ' ELSE '' END, day(o_orderdate), ' ',
         substring('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', month(o_orderdate) * 3 - 2, 3), ' ', year(o_orderdate)) FROM {orders}
UNION ALL SELECT o_custkey, o_orderkey * 10 + 12, concat('2 PLAC ', c_name, ', ', c_mktsegment) FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL SELECT o_custkey, o_orderkey * 10 + 13, '3 MAP' FROM {orders} WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_custkey, o_orderkey * 10 + 14, '4 LATI 1.5' FROM {orders} WHERE o_orderkey % 4 = 0 AND o_orderkey % 28 <> 0
UNION ALL SELECT o_custkey, o_orderkey * 10 + 15, '4 LONG 2.5' FROM {orders} WHERE o_orderkey % 4 = 0
UNION ALL SELECT c_custkey + 1000000000, CAST(0 AS BIGINT), concat('0 @F', c_custkey, '@ FAM') FROM {customer} WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey + 1000000000, CAST(1 AS BIGINT), concat('1 HUSB @I', c_custkey, '@') FROM {customer} WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey + 1000000000, CAST(2 AS BIGINT), '1 MARR' FROM {customer} WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey + 1000000000, CAST(3 AS BIGINT), '2 DATE 1 JAN 1990' FROM {customer} WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey + 1000000000, CAST(4 AS BIGINT), concat('2 PLAC ', c_mktsegment) FROM {customer} WHERE c_custkey % 5 = 0
) AS l
"""

# the same lines, some with trailing backslashes, some of no known form
VIEWS["rough_lines"] = """
SELECT concat('f', rec % 10) AS file, rec, pos,
  CASE WHEN pos % 7 = 3 THEN concat(raw, chr(92), chr(92)) WHEN pos % 11 = 5 THEN concat('garbage ', raw) ELSE raw END AS raw
FROM gedcom_lines
"""

# replacement table: geoid + prefix, deletes, malformed entries, lost geoids
VIEWS["repl"] = """
SELECT concat(c_name, ', xyz, ', n_name, ', ', r_name) AS key,
  CASE c_custkey % 5 WHEN 0 THEN concat('@C', c_custkey, '@') WHEN 1 THEN concat('@C', c_custkey, '@church')
       WHEN 2 THEN '@@' WHEN 3 THEN concat('@LOST', c_custkey) ELSE 'junk' END AS val
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# skip list: some of the places whose country is unknown
VIEWS["skips"] = """
SELECT concat(c_name, ', ', c_mktsegment, ', ', n_name, ', NOWHERE') AS key, ' ' AS val
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0
"""

# reviewer decisions, ordered by seq
VIEWS["decisions"] = """
SELECT event_id AS seq, concat('Key ', user_id) AS key,
  CASE event_type WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'skip' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'prefix' ELSE 'none' END AS op,
  concat('G', user_id % 7) AS geoid, concat('P', event_id % 5) AS prefix
FROM {events}
"""

# first year in which an admin1 name was in use
VIEWS["validity"] = """
SELECT lower(r_name) AS country_iso, n_name AS admin1_id, CAST(1994 + n_nationkey % 8 AS INT) AS first_year
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

# countries there are, and whether they are supported
VIEWS["countries"] = "SELECT r_name AS name, r_regionkey <> 3 AS supported FROM {region}"

# places as they come out of matching, for the hierarchy: some with a prefix, some without a county, some with ids of
# their own or an enclosing place from the file
VIEWS["matched_places"] = """
SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN concat('P', 1000 + o_orderkey) ELSE '' END AS id,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE '' END AS prefix,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE lower(c_name) END AS city,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE c_mktsegment END AS admin2_id,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE c_mktsegment END AS admin2_name,
  n_name AS admin1_id, n_name AS admin1_name, lower(r_name) AS country_iso, r_name AS country_name, 'PPL' AS feature,
  CASE WHEN o_orderkey % 13 = 0 THEN CAST(99.9 AS DOUBLE) ELSE CAST(o_totalprice / 7919.0 AS DOUBLE) END AS lat,
  CAST(o_totalprice / -3571.0 AS DOUBLE) AS lon,
  concat(CASE WHEN o_orderkey % 4 = 0 THEN concat(o_orderpriority, ',') ELSE '' END, c_name, ', ', n_name, ', ', r_name) AS title,
  CASE o_orderkey % 9 WHEN 0 THEN 'P0001' WHEN 1 THEN 'P0001_A_B_C_D_E' ELSE '' END AS enclosed_by
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
"""

# product names as place names: brands as countries
VIEWS["part_gaz"] = """
SELECT concat('P', p_partkey) AS geoid, p_name AS name, p_brand AS country FROM {part}
"""

# words of product names with one letter dropped, never the first
VIEWS["misspelt"] = """
SELECT p_partkey AS id, p_brand AS country, w1, w2,
  concat(substring(w1, 1, CAST(1 + p_partkey % 3 AS INT)), substring(w1, CAST(3 + p_partkey % 3 AS INT))) AS m1,
  concat(substring(w2, 1, CAST(1 + p_partkey % 3 AS INT)), substring(w2, CAST(3 + p_partkey % 3 AS INT))) AS m2
FROM (SELECT p_partkey, p_brand, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM {part}) AS p
"""

# Gramps place objects as XML text
VIEWS["placeobj"] = """
SELECT 'x' AS file, CAST(tier AS BIGINT) AS pos, geoid, name, lat, lon,
  concat('<placeobj handle="_', geoid, '" change="1" id="', geoid, '" type="', feature, '">', chr(10), '  <ptitle>', name, ', ', country,
         '</ptitle>', CASE WHEN tier = 3 THEN concat('<pname value="', name, '"/>') ELSE '' END,
         CASE WHEN tier > 0 THEN concat('<coord long="', lon, '" lat="', lat, '"/>') ELSE '' END,
         '<placeref hlink="_', country, '"/></placeobj>') AS fragment
FROM gaz
"""

# whole Gramps documents, one per country, as rows that end before a >: people, places, notes; every ninth place isn't closed
VIEWS["xml_rows"] = """
SELECT file, pos, raw FROM (
SELECT r_name AS file, CAST(0 AS BIGINT) AS pos, '<?xml version="1.0" encoding="UTF-8"?' AS raw FROM {region}
UNION ALL SELECT r_name, CAST(1 AS BIGINT), concat(chr(10), '<database xmlns="http://x/"') FROM {region}
UNION ALL SELECT r_name, CAST(2 AS BIGINT), '<people' FROM {region}
UNION ALL SELECT r_name, c_custkey * 4 + 100, concat('<person id="I', c_custkey, '"') FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, c_custkey * 4 + 101, concat('<name', chr(10)) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, c_custkey * 4 + 102, concat(c_name, ' &gt; a', '</name') FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, c_custkey * 4 + 103, '</person' FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, CAST(1000000000000 AS BIGINT), '</people' FROM {region}
UNION ALL SELECT r_name, CAST(1000000000001 AS BIGINT), '<places' FROM {region}
UNION ALL SELECT country, base + 1, concat(chr(10), '  <placeobj handle="_', geoid, '" id="', geoid, '"') FROM xml_objects
UNION ALL SELECT country, base + 2, '<ptitle' FROM xml_objects
UNION ALL SELECT country, base + 3, concat(name, ', ', country, '</ptitle') FROM xml_objects
UNION ALL SELECT country, base + 4, concat('<pname value="', name, '"/') FROM xml_objects WHERE tier = 3
UNION ALL SELECT country, base + 5, concat('<coord long="', lon, '" lat="', lat, '"/') FROM xml_objects WHERE tier > 0
UNION ALL SELECT country, base + 6, '<url href="http://x/?a=1&amp;b=2"/' FROM xml_objects
UNION ALL SELECT country, base + 7, concat(chr(10), '  </placeobj') FROM xml_objects WHERE nth % 9 <> 0
UNION ALL SELECT r_name, CAST(3000000000000 AS BIGINT), concat(chr(10), '</places') FROM {region}
UNION ALL SELECT r_name, CAST(3000000000001 AS BIGINT), '<notes' FROM {region}
UNION ALL SELECT r_name, 3000000000002 + o_orderkey, concat('<note id="', o_orderkey, '" text="', o_orderpriority, '"/')
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, CAST(4000000000000 AS BIGINT), '</notes' FROM {region}
UNION ALL SELECT r_name, CAST(4000000000001 AS BIGINT), '</database' FROM {region}
UNION ALL SELECT r_name, CAST(4000000000002 AS BIGINT), chr(10) FROM {region}
) AS x
"""

# the place objects of those documents, in their order
VIEWS["xml_objects"] = """
SELECT *, 1000000000010 + nth * 10 AS base FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY geoid) AS nth FROM gaz) AS g
"""

_NEEDS = {name: [v for v in VIEWS if re.search(rf"\bFROM {v}\b", text)] for name, text in VIEWS.items()}


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the views over plain table names."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for view in _NEEDS[name]:
            add(view)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    plain = {t: t for t in TABLES}
    return "WITH RECURSIVE " + ",\n".join(f"{v} AS ({VIEWS[v].format(**plain)})" for v in ordered)


def _table(spark, sf_dir: str, name: str) -> str:
    """Name of a temporary view over one Parquet file, made at first use."""
    alias = f"{name}_{zlib.crc32(sf_dir.encode()):08x}"
    if not spark.catalog.tableExists(alias):
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").createOrReplaceTempView(alias)
    return alias


def _text(spark, sf_dir: str, name: str) -> str:
    files = {t: _table(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", VIEWS[name])}
    text = VIEWS[name].format(**files)
    for needed in _NEEDS[name]:
        text = re.sub(rf"\bFROM {needed}\b", lambda _, inner=_text(spark, sf_dir, needed), at=needed: f"FROM ({inner}) AS {at}", text)
    return text


def view(spark, sf_dir: str, name: str):
    """The view as a DataFrame over the Parquet files of a folder."""
    return spark.sql(_text(spark, sf_dir, name))
