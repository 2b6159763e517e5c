"""Working tables derived from the driver's parquet files, as SQL that reads the same in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfolio.operators.ordered import row_numbers
from wayfolio.session import balanced

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "places": r"""
SELECT c_custkey AS id,
  CASE WHEN c_custkey % 43 = 0 THEN NULL
       WHEN c_custkey % 41 = 0 THEN 'Temple'
       ELSE (CASE c_custkey % 3 WHEN 0 THEN 'The ' WHEN 1 THEN 'St ' ELSE '' END)
         || (CASE WHEN c_custkey % 2 = 0 THEN 'North-Hall  ' ELSE 'north_hall ' END)
         || CAST(c_custkey % 60 AS STRING) END AS name,
  CASE c_custkey % 14 WHEN 0 THEN 'muslim' WHEN 1 THEN 'christian' WHEN 2 THEN 'buddhist' WHEN 3 THEN 'jewish'
    WHEN 4 THEN 'Place of Worship' WHEN 5 THEN 'Christianity' WHEN 6 THEN 'hindu' WHEN 7 THEN 'chinese_folk'
    WHEN 8 THEN 'sikh' WHEN 9 THEN 'other' WHEN 10 THEN NULL WHEN 11 THEN 'place_of_worship'
    WHEN 12 THEN 'Cao Dai' ELSE '' END AS religion,
  CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) END AS denomination,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE n_name END AS country,
  CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 29 = 0 THEN 'Unknown'
       ELSE 'City ' || CAST(c_custkey % 50 AS STRING) END AS city,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 90 AS STRING) || ' Main Street' END AS address,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'A place of ' || lower(c_mktsegment) END AS description,
  CASE WHEN c_custkey % 7 = 0 THEN 'https://img.example/' || CAST(c_custkey AS STRING) || '.jpg'
       WHEN c_custkey % 7 = 1 THEN '' END AS image_url,
  CASE WHEN c_custkey % 6 = 0 THEN 'http://site.example/' || CAST(c_custkey AS STRING)
       WHEN c_custkey % 6 = 1 THEN 'ftp://bad.example' END AS website_url,
  CASE WHEN c_custkey % 31 = 0 THEN NULL
       ELSE CAST(((c_custkey % 300) * 7919) % 160000 AS DOUBLE) / 1000 - 80 END AS latitude,
  CASE WHEN c_custkey % 37 = 0 THEN NULL
       ELSE CAST(((c_custkey % 300) * 104729) % 350000 AS DOUBLE) / 1000 - 175 END AS longitude,
  CASE WHEN c_custkey % 3 = 0 THEN 'openstreetmap' END AS source,
  CASE WHEN c_custkey % 3 = 0 THEN 'node/' || CAST(c_custkey % 450 AS STRING) END AS external_id,
  c_custkey AS arrival
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "places_existing": "SELECT * FROM places WHERE id % 4 <> 3",
    "places_incoming": "SELECT * FROM places WHERE id % 4 = 3",
    "targets": r"""
SELECT n_nationkey AS target_id, 'City ' || CAST(n_nationkey AS STRING) AS name, n_name AS country,
  CAST((n_nationkey * 7919) % 160000 AS DOUBLE) / 1000 - 80 AS lat,
  CAST((n_nationkey * 104729) % 350000 AS DOUBLE) / 1000 - 175 AS lng
FROM nation""",
    "books_h": r"""
SELECT c_custkey AS book_id, c_name AS title, c_mktsegment AS religion, c_acctbal > 0 AS public_domain FROM customer""",
    "sections_h": r"""
SELECT o_orderkey AS section_id, o_custkey AS book_id,
  ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS chapter_number,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS sort_order,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Title ' || o_orderpriority ELSE NULL END AS display_title,
  o_orderstatus AS section_label, o_orderdate AS created_at FROM orders""",
    "passages_h": r"""
SELECT l_orderkey AS section_id, l_linenumber AS verse_number, l_returnflag AS verse_label,
  p_name || ' ' || p_type || ' ' || p_brand AS content
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "books": r"""
SELECT source AS book_id, 'Book ' || source AS title,
  CASE WHEN source IN ('src3', 'src7') THEN NULL ELSE min(lang) END AS religion, max(lang) AS tradition,
  CASE WHEN source LIKE 'src1%' THEN 'selected_passages' ELSE 'sectioned_text' END AS text_type
FROM documents GROUP BY source""",
    "sections": r"""
SELECT doc_id AS section_id, source AS book_id, lang AS section_label,
  ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) AS chapter_number FROM documents""",
    "conversation_messages": r"""
SELECT conv_id, conv_id % 20 AS user_id, turn, role, text AS content FROM conversations""",
    "reviews": r"""
SELECT event_id AS review_id, event_id % 300 AS place_id, user_id, 1 + event_id % 5 AS rating,
  event_type AS comment, event_id % 10 <> 0 AS is_approved, ts AS created_at FROM events""",
    "favorites": r"""
SELECT event_id AS favorite_id, user_id, event_id AS section_id, 1 + event_id % 7 AS verse_number, ts AS created_at
FROM events WHERE event_type = 'click'""",
    "calendar": r"""
SELECT event_id AS id, event_type AS title, CAST(ts AS DATE) AS event_date,
  CASE event_id % 3 WHEN 0 THEN 'Christianity' WHEN 1 THEN 'Islam' END AS religion,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'Country ' || CAST(event_id % 9 AS STRING) END AS country,
  event_id % 2 = 0 AS is_global FROM events""",
    "reminders": r"""
SELECT event_id AS id, user_id, event_type AS title, ts AS reminder_time,
  CASE event_id % 5 WHEN 0 THEN 'once' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' WHEN 3 THEN 'monthly' ELSE 'yearly' END AS frequency
FROM events""",
    "error_log": r"""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN 400 END AS status,
  CASE event_id % 6 WHEN 4 THEN 'request timed out' WHEN 5 THEN 'fetch failed' END AS message FROM events WHERE event_type = 'error'""",
    "elements_json": r"""
SELECT id AS arrival, id % (SELECT count(*) FROM nation) AS target_id,
  '{"type":"' || CASE id % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END || '","id":' || CAST(id AS STRING)
  || CASE WHEN latitude IS NULL OR longitude IS NULL THEN ''
          WHEN id % 3 = 0 THEN ',"lat":' || CAST(round(latitude, 3) AS STRING) || ',"lon":' || CAST(round(longitude, 3) AS STRING)
          ELSE ',"center":{"lat":' || CAST(round(latitude, 3) AS STRING) || ',"lon":' || CAST(round(longitude, 3) AS STRING) || '}' END
  || ',"tags":{"amenity":"place_of_worship"'
  || CASE WHEN name IS NULL THEN '' WHEN id % 19 = 0 THEN ',"name:en":"' || name || '"' ELSE ',"name":"' || name || '"' END
  || CASE WHEN coalesce(religion, '') = '' THEN '' ELSE ',"religion":"' || lower(religion) || '"' END
  || CASE id % 10 WHEN 0 THEN ',"building":"church"' WHEN 1 THEN ',"building":"mosque"' WHEN 2 THEN ',"historic":"monastery"' ELSE '' END
  || CASE WHEN coalesce(city, '') = '' THEN '' WHEN id % 2 = 0 THEN ',"addr:city":"' || city || '"' ELSE ',"addr:town":"' || city || '"' END
  || CASE WHEN address IS NULL THEN '' ELSE ',"addr:street":"' || address || '"' END
  || CASE WHEN website_url IS NULL THEN '' WHEN id % 4 = 0 THEN ',"contact:website":"' || website_url || '"' ELSE ',"website":"' || website_url || '"' END
  || CASE id % 8 WHEN 0 THEN ',"image":"https://img.example/a.jpg"' WHEN 1 THEN ',"image":"File:My hall.jpg"' WHEN 2 THEN ',"wikimedia_commons":"Category:Halls"' ELSE '' END
  || CASE id % 9 WHEN 0 THEN ',"wikidata":"q' || CAST(id % 50 AS STRING) || '"' WHEN 1 THEN ',"wikidata":"X7"' ELSE '' END
  || '}}' AS json
FROM places""",
    "bindings_json": r"""
SELECT id AS arrival, coalesce(religion, '') AS grp,
  '{"place":{"value":"http://entity.example/Q' || CAST(id AS STRING) || '"}'
  || CASE WHEN name IS NULL THEN '' ELSE ',"placeLabel":{"value":"' || name || '"}' END
  || CASE WHEN country IS NULL THEN '' ELSE ',"countryLabel":{"value":"' || country || '"}' END
  || CASE WHEN id % 23 = 0 THEN ',"coord":{"value":"Point(bad)"}' WHEN latitude IS NULL OR longitude IS NULL THEN ''
     ELSE ',"coord":{"value":"Point(' || CAST(round(longitude, 3) AS STRING) || ' ' || CAST(round(latitude, 3) AS STRING) || ')"}' END
  || '}' AS json
FROM places""",
    "entities_json": r"""
SELECT 'Q' || CAST(id AS STRING) AS qid,
  '{"descriptions":{"en":{"value":"Entity ' || CAST(id AS STRING) || '"}},"claims":{'
  || CASE WHEN id % 2 = 0 THEN '"P18":[{"mainsnak":{"datavalue":{"value":"Photo ' || CAST(id AS STRING) || '.jpg"}}}]' ELSE '' END
  || CASE WHEN id % 6 = 0 THEN ',' ELSE '' END
  || CASE WHEN id % 3 = 0 THEN '"P856":[{"mainsnak":{"datavalue":{"value":"https://entity.example/' || CAST(id AS STRING) || '"}}}]' ELSE '' END
  || '}}' AS json
FROM places""",
}

# Line rows are written once per engine: here for DuckDB, in Tables for Spark.
_LINES = r"""
SELECT doc_id AS section_id, CAST(i - 1 AS INTEGER) AS line_no, lines[i] AS content
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines,
  unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)"""


# Numbered tables are built with the operator that splits large groups, not with a plain window.
_NUMBERED = {
    "sections": (
        "documents", ["doc_id AS section_id", "source AS book_id", "lang AS section_label"], ["book_id"], ["section_id"],
    ),
    "sections_h": (
        "orders",
        [
            "o_orderkey AS section_id", "o_custkey AS book_id",
            "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS sort_order",
            "CASE WHEN o_orderkey % 7 = 0 THEN 'Title ' || o_orderpriority ELSE NULL END AS display_title",
            "o_orderstatus AS section_label", "o_orderdate AS created_at",
        ],
        ["book_id"], ["created_at", "section_id"],
    ),
}


def view_sql(name: str) -> str:
    return _LINES if name == "passages" else VIEWS[name]


def _references(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", sql)))
    return [n for n in (*BASE, *VIEWS, "passages") if n in words]


def _closure(names) -> tuple[list[str], list[str]]:
    """Views in dependency order, and the base tables they read."""
    ordered: list[str] = []
    base: list[str] = []

    def visit(name: str) -> None:
        if name in BASE:
            if name not in base:
                base.append(name)
            return
        if name in ordered:
            return
        for ref in _references(view_sql(name)):
            if ref != name:
                visit(ref)
        ordered.append(name)

    for name in names:
        visit(name)
    return ordered, base


def with_views(names: str, body: str) -> str:
    """Prefix a DuckDB query with the working tables it reads (space separated)."""
    ordered, _ = _closure(names.split())
    ctes = [f"{n} AS ({view_sql(n).strip()})" for n in ordered]
    body = body.strip()
    head = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if not ctes:
        return body
    if head:
        recursive = "RECURSIVE " if head.group(1) else ""
        return f"WITH {recursive}" + ",\n".join(ctes) + ",\n" + body[head.end():]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Tables:
    """Named access to the driver's tables and the working tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(self.path(name))
        if name == "passages":
            lines = F.posexplode(F.split("text", "\\n")).alias("line_no", "content")
            return self.documents.select(F.col("doc_id").alias("section_id"), lines)
        if name in _NUMBERED:
            source, keep, keys, order = _NUMBERED[name]
            return row_numbers(self(source).selectExpr(*keep), keys, order, "chapter_number")
        ordered, base = _closure([name])
        for table in base:
            rows = self(table)
            if table == "customer" and "places" in ordered:
                # Place rules are heavy on the CPU, and the small files hold one split each.
                rows = balanced(rows, "c_custkey")
            rows.createOrReplaceTempView(table)
        ctes = ", ".join(f"{n} AS ({view_sql(n).strip()})" for n in ordered)
        return self.spark.sql(f"WITH {ctes} SELECT * FROM {name}")

    def texts(self, name: str, key: str, column: str) -> DataFrame:
        """Key and text of a table, ready for CPU-heavy text rules."""
        return balanced(self(name).select(key, column), key)

    @property
    def documents(self) -> DataFrame:
        return self.texts("documents", "doc_id", "text")

    @property
    def pages(self) -> DataFrame:
        return self.texts("pages", "page_id", "html")
