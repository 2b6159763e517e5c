"""Grouped reports and the audit sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfolio.catalog.join_queries import WALK_SQL, deduped_elements
from wayfolio.catalog.registry import COORDINATE, GENERIC, LOCATION, NEAR, SCORE, add, filled_sql, key_of, label_of, sq, sql_list
from wayfolio.functions.places import coordinate_key, location_key, similar_key
from wayfolio.lookups import CATEGORY_ALIASES, GENERIC_CITIES, UNSPECIFIC_LABELS
from wayfolio.operators import aggregates as E
from wayfolio.operators.geo import bounds, grid_clusters
from wayfolio.plans import audit as A
from wayfolio.plans.library import library

add(
    "e1_count_by", lambda t: E.count_by(t("places"), "religion"), "places",
    "SELECT coalesce(nullif(religion, ''), '(missing)') AS value, count(*) AS rows FROM places GROUP BY 1",
)
add(
    "e2_top_counts", lambda t: E.top_counts(E.count_by(t("places"), "city"), 30), "places",
    "SELECT coalesce(nullif(city, ''), '(missing)') AS value, count(*) AS rows FROM places GROUP BY 1 ORDER BY rows DESC, value LIMIT 30",
)
add(
    "e2_top_normalized_labels", lambda t: A.normalized_labels(t("places")), "places",
    f"SELECT {label_of('religion')} AS label, count(*) AS rows FROM places GROUP BY 1 ORDER BY rows DESC, label LIMIT 100",
)
add(
    "e3_missing_stats", lambda t: E.missing_stats(t("places"), A.AUDITED), "places",
    " UNION ALL ".join(f"SELECT {sq(c)} AS field, count(*) FILTER (WHERE NOT {filled_sql(c)}) AS missing FROM places" for c in A.AUDITED)
    + " UNION ALL SELECT 'coordinates', count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL) FROM places",
)
add(
    "e4_summary", lambda t: E.summary(t("places")), "places",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE latitude IS NOT NULL AND longitude IS NOT NULL) AS valid_coordinates,
  count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL) AS missing_coordinates, round(avg({SCORE}), 2) AS average_score FROM places""",
)
add(
    "e5_score_distribution", lambda t: E.score_distribution(t("places")), "places",
    f"SELECT {SCORE} AS score, count(*) AS rows FROM places GROUP BY 1",
)


def _groups(key: str) -> str:
    return f"SELECT dup_key, count(*) AS rows FROM (SELECT {key} AS dup_key FROM places) WHERE dup_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1"


add("e6_duplicate_locations", lambda t: E.duplicate_groups(t("places"), location_key()), "places", _groups(LOCATION))
add("e7_duplicate_coordinates", lambda t: E.duplicate_groups(t("places"), coordinate_key()), "places", _groups(COORDINATE))
add("e8_near_duplicates", lambda t: E.duplicate_groups(t("places"), similar_key()), "places", _groups(NEAR))
for _kind, _key, _sql in (("locations", location_key, LOCATION), ("coordinates", coordinate_key, COORDINATE), ("near", similar_key, NEAR)):
    add(
        f"e9_examples_{_kind}", lambda t, key=_key: E.with_examples(t("places"), key()), "places",
        f"""WITH keyed AS (SELECT id, name, {_sql} AS dup_key FROM places),
top AS (SELECT dup_key, count(*) AS rows FROM keyed WHERE dup_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY rows DESC, dup_key LIMIT 20),
ranked AS (SELECT dup_key, rows, id, name, row_number() OVER (PARTITION BY dup_key ORDER BY id) AS n FROM keyed JOIN top USING (dup_key))
SELECT dup_key, rows, string_agg(id || ': ' || coalesce(name, 'null'), '; ' ORDER BY id) AS examples FROM ranked WHERE n <= 3 GROUP BY 1, 2""",
    )

_POOL = "SELECT coalesce(nullif(religion, ''), '(missing)') AS label, count(*) AS rows FROM places GROUP BY 1"
_KNOWN = sql_list([*CATEGORY_ALIASES, *UNSPECIFIC_LABELS, "other"])
add(
    "e10_normalization_candidates", lambda t: A.normalization_candidates(t("places")), "places",
    f"SELECT * FROM (SELECT label, {label_of('label')} AS normalized, rows FROM ({_POOL})) WHERE label <> normalized AND label <> '(missing)'",
)
add(
    "e10_clear_candidates", lambda t: A.normalization_candidates(t("places"), clear_only=True), "places",
    f"""SELECT * FROM (SELECT label, {label_of('label')} AS normalized, rows FROM ({_POOL}))
WHERE label <> normalized AND {key_of('label')} IN {sql_list(CATEGORY_ALIASES)}""",
)
add(
    "e11_strange_labels", lambda t: A.strange_labels(t("places")), "places",
    f"SELECT label, {label_of('label')} AS normalized, rows FROM ({_POOL}) WHERE label <> '(missing)' AND {key_of('label')} NOT IN {_KNOWN}",
)
add(
    "e12_suspicious_cities", lambda t: A.suspicious_cities(t("places")), "places",
    f"SELECT id, name, city, country, religion FROM places WHERE {key_of('city')} IN {sql_list(GENERIC_CITIES)}",
)
add(
    "e12_generic_names", lambda t: A.generic_names(t("places")), "places",
    f"SELECT id, name, city, country, religion FROM places WHERE {key_of('name')} IN {GENERIC}",
)


def _pick(i: int) -> str:
    return "CASE lower(label) " + " ".join(f"WHEN {sq(k)} THEN {sq(v[i])}" for k, v in CATEGORY_ALIASES.items()) + " END"


add(
    "e13_legend", lambda t: E.legend(t("places")), "places",
    f"""SELECT label, coalesce({_pick(2)}, CASE WHEN label = 'Sacred place' THEN '•' ELSE '✦' END) AS symbol,
  'temple-marker--' || coalesce({_pick(1)}, CASE WHEN label = 'Sacred place' THEN 'sacred-place' ELSE 'other' END) AS class_name,
  count(*) AS places
FROM (SELECT {label_of('religion')} AS label FROM places WHERE latitude IS NOT NULL AND longitude IS NOT NULL) GROUP BY 1, 2, 3""",
)
add(
    "e14_rating_summary", lambda t: E.rating_summary(t("reviews").filter("is_approved")), "reviews",
    "SELECT place_id, round(avg(rating), 1) AS average_rating, count(*) AS reviews FROM reviews WHERE is_approved GROUP BY 1",
)
add(
    "e15_count_children",
    lambda t: E.count_children(t("books_h"), t("sections_h"), "book_id", "book_id", "sections").select("book_id", "title", "sections"),
    "books_h sections_h",
    "SELECT b.book_id, b.title, count(s.section_id) AS sections FROM books_h b LEFT JOIN sections_h s USING (book_id) GROUP BY 1, 2",
)
add(
    "e16_library", lambda t: library(t("books")), "books",
    """SELECT group_name, count(*) OVER (PARTITION BY group_name) AS books, title, book_id
FROM (SELECT coalesce(nullif(trim(religion), ''), 'Other / Unclassified') AS group_name, title, book_id FROM books)""",
)
add(
    "e17_facet_options", lambda t: E.facet_options(t("places"), "city", country="NATION_1"), "places",
    f"SELECT DISTINCT city AS option FROM places WHERE country = 'NATION_1' AND {filled_sql('city')}",
)
_COUNTERS = """count(*) AS fetched, count(*) FILTER (WHERE outcome = 'candidate') AS valid,
  count(*) FILTER (WHERE outcome = 'unnamed') AS skipped_unnamed, count(*) FILTER (WHERE outcome = 'generic') AS skipped_generic,
  count(*) FILTER (WHERE outcome = 'no_coordinates') AS skipped_no_coordinates,
  count(*) FILTER (WHERE outcome = 'candidate' AND NOT taken) AS duplicates, count(*) FILTER (WHERE taken) AS candidates
FROM parsed LEFT JOIN (SELECT arrival, taken FROM keyed JOIN walk USING (n)) USING (arrival)"""
add(
    "e18_ingest_stats", lambda t: E.ingest_stats(deduped_elements(t)), "elements_json targets",
    f"WITH RECURSIVE {WALK_SQL} SELECT target_id, {_COUNTERS} GROUP BY 1",
)
add(
    "e19_ingest_totals", lambda t: E.ingest_stats(deduped_elements(t).withColumn("target_id", F.expr("nullif(target_id, 3)")), totals=True),
    "elements_json targets",
    f"""WITH RECURSIVE {WALK_SQL} SELECT nullif(target_id, 3) AS target_id, CAST(grouping(nullif(target_id, 3)) AS INTEGER) AS is_total, {_COUNTERS}
GROUP BY ROLLUP (nullif(target_id, 3))""",
)
add(
    "e20_error_summary",
    lambda t: E.error_summary(t("error_log")),
    "error_log",
    """SELECT CASE WHEN status = 429 THEN 'rate_limited' WHEN status = 404 THEN 'not_found' WHEN status >= 500 THEN 'server'
  WHEN status >= 400 THEN 'http' WHEN message LIKE '%timed out%' THEN 'timeout' WHEN message LIKE '%fetch failed%' THEN 'network'
  ELSE 'unknown' END AS kind, count(*) AS errors FROM error_log GROUP BY 1""",
)
add(
    "e21_bounds", lambda t: bounds(t("places")), "places",
    """SELECT min(latitude) AS south, min(longitude) AS west, max(latitude) AS north, max(longitude) AS east, count(*) AS places,
  (min(latitude) + max(latitude)) / 2 AS center_lat, (min(longitude) + max(longitude)) / 2 AS center_lng
FROM places WHERE latitude IS NOT NULL AND longitude IS NOT NULL""",
)
add(
    "e22_grid_clusters", lambda t: grid_clusters(t("places"), 3), "places",
    """WITH p AS (SELECT latitude, longitude, least(0.9999, greatest(-0.9999, sin(radians(latitude)))) AS s
  FROM places WHERE latitude IS NOT NULL AND longitude IS NOT NULL)
SELECT CAST(floor((longitude + 180) / 360 * 2048 / 52) AS BIGINT) AS cell_x,
  CAST(floor((0.5 - ln((1 + s) / (1 - s)) / (4 * pi())) * 2048 / 52) AS BIGINT) AS cell_y,
  count(*) AS places, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM p GROUP BY 1, 2""",
)
add(
    "e23_corpus_summary",
    lambda t: E.corpus_summary(t("passages").join(t("sections"), "section_id").select("book_id", "section_id")),
    "passages sections",
    "SELECT book_id, count(DISTINCT section_id) AS sections, count(*) AS passages FROM passages JOIN sections USING (section_id) GROUP BY 1",
)
add(
    "e24_duplicate_keys", lambda t: E.duplicate_keys(t("lineitem"), "l_orderkey", "l_linenumber"), "",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
add(
    "e25_ids_by_category", lambda t: E.ids_by_category(t("places"), "religion", "id", per_row=25), "places",
    """WITH n AS (SELECT religion, id, (row_number() OVER (PARTITION BY religion ORDER BY id) - 1) // 25 AS batch FROM places WHERE religion IS NOT NULL)
SELECT religion, CAST(batch AS BIGINT) AS batch, string_agg(id, ',' ORDER BY id) AS ids FROM n GROUP BY 1, 2""",
)
