"""Sorts, limits, pages, worklists and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfolio.catalog.registry import SCORE, add, filled_sql, key_of, km
from wayfolio.plans import audit as A
from wayfolio.plans.corpus import set_diff
from wayfolio.operators.ordered import ordered
from wayfolio.plans.explore import explore, explore_sort, page, upcoming_sort
from wayfolio.plans.ingest import capped_fill, missing_image_worklist
from wayfolio.plans.library import reading_order

add(
    "g1_order_nulls",
    lambda t: ordered(t("books"), ["religion", "title", "book_id"]).select("book_id", "religion", "title", "position"),
    "books",
    "SELECT book_id, religion, title, row_number() OVER (ORDER BY religion ASC NULLS LAST, title NULLS LAST, book_id) AS position FROM books",
)
_NAME = "coalesce(nullif(name, ''), 'Unnamed temple')"
_DISTANCE = f"round({km('12.0', '77.0', 'latitude', 'longitude')}, 6)"
for _mode, _order in (
    ("quality", f"{SCORE} DESC, {_NAME}, id"), ("name", f"{_NAME}, id"), ("nearest", f"{_DISTANCE} ASC NULLS LAST, {_NAME}, id"),
):
    add(
        f"g2_sort_{_mode}",
        lambda t, mode=_mode: (lambda df: ordered(df, explore_sort(df, mode)).select("id", "name", "position"))(
            explore(t("places"), location=(12.0, 77.0))
        ),
        "places", f"SELECT id, name, row_number() OVER (ORDER BY {_order}) AS position FROM places",
    )
add(
    "g3_page", lambda t: (lambda df: page(df, explore_sort(df, "quality"), 3).select("id", "name"))(explore(t("places"))), "places",
    f"SELECT id, name FROM places ORDER BY {SCORE} DESC, {_NAME}, id LIMIT 24 OFFSET 48",
)
add(
    "g3_page_past_end", lambda t: (lambda df: page(df, explore_sort(df, "name"), 10 ** 6, shallow=100).select("id", "name"))(explore(t("places"))), "places",
    f"""WITH n AS (SELECT id, name, row_number() OVER (ORDER BY {_NAME}, id) AS n, count(*) OVER () AS total FROM places)
SELECT id, name FROM n WHERE n > ((total - 1) // 24) * 24""",
)
_SHOWN = f"SELECT {SCORE} AS quality_score, id, name, city, country, religion FROM places"
_TIES = f"{key_of('name')}, id LIMIT 20"
add("g4_top_quality", lambda t: A.by_quality(t("places")), "places", f"{_SHOWN} ORDER BY {SCORE} DESC, {_TIES}")
add("g4_bottom_quality", lambda t: A.by_quality(t("places"), highest=False), "places", f"{_SHOWN} ORDER BY {SCORE}, {_TIES}")
for _column in ("image_url", "website_url"):
    add(
        f"g5_enrichment_{_column}", lambda t, c=_column: A.enrichment_candidates(t("places"), c), "places",
        f"""{_SHOWN} WHERE {filled_sql('name')} AND ({filled_sql('city')} OR {filled_sql('country')}) AND NOT {filled_sql(_column)}
ORDER BY {SCORE} DESC, {_TIES}""",
    )
add(
    "g6_upcoming_first",
    lambda t: ordered(t("calendar"), upcoming_sort("2024-01-05"))
    .select("id", "title", F.col("event_date").cast("string").alias("event_date"), "position"),
    "calendar",
    """SELECT id, title, CAST(event_date AS VARCHAR) AS event_date,
  row_number() OVER (ORDER BY event_date < DATE '2024-01-05', event_date, id) AS position FROM calendar""",
)
add(
    "g7_reading_order",
    lambda t: ordered(t("sections_h"), [F.asc("book_id"), *reading_order(), F.asc("section_id")])
    .select("book_id", "section_id", "chapter_number", "position"),
    "sections_h",
    """SELECT book_id, section_id, chapter_number,
  row_number() OVER (ORDER BY book_id, sort_order ASC NULLS LAST, coalesce(chapter_number, 0), section_id) AS position FROM sections_h""",
)
add(
    "g8_capped_fill",
    lambda t: capped_fill(t("places").filter("religion is not null"), "religion", "id", 7, 50).select("religion", "id"), "places",
    """WITH n AS (SELECT religion, id, row_number() OVER (PARTITION BY religion ORDER BY id) AS n FROM places WHERE religion IS NOT NULL)
SELECT religion, id FROM n WHERE n <= 7 ORDER BY religion, id LIMIT 50""",
)
add(
    "h1_set_diff",
    lambda t: set_diff(
        t("sections_h").select("book_id"), t("books_h").filter("public_domain").select("book_id"), ["book_id"]
    ),
    "books_h sections_h",
    """SELECT book_id, 'missing' AS state FROM (SELECT book_id FROM books_h WHERE public_domain EXCEPT SELECT book_id FROM sections_h)
UNION ALL SELECT book_id, 'unexpected' FROM (SELECT book_id FROM sections_h EXCEPT SELECT book_id FROM books_h WHERE public_domain)""",
)
add(
    "h2_missing_image_worklist", lambda t: missing_image_worklist(t("places"), 900).select("pass", "id", "name"), "places",
    """SELECT CASE WHEN image_url IS NULL THEN 1 ELSE 2 END AS pass, id, name FROM places WHERE coalesce(image_url, '') = ''
ORDER BY pass, name ASC NULLS LAST, id LIMIT 900""",
)
