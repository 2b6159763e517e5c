"""Row filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfolio.catalog.registry import add, filled_sql, km, label_of
from wayfolio.operators import filters as C
from wayfolio.operators.spatial import read_places, stored_near, write_places
from wayfolio.plans.explore import category_filter, explore
from wayfolio.plans.library import passages_with_context
from wayfolio.session import scratch_path


def context(t):
    return passages_with_context(t("passages"), t("sections"), t("books"))


_CONTEXT = "passages p LEFT JOIN (SELECT s.section_id, s.chapter_number, b.* FROM sections s LEFT JOIN books b USING (book_id)) c USING (section_id)"

add(
    "c1_search_passages",
    lambda t: C.search_passages(context(t), "License", religion="de").select("section_id", "line_no", "book_id", "content"),
    "passages sections books",
    f"""SELECT p.section_id, line_no, book_id, content FROM {_CONTEXT}
WHERE contains(lower(content), 'license') AND coalesce(nullif(trim(religion), ''), 'Other / Unclassified') = 'de'
ORDER BY p.section_id, line_no LIMIT 50""",
)
add(
    "c1_search_wildcards",
    lambda t: C.search_passages(context(t), "lic_nse%apache", wildcards=True).select("section_id", "line_no", "content"),
    "passages sections books",
    "SELECT section_id, line_no, content FROM passages WHERE content ILIKE '%lic_nse%apache%' ORDER BY section_id, line_no LIMIT 50",
)
add(
    "c2_filter_any_term",
    lambda t: C.filter_any_term(t("places"), "religion", ["christian", "BUDD", "place_of"]).select("id", "religion"), "places",
    """SELECT id, religion FROM places WHERE contains(lower(religion), 'christian') OR contains(lower(religion), 'budd')
  OR contains(lower(religion), 'place_of')""",
)
add(
    "c2_category_filter", lambda t: category_filter(t("places"), "christian").select("id", "religion"), "places",
    """SELECT id, religion FROM places WHERE contains(lower(religion), 'christian') OR contains(lower(religion), 'church')
  OR contains(lower(religion), 'christianity')""",
)
add(
    "c3_facet_filter",
    lambda t: C.facet_filter(t("places"), country="NATION_1", city="All", religion=None).select("id", "country", "city"), "places",
    "SELECT id, country, city FROM places WHERE country = 'NATION_1'",
)
_HAY = "concat_ws(' ', nullif(name, ''), nullif(religion, ''), {label}, nullif(denomination, ''), nullif(country, ''), nullif(city, ''), nullif(address, ''), nullif(description, ''))"
add(
    "c4_text_match", lambda t: C.match_places(t("places"), " Sacred place ").select("id"), "places",
    f"SELECT id FROM places WHERE contains(lower({_HAY.format(label=label_of('religion'))}), 'sacred place')",
)
add(
    "c5_quality_filter", lambda t: C.quality_filter(t("places"), "image", "website", "city").select("id"), "places",
    f"SELECT id FROM places WHERE {filled_sql('image_url')} AND {filled_sql('website_url')} AND {filled_sql('city')}",
)
add(
    "c6_missing", lambda t: t("places").filter(C.missing("image_url") & F.col("latitude").isNotNull()).select("id"), "places",
    "SELECT id FROM places WHERE (image_url IS NULL OR image_url = '') AND latitude IS NOT NULL",
)
add(
    "c7_in_keys",
    lambda t: C.in_keys(t("conversation_messages"), t("conversation_messages").filter("role = 'system'"), "conv_id").select("conv_id", "turn", "role"),
    "conversation_messages",
    "SELECT conv_id, turn, role FROM conversation_messages WHERE conv_id IN (SELECT conv_id FROM conversation_messages WHERE role = 'system')",
)
add(
    "c8_within_km",
    lambda t: C.within_km(t("places"), 7.9, 29.0, 2500).select("id", F.round("distance_km", 4).alias("distance_km")), "places",
    f"SELECT id, round({km('7.9', '29.0', 'latitude', 'longitude')}, 4) AS distance_km FROM places WHERE {km('7.9', '29.0', 'latitude', 'longitude')} <= 2500",
)


def _stored_within(t, lat, lng, radius):
    path = scratch_path(t.spark, "placed")
    places = t("places").select("id", "latitude", "longitude")
    write_places(places, path)
    near = stored_near(read_places(t.spark, path, places.schema), lat, lng, radius)
    return C.within_km(near, lat, lng, radius).select("id", F.round("distance_km", 4).alias("distance_km"))


# A circle in the open, one across 180 degrees, one around a pole.
for _name, _lat, _lng, _radius in (("open", 7.9, 29.0, 2500), ("date_line", -12.0, 178.5, 4200), ("pole", 84.0, -60.0, 3000)):
    add(
        f"c8_stored_places_{_name}", lambda t, c=(_lat, _lng, _radius): _stored_within(t, *c), "places",
        f"""SELECT id, round({km(str(_lat), str(_lng), 'latitude', 'longitude')}, 4) AS distance_km FROM places
WHERE {km(str(_lat), str(_lng), 'latitude', 'longitude')} <= {_radius}""",
    )
add(
    "c8_explore",
    lambda t: explore(t("places"), search="hall", religion="Islam", quality=("description",), location=(10.0, 20.0), radius_km=9000)
    .select("id", F.round("distance_km", 4).alias("distance_km")), "places",
    f"""SELECT id, round({km('10.0', '20.0', 'latitude', 'longitude')}, 4) AS distance_km FROM places
WHERE {label_of('religion')} = 'Islam' AND {filled_sql('description')} AND {km('10.0', '20.0', 'latitude', 'longitude')} <= 9000
  AND contains(lower({_HAY.format(label=label_of('religion'))}), 'hall')""",
)
add("c9_visible_to", lambda t: C.visible_to(t("reminders"), 8).select("id", "title"), "reminders", "SELECT id, title FROM reminders WHERE user_id = 8")
add(
    "c10_visible_via_parent",
    lambda t: C.visible_via_parent(
        t("conversation_messages").drop("user_id"), t("conversation_messages").filter("turn = 0"), "conv_id", "conv_id", 7
    ).select("conv_id", "turn", "content"),
    "conversation_messages",
    """SELECT conv_id, turn, content FROM conversation_messages m
WHERE EXISTS (SELECT 1 FROM conversation_messages p WHERE p.turn = 0 AND p.conv_id = m.conv_id AND p.user_id = 7)""",
)
add("c11_approved", lambda t: C.approved(t("reviews")).select("review_id", "place_id"), "reviews", "SELECT review_id, place_id FROM reviews WHERE is_approved")
add(
    "c12_violations",
    lambda t: C.violations(
        t("conversation_messages").withColumn("key", F.concat_ws("/", "conv_id", "turn")), "key",
        {
            "role_known": F.col("role").isin("user", "assistant"),
            "content_present": F.length(F.trim("content")) > 0,
            "content_short": F.length("content") <= 1000,
        },
    ),
    "conversation_messages",
    """WITH m AS (SELECT conv_id || '/' || turn AS key, * FROM conversation_messages)
SELECT key, 'role_known' AS rule FROM m WHERE role NOT IN ('user', 'assistant')
UNION ALL SELECT key, 'content_present' FROM m WHERE NOT (length(trim(content)) > 0)
UNION ALL SELECT key, 'content_short' FROM m WHERE NOT (length(content) <= 1000)""",
)
add(
    "c12_frequency_violations",
    lambda t: C.violations(
        t("reminders"), "id",
        {"frequency_known": F.col("frequency").isin("once", "daily", "weekly", "monthly"), "title_present": F.col("title").isNotNull()},
    ),
    "reminders",
    "SELECT id, 'frequency_known' AS rule FROM reminders WHERE frequency NOT IN ('once', 'daily', 'weekly', 'monthly')",
)
_FORBIDDEN = "(?i)licen[cs]ed? under|all rights reserved|copyright"
add(
    "c13_forbidden_hits",
    lambda t: C.forbidden_hits(t("passages"), "content", _FORBIDDEN).select("section_id", "line_no", "hit"), "passages",
    f"""SELECT section_id, line_no, regexp_extract(content, '{_FORBIDDEN}') AS hit FROM passages
WHERE regexp_matches(content, '{_FORBIDDEN}')""",
)
_NOISE = ["(?i)licen[cs]e", "^All rights", "^\\S+\\.$", "^(Of|The) "]
add(
    "c14_drop_noise", lambda t: C.drop_noise(t("passages"), "content", _NOISE).select("section_id", "line_no"), "passages",
    "SELECT section_id, line_no FROM passages WHERE length(trim(content)) > 0 AND NOT ("
    + " OR ".join(f"regexp_matches(content, '{p}')" for p in _NOISE) + ")",
)
