"""Joins, merges, ingest and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfolio.catalog.registry import COORDINATE, EXTERNAL, LOCATION, NAMED, POINT, add, filled_sql, km, name_of
from wayfolio.catalog.scalar_queries import (
    CATEGORY, EL_NAME, EL_TYPE, IMAGE, QID, REF, SKIP, STREET, WEBSITE, address, cases, description, first_of, tag, url,
)
from wayfolio.lookups import CITY_TAGS, FILLABLE_COLUMNS, STRICT_LABELS
from wayfolio.operators import dedupe as D
from wayfolio.operators import merge as M
from wayfolio.operators.geo import nearest, nearest_each, places_around
from wayfolio.operators.ordered import first_per_key
from wayfolio.plans import ingest as I
from wayfolio.plans import library as L
from wayfolio.plans.conversations import recent_with_messages
from wayfolio.sources.json_rows import entity_metadata, read_geo_elements


def tagged_elements(t):
    return I.parse_elements(read_geo_elements(t("elements_json")), t("targets"))


def deduped_elements(t):
    """Parsed elements with their final outcome: rejected, accepted or a duplicate of an earlier one."""
    tagged = tagged_elements(t)
    taken = D.dedupe_incoming(tagged.filter("outcome = 'candidate'").drop("outcome"), None, I.three_keys())
    return taken.select("target_id", "outcome").unionByName(tagged.filter("outcome <> 'candidate'").select("target_id", "outcome"))


COORDS = (
    "CAST(coalesce(json_extract(json, '$.lat'), json_extract(json, '$.center.lat')) AS DOUBLE) AS latitude, "
    "CAST(coalesce(json_extract(json, '$.lon'), json_extract(json, '$.center.lon')) AS DOUBLE) AS longitude"
)
OUTCOME_SQL = f"""located AS (SELECT e.*, {COORDS}, t.name AS target_name, t.country AS target_country FROM elements_json e LEFT JOIN targets t USING (target_id)),
tagged AS (SELECT *, CASE WHEN {EL_NAME} IS NULL THEN 'unnamed' WHEN {SKIP} THEN 'generic'
  WHEN latitude IS NULL OR longitude IS NULL THEN 'no_coordinates' ELSE 'candidate' END AS outcome FROM located)"""
_CITY = first_of(CITY_TAGS, "target_name")
_COUNTRY = f"coalesce(nullif({tag('addr:country')}, ''), target_country)"
PARSED_SQL = f"""{OUTCOME_SQL}, parsed AS (SELECT arrival, target_id, outcome, {EL_NAME} AS name, {CATEGORY} AS religion, {EL_TYPE} AS denomination,
  {_COUNTRY} AS country, {_CITY} AS city, {address(_CITY, _COUNTRY)} AS address,
  {description(EL_TYPE, CATEGORY, _CITY, _COUNTRY)} AS description, latitude, longitude, {WEBSITE} AS website_url,
  {url(tag('image'))} AS image_url, {REF} AS external_id, 'openstreetmap' AS source FROM tagged)"""
#: The sequential rule: a candidate is taken if none of its keys is claimed, and then claims them.
WALK_SQL = f"""{PARSED_SQL},
keyed AS (SELECT row_number() OVER (ORDER BY arrival) AS n, arrival, name, city, country, external_id,
  list_filter(['e:' || ({EXTERNAL}), 'l:' || ({LOCATION}), 'c:' || ({COORDINATE})], lambda x: x IS NOT NULL) AS keys FROM parsed WHERE outcome = 'candidate'),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS claimed, false AS taken
  UNION ALL
  SELECT k.n, CASE WHEN list_has_any(k.keys, w.claimed) THEN w.claimed ELSE list_concat(w.claimed, k.keys) END, NOT list_has_any(k.keys, w.claimed)
  FROM walk w JOIN keyed k ON k.n = w.n + 1)"""
_PARSED = (
    "arrival", "target_id", "outcome", "name", "religion", "denomination", "country", "city", "address", "description",
    "latitude", "longitude", "website_url", "image_url", "external_id", "source",
)
add(
    "a3_parse_elements", lambda t: tagged_elements(t).select(*_PARSED), "elements_json targets", f"WITH {PARSED_SQL} SELECT * FROM parsed"
)

# --- reading joins --------------------------------------------------------------------

add(
    "d1_passages_with_context",
    lambda t: L.passages_with_context(t("passages_h"), t("sections_h"), t("books_h")).select(
        "section_id", "verse_number", "content", "chapter_number", "title", "religion"
    ),
    "passages_h sections_h books_h",
    """SELECT section_id, verse_number, content, chapter_number, title, religion
FROM passages_h LEFT JOIN (SELECT * FROM sections_h LEFT JOIN books_h USING (book_id)) USING (section_id)""",
)
add(
    "d2_favorites_with_passage",
    lambda t: L.favorites_with_passage(t("favorites"), t("passages_h"), t("sections_h")).select(
        "favorite_id", "user_id", "section_id", "verse_number", "content", "chapter_number"
    ),
    "favorites passages_h sections_h",
    """SELECT favorite_id, user_id, f.section_id, f.verse_number, content, chapter_number FROM favorites f
LEFT JOIN passages_h p ON p.section_id = f.section_id AND p.verse_number = f.verse_number
LEFT JOIN sections_h s ON s.section_id = f.section_id""",
)
add(
    "d2_favorites_of_user",
    lambda t: L.favorites_with_passage(t("favorites"), t("passages_h"), t("sections_h"), user=8, limit=5).select("favorite_id", "section_id", "content"),
    "favorites passages_h sections_h",
    """SELECT favorite_id, f.section_id, content FROM favorites f
LEFT JOIN passages_h p ON p.section_id = f.section_id AND p.verse_number = f.verse_number
WHERE user_id = 8 ORDER BY created_at DESC, favorite_id, content ASC NULLS LAST LIMIT 5""",
)
add(
    "d3_with_parent",
    lambda t: L.with_parent(t("customer"), t("nation"), "c_nationkey", "n_nationkey").select("c_custkey", "c_name", "n_name"), "",
    "SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
add(
    "d4_children",
    lambda t: L.children(t("sections_h"), "book_id", 10, [*L.reading_order(), F.asc("section_id")]).select("section_id", "chapter_number"),
    "sections_h", "SELECT section_id, chapter_number FROM sections_h WHERE book_id = 10",
)
add(
    "d5_recent_with_messages",
    lambda t: recent_with_messages(t("conversation_messages").filter("turn = 0"), t("conversation_messages")).select("conv_id", "turn", "role"),
    "conversation_messages",
    """SELECT conv_id, turn, role FROM conversation_messages WHERE conv_id IN
  (SELECT conv_id FROM conversation_messages WHERE turn = 0 ORDER BY conv_id DESC LIMIT 50)""",
)

# --- deduplication --------------------------------------------------------------------


def _greedy_sql(keys: dict[str, str]) -> str:
    """The sequential rule, one incoming row per recursion step, with the claimed keys as state."""
    listed = ", ".join(f"'{k}:' || ({v})" for k, v in keys.items())
    return f"""WITH RECURSIVE known AS (SELECT list_distinct(flatten(list(list_filter([{listed}], lambda x: x IS NOT NULL)))) AS keys FROM places_existing),
incoming AS (SELECT row_number() OVER (ORDER BY arrival) AS n, arrival, list_filter([{listed}], lambda x: x IS NOT NULL) AS keys FROM places_incoming),
checked AS (SELECT i.n, i.arrival, i.keys, list_has_any(i.keys, k.keys) AS is_known FROM incoming i, known k),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS arrival, CAST([] AS VARCHAR[]) AS claimed, CAST(NULL AS VARCHAR) AS outcome
  UNION ALL
  SELECT c.n, c.arrival,
    CASE WHEN c.is_known OR list_has_any(c.keys, w.claimed) THEN w.claimed ELSE list_concat(w.claimed, c.keys) END,
    CASE WHEN c.is_known THEN 'duplicate_existing' WHEN list_has_any(c.keys, w.claimed) THEN 'duplicate_batch' ELSE 'accepted' END
  FROM walk w JOIN checked c ON c.n = w.n + 1)
SELECT arrival, outcome FROM walk WHERE n > 0"""


add(
    "d6_dedupe_three_keys",
    lambda t: D.dedupe_incoming(t("places_incoming"), t("places_existing"), I.three_keys()).select("arrival", "outcome"),
    "places_existing places_incoming", _greedy_sql({"external": EXTERNAL, "location": LOCATION, "coordinates": COORDINATE}),
)
add(
    "d6_dedupe_whole_table",
    lambda t: D.accepted_rows(D.dedupe_incoming(t("places"), None, I.three_keys())).select("id", "name", "city", "country"),
    "places",
    f"""WITH RECURSIVE keyed AS (SELECT row_number() OVER (ORDER BY arrival) AS n, id, name, city, country,
  list_filter(['e:' || ({EXTERNAL}), 'l:' || ({LOCATION}), 'c:' || ({COORDINATE})], lambda x: x IS NOT NULL) AS keys FROM places),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS claimed, false AS taken
  UNION ALL
  SELECT k.n, CASE WHEN list_has_any(k.keys, w.claimed) THEN w.claimed ELSE list_concat(w.claimed, k.keys) END, NOT list_has_any(k.keys, w.claimed)
  FROM walk w JOIN keyed k ON k.n = w.n + 1)
SELECT id, name, city, country FROM keyed JOIN walk USING (n) WHERE taken""",
)
add(
    "d7_dedupe_two_keys",
    lambda t: D.dedupe_incoming(t("places_incoming"), t("places_existing"), I.two_keys()).select("arrival", "outcome"),
    "places_existing places_incoming", _greedy_sql({"location": NAMED, "coordinates": POINT}),
)

_FIELDS = ", ".join(FILLABLE_COLUMNS)
_FILL = ", ".join(
    f"coalesce(first(nullif({c}, '') ORDER BY turn) FILTER (WHERE nullif({c}, '') IS NOT NULL), first({c} ORDER BY turn)) AS {c}"
    for c in FILLABLE_COLUMNS
)
_REST = ", ".join(f"first({c} ORDER BY turn) AS {c}" for c in ("id", "name", "latitude", "longitude"))
_GAINED = " OR ".join(
    f"(min(CASE WHEN turn = -1 AND {filled_sql(c)} THEN {c} END) IS NULL AND max(CASE WHEN {filled_sql(c)} THEN {c} END) IS NOT NULL)"
    for c in FILLABLE_COLUMNS
)
add(
    "d8_merge_fill_missing",
    lambda t: M.merge_fill_missing(t("places_existing"), t("places_incoming"), I.one_key()).select(
        "id", "name", "latitude", "longitude", *FILLABLE_COLUMNS, "action"
    ),
    "places_existing places_incoming",
    f"""WITH stored AS (SELECT *, {POINT} AS k FROM places_existing),
last AS (SELECT k, max(id) AS id FROM stored WHERE k IS NOT NULL GROUP BY k),
pool AS (SELECT s.*, CAST(-1 AS BIGINT) AS turn FROM stored s JOIN last USING (k, id)
  UNION ALL SELECT *, {POINT} AS k, arrival AS turn FROM places_incoming WHERE {POINT} IS NOT NULL)
SELECT {_REST}, {_FILL}, CASE WHEN min(turn) >= 0 THEN 'inserted' WHEN {_GAINED} THEN 'updated' ELSE 'kept' END AS action FROM pool GROUP BY k
UNION ALL SELECT id, name, latitude, longitude, {_FIELDS}, 'kept' FROM stored WHERE (k, id) NOT IN (SELECT (k, id) FROM last) OR k IS NULL""",
)
add(
    "d9_insert_if_absent",
    lambda t: M.insert_if_absent(
        t("calendar").filter("id % 4 = 0"), t("calendar").filter("id % 4 <> 0"), ["title", "event_date", "religion"]
    ).select("id", "title", "religion"),
    "calendar",
    """SELECT id, title, religion FROM calendar c WHERE id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM calendar e
  WHERE (e.id % 4 <> 0 OR e.id < c.id) AND e.title = c.title AND e.event_date = c.event_date AND e.religion = c.religion)""",
)
_SEED = ("id", "name", "city", "country", "image_url")
add(
    "d10_seed_merge",
    lambda t: M.seed_merge(
        t("places_existing").select(*_SEED), t("places_incoming").select(*_SEED).withColumn("image_url", F.when(F.col("id") % 3 > 0, F.concat(F.lit("seed-"), "id"))),
        ["name", "city", "country"], "image_url",
    ),
    "places_existing places_incoming",
    """WITH seeds AS (SELECT id, name, city, country, CASE WHEN id % 3 > 0 THEN 'seed-' || id END AS image_url FROM places_incoming),
first AS (SELECT name, city, country, arg_min(image_url, id) FILTER (WHERE image_url IS NOT NULL) AS seed FROM seeds GROUP BY 1, 2, 3),
all_rows AS (SELECT id, name, city, country, image_url FROM places_existing
UNION ALL SELECT * FROM seeds s WHERE NOT EXISTS (SELECT 1 FROM places_existing e WHERE e.name = s.name AND e.city = s.city AND e.country = s.country)
  AND NOT EXISTS (SELECT 1 FROM seeds b WHERE b.id < s.id AND b.name = s.name AND b.city = s.city AND b.country = s.country))
SELECT e.id, e.name, e.city, e.country, coalesce(nullif(e.image_url, ''), seed, e.image_url) AS image_url
FROM all_rows e LEFT JOIN first f ON e.name = f.name AND e.city = f.city AND e.country = f.country""",
)
add(
    "d11_upsert",
    lambda t: M.upsert(
        t("reminders").filter("id % 2 = 0").select("user_id", "title", "reminder_time").transform(
            lambda d: first_per_key(d, ["user_id"], [F.desc("reminder_time")])
        ),
        t("reminders").filter("id % 2 = 1").select("user_id", "title", "reminder_time"), "user_id", "reminder_time",
    ),
    "reminders",
    """WITH old AS (SELECT user_id, title, reminder_time, 0 AS side FROM reminders WHERE id % 2 = 0),
new AS (SELECT user_id, title, reminder_time, 1 AS side FROM reminders WHERE id % 2 = 1),
both_sides AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY side DESC, reminder_time DESC) AS n FROM (SELECT * FROM old UNION ALL SELECT * FROM new))
SELECT user_id, title, reminder_time FROM both_sides WHERE n = 1""",
)
add(
    "d11_upsert_patch",
    lambda t: M.upsert(
        t("places_existing").select("id", "name", "city", F.col("arrival").alias("version")),
        t("places").filter("id % 5 = 0").select(
            "id", F.when(F.col("id") % 2 == 0, F.upper("name")).alias("name"), F.lit(None).cast("string").alias("city"), (F.col("arrival") + 1).alias("version")
        ).unionByName(t("places").filter("id % 15 = 0").select(
            "id", F.lit(None).cast("string").alias("name"), F.upper("city").alias("city"), (F.col("arrival") + 2).alias("version")
        )),
        "id", "version", patch=True,
    ),
    "places_existing",
    """WITH changes AS (SELECT id, CASE WHEN id % 2 = 0 THEN upper(name) END AS name, CAST(NULL AS VARCHAR) AS city, arrival + 1 AS version FROM places WHERE id % 5 = 0
  UNION ALL SELECT id, NULL, upper(city), arrival + 2 FROM places WHERE id % 15 = 0),
c AS (SELECT id, arg_max(name, version) FILTER (WHERE name IS NOT NULL) AS name, arg_max(city, version) FILTER (WHERE city IS NOT NULL) AS city,
  max(version) AS version FROM changes GROUP BY id)
SELECT coalesce(c.id, t.id) AS id, coalesce(c.name, t.name) AS name, coalesce(c.city, t.city) AS city, coalesce(c.version, t.arrival) AS version
FROM places_existing t FULL JOIN c ON c.id = t.id""",
)
add(
    "d12_insert_ignore",
    lambda t: D.insert_ignore(t("places_incoming"), t("places_existing"), ["name", "city", "country"]).select("id", "name", "city", "country"),
    "places_existing places_incoming",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY lower(coalesce(name, 'null') || '|' || coalesce(city, 'null') || '|' || coalesce(country, 'null')) ORDER BY arrival) AS n FROM places_incoming)
SELECT id, name, city, country FROM n WHERE n = 1 AND NOT EXISTS
  (SELECT 1 FROM places_existing e WHERE e.name = n.name AND e.city = n.city AND e.country = n.country)""",
)

# --- distance -------------------------------------------------------------------------

for _km, _cap in ((12, 300), (3000, 40)):
    add(
        f"d13_places_around_{_km}",
        lambda t, r=_km, c=_cap: places_around(
            t("targets").select("target_id", "lat", "lng"), t("places").select("id", "latitude", "longitude"), r, c
        ).select("target_id", "id", F.round("distance_km", 4).alias("distance_km")),
        "targets places",
        f"""WITH pairs AS (SELECT target_id, id, {km('lat', 'lng', 'latitude', 'longitude')} AS d FROM targets, places
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY id) AS n FROM pairs WHERE d <= {_km})
SELECT target_id, id, round(d, 4) AS distance_km FROM ranked WHERE n <= {_cap}""",
    )

_OFFERS = f"SELECT arrival, {COORDS}, {IMAGE} AS image, {QID} AS qid, list_filter([{', '.join(name_of(tag(x)) for x in ('name', 'name:en'))}], lambda n: n <> '') AS names FROM elements_json"
_BEST = f"""offers AS ({_OFFERS}),
pairs AS (SELECT p.id, p.name, o.arrival, o.image, o.qid, o.names, {km('p.latitude', 'p.longitude', 'o.latitude', 'o.longitude')} AS d
  FROM places p, offers o WHERE p.latitude IS NOT NULL AND p.longitude IS NOT NULL AND o.latitude IS NOT NULL AND o.longitude IS NOT NULL),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival) AS n FROM pairs WHERE d <= 0.25),
scored AS (SELECT *, CASE WHEN {name_of('name')} = '' OR len(names) = 0 THEN 0 WHEN list_contains(names, {name_of('name')}) THEN 3
  WHEN len(list_filter(names, lambda x: contains(x, {name_of('name')}) OR contains({name_of('name')}, x))) > 0 THEN 2 ELSE 0 END AS score
  FROM near WHERE n <= 25 AND (image IS NOT NULL OR qid IS NOT NULL)),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, arrival) AS r FROM scored)"""


def _candidates(t):
    return I.best_candidate(t("places"), read_geo_elements(t("elements_json")))


add(
    "d14_best_candidate", lambda t: _candidates(t), "places elements_json",
    f"WITH {_BEST} SELECT id, arrival, CAST(score AS INTEGER) AS score, image AS element_image, qid FROM best WHERE r = 1",
)
_ENTITY_IMAGE = "'https://commons.wikimedia.org/wiki/Special:FilePath/' || replace(json_extract_string(json, '$.claims.P18[0].mainsnak.datavalue.value'), ' ', '%20') || '?width=1200'"
add(
    "d15_resolve_image",
    lambda t: I.resolve_image(
        t("places"), _candidates(t), entity_metadata(t("entities_json")),
        t("places").filter("id % 5 = 0").select("id", F.concat(F.lit("https://found.example/"), "id").alias("image_url")),
    ),
    "places elements_json entities_json",
    f"""WITH {_BEST}, e AS (SELECT qid, {_ENTITY_IMAGE} AS entity_image FROM entities_json),
x AS (SELECT p.id, b.image, e.entity_image, CASE WHEN p.id % 5 = 0 THEN 'https://found.example/' || p.id END AS found
  FROM places p LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON b.id = p.id LEFT JOIN e ON e.qid = b.qid)
SELECT id, coalesce(image, entity_image, found) AS image_url, CASE WHEN image IS NOT NULL THEN 'OpenStreetMap'
  WHEN entity_image IS NOT NULL THEN 'OSM Wikidata tag' WHEN found IS NOT NULL THEN 'Wikidata search' END AS image_source FROM x""",
)
_EL_CITY5 = "coalesce(" + ", ".join(f"nullif({tag(x)}, '')" for x in CITY_TAGS[:5]) + ")"
_EL_NAME4 = f"coalesce(nullif({tag('name')}, ''), nullif({tag('name:en')}, ''))"
_STRICT = cases(STRICT_LABELS, "lower(" + tag("religion") + ")")
add(
    "d16_area_elements",
    lambda t: I.parse_area_elements(read_geo_elements(t("elements_json")), entity_metadata(t("entities_json")), F.lit("Freeland")),
    "elements_json entities_json",
    f"""WITH ent AS (SELECT qid, json_extract_string(json, '$.descriptions.en.value') AS description, {_ENTITY_IMAGE} AS image_url,
  json_extract_string(json, '$.claims.P856[0].mainsnak.datavalue.value') AS website_url FROM entities_json),
el AS (SELECT *, {COORDS}, {_EL_NAME4} AS name, {_STRICT} AS religion, {_EL_CITY5} AS city, {QID} AS qid FROM elements_json)
SELECT arrival, name, religion, CAST(NULL AS VARCHAR) AS denomination, 'Freeland' AS country, city,
  concat_ws(', ', nullif({STREET}, ''), city, 'Freeland') AS address, latitude, longitude,
  coalesce(ent.description, 'OpenStreetMap place of worship: ' || religion || ' in ' || concat_ws(', ', city, 'Freeland') || '. OSM ' || {REF} || '.') AS description,
  coalesce({IMAGE}, ent.image_url) AS image_url, coalesce({WEBSITE}, ent.website_url) AS website_url
FROM el LEFT JOIN ent USING (qid) WHERE name IS NOT NULL AND religion IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL""",
)
add(
    "d16_with_entity_metadata",
    lambda t: I.with_entity_metadata(
        t("places").select("id", F.concat(F.lit("Q"), (F.col("id") % 120).cast("string")).alias("qid")), entity_metadata(t("entities_json"))
    ).select("id", "entity_description", "entity_website"),
    "places entities_json",
    """SELECT p.id, json_extract_string(json, '$.descriptions.en.value') AS entity_description,
  json_extract_string(json, '$.claims.P856[0].mainsnak.datavalue.value') AS entity_website
FROM places p LEFT JOIN entities_json e ON e.qid = 'Q' || (p.id % 120)""",
)
add(
    "d17_fill_if_missing",
    lambda t: M.fill_if_missing(
        t("places").select("id", "image_url"),
        t("places").filter("id % 3 = 0").select("id", F.concat(F.lit("https://new.example/"), "id").alias("image_url")), "id", "image_url",
    ),
    "places",
    f"""SELECT id, CASE WHEN {filled_sql('image_url')} THEN image_url WHEN id % 3 = 0 THEN 'https://new.example/' || id ELSE image_url END AS image_url FROM places""",
)
add(
    "d18_select_targets", lambda t: I.select_targets(t("targets"), ["city 3", "CITY-5", "Atlantis"])[0], "targets",
    "SELECT * FROM targets WHERE name IN ('City 3', 'City 5')",
)
add(
    "d18_unknown_targets", lambda t: I.select_targets(t("targets"), ["city 3", "CITY-5", "Atlantis"])[1], "targets",
    "SELECT 'Atlantis' AS requested WHERE NOT EXISTS (SELECT 1 FROM targets WHERE name = 'Atlantis')",
)


def _progress(t):
    return t("targets").filter("target_id % 3 <> 0").select(
        "target_id", F.when(F.col("target_id") % 3 == 1, "completed").otherwise("running").alias("status")
    )


add(
    "d19_pending", lambda t: I.pending(t("targets"), _progress(t), 5).select("target_id", "name", "status"), "targets",
    """SELECT target_id, name, CASE WHEN target_id % 3 = 2 THEN 'running' END AS status FROM targets
WHERE target_id % 3 <> 1 ORDER BY target_id LIMIT 5""",
)
add(
    "d20_membership",
    lambda t: M.membership(t("reviews").select("review_id", "user_id", F.col("place_id").alias("section_id")),
                           t("favorites").select("user_id", "section_id"), ["user_id", "section_id"]),
    "reviews favorites",
    """SELECT review_id, user_id, place_id AS section_id,
  EXISTS (SELECT 1 FROM favorites f WHERE f.user_id = r.user_id AND f.section_id = r.place_id) AS is_member FROM reviews r""",
)
add(
    "d20_toggle",
    lambda t: M.toggle(
        t("reviews").filter("review_id % 2 = 0").select("user_id", "place_id"),
        t("reviews").filter("review_id % 3 = 0").select("user_id", "place_id"), ["user_id", "place_id"],
    ),
    "reviews",
    """WITH a AS (SELECT DISTINCT user_id, place_id FROM reviews WHERE review_id % 2 = 0),
b AS (SELECT user_id, place_id FROM reviews WHERE review_id % 3 = 0 GROUP BY ALL HAVING count(*) % 2 = 1)
(SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)

# --- loads ----------------------------------------------------------------------------


def _existing_sections(t):
    return t("sections_h").filter("section_id % 3 <> 0")


add(
    "d21_load_sections",
    lambda t: L.load_sections(
        t("sections_h").select("book_id", "chapter_number"), _existing_sections(t), t("passages_h").filter("section_id % 3 = 1"),
    ).select("book_id", "chapter_number", "action"),
    "sections_h passages_h",
    """SELECT book_id, chapter_number, CASE WHEN section_id % 3 = 0 THEN 'insert'
  WHEN section_id % 3 = 1 AND section_id IN (SELECT section_id FROM passages_h) THEN 'keep' ELSE 'fill' END AS action FROM sections_h""",
)


def _repair(t):
    # Chapters folded three to one, so that a number has several stored versions.
    stored = t("sections_h").withColumn("chapter_number", F.ceil(F.col("chapter_number") / 3))
    expected = stored.select("book_id", "chapter_number", F.lit(4).alias("expected")).distinct()
    return L.repair_sections(expected, stored, t("passages_h"))


add(
    "d22_repair_sections", lambda t: _repair(t).select("section_id", "stored", "action"), "sections_h passages_h",
    """WITH s AS (SELECT section_id, book_id, (chapter_number + 2) // 3 AS n, created_at FROM sections_h),
c AS (SELECT s.*, (SELECT count(*) FROM passages_h p WHERE p.section_id = s.section_id) AS stored FROM s),
r AS (SELECT section_id, row_number() OVER (PARTITION BY book_id, n ORDER BY created_at, section_id) AS k FROM c WHERE stored = 4)
SELECT section_id, stored, CASE WHEN section_id IN (SELECT section_id FROM r WHERE k = 1) THEN 'keep' ELSE 'drop' END AS action FROM c""",
)
add(
    "d23_ensure_book",
    lambda t: L.ensure_book(
        t("books").select("book_id", "title", "religion"), t("books").filter("book_id < 'src3'").select("book_id", "title", F.lit("kept").alias("religion"))
    ),
    "books", "SELECT book_id, title, CASE WHEN book_id < 'src3' THEN 'kept' ELSE religion END AS religion FROM books",
)
add(
    "f10_nearest", lambda t: nearest(t("places"), 12.5, 77.5, 6).select("id", F.round("distance_km", 4).alias("distance_km")), "places",
    f"""SELECT id, round(d, 4) AS distance_km FROM (SELECT id, round({km('12.5', '77.5', 'latitude', 'longitude')}, 6) AS d FROM places
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL) ORDER BY d, id LIMIT 6""",
)
add(
    "f10_nearest_each",
    lambda t: nearest_each(
        t("targets").select("target_id", (F.col("lat") + 0.01).alias("lat"), "lng"), t("places").select("id", "latitude", "longitude"),
        6, "target_id",
    ).select("target_id", "id", "nearest_rank", F.round("distance_km", 4).alias("distance_km")),
    "targets places",
    f"""WITH pairs AS (SELECT target_id, id, round({km('(lat + 0.01)', 'lng', 'latitude', 'longitude')}, 6) AS d FROM targets, places
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY d, id) AS nearest_rank FROM pairs)
SELECT target_id, id, nearest_rank, round(d, 4) AS distance_km FROM r WHERE nearest_rank <= 6""",
)
add(
    "f7_first_per_key", lambda t: first_per_key(t("places").select("id", "name", "arrival"), ["name"], ["arrival"]).select("id", "name"), "places",
    "SELECT min(id) AS id, name FROM places GROUP BY name",
)
