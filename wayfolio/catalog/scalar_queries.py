"""Column functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfolio.catalog.registry import (
    GENERIC, SCORE, add, cell_of, display_of, filled_sql, key_of, km, label_of, name_of, similar_of, sq, sql_list, words_up,
)
from wayfolio.functions import books as B
from wayfolio.functions import places as P
from wayfolio.functions import text as T
from wayfolio.lookups import (
    BUILDING_LABELS, CATEGORY_ALIASES, CITY_TAGS, IDENTIFYING_TAGS, NAMED_ENTITIES, NAME_TAGS,
    ORDINALS, PHONE_TAGS, SEARCH_STOP_WORDS, SELECTION_SIGNALS, STRICT_LABELS, TAG_LABELS, TYPE_TAGS,
    TAG_FALLBACK, UNSPECIFIC_SEARCH_TERMS,
)
from wayfolio.sources.json_rows import read_bindings, read_geo_elements


def elements(t):
    return read_geo_elements(t("elements_json"))


def tag(name: str) -> str:
    return f"json_extract_string(json, '$.tags.\"{name}\"')"


def first_of(tags, *more: str) -> str:
    parts = [f"nullif({tag(x)}, '')" for x in tags] + list(more)
    return f"nullif(trim(regexp_replace(coalesce({', '.join(parts)}), '\\s+', ' ', 'g')), '')"


def cases(pairs: dict, key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN {sq(k)} THEN {sq(v)}" for k, v in pairs.items()) + " END"


def url(c: str) -> str:
    one = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN regexp_matches({one}, '(?i)^https?://') THEN {one} END"


def file_of(c: str) -> str:
    name = f"regexp_replace(regexp_replace(trim({c}), '(?i)^File:', ''), '(?i)^Image:', '')"
    return (
        f"CASE WHEN regexp_matches({c}, '(?i)^(File|Image):') AND {name} <> '' AND NOT regexp_matches({name}, '(?i)^Category:') "
        f"THEN 'https://commons.wikimedia.org/wiki/Special:FilePath/' || replace({name}, ' ', '%20') || '?width=1200' END"
    )


IMAGE = f"coalesce({url(tag('image'))}, {file_of(tag('image'))}, {file_of(tag('wikimedia_commons'))})"
WEBSITE = f"coalesce({url(tag('website'))}, {url(tag('contact:website'))}, {url(tag('url'))})"
QID = f"CASE WHEN regexp_matches(trim({tag('wikidata')}), '(?i)^Q[0-9]+$') THEN upper(trim({tag('wikidata')})) END"
CATEGORY = (
    f"coalesce({cases(TAG_LABELS, key_of(tag('religion')))}, {cases(BUILDING_LABELS, key_of(tag('building')))}, {sq(TAG_FALLBACK)})"
)
EL_NAME = first_of(NAME_TAGS)
EL_CITY = first_of(CITY_TAGS)
EL_TYPE = first_of(TYPE_TAGS)
STREET = f"concat_ws(' ', nullif({tag('addr:housenumber')}, ''), nullif({tag('addr:street')}, ''))"


def address(city: str, country: str) -> str:
    return (
        f"coalesce(nullif({tag('addr:full')}, ''), nullif(concat_ws(', ', nullif({STREET}, ''), nullif({tag('addr:suburb')}, ''), "
        f"nullif({city}, ''), nullif({tag('addr:postcode')}, ''), nullif({country}, '')), ''))"
    )


REF = "json_extract_string(json, '$.type') || '/' || json_extract_string(json, '$.id')"


def description(kind: str, category: str, city: str, country: str, lead="OpenStreetMap sacred place: ", bare="sacred place") -> str:
    details = f"concat_ws(' ', nullif({kind}, ''), nullif({category}, ''))"
    where = f"concat_ws(', ', nullif({city}, ''), nullif({country}, ''))"
    return (
        f"'{lead}' || CASE WHEN {details} = '' THEN '{bare}' ELSE {details} END || "
        f"CASE WHEN {where} = '' THEN '' ELSE ' in ' || {where} END || '. OSM ' || {REF} || '.'"
    )


SKIP = (
    f"({key_of(EL_NAME)} IN {GENERIC} AND NOT ("
    + " OR ".join(f"coalesce({tag(x)}, '') <> ''" for x in IDENTIFYING_TAGS) + "))"
)

# --- text ------------------------------------------------------------------------------

_QUOTES = "translate({0}, '“”‘’–—', '\"\"''''--')"
add(
    "b1_clean_text", lambda t: t.documents.select("doc_id", T.clean_text("text").alias("clean")), "",
    f"SELECT doc_id, nullif(trim(regexp_replace({_QUOTES.format('text')}, '[\\s\\x{{00A0}}\\x{{FEFF}}]+', ' ', 'g')), '') AS clean FROM documents",
)
add(
    "b2_clean_key", lambda t: t("places").select("id", T.clean_key("name").alias("name_key")), "places",
    f"SELECT id, {key_of('name')} AS name_key FROM places",
)
add(
    "b3_normalize_name", lambda t: t("places").select("id", T.normalize_name("name").alias("name_key")), "places",
    f"SELECT id, {name_of('name')} AS name_key FROM places",
)
add(
    "b4_display_label", lambda t: t("places").select("id", T.display_label("religion").alias("label")), "places",
    f"SELECT id, {display_of('religion')} AS label FROM places",
)
add(
    "b5_normalize_category", lambda t: t("places").select("id", P.normalize_category("religion").alias("label")), "places",
    f"SELECT id, {label_of('religion')} AS label FROM places",
)
add(
    "b6_strict_category",
    lambda t: elements(t).select("arrival", P.strict_category(F.col("tags")["religion"]).alias("label")).filter("label is not null"),
    "elements_json",
    f"SELECT * FROM (SELECT arrival, {cases(STRICT_LABELS, 'lower(' + tag('religion') + ')')} AS label FROM elements_json) WHERE label IS NOT NULL",
)
add(
    "b7_category_from_tags", lambda t: elements(t).select("arrival", P.category_from_tags("tags").alias("label")),
    "elements_json", f"SELECT arrival, {CATEGORY} AS label FROM elements_json",
)
add(
    "b8_marker_style",
    lambda t: t("places").select("id", P.marker_style("religion").alias("s")).select("id", "s.*"), "places",
    f"""SELECT id, label,
  coalesce({cases({k: v[1] for k, v in CATEGORY_ALIASES.items()}, 'lower(label)')}, CASE WHEN label = 'Sacred place' THEN 'sacred-place' ELSE 'other' END) AS key,
  coalesce({cases({k: v[2] for k, v in CATEGORY_ALIASES.items()}, 'lower(label)')}, CASE WHEN label = 'Sacred place' THEN '•' ELSE '✦' END) AS symbol,
  'temple-marker--' || coalesce({cases({k: v[1] for k, v in CATEGORY_ALIASES.items()}, 'lower(label)')}, CASE WHEN label = 'Sacred place' THEN 'sacred-place' ELSE 'other' END) AS class_name
FROM (SELECT id, {label_of('religion')} AS label FROM places)""",
)
_ALIAS_ROWS = ", ".join(f"({i}, {sq(k)}, {sq(v[0])})" for i, (k, v) in enumerate(CATEGORY_ALIASES.items()))
add(
    "b9_category_terms",
    lambda t: t("places").select("id", F.array_join(F.array_sort(P.category_terms("religion")), "|").alias("terms")), "places",
    f"""WITH alias(pos, raw, label) AS (VALUES {_ALIAS_ROWS}),
p AS (SELECT id, religion, {label_of('religion')} AS label FROM places),
terms AS (SELECT id, trim(religion) AS term FROM p WHERE {filled_sql('religion')}
  UNION SELECT id, label FROM p
  UNION SELECT id, raw FROM p JOIN alias USING (label)
  UNION SELECT id, unnest([{', '.join(sq(x) for x in UNSPECIFIC_SEARCH_TERMS)}]) FROM p WHERE label = 'Sacred place')
SELECT id, string_agg(term, '|' ORDER BY term) AS terms FROM terms GROUP BY id""",
)
add(
    "b10_first_tag",
    lambda t: elements(t).select(
        "arrival", P.element_name("tags").alias("name"), P.element_city("tags").alias("city"),
        P.element_type("tags").alias("type"), P.element_phone("tags").alias("phone"),
    ),
    "elements_json",
    f"SELECT arrival, {EL_NAME} AS name, {EL_CITY} AS city, {EL_TYPE} AS type, {first_of(PHONE_TAGS)} AS phone FROM elements_json",
)
add(
    "b11_compose_address",
    lambda t: elements(t).select(
        "arrival", P.compose_address("tags", P.element_city("tags"), F.col("tags")["addr:country"]).alias("address")
    ),
    "elements_json", f"SELECT arrival, {address(EL_CITY, tag('addr:country'))} AS address FROM elements_json",
)
add(
    "b12_compose_description",
    lambda t: elements(t).select(
        "arrival",
        P.compose_description(
            "tags", P.element_type("tags"), P.category_from_tags("tags"), P.element_city("tags"), F.lit(None).cast("string"),
            F.concat_ws("/", "element_type", F.col("element_id").cast("string")),
        ).alias("description"),
    ),
    "elements_json",
    f"SELECT arrival, {description(EL_TYPE, CATEGORY, EL_CITY, 'CAST(NULL AS VARCHAR)')} AS description FROM elements_json",
)
add(
    "b13_safe_url", lambda t: t("places").select("id", P.safe_url("website_url").alias("url")), "places",
    f"SELECT id, {url('website_url')} AS url FROM places",
)
add(
    "b14_image_and_website_url",
    lambda t: elements(t).select("arrival", P.image_url("tags").alias("image"), P.website_url("tags").alias("website")),
    "elements_json", f"SELECT arrival, {IMAGE} AS image, {WEBSITE} AS website FROM elements_json",
)
add(
    "b15_entity_id", lambda t: elements(t).select("arrival", P.entity_id("tags").alias("qid")), "elements_json",
    f"SELECT arrival, {QID} AS qid FROM elements_json",
)
add(
    "b16_parse_point",
    lambda t: read_bindings(t("bindings_json"), ("coord",)).select("arrival", P.parse_point("coord").alias("p")).select(
        "arrival", "p.latitude", "p.longitude"
    ),
    "bindings_json",
    r"""SELECT arrival, TRY_CAST(regexp_extract(c, '^Point\(([-0-9.]+) ([-0-9.]+)\)$', 2) AS DOUBLE) AS latitude,
  TRY_CAST(regexp_extract(c, '^Point\(([-0-9.]+) ([-0-9.]+)\)$', 1) AS DOUBLE) AS longitude
FROM (SELECT arrival, json_extract_string(json, '$.coord.value') AS c FROM bindings_json)""",
)
add(
    "b17_valid_coords",
    lambda t: t("places").select(
        "id", P.valid_coords("latitude", "longitude").alias("valid"),
        P.valid_coords(F.col("latitude") * 1.2, "longitude", ranged=True).alias("on_globe"),
    ),
    "places",
    """SELECT id, latitude IS NOT NULL AND longitude IS NOT NULL AS valid,
  coalesce(latitude * 1.2 BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false) AS on_globe FROM places""",
)
add(
    "b18_coord_cell",
    lambda t: t("places").select(
        "id", P.coord_cell("latitude", 3).alias("c3"), P.coord_cell("latitude", 5).alias("c5"), P.coord_cell("longitude", 6).alias("c6")
    ),
    "places",
    f"SELECT id, {cell_of('latitude', 3)} AS c3, {cell_of('latitude', 5)} AS c5, {cell_of('longitude', 6)} AS c6 FROM places",
)
add(
    "b19_has_text", lambda t: t("places").select("id", T.has_text("city").alias("city"), T.has_text("image_url").alias("image")),
    "places", f"SELECT id, {filled_sql('city')} AS city, {filled_sql('image_url')} AS image FROM places",
)
add(
    "b20_quality_score", lambda t: t("places").select("id", P.quality_score().alias("score")), "places",
    f"SELECT id, {SCORE} AS score FROM places",
)
add(
    "b21_haversine_km",
    lambda t: t("places").select("id", F.round(P.haversine_km(42.6977, 23.3219, F.col("latitude"), F.col("longitude")), 4).alias("km")),
    "places", f"SELECT id, round({km('42.6977', '23.3219', 'latitude', 'longitude')}, 4) AS km FROM places",
)
add(
    "b22_similar_name_key", lambda t: t("places").select("id", P.similar_name_key("name").alias("similar")), "places",
    f"SELECT id, {similar_of('name')} AS similar FROM places",
)
add(
    "b23_generic_name",
    lambda t: elements(t).withColumn("name", P.element_name("tags")).select(
        "arrival", P.is_generic_name("name").alias("generic"), P.skip_generic("name", "tags").alias("skipped")
    ),
    "elements_json",
    f"SELECT arrival, {key_of(EL_NAME)} IN {GENERIC} AS generic, {SKIP} AS skipped FROM elements_json",
)

# Roman numerals are spelled from numbers by the table of thousands, hundreds, tens and ones.
_DIGITS = (
    ("M", "MM", "MMM"), ("C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
    ("X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
)


def _roman(n):
    out = F.lit("")
    for power, names in zip((1000, 100, 10, 1), _DIGITS):
        digit = (F.floor(n / power) % 10).cast("int")
        out = F.concat(out, F.coalesce(F.get(F.array(*[F.lit(x) for x in names]), digit - 1), F.lit("")))
    return out


add(
    "b24_roman_to_int",
    lambda t: t("orders").withColumn("n", F.pmod("o_orderkey", F.lit(3999)) + 1).select(
        "o_orderkey", T.roman_to_int(F.lower(_roman(F.col("n")))).cast("bigint").alias("n")
    ),
    "", "SELECT o_orderkey, o_orderkey % 3999 + 1 AS n FROM orders",
)
_ORDINAL_ROWS = [*ORDINALS, *[f"Twenty-{w}" for w in ORDINALS[:9]], "Thirtieth", *[f"Thirty-{w}" for w in ORDINALS[:6]]]
add(
    "b25_ordinal_word",
    lambda t: t("lineitem").select((F.col("l_orderkey") % 45).alias("n")).distinct().select("n", T.ordinal_word("n").alias("word")),
    "",
    f"""SELECT n, coalesce([{', '.join(sq(w) for w in _ORDINAL_ROWS)}][n], 'Lecture ' || n) AS word
FROM (SELECT DISTINCT l_orderkey % 45 AS n FROM lineitem)""",
)

_NAMED = "html"
for _n, _c in sorted(NAMED_ENTITIES.items(), key=lambda kv: kv[0] == "amp"):
    _NAMED = f"replace({_NAMED}, '&{_n};', {sq(_c)})"
add(
    "b26_decode_entities", lambda t: t.pages.select("page_id", T.decode_entities("html").alias("text")), "",
    f"SELECT page_id, {_NAMED} AS text FROM pages",
)
add(
    # Every letter é of the pages is first written as a numeric reference, in both notations.
    "b26_decode_numeric",
    lambda t: t.pages.select(
        "page_id",
        T.decode_entities(F.regexp_replace(F.regexp_replace("html", "é", "&#233;"), "ó", "&#xF3;")).alias("text"),
    ),
    "", f"SELECT page_id, {_NAMED} AS text FROM pages",
)
_STRIPPED = "regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g')"
_BROKEN = f"regexp_replace(regexp_replace({_STRIPPED}, '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</(p|div|h1|h2|h3|h4|pre|li)>', chr(10) || chr(10), 'g')"
_BARE = _NAMED.replace("html", f"regexp_replace({_BROKEN}, '<[^>]+>', '', 'g')", 1)
HTML_TEXT = f"trim(regexp_replace(regexp_replace({_BARE}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || chr(9) || ' ')"
add(
    "b27_html_to_text", lambda t: t.pages.select("page_id", T.html_to_text("html").alias("text")), "",
    f"SELECT page_id, {HTML_TEXT} AS text FROM pages",
)


def _wiki(t):
    """Pages as wiki markup: bold openings become templates, links and references are put in."""
    html = F.regexp_replace("html", "<b>", "{{header|x}} '''")
    html = F.regexp_replace(html, "</p>", "<ref>n</ref> [[Target page|shown]] [[plain]] <!-- c -->")
    return t.pages.select("page_id", html.alias("wiki"))


_WIKI = "regexp_replace(regexp_replace(html, '<b>', '{{header|x}} ''''''', 'g'), '</p>', '<ref>n</ref> [[Target page|shown]] [[plain]] <!-- c -->', 'g')"
_W = f"regexp_replace({_WIKI}, '(?is)\\{{\\{{header.*?\\}}\\}}\\s*', '')"
for _p, _r in (
    (r"(?is)<ref.*?</ref>", ""), (r"(?i)<ref[^/]*/>", ""), (r"(?s)<!--.*?-->", ""), (r"\{\{[^{}]*\}\}", ""),
    (r"\[\[([^|\]]+)\|([^\]]+)\]\]", r"\2"), (r"\[\[([^\]]+)\]\]", r"\1"), ("''{2,}", ""),
):
    _W = f"regexp_replace({_W}, '{_p}', '{_r}', 'g')"
add(
    "b28_strip_wikitext", lambda t: _wiki(t).select("page_id", T.strip_wikitext("wiki").alias("text")), "",
    f"SELECT page_id, trim(replace({_W}, '__NOTOC__', ''), chr(10) || ' ') AS text FROM pages",
)
_SPACED_TYPE = "replace(text_type, '_', ' ')"
add(
    "b29_type_label", lambda t: t("books").select("book_id", B.type_label("text_type").alias("label")), "books",
    f"SELECT book_id, {words_up(_SPACED_TYPE)} AS label FROM books",
)
add(
    "b30_slug", lambda t: t("places").select("id", B.slug("religion").alias("slug")), "places",
    "SELECT id, 'group-' || regexp_replace(regexp_replace(lower(religion), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM places",
)
add(
    "b31_is_selection", lambda t: t("books").select("book_id", B.is_selection("title", "text_type").alias("selection")), "books",
    "SELECT book_id, " + " OR ".join(f"contains(lower(title || ' ' || text_type), {sq(w)})" for w in SELECTION_SIGNALS) + " AS selection FROM books",
)
add(
    "b32_section_title",
    lambda t: t("sections_h").select(
        "section_id", B.section_title("display_title", F.lit(None).cast("string"), "chapter_number", "section_label").alias("title")
    ),
    "sections_h",
    f"""SELECT section_id, CASE WHEN {filled_sql('display_title')} THEN display_title
  ELSE trim(coalesce(section_label, 'Section') || ' ' || chapter_number) END AS title FROM sections_h""",
)
add(
    "b32_passage_marker",
    lambda t: t("passages_h").select("section_id", "verse_number", B.passage_marker().alias("marker")),
    "passages_h", "SELECT section_id, verse_number, coalesce(verse_label, 'Passage') || ' ' || verse_number AS marker FROM passages_h",
)
add(
    "b33_compact_line",
    lambda t: t("places").select("id", T.compact_line("name", "religion", "city", "country").alias("line")),
    "places",
    "SELECT id, concat_ws(' - ', " + ", ".join(f"CASE WHEN {filled_sql(c)} THEN {c} END" for c in ("name", "religion", "city", "country")) + ") AS line FROM places",
)
add(
    "b34_search_term", lambda t: t("conversation_messages").select("conv_id", "turn", T.search_term("content").alias("term")),
    "conversation_messages",
    f"""SELECT conv_id, turn, coalesce(list_filter(string_split_regex(regexp_replace(lower(content), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'),
  lambda w: length(w) > 3 AND w NOT IN {sql_list(SEARCH_STOP_WORDS)})[1], '') AS term FROM conversation_messages""",
)
add(
    "b35_truncate", lambda t: t.documents.select("doc_id", T.truncate("text", 240).alias("cut")), "",
    "SELECT doc_id, substr(text, 1, 240) AS cut FROM documents",
)
add(
    "b36_directions_url",
    lambda t: t("places").select("id", P.directions_url("latitude", "longitude").alias("url")), "places",
    """SELECT id, 'https://www.google.com/maps/dir/?api=1&destination=' || regexp_replace(CAST(latitude AS VARCHAR), '\\.0$', '') || ',' ||
  regexp_replace(CAST(longitude AS VARCHAR), '\\.0$', '') AS url FROM places""".replace("\\\\", "\\"),
)
add(
    "b37_stars", lambda t: t("reviews").select("review_id", B.stars(F.col("rating") * 1.3 - 1).alias("stars")), "reviews",
    """SELECT review_id, repeat('★', n) || repeat('☆', 5 - n) AS stars
FROM (SELECT review_id, CAST(least(5, greatest(0, floor(rating * 1.3 - 1 + 0.5))) AS INTEGER) AS n FROM reviews)""",
)
add(
    "b38_event_label",
    lambda t: t("calendar").select("id", B.date_label("event_date").alias("day"), B.scope_label().alias("scope")), "calendar",
    """SELECT id, strftime(event_date, '%b %-d, %Y') AS day,
  CASE WHEN is_global THEN 'Global' ELSE coalesce(country, 'Regional') END AS scope FROM calendar""",
)
add(
    "b39_page_key",
    lambda t: t("orders").select("o_orderkey", T.page_key(F.lit("et"), F.pmod("o_orderkey", F.lit(150)) + 1).alias("page")), "",
    """SELECT o_orderkey, 'et' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 2, '0')
  ELSE chr(CAST(97 + (n - 100) // 10 AS INTEGER)) || (n % 10) END AS page FROM (SELECT o_orderkey, o_orderkey % 150 + 1 AS n FROM orders)""",
)
add(
    "b40_has_script", lambda t: t.documents.select("doc_id", T.has_script(F.regexp_replace("text", "É", "書")).alias("han")), "",
    "SELECT doc_id, contains(text, 'É') OR regexp_matches(text, '[\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}]') AS han FROM documents",
)
add(
    "b41_classify_error",
    lambda t: t("error_log").select("event_id", B.classify_error("status", F.lit(None).cast("string"), "message").alias("kind")),
    "error_log",
    """SELECT event_id, CASE WHEN status = 429 THEN 'rate_limited' WHEN status = 404 THEN 'not_found' WHEN status >= 500 THEN 'server'
  WHEN status >= 400 THEN 'http' WHEN message LIKE '%timed out%' THEN 'timeout' WHEN message LIKE '%fetch failed%' THEN 'network'
  ELSE 'unknown' END AS kind FROM error_log""",
)
add(
    "b42_default_name_and_title",
    lambda t: t("conversation_messages").select(
        "conv_id", "turn", B.default_name(F.concat("role", F.lit("."), F.col("conv_id"), F.lit("@mail.example"))).alias("name"),
        B.default_title(F.when(F.col("turn") > 0, F.col("content"))).alias("title"),
    ),
    "conversation_messages",
    """SELECT conv_id, turn, role || '.' || conv_id AS name,
  CASE WHEN turn > 0 THEN substr(trim(content, ' ' || chr(10)), 1, 70) ELSE 'AI Assistant question' END AS title FROM conversation_messages""",
)
add(
    "b43_name_similarity",
    lambda t: t("places").select(
        "id",
        P.name_similarity(
            "name",
            F.array_compact(
                F.array(
                    F.col("city"), F.when(F.col("id") % 2 == 0, F.upper("name")),
                    F.when(F.col("id") % 3 == 0, F.substring("name", 5, 9)),
                )
            ),
        ).alias("tier"),
    ),
    "places",
    f"""SELECT id, CAST(CASE WHEN {name_of('name')} = '' OR len(names) = 0 THEN 0
  WHEN len(list_filter(names, lambda n: n = {name_of('name')})) > 0 THEN 3
  WHEN len(list_filter(names, lambda n: contains(n, {name_of('name')}) OR contains({name_of('name')}, n))) > 0 THEN 2 ELSE 0 END AS INTEGER) AS tier
FROM (SELECT id, name, list_filter([{name_of('city')}, CASE WHEN id % 2 = 0 THEN {name_of('name')} ELSE '' END,
  CASE WHEN id % 3 = 0 THEN {name_of('substr(name, 5, 9)')} ELSE '' END], lambda n: n <> '') AS names FROM places)""",
)
add(
    "b44_reference",
    lambda t: t("passages_h").join(t("sections_h"), "section_id").select(
        "section_id", "verse_number", "content", B.reference("display_title", "chapter_number", "verse_number").alias("reference")
    ),
    "passages_h sections_h",
    """SELECT section_id, verse_number, content, coalesce(display_title, 'Holy book') || ' ' || chapter_number || ':' || verse_number AS reference
FROM passages_h JOIN sections_h USING (section_id)""",
)
