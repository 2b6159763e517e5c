"""Column functions on place records: labels, keys, tags, coordinates and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfolio.functions.text import (
    SPACE, clean_key, clean_line, col, display_label, filled, has_text, normalize_name, text, trim_space,
)
from wayfolio.lookups import (
    BUILDING_LABELS, CATEGORY_ALIASES, CITY_TAGS, ENTITY_TAGS, FILE_URL, FILE_WIDTH, GENERIC_CITIES,
    GENERIC_NAMES, IDENTIFYING_TAGS, NAME_TAGS, PHONE_TAGS, QUALITY_WEIGHTS, STRICT_LABELS, TAG_FALLBACK,
    TAG_LABELS, TYPE_TAGS, UNSPECIFIC, UNSPECIFIC_LABELS, UNSPECIFIC_SEARCH_TERMS, WEBSITE_TAGS,
)

EARTH_RADIUS_KM = 6371.0


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, null where the key is not in it."""
    return F.element_at(literal_map(pairs), key)


ALIAS_LABELS = {k: v[0] for k, v in CATEGORY_ALIASES.items()}


# --- labels ---------------------------------------------------------------------------


def normalize_category(c: Column | str, aliases: dict[str, str] = ALIAS_LABELS, also_unspecific: tuple[str, ...] = ()) -> Column:
    """Label of a category; ``also_unspecific`` are further spellings (lower case) of an unspecific place."""
    key = clean_key(c)
    return (
        F.when(key.isin(*aliases), lookup(aliases, key))
        .when(key.isin(*UNSPECIFIC_LABELS, *also_unspecific), F.lit(UNSPECIFIC))
        .when(key == "other", F.lit("Other"))
        .otherwise(display_label(c, UNSPECIFIC))
    )


def strict_category(c: Column | str, labels: dict[str, str] = STRICT_LABELS) -> Column:
    """Label of a known category, null otherwise."""
    return lookup(labels, F.lower(text(c)))


def category_from_tags(tags: Column | str) -> Column:
    t = col(tags)
    return F.coalesce(
        lookup(TAG_LABELS, clean_key(t["religion"])),
        lookup(BUILDING_LABELS, clean_key(t["building"])),
        F.lit(TAG_FALLBACK),
    )


def marker_style(c: Column | str) -> Column:
    """Struct of label, key, symbol and style class for a map marker."""
    label = normalize_category(c)
    key = clean_key(label)
    known = key.isin(*CATEGORY_ALIASES)
    unspecific = label == UNSPECIFIC
    marker = (
        F.when(known, lookup({k: v[1] for k, v in CATEGORY_ALIASES.items()}, key))
        .when(unspecific, F.lit("sacred-place"))
        .otherwise(F.lit("other"))
    )
    symbol = (
        F.when(known, lookup({k: v[2] for k, v in CATEGORY_ALIASES.items()}, key))
        .when(unspecific, F.lit("•"))
        .otherwise(F.lit("✦"))
    )
    return F.struct(
        label.alias("label"), marker.alias("key"), symbol.alias("symbol"),
        F.concat(F.lit("temple-marker--"), marker).alias("class_name"),
    )


def category_terms(c: Column | str, also: tuple[str, ...] = ()) -> Column:
    """All raw spellings a category may be stored under, as a distinct array."""
    label = normalize_category(c)
    own = F.array_compact(F.array(filled(trim_space(c)), label))
    spellings = F.transform(
        F.filter(F.map_entries(literal_map(ALIAS_LABELS)), lambda e: e["value"] == label),
        lambda e: e["key"],
    )
    extra = F.when(
        F.lower(label) == UNSPECIFIC.lower(), F.array(*[F.lit(t) for t in (*UNSPECIFIC_SEARCH_TERMS, *also)])
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own, spellings, extra))


def is_generic_name(c: Column | str, also: tuple[str, ...] = ()) -> Column:
    return clean_key(c).isin(*GENERIC_NAMES, *also)


def is_suspicious_city(c: Column | str) -> Column:
    return clean_key(c).isin(*GENERIC_CITIES)


def skip_generic(name: Column | str, tags: Column | str) -> Column:
    """True for a generic name without any tag that identifies the place."""
    t = col(tags)
    identified = F.lit(False)
    for tag in IDENTIFYING_TAGS:
        identified = identified | (text(t[tag]) != "")
    return is_generic_name(name) & ~identified


# --- tags -----------------------------------------------------------------------------


def first_tag(tags: Column | str, keys, *more: Column) -> Column:
    """First non-empty tag of the chain, squeezed; blank becomes null."""
    t = col(tags)
    return clean_line(F.coalesce(*[filled(t[k]) for k in keys], *[filled(m) for m in more]))


def element_name(tags) -> Column:
    return first_tag(tags, NAME_TAGS)


def element_city(tags, *default: Column) -> Column:
    return first_tag(tags, CITY_TAGS, *default)


def element_type(tags) -> Column:
    return first_tag(tags, TYPE_TAGS)


def element_phone(tags) -> Column:
    return first_tag(tags, PHONE_TAGS)


def compose_address(tags: Column | str, city: Column, country: Column) -> Column:
    t = col(tags)
    street = F.concat_ws(" ", filled(t["addr:housenumber"]), filled(t["addr:street"]))
    parts = F.concat_ws(
        ", ", filled(street), filled(t["addr:suburb"]), filled(city), filled(t["addr:postcode"]), filled(country)
    )
    return clean_line(F.coalesce(filled(t["addr:full"]), parts))


def compose_description(
    tags: Column | str, kind: Column, category: Column, city: Column, country: Column, ref: Column,
    lead: str = "OpenStreetMap sacred place: ", bare: str = "sacred place",
) -> Column:
    """The description tag, or a sentence built from type, category and location."""
    t = col(tags)
    details = F.concat_ws(" ", filled(kind), filled(category))
    location = F.concat_ws(", ", filled(city), filled(country))
    sentence = F.concat(
        F.lit(lead), F.coalesce(filled(details), F.lit(bare)),
        F.when(location == "", F.lit("")).otherwise(F.concat(F.lit(" in "), location)),
        F.lit(". OSM "), ref, F.lit("."),
    )
    return F.when(text(t["description"]) != "", clean_line(t["description"])).otherwise(sentence)


def safe_url(c: Column | str) -> Column:
    cleaned = clean_line(c)
    return F.when(cleaned.rlike("(?i)^https?://"), cleaned)


def file_url(c: Column | str) -> Column:
    """Address of a named media file; categories and blanks give null."""
    name = F.regexp_replace(F.regexp_replace(trim_space(c), "(?i)^File:", ""), "(?i)^Image:", "")
    # Form encoding and URI-component encoding differ in six characters.
    encoded = F.url_encode(name)
    for form, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(plain))
    usable = (name != "") & ~name.rlike("(?i)^Category:")
    return F.when(usable, F.concat(F.lit(FILE_URL + "/"), encoded, F.lit("?" + FILE_WIDTH)))


def image_url(tags: Column | str) -> Column:
    t = col(tags)
    named = "(?i)^(File|Image):"
    return F.coalesce(
        safe_url(t["image"]),
        F.when(t["image"].rlike(named), file_url(t["image"])),
        F.when(t["wikimedia_commons"].rlike(named), file_url(t["wikimedia_commons"])),
    )


def website_url(tags: Column | str) -> Column:
    t = col(tags)
    return F.coalesce(*[safe_url(t[k]) for k in WEBSITE_TAGS])


def entity_id(tags: Column | str) -> Column:
    t = col(tags)
    raw = trim_space(F.coalesce(*[filled(t[k]) for k in ENTITY_TAGS]))
    return F.when(raw.rlike("(?i)^Q[0-9]+$"), F.upper(raw))


def name_similarity(name: Column | str, names: Column, prepared: bool = False) -> Column:
    """3 for an equal name, 2 where one contains the other, else 0.

    ``prepared`` says that both sides are normalised already, to save the work per pair.
    """
    own = col(name) if prepared else normalize_name(name)
    others = names if prepared else name_keys(names)
    return (
        F.when((own == "") | (F.size(others) <= 0), F.lit(0))
        .when(F.array_contains(others, own), F.lit(3))
        .when(F.exists(others, lambda n: F.contains(n, own) | F.contains(own, n)), F.lit(2))
        .otherwise(F.lit(0))
    )


def name_keys(names: Column) -> Column:
    """Normalised, non-empty names of an array."""
    return F.filter(F.transform(names, normalize_name), lambda n: n != "")


# --- coordinates ----------------------------------------------------------------------


def parse_point(c: Column | str) -> Column:
    """Struct of latitude and longitude from ``Point(lon lat)``, null when malformed."""
    pattern = "(?i)^Point\\(([-0-9.]+)\\s+([-0-9.]+)\\)$"
    trimmed = trim_space(c)
    lng = F.regexp_extract(trimmed, pattern, 1).try_cast("double")
    lat = F.regexp_extract(trimmed, pattern, 2).try_cast("double")
    return F.when(lng.isNotNull() & lat.isNotNull(), F.struct(lat.alias("latitude"), lng.alias("longitude")))


def as_coordinate(c: Column | str) -> Column:
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def valid_coords(lat: Column | str, lng: Column | str, ranged: bool = False) -> Column:
    """Both coordinates are finite numbers (and, with ``ranged``, on the globe)."""
    la, lo = as_coordinate(lat), as_coordinate(lng)
    ok = la.isNotNull() & lo.isNotNull()
    if ranged:
        ok = ok & F.coalesce(la.between(-90, 90) & lo.between(-180, 180), F.lit(False))
    return ok


def coord_cell(c: Column | str, digits: int) -> Column:
    """Coordinate as a whole number of 10^-digits degrees, halves away from zero."""
    value = as_coordinate(c)
    return (F.floor(F.abs(value) * (10 ** digits) + 0.5) * F.sign(value)).cast("bigint")


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    la1, lo1, la2, lo2 = (col(x) if isinstance(x, (str, Column)) else F.lit(float(x)) for x in (lat1, lng1, lat2, lng2))
    sin_lat = F.sin(F.radians(la2 - la1) / 2)
    sin_lng = F.sin(F.radians(lo2 - lo1) / 2)
    a = sin_lat * sin_lat + F.cos(F.radians(la1)) * F.cos(F.radians(la2)) * sin_lng * sin_lng
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def directions_url(lat: Column | str, lng: Column | str) -> Column:
    la, lo = as_coordinate(lat), as_coordinate(lng)
    return F.concat(
        F.lit("https://www.google.com/maps/dir/?api=1&destination="),
        number_text(la), F.lit(","), number_text(lo),
    )


def number_text(c: Column) -> Column:
    """A number without a trailing ``.0``."""
    return F.regexp_replace(c.cast("string"), "\\.0$", "")


# --- keys and scores ------------------------------------------------------------------


def similar_name_key(c: Column | str, unicode: bool = False) -> Column:
    """Short key for near-equal names; with ``unicode`` letters of every script count."""
    words = F.regexp_replace(clean_key(c), "(?<![A-Za-z0-9_])(the|saint|st)(?![A-Za-z0-9_])", "")
    kept = F.regexp_replace(words, "[^\\p{L}\\p{N}]+" if unicode else "[^a-z0-9]+", "")
    return F.substring(kept, 1, 42)


def quality_score(lat: Column | str = "latitude", lng: Column | str = "longitude") -> Column:
    score = F.when(valid_coords(lat, lng), 1).otherwise(0)
    for name, weight in QUALITY_WEIGHTS.items():
        score = score + F.when(has_text(name), weight).otherwise(0)
    return score.cast("int")


def _joined_key(*parts: Column) -> Column:
    complete = F.lit(True)
    for part in parts:
        complete = complete & F.coalesce(part != "", F.lit(False))
    return F.when(complete, F.concat_ws("|", *parts))


def location_key(name="name", city="city", country="country") -> Column:
    return _joined_key(clean_key(name), clean_key(city), clean_key(country))


def coordinate_key(name="name", lat="latitude", lng="longitude", digits: int = 5) -> Column:
    return _joined_key(
        clean_key(name), coord_cell(lat, digits).cast("string"), coord_cell(lng, digits).cast("string")
    )


def similar_key(name="name", lat="latitude", lng="longitude", digits: int = 3) -> Column:
    return _joined_key(
        similar_name_key(name), coord_cell(lat, digits).cast("string"), coord_cell(lng, digits).cast("string")
    )


def external_key(source="source", external="external_id") -> Column:
    present = (text(source) != "") & (text(external) != "")
    return F.when(present, F.concat_ws("|", clean_key(source), clean_key(external)))


def named_point_key(name="name", lat="latitude", lng="longitude", digits: int = 6) -> Column:
    """Name (which may be blank) and coordinates; null only without coordinates."""
    la, lo = coord_cell(lat, digits), coord_cell(lng, digits)
    return F.when(
        la.isNotNull() & lo.isNotNull(),
        F.concat_ws("|", normalize_name(name), la.cast("string"), lo.cast("string")),
    )


def named_location_key(name="name", city="city", country="country") -> Column:
    return _joined_key(normalize_name(name), normalize_name(city), normalize_name(country))


__all__ = [
    "EARTH_RADIUS_KM", "literal_map", "lookup", "ALIAS_LABELS", "normalize_category", "strict_category",
    "category_from_tags", "marker_style", "category_terms", "is_generic_name", "is_suspicious_city", "skip_generic",
    "first_tag", "element_name", "element_city", "element_type", "element_phone", "compose_address",
    "compose_description", "safe_url", "file_url", "image_url", "website_url", "entity_id", "name_similarity",
    "name_keys", "parse_point", "as_coordinate", "valid_coords", "coord_cell", "haversine_km", "directions_url",
    "number_text", "similar_name_key", "quality_score", "location_key", "coordinate_key", "similar_key",
    "external_key", "named_point_key", "named_location_key",
]
