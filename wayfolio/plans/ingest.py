"""From raw map elements to place rows with an outcome, and on to inserts and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfolio.functions.places import (
    as_coordinate, category_from_tags, compose_address, compose_description, coordinate_key, element_city,
    element_name, element_phone, element_type, entity_id, external_key, first_tag, image_url, location_key,
    name_keys, name_similarity, named_location_key, named_point_key, safe_url, skip_generic, strict_category, website_url,
)
from wayfolio.functions.text import clean_key, clean_line, filled, normalize_name, text
from wayfolio.lookups import ENTITY_TAGS, SIMILARITY_TAGS
from wayfolio.operators.geo import first_around, thin
from wayfolio.operators.merge import left_lookup
from wayfolio.operators.ordered import first_per_key


def three_keys() -> dict[str, Column]:
    """The alternative keys of the radius import."""
    return {"external": external_key(), "location": location_key(), "coordinates": coordinate_key()}


def two_keys() -> dict[str, Column]:
    """The alternative keys of the two smaller imports."""
    return {"location": named_location_key(), "coordinates": named_point_key()}


def one_key() -> Column:
    """The key of the country import."""
    return named_point_key()


def element_ref() -> Column:
    return F.concat_ws("/", F.col("element_type"), F.col("element_id").cast("string"))


def parse_elements(elements: DataFrame, targets: DataFrame) -> DataFrame:
    """Map elements as places with an ``outcome``: candidate, unnamed, generic or no_coordinates.

    City and country fall back to those of the target the element was found for.
    """
    t = targets.select("target_id", F.col("name").alias("_city"), F.col("country").alias("_country"))
    tagged = elements.join(t, "target_id", "left")
    tags = F.col("tags")
    named = tagged.withColumn("name", element_name(tags)).withColumn("religion", category_from_tags(tags))
    placed = (
        named.withColumn("type", element_type(tags))
        .withColumn("city", element_city(tags, F.col("_city")))
        .withColumn("country", clean_line(F.coalesce(filled(tags["addr:country"]), F.col("_country"))))
    )
    outcome = (
        F.when(F.col("name").isNull(), "unnamed")
        .when(skip_generic("name", "tags"), "generic")
        .when(as_coordinate("latitude").isNull() | as_coordinate("longitude").isNull(), "no_coordinates")
        .otherwise("candidate")
    )
    return placed.select(
        "arrival", "target_id", outcome.alias("outcome"), "name", "religion",
        F.coalesce(first_tag(tags, ("denomination", "denomination:en")), F.col("type")).alias("denomination"),
        "country", "city",
        compose_address(tags, F.col("city"), F.col("country")).alias("address"),
        compose_description(
            tags, F.col("type"), F.col("religion"), F.col("city"), F.col("country"), element_ref()
        ).alias("description"),
        "latitude", "longitude",
        website_url(tags).alias("website_url"),
        F.coalesce(safe_url(tags["image"]), safe_url(tags["image:0"])).alias("image_url"),
        element_ref().alias("external_id"), F.lit("openstreetmap").alias("source"), "type",
        element_phone(tags).alias("phone"), F.col("element_type").alias("osm_type"),
        F.col("element_id").cast("string").alias("osm_id"), clean_line(tags["wikidata"]).alias("wikidata_id"),
    )


def with_entity_metadata(rows: DataFrame, entities: DataFrame, key: str = "qid") -> DataFrame:
    """Attach the metadata of each row's entity id; every id is resolved once.

    Of several entity rows with one id the least by (description, image, website) counts.
    """
    taken = F.min(F.struct("description", "image_url", "website_url")).alias("e")
    known = entities.groupBy(F.col(key).alias("_qid")).agg(taken).select(
        "_qid", F.col("e.description").alias("entity_description"),
        F.col("e.image_url").alias("entity_image"), F.col("e.website_url").alias("entity_website"),
    )
    return left_lookup(rows, known.withColumnRenamed("_qid", key), key)


def parse_area_elements(elements: DataFrame, entities: DataFrame, country: Column) -> DataFrame:
    """Elements of a country import: known categories only, gaps filled from the linked entity."""
    tags = F.col("tags")
    city = F.coalesce(*[filled(tags[k]) for k in ("addr:city", "addr:town", "addr:village", "addr:municipality", "is_in:city")])
    rows = (
        elements.withColumn("name", F.coalesce(*[filled(tags[k]) for k in SIMILARITY_TAGS]))
        .withColumn("religion", strict_category(tags["religion"]))
        .filter("name is not null and religion is not null and latitude is not null and longitude is not null")
        .withColumn("city", city)
        .withColumn("country", F.coalesce(filled(tags["addr:country"]), country))
        .withColumn("denomination", F.coalesce(filled(tags["denomination"]), filled(tags["denomination:en"])))
        .withColumn("qid", entity_id("tags"))
    )
    sentence = compose_description(
        tags, F.col("denomination"), F.col("religion"), F.col("city"), F.col("country"), element_ref(),
        lead="OpenStreetMap place of worship: ", bare="sacred",
    )
    written = F.when(text(tags["description"]) != "", tags["description"])
    return with_entity_metadata(rows, entities).select(
        "arrival", "name", "religion", "denomination", "country", "city",
        compose_address(tags, F.col("city"), F.col("country")).alias("address"),
        "latitude", "longitude",
        F.coalesce(written, F.col("entity_description"), sentence).alias("description"),
        F.coalesce(image_url(tags), F.col("entity_image")).alias("image_url"),
        F.coalesce(website_url(tags), F.col("entity_website")).alias("website_url"),
    )


# --- image enrichment -----------------------------------------------------------------

NEAR_KM = 0.25
NEAR_CAP = 25


def best_candidate(places: DataFrame, elements: DataFrame, km: float = NEAR_KM, cap: int = NEAR_CAP) -> DataFrame:
    """For each place the element nearby that best supplies an image or an entity id.

    The first ``cap`` elements by arrival within ``km`` compete: name similarity first, then
    arrival. Places at one position see the same elements, so the join runs once per position.
    """
    wanted = sorted({*SIMILARITY_TAGS, *ENTITY_TAGS, "image", "wikimedia_commons"})
    narrow = elements.select(
        "arrival", F.col("latitude").alias("elat"), F.col("longitude").alias("elng"),
        F.map_filter("tags", lambda k, v: k.isin(*wanted)).alias("tags"),
    )
    # The cut per position comes first, so the text rules only run on elements that can matter.
    offers = thin(narrow, "elat", "elng", ["arrival"], cap).select(
        "arrival", "elat", "elng",
        name_keys(F.array(*[F.col("tags")[k] for k in SIMILARITY_TAGS])).alias("names"),
        image_url("tags").alias("image"), entity_id("tags").alias("qid"),
    )
    spots = places.select("latitude", "longitude").dropna().distinct()
    seen = first_around(
        spots, offers, km, cap, ["latitude", "longitude"], "arrival", "latitude", "longitude", "elat", "elng"
    )
    useful = seen.filter(F.col("image").isNotNull() | F.col("qid").isNotNull())
    candidates = places.select("id", normalize_name("name").alias("_own"), "latitude", "longitude").join(
        useful.select("latitude", "longitude", "arrival", "names", "image", "qid"), ["latitude", "longitude"]
    )
    scored = candidates.withColumn("score", name_similarity("_own", F.col("names"), prepared=True))
    best = first_per_key(scored, ["id"], [F.desc("score"), F.asc("arrival")])
    return best.select("id", "arrival", "score", F.col("image").alias("element_image"), "qid")


def resolve_image(places: DataFrame, candidates: DataFrame, entities: DataFrame, searched: DataFrame) -> DataFrame:
    """Image of each place by source priority, with where it came from; of several from one source the least."""
    entity = entities.groupBy("qid").agg(F.min("image_url").alias("entity_image"))
    search = searched.groupBy("id").agg(F.min("image_url").alias("search_image"))
    offered = places.select("id").join(candidates.select("id", "element_image", "qid"), "id", "left")
    joined = left_lookup(offered, entity, "qid").join(search, "id", "left")
    return joined.select(
        "id",
        F.coalesce("element_image", "entity_image", "search_image").alias("image_url"),
        F.when(F.col("element_image").isNotNull(), "OpenStreetMap")
        .when(F.col("entity_image").isNotNull(), "OSM Wikidata tag")
        .when(F.col("search_image").isNotNull(), "Wikidata search")
        .alias("image_source"),
    )


def missing_image_worklist(places: DataFrame, n: int) -> DataFrame:
    """The first n places without an image: null before blank, each by name."""
    return (
        places.filter(F.col("image_url").isNull() | (F.col("image_url") == ""))
        .withColumn("pass", F.when(F.col("image_url").isNull(), 1).otherwise(2))
        .orderBy("pass", F.asc_nulls_last("name"), "id").limit(n)
    )


# --- targets and progress -------------------------------------------------------------


def select_targets(targets: DataFrame, requested: list[str], column: str = "name") -> tuple[DataFrame, DataFrame]:
    """Targets asked for by name (all of them when none matches), and the names nobody knows."""
    names = [n for n in (r.strip() for r in requested) if n]
    asked = targets.sparkSession.createDataFrame([(n,) for n in names], "requested string").withColumn(
        "_key", clean_key("requested")
    )
    keyed = targets.withColumn("_key", clean_key(column))
    hits = keyed.join(asked, "_key", "left_semi").drop("_key")
    unknown = asked.join(keyed, "_key", "left_anti").select("requested")
    return (targets if hits.isEmpty() else hits), unknown


# Progress states that count as done.
DONE = ("completed", "completed_with_errors")


def pending(targets: DataFrame, progress: DataFrame, n: int, key: str = "target_id", force: bool = False) -> DataFrame:
    """The first n targets that are not completed yet."""
    joined = targets.join(progress.select(key, F.col("status")), key, "left")
    open_ones = joined if force else joined.filter(~F.coalesce(F.col("status"), F.lit("")).isin(*DONE))
    return open_ones.orderBy(key).limit(n)


def capped_fill(df: DataFrame, group: str, order: str, per_group: int, total: int) -> DataFrame:
    """Up to ``per_group`` rows of each group, groups in order, until ``total`` rows are taken."""
    return first_per_key(df, [group], [order], per_group).orderBy(group, order).limit(total)


__all__ = [
    "three_keys", "two_keys", "one_key", "element_ref", "parse_elements", "with_entity_metadata",
    "parse_area_elements", "NEAR_KM", "NEAR_CAP", "best_candidate", "resolve_image", "missing_image_worklist",
    "select_targets", "DONE", "pending", "capped_fill",
]
