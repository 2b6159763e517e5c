"""JSON sources: flat records, map elements, variable bindings, entity claims and nested books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfolio.functions.places import file_url, parse_point, safe_url
from wayfolio.functions.text import col, filled
from wayfolio.lookups import PLACE_COLUMNS

ELEMENT = (
    "type string, id bigint, lat double, lon double, center struct<lat: double, lon: double>, "
    "tags map<string, string>"
)
ENTITY = (
    "descriptions map<string, struct<value: string>>, "
    "claims map<string, array<struct<mainsnak: struct<datavalue: struct<value: string>>>>>"
)
BOOK = "chapters array<struct<chapter: string, verses: array<struct<verse: string, text: string>>>>"

PLACE_SEED = ", ".join(
    f"{c} {'double' if c in ('latitude', 'longitude') else 'string'}" for c in PLACE_COLUMNS if c != "id"
)
EVENT_SEED = "religion string, title string, description string, event_date date, country string, is_global boolean"


def read_records_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Flat records under a fixed schema: one JSON array per file, or with ``lines`` one record per line."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def parsed_once(df: DataFrame, parsed: Column, name: str) -> DataFrame:
    """Add a parsed struct through a generator, which keeps filters and field reads from parsing again."""
    return df.select("*", F.explode(F.array(parsed)).alias(name))


def read_geo_elements(df: DataFrame, column: str = "json", listed: bool = False) -> DataFrame:
    """Map elements as columns; coordinates come from the element or else its center.

    With ``listed`` the JSON holds an ``elements`` array, one row results per element.
    """
    if listed:
        body = F.from_json(column, f"elements array<struct<{_struct(ELEMENT)}>>")
        rows = df.select("*", F.explode(body["elements"]).alias("_e"))
    else:
        rows = parsed_once(df, F.from_json(column, ELEMENT), "_e")
    return rows.select(
        *[c for c in df.columns if c != column],
        F.col("_e.type").alias("element_type"),
        F.col("_e.id").alias("element_id"),
        F.coalesce("_e.lat", "_e.center.lat").alias("latitude"),
        F.coalesce("_e.lon", "_e.center.lon").alias("longitude"),
        F.coalesce(F.col("_e.tags"), F.create_map().cast("map<string,string>")).alias("tags"),
    )


def _struct(ddl: str) -> str:
    """Column DDL (``name type``) as struct fields (``name: type``)."""
    out, depth = [], 0
    for field in ddl.split(", "):
        name, _, kind = field.partition(" ")
        out.append(field if depth else f"{name}: {kind}")
        depth += field.count("<") - field.count(">")
    return ", ".join(out)


BINDING_VARS = ("place", "placeLabel", "religion", "countryLabel", "cityLabel", "coord", "description", "website", "image")


def read_bindings(df: DataFrame, names=BINDING_VARS, column: str = "json") -> DataFrame:
    """Variable bindings as flat columns; an empty value is null."""
    schema = ", ".join(f"{n} struct<value: string>" for n in names)
    parsed = parsed_once(df, F.from_json(column, schema), "_b")
    return parsed.select(
        *[c for c in df.columns if c != column],
        *[filled(F.col(f"_b.{n}.value")).alias(n) for n in names],
    )


def bindings_to_places(rows: DataFrame) -> DataFrame:
    """Binding rows as places; rows without a label or a readable point are dropped."""
    point = parse_point("coord")
    spot = F.concat_ws(", ", filled("cityLabel"), filled("countryLabel"))
    sentence = F.concat_ws(" in ", filled("religion"), F.lit("sacred place"), filled(spot))
    return (
        rows.withColumn("_p", point).filter(F.col("placeLabel").isNotNull() & F.col("_p").isNotNull())
        .select(
            "arrival", F.col("placeLabel").alias("name"), "religion",
            F.col("countryLabel").alias("country"), F.col("cityLabel").alias("city"),
            F.col("_p.latitude").alias("latitude"), F.col("_p.longitude").alias("longitude"),
            F.coalesce(F.col("description"), sentence).alias("description"),
            file_url("image").alias("image_url"),
            F.coalesce(safe_url("website"), F.col("place")).alias("website_url"),
        )
    )


def entity_metadata(df: DataFrame, column: str = "json") -> DataFrame:
    """English description, image and website of each entity, from the first claim of a property."""
    parsed = parsed_once(df, F.from_json(column, ENTITY), "_e")

    def claim(prop: str) -> Column:
        return filled(F.get(F.col("_e.claims")[prop], F.lit(0))["mainsnak"]["datavalue"]["value"])

    return parsed.select(
        *[c for c in df.columns if c != column],
        filled(F.col("_e.descriptions")["en"]["value"]).alias("description"),
        file_url(claim("P18")).alias("image_url"),
        safe_url(claim("P856")).alias("website_url"),
    )


def explode_book_json(df: DataFrame, column: str = "json") -> DataFrame:
    """One row per verse of a nested book."""
    book = df.withColumn("_b", F.from_json(column, BOOK)).drop(column)
    keep = [c for c in df.columns if c != column]
    chapters = book.select(*keep, F.explode("_b.chapters").alias("_c"))
    verses = chapters.select(*keep, F.col("_c.chapter").try_cast("int").alias("chapter_number"), F.explode("_c.verses").alias("_v"))
    return verses.select(
        *keep, "chapter_number", F.col("_v.verse").try_cast("int").alias("verse_number"), F.col("_v.text").alias("content")
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Raw documents, one row per file, with the file path as id."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


__all__ = [
    "ELEMENT", "ENTITY", "BOOK", "PLACE_SEED", "EVENT_SEED", "read_records_json", "parsed_once", "read_geo_elements",
    "BINDING_VARS", "read_bindings", "bindings_to_places", "entity_metadata", "explode_book_json", "read_corpus",
]
