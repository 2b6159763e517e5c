"""The place explorer: filter, locate, sort and page as one lazy chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfolio.functions.places import category_terms, haversine_km, normalize_category, quality_score
from wayfolio.operators.filters import facet_filter, match_places, quality_filter
from wayfolio.operators.spatial import near_box
from wayfolio.session import materialize

PAGE_SIZE = 24


def explore_sort(df: DataFrame, mode: str) -> list:
    """Sort keys of a mode; unknown distances come last and ids break ties."""
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("Unnamed temple"))
    if mode == "nearest":
        return [F.asc_nulls_last("distance_km"), name.asc(), F.asc("id")]
    if mode == "name":
        return [name.asc(), F.asc("id")]
    if mode == "quality":
        return [quality_score().desc(), name.asc(), F.asc("id")]
    raise ValueError(f"unknown sort mode {mode}")


def explore(
    places: DataFrame, search: str = "", religion: str | None = None, country: str | None = None,
    city: str | None = None, quality: tuple[str, ...] = (), location: tuple[float, float] | None = None,
    radius_km: float | None = None,
) -> DataFrame:
    """Matching places with ``distance_km`` (null without a location)."""
    kept = facet_filter(places, country=country, city=city)
    if religion not in (None, "All"):
        kept = kept.filter(normalize_category("religion") == religion)
    kept = match_places(quality_filter(kept, *quality), search)
    if location is None:
        return kept.withColumn("distance_km", F.lit(None).cast("double"))
    if radius_km is not None:
        # The distance below is rounded to a millimetre, so the bounds are a little wider.
        kept = kept.filter(near_box(*location, radius_km + 1e-5))
    distance = haversine_km(location[0], location[1], F.col("latitude"), F.col("longitude"))
    located = kept.withColumn("distance_km", F.round(distance, 6))
    return located if radius_km is None else located.filter(F.col("distance_km") <= radius_km)


# Rows a page may skip by a plain top-k; deeper pages read the sorted table by position.
SHALLOW = 100_000


def page(df: DataFrame, order: list, number: int, size: int = PAGE_SIZE, shallow: int = SHALLOW) -> DataFrame:
    """One page of an ordered result; a number past the end gives the last page.

    A page near the start is a top-k per partition. For a deep page the table is sorted once in
    ranges, and only the ranges that hold the page are read, so no task sees all skipped rows.
    """
    total = df.count()
    last = max(1, -(-total // size))
    skip = (min(max(number, 1), last) - 1) * size
    if skip + size <= shallow:
        return df.orderBy(*order).offset(skip).limit(size)
    placed = materialize(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    # The upper bits of the id name the range, the lower 33 bits the row in it.
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row per range
    wanted, before = F.lit(False), 0
    for r in sizes:
        if before < skip + size and before + r["count"] > skip:
            wanted = wanted | ((part == r["part"]) & row.between(skip - before, skip + size - 1 - before))
        before += r["count"]
    return placed.filter(wanted).orderBy("_id").drop("_id")


def category_filter(places: DataFrame, value: str) -> DataFrame:
    """Places whose stored label contains any spelling of a category."""
    # The terms are a constant, folded once when the plan is optimised.
    stored = F.lower(F.col("religion"))
    return places.filter(F.exists(category_terms(F.lit(value)), lambda term: F.contains(stored, F.lower(term))))


def upcoming_sort(today: str) -> list:
    """Events from today on come first, each part by date."""
    return [(F.col("event_date") < F.lit(today).cast("date")).asc(), F.asc("event_date"), F.asc("id")]


def upcoming_first(events: DataFrame, today: str) -> DataFrame:
    return events.orderBy(*upcoming_sort(today))


def next_due(reminders: DataFrame, now) -> DataFrame:
    """The next reminder of every user at or after a moment."""
    ahead = reminders.filter(F.col("reminder_time") >= now)
    pick = F.min_by(F.struct("id", "title", "reminder_time"), F.struct("reminder_time", "id")).alias("r")
    return ahead.groupBy("user_id").agg(pick).select("user_id", "r.id", "r.title", "r.reminder_time")
