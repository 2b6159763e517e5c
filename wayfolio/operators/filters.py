"""Row filters: facets, text search, quality toggles, ownership and constraint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfolio.functions.books import display_religion
from wayfolio.functions.places import haversine_km, normalize_category, valid_coords
from wayfolio.functions.text import WS, col, contains_text, has_text, text, trim_space
from wayfolio.operators.spatial import near_box

# The quality toggles and the column each one asks for.
QUALITY_TOGGLES = {
    "image": "image_url", "website": "website_url", "type": "denomination",
    "city": "city", "description": "description",
}
SEARCHED_PLACE_FIELDS = ("name", "religion", "denomination", "country", "city", "address", "description")


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def facet_filter(df: DataFrame, **choices: str | None) -> DataFrame:
    """Equality on each chosen column; ``All`` or None leaves a column free."""
    return df.filter(all_of(F.col(k) == v for k, v in choices.items() if v not in (None, "All")))


def filter_any_term(df: DataFrame, column: str, terms: list[str], wildcards: bool = False) -> DataFrame:
    return df.filter(any_of(contains_text(column, t, wildcards) for t in terms))


def text_match(cols, term: str) -> Column:
    """The term occurs somewhere in the columns joined by spaces, ignoring case."""
    needle = term.strip().lower()
    if not needle:
        return F.lit(True)
    haystack = F.lower(F.concat_ws(" ", *[F.nullif(col(c), F.lit("")) for c in cols]))
    return F.contains(haystack, F.lit(needle))


def match_places(df: DataFrame, term: str) -> DataFrame:
    fields = [*SEARCHED_PLACE_FIELDS[:2], normalize_category("religion"), *SEARCHED_PLACE_FIELDS[2:]]
    return df.filter(text_match(fields, term))


def quality_filter(df: DataFrame, *keys: str) -> DataFrame:
    return df.filter(all_of(has_text(QUALITY_TOGGLES[k]) for k in keys))


def missing(c: Column | str) -> Column:
    """Null or the empty string."""
    return col(c).isNull() | (col(c) == "")


def in_keys(df: DataFrame, keys: DataFrame, on: str, key: str | None = None) -> DataFrame:
    other = keys.select(F.col(key or on).alias("__key"))
    return df.join(other, df[on] == other["__key"], "left_semi")


def within_km(df: DataFrame, lat: float, lng: float, km: float) -> DataFrame:
    """Rows at most ``km`` from a point, with the distance; bounds on both coordinates are pushed to the scan."""
    located = df.filter(near_box(lat, lng, km)).filter(valid_coords("latitude", "longitude")).withColumn(
        "distance_km", haversine_km(lat, lng, F.col("latitude"), F.col("longitude"))
    )
    return located.filter(F.col("distance_km") <= km)


def visible_to(df: DataFrame, user) -> DataFrame:
    return df.filter(F.col("user_id") == user)


def visible_via_parent(child: DataFrame, parent: DataFrame, fk: str, pk: str, user) -> DataFrame:
    """Children whose parent belongs to the user."""
    return in_keys(child, visible_to(parent, user), fk, pk)


def approved(df: DataFrame) -> DataFrame:
    return df.filter("is_approved")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule, in one pass; a rule with an unknown outcome passes, as a CHECK does."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def forbidden_hits(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows that match a pattern, with the first hit."""
    return df.filter(F.col(column).rlike(pattern)).withColumn("hit", F.regexp_extract(column, pattern, 0))


def noise(c: Column | str, patterns: list[str]) -> Column:
    """Blank, or matching any pattern; the patterns run as one alternation."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return ~has_text(c) | F.coalesce(col(c).rlike(joined), F.lit(False))


def drop_noise(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    return df.filter(~noise(column, patterns))


def search_passages(
    passages: DataFrame, term: str, book: str | None = None, religion: str | None = None,
    tradition: str | None = None, limit: int = 50, wildcards: bool = False,
) -> DataFrame:
    """Passages (with their book columns) that hold the term, facets first, then the limit."""
    kept = passages.filter(contains_text("content", term.strip(), wildcards)).filter(F.col("book_id").isNotNull())
    if book not in (None, "All"):
        kept = kept.filter(F.col("book_id") == book)
    if religion not in (None, "All"):
        kept = kept.filter(display_religion("religion") == religion)
    if tradition not in (None, "All"):
        kept = kept.filter(trim_space(text("tradition")) == tradition)
    return kept.orderBy("section_id", "line_no").limit(limit)


__all__ = [
    "QUALITY_TOGGLES", "SEARCHED_PLACE_FIELDS", "all_of", "any_of", "facet_filter", "filter_any_term", "text_match",
    "match_places", "quality_filter", "missing", "in_keys", "within_km", "visible_to", "visible_via_parent",
    "approved", "violations", "forbidden_hits", "noise", "drop_noise", "search_passages",
]
