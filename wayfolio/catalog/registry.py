"""Registration of queries, and SQL snippets shared by their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfolio.fixtures import Tables, with_views
from wayfolio.lookups import (
    CATEGORY_ALIASES, GENERIC_NAMES, QUALITY_WEIGHTS, UNSPECIFIC, UNSPECIFIC_LABELS,
)

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def add(name: str, build: Callable[[Tables], DataFrame], views: str = "", sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = build
    if sql is not None:
        _ORACLE[name] = with_views(views, sql)


def _bind(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(spark, sf_dir))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(build) for name, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


# --- DuckDB snippets ------------------------------------------------------------------


def sq(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "(" + ", ".join(sq(v) for v in values) + ")"


def folded(c: str) -> str:
    return f"regexp_replace(regexp_replace(trim(coalesce({c}, '')), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')"


def key_of(c: str) -> str:
    return f"lower({folded(c)})"


def name_of(c: str) -> str:
    return f"lower(regexp_replace(trim(coalesce({c}, '')), '\\s+', ' ', 'g'))"


def filled_sql(c: str) -> str:
    return f"(length(trim(coalesce({c}, ''))) > 0)"


def words_up(c: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"


def display_of(c: str) -> str:
    return f"CASE WHEN {folded(c)} = '' THEN {sq(UNSPECIFIC)} ELSE {words_up(folded(c))} END"


def label_of(c: str) -> str:
    whens = " ".join(f"WHEN {sq(k)} THEN {sq(v[0])}" for k, v in CATEGORY_ALIASES.items())
    return (
        f"(CASE WHEN {key_of(c)} IN {sql_list(CATEGORY_ALIASES)} THEN CASE {key_of(c)} {whens} END "
        f"WHEN {key_of(c)} IN {sql_list(UNSPECIFIC_LABELS)} THEN {sq(UNSPECIFIC)} "
        f"WHEN {key_of(c)} = 'other' THEN 'Other' ELSE {display_of(c)} END)"
    )


def cell_of(c: str, digits: int) -> str:
    return f"CAST(floor(abs({c}) * {10 ** digits} + 0.5) * sign({c}) AS BIGINT)"


SCORE = (
    "CAST(" + " + ".join(f"CASE WHEN {filled_sql(c)} THEN {w} ELSE 0 END" for c, w in QUALITY_WEIGHTS.items())
    + " + CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 1 ELSE 0 END AS INTEGER)"
)
GENERIC = sql_list(GENERIC_NAMES)


def similar_of(c: str) -> str:
    return (
        f"substr(regexp_replace(regexp_replace({key_of(c)}, '\\b(the|saint|st)\\b', '', 'g'), '[^a-z0-9]+', '', 'g'), 1, 42)"
    )


def key3(*parts: str) -> str:
    cond = " AND ".join(f"coalesce({p}, '') <> ''" for p in parts)
    return f"CASE WHEN {cond} THEN " + " || '|' || ".join(f"({p})" for p in parts) + " END"


LOCATION = key3(key_of("name"), key_of("city"), key_of("country"))
COORDINATE = key3(
    key_of("name"), f"CAST({cell_of('latitude', 5)} AS VARCHAR)", f"CAST({cell_of('longitude', 5)} AS VARCHAR)"
)
NEAR = key3(
    similar_of("name"), f"CAST({cell_of('latitude', 3)} AS VARCHAR)", f"CAST({cell_of('longitude', 3)} AS VARCHAR)"
)
EXTERNAL = (
    f"CASE WHEN coalesce(source, '') <> '' AND coalesce(external_id, '') <> '' "
    f"THEN {key_of('source')} || '|' || {key_of('external_id')} END"
)
POINT = (
    f"CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN {name_of('name')} || '|' || "
    f"CAST({cell_of('latitude', 6)} AS VARCHAR) || '|' || CAST({cell_of('longitude', 6)} AS VARCHAR) END"
)
NAMED = key3(name_of("name"), name_of("city"), name_of("country"))


def km(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """Great-circle distance by the spherical law of cosines' half-angle form, radius 6371 km."""
    a = (
        f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
        f"power(sin(radians({lng2} - {lng1}) / 2), 2))"
    )
    return f"(2 * 6371 * asin(sqrt(CASE WHEN {a} > 1 THEN 1 ELSE {a} END)))"
