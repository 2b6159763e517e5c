"""Grouped reports: counts, duplicate groups, completeness, ratings and ingest statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfolio.functions.books import classify_error
from wayfolio.functions.places import marker_style, quality_score, valid_coords
from wayfolio.functions.text import col, filled, has_text
from wayfolio.operators.ordered import first_per_key, row_numbers

MISSING = "(missing)"


def count_by(df: DataFrame, value: Column | str, name: str = "value") -> DataFrame:
    """Rows per value; null and the empty string count as missing."""
    return df.groupBy(F.coalesce(filled(col(value)), F.lit(MISSING)).alias(name)).agg(
        F.count(F.lit(1)).alias("rows")
    )


def top_counts(counts: DataFrame, n: int, name: str = "value") -> DataFrame:
    """Most frequent values first, ties by value."""
    return counts.orderBy(F.desc("rows"), F.asc(name)).limit(n)


def missing_stats(df: DataFrame, fields) -> DataFrame:
    """Rows without text per field, and rows without coordinates, in one pass."""
    counts = [F.count_if(~has_text(f)).alias(f) for f in fields]
    counts.append(F.count_if(~valid_coords("latitude", "longitude")).alias("coordinates"))
    wide = df.agg(*counts)
    return wide.unpivot([], [*fields, "coordinates"], "field", "missing")


def summary(df: DataFrame) -> DataFrame:
    ok = valid_coords("latitude", "longitude")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("valid_coordinates"),
        F.count_if(~ok).alias("missing_coordinates"),
        F.round(F.avg(quality_score()), 2).alias("average_score"),
    )


def score_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy(quality_score().alias("score")).agg(F.count(F.lit(1)).alias("rows"))


def duplicate_groups(df: DataFrame, key: Column, name: str = "dup_key") -> DataFrame:
    keyed = df.select(key.alias(name)).filter(F.col(name).isNotNull())
    return keyed.groupBy(name).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def with_examples(df: DataFrame, key: Column, examples: int = 3, top: int = 20, name: str = "dup_key") -> DataFrame:
    """The largest duplicate groups with their first few members by id.

    The group list is cut first; only its members are ranked, and no group is ever collected whole.
    """
    groups = top_counts(duplicate_groups(df, key, name), top, name)
    members = df.withColumn(name, key).join(groups, name).select(name, "rows", "id", "name")
    shown = first_per_key(members, [name], ["id"], examples)
    line = F.concat(F.col("id").cast("string"), F.lit(": "), F.coalesce(F.col("name"), F.lit("null")))
    listed = F.sort_array(F.collect_list(F.struct(F.col("id"), line.alias("line"))))
    return shown.groupBy(name, "rows").agg(
        F.array_join(F.transform(listed, lambda e: e["line"]), "; ").alias("examples")
    )


def legend(df: DataFrame) -> DataFrame:
    """Marker styles of the located rows with their counts, by label."""
    style = marker_style("religion")
    return (
        df.filter(valid_coords("latitude", "longitude"))
        .groupBy(style["label"].alias("label"), style["symbol"].alias("symbol"), style["class_name"].alias("class_name"))
        .agg(F.count(F.lit(1)).alias("places"))
        .orderBy("label")
    )


def rating_summary(reviews: DataFrame, key: str = "place_id") -> DataFrame:
    rated = F.coalesce(F.col("rating").try_cast("double"), F.lit(0.0))
    return reviews.groupBy(key).agg(
        F.round(F.avg(rated), 1).alias("average_rating"), F.count(F.lit(1)).alias("reviews")
    )


def count_children(parent: DataFrame, child: DataFrame, pk: str, fk: str, name: str = "children") -> DataFrame:
    """Exact child counts; the children are counted before they meet the parents."""
    counts = child.groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias(name))
    joined = parent.join(counts, parent[pk] == counts["_fk"], "left").drop("_fk")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("bigint"))


def corpus_summary(passages: DataFrame, book: str = "book_id", section: str = "section_id") -> DataFrame:
    """Sections and passages per book, counted per section first."""
    per_section = passages.groupBy(book, section).agg(F.count(F.lit(1)).alias("_n"))
    return per_section.groupBy(book).agg(F.count(F.lit(1)).alias("sections"), F.sum("_n").alias("passages"))


def duplicate_keys(df: DataFrame, *pk: str) -> DataFrame:
    return df.groupBy(*pk).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def facet_options(df: DataFrame, value: Column | str, name: str = "option", **given) -> DataFrame:
    """Distinct non-blank values, sorted, within the facets already chosen."""
    for k, v in given.items():
        if v not in (None, "All"):
            df = df.filter(F.col(k) == v)
    return df.select(col(value).alias(name)).filter(has_text(name)).distinct().orderBy(name)


def ids_by_category(df: DataFrame, category: str, key: str, per_row: int = 50) -> DataFrame:
    """Ids of each category as lists of at most ``per_row``, in order."""
    numbered = row_numbers(df.filter(F.col(category).isNotNull()), [category], [key], "_n")
    batch = F.floor((F.col("_n") - 1) / per_row).cast("bigint")
    ids = F.sort_array(F.collect_list(F.col(key)))
    return numbered.groupBy(category, batch.alias("batch")).agg(
        F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids")
    )


def error_summary(log: DataFrame, status: str = "status", code: str | None = None, message: str = "message") -> DataFrame:
    """Errors per kind."""
    given = F.col(code) if code else F.lit(None).cast("string")
    return log.groupBy(classify_error(status, given, message).alias("kind")).agg(F.count(F.lit(1)).alias("errors")).orderBy("kind")


OUTCOMES = ("unnamed", "generic", "no_coordinates", "duplicate", "candidate")


def ingest_stats(tagged: DataFrame, target: str = "target_id", totals: bool = False) -> DataFrame:
    """Rows per target and outcome; with ``totals`` a grand total row as well, told by ``is_total`` = 1."""
    is_dup = F.col("outcome").startswith("duplicate")
    taken = F.col("outcome").isin("accepted", "candidate")
    grouped = tagged.rollup(target) if totals else tagged.groupBy(target)
    mark = [F.grouping(target).cast("int").alias("is_total")] if totals else []
    return grouped.agg(
        *mark,
        F.count(F.lit(1)).alias("fetched"),
        F.count_if(is_dup | taken).alias("valid"),
        F.count_if(F.col("outcome") == "unnamed").alias("skipped_unnamed"),
        F.count_if(F.col("outcome") == "generic").alias("skipped_generic"),
        F.count_if(F.col("outcome") == "no_coordinates").alias("skipped_no_coordinates"),
        F.count_if(is_dup).alias("duplicates"),
        F.count_if(taken).alias("candidates"),
    )
