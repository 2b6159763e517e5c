"""The place audit: every section as a DataFrame, and all of them as one long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfolio.functions.places import (
    ALIAS_LABELS, coordinate_key, is_generic_name, is_suspicious_city, location_key, normalize_category,
    quality_score, similar_key, valid_coords,
)
from wayfolio.functions.text import clean_key, filled, has_text
from wayfolio.lookups import UNSPECIFIC_LABELS
from wayfolio.session import materialize
from wayfolio.operators.aggregates import (
    MISSING, count_by, duplicate_groups, missing_stats, score_distribution, summary, top_counts, with_examples,
)

# Audited fields and list lengths.
AUDITED = ("name", "religion", "denomination", "country", "city", "address", "description", "image_url", "website_url")
LABEL_LIMIT = 100
CANDIDATE_LIMIT = 50
REGION_LIMIT = 30
LIST_LIMIT = 20

KEYS = {"location": location_key, "coordinate": coordinate_key, "near": similar_key}


def scored(places: DataFrame) -> DataFrame:
    return places.withColumn("quality_score", quality_score())


def _shown(df: DataFrame) -> DataFrame:
    return df.select("quality_score", "id", "name", "city", "country", "religion")


def by_quality(places: DataFrame, n: int = LIST_LIMIT, highest: bool = True) -> DataFrame:
    score = F.desc("quality_score") if highest else F.asc("quality_score")
    return _shown(scored(places).orderBy(score, clean_key("name"), "id").limit(n))


def enrichment_candidates(places: DataFrame, column: str, n: int = LIST_LIMIT) -> DataFrame:
    """Named and located rows that lack a column, best first."""
    wanted = has_text("name") & (has_text("city") | has_text("country")) & ~has_text(column)
    return by_quality(places.filter(wanted), n)


def raw_labels(places: DataFrame, n: int) -> DataFrame:
    return top_counts(count_by(places, "religion", "label"), n, "label")


def normalized_labels(places: DataFrame, n: int = LABEL_LIMIT) -> DataFrame:
    return top_counts(count_by(places, normalize_category("religion"), "label"), n, "label")


def normalization_candidates(places: DataFrame, clear_only: bool = False) -> DataFrame:
    """All raw labels that normalise to something else; ``clear_only`` keeps the aliased ones."""
    pool = count_by(places, "religion", "label").filter(F.col("label") != MISSING)
    changed = pool.withColumn("normalized", normalize_category("label")).filter("label <> normalized")
    if clear_only:
        changed = changed.filter(clean_key("label").isin(*ALIAS_LABELS))
    return changed.select("label", "normalized", "rows")


def strange_labels(places: DataFrame) -> DataFrame:
    """All raw labels no list knows, with how they would be shown."""
    key = clean_key("label")
    known = key.isin(*ALIAS_LABELS) | key.isin(*UNSPECIFIC_LABELS) | (key == "other")
    pool = count_by(places, "religion", "label").filter((F.col("label") != MISSING) & ~known)
    return pool.select("label", normalize_category("label").alias("normalized"), "rows")


def suspicious_cities(places: DataFrame) -> DataFrame:
    return places.filter(is_suspicious_city("city")).select("id", "name", "city", "country", "religion")


def generic_names(places: DataFrame) -> DataFrame:
    return places.filter(is_generic_name("name")).select("id", "name", "city", "country", "religion")


def audit_report(places: DataFrame) -> dict[str, DataFrame]:
    """All sections of the audit, each lazily, from the same narrow projection."""
    groups = {f"duplicates_{kind}": with_examples(places, key()) for kind, key in KEYS.items()}
    return {
        "summary": summary(places),
        "missing_fields": missing_stats(places, AUDITED),
        "raw_labels": raw_labels(places, LABEL_LIMIT),
        "normalized_labels": normalized_labels(places),
        "clear_candidates": top_counts(normalization_candidates(places, clear_only=True), CANDIDATE_LIMIT, "label"),
        "strange_labels": top_counts(strange_labels(places), CANDIDATE_LIMIT, "label"),
        "countries": top_counts(count_by(places, "country"), REGION_LIMIT),
        "cities": top_counts(count_by(places, "city"), REGION_LIMIT),
        "suspicious_cities": suspicious_cities(places).orderBy("id").limit(LIST_LIMIT),
        **groups,
        "generic_names": generic_names(places).orderBy("id").limit(LIST_LIMIT),
        "score_distribution": score_distribution(places),
        "highest_quality": by_quality(places),
        "lowest_quality": by_quality(places, highest=False),
        "image_candidates": enrichment_candidates(places, "image_url"),
        "website_candidates": enrichment_candidates(places, "website_url"),
        "normalization_candidates": top_counts(normalization_candidates(places), CANDIDATE_LIMIT, "label"),
    }


def profile_counts(places: DataFrame) -> DataFrame:
    """Counts of country, city, raw label, normalised label and score in a single pass over the places.

    Each row is expanded to its five (facet, value) pairs and combined before the shuffle.
    """
    def pair(facet: str, value: Column) -> Column:
        return F.struct(F.lit(facet).alias("facet"), F.coalesce(F.nullif(value, F.lit("")), F.lit(MISSING)).alias("value"))

    facets = F.array(
        pair("country", F.col("country")), pair("city", F.col("city")), pair("raw_label", F.col("religion")),
        pair("label", normalize_category("religion")), pair("score", quality_score().cast("string")),
    )
    return places.select(F.inline(facets)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("rows"))


def duplicate_counts(places: DataFrame) -> DataFrame:
    """Number of duplicate groups of each kind, and the rows in them, in one pass."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), key().alias("dup_key")) for k, key in KEYS.items()])
    keyed = places.select(F.inline(kinds)).filter("dup_key is not null")
    groups = keyed.groupBy("kind", "dup_key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return groups.groupBy("kind").agg(F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows"))


def report_long(places: DataFrame) -> DataFrame:
    """The count sections as one table (section, key, value), three passes over the places."""
    counts = profile_counts(places).select(F.col("facet").alias("section"), F.col("value").alias("item"), F.col("rows").alias("value"))
    missing = missing_stats(places, AUDITED).select(F.lit("missing").alias("section"), F.col("field").alias("item"), F.col("missing").alias("value"))
    dups = duplicate_counts(places).select(F.lit("duplicate_groups").alias("section"), F.col("kind").alias("item"), F.col("groups").alias("value"))
    return counts.unionByName(missing).unionByName(dups)


def _audit_rows(places: DataFrame) -> DataFrame:
    """What the audit needs of each place, computed once: shown columns, labels, keys, score and which fields are filled."""
    return places.select(
        "id", "name", "city", "country", "religion", normalize_category("religion").alias("label"), quality_score().alias("score"),
        clean_key("name").alias("name_key"), is_suspicious_city("city").alias("odd_city"), is_generic_name("name").alias("generic"),
        *(key().alias(f"key_{kind}") for kind, key in KEYS.items()), valid_coords("latitude", "longitude").alias("located"),
        *(has_text(c).alias(f"has_{c}") for c in AUDITED),
    )


def _item(section: str, item: Column, wanted: Column | None = None) -> Column:
    pair = F.struct(F.lit(section).alias("section"), item.cast("string").alias("item"))
    return pair if wanted is None else F.when(wanted, pair)


def audit_counts(rows: DataFrame) -> DataFrame:
    """(section, item, rows): every place expanded to the pairs it counts for, summed before the shuffle."""
    shown = lambda c: F.coalesce(filled(F.col(c)), F.lit(MISSING))
    pairs = [
        _item("summary", F.lit("total")), _item("summary", F.lit("valid_coordinates"), F.col("located")),
        _item("summary", F.lit("missing_coordinates"), ~F.col("located")),
        *(_item("missing_fields", F.lit(c), ~F.col(f"has_{c}")) for c in AUDITED), _item("missing_fields", F.lit("coordinates"), ~F.col("located")),
        _item("raw_labels", shown("religion")), _item("normalized_labels", F.col("label")), _item("countries", shown("country")),
        _item("cities", shown("city")), _item("score_distribution", F.col("score")),
        *(_item(f"duplicates_{kind}", F.col(f"key_{kind}"), F.col(f"key_{kind}").isNotNull()) for kind in KEYS),
    ]
    expanded = rows.select(F.inline(F.array_compact(F.array(*pairs))))
    return expanded.groupBy("section", "item").agg(F.count(F.lit(1)).alias("rows"))


def _listed(rows: DataFrame) -> DataFrame:
    """The first rows of each list section; each task cuts its own before anything is shuffled."""
    named = F.col("has_name") & (F.col("has_city") | F.col("has_country"))

    def entry(section: str, wanted: Column, score: Column, name: Column) -> Column:
        return F.when(wanted, F.struct(F.lit(section).alias("section"), score.alias("first"), name.alias("second")))

    none, best, by_name = F.lit(0), -F.col("score"), F.col("name_key")
    entries = F.array(
        entry("suspicious_cities", F.col("odd_city"), none, F.lit("")), entry("generic_names", F.col("generic"), none, F.lit("")),
        entry("highest_quality", F.lit(True), best, by_name), entry("lowest_quality", F.lit(True), F.col("score"), by_name),
        entry("image_candidates", named & ~F.col("has_image_url"), best, by_name),
        entry("website_candidates", named & ~F.col("has_website_url"), best, by_name),
    )
    place = F.row_number().over(Window.partitionBy("section").orderBy("first", "second", "id"))
    about = F.concat_ws(" | ", *(F.coalesce(c, F.lit("")) for c in ("name", "city", "country", "religion")))
    expanded = rows.select("id", "score", about.alias("detail"), F.inline(F.array_compact(entries)))
    ranked = expanded.withColumn("rank", place).filter(F.col("rank") <= LIST_LIMIT)
    return ranked.select("section", "rank", F.col("id").cast("string").alias("key"), F.col("score").cast("bigint").alias("value"), "detail")


def full_audit(places: DataFrame) -> DataFrame:
    """The audit as one table (section, rank, key, value, detail) of all 19 sections; the places are read once.

    ``key`` is the counted value, the duplicate key or the id; ``value`` the count, or in lists of places the score;
    ``detail`` the normalised label, the first members of a group, or the place. The mean score is given to two decimals.
    """
    rows = materialize(_audit_rows(places))
    counts = materialize(audit_counts(rows))

    def ranked(df: DataFrame, section: str, limit: int | None, detail: Column | None = None) -> DataFrame:
        place = F.row_number().over(Window.orderBy(F.desc("rows"), "item"))
        cut = df.orderBy(F.desc("rows"), "item").limit(limit) if limit else df
        shown = (F.lit(None) if detail is None else detail).cast("string")
        return cut.select(F.lit(section).alias("section"), place.alias("rank"), F.col("item").alias("key"), F.col("rows").alias("value"), shown.alias("detail"))

    def of(section: str) -> DataFrame:
        return counts.filter(F.col("section") == section).select("item", "rows")

    def fixed(section: str, names: tuple[str, ...]) -> DataFrame:
        """A row for each name, in their order, also where nothing was counted."""
        each = of(section).agg(F.map_from_entries(F.collect_list(F.struct("item", "rows"))).alias("found"))  # one entry a name
        return each.select(F.posexplode(F.array(*map(F.lit, names))).alias("at", "key"), "found").select(
            F.lit(section).alias("section"), (F.col("at") + 1).alias("rank"), "key",
            F.coalesce(F.try_element_at("found", F.col("key")), F.lit(0)).cast("bigint").alias("value"), F.lit(None).cast("string").alias("detail"),
        )

    label = normalize_category("item")
    known = clean_key("item").isin(*ALIAS_LABELS) | clean_key("item").isin(*UNSPECIFIC_LABELS) | (clean_key("item") == "other")
    raw = of("raw_labels")
    present = raw.filter(F.col("item") != MISSING)
    changed = present.filter(F.col("item") != label)
    scores = of("score_distribution").select(F.col("item").cast("bigint").alias("score"), "rows")
    # hundredths, rounded half up in whole numbers
    total, points = F.sum("rows"), F.sum(F.col("score") * F.col("rows"))
    hundredths = F.expr("(200 * p + n) div (2 * n)")
    mean = scores.agg(total.alias("n"), points.alias("p")).filter("n > 0").select(
        F.lit("summary").alias("section"), F.lit(4).alias("rank"), F.lit("average_score_hundredths").alias("key"), hundredths.alias("value"),
        F.lit(None).cast("string").alias("detail"),
    )
    histogram = scores.select(
        F.lit("score_distribution").alias("section"), F.row_number().over(Window.orderBy("score")).alias("rank"),
        F.col("score").cast("string").alias("key"), F.col("rows").alias("value"), F.lit(None).cast("string").alias("detail"),
    )
    # the largest groups of each kind, then their first members
    largest = Window.partitionBy("section").orderBy(F.desc("rows"), "item")
    groups = counts.filter(F.col("section").startswith("duplicates_") & (F.col("rows") > 1))
    top = groups.withColumn("rank", F.row_number().over(largest)).filter(F.col("rank") <= LIST_LIMIT)
    keys = F.array(*(_item(f"duplicates_{kind}", F.col(f"key_{kind}"), F.col(f"key_{kind}").isNotNull()) for kind in KEYS))
    members = rows.select("id", "name", F.inline(F.array_compact(keys))).join(top, ["section", "item"])
    first = Window.partitionBy("section", "item").orderBy("id")
    shown = members.withColumn("n", F.row_number().over(first)).filter("n <= 3")
    line = F.concat(F.col("id").cast("string"), F.lit(": "), F.coalesce("name", F.lit("null")))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))), lambda e: e["line"]), "; ")
    duplicates = shown.groupBy("section", "rank", "item", "rows").agg(lines.alias("detail")).select(
        "section", "rank", F.col("item").alias("key"), F.col("rows").alias("value"), "detail"
    )
    parts = [
        fixed("summary", ("total", "valid_coordinates", "missing_coordinates")), mean, fixed("missing_fields", (*AUDITED, "coordinates")),
        ranked(raw, "raw_labels", LABEL_LIMIT), ranked(of("normalized_labels"), "normalized_labels", LABEL_LIMIT),
        ranked(changed.filter(clean_key("item").isin(*ALIAS_LABELS)), "clear_candidates", CANDIDATE_LIMIT, label),
        ranked(present.filter(~known), "strange_labels", CANDIDATE_LIMIT, label), ranked(of("countries"), "countries", REGION_LIMIT),
        ranked(of("cities"), "cities", REGION_LIMIT), histogram, ranked(changed, "normalization_candidates", CANDIDATE_LIMIT, label), _listed(rows), duplicates,
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


__all__ = [
    "AUDITED", "LABEL_LIMIT", "CANDIDATE_LIMIT", "REGION_LIMIT", "LIST_LIMIT", "KEYS", "scored",
    "by_quality", "enrichment_candidates", "raw_labels", "normalized_labels", "normalization_candidates",
    "strange_labels", "suspicious_cities", "generic_names", "audit_report", "profile_counts", "duplicate_counts",
    "report_long", "audit_counts", "full_audit",
]
