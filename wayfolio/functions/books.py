"""Column functions on books, sections, passages and user records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfolio.functions.text import col, filled, has_text, squeeze, text, trim_space, truncate
from wayfolio.lookups import NETWORK_CODES, SELECTION_SIGNALS

UNCLASSIFIED = "Other / Unclassified"


def display_religion(c: Column | str = "religion") -> Column:
    return F.coalesce(filled(trim_space(c)), F.lit(UNCLASSIFIED))


def type_label(c: Column | str) -> Column:
    """Readable text type: underscores as spaces, first letter of each word upper case."""
    label = squeeze(F.translate(col(c), "_", " "))
    # A word starts after any character that is neither letter, digit nor underscore.
    pieces = F.split(label, "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    upper = F.transform(
        pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))
    )
    return filled(F.array_join(upper, ""))


def slug(c: Column | str, prefix: str = "group-") -> Column:
    dashed = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-")
    return F.concat(F.lit(prefix), F.regexp_replace(dashed, "^-|-$", ""))


def is_selection(*fields: Column | str) -> Column:
    haystack = F.concat_ws(" ", *[F.lower(trim_space(text(f))) for f in fields])
    return F.exists(
        F.array(*[F.lit(w) for w in SELECTION_SIGNALS]), lambda w: F.contains(haystack, w)
    )


def section_title(display="display_title", title="title", number="chapter_number", label="section_label") -> Column:
    name = filled(trim_space(title))
    n = col(number).cast("string")
    fallback = F.trim(F.concat(F.coalesce(filled(col(label)), F.lit("Section")), F.lit(" "), text(n)))
    return (
        F.when(has_text(display), col(display))
        .when(name.isNotNull() & n.isNotNull(), F.concat(name, F.lit(" "), n))
        .otherwise(F.coalesce(name, fallback))
    )


def passage_marker(label="verse_label", number="verse_number", *fallbacks: Column | str) -> Column:
    name = F.coalesce(filled(col(label)), F.lit("Passage"))
    n = F.coalesce(*[col(x).cast("string") for x in (number, *fallbacks)])
    return F.concat_ws(" ", name, n)


def reference(title, number, verse) -> Column:
    """``Title n:m`` with a stand-in title."""
    return F.trim(
        F.concat(
            F.coalesce(col(title), F.lit("Holy book")), F.lit(" "),
            text(col(number).cast("string")), F.lit(":"), text(col(verse).cast("string")),
        )
    )


def stars(c: Column | str) -> Column:
    n = F.least(F.lit(5), F.greatest(F.lit(0), F.floor(col(c) + 0.5).cast("int")))
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), F.lit(5) - n))


def date_label(c: Column | str) -> Column:
    return F.date_format(col(c), "MMM d, yyyy")


def scope_label(is_global="is_global", country="country") -> Column:
    return F.when(col(is_global), F.lit("Global")).otherwise(F.coalesce(col(country), F.lit("Regional")))


def classify_error(status, code, message) -> Column:
    s, c, m = col(status), text(code), F.lower(text(message))

    def said(*words):
        found = F.lit(False)
        for word in words:
            found = found | F.contains(m, F.lit(word))
        return found

    return (
        F.when(s == 429, "rate_limited").when(s == 404, "not_found")
        .when(s >= 500, "server").when(s >= 400, "http")
        .when(said("timeout", "timed out"), "timeout")
        .when(c.isin(*NETWORK_CODES) | said("fetch failed", "network"), "network")
        .when(said("json", "parse"), "parsing")
        .when(c != "", "supabase")
        .otherwise("unknown")
    )


def default_name(email: Column | str) -> Column:
    """Local part of an address."""
    return F.split_part(col(email), F.lit("@"), F.lit(1))


def default_title(c: Column | str, blank: str = "AI Assistant question") -> Column:
    return F.coalesce(filled(truncate(trim_space(text(c)), 70)), F.lit(blank))
