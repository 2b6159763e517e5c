"""Books, sections and passages: reading joins, idempotent loads and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfolio.functions.books import display_religion
from wayfolio.functions.text import filled
from wayfolio.operators.aggregates import count_children
from wayfolio.operators.ordered import first_per_key, row_numbers


def passages_with_context(passages: DataFrame, sections: DataFrame, books: DataFrame) -> DataFrame:
    """Every passage with its section and book columns, where they exist."""
    context = sections.join(books, "book_id", "left")
    return passages.join(context, "section_id", "left")


def favorites_with_passage(favorites: DataFrame, passages: DataFrame, sections: DataFrame, user=None, limit: int | None = None) -> DataFrame:
    """A user's (or everyone's) favourites with the passage and section they point at, newest first."""
    mine = favorites if user is None else favorites.filter(F.col("user_id") == user)
    joined = mine.join(passages, ["section_id", "verse_number"], "left").join(
        sections.select("section_id", "chapter_number", "display_title"), "section_id", "left"
    )
    ordered = joined.orderBy(F.desc("created_at"), F.asc("favorite_id"), F.asc_nulls_last("content"))
    return ordered if limit is None else ordered.limit(limit)


def with_parent(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    return child.join(parent, child[fk] == parent[pk], "left")


def children(child: DataFrame, fk: str, parent_id, order: list) -> DataFrame:
    """The children of one parent in reading order; the filter reaches the scan."""
    return child.filter(F.col(fk) == parent_id).orderBy(*order)


def positions(sections: DataFrame, own: str | None = None) -> DataFrame:
    """Sections with their ``position``: an own number, else the sort order, else the place among the book's sections."""
    placed = row_numbers(sections, ["book_id"], ["section_id"], "_place")
    given = [*([F.col(own)] if own else []), F.col("sort_order"), F.col("_place")]
    return placed.withColumn("position", F.coalesce(*given)).drop("_place")


def reading_order(number: str = "chapter_number") -> list:
    """sort_order with nulls last, then the number with null as 0."""
    return [F.asc_nulls_last("sort_order"), F.coalesce(F.col(number), F.lit(0)).asc()]


def library(books: DataFrame) -> DataFrame:
    """Books by religion heading and title, with the size of each group beside every book."""
    labelled = books.withColumn("group_name", display_religion("religion"))
    sizes = labelled.groupBy("group_name").agg(F.count(F.lit(1)).alias("books"))
    return labelled.join(sizes, "group_name").select("group_name", "books", "title", "book_id").orderBy(
        "group_name", "title", "book_id"
    )


def renumber(df: DataFrame, part: list[str], order: list[str], label: str = "Passage") -> DataFrame:
    """Rows numbered 1..n inside a section, with a label and the number as sort order."""
    numbered = row_numbers(df, part, order, "verse_number")
    return numbered.withColumn("verse_label", F.lit(label)).withColumn("sort_order", F.col("verse_number"))


# --- loads ----------------------------------------------------------------------------


def ensure_book(meta: DataFrame, existing: DataFrame) -> DataFrame:
    """Stored books plus those of ``meta`` whose title is not stored yet."""
    absent = first_per_key(meta, ["title"], ["book_id"]).join(existing.select("title").distinct(), "title", "left_anti")
    return existing.unionByName(absent.select(*existing.columns))


def load_sections(parsed: DataFrame, existing: DataFrame, passages: DataFrame) -> DataFrame:
    """What to do with each parsed section: keep (already filled), fill (stored but empty) or insert.

    ``parsed`` and ``existing`` are keyed by book_id and chapter_number; ``passages`` by section_id. Where a number is stored
    several times, the fullest section speaks for it, the first by id of equally full ones, so no parsed row is multiplied.
    """
    stored = count_children(existing, passages, "section_id", "section_id", "stored_passages")
    state = first_per_key(
        stored.select("book_id", "chapter_number", "section_id", "stored_passages"), ["book_id", "chapter_number"],
        [F.desc("stored_passages"), F.asc("section_id")],
    )
    joined = parsed.join(state, ["book_id", "chapter_number"], "left")
    action = (
        F.when(F.col("section_id").isNull(), "insert").when(F.col("stored_passages") > 0, "keep").otherwise("fill")
    )
    return joined.withColumn("action", action)


def repair_sections(expected: DataFrame, existing: DataFrame, passages: DataFrame) -> DataFrame:
    """Mark stored sections: the earliest complete one per (book, number) is kept, all others dropped.

    ``expected`` gives the passage count of each (book_id, chapter_number); a stored section that nobody expects is dropped,
    and its ``expected`` is null.
    """
    counted = count_children(existing, passages, "section_id", "section_id", "stored")
    checked = counted.join(expected, ["book_id", "chapter_number"], "left")
    complete = checked.filter(F.col("stored") == F.col("expected"))
    kept = first_per_key(complete, ["book_id", "chapter_number"], ["created_at", "section_id"]).select(
        "section_id", F.lit(True).alias("_kept")
    )
    return (
        checked.join(kept, "section_id", "left")
        .withColumn("action", F.when(F.col("_kept"), "keep").otherwise("drop"))
        .drop("_kept")
    )


__all__ = [
    "passages_with_context", "favorites_with_passage", "with_parent", "children", "reading_order", "library", "positions",
    "renumber", "ensure_book", "load_sections", "repair_sections",
]
