"""Text context for a batch of questions: seven retrieval steps, one document per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfolio.functions.books import reference
from wayfolio.functions.text import SPACE, compact_line, filled, search_term, truncate
from wayfolio.operators.geo import nearest_each
from wayfolio.operators.merge import left_lookup
from wayfolio.operators.ordered import first_per_key
from wayfolio.operators.word_index import GRAM, WordIndex, few, lookup, passing_index
from wayfolio.session import materialize

# Section titles in order, rows per section and cut lengths.
SECTIONS = (
    "Religions", "Holy Books", "Relevant Verses", "Prayers", "Temples and Sacred Places",
    "Nearby Temples", "User Favorites",
)
NAMED_LIMIT = 10
VERSE_LIMIT = 8
PRAYER_LIMIT = 8
PLACE_LIMIT = 10
NEARBY_LIMIT = 6
FAVORITE_LIMIT = 5
ABOUT_CUT = 180
VERSE_CUT = 240
PRAYER_CUT = 220
PLACE_CUT = 150


def place_spot() -> Column:
    return F.concat_ws(", ", filled("city"), filled("country"))


def passages_for_terms(terms: DataFrame, passages: DataFrame | None, limit: int, index: WordIndex | None = None) -> DataFrame:
    """The first passages (by section_id, line_no) that contain each term, without pairing terms and passages.

    ``terms`` has one distinct, non-empty ``term`` per row, of four characters or more. With a stored ``index`` the passages
    are not read.
    """
    return lookup(terms, index or passing_index(passages, limit), limit)


def _section(rows: DataFrame, number: int, order: list, line: Column) -> DataFrame:
    """Bullet lines of one section (1 to 7), at most a handful per question."""
    entry = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], line.alias("line"))
    listed = F.array_sort(F.collect_list(entry))
    lines = F.filter(F.transform(listed, lambda e: e["line"]), lambda x: x.isNotNull() & (x != ""))
    keys = [c for c in ("question_id", "_term") if c in rows.columns]
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")
    text = F.when(F.size(lines) > 0, F.concat(F.lit(f"### {SECTIONS[number - 1]}\n"), body))
    return rows.groupBy(*keys).agg(text.alias(f"s{number}"))


def build_context(
    questions: DataFrame, religions: DataFrame, books: DataFrame, passages: DataFrame, prayers: DataFrame,
    places: DataFrame, favorites: DataFrame, index: WordIndex | None = None,
) -> DataFrame:
    """One ``context`` per row of ``questions`` (question_id, user_id, message, lat, lng).

    Shared sections are computed once; verses once per distinct term; nearby places once per
    distinct position; favourites once per user. With a word ``index`` the passages are read twice: for the ids of the first of
    all, and for the sections that these, verses and favourites name.
    """
    asked = questions.withColumn("_term", search_term("message"))

    def shared(df, n, order, line, number, columns):
        # A handful of lines that is the same for every question, as one value.
        return _section(df.orderBy(*order).limit(n).select(*columns), number, order, line).scalar()

    about = compact_line("name", truncate("description", ABOUT_CUT))
    s1 = shared(religions, NAMED_LIMIT, ["name"], about, 1, ["name", "description"])
    title = compact_line("title", truncate("description", ABOUT_CUT))
    s2 = shared(books, NAMED_LIMIT, ["title"], title, 2, ["title", "description"])
    prayer = compact_line("title", "category", truncate("content", PRAYER_CUT))
    s4 = shared(prayers, PRAYER_LIMIT, ["id"], prayer, 4, ["id", "title", "category", "content"])
    place = compact_line("name", "religion", place_spot(), truncate("description", PLACE_CUT))
    s5 = shared(places, PLACE_LIMIT, ["id"], place, 5, ["id", "name", "religion", "city", "country", "description"])

    verse = compact_line(reference(F.col("title"), F.col("chapter_number"), F.col("verse_number")), truncate("content", VERSE_CUT))
    terms = asked.select(F.col("_term").alias("term")).filter("term <> ''").distinct()
    index = index or passing_index(passages.select("section_id", "line_no", "content"), VERSE_LIMIT)
    found = passages_for_terms(terms, None, VERSE_LIMIT, index).withColumnRenamed("term", "_term")
    found = materialize(found)
    mine = materialize(first_per_key(favorites, ["user_id"], ["favorite_id"], FAVORITE_LIMIT))
    opening = passages.select("section_id").orderBy("section_id").limit(VERSE_LIMIT)
    named = few(found.select("section_id").unionAll(mine.select("section_id")).unionAll(opening).distinct())
    columns = ["section_id", "line_no", "title", "chapter_number", "verse_number", "content"]
    wanted = F.col("section_id").eqNullSafe(F.col("_named"))
    picked = materialize(passages.select(*columns).join(named.select(F.col("section_id").alias("_named")), wanted, "left_semi"))
    s3 = _section(found.join(picked, ["section_id", "line_no"]), 3, ["section_id", "line_no"], verse)
    any_verse = shared(picked, VERSE_LIMIT, ["section_id", "line_no"], verse, 3, columns)

    spots = asked.filter("lat is not null and lng is not null").select("lat", "lng").distinct()
    spots = spots.withColumn("_spot", F.concat_ws(",", "lat", "lng"))
    near = nearest_each(spots, places.select("id", "name", "religion", "city", "country", "latitude", "longitude"), NEARBY_LIMIT, "_spot")
    away = F.concat(F.format_string("%.1f", F.round("distance_km", 1)), F.lit(" km away"))
    near_line = compact_line("name", "religion", place_spot(), away)
    placed = asked.filter("lat is not null and lng is not null")
    near_rows = placed.select("question_id", F.concat_ws(",", "lat", "lng").alias("_spot")).join(
        near.select("_spot", "nearest_rank", near_line.alias("_line")), "_spot"
    )
    s6 = _section(near_rows, 6, ["nearest_rank"], F.col("_line"))

    mine = mine.join(picked.drop("line_no"), ["section_id", "verse_number"], "left")
    fav_line = F.when(
        filled("content").isNotNull(),
        F.concat(reference(F.col("title"), F.col("chapter_number"), F.col("verse_number")), F.lit(" - "), F.col("content")),
    )
    fav_rows = asked.select("question_id", "user_id").join(mine.select("user_id", "favorite_id", fav_line.alias("_line")), "user_id")
    s7 = _section(fav_rows, 7, ["favorite_id"], F.col("_line"))

    out = left_lookup(asked.withColumns({"s1": s1, "s2": s2, "s4": s4, "s5": s5}), s3, "_term")
    # Questions without a term share one section as a value; they meet in no join.
    out = out.withColumn("s3", F.when(F.col("_term") == "", any_verse).otherwise(F.col("s3")))
    for part in (s6, s7):
        out = out.join(part, "question_id", "left")
    text = F.concat_ws("\n\n", *[F.col(f"s{i}") for i in range(1, 8)])
    return out.select("question_id", F.col("_term").alias("term"), text.alias("context"))


__all__ = [
    "SECTIONS", "NAMED_LIMIT", "VERSE_LIMIT", "PRAYER_LIMIT", "PLACE_LIMIT", "NEARBY_LIMIT", "FAVORITE_LIMIT",
    "ABOUT_CUT", "VERSE_CUT", "PRAYER_CUT", "PLACE_CUT", "GRAM", "place_spot", "passages_for_terms", "build_context",
]
