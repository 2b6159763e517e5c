"""Corpus jobs, page structure and question context."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from wayfolio.catalog.registry import add, filled_sql, km
from wayfolio.catalog.scalar_queries import HTML_TEXT
from wayfolio.functions.markup import HEADING, STOP, Rule, blocks
from wayfolio.functions.text import clean_line, html_to_text, once, search_term, strip_tags
from wayfolio.lookups import SEARCH_STOP_WORDS
from wayfolio.operators import sequences as S
from wayfolio.operators.word_index import add_to_word_index, passing_index, read_word_index
from wayfolio.plans import context as X
from wayfolio.plans import corpus as K
from wayfolio.plans.library import passages_with_context
from wayfolio.session import scratch_path

add(
    "h5_index_links",
    lambda t: S.index_links(t("pages").select("page_id", "url", F.concat(F.lit("<a href=\""), "url", F.lit("\">"), F.col("page_id").cast("string"), F.lit("</a>"), F.col("html")).alias("html")),
                            "html", "<a href=\"([^\"]*)\">(\\d+)</a>"),
    "",
    "SELECT page_id, CAST(page_id AS INTEGER) AS number, url AS target FROM pages WHERE page_id >= 1",
)
add(
    "h5_all_links",
    lambda t: t.pages.select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<a href=\"([^\"]*)\">"), F.lit(1))).alias("link_no", "target")
    ),
    "",
    """SELECT page_id, CAST(i - 1 AS INTEGER) AS link_no, links[i] AS target FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS links,
  unnest(range(1, len(regexp_extract_all(html, '<a href="([^"]*)">', 1)) + 1)) AS i FROM pages)""",
)


def _verse_rows(t):
    n = F.length("content")
    head = F.when(n % 5 == 0, F.concat(n.cast("string"), F.lit(", "), (n + 1).cast("string"))).when(n % 5 == 1, n.cast("string"))
    return t("passages").select("section_id", "line_no", F.concat(F.coalesce(F.concat(head, F.lit(". ")), F.lit("")), "content").alias("row_text"))


add(
    "h6_explode_numbers",
    lambda t: S.explode_numbers(_verse_rows(t), "row_text").select("section_id", "line_no", "number", "verse"),
    "passages",
    r"""WITH n AS (SELECT section_id, line_no, length(content) AS n, nullif(trim(regexp_replace(content, '\s+', ' ', 'g')), '') AS verse FROM passages)
SELECT section_id, line_no, CAST(n AS INTEGER) AS number, verse FROM n WHERE n % 5 IN (0, 1) AND n > 0 AND verse IS NOT NULL
UNION ALL SELECT section_id, line_no, CAST(n + 1 AS INTEGER), verse FROM n WHERE n % 5 = 0 AND verse IS NOT NULL""",
)


def _marked(t):
    """Every sentence end becomes a numbered marker, on documents of even id."""
    marked = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "\\. ", " (7) ")).otherwise(F.col("text"))
    return t.documents.select("doc_id", marked.alias("text"))


add(
    "h7_split_numbered",
    # outer, then filtered: for a plain explode Spark infers a filter that splits every text once more
    lambda t: _marked(t).select("doc_id", F.posexplode_outer(S.split_numbered("text")).alias("part_no", "content")).filter("part_no is not null"),
    "",
    r"""WITH m AS (SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN replace(text, '. ', ' (7) ') ELSE text END, '\s+', ' ', 'g')) AS flat FROM documents),
k AS (SELECT doc_id, flat, len(regexp_extract_all(flat, '\(\s*\d+\s*\)')) AS markers FROM m),
c AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(trim(parts[i]), '(?i)^\(\s*[ivxlcdm]+\s*\)\s*', ''), '^\[[^\]]+\]\s*', '')) AS content
  FROM (SELECT doc_id, string_split_regex(flat, '\(\s*\d+\s*\)') AS parts FROM k WHERE markers > 1) p, unnest(range(1, len(parts) + 1)) AS r(i)),
w AS (SELECT doc_id, 1 AS i, trim(regexp_replace(trim(regexp_replace(regexp_replace(flat, '(?i)\(\s*[ivxlcdm\d]+\s*\)', '', 'g'), '\s+', ' ', 'g')), '^\[[^\]]+\]\s*', '')) AS content FROM k WHERE markers <= 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS part_no, content
FROM (SELECT * FROM c WHERE length(content) >= 8 UNION ALL SELECT * FROM w WHERE content <> '')""",
)
_PARAGRAPHS = r"""p AS (SELECT page_id, i, nullif(trim(regexp_replace(replace(replace(regexp_replace(parts[i], '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')), '') AS content
  FROM (SELECT page_id, regexp_extract_all(html, '(?is)<p(?:\s+[^>]*)?>(.*?)</p>', 1) AS parts FROM pages) x, unnest(range(1, len(parts) + 1)) AS r(i))"""
add(
    "h8_paragraphs_html",
    lambda t: t.pages.select("page_id", F.posexplode(S.paragraphs("html")).alias("paragraph_no", "fragment"))
    .select("page_id", "paragraph_no", strip_tags("fragment").alias("content")).filter("content is not null"),
    "", f"WITH {_PARAGRAPHS} SELECT page_id, CAST(i - 1 AS INTEGER) AS paragraph_no, content FROM p WHERE content IS NOT NULL",
)
_BLOCKS = f"""t AS (SELECT page_id, {HTML_TEXT} AS text FROM pages),
b AS (SELECT page_id, i, nullif(trim(regexp_replace(parts[i], '\\s+', ' ', 'g')), '') AS content
  FROM (SELECT page_id, string_split_regex(text, '\\n\\s*\\n') AS parts FROM t) x, unnest(range(1, len(parts) + 1)) AS r(i))"""
add(
    "h8_paragraphs_blocks",
    lambda t: t.pages.select("page_id", F.posexplode(S.paragraphs(html_to_text("html"), "blocks")).alias("block_no", "block"))
    .select("page_id", "block_no", clean_line("block").alias("content")).filter("content is not null"),
    "", f"WITH {_BLOCKS} SELECT page_id, CAST(i - 1 AS INTEGER) AS block_no, content FROM b WHERE content IS NOT NULL",
)

# --- corpus profiles over the test documents ------------------------------------------

WORD = "\\S+"
BY_UNITS = K.Profile("units", "units", heading=WORD, sections=(1, 3), passages=(5, 60), forbidden="(?i)licen[cs]ed? under|all rights reserved")
BY_STANZAS = K.Profile("stanzas", "stanzas", heading="[A-Z]\\S*", speaker="[^A-Z\\n]\\S*", sections=(1, 4), passages=(2, 40))
BY_LINES = K.Profile("lines", "lines", noise=("(?i)licen[cs]e", "^All rights"), sections=(1, 1), passages=(2, 30), forbidden="(?i)copyright|@")
BY_PARAGRAPHS = K.Profile("pages", "html_paragraphs", source="raw", sections=(1, 1), passages=(3, 40), forbidden="(?i)menu|cookie")


def _pages(t):
    return t.pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


def _docs(t):
    return t.documents


_CLEAN = "nullif(trim(regexp_replace(translate(content, '“”‘’–—', '\"\"''''--'), '\\s+', ' ', 'g')), '')"
_LINES = f"""l AS (SELECT section_id AS doc_id, line_no, content, {_CLEAN} AS line FROM passages),
n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS verse FROM l
  WHERE line IS NOT NULL AND NOT regexp_matches(content, '(?i)licen[cs]e') AND NOT regexp_matches(content, '^All rights'))"""
add(
    "i_segment_lines", lambda t: K.segment_corpus(_docs(t), BY_LINES).filter("content is not null").select("doc_id", "section_no", "verse_number", "content"),
    "passages", f"WITH {_LINES} SELECT doc_id, CAST(1 AS INTEGER) AS section_no, CAST(verse AS INTEGER) AS verse_number, line AS content FROM n",
)
add(
    "i_validate_lines", lambda t: K.validate_corpus(K.segment_corpus(_docs(t), BY_LINES), BY_LINES), "passages",
    f"""WITH {_LINES}, c AS (SELECT d.doc_id, count(n.doc_id) AS rows FROM documents d LEFT JOIN n USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(1 AS INTEGER) AS section_no, 'empty_section' AS rule, 'error' AS severity, 'no passages' AS detail FROM c WHERE rows = 0
UNION ALL SELECT doc_id, NULL, 'too_few_passages', 'error', CAST(rows AS VARCHAR) FROM c WHERE rows < 2
UNION ALL SELECT doc_id, NULL, 'too_many_passages', 'error', CAST(rows AS VARCHAR) FROM c WHERE rows > 30
UNION ALL SELECT doc_id, 1, 'forbidden_text', 'error', regexp_extract(arg_min(line, verse), '(?i)copyright|@') || ' x' || count(*)
  FROM n WHERE regexp_matches(line, '(?i)copyright|@') GROUP BY doc_id""",
)
_UNIT_LINES = f"""f AS (SELECT section_id AS doc_id, line_no, {_CLEAN} AS line, regexp_matches(content, '^\\S+$') AS head FROM passages),
s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM f)"""
add(
    "i_section_counts", lambda t: K.segment_corpus(_docs(t), BY_UNITS).groupBy("doc_id").agg(F.count_distinct("section_no").alias("sections")), "passages",
    f"WITH {_UNIT_LINES} SELECT doc_id, max(section_no)::BIGINT AS sections FROM s GROUP BY 1 HAVING max(section_no) > 0",
)
_UNITS = f"""{_UNIT_LINES},
heads AS (SELECT doc_id, section_no, line AS heading FROM s WHERE head),
n AS (SELECT doc_id, section_no, line, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY line_no) AS i FROM s
  WHERE NOT head AND section_no > 0 AND line IS NOT NULL),
w AS (
  SELECT doc_id, section_no, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS len, CAST(0 AS BIGINT) AS unit, true AS shut, CAST(NULL AS VARCHAR) AS line FROM n WHERE i = 1
  UNION ALL
  SELECT w.doc_id, w.section_no, n.i, CASE WHEN w.shut THEN length(n.line) ELSE w.len + 1 + length(n.line) END,
    w.unit + CASE WHEN w.shut THEN 1 ELSE 0 END,
    regexp_matches(n.line, '[.!?;:,]["'']?-?$') OR CASE WHEN w.shut THEN length(n.line) ELSE w.len + 1 + length(n.line) END > 480, n.line
  FROM w JOIN n ON n.doc_id = w.doc_id AND n.section_no = w.section_no AND n.i = w.i + 1),
u AS (SELECT doc_id, section_no, unit, string_agg(line, ' ' ORDER BY i) AS content FROM w WHERE i > 0 GROUP BY 1, 2, 3)"""
add(
    "i_segment_units",
    lambda t: K.segment_corpus(_docs(t), BY_UNITS).filter("content is not null").select("doc_id", "section_no", "heading", "verse_number", "content"),
    "passages",
    f"""WITH RECURSIVE {_UNITS}
SELECT doc_id, CAST(section_no AS INTEGER) AS section_no, heading, CAST(unit AS INTEGER) AS verse_number, content FROM u JOIN heads USING (doc_id, section_no)""",
)
add(
    "i_validate_units", lambda t: K.validate_corpus(K.segment_corpus(_docs(t), BY_UNITS), BY_UNITS), "passages",
    f"""WITH RECURSIVE {_UNITS},
c AS (SELECT doc_id, section_no, count(content) AS rows FROM heads LEFT JOIN u USING (doc_id, section_no) GROUP BY 1, 2),
d AS (SELECT doc_id, count(*) AS sections, sum(rows) AS rows FROM c GROUP BY 1),
h AS (SELECT doc_id, section_no, regexp_extract(arg_min(content, unit), '(?i)licen[cs]ed? under|all rights reserved') || ' x' || count(*) AS detail
  FROM u WHERE regexp_matches(content, '(?i)licen[cs]ed? under|all rights reserved') GROUP BY 1, 2)
SELECT doc_id, CAST(section_no AS INTEGER) AS section_no, 'empty_section' AS rule, 'error' AS severity, 'no passages' AS detail FROM c WHERE rows = 0
UNION ALL SELECT doc_id, CAST(section_no AS INTEGER), 'forbidden_text', 'error', detail FROM h
UNION ALL SELECT doc_id, NULL, 'too_many_sections', 'error', CAST(sections AS VARCHAR) FROM d WHERE sections > 3
UNION ALL SELECT doc_id, NULL, 'too_few_passages', 'error', CAST(rows AS VARCHAR) FROM d WHERE rows < 5
UNION ALL SELECT doc_id, NULL, 'too_many_passages', 'error', CAST(rows AS VARCHAR) FROM d WHERE rows > 60""",
)
add(
    "i_segment_stanzas", lambda t: K.segment_corpus(_docs(t), BY_STANZAS).select("doc_id", "section_no", "heading", "verse_number", "content"), "passages",
    f"""WITH f AS (SELECT section_id AS doc_id, line_no, {_CLEAN} AS line, regexp_matches(content, '^[A-Z]\\S*$') AS head FROM passages),
s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM f),
b AS (SELECT doc_id, section_no, line_no, line, regexp_matches(line, '^[^A-Z]\\S*$') AS speaks FROM s WHERE NOT head AND section_no > 0 AND line IS NOT NULL),
r AS (SELECT *, sum(CASE WHEN speaks THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section_no ORDER BY line_no) AS run FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_no, run ORDER BY line_no) - 1 AS k FROM r WHERE NOT speaks),
g AS (SELECT doc_id, section_no, run, k // 4 AS g, string_agg(line, ' ' ORDER BY line_no) AS body FROM k GROUP BY 1, 2, 3, 4),
v AS (SELECT g.*, CASE WHEN g = 0 AND p.line IS NOT NULL THEN p.line || ' ' ELSE '' END || body AS content,
  row_number() OVER (PARTITION BY g.doc_id, g.section_no ORDER BY g.run, g) AS verse
  FROM g LEFT JOIN (SELECT * FROM r WHERE speaks) p ON p.doc_id = g.doc_id AND p.section_no = g.section_no AND p.run = g.run)
SELECT h.doc_id, CAST(h.section_no AS INTEGER) AS section_no, h.line AS heading, CAST(verse AS INTEGER) AS verse_number, content
FROM (SELECT * FROM s WHERE head) h LEFT JOIN v ON v.doc_id = h.doc_id AND v.section_no = h.section_no""",
)
add(
    "i_segment_pages", lambda t: K.segment_corpus(_pages(t), BY_PARAGRAPHS).filter("content is not null").select("doc_id", "verse_number", "content"),
    "",
    f"""WITH {_PARAGRAPHS} SELECT page_id AS doc_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INTEGER) AS verse_number, content
FROM p WHERE content IS NOT NULL""",
)
add(
    "i_validate_pages", lambda t: K.validate_corpus(K.segment_corpus(_pages(t), BY_PARAGRAPHS), BY_PARAGRAPHS).select("doc_id", "rule", "severity", "detail"),
    "",
    f"""WITH {_PARAGRAPHS}, c AS (SELECT g.page_id, count(content) AS rows FROM pages g LEFT JOIN p USING (page_id) GROUP BY 1)
SELECT page_id AS doc_id, 'empty_section' AS rule, 'error' AS severity, 'no passages' AS detail FROM c WHERE rows = 0
UNION ALL SELECT page_id, 'too_few_passages', 'error', CAST(rows AS VARCHAR) FROM c WHERE rows < 3
UNION ALL SELECT page_id, 'too_many_passages', 'error', CAST(rows AS VARCHAR) FROM c WHERE rows > 40
UNION ALL SELECT page_id, 'forbidden_text', 'error', regexp_extract(arg_min(content, i), '(?i)menu|cookie') || ' x' || count(*)
  FROM p WHERE regexp_matches(content, '(?i)menu|cookie') GROUP BY page_id""",
)

# --- question context -----------------------------------------------------------------


def _book_passages(t):
    rows = passages_with_context(t("passages"), t("sections"), t("books"))
    return rows.select("section_id", "line_no", (F.col("line_no") + 1).alias("verse_number"), "content", "title", "chapter_number")


def _questions(t):
    """Every user turn is a question; users and positions follow from its conversation."""
    asked = t("conversation_messages").filter("role = 'user'")
    spot = F.col("conv_id") % 23
    return asked.select(
        F.concat_ws("/", "conv_id", "turn").alias("question_id"), "user_id", F.col("content").alias("message"),
        F.when(spot < 17, ((spot * 7919) % 160000).cast("double") / 1000 - 80).alias("lat"),
        F.when(spot < 17, ((spot * 104729) % 350000).cast("double") / 1000 - 175).alias("lng"),
    )


def _context(t):
    religions = t("nation").select(F.col("n_name").alias("name"), F.concat(F.lit("About "), F.lower("n_name")).alias("description"))
    prayers = t("supplier").select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("Prayer "), F.col("s_suppkey").cast("string")).alias("title"),
        F.lit("daily").alias("category"), F.col("s_name").alias("content"),
    )
    books = t("books").select("title", F.col("text_type").alias("description"))
    favorites = t("favorites").select("favorite_id", F.col("user_id"), F.col("section_id"), F.col("verse_number"))
    index = passing_index(t("passages"), X.VERSE_LIMIT)  # words need no titles
    return X.build_context(_questions(t), religions, books, _book_passages(t), prayers, t("places"), favorites, index)


_STOP = "(" + ", ".join(f"'{w}'" for w in SEARCH_STOP_WORDS) + ")"
_ASKED = f"""asked AS (SELECT conv_id || '/' || turn AS question_id, user_id, CASE WHEN conv_id % 23 < 17 THEN CAST((conv_id % 23 * 7919) % 160000 AS DOUBLE) / 1000 - 80 END AS lat,
  CASE WHEN conv_id % 23 < 17 THEN CAST((conv_id % 23 * 104729) % 350000 AS DOUBLE) / 1000 - 175 END AS lng,
  coalesce(list_filter(string_split_regex(regexp_replace(lower(content), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 3 AND w NOT IN {_STOP})[1], '') AS term
  FROM conversation_messages WHERE role = 'user')"""


def _terms(t):
    return _questions(t).select(search_term("message").alias("term")).filter("term <> ''").distinct()


def _first_passages(t):
    return X.passages_for_terms(_terms(t), t("passages"), X.VERSE_LIMIT)


_FIRST_SQL = f"""WITH {_ASKED}, terms AS (SELECT DISTINCT term FROM asked WHERE term <> ''),
r AS (SELECT term, section_id, line_no, row_number() OVER (PARTITION BY term ORDER BY section_id, line_no) AS n
  FROM terms, passages WHERE contains(lower(content), term))
SELECT term, section_id, line_no FROM r WHERE n <= 8"""
add("h4_passages_for_terms", _first_passages, "passages conversation_messages", _FIRST_SQL)


def _indexed(t):
    """The lookup through a stored index that was written in two batches, the later one with the earlier sections."""
    path = scratch_path(t.spark, "words")
    passages = t("passages")
    for batch, own in (("1", passages.filter("section_id % 2 = 1")), ("2", passages.filter("section_id % 2 = 0"))):
        add_to_word_index(own, path, batch, X.VERSE_LIMIT)
    return X.passages_for_terms(_terms(t), None, X.VERSE_LIMIT, read_word_index(t.spark, path, X.VERSE_LIMIT))


add("h4_indexed_passages", _indexed, "passages conversation_messages", _FIRST_SQL)


def _block(n: int, title: str, rows: str, key: str) -> str:
    """One section as text per key, from rows with columns (key, pos, line)."""
    return (
        f"s{n} AS (SELECT {key}, '### {title}' || chr(10) || string_agg('- ' || line, chr(10) ORDER BY pos) AS s{n} "
        f"FROM ({rows}) WHERE line <> '' GROUP BY {key})"
    )


def _line(*parts: str) -> str:
    return "concat_ws(' - ', " + ", ".join(f"CASE WHEN {filled_sql(p)} THEN {p} END" for p in parts) + ")"


_SPOT = "concat_ws(', ', nullif(city, ''), nullif(country, ''))"
_REFERENCE = "trim(coalesce(title, 'Holy book') || ' ' || coalesce(CAST(chapter_number AS VARCHAR), '') || ':' || coalesce(CAST(verse_number AS VARCHAR), ''))"
add(
    "h4_build_context", _context,
    "books sections passages places favorites conversation_messages",
    f"""WITH {_ASKED},
verses AS (SELECT p.section_id, line_no, line_no + 1 AS verse_number, content, title, chapter_number FROM passages p
  LEFT JOIN sections s USING (section_id) LEFT JOIN books b ON b.book_id = s.book_id),
{_block(1, 'Religions', "SELECT 1 AS one, n_name AS pos, n_name || ' - About ' || lower(n_name) AS line FROM (SELECT * FROM nation ORDER BY n_name LIMIT 10)", 'one')},
{_block(2, 'Holy Books', "SELECT 1 AS one, title AS pos, title || ' - ' || text_type AS line FROM (SELECT * FROM books ORDER BY title LIMIT 10)", 'one')},
terms AS (SELECT DISTINCT term FROM asked),
ranked AS (SELECT term, verses.*, row_number() OVER (PARTITION BY term ORDER BY section_id, line_no) AS n FROM terms, verses WHERE term = '' OR contains(lower(content), term)),
{_block(3, 'Relevant Verses', f"SELECT term, n AS pos, {_line(_REFERENCE, 'substr(content, 1, 240)')} AS line FROM ranked WHERE n <= 8", 'term')},
{_block(4, 'Prayers', "SELECT 1 AS one, s_suppkey AS pos, 'Prayer ' || s_suppkey || ' - daily - ' || s_name AS line FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 8)", 'one')},
{_block(5, 'Temples and Sacred Places', f"SELECT 1 AS one, id AS pos, {_line('name', 'religion', _SPOT, 'substr(description, 1, 150)')} AS line FROM (SELECT * FROM places ORDER BY id LIMIT 10)", 'one')},
spots AS (SELECT DISTINCT lat, lng FROM asked WHERE lat IS NOT NULL),
near AS (SELECT lat, lng, p.*, round({km('lat', 'lng', 'latitude', 'longitude')}, 6) AS d FROM spots, places p WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
nearest AS (SELECT *, row_number() OVER (PARTITION BY lat, lng ORDER BY d, id) AS n FROM near),
{_block(6, 'Nearby Temples', f"SELECT lat, lng, n AS pos, {_line('name', 'religion', _SPOT, 'away')} AS line FROM (SELECT *, format('{{:.1f}} km away', round(d, 1)) AS away FROM nearest WHERE n <= 6)", 'lat, lng')},
mine AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY favorite_id) AS n FROM favorites),
{_block(7, 'User Favorites', f"SELECT user_id, favorite_id AS pos, CASE WHEN content <> '' THEN {_REFERENCE} || ' - ' || content END AS line FROM (SELECT mine.user_id, favorite_id, v.* FROM mine JOIN verses v ON v.section_id = mine.section_id AND v.verse_number = mine.verse_number WHERE n <= 5)", 'user_id')}
SELECT question_id, term, concat_ws(chr(10) || chr(10), s1, s2, s3, s4, s5, s6, s7) AS context
FROM asked LEFT JOIN s1 ON true LEFT JOIN s2 ON true LEFT JOIN s4 ON true LEFT JOIN s5 ON true LEFT JOIN s3 USING (term)
LEFT JOIN s6 ON s6.lat = asked.lat AND s6.lng = asked.lng LEFT JOIN s7 ON s7.user_id = asked.user_id""",
)

# --- profiles of real works over the test documents, written out as such works ---------

NESTED = replace(K.PROFILES["book-of-mormon"], opens=None, closes=None)
ALIGNED = replace(K.PROFILES["japji-sahib"], opens=None, closes=None, noise=("^\\* \\* \\*$",), plan=tuple(f"Part {n}" for n in range(1, 31)), cues=(), tidy=())
BLOCKS = K.Profile(
    "articles", "paragraphs", source="blocks", heading=f"{HEADING}[^\\n]*",
    rules=(Rule("heading", "h1"), Rule("stop", "div", "foot(?:er)?"), Rule("drop", "div"), Rule("text", "p")), section_stop=(f"^{STOP}$",),
)
#: Lines of a chapter, and chapters of a book; every other book has no heading for its first chapter.
VERSES, CHAPTERS = 4, 3


def _plain_lines(t):
    """Non-blank lines of every document, without digits and colons, as an array."""
    return t.documents.select("doc_id", S.clean_lines(F.regexp_replace("text", "[0-9:]", ""), clean_line).alias("lines"))


def _nested_works(t):
    titles = F.array(F.lit(""), *(F.lit(title) for title, _ in NESTED.books))
    names = F.array(F.lit(NESTED.first_book), *(F.lit(name) for _, name in NESTED.books))

    def block(line, i):
        chapter, verse = F.floor(i / VERSES).cast("int"), i % VERSES + 1
        book, number = (F.floor(chapter / CHAPTERS) % len(NESTED.chapters)).cast("int"), chapter % CHAPTERS + 1
        opens = (verse == 1) & (number == 1) & (i > 0)
        headed = (verse == 1) & ((number > 1) | (book % 2 == 0))
        return F.concat(
            F.when(opens, F.concat(F.get(titles, book), F.lit("\n\n"))).otherwise(F.lit("")),
            F.when(headed, F.concat(F.get(names, book), F.lit(" Chapter "), number.cast("string"), F.lit("\n\n"))).otherwise(F.lit("")),
            number.cast("string"), F.lit(":"), verse.cast("string"), F.lit("\n"), line,
        )

    # at most one round of the books, so that every heading differs; longer texts are parted
    size = VERSES * CHAPTERS * len(NESTED.chapters)
    def parted(lines):
        pieces = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / size).cast("int")))
        return F.transform(pieces, lambda k: F.slice(lines, k * size + 1, F.lit(size)))

    # texts without lines go behind the explode: a filter before it would make all lines twice
    parts = F.posexplode_outer(once(F.col("lines"), parted)).alias("part_no", "lines")
    rows = _plain_lines(t).select("doc_id", parts).filter("part_no is not null")
    return rows.select(
        F.concat_ws("/", "doc_id", "part_no").alias("doc_id"), F.array_join(F.transform("lines", block), "\n\n").alias("text")
    )


_WORK_LINES = f"""raw AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS content FROM (SELECT doc_id, string_split(regexp_replace(text, '[0-9:]', '', 'g'), chr(10)) AS l FROM documents)),
w AS (SELECT doc_id, {_CLEAN} AS line, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i FROM raw WHERE {_CLEAN} IS NOT NULL)"""
_SPAN = VERSES * CHAPTERS * len(NESTED.chapters)
_BOOK_LIST = "[" + ", ".join(f"'{name}'" for name in (NESTED.first_book, *(name for _, name in NESTED.books))) + "]"
add(
    "i_nested_books",
    lambda t: K.segment_corpus(_nested_works(t), NESTED).select("doc_id", "section_no", "part", "section_number", "heading", "verse_number", "content"),
    "",
    f"""WITH {_WORK_LINES}, p AS (SELECT doc_id, line, i // {_SPAN} AS piece, i % {_SPAN} AS i FROM w)
SELECT doc_id || '/' || piece AS doc_id, CAST(i // {VERSES} + 1 AS INTEGER) AS section_no, {_BOOK_LIST}[i // {VERSES * CHAPTERS} + 1] AS part,
  CAST(i // {VERSES} % {CHAPTERS} + 1 AS INTEGER) AS section_number, part || ' ' || section_number AS heading, CAST(i % {VERSES} + 1 AS INTEGER) AS verse_number, line AS content FROM p""",
)


def _planned_works(t):
    """Headings of a plan between the lines; every fifth is repeated far behind its place, where it is text."""
    numeral = F.array(*map(F.lit, ROMAN))

    def line(x, i):
        number = F.floor(i / 5).cast("int") + 1
        head = F.when((i % 5 == 0) & (number < len(ALIGNED.plan)), F.concat(F.lit("### "), F.get(numeral, number - 1), F.lit(".\n"))).otherwise(F.lit(""))
        again = F.when((i % 25 == 24) & (number < len(ALIGNED.plan)), F.lit("\n### I.")).otherwise(F.lit(""))
        return F.concat(head, x, again)

    first = F.transform(F.slice("lines", 1, 100), line)
    return _plain_lines(t).filter(F.size("lines") > 0).select("doc_id", F.array_join(F.concat(first, F.slice("lines", F.lit(101), F.size("lines"))), "\n").alias("text"))


ROMAN = [
    "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX", "XXI", "XXII", "XXIII", "XXIV",
    "XXV", "XXVI", "XXVII", "XXVIII", "XXIX", "XXX",
]
add(
    "i_planned_sections",
    lambda t: K.segment_corpus(_planned_works(t), ALIGNED).select("doc_id", "section_no", "heading", "content"), "",
    f"""WITH {_WORK_LINES}, s AS (SELECT doc_id, i, least(i // 5, 19) + 2 AS section, line FROM w),
t AS (SELECT doc_id, section, string_agg(CASE WHEN i < 100 AND i % 25 = 24 THEN line || ' ### I.' ELSE line END, ' ' ORDER BY i) AS content FROM s GROUP BY 1, 2)
SELECT doc_id, CAST(section AS INTEGER) AS section_no, 'Part ' || section AS heading, content FROM t
UNION ALL SELECT DISTINCT doc_id, 1, 'Part 1', CAST(NULL AS VARCHAR) FROM w""",
)
_P_TEXT = "nullif(trim(regexp_replace(replace(replace(regexp_replace(p, '<[^>]+>', ' ', 'g'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')), '')"
add(
    "i_block_text",
    lambda t: t.pages.select("page_id", F.posexplode(blocks("html", "h1|p")).alias("block_no", "b")).select("page_id", "block_no", "b.tag", "b.class", "b.id", "b.text"),
    "",
    f"""WITH b AS (SELECT page_id, unnest(range(0, len(l))) AS block_no, unnest(l) AS p FROM (
  SELECT page_id, string_split_regex(regexp_replace(regexp_replace(html, '^.*?(<(?:h1|p)[\\s>/])', '\\1', 's'), '<((?:h1|p)[\\s>/])', chr(1) || '<\\1', 'g'), chr(1))[2:] AS l FROM pages)),
c AS (SELECT page_id, block_no, regexp_extract(p, '^<(\\w+)', 1) AS tag, regexp_extract(regexp_extract(p, '^<[^>]*>'), '\\sclass="([^"]*)"', 1) AS class,
  regexp_extract(regexp_extract(p, '^<[^>]*>'), '\\sid="([^"]*)"', 1) AS id, regexp_replace(regexp_replace(p, '^<[^>]*>', ''), '</(?:h1|p)\\s*>.*$', '', 's') AS p FROM b)
SELECT page_id, CAST(block_no AS INTEGER) AS block_no, tag, class, id, {_P_TEXT} AS text FROM c""",
)
