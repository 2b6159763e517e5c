"""Raw documents to numbered passages, and the checks that gate a load.

``segment_corpus`` runs one profile over a table of documents without a shuffle: every step is
an expression on the text of one document. ``validate_corpus`` reports findings as rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfolio.functions.text import (
    clean_line, clean_text, html_to_text, once, roman_to_int, squeeze, strip_tags, strip_wikitext, text,
)
from wayfolio.functions.markup import HEADING, chosen_text
from wayfolio.plans.profiles import GUTENBERG, HAN, PROFILES, SITE, TAIL, Layout, Profile
from wayfolio.session import materialize
from wayfolio.sources.json_rows import explode_book_json
from wayfolio.operators.sequences import (
    UNIT_END, aligned_headings, assign_sections, clean_lines, drop_footnotes, expected_headings, group_stanzas, group_units, joined_lines,
    paragraphs, split_numbered, split_on_phrases, split_passages,
)


def _between(body: Column, opens: str | None, closes: str | None, found: bool) -> Column:
    """The text behind the first ``opens`` and before the first ``closes`` behind it; with ``found`` null where one is missing."""
    for pattern, cut in ((opens, "(?s:\\A.*?)(?:{})"), (closes, "(?:{})(?s:.*)\\z")):
        if pattern:
            flags, bare = re.match("(?s)((?:\\(\\?[a-z]+\\))?)(.*)", pattern).groups()
            shorter = F.regexp_replace(body, flags + cut.format(bare), "")
            body = F.when(body.rlike(pattern), shorter) if found else shorter
    return body


def _plain(docs: DataFrame, profile: Profile) -> DataFrame:
    """``docs`` with the text that sections are looked for in; null where its limits are not found.

    Each step is a projection of its own, so that a step that looks at the text twice doesn't evaluate the ones before twice.
    """
    body, steps = F.col("text"), []
    steps += [F.regexp_replace(body, cut, "") for cut in profile.cuts]
    marked_up = profile.source in ("blocks", "raw")
    if marked_up:
        steps.append(_between(body, profile.opens, profile.closes, True))
    if profile.source == "blocks":
        steps.append(chosen_text(body, profile.rules))
    elif profile.source == "html":
        steps.append(html_to_text(body))
    elif profile.source == "either":
        steps.append(F.when(body.rlike("(?i)<html|<body|<p|<h\\d"), html_to_text(body)).otherwise(body))
    elif profile.source == "wiki":
        steps.append(strip_wikitext(body))
    steps.append(F.replace(body, F.lit("\r"), F.lit("")))
    if not marked_up:
        steps.append(_between(body, profile.opens, profile.closes, True))
    if profile.method != "planned":  # where tidying would take away what ends a footnote, it comes later
        steps.append(_tidied(body, profile))
    if profile.flat:
        case, heading = re.match(r"((?:\(\?[a-z]+\))?)(.*)", profile.heading).groups()
        steps.append(F.regexp_replace(F.regexp_replace(body, "\\s+", " "), f"{case}\\b({heading})\\s*", "\n$1\n"))
    if profile.stops:
        steps.append(F.regexp_replace(body, _to_end(profile.stops), ""))
    if profile.split_heading:
        steps.append(F.regexp_replace(body, f"(?m)^({profile.split_heading})[ \\t]*", "$1\n"))
        if profile.opening is not None:
            begins = body.rlike(f"\\A\\s*{profile.split_heading}")
            steps.append(F.when(begins, body).otherwise(F.concat(F.lit("§ 0.\n"), body)))
    if profile.layouts:
        steps.append(_laid_out(body, profile.layouts))
    for step in steps:
        docs = docs.withColumn("text", step)
    return docs


def _tidied(body: Column, profile: Profile) -> Column:
    for pattern, replacement in profile.tidy:
        body = F.regexp_replace(body, pattern, replacement)
    return body


def _laid_out(body: Column, layouts: tuple[Layout, ...]) -> Column:
    """Lines of the text, read by the layout whose marks occur most often in it, the first of equal ones."""
    counts = [F.regexp_count(body, F.lit(layout.marks)) for layout in layouts]
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    out = F.lit(None).cast("string")
    for layout, count in reversed(list(zip(layouts, counts, strict=True))):
        own = _between(body, layout.opens, layout.closes, False)
        if layout.noise:
            own = _lines_without(own, layout.noise)
        if layout.split:
            own = F.array_join(F.split(squeeze(own), layout.split), "\n")
        if layout.bare:
            own = F.array_join(_bare(F.split(own, "\n"), layout.bare), "\n")
        out = F.when(count == most, own).otherwise(out)
    return out


def _to_end(lines: tuple[str, ...]) -> str:
    """A pattern from the first line that matches one of ``lines`` to the end of the text."""
    return "(?m)" + "|".join(f"(?:{p})" for p in lines).join(("(?:", ")")) + "(?s:.*)\\z"


def _bare(lines: Column, front: str) -> Column:
    return F.transform(lines, lambda x: F.regexp_replace(x, front, ""))


def _lines_without(c: Column, noise: tuple[str, ...]) -> Column:
    joined = "|".join(f"(?:{p})" for p in noise)
    return F.array_join(F.filter(F.split(c, "\\n"), lambda x: ~F.trim(x).rlike(joined)), "\n")


def _without_noise(c: Column, profile: Profile) -> Column:
    return _lines_without(c, profile.noise) if profile.noise else c


def _without_end(body: Column, stops: tuple[str, ...]) -> Column:
    """The text before the first line that matches the first pattern that occurs at all."""
    out = body
    for pattern in reversed(stops):
        out = F.when(body.rlike(_to_end((pattern,))), F.regexp_replace(body, _to_end((pattern,)), "")).otherwise(out)
    return out


def _numbered_from(items: Column, least: int = 1) -> Column:
    """Contents as (number, content), numbered from 1 and without blanks."""
    kept = F.filter(items, lambda x: x.isNotNull() & (F.length(x) >= least))
    return F.transform(kept, lambda x, i: F.struct((i + 1).alias("number"), x.alias("content")))


def _explicit(body: Column, opening: str, digits: str) -> Column:
    """Slices opened by ``opening`` whose number is read from the marker itself."""
    pieces = F.filter(F.split(body, f"(?={opening})"), lambda p: p.rlike(f"\\A(?:{opening})"))
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.regexp_extract(p, digits, 1).try_cast("int").alias("number"),
            clean_line(F.regexp_replace(p, f"\\A(?:{opening})", "")).alias("content"),
        ),
    )


def passages_of(body: Column, profile: Profile) -> Column:
    """The passages of one section body as an array of (number, content)."""
    method, cleaned = profile.method, joined_lines(body)
    if method == "units":
        return _numbered_from(group_units(cleaned))
    if method == "stanzas":
        return _numbered_from(group_stanzas(cleaned, profile.speaker or "(?!)"))
    if method == "numbered":
        slices = F.filter(F.split(cleaned, "(?m)^(?=\\d+(?:, ?\\d+)*[.,]? )"), lambda p: p.rlike("^\\d"))

        def spread(piece):
            numbers = F.split(F.regexp_extract(piece, "^(\\d+(?:, ?\\d+)*)[.,]? ", 1), ", ?")
            content = clean_line(F.regexp_replace(piece, "^\\d+(?:, ?\\d+)*[.,]? ", ""))
            return F.transform(numbers, lambda n: F.struct(n.try_cast("int").alias("number"), content.alias("content")))

        return F.flatten(F.transform(slices, spread))
    if method == "markers":
        opening = profile.marker
        if "(\\d+)" in opening:
            return _explicit(body, opening, opening)
        pieces = F.filter(F.split(body, f"(?={opening})"), lambda p: p.rlike(f"\\A(?:{opening})"))
        bare = F.transform(pieces, lambda p: F.regexp_replace(p, f"\\A(?:{opening})\\s*", ""))
        if profile.commentary:
            bare = F.transform(bare, lambda p: F.regexp_replace(p, f"\\n(?:{profile.commentary})(?s:.*)\\z", ""))
        return _numbered_from(F.transform(bare, clean_line))
    if method == "anchors":
        slices = _explicit(body, profile.marker, profile.marker)
        verse = F.transform(
            slices,
            lambda s: F.struct(
                s["number"].alias("number"), strip_tags(F.regexp_replace(s["content"], "(?is)^.*?<B>\\s*\\d+\\s*</B>", "")).alias("content")
            ),
        )
        return F.filter(verse, lambda v: (v["number"] >= 1) & v["content"].isNotNull())
    if method == "phrases":
        return _numbered_from(split_on_phrases(cleaned, list(profile.phrases)))
    if method == "passages":
        return _numbered_from(split_passages(cleaned))
    if method == "whole":
        return _numbered_from(F.array(squeeze(body)))
    if method == "lines":
        return _numbered_from(F.split(cleaned, "\\n"), profile.least)
    if method == "leading_number":
        # a paragraph without a number of its own has none; the checks report it
        return F.transform(
            F.filter(F.transform(paragraphs(body, "blocks"), clean_line), lambda p: p.isNotNull()),
            lambda p: F.struct(
                F.regexp_extract(p, "^(\\d+)[.,]?\\s+", 1).try_cast("int").alias("number"),
                clean_line(F.regexp_replace(p, "^\\d+[.,]?\\s+", "")).alias("content"),
            ),
        )
    if method in ("paragraphs", "blocks"):
        return _numbered_from(F.transform(paragraphs(body, "blocks"), clean_line), profile.least)
    if method == "html_paragraphs":
        return _numbered_from(F.transform(paragraphs(body, "html"), strip_tags))
    if method == "split_numbered":
        blocks = F.transform(paragraphs(body, "html"), strip_tags)
        return _numbered_from(F.flatten(F.transform(F.filter(blocks, lambda b: b.isNotNull()), split_numbered)))
    raise ValueError(f"unknown method {method}")


def _expected_sections(docs: DataFrame, profile: Profile) -> DataFrame:
    """Sections of a text whose numbered lines are headings only when they are next in order."""
    lined = docs.withColumn("_lines", clean_lines("text")).withColumn(
        "_heads", expected_headings(F.col("_lines"), profile.marker, profile.sections[1], profile.sure)
    )
    rows = lined.select("*", F.posexplode("_heads").alias("_pos", "_head"))
    following = F.coalesce(F.get("_heads", F.col("_pos") + 1)["index"], F.size("_lines"))
    own = F.slice("_lines", F.col("_head.index") + 1, following - F.col("_head.index"))
    head = F.get("_lines", F.col("_head.index"))
    body = F.transform(
        own, lambda line, i: F.when(i == 0, F.regexp_replace(line, profile.marker, "")).otherwise(line)
    )
    bare = F.transform(body, lambda x: squeeze(F.regexp_replace(x, "^\\s*\\d+\\.\\s*", "")))
    return rows.select(
        "doc_id", *(c for c in ("work_id", "page_no") if c in docs.columns), (F.col("_pos") + 1).alias("section_no"), F.col("_head.number").alias("section_number"),
        head.alias("heading"), _numbered_from(bare).alias("_passages"),
    )


def _nested_sections(docs: DataFrame, profile: Profile) -> DataFrame:
    """Chapters of the books inside a work: one split at the headings of books, one in each book at those of chapters.

    A book's name comes from its heading, or from the chapter's, which names it too. Passages before a book's first chapter
    heading are its chapter 1. Numbers restart with each book.
    """
    blocks = F.regexp_replace(F.trim(F.col("text")), "\\n[ \\t]*\\n\\s*", "\u0003")
    blocks = F.replace(F.regexp_replace(blocks, "\\s*\\n\\s*", " "), F.lit("\u0003"), F.lit("\n"))
    blocks = F.array_join(clean_lines(blocks, clean_line), "\n")
    names = F.create_map(*(F.lit(x) for pair in profile.books for x in pair))
    titles = "|".join(re.escape(title) for title, _ in profile.books)
    marker = profile.marker

    def chapters(book):
        title = F.upper(F.substring_index(book, "\n", 1))
        name = F.coalesce(F.try_element_at(names, title), F.lit(profile.first_book))
        parts = F.filter(F.split(book, f"(?m)^(?={profile.heading}$)"), lambda p: p != "")

        def numbered(first):
            headed = first.rlike(f"^(?:{profile.heading})$")
            number = F.when(headed, F.regexp_extract(first, f"^(?:{profile.heading})$", 2).try_cast("int")).otherwise(1)
            own = F.when(headed, F.regexp_extract(first, f"^(?:{profile.heading})$", 1)).otherwise(name)
            return F.struct(own.alias("part"), number.alias("number"), headed.alias("headed"))

        def chapter(part, head):
            def verses(line):
                pieces = F.filter(F.split(line, f"(?:^|(?<=\\s))(?={marker})"), lambda v: v.rlike(f"^{marker}"))
                return F.transform(pieces, lambda v: F.struct(
                    # a verse that names another chapter has no number here
                    F.when(F.regexp_extract(v, f"^{marker}", 1).try_cast("int") == head["number"], F.regexp_extract(v, f"^{marker}", 2).try_cast("int")).alias("number"),
                    clean_line(F.regexp_replace(v, f"^{marker}", "")).alias("content"),
                ))

            passages = F.flatten(F.transform(F.split(part, "\n"), verses))
            return F.struct(head["part"].alias("part"), head["number"].alias("number"), passages.alias("passages"), head["headed"].alias("headed"))

        def headed_chapter(part):
            return once(numbered(F.substring_index(part, "\n", 1)), lambda head: chapter(part, head))

        return F.filter(F.transform(parts, headed_chapter), lambda c: c["headed"] | (F.size(c["passages"]) > 0))

    books = F.filter(F.split(blocks, f"(?im)^(?=(?:{titles})$)"), lambda b: b != "")
    rows = docs.select("*", F.posexplode_outer(F.flatten(F.transform(books, chapters))).alias("_pos", "_c")).filter("_c is not null")
    return rows.select(
        "doc_id", *(c for c in ("work_id", "page_no") if c in docs.columns), (F.col("_pos") + 1).alias("section_no"), F.col("_c.number").alias("section_number"),
        F.concat_ws(" ", "_c.part", "_c.number").alias("heading"), F.col("_c.part").alias("part"), F.col("_c.passages").alias("_passages"),
    )


def _planned_sections(docs: DataFrame, profile: Profile) -> DataFrame:
    """Sections of a text whose headings are aligned with a plan: what precedes the first is the plan's first section."""
    # a note runs to the line that closes it, or to what can't be part of it
    note = f"(?s)\\A\\s*{profile.footnote}.*?(?:\\][ \\t]*(?=\\n|\\z)|(?=\\n\\s*(?:\\{{p\\.\\s*\\d+\\}}|###\\s|(?i:SLOK)\\s*(?:\\n|\\z)))|\\z)"
    pieces = F.transform(F.split(F.col("text"), f"(?m)^(?=[ \\t]*{profile.footnote})"), lambda p: F.regexp_replace(p, note, ""))
    lines = clean_lines(_tidied(F.array_join(pieces, ""), profile))
    heading = f"^(?:{profile.heading})$"

    def numbered(found):
        line = found["line"]
        shown = F.regexp_extract(line, heading, 1)
        number = F.when(line.rlike(heading), (roman_to_int(shown) if profile.number == "roman" else shown.try_cast("int")) + 1)
        inside = F.lit(False)
        for cue, place in reversed(profile.cues):
            number = F.when(line.rlike(cue), F.lit(place)).otherwise(number)
            inside = F.when(line.rlike(cue), F.lit(place < len(profile.plan))).otherwise(inside)
        return F.struct(number.cast("int").alias("number"), found["index"].alias("index"), inside.alias("inside"))

    # the few lines that may be headings are numbered, and only they are folded
    maybe = "|".join((heading, *(cue for cue, _ in profile.cues)))
    places = F.filter(F.transform("_lines", lambda line, i: F.when(line.rlike(maybe), i)), lambda i: i.isNotNull())
    lined = docs.withColumn("_lines", lines).withColumn("_places", places)
    lined = lined.withColumn("_found", F.transform("_places", lambda i: F.struct(F.get("_lines", i).alias("line"), i.alias("index"))))
    lined = lined.withColumn("_numbered", F.transform("_found", numbered))
    lined = lined.withColumn("_numbered", F.filter("_numbered", lambda h: h["number"].isNotNull() & (h["number"] > 1)))
    opening = F.array(F.struct(F.lit(1).alias("number"), F.lit(-1).alias("index"), F.lit(False).alias("inside")))
    lined = lined.withColumn("_aligned", aligned_headings(F.col("_numbered"), len(profile.plan)))
    lined = lined.withColumn("_heads", F.when(F.size("_lines") > 0, F.concat(opening, F.col("_aligned"))))
    # outer, then filtered: for a plain explode Spark infers a filter on the array, and writes all steps out once more for it
    rows = lined.select("*", F.posexplode_outer("_heads").alias("_pos", "_head")).filter("_head is not null")
    begins = F.col("_head.index") + F.when(F.col("_head.inside"), 0).otherwise(1)
    ends = F.coalesce(F.get("_heads", F.col("_pos") + 1)["index"], F.size("_lines"))
    own = F.slice("_lines", begins + 1, F.greatest(ends - begins, F.lit(0)))
    joined = "|".join(f"(?:{p})" for p in profile.noise)
    body = F.array_join(F.filter(own, lambda x: ~x.rlike(joined)), " ")
    return rows.select(
        "doc_id", *(c for c in ("work_id", "page_no") if c in docs.columns), F.col("_head.number").alias("section_no"),
        F.col("_head.number").alias("section_number"), F.get(F.array(*map(F.lit, profile.plan)), F.col("_head.number") - 1).alias("heading"),
        _numbered_from(F.array(squeeze(body))).alias("_passages"),
    )


def _window_sections(docs: DataFrame, profile: Profile) -> DataFrame:
    """The selected section that a page holds: from its first paragraph to the one that ends it.

    Steps are columns of their own, so that no expression is evaluated, or even written down, more than once.
    """
    noise = "|".join(f"(?:{p})" for p in profile.noise)
    starts, stops = (F.array(*(F.lit(w[k]) for w in profile.windows)) for k in (1, 2))

    def unlabelled(c):
        for label in profile.labels:
            c = F.regexp_replace(c, label, "")
        return clean_line(c)

    def meets(p, pattern):
        return F.coalesce(F.rlike(p["raw"], pattern), F.lit(False)) | F.coalesce(F.rlike(p["clean"], pattern), F.lit(False))

    def judged(p, i):
        shown = p["clean"].isNotNull() & p["content"].isNotNull() & ~p["clean"].rlike(noise) & ~p["content"].rlike(noise)
        kept = shown & (F.length(p["content"]) >= profile.least)
        return F.struct(p["raw"].alias("raw"), p["clean"].alias("clean"), p["content"].alias("content"), F.coalesce(kept, F.lit(False)).alias("kept"), i.alias("i"))

    steps = {
        "_html": paragraphs("text", "html"),
        "_raw": F.transform("_html", strip_tags),
        "_tidy": F.transform("_raw", lambda x: F.struct(clean_line(_tidied(x, profile)).alias("raw"))),
        "_clean": F.transform("_tidy", lambda p: F.struct(p["raw"].alias("raw"), unlabelled(p["raw"]).alias("clean"))),
        "_bare": F.transform("_clean", lambda p: F.struct(p["raw"].alias("raw"), p["clean"].alias("clean"), unlabelled(p["clean"]).alias("content"))),
        "_p": F.transform("_bare", judged),
        "_w": F.get(F.filter(F.sequence(F.lit(0), F.lit(len(profile.windows) - 1)), lambda w: F.exists("_p", lambda p: meets(p, F.get(starts, w)))), 0),
        "_begin": F.get(F.filter("_p", lambda p: meets(p, F.get(starts, F.col("_w")))), 0)["i"],
        "_first": F.get(F.filter("_p", lambda p: p["kept"] & (p["i"] >= F.col("_begin"))), 0)["i"],
        "_end": F.get(F.filter("_p", lambda p: (p["i"] > F.col("_first")) & meets(p, F.get(stops, F.col("_w")))), 0)["i"],
        "_own": F.filter("_p", lambda p: p["kept"] & (p["i"] >= F.col("_first")) & (F.col("_end").isNull() | (p["i"] < F.col("_end")))),
    }
    for name, step in steps.items():
        docs = docs.withColumn(name, step)
    return docs.select(
        "doc_id", *(c for c in ("work_id", "page_no") if c in docs.columns), F.lit(1).alias("section_no"), F.lit(1).alias("section_number"),
        F.get(F.array(*(F.lit(w[0]) for w in profile.windows)), F.col("_w")).alias("heading"),
        _numbered_from(F.flatten(F.transform("_own", lambda p: split_numbered(p["content"])))).alias("_passages"),
    )


def segment_corpus(docs: DataFrame, profile: Profile) -> DataFrame:
    """Passages of every document: doc_id, section_no, section_number, heading, verse_number, content.

    A section without passages keeps one row with null content, so that checks can see it. Works whose books have chapters of
    their own have a column ``part``, the book, besides. Columns ``work_id`` and
    ``page_no`` of a document that is one page of a work are kept.
    """
    of_work = [c for c in ("work_id", "page_no") if c in docs.columns]
    if profile.method == "json":
        verses = explode_book_json(docs.select("doc_id", *of_work, F.col("text").alias("json")))
        return verses.select(
            "doc_id", *of_work, F.col("chapter_number").alias("section_no"), F.col("chapter_number").alias("section_number"),
            F.lit(None).cast("string").alias("heading"), "verse_number", clean_line("content").alias("content"),
        )
    plain = _plain(docs.select("doc_id", *of_work, "text"), profile)
    if profile.method == "expected":
        sections = _expected_sections(plain.withColumn("text", _without_noise(F.col("text"), profile)), profile)
    elif profile.method == "nested":
        sections = _nested_sections(plain, profile)
        of_work = [*of_work, "part"]
    elif profile.method == "planned":
        sections = _planned_sections(plain, profile)
    elif profile.method == "windows":
        sections = _window_sections(plain, profile)
    else:
        if profile.heading:
            split = assign_sections(plain, "text", profile.heading)
        else:
            split = plain.select("doc_id", *of_work, F.lit(1).alias("section_no"), F.lit(None).cast("string").alias("heading"), F.col("text").alias("body"))
        body = F.col("body")
        if profile.section_stop:
            body = _without_end(body, profile.section_stop)
        if profile.source != "raw":
            body = _without_noise(body, profile)
        if profile.footnote:
            body = drop_footnotes(body, profile.footnote)
        number = F.col("section_no").cast("int")
        if profile.number:
            shown = F.regexp_extract("heading", f"^(?:{profile.heading})$", 1)
            number = roman_to_int(shown) if profile.number == "roman" else shown.try_cast("int")
        sections = split.select(
            "doc_id", *of_work, "section_no", number.alias("section_number"),
            F.when(F.startswith("heading", F.lit(HEADING)), F.regexp_replace(F.substr("heading", F.lit(2)), "^\\[|\\]$", ""))
            .otherwise(F.col("heading")).alias("heading"),
            passages_of(body, profile).alias("_passages"),
        )
        if profile.source == "raw" and profile.noise:
            joined = "|".join(f"(?:{p})" for p in profile.noise)
            sections = sections.withColumn(
                "_passages",
                _numbered_from(F.transform(F.filter("_passages", lambda p: ~p["content"].rlike(joined)), lambda p: p["content"])),
            )
    if profile.opening is not None:
        long = F.filter("_passages", lambda p: F.length(p["content"]) > profile.opening)
        sections = sections.withColumn("_passages", F.when(F.col("heading") == "§ 0.", _numbered_from(F.transform(long, lambda p: p["content"])))
                                       .otherwise(F.col("_passages")))
        # A text that begins with its first heading has no opening; an empty one is none.
        sections = sections.filter((F.col("heading") != "§ 0.") | (F.size("_passages") > 0))
        sections = sections.withColumn("heading", F.when(F.col("heading") == "§ 0.", F.lit("Opening")).otherwise(F.col("heading")))
    rows = sections.select(
        "doc_id", *of_work, "section_no", "section_number", "heading", F.posexplode_outer("_passages").alias("_pos", "_p")
    )
    return rows.select(
        "doc_id", *of_work, F.col("section_no").cast("int").alias("section_no"), "section_number", "heading",
        F.col("_p.number").alias("verse_number"), F.col("_p.content").alias("content"),
    )


# --- checks ---------------------------------------------------------------------------


def _finding(condition: Column, rule: str, severity: str, detail: Column) -> Column:
    return F.when(
        condition,
        F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail")),
    )


def validate_corpus(passages: DataFrame, profile: Profile, numbered: bool = True, docs: DataFrame | None = None) -> DataFrame:
    """Findings as rows: doc_id, section_no (null for whole documents), rule, severity, detail; work_id if given.

    Rules: section and passage counts, empty or repeated sections, section numbers missing or unexpected, headings out of
    order, gaps in the numbering, forbidden text (the first hit of a section and how many passages have one). Where a
    profile's documents are pages of a work, counts are of the work (``work_id``, ``page_no``), and its pages are checked.

    Where a profile has a plan of books and chapters, chapters are numbered inside their book and held against it; expected
    titles and the passages of each section are checked where the profile has them. With ``docs`` a document without any
    section is a finding too.

    Passages are counted per number, then per section, then per work; no step gathers numbers or findings in a row.
    """
    paged = profile.pages is not None
    of_work = [c for c in ("work_id", "page_no") if c in passages.columns]
    nested = bool(profile.chapters)
    place = [*of_work, "doc_id", *(["part"] if nested else []), "section_no", "section_number", *(["heading"] if profile.titles else [])]
    hit = F.col("content").rlike(profile.forbidden) if profile.forbidden else F.lit(False)
    per_number = passages.groupBy(*place, "verse_number").agg(
        F.count("content").alias("rows"), F.count_if(hit).alias("hits"),
        F.min(F.when(hit, F.struct(F.coalesce("verse_number", F.lit(0)), "content"))).alias("hit"),
    )
    per_section = materialize(per_number.groupBy(*place).agg(
        F.sum("rows").alias("rows"), F.sum(F.when(F.col("verse_number").isNotNull(), F.col("rows")).otherwise(0)).alias("counted"),
        F.max("verse_number").alias("top"), F.count("verse_number").alias("numbers"),
        F.sum("hits").alias("hits"), F.min("hit").alias("hit"),
    ))
    found = F.regexp_extract("hit.content", profile.forbidden or "", 0)
    order = F.col("section_number") != F.col("section_no")
    checks = [
        _finding(F.col("rows") == 0, "empty_section", "error", F.lit("no passages")),
        *([] if nested else [_finding(order, "heading_order", "warning", F.concat(F.lit("found "), F.col("section_number"), F.lit(", expected "), F.col("section_no"))),
        _finding(F.col("section_number") > F.col("section_no"), "heading_ahead", "error", F.concat(F.lit("found "), F.col("section_number")))]),
        _finding(F.col("hits") > 0, "forbidden_text", "error", F.concat(found, F.lit(" x"), F.col("hits"))),
    ]
    if numbered:
        checks += [
            _finding(F.col("numbers") < F.col("counted"), "repeated_number", "error", F.col("counted") - F.col("numbers")),
            _finding(F.col("counted") < F.col("rows"), "unnumbered", "error", F.col("rows") - F.col("counted")),
            _finding(F.col("counted") < F.col("numbers"), "empty_passage", "error", F.col("numbers") - F.col("counted")),
            _finding(F.col("numbers") < F.col("top"), "number_gap", "error", F.col("top") - F.col("numbers")),
        ]
    if profile.per_section:
        wanted = F.get(F.array(*map(F.lit, profile.per_section)), F.col("section_no") - 1)
        checks.append(_finding(F.col("rows") != wanted, "section_passages", "error", F.concat(F.col("rows"), F.lit(", expected "), wanted)))
    shown = [*(c for c in of_work if c == "work_id"), "doc_id", "section_no", "f.rule", "f.severity", "f.detail"]
    out = per_section.select("*", F.explode(F.array_compact(F.array(*checks))).alias("f")).select(*shown)

    counted = "work_id" if paged and "work_id" in of_work else "doc_id"
    part = "page_no" if counted == "work_id" else "unit" if nested else "section_number"
    per_section = per_section.withColumn("unit", F.concat_ws(" ", "part", "section_number")) if nested else per_section
    name = "page" if counted == "work_id" else "section"
    low, high = profile.pages if counted == "work_id" else profile.sections
    low_p, high_p = (1, 10 ** 9) if paged and counted == "doc_id" else profile.passages
    heads = [*(["work_id"] if "work_id" in of_work else []), *(["doc_id"] if counted == "doc_id" else [])]
    unit = F.count_distinct("doc_id") if counted == "work_id" else F.count(F.lit(1))
    per_part = per_section.groupBy(*heads, part).agg(unit.alias("parts"), F.sum("rows").alias("rows"))
    per_work = materialize(per_part.groupBy(*heads).agg(
        F.sum("parts").alias("parts"), F.sum("rows").alias("rows"), F.count(part).alias("seen"),
    ))
    repeated = F.col("parts") - F.col("seen")
    work_checks = F.array_compact(F.array(
        _finding(F.col("parts") < low, f"too_few_{name}s", "error", F.col("parts")),
        _finding(F.col("parts") > high, f"too_many_{name}s", "error", F.col("parts")),
        _finding(F.col("rows") < low_p, "too_few_passages", "error", F.col("rows")),
        _finding(F.col("rows") > high_p, "too_many_passages", "error", F.col("rows")),
        _finding(repeated > 0, f"repeated_{name}", "error", repeated),
    ))

    def whole(rows: DataFrame, finding: Column) -> DataFrame:
        placed = rows.withColumn("f", finding).withColumn("section_no", F.lit(None).cast("int"))
        if "doc_id" not in rows.columns:
            placed = placed.withColumn("doc_id", F.lit(None).cast(passages.schema["doc_id"].dataType))
        return placed.select(*shown)

    out = out.unionByName(whole(per_work.withColumn("_f", F.explode(work_checks)), F.col("_f")))
    if low == high:
        units = F.sequence(F.lit(1), F.lit(high))
        if nested:
            books = F.array(*(F.struct(F.lit(b).alias("book"), F.lit(n).alias("chapters")) for b, n in profile.chapters))
            named = F.transform(books, lambda b: F.transform(F.sequence(F.lit(1), b["chapters"]), lambda n: F.concat_ws(" ", b["book"], n)))
            units = F.flatten(named)
        wanted = per_work.select(*heads, F.explode(units).alias("_n"))
        seen = per_part.select(*(F.col(h).alias(f"_{h}") for h in heads), F.col(part).alias("_seen"))
        same = F.col("_n") == F.col("_seen")
        for h in heads:
            same = same & F.col(h).eqNullSafe(F.col(f"_{h}"))
        out = out.unionByName(whole(wanted.join(seen, same, "left_anti"), _finding(F.lit(True), f"missing_{name}", "error", F.col("_n"))))
        if nested:
            beyond = per_part.filter(~F.array_contains(units, F.col("unit")))
            out = out.unionByName(whole(beyond, _finding(F.lit(True), f"unexpected_{name}", "error", F.col("unit"))))
    if profile.titles:
        bare = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, "\\[[0-9]+\\]", ""), "\\.$", ""))
        titles = per_work.select(*heads, F.explode(F.array(*map(F.lit, profile.titles))).alias("_title"))
        found_titles = per_section.select(*(F.col(h).alias(f"_{h}") for h in heads), bare(clean_line("heading")).alias("_seen"))
        same = F.lower("_title") == F.col("_seen")
        for h in heads:
            same = same & F.col(h).eqNullSafe(F.col(f"_{h}"))
        out = out.unionByName(whole(titles.join(found_titles, same, "left_anti"), _finding(F.lit(True), "missing_title", "error", F.col("_title"))))
    if docs is not None:
        empty = docs.select(*(c for c in shown if c in docs.columns and c in ("doc_id", "work_id"))).join(per_section.select("doc_id"), "doc_id", "left_anti")
        out = out.unionByName(whole(empty, _finding(F.lit(True), "no_sections", "error", F.lit("no text found"))), allowMissingColumns=True)
    return out


def set_diff(actual: DataFrame, expected: DataFrame, on: list[str]) -> DataFrame:
    """Members only expected (missing) and only found (unexpected)."""
    a, e = actual.select(*on).distinct(), expected.select(*on).distinct()
    missing = e.join(a, on, "left_anti").withColumn("state", F.lit("missing"))
    return missing.unionByName(a.join(e, on, "left_anti").withColumn("state", F.lit("unexpected")))


def numbering_gaps(df: DataFrame, part: list[str], number: str) -> DataFrame:
    """Ranges of numbers absent between 1 and the largest, per group, and repeated numbers."""
    from wayfolio.operators.ordered import neighbors

    counted = df.filter(F.col(number) >= 1).groupBy(*part, number).agg(F.count(F.lit(1)).alias("_n"))
    # Each number looks back once; nothing before the first reads as 0.
    linked = neighbors(counted, part, [number], previous={"_before": number})
    before = F.coalesce(F.col("_before"), F.lit(0))
    gaps = linked.filter(F.col(number) - before > 1).select(
        *part, F.lit("gap").alias("issue"), (before + 1).cast("bigint").alias("first"), (F.col(number) - 1).cast("bigint").alias("last")
    )
    repeats = counted.filter("_n > 1").select(
        *part, F.lit("repeated").alias("issue"), F.col(number).cast("bigint").alias("first"), F.col(number).cast("bigint").alias("last")
    )
    return gaps.unionByName(repeats)


def sequence_breaks(sections: DataFrame, part: list[str], order: list[str], number: str) -> DataFrame:
    """Sections whose own number differs from their place; ahead of it is an error, behind a warning."""
    from wayfolio.operators.ordered import row_numbers

    placed = row_numbers(sections, part, order, "expected")
    return placed.filter(F.col(number) != F.col("expected")).withColumn(
        "severity", F.when(F.col(number) > F.col("expected"), "error").otherwise("warning")
    )


__all__ = [
    "Profile", "Layout", "GUTENBERG", "HAN", "SITE", "TAIL", "PROFILES", "passages_of",
    "segment_corpus", "validate_corpus", "set_diff", "numbering_gaps", "sequence_breaks",
]
