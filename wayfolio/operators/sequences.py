"""Order-dependent rules inside a text. They work on one text value at a time, so nothing is shuffled.

A text is a single cell of a table; splitting it with look-ahead patterns keeps the work in the
scan stage, where a window over exploded lines would move every line across the cluster.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfolio.functions.text import SPACE, WS, clean_line, clean_text, col, once, squeeze, text, trim_space


def lines_of(c: Column | str) -> Column:
    return F.split(col(c), "\\n")


def clean_lines(c: Column | str, clean=clean_text) -> Column:
    """Cleaned, non-blank lines as an array."""
    return F.array_compact(F.transform(lines_of(c), clean))


def joined_lines(c: Column | str, clean=clean_text) -> Column:
    """The text with every line cleaned and blank lines gone."""
    return F.array_join(clean_lines(c, clean), "\n")


def assign_sections(df: DataFrame, column: str, heading: str, keep_preface: bool = False) -> DataFrame:
    """One row per section: ``section_no`` from 1, ``heading`` line and ``body``.

    A section runs from a line matching ``heading`` to the next one. Lines before the first
    heading belong to no section; with ``keep_preface`` they form section 0.
    """
    heading = f"(?:{heading})"
    parts = F.split(col(column), f"(?m)^(?={heading}$)")
    split = df.select("*", F.posexplode(F.filter(parts, lambda p: p != "")).alias("_pos", "_part"))
    first_line = F.substring_index(F.col("_part"), "\n", 1)
    # Whether the text opens with a heading decides if pieces count from 1 or from 0.
    opens = text(column).rlike(f"\\A{heading}(?=\\n|\\z)")
    numbered = (
        split.withColumn("section_no", F.col("_pos") + F.when(opens, 1).otherwise(0))
        .withColumn("heading", F.when(F.col("section_no") > 0, first_line))
        .withColumn(
            "body",
            F.when(F.col("section_no") == 0, F.col("_part"))
            .when(F.contains(F.col("_part"), F.lit("\n")), F.substr("_part", F.length(first_line) + 2))
            .otherwise(F.lit("")),
        )
        .drop("_pos", "_part")
    )
    return numbered if keep_preface else numbered.filter(F.col("section_no") > 0)


def slice_by_marker(df: DataFrame, column: str, marker: str, clean=clean_line) -> DataFrame:
    """Text from each marker up to the next: ``marker`` and ``content``, numbered in order.

    What precedes the first marker, and slices without text, are dropped.
    """
    pieces = F.split(col(column), f"(?={marker})")
    rows = df.select("*", F.posexplode(pieces).alias("_pos", "_piece")).filter(F.col("_piece").rlike(f"\\A(?:{marker})"))
    cut = rows.withColumn("marker", F.regexp_extract("_piece", f"\\A(?:{marker})", 0)).withColumn(
        "content", clean(F.regexp_replace("_piece", f"\\A(?:{marker})", ""))
    )
    return cut.filter(F.col("content").isNotNull()).withColumn("slice_no", F.col("_pos")).drop("_pos", "_piece")


UNIT_END = "[.!?;:,][\"']?-?"


def group_units(c: Column | str, cap: int = 480) -> Column:
    """Units of whole lines: each ends with the first line that closes a phrase or passes ``cap`` characters.

    Expects cleaned lines joined by newlines; the pattern reads them left to right, as a scan would.
    """
    end = "(?=\\n|\\z)"
    shut = "(?<=[.!?;:,]|[.!?;:,][\"']|[.!?;:,]-|[.!?;:,][\"']-)"
    unit = f"(?s)\\n?(.{{1,{cap}}}?{shut}{end}|.{{{cap + 1},}}?{end}|.+)"
    units = F.regexp_extract_all(col(c), F.lit(unit), F.lit(1))
    return F.filter(F.transform(units, squeeze), lambda u: u != "")


def group_stanzas(c: Column | str, speaker: str, size: int = 4) -> Column:
    """Stanzas of up to ``size`` lines; a speaker line starts a new run and heads its first stanza only."""
    runs = F.split(col(c), f"(?m)^(?=(?:{speaker})$)")

    def stanzas(run):
        first = F.substring_index(run, "\n", 1)
        spoken = first.rlike(f"^(?:{speaker})$")
        lines = F.filter(F.split(run, "\\n"), lambda x: x != "")
        said = F.when(spoken, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
        groups = F.when(
            F.size(said) > 0, F.sequence(F.lit(0), F.floor((F.size(said) - 1) / size).cast("int"))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(
            groups,
            lambda g: F.concat(
                F.when(spoken & (g == 0), F.concat(first, F.lit(" "))).otherwise(F.lit("")),
                F.array_join(F.slice(said, g * size + 1, F.lit(size)), " "),
            ),
        )

    return F.flatten(F.transform(F.filter(runs, lambda r: r != ""), stanzas))


def drop_footnotes(c: Column | str, opening: str = "\\[Footnote\\s+\\d+:") -> Column:
    """Remove footnotes: blocks that open a line and close with a bracket at a line end, then inline ones."""
    blocks = F.regexp_replace(col(c), f"(?im)^{opening}[\\s\\S]*?(?:\\]$|\\z)\\n?", "")
    return F.regexp_replace(blocks, f"(?i){opening}[^\\n]*?\\]", "")


def clip_body(c: Column | str, start: str, end: str, keep_start: bool = False) -> Column:
    """Text between two literal markers; null when either is missing or out of order."""
    value = col(c)
    at = F.locate(start, value)
    body_at = at if keep_start else at + len(start)
    # The end marker is looked for behind the start marker only.
    rest = F.substr(value, F.when(at > 0, body_at).otherwise(F.lit(1)))
    stop = F.locate(end, rest)
    return F.when((at > 0) & (stop > 1), trim_space(F.substr(rest, F.lit(1), stop - 1)))


def clip_status(c: Column | str, start: str, end: str) -> Column:
    value = col(c)
    at = F.locate(start, value)
    rest = F.substr(value, F.when(at > 0, at + len(start)).otherwise(F.lit(1)))
    return (
        F.when(at == 0, F.lit("no_start"))
        .when(F.locate(end, rest) == 0, F.lit("no_end"))
        .otherwise(F.lit("ok"))
    )


def split_on_phrases(c: Column | str, phrases: list[str]) -> Column:
    """Passages that start at a blank line or at a line opening with one of the phrases."""
    opening = "|".join(re.escape(p) for p in phrases)
    pieces = F.split(col(c), f"(?m)\\n\\s*\\n|^(?={opening})")
    return F.array_compact(F.transform(pieces, clean_line))


NUMBERED_LINE = "(?:\\d+|[IVXLCDM]+)[.)] "


def split_passages(c: Column | str, short: int = 120, long: int = 140, least: int = 3) -> Column:
    """Passages by three rules on cleaned lines joined by newlines.

    A numbered line opens a passage and loses its number; a line longer than ``long`` opens one
    too; a line shorter than ``short`` that ends a sentence closes the passage it continues.
    One pattern reads a passage: any line, then lines that neither open nor close, then
    possibly one that closes.
    """
    numbered = f"(?:{NUMBERED_LINE})"
    closing = f"(?=[^\\n]{{1,{short - 1}}}(?:\\n|\\z))[^\\n]*[.:;!?](?=\\n|\\z)"
    middle = f"(?!{numbered})(?!{closing})[^\\n]{{1,{long}}}(?=\\n|\\z)"
    passage = f"(?:\\A|\\n)[^\\n]+(?:\\n{middle})*+(?:\\n(?!{numbered}){closing})?"
    found = F.regexp_extract_all(col(c), F.lit(passage), F.lit(0))
    bare = F.transform(found, lambda p: squeeze(F.regexp_replace(p, f"^\\n?{numbered}", "")))
    return F.filter(bare, lambda p: F.length(p) >= least)


def expected_headings(lines: Column, pattern: str, last: int, sure: str | None = None, free_from: int = 11) -> Column:
    """Which lines are headings 1, 2, ... when each must be the next number not yet seen.

    With ``sure`` a number below ``free_from`` only counts on a line that also matches it, so that numbered verses of a
    chapter are not taken for the next chapter. Returns structs (number, index), index counting lines from 0. Only candidate lines are folded,
    and the fold keeps at most ``last`` entries.
    """
    indexed = F.transform(
        lines,
        lambda line, i: F.struct(
            F.regexp_extract(line, pattern, 1).try_cast("int").alias("number"), i.alias("index"),
            (line.rlike(sure) if sure else F.lit(True)).alias("sure"),
        ),
    )
    heads = F.filter(indexed, lambda x: x["number"].between(1, last) & (x["sure"] | (x["number"] >= free_from)))
    candidates = F.transform(heads, lambda x: F.struct(x["number"].alias("number"), x["index"].alias("index")))
    empty = F.array().cast("array<struct<number:int,index:int>>")

    def step(taken, x):
        return F.when(x["number"] == F.size(taken) + 1, F.array_append(taken, x)).otherwise(taken)

    return F.aggregate(candidates, empty, step)


def aligned_headings(heads: Column, last: int) -> Column:
    """The longest run of headings whose plan numbers rise, out of ``heads``: structs (number, index, ...) in order of lines.

    A number that is misread, repeated or out of place leaves the run and stays text; numbers that no heading has are
    missing, and what follows them is still aligned. The fold keeps, for each length, the run with the smallest last
    number, so it holds at most ``last`` runs of at most ``last`` headings.
    """
    heads = F.filter(heads, lambda h: h["number"].between(1, last))
    none = F.filter(heads, lambda h: F.lit(False))
    runs = F.array(F.struct(F.lit(0).alias("last"), none.alias("run")))

    def step(kept, head):
        # runs are ordered by their last number; the head extends the longest run that ends below it, and takes the place
        # of the next one, which is as long as the new run and ends behind it
        below = F.filter(kept, lambda r: r["last"] < head["number"])
        longer = F.struct(head["number"].alias("last"), F.array_append(F.try_element_at(below, F.lit(-1))["run"], head).alias("run"))
        beyond = F.filter(kept, lambda r: r["last"] >= head["number"])
        same = F.exists(kept, lambda r: r["last"] == head["number"])
        return F.when(same, kept).otherwise(F.concat(below, F.array(longer), F.slice(beyond, F.lit(2), F.lit(last))))

    return F.aggregate(heads, runs, step, lambda kept: F.element_at(kept, -1)["run"])


def explode_numbers(df: DataFrame, column: str, numbers: str = "number_list") -> DataFrame:
    """Rows like ``1, 2. text``: one row per listed number, with the shared content."""
    pattern = "^(\\d+(?:,\\s*\\d+)*)\\.\\s+(.+)$"
    parsed = df.withColumn(numbers, F.regexp_extract(column, pattern, 1)).withColumn(
        "verse", clean_line(F.regexp_extract(column, pattern, 2))
    )
    listed = F.filter(
        F.transform(F.split(numbers, ","), lambda n: F.trim(n).try_cast("int")),
        lambda n: n.isNotNull() & (n > 0),
    )
    return parsed.filter(F.col(numbers) != "").select("*", F.explode(listed).alias("number"))


def _clean_part(c: Column) -> Column:
    t = F.regexp_replace(squeeze(c), "(?i)^\\(\\s*[ivxlcdm]+\\s*\\)\\s*", "")
    return trim_space(F.regexp_replace(t, "^\\[[^\\]]+\\]\\s*", ""))


def split_numbered(c: Column | str, least: int = 8) -> Column:
    """Parts of a passage with markers like ``(12)``; a single marker does not split it."""
    marker = "\\(\\s*\\d+\\s*\\)"

    def bare(parts):
        return F.filter(F.transform(parts, lambda p: _clean_part(F.regexp_replace(p, f"^{marker}", ""))), lambda p: F.length(p) >= least)

    def parted(flat):
        whole = F.array(_clean_part(F.regexp_replace(flat, "(?i)\\(\\s*[ivxlcdm\\d]+\\s*\\)", "")))
        pieces = F.split(flat, f"(?={marker})")
        return once(pieces, lambda parts: F.when(
            F.size(F.filter(parts, lambda p: p.rlike(f"^{marker}"))) > 1, bare(parts)).otherwise(F.filter(whole, lambda p: p != "")))

    return once(squeeze(c), parted)


def paragraphs(c: Column | str, mode: str = "html") -> Column:
    """Paragraph blocks as an array of fragments: ``<p>`` elements, or blocks between blank lines."""
    if mode == "html":
        return F.regexp_extract_all(col(c), F.lit("(?is)<p(?:\\s+[^>]*)?>(.*?)</p>"), F.lit(1))
    return F.split(col(c), "\\n\\s*\\n")


def index_links(pages: DataFrame, column: str, link: str, key: str = "page_id", last: int | None = None) -> DataFrame:
    """Numbered links of an index page: ``link`` captures the target and its number; the last one wins."""
    targets = F.regexp_extract_all(col(column), F.lit(link), F.lit(1))
    numbers = F.regexp_extract_all(col(column), F.lit(link), F.lit(2))
    rows = pages.select(key, F.posexplode(F.arrays_zip(targets.alias("target"), numbers.alias("number"))).alias("_pos", "_link"))
    found = rows.select(
        key, "_pos", F.col("_link.target").alias("target"), F.col("_link.number").try_cast("int").alias("number")
    ).filter(F.col("number") >= 1)
    if last is not None:
        found = found.filter(F.col("number") <= last)
    return found.groupBy(key, "number").agg(F.max_by("target", "_pos").alias("target"))
