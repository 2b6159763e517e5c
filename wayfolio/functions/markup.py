"""Blocks of a page with their tag, class and id, so that rules can choose by attribute before the markup goes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfolio.functions.text import col, strip_tags

#: Marks in front of a line of text made from blocks: a section's heading, and the end of a section's text.
HEADING, STOP = "\u0002", "\u0001"
BLOCK_TAGS = "p|h[1-6]|div|li|pre|blockquote|hr"


@dataclass(frozen=True)
class Rule:
    """Blocks whose tag, class, id and text match become ``kind``: 'text', 'heading', 'stop' or 'drop'."""

    kind: str
    tag: str = ".*"
    classes: str | None = None
    id: str | None = None
    text: str | None = None

    def holds(self, block: Column) -> Column:
        holds = block["tag"].rlike(f"(?i)^(?:{self.tag})$")
        if self.classes:
            holds = holds & block["class"].rlike(f"(?:^|\\s)(?:{self.classes})(?:\\s|$)")
        if self.id:
            holds = holds & block["id"].rlike(f"^(?:{self.id})$")
        if self.text:
            holds = holds & F.coalesce(block["text"], F.lit("")).rlike(self.text)
        return holds


def _attribute(opening: Column, name: str) -> Column:
    return F.regexp_extract(opening, f"(?i)\\s{name}\\s*=\\s*[\"']([^\"']*)[\"']", 1)


def blocks(c: Column | str, tags: str = BLOCK_TAGS) -> Column:
    """Array of (tag, class, id, text): each block element up to its close or the next block's opening, whichever is first.

    Text before the first block belongs to none. A block without text has null text.
    """
    pieces = F.filter(F.split(col(c), f"(?i)(?=<(?:{tags})[\\s>/])"), lambda p: p.rlike(f"(?i)\\A<(?:{tags})[\\s>/]"))

    def block(piece):
        opening = F.regexp_extract(piece, "\\A<[^>]*>", 0)
        body = F.regexp_replace(F.regexp_replace(piece, "\\A<[^>]*>", ""), f"(?is)</(?:{tags})\\s*>.*\\z", "")
        return F.struct(
            F.lower(F.regexp_extract(opening, "\\A<(\\w+)", 1)).alias("tag"), _attribute(opening, "class").alias("class"),
            _attribute(opening, "id").alias("id"), strip_tags(body).alias("text"),
        )

    return F.transform(pieces, block)


def chosen_text(c: Column | str, rules: tuple[Rule, ...], tags: str = BLOCK_TAGS) -> Column:
    """Lines of the blocks that a rule takes, the first rule that holds deciding; headings and stops carry their marks."""
    def line(block):
        out = F.lit(None).cast("string")
        for rule in reversed(rules):
            shown = {
                "text": block["text"], "drop": F.lit(None).cast("string"), "stop": F.lit(STOP), "heading": F.concat(F.lit(HEADING), F.coalesce(block["text"], F.lit(""))),
            }[rule.kind]
            out = F.when(rule.holds(block), shown).otherwise(out)
        return out

    return F.array_join(F.array_compact(F.transform(blocks(c, tags), line)), "\n\n")
