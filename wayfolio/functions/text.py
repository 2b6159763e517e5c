"""Column functions on free text. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfolio.lookups import NAMED_ENTITIES, ORDINAL_LIMIT, ORDINALS, SEARCH_STOP_WORDS

# Fixed value: the characters that count as white space (NBSP and BOM included).
SPACE = (
    "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
)
WS = f"[{SPACE}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text(c: Column | str) -> Column:
    """The value, with null read as the empty string."""
    return F.coalesce(col(c), F.lit(""))


def trim_space(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{WS}+|{WS}+$", "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space; none at either end."""
    return F.trim(F.regexp_replace(col(c), f"{WS}+", " "))


def has_text(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(f"[^{SPACE}]"), F.lit(False))


def or_null(c: Column | str) -> Column:
    """Blank becomes null; other values are kept as they are."""
    return F.when(has_text(c), col(c))


def filled(c: Column | str) -> Column:
    """The empty string becomes null, as a falsy value does."""
    return F.nullif(col(c), F.lit(""))


def clean_line(c: Column | str) -> Column:
    """Squeezed text, or null when nothing is left."""
    return filled(squeeze(c))


def clean_text(c: Column | str) -> Column:
    """Drop the byte-order mark, straighten quotes and dashes, squeeze space, blank to null."""
    plain = F.translate(col(c), "“”‘’–—", "\"\"''--")
    return clean_line(plain)


def _folded(c: Column | str) -> Column:
    spaced = F.regexp_replace(trim_space(text(c)), "[_-]+", " ")
    return F.regexp_replace(spaced, f"{WS}+", " ")


def clean_key(c: Column | str) -> Column:
    """Match key: trimmed, underscores and hyphens as spaces, collapsed, lower case."""
    return F.lower(_folded(c))


def normalize_name(c: Column | str) -> Column:
    """Name key that keeps underscores and hyphens."""
    return F.lower(squeeze(text(c)))


def capitalize_words(c: Column | str) -> Column:
    """Upper-case the first letter of each word and keep the rest as written."""
    words = F.transform(
        F.split(col(c), " "),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))),
    )
    return F.array_join(words, " ")


def display_label(c: Column | str, blank: str = "Sacred place") -> Column:
    folded = _folded(c)
    return F.when(folded == "", F.lit(blank)).otherwise(capitalize_words(folded))


def truncate(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def compact_line(*parts: Column | str, sep: str = " - ") -> Column:
    """Join the non-blank parts, each as written."""
    return F.concat_ws(sep, *[or_null(col(p).cast("string")) for p in parts])


def search_term(c: Column | str) -> Column:
    """First word of a question worth searching for, or the empty string."""
    stop = f"(?!(?:{'|'.join(SEARCH_STOP_WORDS)})(?![a-z0-9]))"
    return F.regexp_extract(F.lower(text(c)), f"(?<![a-z0-9]){stop}[a-z0-9]{{4,}}", 0)


def contains_text(c: Column | str, term: str, wildcards: bool = False) -> Column:
    """Case-insensitive substring test; with ``wildcards`` % and _ keep their LIKE meaning."""
    if wildcards:
        return col(c).ilike(f"%{term}%")
    return F.contains(F.lower(col(c)), F.lit(term.lower()))


# --- numerals -------------------------------------------------------------------------


def roman_to_int(c: Column | str) -> Column:
    """Value of a Roman numeral by the subtractive rule; null for anything else."""
    upper = F.upper(col(c))
    value = F.create_map(
        *[F.lit(x) for pair in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000)) for x in pair]
    )
    digits = F.reverse(F.regexp_extract_all(upper, F.lit("[IVXLCDM]"), F.lit(0)))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("previous"))

    def step(acc, digit):
        v = F.element_at(value, digit)
        smaller = v < acc["previous"]
        return F.struct(
            F.when(smaller, acc["total"] - v).otherwise(acc["total"] + v).alias("total"),
            F.when(smaller, acc["previous"]).otherwise(v).alias("previous"),
        )

    return F.when(upper.rlike("^[IVXLCDM]+$"), F.aggregate(digits, start, step, lambda a: a["total"]))


def ordinal_word(c: Column | str, fallback: str = "Lecture ") -> Column:
    """English ordinal for 1 to 36, otherwise the fallback word and the number."""
    n = col(c)
    words = F.array(*[F.lit(w) for w in ORDINALS])
    ones = F.get(words, (n % 10 - 1).cast("int"))
    tens = F.when(n > 30, F.lit("Thirty-")).otherwise(F.lit("Twenty-"))
    return (
        F.when(n.between(1, 20), F.get(words, (n - 1).cast("int")))
        .when(n == 30, F.lit("Thirtieth"))
        .when(n.between(21, ORDINAL_LIMIT), F.concat(tens, ones))
        .otherwise(F.concat(F.lit(fallback), n.cast("string")))
    )


def page_key(base: Column | str, n: Column | str) -> Column:
    """Two-digit page suffix; from 100 on the tens are letters (100 is a0, 110 is b0)."""
    number = col(n).cast("int")
    letters = F.array(*[F.lit(chr(ord("a") + i)) for i in range(26)])
    letter = F.get(letters, F.floor((number - 100) / 10).cast("int"))
    short = F.lpad(number.cast("string"), 2, "0")
    return F.concat(
        col(base),
        F.when(number < 100, short).otherwise(F.concat(letter, (number % 10).cast("string"))),
    )


# --- markup ---------------------------------------------------------------------------


def decode_entities(c: Column | str) -> Column:
    """Numeric and the common named entities; a code above 16 bits keeps its low 16 bits."""

    def numeric(value: Column, digits: str, prefix: str, base: int) -> Column:
        # A look-ahead split leaves every reference at the head of a piece.
        pieces = F.split(value, f"(?=&#{prefix}{digits};)")

        def decode(piece):
            number = F.regexp_extract(piece, f"^&#{prefix}({digits});", 1)
            code = F.pmod(F.conv(number, base, 10).cast("decimal(20,0)"), F.lit(65536)).cast("int")
            unit = F.when(code.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(code)
            char = F.decode(F.unhex(F.lpad(F.hex(unit.cast("long")), 4, "0")), "UTF-16BE")
            rest = F.regexp_replace(piece, f"^&#{prefix}{digits};", "")
            return F.when(number == "", piece).otherwise(F.concat(char, rest))

        decoded = F.array_join(F.transform(pieces, decode), "")
        return F.when(F.contains(value, F.lit("&#")), decoded).otherwise(value)

    out = numeric(col(c), "[0-9]{1,15}", "", 10)
    out = numeric(out, "[0-9a-fA-F]{1,12}", "[xX]", 16)
    # The ampersand goes last, so that what it uncovers is not decoded again.
    for name, char in sorted(NAMED_ENTITIES.items(), key=lambda kv: kv[0] == "amp"):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def html_to_text(c: Column | str) -> Column:
    """Visible text of a page: breaks and block ends become newlines, tags go, space is squeezed."""
    t = F.regexp_replace(col(c), "(?is)<script.*?</script>", "")
    t = F.regexp_replace(t, "(?is)<style.*?</style>", "")
    t = F.regexp_replace(t, "(?i)<br\\s*/?>", "\n")
    t = F.regexp_replace(t, "(?i)</(p|div|h1|h2|h3|h4|pre|li)>", "\n\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    t = F.translate(decode_entities(t), " \r", " ")
    t = F.regexp_replace(t, "[ \\t]+", " ")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    return trim_space(t)


def strip_tags(c: Column | str) -> Column:
    """One line of text from a fragment of markup."""
    return clean_line(decode_entities(F.regexp_replace(col(c), "<[^>]+>", " ")))


def strip_wikitext(c: Column | str) -> Column:
    """Plain text of a wiki page: templates, references, comments, link and quote marks go."""
    t = F.replace(col(c), F.lit("\r"), F.lit(""))
    t = F.regexp_replace(t, "(?is)^(.*?)\\{\\{header.*?\\}\\}\\s*", "$1")
    t = F.regexp_replace(t, "(?s)\\{\\{lang\\|zh\\|.*?\\}\\}\\s*", "")
    t = F.regexp_replace(t, "(?is)<ref.*?</ref>", "")
    t = F.regexp_replace(t, "(?i)<ref[^/]*/>", "")
    t = F.regexp_replace(t, "(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, "\\{\\{[^{}]*\\}\\}", "")
    t = F.regexp_replace(t, "\\[\\[([^|\\]]+)\\|([^\\]]+)\\]\\]", "$2")
    t = F.regexp_replace(t, "\\[\\[([^\\]]+)\\]\\]", "$1")
    t = F.regexp_replace(t, "'{2,}", "")
    return trim_space(F.replace(t, F.lit("__NOTOC__"), F.lit("")))


# Character ranges by script.
SCRIPTS = {"Han": "[\\u3400-\\u9FFF\\uF900-\\uFAFF]"}


def has_script(c: Column | str, script: str = "Han") -> Column:
    return F.coalesce(col(c).rlike(SCRIPTS[script]), F.lit(False))
