"""Profiles: how each kind of document is cut into sections and passages, and what a complete one holds."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from wayfolio.functions.markup import HEADING, STOP, Rule
from wayfolio.functions.text import SCRIPTS


@dataclass(frozen=True)
class Layout:
    """One of the forms in which a source comes: recognised by how often ``marks`` occurs in its text."""

    marks: str
    opens: str | None = None  # the text begins behind its first match, if there is one
    closes: str | None = None  # and ends before the first match behind that
    split: str | None = None  # where lines begin, if they aren't lines yet
    bare: str | None = None  # what goes from the front of a line
    noise: tuple[str, ...] = ()


@dataclass(frozen=True)
class Profile:
    """How one kind of document is cut, and what a complete one holds."""

    name: str
    method: str
    source: str = "text"
    heading: str | None = None
    number: str | None = None  # 'roman' or 'arabic': how the heading's first group is read
    cuts: tuple[str, ...] = ()  # what goes from the source as it comes
    opens: str | None = None  # the text lies behind the first match; without one there is no text
    closes: str | None = None  # and before the first match behind that
    tidy: tuple[tuple[str, str], ...] = ()  # replacements in the plain text
    flat: bool = False  # lines mean nothing: headings stand inside running text
    rules: tuple[Rule, ...] = ()  # for the source 'blocks': which blocks of the page count, and as what
    marker: str | None = None
    sure: str | None = None  # what a line must match to be a heading whose number alone does not tell
    speaker: str | None = None
    phrases: tuple[str, ...] = ()
    noise: tuple[str, ...] = ()
    stops: tuple[str, ...] = ()  # lines at which the whole text ends
    section_stop: tuple[str, ...] = ()  # a line at which a section's text ends; the first pattern that occurs decides
    commentary: str | None = None  # a line at which a passage ends, unless it is its first
    split_heading: str | None = None  # a heading that has text behind it on its line
    opening: int | None = None  # text before the first heading is a section, of paragraphs longer than this
    books: tuple[tuple[str, str], ...] = ()  # headings of the books inside a work, and their names
    first_book: str | None = None  # the book a work begins with
    chapters: tuple[tuple[str, int], ...] = ()  # books of a complete work, and how many chapters each has
    plan: tuple[str, ...] = ()  # titles of all sections in their order; headings found are aligned with it
    cues: tuple[tuple[str, int], ...] = ()  # lines that stand for a heading of the plan but belong to the text
    layouts: tuple[Layout, ...] = ()
    windows: tuple[tuple[str, str, str], ...] = ()  # title, first paragraph, paragraph behind the last
    labels: tuple[str, ...] = ()  # what goes from the front of a paragraph
    least: int = 1  # characters of a passage
    pages: tuple[int, int] | None = None  # documents of a complete work, where each is one page or book of it
    footnote: str | None = None
    label: str = "Passage"
    titles: tuple[str, ...] = ()  # headings that a complete text has
    per_section: tuple[int, ...] = ()  # passages of each section of a complete text
    sections: tuple[int, int] = (1, 10 ** 9)
    passages: tuple[int, int] = (1, 10 ** 9)
    forbidden: str | None = None


GUTENBERG = "(?i)Project Gutenberg|START OF TH(?:E|IS) PROJECT|END OF TH(?:E|IS) PROJECT|License"
SITE = "(?i)Mechon Mamre|Javascript|This site requires|Copyright 2002|Hebrew Bible in English|chapters\\(|footer\\("
TAIL = ("(?i)^\\*\\*\\*\\s*END OF", "(?i)^End of (?:the )?Project Gutenberg", "(?i)^PROJECT GUTENBERG")
HAN = SCRIPTS["Han"]
STOPPED = (f"^{STOP}$",)

# Titles that the sections of the selection have.
ZEND_AVESTA_TITLES = (
    "Contracts and Outrages", "Uncleanness", "Funerals and Purification", "Cleansing the Unclean", "Spells Recited During the Cleansing",
    "To Fires, Waters, Plants", "To the Earth and the Sacred Waters", "Prayer for Helpers", "A Prayer for Sanctity and its Benefits", "To the Fire",
    "To the Bountiful Immortals", "Praise of the Holy Bull", "To Rain as a Healing Power", "To the Waters and Light of the Sun",
    "To the Waters and Light of the Moon", "To the Waters and Light of the Stars",
)
# Titles of the books, which their pages repeat as a paragraph.
MENCIUS_TITLES = (
    "Liang Hui Wang I", "Liang Hui Wang II", "Gong Sun Chou I", "Gong Sun Chou II", "Teng Wen Gong I", "Teng Wen Gong II", "Li Lou I", "Li Lou II",
    "Wan Zhang I", "Wan Zhang II", "Gaozi I", "Gaozi II", "Jin Xin I", "Jin Xin II",
)
# The books of a complete work, with their chapters.
MORMON_CHAPTERS = (
    ("1 Nephi", 22), ("2 Nephi", 33), ("Jacob", 7), ("Enos", 1), ("Jarom", 1), ("Omni", 1), ("Words of Mormon", 1), ("Mosiah", 29), ("Alma", 63),
    ("Helaman", 16), ("3 Nephi", 30), ("4 Nephi", 1), ("Mormon", 9), ("Ether", 15), ("Moroni", 10),
)
# Headings of the books behind the first.
MORMON_BOOKS = (
    ("THE SECOND BOOK OF NEPHI", "2 Nephi"), ("THE BOOK OF JACOB", "Jacob"), ("THE BOOK OF ENOS", "Enos"), ("THE BOOK OF JAROM", "Jarom"),
    ("THE BOOK OF OMNI", "Omni"), ("THE WORDS OF MORMON", "Words of Mormon"), ("THE BOOK OF MOSIAH", "Mosiah"), ("THE BOOK OF ALMA", "Alma"),
    ("THE BOOK OF HELAMAN", "Helaman"), ("THIRD BOOK OF NEPHI", "3 Nephi"), ("FOURTH NEPHI", "4 Nephi"), ("THE BOOK OF MORMON", "Mormon"),
    ("THE BOOK OF ETHER", "Ether"), ("THE BOOK OF MORONI", "Moroni"),
)
# Selected sections by title, with the paragraphs at which each begins and ends.
DEAD_SECTIONS = (
    ("Hymn to Osiris", "(?i)HYMN TO OSIRIS", "(?i)Vignette|Appendix|PLATE|CHAPTER"),
    ("Hymn to Ra", "(?i)A HYMN OF PRAISE To RA", "(?i)Vignette|Text\\s*\\[CHAPTER CXXXIII\\]|Appendix|PLATE"),
    (
        "Entering the Hall of Double Right and Truth", "(?i)THE CHAPTER OF ENTERING INTO THE HALL OF DOUBLE RIGHT AND TRUTH",
        "(?i)Appendix|Vignette|PLATE",
    ),
    ("The Negative Confession", "(?i)THE NEGATIVE CONFESSION", "(?i)Appendix|PLATE XXXII\\. \\(continued\\)|CHAPTER XLII"),
    ("Offerings to the Seven Cows and the Four Rudders", "(?i)CHAPTER CXLVIII", "(?i)Appendix|Vignette|PLATE"),
)
# Lines of the site around a lecture.
LECTURE_NOISE = (
    "(?i)^(Home|About|Contact|Newsletter|Shop|Links|TOOLS)$", "(?i)^(Resources|Comments|Last Updated|Like what you read|Let's grow together)",
    "(?i)^(Buy now|Source \\d|Summary:|Alternative titles include)", "(?i)^(Next:|Previous:|Index|Contents|Start Reading|Sacred Texts|Jainism)$",
    "(?i)^(Become a Patreon|Buy me a Coffee|Liberapay|Why\\?|Read more)", "(?i)copyright|privacy policy|support me on patreon",
)


def _any(titles) -> str:
    return "(?:" + "|".join(re.escape(t) for t in titles) + ")"


# Per source text the patterns that mark its parts, and the counts of a complete parse.
PROFILES = {
    p.name: p
    for p in (
        Profile("bible", "json", source="json", label="Verse", pages=(66, 66)),
        Profile(
            "quran", "units", label="Ayah", number="roman",
            heading="(?i)SURA\\d*\\s*[^A-Z0-9\\n]*\\s*[IVXLCDM]+\\.?\\d*\\s*(?:[.-]\\s*)?[^\\n]*?\\s*\\[([IVXLCDM]+)\\.\\]",
            noise=(
                "(?i)^(MECCA|MEDINA)\\.-\\d+\\s+Verses?", "(?i)^\\d+\\s+The word Sura occurs",
                "(?i)^For the understanding", "(?i)^In the Name of God",
            ), stops=(*TAIL, "(?i)^INDEX\\.$"), section_stop=("^_{5,}$",),
            sections=(114, 114), passages=(2500, 9000), forbidden=GUTENBERG,
        ),
        Profile(
            "bhagavad-gita", "stanzas", source="html", number="roman", heading="(?i)CHAPTER\\s+([IVXLCDM]+)",
            speaker="(?:Dhritirashtra|Sanjaya|Krishna|Arjuna)\\.?:?",
            noise=("^\\.\\s*\\.\\s*\\.", "(?i)^Entitled\\s+", "(?i)^Or\\s+", "(?i)^THE BHAGAVAD-GITA\\.?$"),
            stops=(*TAIL, "(?i)^HERE ENDS, WITH CHAPTER XVIII"), section_stop=("(?i)^HERE ENDETH CHAPTER",),
            footnote="\\[FN#\\d+", sections=(18, 18), passages=(400, 900), forbidden=GUTENBERG, label="Verse",
        ),
        Profile(
            "dhammapada", "numbered", source="html", number="roman",
            heading="(?i)Chapter\\s+([IVXLCDM]+)\\.\\s+[^\\n]+", stops=TAIL,
            sections=(26, 26), passages=(423, 423), forbidden=GUTENBERG, label="Verse",
        ),
        Profile(
            "book-of-mormon", "nested", opens="(?m)^(?=1 Nephi Chapter 1$)", closes="\\*\\*\\* END OF THE PROJECT GUTENBERG EBOOK THE BOOK OF MORMON \\*\\*\\*",
            heading="(.+?)\\s+Chapter\\s+(\\d+)", marker="(\\d+):(\\d+)\\s+", books=MORMON_BOOKS, first_book="1 Nephi", chapters=MORMON_CHAPTERS,
            sections=(239, 239), passages=(6604, 6604), label="Verse",
            forbidden=(
                "(?i)Project Gutenberg|START OF THE PROJECT|END OF THE PROJECT|Contents|Transcriber's Notes|License|Updated editions|Gutenberg eBook"
            ),
        ),
        Profile(
            "tao-te-ching", "expected", source="html", marker="^(?:Ch\\.\\s*)?(\\d{1,2})\\.",
            sure="^(?:Ch\\.|\\d{1,2}\\.\\s*(?:$|1\\.))", stops=TAIL,
            sections=(81, 81), passages=(81, 10 ** 9), forbidden=GUTENBERG, label="Line",
        ),
        Profile(
            "upanishads", "markers", heading="(?i)(?:Isa|Katha|Kena)-Upanishad", marker="(?m)^[IVXLCDM]+$",
            noise=("(?i)^Peace Chant$",), section_stop=("(?i)^Here ends this Upanishad\\.?$",), stops=TAIL,
            commentary=(
                "(?:This|Here|By|Thus|In this|The idea|The wise|Self-realization|Knowledge of|These two|The next|To the|There are"
                "|This Mantram|This Upanishad)\\b"
            ),
            sections=(3, 3), passages=(80, 200), label="Verse",
            forbidden="(?i)Project Gutenberg|License|START OF THIS PROJECT|END OF THIS PROJECT",
        ),
        Profile(
            "zend-avesta", "phrases", opens="SELECTIONS FROM THE ZEND-AVESTA", closes="THE DHAMMAPADA",
            heading=f"(?i){_any(ZEND_AVESTA_TITLES)}(?:\\[\\d+\\])?\\.?(?:\\[\\d+\\])?", titles=ZEND_AVESTA_TITLES, footnote="\\[Footnote\\s+\\d+:",
            phrases=(
                "O Maker", "Ahura Mazda answered", "Zarathustra asked", "And now", "I pray", "I offer",
                "I would worship", "Hail,", "Up!", "As the sea", "Come, come on",
            ),
            sections=(15, 25), passages=(60, 220),
            forbidden=(
                "(?i)Project Gutenberg|Full Project Gutenberg|Dhammapada|Upanishad|Koran|Life of Buddha|Vedic Hymns|START OF THE PROJECT|END OF THE PROJECT"
            ),
        ),
        Profile(
            "japji-sahib", "planned", source="either", heading="(?i)(?:###\\s+)?([IVXLCDM]+)\\.?", number="roman",
            opens="(?i)THE JAPJI[^\\n]*", closes="(?im)^[^\\n]*Asa Ki War", footnote="\\[\\d+\\.",
            tidy=(
                ("\\[[0-9]+\\]", ""), ("(?i)\\{p\\.\\s*\\d+\\}", ""), ("(?i)\\{footnote\\s+p\\.\\s*\\d+\\}", ""),
                ("\\[([^\\]\\n]+)\\]\\([^)\\n]+\\)", "$1"), ("_", ""),
            ),
            noise=(
                "(?i)^Title:|^URL Source:|^Published Time:|^Markdown Content:", "(?i)^Sacred Texts\\s*Sikhism\\s*Index\\s*Previous\\s*Next$",
                "^\\* \\* \\*$", "(?i)^Next:|^Previous:|^Index$|^Sikhism$|^Sacred Texts$", "^\\d+\\.", "(?i)^Also translated", "(?i)^\\([a-z]\\)",
                "^##?\\s+",
            ),
            plan=("Opening", *(f"Pauri {n}" for n in range(1, 39)), "Final Salok"), cues=(("(?i)^SLOK$", 40), ("(?i)^That God is ever true", 28)),
            sections=(40, 40), passages=(40, 60), label="Pauri",
            forbidden="(?i)Sacred Texts Archive|Internet Sacred Text|Next:|Previous:|Asa Ki War|Rahiras|Sohila|footnote|URL Source|Published Time",
        ),
        Profile(
            "analects", "markers", number="roman", flat=True, tidy=(("\\[[0-9]+\\]", ""),),
            opens="(?=CONFUCIAN\\s+ANALECTS\\.\\s+BOOK\\s+I\\.)", closes="\\*\\*\\* END OF THE PROJECT GUTENBERG EBOOK THE ANALECTS OF CONFUCIUS",
            heading="(?i)BOOK\\s+([IVXLCDM]+)\\.\\s*[^.\\n]+\\.", marker="(?i)\\bCHAP\\.\\s*[IVXLCDM]+\\.?\\s*",
            sections=(20, 20), passages=(450, 550), label="Chapter",
            forbidden="(?i)Project Gutenberg|Full Project Gutenberg|START OF THIS PROJECT|END OF THE PROJECT",
        ),
        Profile(
            "diamond-sutra", "paragraphs", source="blocks", heading=f"{HEADING}\\[[^\\]\\n]+\\]",
            opens="(?i)<h2>\\s*THE DIAMOND SUTRA\\s*</h2>", closes="(?i)\\*\\*\\* END OF THE PROJECT GUTENBERG EBOOK",
            cuts=(
                "(?is)<noscript.*?</noscript>", "(?is)<sup.*?</sup>", "(?is)<a[^>]+class=[\"']fnanchor[\"'].*?</a>", "(?i)<img[^>]*>",
            ),
            rules=(
                Rule("heading", "p", "chapter", "Ch_\\d+(?:_\\d+)?", "(?i)^\\[Chapters?\\s+[^\\]]+\\]$"), Rule("stop", "div", "footnote"),
                Rule("drop", "p", text="(?i)^\\[Chapter"), Rule("text", "p"),
            ),
            section_stop=STOPPED, least=2, sections=(31, 31), passages=(35, 120),
            forbidden=(
                "(?i)Project Gutenberg|START OF THE PROJECT|END OF THE PROJECT|Preface|Introduction|Transcriber|License|Full Project Gutenberg"
                "|Footnote|Chinese Annotation|Handbook of Chinese Buddhism|Kin-Kong-King"
            ),
        ),
        Profile(
            "yoga-sutras", "leading_number", source="blocks", heading=f"{HEADING}(?i)BOOK\\s+([IVXLCDM]+)", number="roman",
            opens="(?i)\\*\\*\\*\\s*START OF THE PROJECT GUTENBERG EBOOK", closes="(?i)\\*\\*\\*\\s*END OF THE PROJECT GUTENBERG EBOOK",
            rules=(
                Rule("heading", "h2", text="(?i)^BOOK [IVXLCDM]+$"), Rule("stop", "h2", text="(?i)^(?:INTRODUCTION TO BOOK|BOOK )"),
                Rule("text", "p", "p1"),
            ),
            section_stop=STOPPED, sections=(4, 4), per_section=(51, 55, 55, 34), passages=(195, 195), label="Sutra",
            forbidden="(?i)Project Gutenberg|START OF THE PROJECT|END OF THE PROJECT|INTRODUCTION TO BOOK|Contents|license|commentary",
        ),
        Profile(
            "torah", "anchors", source="raw", marker="(?i)<A\\s+NAME=[\"'](\\d+)[\"'][^>]*>\\s*</A>",
            pages=(187, 187), passages=(5700, 6000), forbidden=SITE, label="Verse",
        ),
        Profile(
            "prophets-writings", "anchors", source="raw", marker="(?i)<A\\s+NAME=[\"'](\\d+)[\"'][^>]*>\\s*</A>",
            pages=(742, 742), passages=(17000, 18000), forbidden=SITE, label="Verse",
        ),
        Profile(
            "lotus-sutra", "html_paragraphs", source="raw", noise=("(?i)^Sacred Texts|^Buddhism$|^Index$|^Next:?|^Previous:?",),
            pages=(27, 27), passages=(1200, 2200),
            forbidden=(
                "(?i)Sacred Texts|Internet Sacred Text Archive|Google tag|Cloudflare|cf_chl|challenge-platform|Page navigation|Previous:|Next:"
                "|Full Project Gutenberg|license|copyright"
            ),
        ),
        Profile(
            "zhuangzi", "html_paragraphs", source="raw",
            noise=("(?i)^p\\.\\s*\\d+$", "(?i)^THE$|^WRITINGS OF KWANG-DZE\\.?$", "(?i)^PART\\s+", "(?i)^Book\\s+"),
            pages=(7, 7), passages=(40, 280),
            forbidden=(
                "(?i)Sacred Texts|Internet Sacred Text Archive|Google tag|Cloudflare|cf_chl|challenge-platform|Page navigation|Previous:|Next:"
                "|Tao-te Ching|Tao Te Ching|Tai Shang|Th&acirc;i-Shang|Appendix|Index to Volumes|copyright|license"
            ),
        ),
        Profile(
            "pure-land-sutras", "paragraphs", source="html", heading="§\\s*\\d+\\.", split_heading="§\\s*\\d+\\.", opening=12,
            noise=(
                "(?i)^Sacred Texts$", "(?i)^Buddhism$", "(?i)^Index$", "(?i)^Previous$", "(?i)^Next$", "(?i)^THE (LARGER|SMALLER)$",
                "(?i)^SUKHAVATI-VYUHA\\.?$", "(?i)^DESCRIPTION OF SUKHAVATI", "(?i)^THE LAND OF BLISS\\.?$", "(?i)^MEDITATION$",
                "(?i)^BUDDHA AMITAYUS", "^\\[\\d+[\\s.]", "^[*.]\\s",
            ), sections=(18, 55), passages=(30, 500),
            forbidden=(
                "(?i)Sacred Texts|Internet Sacred Text Archive|Google tag|Cloudflare|cf_chl|challenge-platform|Page navigation|Previous:|Next:"
                "|Index of|Indices|Copyright|Project Gutenberg|license"
            ),
        ),
        Profile(
            "book-of-the-dead", "windows", source="raw", windows=DEAD_SECTIONS, cuts=("(?is)\\A.*?(?=<body)",),
            closes="(?i)<nav\\s+role=[\"']navigation[\"']|<HR>\\s*<CENTER><A HREF=",
            tidy=(("(?i)\\{(?:footnote\\s*)?p\\.\\s*\\d+\\}", ""), ("\\[[0-9]+\\]", ""), ("#{2,}", "")),
            labels=(
                "(?i)^Text\\s*:\\s*", "(?i)^Text\\s*\\[[^\\]]+\\]\\s*[:.]?\\s*", "^\\[[^\\]]+\\]\\s*:?\\s*", "(?i)^THE CHAPTER OF[^:]+:\\s*",
            ),
            noise=(
                "^\\[\\d+[\\s.]", "^[*.]\\s", "^\\d+[.\\s]", "^[a-z]+(?:\\s+[a-z]+){1,4}\\s*,\\s*\"", "(?i)^Sacred Texts$", "(?i)^Egypt$",
                "(?i)^Index$", "(?i)^Previous$", "(?i)^Next$", "(?i)^Vignette", "(?i)^Vignettes", "(?i)^Rubric", "(?i)^Appendix", "(?i)^PLATE",
            ),
            least=8, pages=(5, 5), passages=(30, 180),
            forbidden=(
                "(?i)Sacred Texts|Internet Sacred Text Archive|Google tag|Cloudflare|cf_chl|challenge-platform|Page navigation|Previous:|Next:"
                "|Title Page|Preface|Contents|Introduction|Dover reprint|Online Books Page|Appendix|Vignette|Naville|Todtenbuch|Brugsch|Lanzone"
                "|Pierret|License|Project Gutenberg"
            ),
        ),
        Profile(
            "kojiki", "lines", source="html", heading="[ \\t]*\\[\\s*Sect\\.\\s+[IVXLCDM]+\\.?\\s*[.\\-—–][^\\n]*",
            cuts=(
                "(?s)\\A.*?(?=<div class=\"prp-pages-output\")", "(?is)<div[^>]+class=[\"'][^\"']*\\breflist\\b.*\\z", "(?s)<div class=\"printfooter\".*\\z",
            ),
            tidy=(("\\[[ \\t]*\\d+[ \\t]*\\]", ""), ("\\^[ \\t]*", ""), ("(?i)Retrieved from [^\\n]*", "")),
            section_stop=("^\\s*\\* \\* \\*\\s*$", "(?i)^[^\\n]*(?:Retrieved from|This page was last edited|Text is available under)"),
            noise=(
                "(?i)^RECORDS OF ANCIENT MATTERS\\.?$", "(?i)^Kojiki \\(1882\\)$", "(?i)^by\\s+", "^←|^→",
                "(?i)^Section \\d+$", "(?i)^Preface$|^Translator",
            ),
            least=2, pages=(19, 19), passages=(20, 180),
            forbidden=(
                "(?i)Translator.?s Introduction|Preface|Appendix|Wikisource|Retrieved from|This page was last edited|Creative Commons|Privacy Policy"
                "|Search|Main menu|Navigation|Add languages|Download EPUB"
            ),
        ),
        Profile(
            "uttaradhyayana", "passages", source="html", layouts=(
                Layout("\\(\\d+\\)\\s", opens="(?i)Next >", closes="Footnotes and references:|Article published on|Last Updated:|Comments:",
                       split="(?=\\(\\d+\\)\\s)", bare="^\\(\\d+\\)\\s*"),
                Layout("(?m)^(?:\\d+|[IVXLCDM]+)[.)]\\s", opens="(?i)[^\\n]*Lecture[^\\n]*", closes="(?im)^(?:Next:|Previous:|Sacred Texts|Index|Footnotes)",
                       noise=LECTURE_NOISE),
            ),
            pages=(36, 36), passages=(300, 1200),
            forbidden=(
                "(?i)Sutrakritanga|Sutra-kritanga|Sacred Texts Archive|Project Gutenberg|Comments:|Last Updated|Privacy Policy|Become a Patreon"
                "|Buy me a Coffee|Index of Names|Index of Sanskrit"
            ),
        ),
        Profile(
            "mencius", "blocks", source="wiki", noise=(f"^{_any(MENCIUS_TITLES)}$", "(?i)^category:"),
            pages=(14, 14), passages=(500, 800),
            forbidden=(
                "(?i)Wikisource|Creative Commons|Privacy policy|Disclaimers|Navigation|Retrieved from|Sacred Texts|Project Gutenberg|" + HAN
            ),
        ),
        Profile(
            "four-books", "blocks", source="wiki", noise=("^The Great Learning$|^The Doctrine of the Mean$", "(?i)^category:"), sections=(1, 1),
            forbidden=(
                "(?i)Wikisource|Creative Commons|Privacy policy|Disclaimers|Navigation|Retrieved from|Project Gutenberg|The Chinese Classics/Volume|"
                + HAN
            ),
        ),
    )
}
PROFILES |= {
    p.name: p
    for p in (
        replace(PROFILES["four-books"], name="great-learning", passages=(10, 30)),
        replace(PROFILES["four-books"], name="doctrine-of-the-mean", passages=(15, 50)),
    )
}
