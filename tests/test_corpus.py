"""Profiles on short texts of our own, and the findings of the checks."""

import pytest

from wayfolio.plans import corpus as K


def segment(spark, text, profile):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = K.segment_corpus(df, profile).orderBy("section_no", "verse_number").collect()
    return [(r.section_number, r.verse_number, r.content) for r in rows]


SAMPLES = {
    "quran": (
        "front matter\nSURA I. - THE OPENING [I.]\nMECCA.-7 Verses\nIn the Name of God\nPraise be,\nlord of\nworlds.\n_____\n1 a note\non the text\nSURA CX. - HELP [II.]\nWhen help comes;\nsing",
        [(1, 1, "Praise be,"), (1, 2, "lord of worlds."), (2, 1, "When help comes;"), (2, 2, "sing")],
    ),
    "bhagavad-gita": (
        "<h2>CHAPTER I</h2><p>Krishna:<br>one<br>two<br>three<br>four<br>five</p><p>Arjuna:<br>six</p><h2>CHAPTER II</h2><p>seven</p>",
        [(1, 1, "Krishna: one two three four"), (1, 2, "five"), (1, 3, "Arjuna: six"), (2, 1, "seven")],
    ),
    "dhammapada": (
        "<p>Chapter I. The Pairs</p><p>1. All that\nwe are<br>2, 3. Twin verse</p><p>Chapter II. Care</p><p>21. Care is</p>",
        [(1, 1, "All that we are"), (1, 2, "Twin verse"), (1, 3, "Twin verse"), (2, 21, "Care is")],
    ),
    "book-of-mormon": (
        "Contents\n1 Nephi Chapter 1\nmore\n\n1 Nephi Chapter 1\n\n1:1 In the first\nyear 1:2 And it was\n\nnot a verse\n\n1 Nephi Chapter 2\n\n2:1 Again\n\n"
        "THE BOOK OF ENOS\n\n1:1 Behold\n\n1:2 I Enos\n\nTHE BOOK OF ALMA\nThe son\n\nAlma Chapter 1\n\n1:1 Now it 2:9 stray\n\nAlma Chapter 2\n"
        "\n*** END OF THE PROJECT GUTENBERG EBOOK THE BOOK OF MORMON ***\n2:1 License",
        [(1, 1, "In the first year"), (1, 2, "And it was"), (2, 1, "Again"), (1, 1, "Behold"), (1, 2, "I Enos"), (1, None, "stray"), (1, 1, "Now it"), (2, None, None)],
    ),
    "tao-te-ching": (
        "<p>Ch. 1. 1. The way<br>2. that flows<br>7. not a heading<br>2. 1. All know<br>3.<br>Not</p>",
        [(1, 1, "The way"), (1, 2, "that flows"), (1, 3, "not a heading"), (2, 1, "All know"), (3, 1, "Not")],
    ),
    "upanishads": (
        "Isa-Upanishad\nPeace Chant\nI\nAll this\nis clothed\nThis Mantram says\nmore of it\nII\nDoing works\nKena-Upanishad\nI\nBy whom",
        [(1, 1, "All this is clothed"), (1, 2, "Doing works"), (2, 1, "By whom")],
    ),
    "zend-avesta": (
        "PREFACE\nUncleanness\nno\nSELECTIONS FROM THE ZEND-AVESTA\nintroduction\nUNCLEANNESS[3].\nAhura spake.\n[Footnote 1: a\nlong note]\nO Maker of the world\n"
        "who is he\nHail, bull\nYASNA\nTo the Fire\nI pray for it\nTHE DHAMMAPADA\nTo the Fire\nLicense",
        [(1, 1, "Ahura spake."), (1, 2, "O Maker of the world who is he"), (1, 3, "Hail, bull YASNA"), (2, 1, "I pray for it")],
    ),
    "japji-sahib": (
        "Title: x\nnav\n## THE JAPJI\nThere is but one God\n### I.[4]\nTruth was\n[12. a note\nends here]\nin the beginning {p. 197}\n### II.\nBy order\n[13. open note\n"
        "### III.\nThird\n### IXX.\n### XXVI.\nTwenty six\nThat God is ever true\nhe shall be\nXXVIII\ntwenty eight\nSLOK\nThe air is the guru\n* * *\nNext: Asa Ki War\nother",
        [
            (1, 1, "There is but one God"), (2, 1, "Truth was in the beginning"), (3, 1, "By order"), (4, 1, "Third"), (20, None, None), (27, 1, "Twenty six"),
            (28, 1, "That God is ever true he shall be"), (29, 1, "twenty eight"), (40, 1, "The air is the guru"),
        ],
    ),
    "analects": (
        "Contents BOOK I. X.\nCONFUCIAN\nANALECTS. BOOK I. HSIO R.\nCHAP. I. The Master[1] said,\nto learn CHAP. II. Filial\nBOOK II. WEI\nCHANG. CHAP. I. Govern\n"
        "*** END OF THE PROJECT GUTENBERG EBOOK THE ANALECTS OF CONFUCIUS\nBOOK III. LICENSE. CHAP. I. free",
        [(1, 1, "The Master said, to learn"), (1, 2, "Filial"), (2, 1, "Govern")],
    ),
    "diamond-sutra": (
        "<h2>PREFACE</h2><p>Before</p><h2> THE DIAMOND SUTRA </h2><p>no chapter yet</p><p id=\"Ch_1\" class=\"chapter\">[Chapter 1]</p><p>Thus <sup>1</sup>I heard."
        "<a href='#f' class='fnanchor'>[2]</a></p><p class=q>Once,\nthere.</p><p>x</p><p id='Ch_2_3' class='chapter'>[Chapters 2 and 3]</p><p>Then.</p><p>[Chapter 9 alone]</p>"
        "<div class='footnote' id='f'><p>a note</p></div><p>more notes</p><p id=\"Ch_4\" class=\"chapter\">[Chapter 4]</p><p>Four.</p>"
        "<pre>*** END OF THE PROJECT GUTENBERG EBOOK</pre><p>License</p>",
        [(1, 1, "Thus I heard."), (1, 2, "Once, there."), (2, 1, "Then."), (3, 1, "Four.")],
    ),
    "yoga-sutras": (
        "<h2>BOOK I</h2><p class=\"p1\">1. Early.</p>*** START OF THE PROJECT GUTENBERG EBOOK<h2>INTRODUCTION TO BOOK I</h2><p>intro</p><p class=\"p1\">9. no</p><h2>BOOK I</h2>"
        "<p class=\"p1\">1. Now yoga.</p><p>commentary 7. here</p><p class=\"p1\">2, It\nis rest.</p><p class=\"p1 x\">unnumbered</p><h2>INTRODUCTION TO BOOK II</h2>"
        "<p class=\"p1\">3. not in</p><h2><i>Book</i> II</h2><p class=\"p1\">1. Effort.</p><p class='p2'>2. no</p>*** END OF THE PROJECT GUTENBERG EBOOK<p class=\"p1\">2. License</p>",
        [(1, None, "unnumbered"), (1, 1, "Now yoga."), (1, 2, "It is rest."), (2, 1, "Effort.")],
    ),
    "torah": (
        "<H1>Genesis Chapter 1</H1><A NAME=\"1\"></A><B>1</B> In the <I>beginning</I>. <A NAME='3'></A><B>3</B> And &amp; light.",
        [(1, 1, "In the beginning ."), (1, 3, "And & light.")],
    ),
    "lotus-sutra": ("<P>Index</P><P ALIGN=x>Thus  heard</P><p>Second</p>", [(1, 1, "Thus heard"), (1, 2, "Second")]),
    "zhuangzi": ("<P>p. 164</P><P>In the Northern Ocean</P><p>PART I</p><p>THE</p><p>Then</p>", [(1, 1, "In the Northern Ocean"), (1, 2, "Then")]),
    "pure-land-sutras": ("<p>§ 1. Thus</p><p>heard by me</p><p>[3 note]</p><p>§ 2. Then</p><p>spoke</p>", [(1, 1, "Thus"), (1, 2, "heard by me"), (2, 1, "Then"), (2, 2, "spoke")]),
    "book-of-the-dead": (
        "<html><p>head HYMN TO OSIRIS</p><BODY><p>Vignette: a boat</p><p>Text: HYMN TO OSIRIS Unnefer[3]</p><p>PLATE I</p><p>(1) Homage to thee {p. 5}(2) O thou shining (3) ok</p>"
        "<p>12 note one</p><p>netjer nefer , \"the god\"</p><p>[1. another note]</p><p>Praise be unto thee.</p><p>short</p><p>Vignette of a shrine</p><p>A later paragraph</p>"
        "<nav role=\"navigation\"><p>Homage to the index</p></nav></BODY>",
        [(1, 1, "HYMN TO OSIRIS Unnefer")],
    ),
    "kojiki": (
        "<div><p>Navigation</p></div><div class=\"prp-pages-output\"><p>Preface</p><p>[Sect. I.—The Beginning.]</p><p>The names[12] of the deities</p><p>Section 3</p><p>by someone</p>"
        "<p>next line ^</p><p>x</p><p>* * *</p><p>[1] a note</p></div><div class=\"x reflist\"><p>ref</p></div>",
        [(1, 1, "The names of the deities"), (1, 2, "next line")],
    ),
    "uttaradhyayana": ("<p>Home</p><p>First Lecture.</p><p>1. A monk<br>should obey.</p><p>II. He walks</p><p>Next: two</p><p>3. gone</p>", [(1, 1, "A monk should obey."), (1, 2, "He walks")]),
    "mencius": ("{{header|title=x}}\nLiang Hui Wang I\n\nMencius went '''to''' see\n\nThe [[king]] said\n\nCategory:Texts", [(1, 1, "Mencius went to see"), (1, 2, "The king said")]),
    "four-books": ("one\ntwo\n\n<ref>x</ref>three", [(1, 1, "one two"), (1, 2, "three")]),
}


@pytest.mark.parametrize("name", list(SAMPLES))
def test_profile(spark, name):
    text, want = SAMPLES[name]
    assert segment(spark, text, K.PROFILES[name]) == want


def test_every_profile_is_sampled():
    assert set(K.PROFILES) - set(SAMPLES) == {"bible", "prophets-writings", "great-learning", "doctrine-of-the-mean"}
    assert K.PROFILES["prophets-writings"].marker == K.PROFILES["torah"].marker


@pytest.mark.parametrize("name", [p.name for p in K.PROFILES.values() if p.stops])
def test_nothing_is_read_behind_the_end(spark, name):
    text, want = SAMPLES[name]
    line = "<p>{}</p>" if K.PROFILES[name].source == "html" else "\n{}"
    tail = "".join(line.format(x) for x in ("*** END OF THE PROJECT GUTENBERG EBOOK X ***", "999. You may copy it,", "III", "give it away."))
    assert segment(spark, text + tail, K.PROFILES[name]) == want


def test_an_opening_is_a_section(spark):
    text = "<p>Short</p><p>Adoration to all the teachers</p><p>§ 1. Thus it was</p><p>heard</p>"
    want = [(1, 1, "Adoration to all the teachers"), (2, 1, "Thus it was"), (2, 2, "heard")]
    assert segment(spark, text, K.PROFILES["pure-land-sutras"]) == want


def test_nested_book(spark):
    book = '{"chapters": [{"chapter": "1", "verses": [{"verse": "1", "text": "In the  beginning"}, {"verse": "2", "text": "b"}]}]}'
    assert segment(spark, book, K.PROFILES["bible"]) == [(1, 1, "In the beginning"), (1, 2, "b")]


def test_pages_are_counted_per_work(spark):
    profile = K.Profile("p", "lines", pages=(3, 3), passages=(4, 6))
    docs = [(f"{w}{p}", w, p, "one\ntwo") for w in "ab" for p in (1, 2, 3) if (w, p) != ("b", 2)]
    df = spark.createDataFrame(docs, "doc_id string, work_id string, page_no int, text string")
    got = {(r.work_id, r.rule, r.detail) for r in K.validate_corpus(K.segment_corpus(df, profile), profile).collect()}
    assert got == {("b", "too_few_pages", "2"), ("b", "missing_page", "2")}
    alone = K.segment_corpus(df.drop("work_id", "page_no"), profile)
    assert K.validate_corpus(alone, profile).count() == 0


def findings(spark, rows, profile):
    df = spark.createDataFrame(rows, "doc_id int, section_no int, section_number int, heading string, verse_number int, content string")
    return {(r.section_no, r.rule, r.severity) for r in K.validate_corpus(df, profile).collect()}


def test_checks(spark):
    profile = K.Profile("p", "units", sections=(3, 3), passages=(3, 4), forbidden="(?i)license")
    clean = [(1, 1, 1, "I", 1, "a"), (1, 2, 2, "II", 1, "b"), (1, 3, 3, "III", 1, "c"), (1, 3, 3, "III", 2, "d")]
    assert findings(spark, clean, profile) == set()
    broken = [(1, 1, 1, "I", 1, "a"), (1, 1, 1, "I", 3, "License here"), (1, 2, 4, "IV", 1, "b"), (1, 2, 4, "IV", 1, "b2"), (1, 3, 1, "I", None, None), (1, 4, 3, "III", 1, "x")]
    assert findings(spark, broken, profile) == {
        (1, "number_gap", "error"), (1, "forbidden_text", "error"), (2, "repeated_number", "error"), (2, "heading_order", "warning"),
        (2, "heading_ahead", "error"), (3, "empty_section", "error"), (3, "heading_order", "warning"), (4, "heading_order", "warning"),
        (None, "too_many_sections", "error"), (None, "too_many_passages", "error"), (None, "repeated_section", "error"), (None, "missing_section", "error"),
    }


def test_gaps(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 5, 5, 9)] + [("b", 3)], "k string, n int")
    rows = {(r.k, r.issue, r["first"], r["last"]) for r in K.numbering_gaps(df, ["k"], "n").collect()}
    assert rows == {("a", "gap", 3, 4), ("a", "gap", 6, 8), ("a", "repeated", 5, 5), ("b", "gap", 1, 2)}


def test_the_other_layout_of_lectures(spark):
    text = "<p>Home</p><p>Next &gt;</p><p>(1) A monk should\nobey. (2) He walks softly. (3) Then slowly</p><p>Footnotes and references:</p><p>(4) a note</p>"
    assert segment(spark, text, K.PROFILES["uttaradhyayana"]) == [(1, 1, "A monk should obey. He walks softly."), (1, 2, "Then slowly")]


def test_sections_of_a_window(spark):
    page = "<body><p>A HYMN OF PRAISE TO RA when he riseth</p><p>Homage to thee, O Ra.</p><p>Rubric here</p><p>(1) Thou risest up (2) thou shinest</p><p>Text [CHAPTER CXXXIII] next</p><p>not this one</p><HR>\n<CENTER><A HREF=x>"
    profile = K.PROFILES["book-of-the-dead"]
    df = spark.createDataFrame([(1, page)], "doc_id int, text string")
    rows = K.segment_corpus(df, profile).orderBy("verse_number").collect()
    assert [r.content for r in rows] == ["A HYMN OF PRAISE TO RA when he riseth", "Homage to thee, O Ra.", "Thou risest up", "thou shinest"]
    assert {r.heading for r in rows} == {"Hymn to Ra"}


def test_headings_are_named(spark):
    heads = lambda name: [r.heading for r in K.segment_corpus(spark.createDataFrame([(1, SAMPLES[name][0])], "doc_id int, text string"), K.PROFILES[name])
                          .select("section_no", "heading").distinct().orderBy("section_no").collect()]
    assert heads("diamond-sutra") == ["Chapter 1", "Chapters 2 and 3", "Chapter 4"]
    assert heads("book-of-mormon") == ["1 Nephi 1", "1 Nephi 2", "Enos 1", "Alma 1", "Alma 2"]
    assert heads("japji-sahib") == ["Opening", "Pauri 1", "Pauri 2", "Pauri 3", "Pauri 19", "Pauri 26", "Pauri 27", "Pauri 28", "Final Salok"]
    assert heads("yoga-sutras") == ["BOOK I", "Book II"]


def whole_mormon():
    """A complete work: 15 books, 239 chapters, 6604 verses, four books without headings of chapters."""
    chapters = [(b, n + 1) for b, count in K.PROFILES["book-of-mormon"].chapters for n in range(count)]
    titles = {name: title for title, name in K.PROFILES["book-of-mormon"].books}
    blocks, left = ["front matter"], 6604
    for i, (book, n) in enumerate(chapters):
        verses = left // (len(chapters) - i)
        left -= verses
        if n == 1 and book in titles:
            blocks.append(titles[book])
        if book not in ("Enos", "Jarom", "Omni", "4 Nephi"):
            blocks.append(f"{book} Chapter {n}")
        blocks += [f"{n}:{v} word {v}\nof {book}" for v in range(1, verses + 1)]
    return "\n\n".join([*blocks, "*** END OF THE PROJECT GUTENBERG EBOOK THE BOOK OF MORMON ***", "License"])


def whole_yoga():
    books = "".join(
        f"<h2>INTRODUCTION TO BOOK {r}</h2><p>some commentary</p><h2>BOOK {r}</h2>" + "".join(f'<p class="p1">{i}. Sutra {i}.</p><p>commentary</p>' for i in range(1, n + 1))
        for r, n in zip(("I", "II", "III", "IV"), (51, 55, 55, 34), strict=True)
    )
    return f"*** START OF THE PROJECT GUTENBERG EBOOK{books}*** END OF THE PROJECT GUTENBERG EBOOK<p>license</p>"


def whole_diamond():
    parts = "".join(f'<p id="Ch_{i}" class="chapter">[Chapter {i}]</p><p>Passage one of {i}.</p><p>Two.</p><div class="footnote"><p>Footnote {i}</p></div>' for i in range(1, 32))
    return f"<h2>THE DIAMOND SUTRA</h2>{parts}*** END OF THE PROJECT GUTENBERG EBOOK"


ROMAN = dict(zip(range(1, 39), "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX XXI XXII XXIII XXIV XXV XXVI XXVII XXVIII XXIX XXX XXXI XXXII XXXIII "
                 "XXXIV XXXV XXXVI XXXVII XXXVIII".split(), strict=True))


def whole_japji():
    pauris = "".join(f"### {ROMAN[n]}.\nline {n} of it\n" if n != 27 else "That God is ever true\n" for n in range(1, 39))
    return f"nav\nTHE JAPJI\nOne God\n{pauris}SLOK\nThe air\nNext: Asa Ki War"


def whole_analects():
    return "CONFUCIAN ANALECTS. " + "".join(f"BOOK {ROMAN[b]}. NAME {b}. " + "".join(f"CHAP. {ROMAN[c]}. The Master said {c}.\n" for c in range(1, 25)) for b in range(1, 21)) + (
        "*** END OF THE PROJECT GUTENBERG EBOOK THE ANALECTS OF CONFUCIUS License")


def whole_zend():
    titles = K.PROFILES["zend-avesta"].titles
    return "SELECTIONS FROM THE ZEND-AVESTA\n" + "".join(f"{t.upper()}[{i}].\n" + "".join(f"I pray {k}\n" for k in range(5)) for i, t in enumerate(titles)) + "THE DHAMMAPADA\n"


WHOLE = {
    "book-of-mormon": (whole_mormon, ("2:1 word 1\nof Jacob", "2:x"), "number_gap"),
    "yoga-sutras": (whole_yoga, ('<p class="p1">34. Sutra', '<p class="p3">34. Sutra'), None),
    "diamond-sutra": (whole_diamond, ("Two.", "See the Preface."), "forbidden_text"),
    "japji-sahib": (whole_japji, ("### XII.", "* * *"), "missing_section"),
    "analects": (whole_analects, ("CHAP. II. The Master said 2.", ""), None),
    "zend-avesta": (whole_zend, ("TO THE FIRE[9].", "[Footnote 1: x]"), "missing_title"),
}


@pytest.mark.parametrize("name", list(WHOLE))
def test_whole_works(spark, name):
    """A complete work has no finding; one defect has one."""
    made, (given, instead), rule = WHOLE[name]
    whole = made()
    assert given in whole
    df = spark.createDataFrame([(1, whole), (2, whole.replace(given, instead, 1))], "doc_id int, text string")
    profile = K.PROFILES[name]
    found = K.validate_corpus(K.segment_corpus(df, profile), profile, docs=df).collect()
    assert [r for r in found if r.doc_id == 1] == []
    if rule:
        assert rule in {r.rule for r in found if r.doc_id == 2}


def test_what_is_not_found_is_reported(spark):
    df = spark.createDataFrame([(1, "no limits here"), (2, None)], "doc_id int, text string")
    profile = K.PROFILES["zend-avesta"]
    found = K.validate_corpus(K.segment_corpus(df, profile), profile, docs=df).collect()
    assert sorted((r.doc_id, r.rule) for r in found) == [(1, "no_sections"), (2, "no_sections")]


@pytest.mark.parametrize("module", ["plans.audit", "plans.corpus", "plans.profiles", "plans.explore", "plans.ingest", "plans.library", "functions.markup", "operators.sequences", "operators.geo"])
def test_star_imports(module):
    exec(f"from wayfolio.{module} import *", {})
