"""Text functions on literal cases."""

import html

from wayfolio.functions import books as B
from wayfolio.functions import text as T


def test_clean_text(column):
    assert column(T.clean_text, "﻿ “Hi”  ‘you’ – a—b  c\n", "   ", "", None) == [
        "\"Hi\" 'you' - a-b c", None, None, None,
    ]


def test_keys(column):
    assert column(T.clean_key, "Al-Noor  Mosque ", "Al Noor Mosque", "__x", None) == ["al noor mosque", "al noor mosque", " x", ""]
    assert column(T.normalize_name, " The  A_B-c ") == ["the a_b-c"]


def test_labels_keep_word_tails(column):
    assert column(T.display_label, "al NOOR", "chinese_folk", " ", None) == ["Al NOOR", "Chinese Folk", "Sacred place", "Sacred place"]
    assert column(B.type_label, "selected_passages", "a__b", " ", None) == ["Selected Passages", "A B", None, None]
    assert column(B.slug, "Ancient  Egyptian!") == ["group-ancient-egyptian"]


def test_has_text(column):
    assert column(T.has_text, "a", "  \t", "", None) == [True, False, False, False]


def test_search_term(column):
    assert column(T.search_term, "What about the Peace-Prayer, please?", "near me", "Où est le TEMPLE bleu?") == ["peace", "", "bleu"]


def test_search_term_by_words(column):
    import re

    from wayfolio.lookups import SEARCH_STOP_WORDS

    def plain(message):
        return next((w for w in re.findall("[a-z0-9]+", (message or "").lower()) if len(w) > 3 and w not in SEARCH_STOP_WORDS), "")

    asked = [
        "about", "abouts", "xabout what", "the PLEASE about-what_near?nearby", "a1b abc abc1", "\u00e9about\u00e9tion", "what\u00a0holy\ufeffbookish",
        "", None, "   ", "prayer1 x", "one two six", "temple\ntemples", "1234", "religion religion4", "\u212aelvin kind",
    ]
    assert column(T.search_term, *asked) == [plain(m) for m in asked]


def test_search_term_is_one_expression(spark):
    plan = spark.createDataFrame([("x",)], "m string").select(T.search_term("m").alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "regexp_replace(" not in plan



def test_roman_numerals(column):
    def spell(n):
        out = ""
        for v, s in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
            while n >= v:
                out, n = out + s, n - v
        return out

    values = list(range(1, 400)) + [1999, 3999]
    assert column(T.roman_to_int, *[spell(v) for v in values]) == values
    assert column(T.roman_to_int, "xiv", "", "ABC", None) == [14, None, None, None]


def test_ordinals(column):
    assert column(T.ordinal_word, 1, 12, 20, 21, 30, 36, 37, schema="v int") == [
        "First", "Twelfth", "Twentieth", "Twenty-First", "Thirtieth", "Thirty-Sixth", "Lecture 37",
    ]


def test_page_keys(column):
    fn = lambda n: T.page_key(T.F.lit("et"), n)
    assert column(fn, 1, 99, 100, 119, 150, schema="v int") == ["et01", "et99", "eta0", "etb9", "etf0"]


def test_entities(column):
    samples = ["a &amp; b &lt;c&gt; &quot;q&quot;", "caf&#233; &#xE9;&#X4e2d;", "&amp;lt; &copy; &#65;&#66;", "no entity", "&#; &#x; &#8212;"]
    want = [html.unescape(s.replace("&copy;", "\0").replace("&amp;lt;", "\1")).replace("\0", "&copy;").replace("\1", "&lt;") for s in samples]
    assert column(T.decode_entities, *samples) == want
    # Codes above 16 bits keep their low half; lone surrogates become the replacement character.
    assert column(T.decode_entities, "&#65601;", "&#55357;") == ["A", "�"]


def test_html_and_wiki(column):
    page = "<style>p{}</style><script>x('</p>')</script><h1>T</h1><p>a<br/>b &amp; c</p>\n\n\n<div>d</div>"
    assert column(T.html_to_text, page) == ["T\n\na\nb & c\n\nd"]
    wiki = "{{header|x=1\n|y=2}}\nText<ref name=a>n</ref> '''bold''' [[Page|shown]] [[plain]] {{note}}<!-- c -->\n\nNext __NOTOC__"
    assert column(T.strip_wikitext, wiki) == ["Text bold shown plain \n\nNext"]


def test_scripts_and_cuts(column):
    assert column(T.has_script, "孟子", "abc", None) == [True, False, False]
    assert column(lambda v: T.truncate(v, 3), "abcdef", "ab") == ["abc", "ab"]


def test_titles_and_markers(column):
    fn = lambda d, t, n, s: B.section_title(d, t, n, s)
    rows = [("Shown", "T", 1, "S"), (" ", "T", 2, "S"), (None, "T", None, "S"), (None, None, 3, None), (None, "", None, "Surah")]
    assert column(fn, *rows, schema="d string, t string, n int, s string") == ["Shown", "T 2", "T", "Section 3", "Surah"]
    assert column(lambda a, b, c: B.passage_marker(a, b, c), ("Ayah", 4, 9), (None, None, 7), ("X", None, None), schema="a string, b int, c int") == [
        "Ayah 4", "Passage 7", "X",
    ]
    assert column(lambda a, b, c: B.reference(a, b, c), (None, None, 2), ("G", 1, 2), schema="a string, b int, c int") == ["Holy book :2", "G 1:2"]


def test_small_labels(column):
    assert column(B.stars, 4.5, -1.0, 9.0, 2.4, schema="v double") == ["★★★★★", "☆☆☆☆☆", "★★★★★", "★★☆☆☆"]
    assert column(B.default_name, "ann.lee@mail.example") == ["ann.lee"]
    assert column(B.default_title, "  q ", "x" * 90, " ", None) == ["q", "x" * 70, "AI Assistant question", "AI Assistant question"]
    rows = [(429, None, None), (404, None, None), (503, None, None), (400, None, None), (None, None, "Request TIMED OUT"), (None, "ENOTFOUND", None),
            (None, None, "fetch failed"), (None, None, "bad JSON"), (None, "PGRST1", "x"), (None, None, "x")]
    assert column(lambda s, c, m: B.classify_error(s, c, m), *rows, schema="s int, c string, m string") == [
        "rate_limited", "not_found", "server", "http", "timeout", "network", "network", "parsing", "supabase", "unknown",
    ]
    assert column(lambda t, d, k: B.is_selection(t, d, k), ("A", None, "selected_passages"), ("Whole", None, "sectioned_text"), schema="t string, d string, k string") == [True, False]
