"""Text rules against plain sequential versions of the same rule."""

import random
import re

from pyspark.sql import functions as F

from wayfolio.operators import sequences as S

RNG = random.Random(11)


def words(n):
    return " ".join(RNG.choice(("sun", "moon", "river", "stone", "a", "of")) for _ in range(n))


def random_lines(ends=("", "", ".", ";", ",", '."', "!-")):
    out = []
    for _ in range(RNG.randint(1, 30)):
        out.append(words(RNG.choice((1, 2, 5, 12, 30, 40))) + RNG.choice(ends))
    return out


def units(lines, cap):
    out, pending = [], ""
    for line in lines:
        pending = f"{pending} {line}" if pending else line
        if re.search(r"[.!?;:,][\"']?-?$", line) or len(pending) > cap:
            out.append(pending)
            pending = ""
    return out + ([pending] if pending else [])


def test_group_units(column):
    texts = [random_lines() for _ in range(150)]
    for cap in (40, 480):
        got = column(lambda v: S.group_units(v, cap), *["\n".join(t) for t in texts])
        assert got == [units(t, cap) for t in texts]


def test_group_units_on_a_long_text(column):
    lines = [words(6) + RNG.choice(("", ".")) for _ in range(20000)]
    assert column(S.group_units, "\n".join(lines)) == [units(lines, 480)]


def stanzas(lines, speakers, size):
    out, speaker, pending = [], "", []

    def flush():
        nonlocal speaker, pending
        if pending:
            out.append(" ".join(([speaker] if speaker else []) + [" ".join(pending)]))
            speaker, pending = "", []

    for line in lines:
        if line in speakers:
            flush()
            speaker = line
            continue
        pending.append(line)
        if len(pending) >= size:
            flush()
    flush()
    return out


def test_group_stanzas(column):
    texts = []
    for _ in range(150):
        lines = []
        for _ in range(RNG.randint(1, 25)):
            lines.append(RNG.choice(("Krishna.", "Arjuna:")) if RNG.random() < 0.2 and not (lines and lines[-1][-1] in ".:") else words(3))
        texts.append(lines)
    got = column(lambda v: S.group_stanzas(v, "(?:Krishna|Arjuna)[.:]", 4), *["\n".join(t) for t in texts])
    # A speaker whose run ends without a line says nothing.
    assert got == [stanzas(t, {"Krishna.", "Arjuna:"}, 4) for t in texts]


def passages(lines):
    out, buffer = [], []

    def flush():
        content = " ".join(buffer).strip()
        buffer.clear()
        if len(content) >= 3:
            out.append(content)

    for line in lines:
        if re.match(r"^\d+[.)]\s+", line) or re.match(r"^[IVXLCDM]+[.)]\s+", line):
            flush()
            buffer.append(re.sub(r"^(?:\d+|[IVXLCDM]+)[.)]\s+", "", line))
            continue
        if len(line) < 120 and re.search(r"[.:;!?]$", line) and buffer:
            buffer.append(line)
            flush()
            continue
        if buffer and len(line) > 140:
            flush()
        buffer.append(line)
    flush()
    return out


def test_split_passages(column):
    texts = []
    for _ in range(300):
        texts.append([RNG.choice(("", "", "", "3. ", "IV) ")) + words(RNG.choice((1, 3, 20, 26, 40))) + RNG.choice(("", ".", ".", "?")) for _ in range(RNG.randint(1, 25))])
    got = column(S.split_passages, *["\n".join(t) for t in texts])
    assert got == [passages(t) for t in texts]


def test_split_passages_on_a_long_text(column):
    lines = [words(4) for _ in range(30000)] + ["end."]
    assert column(S.split_passages, "\n".join(lines)) == [passages(lines)]


def footnotes(lines):
    out, skipping = [], False
    for line in lines:
        if re.match(r"\[Footnote\s+\d+:", line, re.I):
            skipping = not line.endswith("]")
            continue
        if skipping:
            skipping = not line.endswith("]")
            continue
        out.append(re.sub(r"\[Footnote\s+\d+:.*?\]", "", line, flags=re.I).strip())
    return [x for x in out if x]


def test_drop_footnotes(column):
    texts = []
    for _ in range(300):
        lines = []
        for _ in range(RNG.randint(1, 15)):
            kind = RNG.random()
            line = words(3)
            if kind < 0.2:
                line = f"[Footnote {RNG.randint(1, 99)}: {line}"
            elif kind < 0.3:
                line = f"{line} [footnote 4: x] y"
            if RNG.random() < 0.25:
                line += "]"
            lines.append(line)
        texts.append(lines)
    got = column(lambda v: S.joined_lines(S.drop_footnotes(v)), *["\n".join(t) for t in texts])
    assert got == ["\n".join(" ".join(x.split()) for x in footnotes(t)) for t in texts]


def test_expected_headings(column):
    texts = [[f"{RNG.randint(1, 5)}. {words(2)}" if RNG.random() < 0.6 else words(2) for _ in range(RNG.randint(1, 30))] for _ in range(200)]

    def fold(lines):
        out, want = [], 1
        for i, line in enumerate(lines):
            m = re.match(r"^(\d{1,2})\.", line)
            if m and int(m[1]) == want <= 4:
                out.append((want, i))
                want += 1
        return out

    got = column(lambda v: S.expected_headings(F.split(v, "\n"), "^(\\d{1,2})\\.", 4), *["\n".join(t) for t in texts])
    assert [[(h["number"], h["index"]) for h in g] for g in got] == [fold(t) for t in texts]


def test_a_numbered_verse_is_no_heading(column):
    text = "Ch. 1. 1. The way\n2. The named\n2. 1. All know\n3.\n11. Thirty spokes"
    sure = "^(?:Ch\\.|\\d{1,2}\\.\\s*(?:$|1\\.))"
    got = column(lambda v: S.expected_headings(F.split(v, "\n"), "^(?:Ch\\.\\s*)?(\\d{1,2})\\.", 81, sure), text)
    assert [(h["number"], h["index"]) for h in got[0]] == [(1, 0), (2, 2), (3, 3)]


def test_assign_sections(spark):
    text = "intro\nI\na\nb\nII\nIII\nc"
    df = spark.createDataFrame([(1, text), (2, "I\nx"), (3, "none"), (4, "I")], "doc_id int, text string")
    rows = S.assign_sections(df, "text", "[IV]+").orderBy("doc_id", "section_no").collect()
    assert [(r.doc_id, r.section_no, r.heading, r.body.strip("\n")) for r in rows] == [
        (1, 1, "I", "a\nb"), (1, 2, "II", ""), (1, 3, "III", "c"), (2, 1, "I", "x"), (4, 1, "I", ""),
    ]
    kept = S.assign_sections(df, "text", "[IV]+", keep_preface=True).filter("section_no = 0").orderBy("doc_id").collect()
    assert [(r.doc_id, r.body.strip()) for r in kept] == [(1, "intro"), (3, "none")]


def test_sections_give_back_the_text(spark):
    texts = ["\n".join(RNG.choice(("HEAD", words(2))) for _ in range(RNG.randint(1, 20))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = S.assign_sections(df, "text", "HEAD", keep_preface=True).orderBy("doc_id", "section_no").collect()
    rebuilt = {}
    for r in rows:
        rebuilt.setdefault(r.doc_id, []).extend([*([r.heading] if r.heading else []), *[x for x in r.body.split("\n") if x]])
    assert [rebuilt[i] for i in range(100)] == [t.split("\n") for t in texts]


def test_slices_and_clips(spark, column):
    df = spark.createDataFrame([(1, "x CHAP. I. one two CHAP. II.  CHAP. III three")], "id int, text string")
    rows = S.slice_by_marker(df, "text", "(?i)\\bCHAP\\.\\s*[IVXLCDM]+\\.?\\s*").orderBy("slice_no").collect()
    assert [r.content for r in rows] == ["one two", "three"]
    texts = ["a START body END z", "START body", "END START", "none END"]
    assert column(lambda v: S.clip_body(v, "START", "END"), *texts) == ["body", None, None, None]
    assert column(lambda v: S.clip_status(v, "START", "END"), *texts) == ["ok", "no_end", "no_end", "no_start"]


def test_numbered_rows(spark, column):
    df = spark.createDataFrame([(1, "1, 2. Twin  verse"), (2, "7. One"), (3, "none"), (4, "0. zero")], "id int, row string")
    rows = S.explode_numbers(df, "row").orderBy("id", "number").collect()
    assert [(r.id, r.number, r.verse) for r in rows] == [(1, 1, "Twin verse"), (1, 2, "Twin verse"), (2, 7, "One")]
    assert column(S.split_numbered, "A long prefix (1) first part here (2) tiny (3) [x] third part here", "one (4) marker (iv) only", "") == [
        ["A long prefix", "first part here", "third part here"], ["one marker only"], [],
    ]


def test_paragraphs_and_links(spark, column):
    assert column(S.paragraphs, "<p>a</p><P class='x'>b\nc</P><pre>no</pre>") == [["a", "b\nc"]]
    assert column(lambda v: S.paragraphs(v, "blocks"), "a\n \nb\nc") == [["a", "b\nc"]]
    page = '<a href="lot01.htm">Chapter 1</a><a href="lot02.htm">Chapter 2</a><a href="x01.htm">Chapter 1</a><a href="lot99.htm">Chapter 99</a>'
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    rows = S.index_links(df, "html", 'href="([^"]+)">\\s*Chapter\\s+(\\d+)\\s*</a>', last=27).orderBy("number").collect()
    assert [(r.number, r.target) for r in rows] == [(1, "x01.htm"), (2, "lot02.htm")]


def test_long_text_steps_are_written_once(spark, tables):
    from wayfolio.catalog.corpus_queries import _nested_works

    docs = spark.createDataFrame([(1, "a (1) one two three (2) four five six")], "doc_id long, text string")
    rows = docs.select("doc_id", F.posexplode_outer(S.split_numbered("text")).alias("part_no", "content"))
    assert [r.content for r in rows.collect()] == ["one two three", "four five six"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    works = _nested_works(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert works.count("array_compact") + works.count("[0-9:]") <= 2
