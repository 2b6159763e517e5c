"""Order-dependent operators on tables and inside texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfolio.catalog.registry import add
from wayfolio.functions.text import clean_line, squeeze
from wayfolio.operators import sequences as S
from wayfolio.operators.ordered import neighbors, row_numbers
from wayfolio.plans.conversations import assistant_tail, exchange_rows, history_tail, qa_pairs
from wayfolio.plans.corpus import numbering_gaps, sequence_breaks
from wayfolio.plans.explore import next_due
from wayfolio.plans.library import positions, renumber

# --- tables ---------------------------------------------------------------------------

add(
    "f1_renumber",
    lambda t: renumber(t("passages").withColumnRenamed("section_id", "doc_id"), ["doc_id"], ["line_no"], "Line")
    .select("doc_id", "line_no", "verse_number", "verse_label", "sort_order"),
    "passages",
    """SELECT section_id AS doc_id, line_no, row_number() OVER (PARTITION BY section_id ORDER BY line_no) AS verse_number,
  'Line' AS verse_label, row_number() OVER (PARTITION BY section_id ORDER BY line_no) AS sort_order  FROM passages""",
)
add(
    "f1_renumber_large_groups",
    lambda t: row_numbers(t("events").select("event_type", "event_id", "ts"), ["event_type"], ["ts", "event_id"], "number", partitions=7)
    .select("event_id", "number"),
    "", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS number FROM events",
)
add(
    "f2_with_neighbors",
    lambda t: neighbors(t("sections_h"), ["book_id"], ["chapter_number"], {"previous_id": "section_id"}, {"next_id": "section_id"})
    .select("section_id", "previous_id", "next_id"),
    "sections_h",
    """SELECT section_id, lag(section_id) OVER w AS previous_id, lead(section_id) OVER w AS next_id
FROM sections_h WINDOW w AS (PARTITION BY book_id ORDER BY chapter_number)""",
)
add(
    "f2_neighbors_large_groups",
    lambda t: neighbors(
        t("events").select("event_type", "event_id", "ts"), ["event_type"], ["ts", "event_id"], {"before": "event_id"}, {"after": "event_id"},
        partitions=7,
    ).select("event_id", "before", "after"),
    "",
    """SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
)
add(
    "f3_position",
    lambda t: positions(t("sections_h").withColumn("own", F.when(F.col("section_id") % 3 == 0, F.col("chapter_number"))), "own")
    .select("section_id", "position"),
    "sections_h",
    """SELECT section_id, coalesce(CASE WHEN section_id % 3 = 0 THEN chapter_number END, sort_order,
  row_number() OVER (PARTITION BY book_id ORDER BY section_id)) AS position FROM sections_h""",
)
add(
    "f4_qa_pairs", lambda t: qa_pairs(t("conversation_messages")), "conversation_messages",
    """WITH q AS (SELECT conv_id, arg_min(content, turn) AS question, min(turn) AS question_turn FROM conversation_messages WHERE role = 'user' GROUP BY 1),
a AS (SELECT m.conv_id, arg_min(content, turn) AS answer, min(turn) AS answer_turn FROM conversation_messages m JOIN q ON q.conv_id = m.conv_id
  WHERE role = 'assistant' AND turn >= question_turn GROUP BY 1)
SELECT conv_id, coalesce(nullif(substr(question, 1, 70), ''), 'AI question') AS title, question, answer, question_turn, answer_turn
FROM q JOIN a USING (conv_id)""",
)
add(
    "f4_qa_pairs_titled",
    lambda t: qa_pairs(t("conversation_messages"), t("conversation_messages").select(
        "conv_id", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Talk "), "conv_id")).alias("title")).distinct()).select("conv_id", "title"),
    "conversation_messages",
    """WITH q AS (SELECT conv_id, arg_min(content, turn) AS question, min(turn) AS question_turn FROM conversation_messages WHERE role = 'user' GROUP BY 1),
a AS (SELECT DISTINCT m.conv_id FROM conversation_messages m JOIN q ON q.conv_id = m.conv_id WHERE role = 'assistant' AND turn >= question_turn)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Talk ' || conv_id ELSE coalesce(nullif(substr(question, 1, 70), ''), 'AI question') END AS title
FROM q JOIN a USING (conv_id)""",
)
add(
    "f5_history_tail", lambda t: history_tail(t("conversation_messages")), "conversation_messages",
    """WITH v AS (SELECT conv_id, turn, role, substr(content, 1, 4000) AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n
  FROM conversation_messages WHERE role IN ('user', 'assistant'))
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || content, chr(10) ORDER BY turn) AS history
FROM v WHERE n <= 10 GROUP BY 1""",
)
add(
    "f5_assistant_tail", lambda t: assistant_tail(t("conversation_messages"), turns=3), "conversation_messages",
    """WITH v AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversation_messages)
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || content, chr(10) ORDER BY turn) AS history
FROM v WHERE n <= 3 GROUP BY 1""",
)
add(
    "f5_exchange_rows",
    lambda t: exchange_rows(qa_pairs(t("conversation_messages")).withColumn("user_id", F.col("conv_id") % 20))[1].select("conv_id", "user_id", "turn", "role", "content"),
    "conversation_messages",
    """WITH q AS (SELECT conv_id, arg_min(content, turn) AS question, min(turn) AS t FROM conversation_messages WHERE role = 'user' GROUP BY 1),
a AS (SELECT m.conv_id, arg_min(content, turn) AS answer FROM conversation_messages m JOIN q ON q.conv_id = m.conv_id WHERE role = 'assistant' AND turn >= t GROUP BY 1)
SELECT conv_id, conv_id % 20 AS user_id, CAST(0 AS INTEGER) AS turn, 'user' AS role, question AS content FROM q JOIN a USING (conv_id)
UNION ALL SELECT conv_id, conv_id % 20, 1, 'assistant', answer FROM q JOIN a USING (conv_id)""",
)
# Numbers with a gap behind the first, and in some sections one given twice.
_SHIFTED = "CASE WHEN section_id % 4 = 1 AND verse_number = 4 THEN 4 WHEN verse_number >= 2 THEN verse_number + 1 ELSE verse_number END"
add(
    "f8_numbering_gaps", lambda t: numbering_gaps(t("passages_h").withColumn("verse_number", F.expr(_SHIFTED)), ["section_id"], "verse_number"), "passages_h",
    f"""WITH d AS (SELECT section_id, {_SHIFTED} AS v, count(*) AS n FROM passages_h GROUP BY 1, 2),
l AS (SELECT section_id, v, coalesce(lag(v) OVER (PARTITION BY section_id ORDER BY v), 0) AS p FROM d)
SELECT section_id, 'gap' AS issue, CAST(p + 1 AS BIGINT) AS first, CAST(v - 1 AS BIGINT) AS last FROM l WHERE v - p > 1
UNION ALL SELECT section_id, 'repeated', v, v FROM d WHERE n > 1""",
)
add(
    "f9_sequence_breaks",
    lambda t: sequence_breaks(t("sections_h").withColumn("found", F.col("chapter_number") + F.when(F.col("section_id") % 9 == 0, 1).when(F.col("section_id") % 9 == 1, -1).otherwise(0)),
                              ["book_id"], ["chapter_number"], "found").select("section_id", "found", "expected", "severity"),
    "sections_h",
    """SELECT section_id, found, chapter_number AS expected, CASE WHEN found > chapter_number THEN 'error' ELSE 'warning' END AS severity
FROM (SELECT *, chapter_number + CASE section_id % 9 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS found FROM sections_h) WHERE found <> chapter_number""",
)
add(
    "f11_next_due", lambda t: next_due(t("reminders"), F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")).select("user_id", "id", "title"), "reminders",
    """SELECT user_id, id, title FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY reminder_time, id) AS n
  FROM reminders WHERE reminder_time >= TIMESTAMP '2024-01-10 00:00:00') WHERE n = 1""",
)

# --- texts ----------------------------------------------------------------------------

# A line of a single word stands for a heading or a speaker.
WORD = "\\S+"
_FLAGGED = "SELECT section_id, line_no, content, regexp_matches(content, '^\\S+$') AS head FROM passages"
_SECTIONED = f"""f AS ({_FLAGGED}),
s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY section_id ORDER BY line_no) AS section_no FROM f)"""


def _sections(t):
    return S.assign_sections(t.documents, "text", WORD)


add(
    "f6_assign_sections",
    lambda t: _sections(t).select("doc_id", "section_no", "heading", F.regexp_replace("body", "\\n$", "").alias("body")),
    "passages",
    f"""WITH {_SECTIONED}
SELECT section_id AS doc_id, CAST(section_no AS INTEGER) AS section_no, max(content) FILTER (WHERE head) AS heading,
  coalesce(string_agg(content, chr(10) ORDER BY line_no) FILTER (WHERE NOT head), '') AS body FROM s WHERE section_no > 0 GROUP BY 1, 2""",
)
# Words that open slices in the invented prose of the test documents.
_MARK = "\\b(?:the|les|der) "
add(
    "f12_slice_by_marker",
    lambda t: S.slice_by_marker(t.documents, "text", _MARK).select("doc_id", "slice_no", "marker", "content"),
    "",
    r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '\b(the|les|der) ', chr(1) || '\1 ', 'g'), chr(1)) AS parts FROM documents),
x AS (SELECT doc_id, i, parts[i] AS part FROM p, unnest(range(1, len(parts) + 1)) AS r(i)),
y AS (SELECT doc_id, i, substr(part, 1, 4) AS marker, nullif(trim(regexp_replace(substr(part, 5), '\s+', ' ', 'g')), '') AS content FROM x
  WHERE part LIKE 'the %' OR part LIKE 'les %' OR part LIKE 'der %')
SELECT doc_id, CAST(i - 1 - CASE WHEN (SELECT parts[1] FROM p p2 WHERE p2.doc_id = y.doc_id) = '' THEN 1 ELSE 0 END AS INTEGER) AS slice_no, marker, content
FROM y WHERE content IS NOT NULL""",
)

# Two thirds of the lines lose their closing mark, so that units run over several lines.


def _open_text():
    return F.array_join(
        F.transform(
            F.split("text", "\\n"),
            lambda x: F.when(F.length(x) % 3 == 0, squeeze(x)).otherwise(squeeze(F.regexp_replace(x, "[.!?;:,]+$", ""))),
        ),
        "\n",
    )


_OPEN = """o AS (SELECT section_id, line_no, CASE WHEN length(content) % 3 = 0 THEN c ELSE trim(regexp_replace(c, '[.!?;:,]+$', '')) END AS line
  FROM (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS c FROM passages)),
n AS (SELECT section_id, line, row_number() OVER (PARTITION BY section_id ORDER BY line_no) AS i FROM o WHERE line <> '')"""
add(
    "f13_group_units",
    lambda t: t.documents.select("doc_id", F.posexplode(S.group_units(_open_text())).alias("unit_no", "content")),
    "passages",
    f"""WITH RECURSIVE {_OPEN},
w AS (
  SELECT section_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS len, CAST(0 AS BIGINT) AS unit, true AS shut, CAST(NULL AS VARCHAR) AS line FROM n WHERE i = 1
  UNION ALL
  SELECT w.section_id, n.i, CASE WHEN w.shut THEN length(n.line) ELSE w.len + 1 + length(n.line) END,
    w.unit + CASE WHEN w.shut THEN 1 ELSE 0 END,
    regexp_matches(n.line, '[.!?;:,]["'']?-?$') OR CASE WHEN w.shut THEN length(n.line) ELSE w.len + 1 + length(n.line) END > 480, n.line
  FROM w JOIN n ON n.section_id = w.section_id AND n.i = w.i + 1)
SELECT section_id AS doc_id, CAST(unit - 1 AS INTEGER) AS unit_no, string_agg(line, ' ' ORDER BY i) AS content FROM w WHERE i > 0 GROUP BY 1, 2""",
)
add(
    "f14_group_stanzas",
    lambda t: t.documents.select("doc_id", F.posexplode(S.group_stanzas("text", WORD, 4)).alias("stanza_no", "content")),
    "passages",
    f"""WITH {_SECTIONED},
l AS (SELECT *, row_number() OVER (PARTITION BY section_id, section_no ORDER BY line_no) - 1 AS k FROM s WHERE NOT head AND content <> ''),
h AS (SELECT section_id, section_no, content AS speaker FROM s WHERE head),
g AS (SELECT l.section_id, l.section_no, k // 4 AS g, string_agg(content, ' ' ORDER BY k) AS body FROM l GROUP BY 1, 2, 3)
SELECT g.section_id AS doc_id, CAST(row_number() OVER (PARTITION BY g.section_id ORDER BY g.section_no, g.g) - 1 AS INTEGER) AS stanza_no,
  CASE WHEN g.g = 0 AND speaker IS NOT NULL THEN speaker || ' ' ELSE '' END || body AS content
FROM g LEFT JOIN h ON h.section_id = g.section_id AND h.section_no = g.section_no""",
)


def _noted_text():
    return F.array_join(
        F.transform(
            F.split("text", "\\n"),
            lambda x: F.concat(
                F.when(F.length(x) % 7 == 0, F.lit("[Footnote 12: ")).otherwise(F.lit("")), x,
                F.when(F.length(x) % 5 == 0, F.lit("]")).otherwise(F.lit("")),
            ),
        ),
        "\n",
    )


add(
    "f15_drop_footnotes",
    lambda t: t.documents.select("doc_id", S.joined_lines(S.drop_footnotes(_noted_text()), clean_line).alias("text")).filter("text <> ''"),
    "passages",
    r"""WITH l AS (SELECT section_id, line_no, CASE WHEN length(content) % 7 = 0 THEN '[Footnote 12: ' ELSE '' END || content ||
  CASE WHEN length(content) % 5 = 0 THEN ']' ELSE '' END AS line, length(content) % 7 = 0 AS opens, length(content) % 5 = 0 AS shuts FROM passages),
m AS (SELECT *, max(CASE WHEN opens THEN line_no END) OVER w AS last_open, max(CASE WHEN shuts THEN line_no END) OVER (PARTITION BY section_id ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_shut FROM l WINDOW w AS (PARTITION BY section_id ORDER BY line_no)),
k AS (SELECT * FROM m WHERE last_open IS NULL OR (NOT opens AND last_shut >= last_open))
SELECT section_id AS doc_id, string_agg(nullif(trim(regexp_replace(line, '\s+', ' ', 'g')), ''), chr(10) ORDER BY line_no) AS text FROM k GROUP BY 1""",
)
add(
    "f16_clip_body",
    lambda t: t.pages.select("page_id", S.clip_body("html", "<article>", "</article>").alias("body"), S.clip_status("html", "<article>", "</article>").alias("status")),
    "",
    """SELECT page_id, CASE WHEN a > 0 AND position('</article>' IN rest) > 0 THEN trim(substr(rest, 1, position('</article>' IN rest) - 1), chr(10) || ' ') END AS body,
  CASE WHEN a = 0 THEN 'no_start' WHEN position('</article>' IN rest) = 0 THEN 'no_end' ELSE 'ok' END AS status
FROM (SELECT page_id, a, substr(html, CASE WHEN a > 0 THEN a + 9 ELSE 1 END) AS rest FROM (SELECT page_id, html, position('<article>' IN html) AS a FROM pages))""",
)


def _numbered_text():
    return F.array_join(
        F.transform(
            F.split("text", "\\n"),
            lambda x: F.concat(F.when(F.length(x) % 11 == 0, F.concat((F.length(x) % 9 + 1).cast("string"), F.lit(". "))).otherwise(F.lit("")), squeeze(x)),
        ),
        "\n",
    )


add(
    "f17_split_passages",
    lambda t: t.documents.select("doc_id", F.posexplode(S.split_passages(_numbered_text())).alias("part_no", "content")),
    "passages",
    r"""WITH l AS (SELECT section_id, line_no, CASE WHEN length(content) % 11 = 0 THEN (length(content) % 9 + 1) || '. ' ELSE '' END ||
  trim(regexp_replace(content, '\s+', ' ', 'g')) AS line FROM passages),
r AS (SELECT section_id, line_no, line, regexp_matches(line, '^([0-9]+|[IVXLCDM]+)[.)] ') AS num, length(line) > 140 AS long,
  length(line) < 120 AND regexp_matches(line, '[.:;!?]$') AND NOT regexp_matches(line, '^([0-9]+|[IVXLCDM]+)[.)] ') AS c FROM l),
i AS (SELECT *, line_no - row_number() OVER (PARTITION BY section_id, c ORDER BY line_no) AS island, line_no AS ln FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY section_id, c, island ORDER BY ln) AS k, min(ln) OVER (PARTITION BY section_id, c, island) AS first FROM i),
e AS (SELECT *, c AND CASE WHEN first = 0 THEN k % 2 = 0 ELSE k % 2 = 1 END AS closes FROM p),
b AS (SELECT *, CASE WHEN num OR long OR coalesce(lag(closes) OVER w, true) THEN 1 ELSE 0 END AS starts FROM e WINDOW w AS (PARTITION BY section_id ORDER BY ln)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY section_id ORDER BY ln) AS part FROM b),
t AS (SELECT section_id, part, trim(string_agg(CASE WHEN num AND starts = 1 THEN regexp_replace(line, '^([0-9]+|[IVXLCDM]+)[.)] ', '') ELSE line END, ' ' ORDER BY ln)) AS content FROM g GROUP BY 1, 2)
SELECT section_id AS doc_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY part) - 1 AS INTEGER) AS part_no, content FROM t WHERE length(content) >= 3""",
)
_PHRASES = ["The", "Of", "Les", "Der"]
add(
    "f17_split_on_phrases",
    lambda t: t.documents.select("doc_id", F.posexplode(S.split_on_phrases("text", _PHRASES)).alias("part_no", "content")),
    "passages",
    f"""WITH r AS (SELECT section_id, line_no, content, sum(CASE WHEN regexp_matches(content, '^(The|Of|Les|Der)') THEN 1 ELSE 0 END)
  OVER (PARTITION BY section_id ORDER BY line_no) AS part FROM passages),
t AS (SELECT section_id, part, nullif(trim(regexp_replace(string_agg(content, ' ' ORDER BY line_no), '\\s+', ' ', 'g')), '') AS content FROM r GROUP BY 1, 2)
SELECT section_id AS doc_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY part) - 1 AS INTEGER) AS part_no, content FROM t WHERE content IS NOT NULL""",
)
add(
    "f18_expected_headings",
    lambda t: t.documents.select(
        "doc_id",
        F.explode(
            S.expected_headings(
                F.transform(F.split("text", "\\n"), lambda x: F.concat((F.length(x) % 9 + 1).cast("string"), F.lit(". "), x)), "^(\\d{1,2})\\.", 81
            )
        ).alias("h"),
    ).select("doc_id", "h.number", "h.index"),
    "passages",
    """WITH RECURSIVE c AS (SELECT section_id, line_no, length(content) % 9 + 1 AS number FROM passages),
w AS (SELECT DISTINCT section_id, CAST(0 AS BIGINT) AS number, CAST(-1 AS BIGINT) AS pos FROM c
  UNION ALL
  SELECT w.section_id, w.number + 1, (SELECT min(c.line_no) FROM c WHERE c.section_id = w.section_id AND c.number = w.number + 1 AND c.line_no > w.pos)
  FROM w WHERE w.pos IS NOT NULL AND w.number < 81)
SELECT section_id AS doc_id, CAST(number AS INTEGER) AS number, CAST(pos AS INTEGER) AS index FROM w WHERE number > 0 AND pos IS NOT NULL""",
)
