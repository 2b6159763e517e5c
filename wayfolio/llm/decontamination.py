"""Benchmark decontamination by a positional inverted index over the test vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfolio.llm.common import ascii_lower, stored

WINDOW = 10
#: Rarest terms of a window whose lists are intersected before whole items are looked up.
LISTS = 3
#: Sides with at most so many narrow rows are sent to every executor; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_EDGE = "".join(map(chr, (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))))
#: Stands behind the last word of every document; no word is empty, so it can't meet one.
END = ""


def index_words(text: Column) -> Column:
    """Words of a text: lower-cased runs of digits, ASCII letters and everything beyond ASCII."""
    body = F.btrim(ascii_lower(text), F.lit(_EDGE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SEPARATORS))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (stored, narrow) with a broadcast hint if its counted rows stay below ``most``."""
    return F.broadcast(df) if df.count() <= most else df


def test_items(items: DataFrame, identity: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored (item, item_id, n, at, term), one row per word of an item, and the vocabulary (word, term)."""
    words = stored(
        items.select(F.monotonically_increasing_id().alias("item"), F.col(identity).alias("item_id"),
                     index_words(F.col(text)).alias("words"))
        .select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("at", "word")), "items"
    )
    one_end = words.sparkSession.range(1).select(F.lit(END).alias("word"))
    vocabulary = stored(
        words.select("word").distinct().unionByName(one_end).select("word", F.monotonically_increasing_id().alias("term")), "terms"
    )
    return stored(words.join(vocabulary, "word").drop("word"), "item_terms"), vocabulary


def postings(docs: DataFrame, vocabulary: DataFrame, identity: str = "doc_id", text: str = "text",
             most: int = BROADCAST_ROWS) -> DataFrame:
    """The index, stored: (row, pos, term) for every occurrence of a vocabulary term, in one scan of the texts.

    ``row`` numbers the documents' rows. Each document's end is a posting too, so its ``pos`` is the number of words;
    it alone carries doc_id and ``mark``, a hash of the text.
    """
    words = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(identity).alias("doc_id"), F.xxhash64(text).alias("mark"),
        F.concat(index_words(F.col(text)), F.array(F.lit(END))).alias("words"),
    ).select("row", "doc_id", "mark", F.posexplode("words").alias("pos", "word"))
    found = words.join(small(vocabulary, most), "word")
    at_end = F.col("word") == END
    return stored(
        found.select("row", "pos", "term", F.when(at_end, F.col("doc_id")).alias("doc_id"), F.when(at_end, F.col("mark")).alias("mark"),
                     at_end.alias("is_end")), "postings"
    )


def rarest_terms(item_terms: DataFrame, lists: DataFrame, window: int) -> DataFrame:
    """(item, start, rank, at, term): the words of each window, rarest term in the index first; rank 1..LISTS."""
    counts = lists.groupBy("term").agg(F.count("*").alias("df"))
    known = item_terms.join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ahead = Window.partitionBy("item").orderBy("at").rowsBetween(0, window - 1)
    spans = known.withColumn("words", F.sort_array(F.collect_list(F.struct("df", "at", "term")).over(ahead)))
    complete = F.col("at") <= F.greatest(F.lit(0), F.col("n") - window)
    return spans.filter(complete).select(
        "item", F.col("at").alias("start"), F.posexplode(F.slice("words", 1, LISTS)).alias("rank", "word")
    ).select("item", "start", (F.col("rank") + 1).alias("rank"), "word.at", "word.term")


def phrase_matches(item_terms: DataFrame, index: DataFrame, window: int = WINDOW, most: int = BROADCAST_ROWS) -> DataFrame:
    """Every maximal run of at least ``window`` words (or of a shorter item's all) that an item and a document share.

    Returns stored (row, item_id, first, last), positions of the document. The posting lists of each window's rarest
    terms, shifted by the term's place in the item, are intersected from the rarest on; what is left are diagonals
    (item, row, shift). All other words of these items are then looked up in the lists of these rows.
    """
    lists = index.filter(~F.col("is_end")).select("row", "pos", "term")
    windows = stored(rarest_terms(item_terms, lists, window), "windows")
    shifted = None
    for rank in range(1, LISTS + 1):
        own = windows.filter(F.col("rank") == rank).drop("rank")
        listed = lists.join(small(own, most), "term").select("item", "start", "row", (F.col("pos") - F.col("at")).alias("shift"))
        if shifted is None:
            shifted = listed
            continue
        # a window with fewer words has no list of this rank to be in
        short = windows.groupBy("item", "start").agg(F.max("rank").alias("ranks")).filter(F.col("ranks") < rank)
        key = ["item", "start", "row", "shift"]
        shifted = shifted.join(listed, key, "left_semi").unionByName(
            shifted.join(small(short.drop("ranks"), most), ["item", "start"], "left_semi").select(*key)
        )
    diagonals = stored(shifted.select("item", "row", "shift").distinct(), "diagonals")

    touched = small(stored(diagonals.select("row").distinct(), "touched"), most)
    near = lists.join(touched, "row", "left_semi")
    expected = diagonals.join(small(item_terms, most), "item").withColumn("pos", F.col("shift") + F.col("at")).filter("pos >= 0")
    met = expected.join(near, ["row", "pos", "term"], "left_semi")
    along = Window.partitionBy("item", "row", "shift").orderBy("at")
    runs = met.withColumn("run", F.col("at") - F.row_number().over(along)).groupBy("item", "row", "shift", "run").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("item_id").alias("item_id"), F.first("n").alias("n")
    )
    long_enough = F.col("last") - F.col("first") + 1 >= F.least(F.col("n"), F.lit(window))
    return stored(runs.filter(long_enough).select("row", "item_id", "first", "last"), "matches")


def proximity_matches(item_terms: DataFrame, index: DataFrame, span: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Places where all distinct words of an item lie within ``span`` words of an occurrence of its rarest word.

    Returns (row, item_id, pos), the rarest word's position. For short items, in any order of words. Lists meet by
    blocks of ``span`` positions, never whole documents by whole documents.
    """
    lists = index.filter(~F.col("is_end")).select("row", "pos", "term")
    counts = lists.groupBy("term").agg(F.count("*").alias("df"))
    terms = item_terms.select("item", "item_id", "term").distinct().join(counts, "term", "left")
    terms = stored(terms.withColumn("df", F.coalesce("df", F.lit(0))), "near_terms")
    rarest = terms.groupBy("item").agg(F.min(F.struct("df", "term")).alias("r"), F.count("*").alias("wanted"))
    rarest = stored(rarest.select("item", "wanted", F.col("r.term").alias("term")), "anchors")
    anchors = lists.join(small(rarest, most), "term").select("item", "wanted", "row", F.col("pos").alias("center"))
    block = lambda c: F.floor(F.col(c) / span).cast("long")
    wanted = anchors.join(small(terms.drop("df"), most), "item").withColumn(
        "block", F.explode(F.sequence(block("center") - 1, block("center") + 1))
    )
    held = lists.withColumn("block", block("pos"))
    met = wanted.join(held, ["row", "term", "block"]).filter(F.abs(F.col("pos") - F.col("center")) <= span)
    return (
        met.groupBy("item", "item_id", "row", "center").agg(F.count_distinct("term").alias("seen"), F.first("wanted").alias("wanted"))
        .filter("seen = wanted").select("row", "item_id", F.col("center").alias("pos"))
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, identity: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", most: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, mark, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of ``window`` consecutive words of an item, or of a shorter item as a whole.

    * Null or wordless texts have no words: as documents nothing is hit, as items they match nothing.
    * Rows that repeat an id are judged each by its own text. Items that repeat an id count once.
    * Texts are indexed whole. Other columns are not read. No items or no documents give no hits or no rows.
    * ``mark`` is a hash of the text, with which (doc_id, mark) leads back to the rows.
    """
    item_terms, vocabulary = test_items(items, item, item_text)
    index = postings(docs, vocabulary, identity, text, most)
    matches = phrase_matches(item_terms, index, window, most)
    hit = (
        matches.select("row", F.explode(F.sequence("first", "last")).alias("pos")).distinct()
        .groupBy("row").agg(F.count("*").alias("n_hit"))
    )
    named = matches.select("row", F.col("item_id").cast("string").alias("item")).distinct().groupBy("row").agg(
        F.sort_array(F.collect_list("item")).alias("names"), F.count("*").alias("n_items")
    )
    ends = index.filter("is_end").select("row", "doc_id", "mark", F.col("pos").cast("long").alias("n_words"))
    joined = ends.join(hit, "row", "left").join(named, "row", "left")
    none = F.lit(0).cast("long")
    return joined.select(
        "doc_id", "mark", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.sha2(F.encode(F.coalesce(F.array_join("names", ","), F.lit("")), "UTF-8"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; same columns."""
    bad = stored(contamination(docs, items, identity=identity, text=text).filter("contaminated")
                 .select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct(), "contaminated")
    bad = small(bad)
    same = F.col(f"row.{identity}").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.col(f"row.{text}")) == F.col("bad_mark"))
    return docs.select(F.struct(*docs.columns).alias("row")).join(bad, same, "left_anti").select("row.*")
