"""A stored word index of passages: which passages hold a word first, and which words hold a piece of four letters.

It is written once and refreshed by batches of new sections; lookups read it instead of the passages. Each batch is a folder
of its own, so a repeated batch replaces itself, and keeps the first passages of every word it has; the first ones over all
batches are among these. Files are in ranges of the looked-up column, so that a lookup reads few of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from wayfolio.operators.ordered import first_per_key
from wayfolio.session import materialize

GRAM = 4
#: Sections that are looked through before all others, and rows of one term or word each that may be broadcast.
EARLY, FEW = 16_384, 500_000
ORDER = ["section_id", "line_no"]


@dataclass(frozen=True)
class WordIndex:
    """``postings`` (word, section_id, line_no), at least the first ``limit`` of each word; ``pieces`` (piece, word), rows may repeat."""

    postings: DataFrame
    pieces: DataFrame
    limit: int


def pieces_of(c: Column | str) -> Column:
    """All distinct stretches of GRAM letters."""
    value = F.col(c) if isinstance(c, str) else c
    starts = F.sequence(F.lit(1), F.length(value) - (GRAM - 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(value, i, F.lit(GRAM))))


def words_of(passages: DataFrame) -> DataFrame:
    """(word, section_id, line_no): the distinct words, of GRAM letters or more, of every passage."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(f"[a-z0-9]{{{GRAM},}}"), F.lit(0)))
    return passages.select(F.explode(words).alias("word"), *ORDER)


def _pieces(postings: DataFrame) -> DataFrame:
    return postings.select("word").distinct().select(F.explode(pieces_of("word")).alias("piece"), "word")


def few(df: DataFrame) -> DataFrame:
    """``df``, stored, as a table to broadcast if it has at most FEW rows."""
    kept = materialize(df)
    return F.broadcast(kept) if kept.count() <= FEW else kept


def first_postings(passages: DataFrame, limit: int) -> DataFrame:
    """(word, section_id, line_no): the first ``limit`` passages of each word.

    Words that have as many in the EARLY first sections need no later ones. They are most of a text, so the later passages' words
    are freed of them before the rest is sorted.
    """
    bound = early_bound(passages)
    if bound is None:
        return first_per_key(words_of(passages), ["word"], ORDER, limit)
    # the first sections may lie in one split
    spread = passages.filter(_is_early(bound)).repartition(passages.sparkSession.sparkContext.defaultParallelism, *ORDER)
    early = materialize(first_per_key(words_of(spread), ["word"], ORDER, limit))
    full = few(early.groupBy("word").count().filter(F.col("count") >= limit).select("word"))
    later = words_of(passages.filter(F.col("section_id") > bound)).join(full, "word", "left_anti")
    return first_per_key(early.unionAll(first_per_key(later, ["word"], ORDER, limit)), ["word"], ORDER, limit)


def _is_early(bound) -> Column:
    return F.col("section_id").isNull() | (F.col("section_id") <= bound)


def early_bound(rows: DataFrame):
    """The last of the EARLY first section ids, nulls first; none if there are few more sections than that."""
    first = rows.select("section_id").distinct().orderBy("section_id").limit(EARLY + 1).agg(F.count(F.lit(1)), F.max("section_id")).first()
    return first[1] if first[0] > EARLY else None


def passing_index(passages: DataFrame, limit: int) -> WordIndex:
    """An index for a single lookup; its postings are stored while this is built, so the passages are read once."""
    posted = materialize(first_postings(passages, limit))
    return WordIndex(posted, _pieces(posted), limit)


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").drop("batch")


def add_to_word_index(passages: DataFrame, path: str, batch: str, limit: int) -> None:
    """Writes the passages as one batch of the index at ``path``; the same batch again replaces it."""
    spark = passages.sparkSession
    first = materialize(first_postings(passages, limit))
    target = f"{path}/postings/batch={batch}"
    first.repartitionByRange("word").sortWithinPartitions("word", *ORDER).write.mode("overwrite").parquet(target)
    words = spark.read.parquet(target).select("word").distinct()
    words.select(F.explode(pieces_of("word")).alias("piece"), "word").repartitionByRange("piece", "word").sortWithinPartitions("piece").write.mode(
        "overwrite"
    ).parquet(f"{path}/pieces/batch={batch}")


def read_word_index(spark: SparkSession, path: str, limit: int) -> WordIndex:
    """The index at ``path``, whose batches kept ``limit`` passages of each word."""
    try:
        return WordIndex(_read(spark, path, "postings"), _read(spark, path, "pieces"), limit)
    except AnalysisException as missing:
        raise FileNotFoundError(f"no word index at {path}") from missing


def _rarest_pieces(asked: DataFrame, pieces: DataFrame) -> DataFrame:
    """(term, piece): of each term's pieces the one that the fewest words have."""
    counts = pieces.join(asked.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("words"))
    return asked.join(counts, "piece").groupBy("term").agg(F.min_by("piece", F.struct("words", "piece")).alias("piece"))


def _hits(asked: DataFrame, postings: DataFrame, pieces: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` passages of each term among ``postings``, whose words ``pieces`` has."""
    wanted = few(_rarest_pieces(asked, pieces))
    matches = pieces.join(wanted, "piece").filter(F.contains(F.col("word"), F.col("term"))).select("term", "word").distinct()
    # the first passages of a term are among the first of each word that holds it; a passage may hold several such words
    place = F.dense_rank().over(W.partitionBy("term").orderBy(*ORDER))
    return postings.join(matches, "word").select("term", *ORDER).withColumn("_n", place).filter(F.col("_n") <= limit).drop("_n").distinct()


def lookup(terms: DataFrame, index: WordIndex, limit: int) -> DataFrame:
    """(term, section_id, line_no): the first ``limit`` passages of each term, by section_id and line_no.

    A term (letters and digits, GRAM or more) can only occur inside one word. It is looked for under its rarest piece, so that a
    common one like "tion" brings no words of its own; only pieces that a term has are counted. Terms are first looked for in
    the EARLY first sections. Short ones, which lie in very many words, have all their passages there; only terms that have not
    are looked for among all words.
    """
    if limit > index.limit:
        raise ValueError(f"the index keeps {index.limit} passages a word")
    asked = materialize(terms.select("term", F.explode(pieces_of("term")).alias("piece")))
    bound = early_bound(index.postings)
    if bound is None:
        return _hits(asked, index.postings, index.pieces, limit)
    early = materialize(index.postings.filter(_is_early(bound)))
    found = materialize(_hits(asked, early, _pieces(early), limit))
    settled = found.groupBy("term").count().filter(F.col("count") == limit).select("term")
    rest = _hits(materialize(asked.join(settled, "term", "left_anti")), index.postings, index.pieces, limit)
    return found.join(settled, "term", "left_semi").unionAll(rest)


__all__ = ["GRAM", "ORDER", "WordIndex", "pieces_of", "words_of", "few", "first_postings", "passing_index", "add_to_word_index", "read_word_index", "lookup"]
