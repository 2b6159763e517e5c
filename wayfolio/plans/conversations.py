"""Question and answer history of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfolio.functions.text import filled, trim_space
from wayfolio.operators.ordered import first_per_key

# Message length and history sizes of the three callers.
MESSAGE_LIMIT = 4000
ROUTE_TURNS = 12
GUIDE_TURNS = 10
ASSISTANT_TURNS = 8


def qa_pairs(messages: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """First question of each conversation and the first answer at or after it; incomplete ones drop out.

    A title stored in ``conversations`` (conv_id, title) wins over the one made of the question.

    Two combined aggregates with an equi-join between them, so a very long conversation is
    never gathered in one place.
    """
    asked = messages.filter("role = 'user'").groupBy("conv_id").agg(
        F.min_by("content", "turn").alias("question"), F.min("turn").alias("question_turn")
    )
    after = messages.filter("role = 'assistant'").join(asked.select("conv_id", "question_turn"), "conv_id")
    answered = after.filter("turn >= question_turn").groupBy("conv_id").agg(
        F.min_by("content", "turn").alias("answer"), F.min("turn").alias("answer_turn")
    )
    pairs = asked.join(answered, "conv_id")
    if conversations is not None:
        titles = conversations.groupBy("conv_id").agg(F.min(filled("title")).alias("_title"))
        pairs = pairs.join(titles, "conv_id", "left")
    else:
        pairs = pairs.withColumn("_title", F.lit(None).cast("string"))
    title = F.coalesce("_title", filled(F.substring("question", 1, 70)), F.lit("AI question"))
    return pairs.select(
        "conv_id", title.alias("title"), "question", "answer", "question_turn", "answer_turn"
    )


def _rendered(messages: DataFrame, line: Column) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct(F.col("turn"), line.alias("line"))))
    texts = F.filter(F.transform(lines, lambda x: x["line"]), lambda x: x != "")
    return messages.groupBy("conv_id").agg(F.array_join(texts, "\n").alias("history"))


def speaker_line() -> Column:
    who = F.when(F.col("role") == "user", F.lit("User: ")).otherwise(F.lit("Assistant: "))
    return F.concat(who, F.col("content"))


def history_tail(messages: DataFrame, turns: int = GUIDE_TURNS) -> DataFrame:
    """The last turns of each conversation as text: known roles only, long messages cut."""
    valid = messages.filter(F.col("role").isin("user", "assistant") & F.col("content").isNotNull())
    cut = valid.withColumn("content", F.substring("content", 1, MESSAGE_LIMIT))
    tail = first_per_key(cut, ["conv_id"], [F.desc("turn")], turns)
    return _rendered(tail, speaker_line())


def assistant_tail(messages: DataFrame, turns: int = ASSISTANT_TURNS) -> DataFrame:
    """The other caller's rule: last turns first, then blank messages go; any other role is the assistant."""
    tail = first_per_key(messages, ["conv_id"], [F.desc("turn")], turns)
    line = F.when(F.coalesce(F.col("content"), F.lit("")) == "", F.lit("")).otherwise(speaker_line())
    return _rendered(tail, line)


def recent_with_messages(conversations: DataFrame, messages: DataFrame, n: int = 50, order: str = "conv_id") -> DataFrame:
    """Messages of the n latest conversations; joined as the optimizer sees fit."""
    latest = conversations.orderBy(F.desc(order)).limit(n).select("conv_id")
    return messages.join(latest, "conv_id", "left_semi").orderBy(F.desc("conv_id"), "turn")


def exchange_rows(exchanges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation rows and message rows to store for answered questions (blank ones are not stored)."""
    from wayfolio.functions.books import default_title

    kept = exchanges.filter(
        F.col("user_id").isNotNull() & (trim_space("question") != "") & (trim_space("answer") != "")
    )
    conversations = kept.select("conv_id", "user_id", default_title("question").alias("title"))
    pair = F.array(
        F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("content")),
    )
    messages = kept.select("conv_id", "user_id", F.inline(pair))
    return conversations, messages
