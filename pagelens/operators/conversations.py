"""Conversations, messages and the sources they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions.questions import cited_numbers
from pagelens.operators.spread import number_rows


def append_messages(
    messages: DataFrame, new: DataFrame, conversations: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Messages with the new ones, and conversations touched at their newest message."""
    touched = new.groupBy("conversation_id").agg(F.max("sent_at").alias("_sent"))
    updated = (
        conversations.join(touched, "conversation_id", "left")
        .withColumn("updated_at", F.greatest("updated_at", "_sent"))
        .drop("_sent")
    )
    return messages.unionByName(new), updated


def transcript(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of known conversations with their position."""
    known = messages.join(conversations.select("conversation_id", "title"), "conversation_id")
    return number_rows(
        known.withColumn("_hour", F.date_trunc("HOUR", "sent_at")),
        ["conversation_id"], "_hour", [F.col("sent_at"), F.col("message_id")], "position",
    ).drop("_hour")


def recent_conversations(conversations: DataFrame, k: int = 20) -> DataFrame:
    return conversations.orderBy(F.col("updated_at").desc(), F.col("conversation_id")).limit(k)


def delete_conversations(
    conversations: DataFrame, messages: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the listed conversations."""
    gone = ids.select("conversation_id").distinct()
    return (
        conversations.join(gone, "conversation_id", "left_anti"),
        messages.join(gone, "conversation_id", "left_anti"),
    )


def resolve_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Source of each ``[n]`` marker in ``answers(answer_id, text)``; unknown numbers drop out.

    ``sources(answer_id, n, ...)`` numbers each answer's sources from 1.
    """
    cited = answers.select(
        "answer_id", F.posexplode(cited_numbers(F.col("text"))).alias("position", "n")
    )
    return cited.join(sources, ["answer_id", "n"])


def citation_ledger(messages: DataFrame) -> DataFrame:
    """How often each source chunk was cited by assistant messages."""
    cited = messages.filter("role = 'assistant'").select(
        "conversation_id", F.explode("cited").alias("c")
    )
    return cited.groupBy(
        F.col("c.chunk_id").alias("chunk_id"), F.col("c.url").alias("url")
    ).agg(F.count("*").alias("citations"))
