"""Conversation log: lists, search, status, analytics and updates.

Tables: conversations (conversation_id, user_id, title, created_at, updated_at)
and messages (message_id, conversation_id, role, content, routing, metadata,
created_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from insight_spark.functions import fixed_values as fv
from insight_spark.functions.text import title_from_first_message
from insight_spark.operators.relational import join_left_count, keep_latest, latest_n


def conversation_create(requests: DataFrame) -> DataFrame:
    """New conversations from (conversation_id, user_id, title, created_at) requests."""
    return requests.select(
        "conversation_id", "user_id", F.coalesce("title", F.lit("New Chat")).alias("title"),
        "created_at", F.col("created_at").alias("updated_at"),
    )


def message_append(conversations: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) after appending ``new`` messages.

    A conversation takes the time of its newest message; "New Chat" becomes the
    first fifty characters of the earliest new one. The new messages are
    aggregated before the join, so a busy conversation stays cheap.
    """
    seen = new.groupBy("conversation_id").agg(
        F.max("created_at").alias("_last"),
        F.min(F.struct("created_at", "message_id", "content")).alias("_first"),
    )
    updated = conversations.join(seen, "conversation_id", "left").select(
        "conversation_id",
        "user_id",
        F.when(F.col("_first").isNotNull(), title_from_first_message(F.col("title"), F.col("_first.content")))
        .otherwise(F.col("title"))
        .alias("title"),
        "created_at",
        F.greatest("updated_at", "_last").alias("updated_at"),
    )
    return updated, messages.unionByName(new)


def newest_versions(versions: DataFrame) -> DataFrame:
    """Current conversations from an append-only file of versions."""
    others = [c for c in versions.columns if c not in ("conversation_id", "updated_at")]
    return keep_latest(versions, ["conversation_id"], ["updated_at"], others).select(*versions.columns)


def conversation_get(
    conversations: DataFrame, messages: DataFrame, order: list[str], limit: int = fv.LISTED_MESSAGES
) -> DataFrame:
    """Each given conversation with its first messages in time order."""
    window = Window.partitionBy("conversation_id").orderBy(*order)
    first = messages.withColumn("message_no", F.row_number().over(window)).filter(F.col("message_no") <= limit)
    return conversations.join(first, "conversation_id")


def conversation_list(
    conversations: DataFrame, messages: DataFrame, user_id: str | None = None, limit: int = fv.LISTED_CONVERSATIONS
) -> DataFrame:
    """A user's conversations with message counts, newest first."""
    mine = conversations if user_id is None else conversations.filter(F.col("user_id") == user_id)
    return join_left_count(
        mine, messages, "conversation_id", "conversation_id",
        [F.desc("updated_at"), F.col("conversation_id")], limit,
    )


def conversation_search(
    conversations: DataFrame, messages: DataFrame, needle: str, user_id: str | None = None,
    limit: int = fv.LISTED_CONVERSATIONS,
) -> DataFrame:
    """Conversations with a message that contains ``needle`` in any case, newest first."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    mine = conversations if user_id is None else conversations.filter(F.col("user_id") == user_id)
    hits = messages.filter(F.col("content").ilike(f"%{escaped}%")).select("conversation_id")
    return (
        mine.join(hits, "conversation_id", "left_semi")
        .select("conversation_id", "title", "updated_at")
        .orderBy(F.desc("updated_at"), "conversation_id")
        .limit(limit)
    )


def conversation_delete(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations in ``gone``."""
    ids = gone.select("conversation_id")
    return (
        conversations.join(ids, "conversation_id", "left_anti"),
        messages.join(ids, "conversation_id", "left_anti"),
    )


def cached_messages(messages: DataFrame, order: list[Column], n: int = fv.CACHED_MESSAGES) -> DataFrame:
    return latest_n(messages, ["conversation_id"], order, n)


def user_analytics(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Per user: number of conversations and of messages."""
    per_conversation = messages.groupBy("conversation_id").agg(F.count("*").alias("_m"))
    return (
        conversations.join(per_conversation, "conversation_id", "left")
        .groupBy("user_id")
        .agg(
            F.count("*").alias("total_conversations"),
            F.coalesce(F.sum("_m"), F.lit(0)).alias("total_messages"),
        )
    )


def routing_breakdown(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages per user and routing; messages without routing are left out.

    Counting per conversation first keeps the join small.
    """
    counts = (
        messages.filter(F.col("routing").isNotNull())
        .groupBy("conversation_id", "routing")
        .agg(F.count("*").alias("_m"))
    )
    return (
        counts.join(conversations.select("conversation_id", "user_id"), "conversation_id")
        .groupBy("user_id", "routing")
        .agg(F.sum("_m").alias("messages"))
    )


def session_status(conversations: DataFrame, chunks: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Per conversation: files, tables, document and vector counts, ready flags.

    ``chunks`` is (conversation_id, source, source_type, ...); files are counted
    on the distinct (conversation, source) pairs.
    """
    files = (
        chunks.groupBy("conversation_id", "source", "source_type")
        .agg(F.count("*").alias("_chunks"))
        .groupBy("conversation_id")
        .agg(
            F.count_distinct("source").alias("total_documents"),
            F.sum("_chunks").alias("total_vectors"),
            F.bool_or(F.col("source_type") == "csv").alias("has_csv"),
        )
    )
    out = conversations.join(files, "conversation_id", "left").fillna(
        {"total_documents": 0, "total_vectors": 0, "has_csv": False}
    )
    if tables is not None:
        counts = tables.groupBy("conversation_id").agg(F.count("*").alias("csv_tables"))
        out = out.join(counts, "conversation_id", "left").fillna({"csv_tables": 0})
    return out.withColumn(
        "status", F.when(F.col("total_vectors") > 0, F.lit("active")).otherwise(F.lit("idle"))
    ).withColumn("vectorstore_ready", F.col("total_vectors") > 0)


def session_stats(status: DataFrame) -> DataFrame:
    """All sessions, active sessions, and vectors."""
    return status.agg(
        F.count("*").alias("total_sessions"),
        F.count_if(F.col("status") == "active").alias("active_sessions"),
        F.coalesce(F.sum("total_vectors"), F.lit(0)).alias("total_vectors"),
    )
