"""Conversations as roll-ups of their messages. seq breaks ties of created_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TITLE_CHARS, DEFAULT_TITLE = 35, "New Conversation"
SOURCES = "array<struct<file_name:string,document_id:string,file_type:string,page:int,score:double,snippet:string>>"


def title_of(content: Column) -> Column:
    short = F.when(F.length(content) > TITLE_CHARS, F.concat(F.substring(content, 1, TITLE_CHARS), F.lit("..."))).otherwise(content)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit(DEFAULT_TITLE))


def roll_up(messages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(conversation_id, title, created_at, updated_at, n_messages).

    The title is the given one, else the first message's; a default title is replaced by the next user message that
    says something.
    """
    at = F.struct("created_at", "seq")
    first = F.min(F.struct("created_at", "seq", "content"))
    per = messages.groupBy("conversation_id").agg(first.alias("f"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count(F.lit(1)).alias("n_messages"))
    per = per.withColumn("_own", title_of(F.col("f.content")))
    if titles is not None:
        per = per.join(titles.select("conversation_id", F.col("title").alias("_given")), "conversation_id", "left")
    else:
        per = per.withColumn("_given", F.lit(None).cast("string"))
    later = messages.join(per.select("conversation_id", F.col("f.created_at").alias("_at"), F.col("f.seq").alias("_seq"), "_given"), "conversation_id")
    later = later.filter((F.col("role") == "user") & (F.col("content") != "") & (F.col("_given").isNotNull() | (at > F.struct("_at", "_seq"))))
    following = later.groupBy("conversation_id").agg(F.min_by("content", at).alias("_next"))
    start = F.coalesce("_given", "_own")
    title = F.when((start == DEFAULT_TITLE) & F.col("_next").isNotNull(), title_of(F.col("_next"))).otherwise(start)
    return per.join(following, "conversation_id", "left").select("conversation_id", title.alias("title"), "created_at", "updated_at", "n_messages")


def recent(messages: DataFrame, limit: int = 10) -> DataFrame:
    """The latest messages of each conversation, numbered from 1 in the order of time. Spark takes the limit of every task's own
    rows before it shuffles them, so a long conversation is no long task."""
    back = W.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("seq"))
    kept = messages.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= limit)
    return kept.withColumn("n", F.row_number().over(W.partitionBy("conversation_id").orderBy("created_at", "seq"))).drop("_back")


def latest_first(conversations: DataFrame) -> DataFrame:
    return conversations.orderBy(F.desc("updated_at"), "conversation_id")


def parsed_sources(c: Column) -> Column:
    """Sources from their JSON text; an empty array where there are none or the text is no JSON."""
    return F.coalesce(F.from_json(c, SOURCES), F.array().cast(SOURCES))


def with_messages(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """conversations with messages, an array of structs in the order of time."""
    one = F.struct("created_at", "seq", "role", "content", parsed_sources(F.col("sources")).alias("sources"))
    per = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(one)).alias("messages"))
    return conversations.join(per, "conversation_id", "left")


def deleted(conversations: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("conversation_id").distinct()
    return conversations.join(gone, "conversation_id", "left_anti"), messages.join(gone, "conversation_id", "left_anti")
