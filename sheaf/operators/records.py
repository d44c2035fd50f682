"""Statistics of chunks, chats, collections, and checks of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def last_messages(messages: DataFrame, chat: str = "conv_id", order: str = "turn", k: int = 20) -> DataFrame:
    """The last k messages of every chat, oldest first."""
    x = messages.withColumn("back", F.row_number().over(W.partitionBy(chat).orderBy(F.desc(order)))).where(F.col("back") <= k)
    return x.withColumn("place", F.row_number().over(W.partitionBy(chat).orderBy(order))).drop("back")


def model_roles(messages: DataFrame, role: str = "role") -> DataFrame:
    """Roles as a chat model knows them: chatbot is assistant, unknown ones are user (I4)."""
    return messages.withColumn(role, F.when(F.col(role) == "chatbot", "assistant").when(F.col(role).isin("user", "assistant", "system"), F.col(role)).otherwise("user"))


def latest_status(events: DataFrame, key: str, status: str, at: str, tie: str) -> DataFrame:
    """The last status of each key."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(at, tie)).alias("status"), F.max(at).alias("at"))


def not_ingested(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't stored yet, pair by pair."""
    return new.join(stored.select(*keys).distinct(), keys, "left_anti")


def name_conflicts(rows: DataFrame, owner: str, name: str) -> DataFrame:
    """Names that an owner has more than once."""
    return rows.groupBy(owner, name).agg(F.count("*").alias("n")).where("n > 1")


def retrieval_quality(ranked: DataFrame, truth: DataFrame, text: str = "text", k: int = 10) -> DataFrame:
    """(questions, hit_rate, mrr): whether the truth stands verbatim in a retrieved context, and how far up."""
    hit = ranked.join(truth, "q_id").where(F.contains(F.col(text), F.col("truth"))).groupBy("q_id").agg(F.min("rank").alias("r"))
    x = truth.select("q_id").join(hit, "q_id", "left")
    return x.agg(F.count("*").alias("questions"), F.round(F.avg(F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0))), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def chosen_collections(chats: DataFrame, asked: DataFrame, known: DataFrame, chat: str = "conv_id", name: str = "collection") -> DataFrame:
    """(chat, name): the collections asked for that exist, or all of them for chats that ask for none."""
    none = chats.select(chat).distinct().join(asked.select(chat), chat, "left_anti")
    return asked.select(chat, name).distinct().join(known.select(name), name, "left_semi").select(chat, name).unionByName(none.crossJoin(known.select(name).distinct()))


def history(messages: DataFrame, chat: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages of every chat with their place, oldest first."""
    return messages.withColumn("place", F.row_number().over(W.partitionBy(chat).orderBy(order)))
