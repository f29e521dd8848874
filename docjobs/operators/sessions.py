"""Sessions of a chat: messages of a user that follow one another within a gap, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chat_sessions(messages: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """messages (user_id, id, ts, role, text) plus session, the time of the first message of its session.

    A message opens a session if the user's last one is longer ago than gap. Messages are dealt by user and day, so a user
    with a third of all messages is no single group; what goes from day to day is one row each: the last message and the
    last opening before the day. Messages without a time have no session; null users share one chat.
    """
    rows = messages.withColumns({"ts": F.col("ts").cast("timestamp"), "_day": F.to_date(F.col("ts").cast("timestamp"))})
    own = Window.partitionBy("user_id", "_day").orderBy("ts", "id")
    days = Window.partitionBy("user_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)

    def carried(df: DataFrame, value, name: str) -> DataFrame:
        """df with the greatest value of the user's earlier days."""
        by_day = df.groupBy("user_id", "_day").agg(F.max(value).alias("_most")).select(F.col("user_id").alias("_user"), F.col("_day").alias("_on"), F.max("_most").over(days).alias(name))
        return df.join(by_day, F.col("user_id").eqNullSafe(F.col("_user")) & F.col("_day").eqNullSafe(F.col("_on")), "left").drop("_user", "_on")

    rows = carried(rows, F.col("ts"), "_before").withColumn("_last", F.coalesce(F.lag("ts").over(own), "_before"))
    opens = F.col("_last").isNull() | (F.col("ts") > F.col("_last") + F.expr(f"interval {gap}"))
    rows = carried(rows.withColumn("_opened", F.when(opens, F.col("ts"))), F.col("_opened"), "_open")
    session = F.coalesce(F.max("_opened").over(own), F.col("_open"))
    return rows.withColumn("session", F.when(F.col("ts").isNotNull(), session)).select(*messages.columns, "session")


def session_history(messages: DataFrame, gap: str = "30 minutes", last_n: int | None = None) -> DataFrame:
    """For each user's message, the earlier messages of its session (all, or the last_n): user_id, session, id, input, history.

    Messages without a session have no history.
    """
    frame = Window.partitionBy("user_id", "session", F.when(F.col("session").isNull(), F.col("id"))).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding if last_n is None else -last_n, -1)
    said = chat_sessions(messages, gap).withColumn("history", F.collect_list(F.struct("role", "text")).over(frame))
    return said.filter("role = 'user'").select("user_id", "session", "id", F.col("text").alias("input"), F.when(F.col("session").isNull(), F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.col("history")).alias("history"))


def stream_sessions(messages: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A stream of messages (user_id, id, ts, role, text) -> user_id, session, last, n, messages of each session, once it has closed.

    State is bounded by the watermark: a session leaves it when no message can come any more that would prolong it; messages later than that
    are dropped, as those without a time are.
    """
    timed = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    said = F.array_sort(F.collect_list(F.struct("ts", "id", "role", "text")))
    out = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"), said.alias("messages"))
    return out.select("user_id", F.col("w.start").alias("session"), "last", "n", "messages")
