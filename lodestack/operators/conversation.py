"""Operators on conversations: messages of threads in order of ``pos``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled, token_estimate

THREAD = "thread_id"


def with_cost(messages: DataFrame) -> DataFrame:
    """Estimated tokens of each message, four for its role; system messages are free."""
    return messages.withColumn("cost", F.when(F.col("role") == "system", 0).otherwise(token_estimate(F.col("content")) + 4))


def kept_from(messages: DataFrame, budget: int) -> DataFrame:
    """(thread_id, keep_from): the first position of the newest whole turns whose cost fits the budget, one turn at least.

    A turn starts with a user message; what stands before the first is not kept.
    """
    w = Window.partitionBy(THREAD).orderBy("pos")
    rows = with_cost(messages.filter("role <> 'system'")).withColumn("turn", F.count_if(F.col("role") == "user").over(w))
    spans = rows.filter("turn > 0").groupBy(THREAD, "turn").agg(F.min("pos").alias("start"), F.sum("cost").alias("cost"))
    back = Window.partitionBy(THREAD).orderBy(F.desc("turn"))
    sums = spans.withColumns({"total": F.sum("cost").over(back), "last": F.row_number().over(back)})
    return sums.filter((F.col("total") <= budget) | (F.col("last") == 1)).groupBy(THREAD).agg(F.min("start").alias("keep_from"))


def recent(messages: DataFrame, after: int = -1, limit: int | None = None, question: Column | None = None) -> DataFrame:
    """The newest ``limit`` non-empty messages of users and assistants after a position.

    ``question``: trailing user messages equal to it are left out.
    """
    rows = messages.filter(F.col("role").isin("user", "assistant") & (F.col("pos") > after) & (F.trim(filled(F.col("content"))) != ""))
    newest = Window.partitionBy(THREAD).orderBy(F.desc("pos"))
    if limit:
        rows = rows.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= limit).drop("__n")
    if question is not None:
        other = ~((F.col("role") == "user") & (F.trim("content") == F.trim(question)))
        rows = rows.withColumn("__later", F.count_if(other).over(newest)).filter("__later > 0").drop("__later")
    return rows


def segments(messages: DataFrame, cursor: Column, tokens: int, rounds: int) -> DataFrame:
    """Per thread: tokens and user turns after the cursor, and whether either is due for a summary."""
    rows = messages.withColumn("cost", token_estimate(F.col("content")) + 4).withColumn("__new", F.col("pos") > cursor)
    out = rows.groupBy(THREAD).agg(F.coalesce(F.sum(F.when(F.col("__new"), F.col("cost"))), F.lit(0)).cast("bigint").alias("tokens"), F.count_if(F.col("__new") & (F.col("role") == "user")).alias("turns"))
    return out.withColumn("due", (F.col("tokens") >= tokens) | (F.col("turns") >= rounds))


def compaction(messages: DataFrame, trigger: int, budget: int, least_text: int = 5) -> DataFrame:
    """(thread_id, keep_from): where each long thread can be cut; null if it can't.

    The cut moves back to an earlier user message while the part before it has a
    tool call without its result, and enough text messages have to remain.
    """

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        thread = pdf["thread_id"].iloc[0]
        users = pdf.index[pdf["role"] == "user"].tolist()
        spot = {i: k for k, i in enumerate(pdf.index)}
        starts = [spot[i] for i in users]
        none = pd.DataFrame({"thread_id": [thread], "keep_from": pd.array([None], "Int32")})
        cost = pdf["cost"].tolist()
        if sum(cost) < trigger or not starts:
            return none
        at, total = starts[-1], 0
        for a, b in zip(starts[::-1], [len(cost), *starts[:0:-1]], strict=True):
            total += sum(cost[a:b])
            if total > budget:
                break
            at = a
        # Calls without their result before each place, in one pass.
        made, answered, due, waiting = set(), set(), [0], 0
        for own, answer in zip(pdf["tool_call_ids"], pdf["tool_call_id"], strict=True):
            for c in own:
                if c not in made:
                    made.add(c)
                    waiting += c not in answered
            if answer and answer not in answered:
                answered.add(answer)
                waiting -= answer in made
            due.append(waiting)
        if at > 0 and due[at]:
            at = next((s for s in reversed(starts) if s < at and (s <= 0 or not due[s])), -1)
        texts = sum(1 for r, c in zip(pdf["role"].tolist()[max(at, 0) :], pdf["content"].tolist()[max(at, 0) :], strict=True) if r in ("user", "assistant") and (c or "").strip())
        if at <= 0 or texts < least_text:
            return none
        return pd.DataFrame({"thread_id": [thread], "keep_from": pd.array([pdf["pos"].iloc[at]], "Int32")})

    rows = with_cost(messages).filter("role <> 'system'").select("thread_id", "pos", "role", "content", "cost", "tool_call_ids", "tool_call_id")
    return rows.groupBy("thread_id").applyInPandas(cut, "thread_id string, keep_from int")
