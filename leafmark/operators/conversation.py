"""Conversation operators: turns grouped, flagged and weighed, within each conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark import config as C
from leafmark.functions import text as T


def turn_flags(turns: DataFrame) -> DataFrame:
    """page_id, turn, role, words and a boolean for each flag."""
    base = turns.select(F.col("conv_id").alias("page_id"), F.col("turn").cast("long").alias("turn"), "role", "text", T.count_words(F.col("text")).alias("words"), F.coalesce(F.col("text").contains(C.CODE_BLOCK), F.lit(False)).alias("has_code"))
    flagged = base.select("*", *(T.has(F.col("text"), p).alias(n) for n, p in C.TURN_FLAGS))
    short = (F.col("role") == "assistant") & (F.col("words") <= 18) & F.lower(F.coalesce("text", F.lit(""))).rlike(C.SHORT_CONFIRMATION)
    flagged = flagged.withColumn("is_short", F.coalesce(short, F.lit(False)))
    evidence = F.col("has_final_answer") | F.col("has_revision") | F.col("has_summary") | F.col("has_recommendation") | F.col("has_key_explanation") | F.col("has_code") | (F.col("words") >= 45)
    complete = (F.col("role") == "assistant") & ~F.col("has_failed_answer") & ~F.col("is_short") & (F.col("words") >= 24) & evidence
    return flagged.withColumn("is_complete", F.coalesce(complete, F.lit(False)))


def with_last_turns(flagged: DataFrame) -> DataFrame:
    """Adds last_mine and last_user: the last turns of the assistant and of the user (-1 for none) in each conversation."""
    conv = Window.partitionBy("page_id")
    last = lambda role: F.max(F.when(F.col("role") == role, F.col("turn"))).over(conv)
    return flagged.withColumn("last_mine", last("assistant")).withColumn("last_user", F.coalesce(last("user"), F.lit(-1)))


def turn_priorities(turns: DataFrame) -> DataFrame:
    """page_id, turn, superseded, priority (0 to 88) of the assistant's turns: one window by conversation."""
    conv = Window.partitionBy("page_id")
    f = turn_flags(turns)
    mine = F.col("role") == "assistant"
    last = lambda cond, value="turn": F.max(F.when(cond, F.col(value))).over(conv)
    f = f.withColumn("last_mine", last(mine)).withColumn("last_user", F.coalesce(last(F.col("role") == "user"), F.lit(-1)))
    f = f.withColumn("failed", F.coalesce(last(mine & F.col("has_failed_answer")), F.lit(-1))).withColumn("authority", F.coalesce(last(mine & (F.col("has_revision") | F.col("has_final_answer") | F.col("is_complete"))), F.lit(-1)))
    f = f.withColumn("corrected", F.coalesce(F.max(F.when((F.col("role") == "user") & (F.col("turn") == F.col("last_user")), T.has(F.col("text"), C.CORRECTION).cast("int"))).over(conv), F.lit(0)) == 1).filter(mine)
    latest, answers = F.col("turn") == F.col("last_mine"), (F.col("last_user") > -1) & (F.col("turn") > F.col("last_user"))
    superseded = (F.col("authority") > -1) & (F.col("turn") < F.col("authority"))
    revised = F.col("has_revision") | (answers & F.col("corrected"))
    replaces = F.col("is_complete") & (F.col("failed") > -1) & (F.col("turn") > F.col("failed"))
    weights = [
        (latest, 28), (answers, 30), (answers & F.col("corrected"), 26), (~answers & (F.col("last_user") > F.col("turn")) & ~latest, -18), (revised, 34), (F.col("has_final_answer"), 32), (latest & F.col("is_complete"), 24), (replaces, 24), (F.col("has_summary"), 18),
        (F.col("has_recommendation") & (F.col("has_final_answer") | latest), 22), (F.col("has_key_explanation"), 12), (F.col("has_code"), 14), (F.col("has_hedged_draft"), -24), (F.col("has_failed_answer"), -56), (F.col("is_short"), -44), (superseded, -42),
    ]
    total = sum((F.when(c, w).otherwise(0) for c, w in weights), F.lit(18))
    return f.select("page_id", "turn", superseded.alias("superseded"), F.least(F.lit(88), F.greatest(F.lit(0), total)).cast("long").alias("priority"))


def role_alternation(turns: DataFrame) -> DataFrame:
    """page_id, turns, changes: how often the role differs from the turn before."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("change", (F.col("role") != before).cast("int")).groupBy(F.col("conv_id").alias("page_id")).agg(F.count(F.lit(1)).alias("turns"), F.coalesce(F.sum("change"), F.lit(0)).alias("changes"))


def latest_of_role(turns: DataFrame, k: int = 1) -> DataFrame:
    """The k latest turns of each role in each conversation."""
    rank = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("turn")))
    return turns.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("conv_id").alias("page_id"), "role", F.col("turn").cast("long").alias("turn"), F.col("rank").cast("long").alias("rank"))


def sampled_turns(turns: DataFrame, head: int = C.HEAD_MESSAGES, middle: int = C.MIDDLE_MESSAGES, tail: int = C.TAIL_MESSAGES, most: int = C.MAX_MESSAGES) -> DataFrame:
    """Conversations longer than `most` keep their first, last and last strong middle turns; others keep all."""
    page = Window.partitionBy("conv_id")
    placed = turns.withColumn("n", F.count(F.lit(1)).over(page)).withColumn("up", F.row_number().over(page.orderBy("turn"))).withColumn("down", F.row_number().over(page.orderBy(F.desc("turn"))))
    ends = (F.col("n") <= most) | (F.col("up") <= head) | (F.col("down") <= tail)
    strong = ~ends & (F.col("role") == "assistant") & (T.has(F.col("text"), C.STRONG_MIDDLE) | F.coalesce(F.col("text").contains(C.CODE_BLOCK), F.lit(False)))
    placed = placed.withColumn("ends", ends).withColumn("strong", strong).withColumn("strong_rank", F.sum(F.col("strong").cast("int")).over(page.orderBy(F.desc("turn"))))
    return placed.filter(F.col("ends") | (F.col("strong") & (F.col("strong_rank") <= middle))).select(F.col("conv_id").alias("page_id"), F.col("turn").cast("long").alias("turn"), "role")


def turn_groups(turns: DataFrame) -> DataFrame:
    """Neighbouring turns of one role merged: page_id, turn (first), role, words, merged. Turns lie 800 apart, so two
    are merged if one of them has fewer than 80 words; the fold runs over each conversation's ordered turns."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), "role", T.count_words(F.col("text")).alias("words"))
    listed = turns.groupBy(F.col("conv_id").alias("page_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    kind = "array<struct<turn:bigint,role:string,words:bigint,merged:bigint,last:bigint>>"

    def step(a: Column, t: Column) -> Column:
        p = F.try_element_at(a, F.lit(-1))
        gap = (t["turn"] - p["last"]) * 800
        joins = (p["role"] == t["role"]) & gap.between(0, 900) & ~((p["words"] > 260) & (t["words"] > 220)) & ((gap <= 360) | (p["words"] < 80) | (t["words"] < 80))
        grown = F.struct(p["turn"].alias("turn"), p["role"].alias("role"), (p["words"] + t["words"]).alias("words"), (p["merged"] + 1).alias("merged"), t["turn"].alias("last"))
        new = F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["words"].alias("words"), F.lit(1).cast("long").alias("merged"), t["turn"].alias("last"))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1)), F.array(grown))).otherwise(F.concat(a, F.array(new)))

    folded = listed.select("page_id", F.explode(F.aggregate("turns", F.array().cast(kind), step)).alias("g"))
    return folded.select("page_id", "g.turn", "g.role", "g.words", "g.merged")
