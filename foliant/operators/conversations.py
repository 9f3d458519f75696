"""Turns, orderings, tool budgets and traces of recorded conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CALLS, MAX_ESCALATIONS, MIN_EVIDENCE, MAX_ROUNDS = 8, 1, 1, 10


def turns(messages: DataFrame) -> DataFrame:
    """Each user message with the assistant message right after it; unanswered ones are pending. A window within a conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = messages.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    answer = F.when(F.col("next_role") == "assistant", F.col("next_text"))
    return after.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), answer.alias("answer"), F.when(answer.isNotNull(), "complete").otherwise("pending").alias("state"))


def by_book(conversations: DataFrame, title: str) -> DataFrame:
    """A book's conversations, newest first."""
    return conversations.where(F.col("book_title") == title).orderBy(F.desc("updated_ts"), "conv_id")


def library_order(books: DataFrame) -> DataFrame:
    """Opened books by last opening, then the others by import, newest first."""
    return books.orderBy(F.desc_nulls_last("last_opened_ts"), F.desc("import_ts"), "book_id")


def numbered(ordered: DataFrame, name: str = "place") -> DataFrame:
    """Rows of an ordered table with their place from 1: only the sizes of the sorted parts reach the driver, and no task has all rows."""
    from ..plans.scratch import written

    kept = written(ordered.withColumn("__id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__id", 33)
    before, parts = 0, []
    for p, n in sorted(kept.groupBy(part.alias("p")).count().collect()):
        parts += [F.lit(p), F.lit(before - (p << 33) + 1)]
        before += n
    at = F.create_map(*parts)[part] if parts else F.lit(0)
    return kept.withColumn(name, (F.col("__id") + at).cast("int")).drop("__id")


def trace_time(steps: DataFrame) -> DataFrame:
    """Seconds of each trace's model and tool steps; user and assistant steps take none."""
    counted = F.when(F.col("kind").isin("llm", "tool"), F.coalesce(F.col("exec_time"), F.lit(0.0))).otherwise(0.0)
    return steps.groupBy("trace_id").agg(F.round(F.sum(counted), 6).alias("seconds"), F.count("*").alias("n_steps"), F.count_if(F.col("kind") == "tool").alias("n_tools"))


def budget(calls: DataFrame, most: int = MAX_CALLS) -> DataFrame:
    """Tool calls (question_id, seq, result) in order: which are allowed, and whether each is evidence by its text."""
    n = F.row_number().over(Window.partitionBy("question_id").orderBy("seq"))
    evidence = ~(F.col("result").contains("No matches") | F.col("result").contains("not found"))
    return calls.withColumn("n", n).withColumn("allowed", F.col("n") <= most).withColumn("evidence", F.col("allowed") & F.coalesce(evidence, F.lit(False)))


def budget_summary(calls: DataFrame, most: int = MAX_CALLS) -> DataFrame:
    b = budget(calls, most)
    return b.groupBy("question_id").agg(F.count_if("allowed").alias("n_allowed"), F.count_if(~F.col("allowed")).alias("n_refused"), F.count_if("evidence").alias("n_evidence"), (F.count_if("evidence") >= MIN_EVIDENCE).alias("grounded"))


def guarded(calls: DataFrame, most: int = MAX_CALLS, escalations: int = MAX_ESCALATIONS, rounds: int = MAX_ROUNDS) -> DataFrame:
    """calls (question_id, seq, round, escalates) in order, with allowed and why one is refused: round, escalation or budget.

    A round after the last allowed one is refused, and so is an escalation (a call that widens the scope from a chapter to its book) after the last allowed one; neither uses up the budget of calls.
    """
    w = Window.partitionBy("question_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    late = F.coalesce(F.col("round"), F.lit(1)) > rounds
    widens = F.coalesce(F.col("escalates"), F.lit(False)) & ~late
    asked = calls.withColumn("__n", F.sum(F.when(widens, 1).otherwise(0)).over(w)).withColumn("__open", ~late & ~(widens & (F.col("__n") > escalations)))
    counted = asked.withColumn("__used", F.sum(F.when(F.col("__open"), 1).otherwise(0)).over(w))
    why = F.when(late, "round").when(~F.col("__open"), "escalation").when(F.col("__used") > most, "budget")
    return counted.select(*calls.columns, why.isNull().alias("allowed"), why.alias("refused"))
