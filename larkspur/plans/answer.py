"""Answering, judging, retrying and summing up; sweeps over the weight of the prior."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chat_messages, contains_gold, extract_answer, has_flag, judge_verdict
from ..providers import Message, infer
from ..session import cut

ANSWER_FLAGS = ("LLM request failed",)
JUDGE_FLAGS = ("llm request failed", "error_answer")
SYSTEM = "Read the passages, reason after `Thought:`, and give the result after `Answer:`."
JUDGE_SYSTEM = "Decide whether the given answer agrees with the reference. Say only correct or incorrect."


def pending(predictions: DataFrame) -> DataFrame:
    """Rows without an answer yet: a missing value means not produced."""
    return predictions.where("pred_answer IS NULL")


def failed(predictions: DataFrame, column: str, flags: tuple[str, ...]) -> DataFrame:
    return predictions.where(has_flag(F.col(column), flags))


def _again(rows: DataFrame, todo, step: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """Runs `step` on the rows that need it, a bounded number of rounds; finished rows are not touched."""
    for _ in range(rounds):
        rows = cut(rows)
        open_rows = rows.where(todo)
        if open_rows.isEmpty():
            break
        rows = rows.where(~todo).unionByName(step(open_rows))
    return rows


def answer(retrieved: DataFrame, client: Callable[[list[Message]], str], rounds: int = 6, workers: int = 8) -> DataFrame:
    """Adds or completes ``pred_answer``; failed answers are asked again."""
    rows = retrieved if "pred_answer" in retrieved.columns else retrieved.withColumn("pred_answer", F.lit(None).cast("string"))
    todo = F.col("pred_answer").isNull() | has_flag(F.col("pred_answer"), ANSWER_FLAGS)

    def step(part: DataFrame) -> DataFrame:
        asked = part.withColumn("messages", chat_messages(SYSTEM, F.coalesce("sorted_passage", F.array().cast("array<string>")), F.col("question")))
        done = infer(asked, "messages", "raw", client, workers)
        return done.withColumn("pred_answer", extract_answer(F.col("raw"))).select(*rows.columns)

    return _again(rows, todo, step, rounds)


def judge(predictions: DataFrame, client: Callable[[list[Message]], str], rounds: int = 10, workers: int = 8) -> DataFrame:
    """Adds or completes ``llm_judge_answer, llm_accuracy, contain_accuracy``."""
    have = {"llm_judge_answer": "string", "llm_accuracy": "double", "contain_accuracy": "int"}
    rows = predictions
    for c, t in have.items():
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(t))
    todo = F.col("pred_answer").isNotNull() & (F.col("llm_accuracy").isNull() | F.col("contain_accuracy").isNull() | has_flag(F.col("llm_judge_answer"), JUDGE_FLAGS))

    def step(part: DataFrame) -> DataFrame:
        text = F.concat_ws("\n", "question", "pred_answer", "gold_answer")
        chat = F.array(F.struct(F.lit("system").alias("role"), F.lit(JUDGE_SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), text.alias("content")))
        done = infer(part.withColumn("messages", chat), "messages", "raw", client, workers)
        score, kept = judge_verdict(F.col("raw"))
        return done.withColumns({"llm_judge_answer": kept, "llm_accuracy": score, "contain_accuracy": contains_gold(F.col("pred_answer"), F.col("gold_answer"))}).select(*rows.columns)

    return _again(rows, todo, step, rounds)


def summary(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean accuracies in percent; NULL over no rows."""
    return predictions.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"), F.round(F.avg("llm_accuracy") * 100, 6).alias("llm_accuracy"), F.round(F.avg("contain_accuracy") * 100, 6).alias("contain_accuracy")
    )


def pending_alphas(grid: DataFrame, ledger: DataFrame) -> DataFrame:
    """Weights whose run is not in the ledger; a failed run has no score and counts as open."""
    done = ledger.where("EM IS NOT NULL").select(F.round("cooccur_alpha", 2).alias("alpha")).distinct()
    return grid.select(F.round("alpha", 2).alias("alpha")).join(done, "alpha", "left_anti")


def best_run(ledger: DataFrame) -> DataFrame:
    """The run of the best score; the smallest weight wins ties."""
    ok = ledger.where("EM IS NOT NULL AND Contain_Acc IS NOT NULL")
    best = ok.groupBy().agg(F.max_by(F.struct(*ledger.columns), F.struct("EM", -F.col("cooccur_alpha"))).alias("r"))
    return best.where("r IS NOT NULL").select("r.*")
