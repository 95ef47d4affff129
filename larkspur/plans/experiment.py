"""Runs over a set of questions that can be broken off and taken up again, and sweeps over the weight of the prior."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..providers import Message
from ..sources import stores
from . import answer
from .retrieve import Index, nested, retrieve

log = logging.getLogger("larkspur")
Client = Callable[[list[Message]], str]


def retrieval(index: Index, questions: DataFrame, path: str) -> DataFrame:
    """The best passages of every question, as stored at `path` or retrieved and stored now."""
    spark = questions.sparkSession
    if not stores.exists(spark, path):
        stores.write_results(nested(retrieve(index, questions), questions, index.passages), path)
    return stores.read_results(spark, path)


def _parts(rows: DataFrame, every: int | None) -> int:
    return max(1, -(-rows.count() // every)) if every else 1


def completed(rows: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, every: int | None, measure: str) -> DataFrame:
    """`rows` put through `step` in parts of about `every` rows, each stored when it is done; stored parts are not done again.

    A part is a hash range of the rows, so a later run has the same parts. Logs the running mean of `measure`.
    """
    spark, n = rows.sparkSession, _parts(rows, every)
    key = F.xxhash64("question", "gold_answer")
    done, total = 0, 0.0
    for i in range(n):
        at = f"{path}/part={n}-{i:06d}"
        if not stores.exists(spark, at):
            stores.write_results(step(rows.where(F.pmod(key, F.lit(n)) == i)), at)
        some, value = stores.read_results(spark, at, stores.PREDICTIONS).agg(F.count("*"), F.sum(F.coalesce(F.col(measure).cast("double"), F.lit(0.0)))).first()
        done, total = done + some, total + (value or 0.0)
        if done:
            log.info("%s: %d rows, mean of %s %.4f", path, done, measure, total / done)
    return spark.read.schema(stores.PREDICTIONS).json([f"{path}/part={n}-{i:06d}" for i in range(n)])


def experiment(index: Index, questions: DataFrame, path: str, client: Client, judge: Client, every: int | None = None, rounds: tuple[int, int] = (6, 10)) -> DataFrame:
    """The summary of one run. An evaluated run is read, a retrieved one goes on with its answers, a half answered one with the rest."""
    spark = questions.sparkSession
    if stores.exists(spark, f"{path}/evaluation"):
        return stores.read_evaluation(spark, f"{path}/evaluation")
    found = retrieval(index, questions, f"{path}/retrieval")

    def step(part: DataFrame) -> DataFrame:
        return answer.judge(answer.answer(part, client, rounds[0]), judge, rounds[1])

    rows = completed(found, step, f"{path}/predictions", every, "llm_accuracy")
    stores.write_results(stores.evaluation_text(answer.summary(rows)), f"{path}/evaluation")
    return stores.read_evaluation(spark, f"{path}/evaluation")


def sweep(index: Index, questions: DataFrame, alphas: list[float], path: str, client: Client, judge: Client, every: int | None = None) -> DataFrame:
    """The ledger of runs by weight, in the order of weights. Weights with a score are skipped, a failing run leaves a row without one."""
    spark = questions.sparkSession
    grid = spark.createDataFrame([(float(a),) for a in alphas], "alpha double")
    for r in answer.pending_alphas(grid, stores.read_ledger(spark, f"{path}/ledger")).orderBy("alpha").collect():  # a handful of weights
        at = f"{path}/alpha_{r['alpha']:.2f}"
        try:
            got = experiment(Index(index.passages, index.ner, index.entity_vectors, replace(index.config, alpha=r["alpha"]), index.encode, index.tagger, index.store), questions, at, client, judge, every).first()
            row = (r["alpha"], index.config.partners, got["llm_accuracy"], got["contain_accuracy"], at)
        except Exception:
            log.exception("weight %.2f failed", r["alpha"])
            row = (r["alpha"], index.config.partners, None, None, at)
        stores.append_ledger(spark.createDataFrame([row], stores.LEDGER), f"{path}/ledger")
    return latest(stores.read_ledger(spark, f"{path}/ledger"))


def latest(ledger: DataFrame) -> DataFrame:
    """One row a weight, one with a score before one without, by weight."""
    best = F.max_by(F.struct(*ledger.columns), F.struct(F.coalesce("EM", F.lit(-1.0)), F.coalesce("Contain_Acc", F.lit(-1.0)), "result_dir"))
    return ledger.groupBy(F.round("cooccur_alpha", 2).alias("at")).agg(best.alias("r")).select("r.*").orderBy("cooccur_alpha")


def continued(spark: SparkSession, root: str, prefix: str, path: str) -> bool:
    """Starts the run at `path` with the retrieval of the latest earlier one under `root`; false if there is none."""
    if stores.exists(spark, f"{path}/retrieval"):
        return True
    earlier = [p for p in stores.find_runs(spark, root, prefix, "retrieval") if p != path]
    if earlier:
        stores.copy_table(spark, f"{earlier[0]}/retrieval", f"{path}/retrieval")
    return bool(earlier)
