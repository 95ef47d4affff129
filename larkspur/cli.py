"""Command line: ``python -m larkspur.cli {index,retrieve,run,sweep} ...``. Settings not given here come from LARKSPUR_ variables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import Config
from .functions.text import alpha_grid
from .plans import corpus, experiment
from .providers import ChatClient
from .session import log_to
from .sources.stores import read_chunks, read_questions


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larkspur", description="Corpus-graph retrieval on Spark.")
    p.add_argument("job", choices=("index", "retrieve", "run", "sweep"))
    p.add_argument("--corpus", required=True, help="folder of the stores")
    p.add_argument("--chunks", help="JSON array of texts to take in (index)")
    p.add_argument("--questions", help="JSON array of questions and answers")
    p.add_argument("--results", help="folder of the results")
    p.add_argument("--alphas", help="comma-separated weights (sweep); 0.00 to 1.00 by 0.05 without it")
    p.add_argument("--save-every", type=int, default=None, help="rows after which answers are stored")
    p.add_argument("--llm-url")
    p.add_argument("--llm-model")
    p.add_argument("--log", help="log file")
    for name, kind in (("alpha", float), ("partners", int), ("partner-weight", float), ("hops", int), ("gate", float), ("sentences", int), ("passages", int), ("damping", float), ("boost", float)):
        p.add_argument(f"--{name}", type=kind, default=None)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    if a.log:
        log_to(a.log)
    spark = spark or SparkSession.builder.appName("larkspur").getOrCreate()
    if a.job == "index":
        corpus.extend(read_chunks(spark, a.chunks).select("text"), a.corpus)
        return
    names = ("alpha", "partners", "partner_weight", "hops", "gate", "sentences", "passages", "damping", "boost")
    index = corpus.load(spark, a.corpus, config=Config.load(**{n: getattr(a, n) for n in names}))
    questions = read_questions(spark, a.questions)
    if a.job == "retrieve":
        experiment.retrieval(index, questions, f"{a.results}/retrieval")
        return
    client = ChatClient.load(a.llm_url, a.llm_model)
    if a.job == "run":
        experiment.experiment(index, questions, a.results, client, client, a.save_every).show()
    else:
        experiment.sweep(index, questions, alpha_grid(a.alphas), a.results, client, client, a.save_every).show(100)


if __name__ == "__main__":
    main()
