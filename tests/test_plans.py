import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur import cli
from larkspur.config import Config
from larkspur.plans import answer, corpus, experiment
from larkspur.plans.retrieve import Index, nested, retrieve
from larkspur.providers import ChatClient, first_passage, infer, same_text_judge, tag
from larkspur.queries import QUERIES, SQL
from larkspur.sources import stores
from larkspur.sources.stores import read_or_empty
from larkspur.streaming.incremental import add_passages

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((plain([r[c] for c in cols]) for r in df.collect()), key=repr)
    cur = con.execute(SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got == sorted((plain([r[i] for i in at]) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_retrieval_on_empty_tables(spark):
    empty = Index(
        spark.createDataFrame([], "hash_id string, text string"), spark.createDataFrame([], stores.NER), spark.createDataFrame([], "hash_id string, embedding array<float>")
    )
    q = spark.createDataFrame([("q", "Which person founded Lake Trobagimul?", "x")], "question_id string, question string, answer string")
    got = retrieve(empty, q)
    assert got.count() == 0
    assert nested(got, q, empty.passages).first()["sorted_passage"] is None


def test_stores(spark, tmp_path):
    (tmp_path / "questions.json").write_text('[{"question": "a?", "answer": "b", "more": 1}, {"question": "c?", "answer": "d"}]')
    (tmp_path / "chunks.json").write_text('["one", "two"]')
    assert [r["answer"] for r in stores.read_questions(spark, str(tmp_path / "questions.json")).orderBy("answer").collect()] == ["b", "d"]
    assert [r["text"] for r in stores.read_chunks(spark, str(tmp_path / "chunks.json")).orderBy("idx").collect()] == ["0:one", "1:two"]
    store = str(tmp_path / "store")
    batch = spark.createDataFrame([("0:one",), ("0:one",), (None,), ("1:two",)], "text string")
    for _ in range(2):
        add_passages(batch, store)
    saved = stores.read_or_empty(spark, store, stores.STORE)
    assert saved.count() == 2 and all(len(r["embedding"]) == 64 for r in saved.collect())
    ledger = str(tmp_path / "ledger")
    assert stores.read_ledger(spark, ledger).count() == 0
    stores.append_ledger(spark.createDataFrame([(0.5, 5, 0.7, 0.6, "r"), (0.25, 5, None, None, "r"), (0.0, 5, 0.7, 0.1, "r")], stores.LEDGER), ledger)
    back = stores.read_ledger(spark, ledger)
    assert answer.best_run(back).first()["cooccur_alpha"] == 0.0
    grid = spark.createDataFrame([(0.0,), (0.25,), (0.5,)], "alpha double")
    assert [r[0] for r in answer.pending_alphas(grid, back).collect()] == [0.25]
    stores.evaluation_text(spark.createDataFrame([(50.0, 25.0)], "llm_accuracy double, contain_accuracy double")).write.json(str(tmp_path / "eval"))
    assert tuple(stores.read_evaluation(spark, str(tmp_path / "eval")).first()) == (50.0, 25.0)
    v = spark.createDataFrame([("a", "entity", 'x & "y"')], "id string, kind string, content string")
    e = spark.createDataFrame([("a", "a", 1.0)], "src string, dst string, weight double")
    stores.write_graphml(v, e, str(tmp_path / "g"))
    lines = [line for f in sorted((tmp_path / "g").glob("part-*")) for line in f.read_text().splitlines()]
    import xml.etree.ElementTree as tree

    assert len(tree.fromstring("".join(lines))[-1]) == 2


def test_corpus_grows_and_answers(spark, tmp_path):
    path = str(tmp_path / "corpus")
    texts = spark.createDataFrame([("0:Vibor Tholen founded Lake Trobagimul. It had 12 boats.",), ("1:Nobody lived in Port Ösklund.",), (None,), ("2:nothing",)], "text string")
    corpus.extend(texts.limit(1), path)
    for _ in range(2):
        corpus.extend(texts, path)
    assert {n: read_or_empty(spark, f"{path}/{n}", stores.STORE).count() for n in ("passages", "sentences", "entities")} == {"passages": 3, "sentences": 3, "entities": 5}
    index = corpus.load(spark, path, config=Config(related=0.1), store=str(tmp_path / "kept"))
    q = spark.createDataFrame([("q", "Who founded Lake Trobagimul?", "Vibor Tholen"), ("r", "why?", "x")], "question_id string, question string, answer string")
    best = {(r["question_id"], r["rank"]): r["hash_id"] for r in retrieve(index, q).collect()}
    first = index.passages.where("text LIKE '0:%'").first()["hash_id"]
    assert best["q", 1] == first and ("r", 1) in best
    assert stores.exists(spark, str(tmp_path / "kept" / "counts")) and index.neighbours_of([0.5, 0.25]).count() == index.neighbours_of([0.25, 0.5]).count()


def test_run_is_taken_up_again_and_swept(spark, tmp_path):
    path = str(tmp_path / "corpus")
    corpus.extend(spark.createDataFrame([("0:Vibor founded Lake Trobagimul.",), ("1:Nobody lived in Port Ösklund.",)], "text string"), path)
    index = corpus.load(spark, path)
    q = spark.createDataFrame([("q", "Who founded Lake Trobagimul?", "Vibor"), ("r", "Who lived in Port Ösklund?", "Nobody")], "question_id string, question string, answer string")
    calls = []

    def lost(messages):
        raise OSError("lost")

    with pytest.raises(Exception, match="lost"):
        experiment.experiment(index, q, str(tmp_path / "run"), lost, lost, rounds=(1, 1))
    assert stores.exists(spark, str(tmp_path / "run" / "retrieval")) and not calls
    got = experiment.experiment(index, q, str(tmp_path / "run"), first_passage, same_text_judge, every=1, rounds=(1, 1)).first()
    assert got["contain_accuracy"] == 100.0
    assert experiment.experiment(None, q, str(tmp_path / "run"), lost, lost).first() == got  # evaluated already
    assert experiment.continued(spark, str(tmp_path), "run", str(tmp_path / "later")) and stores.read_results(spark, str(tmp_path / "later" / "retrieval")).count() == 2
    bad = experiment.sweep(index, q, [0.0], str(tmp_path / "sweep"), lost, lost)
    assert [r["EM"] for r in bad.collect()] == [None]
    both = experiment.sweep(index, q, [0.5, 0.0], str(tmp_path / "sweep"), first_passage, same_text_judge)
    assert [(r["cooccur_alpha"], r["Contain_Acc"]) for r in both.collect()] == [(0.0, 100.0), (0.5, 100.0)]
    chunks, questions = tmp_path / "c.json", tmp_path / "q.json"
    chunks.write_text('["Vibor founded Lake Trobagimul."]')
    questions.write_text('[{"question": "Who founded Lake Trobagimul?", "answer": "Vibor"}]')
    more = str(tmp_path / "more")
    cli.main(["index", "--corpus", more, "--chunks", str(chunks), "--log", str(tmp_path / "log")], spark)
    cli.main(["retrieve", "--corpus", more, "--questions", str(questions), "--results", str(tmp_path / "out"), "--gate", "0.4"], spark)
    assert len(stores.read_results(spark, str(tmp_path / "out" / "retrieval")).first()["sorted_passage"]) == 1


def test_a_broken_store_is_an_error(spark, tmp_path):
    at = str(tmp_path / "store")
    spark.createDataFrame([(1,)], "hash_id int").write.parquet(at)
    with pytest.raises(Exception):  # noqa: B017
        stores.read_or_empty(spark, at, stores.STORE).collect()
    ner = spark.createDataFrame([({"p": ["a"]}, {"s": ["a"]})], stores.NER)
    stores.write_ner(ner, str(tmp_path / "ner"))
    left = stores.untagged(spark.createDataFrame([("p",), ("r",)], "hash_id string"), stores.read_or_empty(spark, str(tmp_path / "ner"), stores.NER, "json"))
    assert [r[0] for r in left.collect()] == ["r"]


def test_override_and_union(spark):
    ner = spark.createDataFrame([(1, {"p": ["a", "b"]}), (2, {"p": ["c"]}), (0, None)], "at int, m map<string,array<string>>")
    assert stores.override_ner(ner, "m", "at").first()["entities"] == ["c"]
    assert stores.merge_ner(ner, "m").first()["entities"] == ["a", "b", "c"]


PRED = "question string, sorted_passage array<string>, gold_answer string, pred_answer string"


def test_answers_are_completed_and_retried(spark):
    rows = [("q?", ["0:Paris is far. Yes."], "Paris", None), ("r?", ["1:x"], "x", "LLM request failed (retry 3/3)"), ("s?", None, "y", "kept")]
    done = answer.answer(spark.createDataFrame(rows, PRED), first_passage, rounds=2)
    got = {r["question"]: r["pred_answer"] for r in done.collect()}
    assert got == {"q?": "Paris is far", "r?": "x", "s?": "kept"}
    judged = answer.judge(done, same_text_judge, rounds=2)
    assert {r["question"]: (r["llm_accuracy"], r["contain_accuracy"]) for r in judged.collect()} == {"q?": (1.0, 1), "r?": (1.0, 1), "s?": (0.0, 0)}
    assert answer.summary(judged).first()["rows"] == 3


def test_failing_client_ends_after_bounded_rounds(spark):
    rows = [("q?", ["0:x"], "x", None)]
    done = answer.answer(spark.createDataFrame(rows, PRED), ChatClient("http://127.0.0.1:9", "m", timeout=0.2, tries=2), rounds=2)
    assert done.first()["pred_answer"].startswith("LLM request failed (retry 2/2)")
    assert not ChatClient("http://127.0.0.1:9", "m", timeout=0.2, tries=1).reachable()


def test_summary_of_nothing_is_null(spark):
    empty = spark.createDataFrame([], "llm_accuracy double, contain_accuracy int")
    assert tuple(answer.summary(empty).first()) == (0, None, None)


def test_tagger_keeps_keys_and_drops_numbers(spark):
    df = spark.createDataFrame([("p", "Vibor 12"), ("r", "none")], "hash_id string, text string")
    got = tag(df, lambda t: [(t, w, "CARDINAL" if w.isdigit() else "TERM") for w in t.split() if w != "none"]).collect()
    assert [(r["passage_id"], r["entity"]) for r in got] == [("p", "Vibor")]


def test_infer_keeps_rows(spark):
    df = spark.createDataFrame([(1, [{"role": "user", "content": "0:hi. x"}])], "k int, m array<struct<role:string,content:string>>")
    assert infer(df, "m", "out", first_passage).first()["out"] == "Answer: hi"


def test_core_does_not_import_the_subpackage():
    import pathlib

    import larkspur

    root = pathlib.Path(larkspur.__file__).parent
    files = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert files and not [p for p in files if "larkspur.llm" in p.read_text() or "from .llm" in p.read_text() or "from ..llm" in p.read_text()]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert isinstance(e.entry(spark).select(F.col("question_id")).first()[0], str)
