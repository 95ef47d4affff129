"""Readers and writers of the engine's files: inputs, embedding stores, tag caches, results, ledgers, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id, indexed_chunk, percent

QUESTIONS = "question string, answer string"
STORE = "hash_id string, text string, embedding array<float>"
NER = "passage_hash_id_to_entities map<string,array<string>>, sentence_to_entities map<string,array<string>>"
RETRIEVAL = "question string, sorted_passage array<string>, sorted_passage_scores array<double>, gold_answer string"
PREDICTIONS = RETRIEVAL + ", pred_answer string, llm_judge_answer string, llm_accuracy double, contain_accuracy int"
LEDGER = "cooccur_alpha double, top_k_entity_cooccur int, EM double, Contain_Acc double, result_dir string"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects with `question` and `answer`, or one such object a line; other keys are ignored."""
    rows = spark.read.schema(QUESTIONS).option("multiLine", not path.endswith(".jsonl")).json(path)
    return rows.select(content_id("question", F.col("question")).alias("question_id"), "question", "answer")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of strings; chunk i becomes the passage text ``i:chunk``. The format makes a file one task; `number_chunks` takes any table."""
    whole = spark.read.text(path, wholetext=True)
    items = whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("idx", "chunk"))
    text = indexed_chunk(F.col("idx"), F.col("chunk"))
    return items.select(content_id("passage", text).alias("hash_id"), F.col("idx").cast("bigint").alias("idx"), text.alias("text"))


def number_chunks(chunks: DataFrame, order: str, chunk: str = "chunk") -> DataFrame:
    """As `read_chunks`, for a table of chunks of any size that has its numbers in column `order`."""
    text = indexed_chunk(F.col(order), F.col(chunk))
    return chunks.where(F.col(chunk).isNotNull()).select(content_id("passage", text).alias("hash_id"), F.col(order).cast("bigint").alias("idx"), text.alias("text"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table or a file is stored at `path`; a table under way has no `_SUCCESS` yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.isFile(at) or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))


def read_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A stored table, or an empty one where none is stored yet; a stored one that cannot be read is an error."""
    return spark.read.schema(schema).format(fmt).load(path) if exists(spark, path) else spark.createDataFrame([], schema)


def kept(df: DataFrame, path: str) -> DataFrame:
    """The table stored at `path`, or else `df`, which is then stored there."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.mode("overwrite").parquet(path)  # what an earlier, lost run left
    return spark.read.schema(df.schema).parquet(path)


def find_runs(spark: SparkSession, root: str, prefix: str, holds: str) -> list[str]:
    """Folders in `root` whose names begin with `prefix` and that hold a finished `holds`, the latest name first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, prefix + "*")) or []
    return sorted((f"{root}/{x.getPath().getName()}" for x in found if exists(spark, f"{root}/{x.getPath().getName()}/{holds}")), reverse=True)


def copy_table(spark: SparkSession, source: str, target: str, fmt: str = "json") -> None:
    """A stored table once more, as another run's start."""
    spark.read.format(fmt).load(source).write.mode("overwrite").format(fmt).save(target)


def new_texts(texts: DataFrame, store: DataFrame, namespace: str) -> DataFrame:
    """``hash_id, text`` of the distinct texts that are not in the store yet."""
    keyed = texts.where("text IS NOT NULL").select(content_id(namespace, F.col("text")).alias("hash_id"), "text").dropDuplicates(["hash_id"])
    return keyed.join(store.select("hash_id"), "hash_id", "left_anti")


def append_store(df: DataFrame, path: str) -> None:
    """Adds only the new rows; stored files are never rewritten."""
    df.write.mode("append").parquet(path)


def read_ner(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NER).option("multiLine", True).json(path)


def merge_ner(ner: DataFrame, column: str) -> DataFrame:
    """``key, entities``: all writes of a key united, so that a later write never drops an entity."""
    rows = ner.select(F.explode(column).alias("key", "list")).select("key", F.explode("list").alias("entity")).where(F.trim("entity") != "").distinct()
    return rows.groupBy("key").agg(F.sort_array(F.collect_list("entity")).alias("entities"))


def override_ner(ner: DataFrame, column: str, order: str) -> DataFrame:
    """``key, entities``: the list of a key's last write by `order`, ties by the list itself."""
    rows = ner.select(order, F.explode(column).alias("key", "entities"))
    return rows.groupBy("key").agg(F.max_by("entities", F.struct(order, "entities")).alias("entities"))


def write_ner(ner: DataFrame, path: str) -> None:
    """Adds tags to those stored; earlier ones are never rewritten."""
    ner.select("passage_hash_id_to_entities", "sentence_to_entities").write.mode("append").json(path)


def untagged(passages: DataFrame, ner: DataFrame) -> DataFrame:
    """Passages that no stored tags tell of."""
    done = ner.select(F.explode(F.map_keys("passage_hash_id_to_entities")).alias("hash_id"))
    return passages.join(done, "hash_id", "left_anti")


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: str = RETRIEVAL) -> DataFrame:
    """Stored retrieval results or, with their schema, predictions; none stored yet: an empty table."""
    return read_or_empty(spark, path, schema, "json")


def evaluation_text(metrics: DataFrame) -> DataFrame:
    """Shares as the percent strings of an evaluation file."""
    return metrics.select(*[F.concat(F.round(c, 2).cast("string"), F.lit("%")).alias(c) for c in ("llm_accuracy", "contain_accuracy")])


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("llm_accuracy string, contain_accuracy string").json(path)
    return raw.select(percent(F.col("llm_accuracy")).alias("llm_accuracy"), percent(F.col("contain_accuracy")).alias("contain_accuracy"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).option("header", True).csv(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML text as part files: a head, one line a vertex, one a edge, and a foot, in order."""

    def esc(c: str):
        return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    spark = vertices.sparkSession
    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="content" for="node" attr.name="content" attr.type="string"/><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">'
    ends = spark.createDataFrame([(0, "", head), (3, "", "</graph></graphml>")], "part int, k string, value string")
    v = vertices.select(F.lit(1).alias("part"), F.col("id").alias("k"), F.concat(F.lit('<node id="'), esc("id"), F.lit('"><data key="content">'), esc("content"), F.lit("</data></node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.col("src").alias("k"), F.concat(F.lit('<edge source="'), esc("src"), F.lit('" target="'), esc("dst"), F.lit('"><data key="weight">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("value"))
    ends.unionByName(v).unionByName(e).repartitionByRange("part", "k").sortWithinPartitions("part", "k").select("value").write.mode("overwrite").text(path)
