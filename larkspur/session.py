"""Session helpers: local sessions, the cluster's shared folder, lineage cuts."""

from __future__ import annotations

import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benches. Clusters bring their own."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("larkspur")
    return builder.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only in local mode, and where it is unset, as in tests, a local one is made."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, written once to the shared folder, so later plans start from files that survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame) -> DataFrame:
    """As `cut`, in compressed columns: for tables of many rows, whose keys repeat; a checkpoint's rows are not compressed."""
    path = work_path(df.sparkSession, "packed")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def log_to(path: str, level: int = logging.INFO) -> logging.Logger:
    """The library's log, written to a file of the driver as well as to the console."""
    log = logging.getLogger("larkspur")
    log.setLevel(level)
    form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    for h in (logging.FileHandler(path, encoding="utf-8"), logging.StreamHandler()):
        if not any(type(x) is type(h) and getattr(x, "baseFilename", "") == getattr(h, "baseFilename", "") for x in log.handlers):
            h.setFormatter(form)
            log.addHandler(h)
    return log


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Time stamps without a zone stay as they are stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores, as of one small file, spread over the cores; any other stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
