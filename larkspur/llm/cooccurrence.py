"""Items that appear together: an incremental table of pair counts.

`PairTable` keeps three tables of counted rows in the shared folder, each in
hash buckets: the items of every record, the records of every item, and the
records of every pair. `apply` takes the records that changed, turns the
difference between their old and new items into signed rows, for pairs only
those with an item that came or went, and adds them to the buckets they fall
in; all other buckets stay as they are.

A change is one version: new files of the touched buckets of all three tables,
then one small manifest that names the files of every bucket. Until the
manifest is written the earlier version holds, so a lost driver leaves no
tables that disagree, and a table opened again goes on where it ended. The
number of buckets follows the number of rows.

Defined results: NULL records and NULL or blank items are ignored; repeated
items of a record count once; records without items still count as records; an
empty change alters nothing; further columns are ignored. Items of a record are
rows and never one value, so a very large record is joined like any other.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, work_path

#: Text with at least one character that is not white space.
NOT_BLANK = r"(?U)\S"
KEYS = {"baskets": ["kind", "record", "item"], "items": ["kind", "item"], "pairs": ["kind", "a", "b"]}


def records(df: DataFrame, kind: str, map_col: str) -> DataFrame:
    """``kind, record, items`` of a ``map<string, array<string>>`` column, one row a map entry."""
    entries = df.select(F.explode(map_col).alias("record", "list"))
    return entries.select(
        F.lit(kind).alias("kind"),
        "record",
        F.coalesce(F.filter("list", lambda x: x.rlike(NOT_BLANK)), F.array().cast("array<string>")).alias("items"),
    )


def item_rows(df: DataFrame) -> DataFrame:
    """``kind, record, item``, each once, and for every record one row without item."""
    marked = F.concat("items", F.array(F.lit(None).cast("string")))
    return df.where(F.col("record").isNotNull()).select("kind", "record", F.explode(marked).alias("item")).distinct()


class PairTable:
    """Persistent counts below `path`: a stored table is opened, a new path starts empty."""

    def __init__(self, spark: SparkSession, path: str | None = None, rows_a_bucket: int = 500_000, least_buckets: int = 8):
        self.spark, self.path = spark, path or work_path(spark, "pairs")
        self.rows_a_bucket, self.least_buckets = rows_a_bucket, least_buckets
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        stored = [int(n.split(".")[0]) for n in self._names("manifest") if n.endswith(".json")]
        self.state: dict = {"version": 0, "buckets": 0, "rows": 0, "files": {t: {} for t in KEYS}}
        if stored:
            text = spark.read.text(f"{self.path}/manifest/{max(stored):08d}.json", wholetext=True).first()[0]
            self.state = json.loads(text)

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _commit(self, state: dict) -> None:
        new, final = self._at(f"manifest/.{state['version']:08d}.new"), self._at(f"manifest/{state['version']:08d}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(new, final):
            raise RuntimeError(f"version {state['version']} of {self.path} was written by another run")
        self.state = state

    def _schema(self, table: str) -> str:
        return ", ".join(f"{k} string" for k in KEYS[table]) + ", n bigint"

    def read(self, table: str, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets."""
        files = self.state["files"][table]
        paths = [f"{self.path}/{table}/{v}/bucket={b}" for b, v in files.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self._schema(table)).parquet(*paths) if paths else self.spark.createDataFrame([], self._schema(table))

    def _bucket(self, table: str, buckets: int):
        keys = KEYS[table][:2] if table == "baskets" else KEYS[table]  # a record's items stay together
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _touched(self, df: DataFrame, table: str) -> set[int]:
        """Bucket numbers, at most as many as there are buckets."""
        return {r[0] for r in df.select(self._bucket(table, self.state["buckets"]).alias("b")).distinct().collect()}

    def _merge(self, state: dict, table: str, delta: DataFrame) -> None:
        """Adds signed rows to the buckets they fall in, as files of a new version."""
        keys, some = KEYS[table], self._touched(delta, table)
        rows = self.read(table, some).unionByName(delta.select(*keys, "n")).groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
        self._write(state, table, rows, some)

    def _write(self, state: dict, table: str, rows: DataFrame, some: set[int]) -> None:
        rows = rows.withColumn("bucket", self._bucket(table, state["buckets"]))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/{state['version']}")
        there = {n.removeprefix("bucket=") for n in self._names(f"{table}/{state['version']}") if n.startswith("bucket=")}
        kept = {b: v for b, v in state["files"][table].items() if int(b) not in some}
        state["files"][table] = kept | {b: state["version"] for b in there}

    def _fit(self, more: int) -> None:
        """As many buckets as the rows want: a power of two, and all rows placed anew when they have outgrown it."""
        have, rows = self.state["buckets"], self.state["rows"] + more
        want = self.least_buckets
        while want * self.rows_a_bucket < rows:
            want *= 2
        state = self.state | {"rows": rows, "buckets": max(have, want)}
        if have and want > have:
            state |= {"version": self.state["version"] + 1, "files": dict(self.state["files"])}
            for table in KEYS:
                self._write(state, table, self.read(table), set(range(have)))
            self._commit(state)
        self.state = state

    def apply(self, changed: DataFrame, replace: bool = False) -> DataFrame:
        """Adds the items of `changed` (``kind, record, items``) to their records or, with `replace`, takes them as all a record has.

        Returns ``kind, item`` of every item that came or went somewhere: the scores of its pairs are the affected ones.
        """
        fresh = cut(item_rows(changed))
        count = fresh.count()
        if not count:
            return self.spark.createDataFrame([], "kind string, item string")
        self._fit(count)
        rows = fresh.withColumns({"was": F.lit(0), "now": F.lit(1)})
        if self.state["files"]["baskets"]:
            old = self.read("baskets", self._touched(fresh, "baskets")).select("kind", "record", "item")
            old = old.join(fresh.where("item IS NULL").select("kind", "record"), ["kind", "record"], "left_semi")
            rows = rows.unionByName(old.withColumns({"was": F.lit(1), "now": F.lit(0 if replace else 1)}))
            rows = rows.groupBy("kind", "record", "item").agg(F.max("was").alias("was"), F.max("now").alias("now"))
        rows = cut(rows)
        moved = rows.where("was <> now").withColumn("n", (F.col("now") - F.col("was")).cast("bigint"))
        mine = moved.where("item IS NOT NULL").select("kind", "record", F.col("item").alias("x"), F.col("was").alias("xw"), F.col("now").alias("xn"))
        pairs = mine.join(rows.where("item IS NOT NULL"), ["kind", "record"]).where((F.col("x") < F.col("item")) | (F.col("was") == F.col("now")) & (F.col("x") > F.col("item")))
        n = (F.col("xn") * F.col("now") - F.col("xw") * F.col("was")).cast("bigint")
        pairs = pairs.select("kind", F.least("x", "item").alias("a"), F.greatest("x", "item").alias("b"), n.alias("n"))
        pairs = cut(pairs.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).where("n <> 0"))
        items = cut(moved.groupBy("kind", "item").agg(F.sum("n").alias("n")))
        state = self.state | {"version": self.state["version"] + 1, "files": dict(self.state["files"])}
        for table, delta in (("pairs", pairs), ("items", items), ("baskets", moved)):
            self._merge(state, table, delta)
        self._commit(state)
        return items.where("item IS NOT NULL").select("kind", "item")

    def scores(self, min_count: int = 1, min_lift: float = 0.0, affected: DataFrame | None = None) -> DataFrame:
        """``kind, a, b, n_ab, n_a, n_b, n, lift``; with `affected` (``kind, item``) only pairs with such an item.

        Where only the number of records `n` changed, all lifts of a kind change by the same factor, and no count does.
        As ``n_ab <= min(n_a, n_b)``, an item in more than ``n / min_lift`` records or fewer than `min_count` is in no
        result, so such items, the hottest among them, leave before the join.
        """
        counts = self.read("items")
        totals = counts.where("item IS NULL").select("kind", "n")  # one row a kind
        item = counts.where("item IS NOT NULL").select("kind", "item", F.col("n").alias("n_item")).join(F.broadcast(totals), "kind")
        item = item.where((F.col("n_item") >= min_count) & (F.col("n_item") * F.lit(float(min_lift)) <= F.col("n")))
        pair = self.read("pairs").where(F.col("n") >= min_count).select("kind", "a", "b", F.col("n").alias("n_ab"))
        if affected is not None:
            some = affected.select("kind", "item").distinct().withColumn("hit", F.lit(True))
            for c in ("a", "b"):
                pair = pair.join(some.withColumnsRenamed({"item": c, "hit": f"hit_{c}"}), ["kind", c], "left")
            pair = pair.where(F.col("hit_a") | F.col("hit_b")).drop("hit_a", "hit_b")
        out = (
            pair.join(item.select("kind", F.col("item").alias("a"), F.col("n_item").alias("n_a"), "n"), ["kind", "a"])
            .join(item.select("kind", F.col("item").alias("b"), F.col("n_item").alias("n_b")), ["kind", "b"])
        )
        lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
        if float(min_lift).is_integer():  # exact in whole numbers
            out = out.where(F.col("n_ab") * F.col("n") >= F.lit(int(min_lift)) * F.col("n_a") * F.col("n_b"))
        else:
            out = out.where(lift >= min_lift)
        return out.select("kind", "a", "b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"))
