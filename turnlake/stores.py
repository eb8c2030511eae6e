"""Keyed Parquet side tables: summaries, tool results, topic compactions, sub-topics, and the index itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 1
#: Folders that the index of sessions is dealt over.
BUCKETS = 64
KEYS = {
    "summaries": ["session_id", "turn_id"], "tool_results": ["session_id", "turn_id", "msg_idx"], "topic_compactions": ["session_id", "kind", "topic_id", "subtopic_id"],
    "subtopics": ["session_id", "topic_id", "subtopic_id"], "turns": ["session_id", "seq"], "topics": ["session_id", "topic_ord"], "session_index": ["session_id"], "turn_classes": ["session_id", "seq"], "lines": ["session_id", "line"],
}
#: Index tables that grow: a write adds rows, and of each key the last row counts. In the others a session's last write counts.
GROWING = {"lines"}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only where none is set on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="turnlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/turnlake/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it again, so that later steps read it and don't redo it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, n: int, most: int, *keys: str) -> DataFrame:
    """rows, n of them, hashed by keys over so many tasks that each has about most of them, whatever the size of the table.

    Adaptive execution would put partitions together by the bytes of a shuffle, not by what a task makes of them; a given number stays.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // most)), *keys)


class Store:
    """Side tables under one folder. A write adds rows with a time and version; a read gives each key's latest row of this version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, table: str) -> bool:
        where, files = self._files(table)
        return files.exists(where)

    def save(self, table: str, rows: DataFrame) -> None:
        """Append rows; rows of a key that is there already take its place on reads."""
        rows.withColumns({"_version": F.lit(VERSION), "_written": F.current_timestamp(), "_batch": F.lit(uuid.uuid4().hex)}).write.mode("append").parquet(f"{self.path}/{table}")

    def load(self, table: str, schema: str | StructType | None = None) -> DataFrame | None:
        """Latest rows by key; None, or no rows of schema, if nothing was saved."""
        if not self._exists(table) and self._exists(f"{table}.old"):
            self._move(f"{table}.old", table)
        if not self._exists(table):
            return None if schema is None else self.spark.createDataFrame([], schema)
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{table}").filter(F.col("_version") == VERSION)
        order = Window.partitionBy(*KEYS[table]).orderBy(F.desc("_written"), F.desc("_batch"))
        return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_version", "_written", "_batch")

    def replace_sessions(self, table: str, rows: DataFrame) -> None:
        """Add whole sessions to the index: they take the place of what it has of them, other sessions stay as they are.

        Files are dealt over BUCKETS folders by the session, however many sessions there are; nothing that is there is rewritten.
        """
        self._deal(table, rows)

    def add_new(self, table: str, rows: DataFrame) -> None:
        """Add those rows to a GROWING table of the index whose keys it doesn't have; nothing that is there is written again."""
        keys, known = KEYS[table], self._index(table, rows)
        new = rows if known is None else rows.join(known.select(keys), keys, "left_anti")
        self._deal(table, new.dropDuplicates(keys))

    def _deal(self, table: str, rows: DataFrame) -> None:
        marks = {"_version": F.lit(VERSION), "_written": F.current_timestamp(), "_batch": F.lit(uuid.uuid4().hex), "_bucket": _bucket()}
        rows.withColumns(marks).hint("rebalance", "_bucket").write.mode("append").partitionBy("_bucket").parquet(f"{self.path}/index/{table}")

    def _index(self, table: str, touched: DataFrame | None = None) -> DataFrame | None:
        """All rows of an index table that were ever written; of the sessions in touched only, if given."""
        self._recover(table)
        if not self._exists(f"index/{table}"):
            return None
        found = self.spark.read.option("mergeSchema", str(table in GROWING).lower()).parquet(f"{self.path}/index/{table}").filter(F.col("_version") == VERSION)
        if touched is not None:
            buckets = [r[0] for r in touched.select(_bucket().alias("b")).distinct().collect()]  # at most BUCKETS
            found = found.filter(F.col("_bucket").isin(buckets)).join(touched.select("session_id").distinct(), "session_id", "left_semi")
        return found

    def sessions(self, table: str, touched: DataFrame | None = None) -> DataFrame | None:
        """Each session's rows as last written; of the sessions in touched only, if given, and then only their folders are read."""
        found = self._index(table, touched)
        if found is None:
            return None
        if table in GROWING:
            order = Window.partitionBy(*KEYS[table]).orderBy(F.desc("_written"), F.desc("_batch"))
            return found.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_version", "_written", "_batch", "_bucket")
        last = found.groupBy("session_id").agg(F.max(F.struct("_written", "_batch")).alias("_last"))
        found = found.join(last, "session_id").filter((F.col("_written") == F.col("_last._written")) & (F.col("_batch") == F.col("_last._batch")))
        return found.drop("_version", "_written", "_batch", "_bucket", "_last")

    def vacuum(self, table: str) -> None:
        """Rewrite the index table without rows that later writes have replaced; no other write may run meanwhile.

        It is written beside the table and takes its place by two renames; what a failure leaves is found by the next call.
        """
        self._recover(table)
        rows = self.sessions(table)
        if rows is not None:
            marks = {"_version": F.lit(VERSION), "_written": F.current_timestamp(), "_batch": F.lit(uuid.uuid4().hex), "_bucket": _bucket()}
            rows.withColumns(marks).hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/index/{table}.new")
            self._move(f"index/{table}", f"index/{table}.old")
            self._move(f"index/{table}.new", f"index/{table}")
            self._delete(f"index/{table}.old")

    def compact(self, table: str) -> None:
        """Rewrite a side table with each key's latest row; the same way, and no other write may run meanwhile."""
        rows = self.load(table)
        if rows is not None:
            marks = {"_version": F.lit(VERSION), "_written": F.current_timestamp(), "_batch": F.lit(uuid.uuid4().hex)}
            rows.withColumns(marks).write.mode("overwrite").parquet(f"{self.path}/{table}.new")
            self._move(table, f"{table}.old")
            self._move(f"{table}.new", table)
            self._delete(f"{table}.old")

    def _recover(self, table: str) -> None:
        if not self._exists(f"index/{table}") and self._exists(f"index/{table}.old"):
            self._move(f"index/{table}.old", f"index/{table}")

    def _files(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _move(self, name: str, to: str) -> None:
        where, files = self._files(name)
        self._delete(to)
        if not files.rename(where, self._files(to)[0]):
            raise OSError(f"{self.path}/{name} can't be renamed to {to}")

    def _delete(self, name: str) -> None:
        where, files = self._files(name)
        files.delete(where, True)


def _bucket():
    return F.pmod(F.xxhash64(F.col("session_id").cast("string")), F.lit(BUCKETS)).cast("int")


def index_path(session_path: str) -> str:
    """Where a session file's index goes; other names than *.jsonl get a suffix, so a transcript is never overwritten."""
    return (session_path[: -len(".jsonl")] if session_path.endswith(".jsonl") else session_path) + ".index"


def stale(files: DataFrame, indexed: DataFrame | None) -> DataFrame:
    """Sessions of files (session_id, modified) whose index is missing or of another modification time."""
    now = files.select("session_id", "modified")
    return now if indexed is None else now.join(indexed.select("session_id", F.col("modified").alias("_m")), "session_id", "left").filter(F.col("_m").isNull() | (F.col("_m") != F.col("modified"))).drop("_m")


def summary_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id").agg(F.count("*").alias("entries"), F.sum("tokens").alias("tokens"), F.sum("original_tokens").alias("original_tokens"), F.count_if(F.col("method") == "llm").alias("by_model"))


def tool_result_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id").agg(F.count("*").alias("entries"), F.count_distinct("turn_id").alias("turns"), F.sum(F.col("original_tokens") - F.col("truncated_tokens")).alias("tokens_saved"))


def topic_compaction_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id").agg(F.count("*").alias("entries"), F.sum("turn_count").alias("turns"), F.sum(F.col("original_tokens") - F.col("summary_tokens")).alias("tokens_saved"))
