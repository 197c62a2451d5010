"""Helpers that the operators of this package share: tables, steps written to the shared folder, and taking rows out."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: The words of a text are the runs outside these six characters.
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of rows that a task hands to Python at a time; Spark's own 64 MB are held by both sides, and outside the heap by the JVM.
HANDED = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset and all runs on this machine, as in tests, one that is made and set.

    On a cluster an unset folder is an error: what executors write to their own disks the others never see.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/loomql/{label}-{uuid.uuid4().hex}"


@contextmanager
def step_settings(spark: SparkSession) -> Iterator[None]:
    """For a step that is written, unless the session says otherwise: rows go to Python ``HANDED`` bytes at a time (a row or a group is
    never cut), and its shuffle files go when it ends. They would stay until the driver happens to collect its garbage."""
    own = {"spark.sql.execution.arrow.maxBytesPerBatch": str(HANDED), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    own = {k: v for k, v in own.items() if spark.conf.get(k, None) is None}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in own:
            spark.conf.unset(key)


def give_back() -> None:
    """Return to the system what this process has freed: a Python worker waits for its next task with all that its last one took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def give_back_heap(spark: SparkSession) -> None:
    """Executors collect their garbage and return what they don't need of the heap, so that what one step has grown isn't kept beside the next one's Python workers.

    A small task for each core goes to all of them, as long as nothing else runs.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("x")).write.format("noop").mode("overwrite").save()


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with ``give_back`` once its own objects are gone."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and any executor can read it again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with step_settings(spark):
        df.write.parquet(path)
    return at_path(df, path)


def at_path(df: DataFrame, path: str) -> DataFrame:
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    if _steps:
        _steps[-1].append(table)
    return table


#: The tables that were written within each ``settled`` that is being made, the innermost last.
_steps: list[list[DataFrame]] = []


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` gives, written; the steps that were written for it are deleted then, as nothing needs them any more."""
    _steps.append([])
    try:
        df = make()
        path = new_path(df.sparkSession, label)
        with step_settings(df.sparkSession):
            df.write.parquet(path)
    finally:
        steps = _steps.pop()
    discard(*steps)
    return at_path(df, path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once no result depends on them."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fitting_rows(rows: DataFrame, key: str, text: str, size: int) -> list[Row]:
    """A row for each key, for the driver: ``rows`` must hold a bounded number of keys, but may hold any number of rows of each.

    Of rows that share a key the one whose text hashes lowest counts. Texts together have at most ``size`` bytes: keys are taken by
    their hash while there is room, and one whose text is over a sixteenth of that is passed over, so that a few can't take it all.
    Keys and sizes are looked at first; only the chosen texts are collected, in the order of their keys' hashes.
    """
    light = rows.filter(F.col(text).isNotNull()).groupBy(key).agg(F.min(F.struct(F.xxhash64(text).alias("hash"), F.octet_length(text).alias("bytes"))).alias("x"))
    taken, room = [], size
    for r in light.select(key, "x.*", F.xxhash64(key).alias("order")).orderBy("order", key).collect():
        if r["bytes"] <= min(room, size // 16):
            taken.append((r[key], r["hash"]))
            room -= r["bytes"]
    chosen = rows.sparkSession.createDataFrame(taken, f"_key {rows.schema[key].dataType.simpleString()}, _hash long")
    same = (F.col(key) == F.col("_key")) & (F.xxhash64(text) == F.col("_hash"))
    return rows.join(F.broadcast(chosen), same, "left_semi").dropDuplicates([key]).orderBy(F.xxhash64(key), key).collect()


def taken_out(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. ``rows`` says of each whether it stays: id, hash (xxhash64 of the text) and kept.

    What goes is usually far less than what stays, and it is light: Spark broadcasts it if its files are small, and else deals both
    sides by key. Only rows that repeat both identifier and text are read a second time, to keep one of them.
    """
    fates = rows.groupBy("id", "hash").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    fates = written(fates.filter("n > 1 or not stays"), "fates")
    same = docs[id_col].eqNullSafe(fates["id"]) & (F.xxhash64(docs[text_col]) == fates["hash"])
    out = docs.join(fates, same, "left_anti")
    again = fates.filter("stays")
    if not again.isEmpty():
        twice = docs.join(again, same, "left_semi").select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
        out = out.unionByName(twice.dropDuplicates(["id", "hash"]).select("row.*"))
    return out
