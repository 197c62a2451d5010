"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame functions alone.

Every row belongs to a run, by the task that read it. A run holds one entry for each digest: the
smallest identifier, the number of rows and the least and greatest length of the texts, sorted by digest. There are
``FAN_IN`` ** rounds runs, as many as tasks at least. In round r the runs whose numbers differ only in digit r
(to the base ``FAN_IN``) exchange entries: each takes over a share of their digests and merges
the sorted entries that it gets, keeping the smallest identifier and verifying lengths. Runs are
halved as often as they are merged, so none grows, and after the last round each digest has one
entry. Results go down the same tree: no more than ``FAN_IN`` entries of a digest, however common, meet
under one key above the runs. Texts never leave the scan; only digests are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, settled, taken_out, tasks, written

#: Runs that exchange entries in a round; and the parts that a run's digests are dealt in, so that few runs still fill many tasks.
FAN_IN, PARTS = 4, 64


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def leading(digest: Column, first: int) -> Column:
    """Four bytes of a digest as a number."""
    return F.conv(F.hex(F.substring(digest, first, 4)), 16, 10).cast("long")


def merged(sorted_runs: DataFrame) -> DataFrame:
    """One entry for each (run, digest). The least identifier is that of a struct, which Spark aggregates as the sorted rows come by."""
    out = sorted_runs.groupBy("run", "part", "digest").agg(F.min("least").alias("least"), F.sum("rows").alias("rows"), F.min("short").alias("short"), F.max("long").alias("long"))
    return out.withColumn("rows", F.when(F.col("short") == F.col("long"), F.col("rows")).otherwise(F.raise_error(F.lit("two texts with one SHA-256")).cast("long")))


def next_run(level: int) -> Column:
    """Where the entries of a run go in round ``level``: the run's digit there becomes the digest's. ``home`` is a digest's last run."""
    unit = FAN_IN**level
    digit = lambda x: F.floor(x / unit) % FAN_IN
    return (F.col("run") + (digit(F.col("home")) - digit(F.col("run"))) * unit).cast("int")


def exchanged(entries: DataFrame, level: int, runs: int) -> DataFrame:
    """One round: entries go to their next run, which is sorted and merged."""
    sent = entries.withColumn("home", leading(F.col("digest"), 1) % runs).withColumn("run", next_run(level)).drop("home")
    return merged(sent.repartition("run", "part").sortWithinPartitions("run", "part", "digest"))


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, digest, keep_id, group_size, kept) for each row: hash is of its text as it is, digest of the normalised one."""
    clean = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.unhex(F.sha2(clean, 256)).alias("digest"), F.octet_length(clean).alias("bytes"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "digests")  # numbered for good once it is written
    rounds = 1
    while FAN_IN**rounds < tasks(docs.sparkSession):
        rounds += 1
    runs = FAN_IN**rounds
    rows = rows.withColumns({"run": (F.shiftright("row", 33) % runs).cast("int"), "part": (leading(F.col("digest"), 5) % PARTS).cast("int")})
    least = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    levels = [merged(rows.select("run", "part", "digest", least.alias("least"), F.lit(1).cast("long").alias("rows"), F.col("bytes").alias("short"), F.col("bytes").alias("long")))]
    levels[0] = written(levels[0], "run-entries")
    for level in range(rounds):
        last = exchanged(levels[-1], level, runs)
        levels.append(written(last, "run-entries") if level < rounds - 1 else last)
    found = written(levels[-1].filter("rows > 1").select("run", "digest", F.col("least.id").alias("keep_id"), F.col("least.row").alias("keep_row"), F.col("rows").alias("group_size")), "groups")
    # Down again: each level's entry meets only the entries of the runs that it came from.
    for level in range(rounds - 1, -1, -1):
        below = levels[level].select("digest", "run").withColumn("home", leading(F.col("digest"), 1) % runs).withColumn("up", next_run(level)).drop("home")
        found = below.join(found.withColumnRenamed("run", "up"), ["digest", "up"]).drop("up")
    single = F.col("group_size").isNull()
    return rows.join(found, ["digest", "run"], "left").select(
        "id", "hash", "digest",
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are after ``normalised``. A null identifier comes after
    all others, so it stays only if its whole group has none; keep_id is then null. Of rows
    that repeat an identifier and a text, one is kept. Two texts with one SHA-256 and different
    lengths would be a collision of digests: the query fails rather than join them. No
    rows give no rows; other columns play no part, whatever their names.
    """
    rows = placed(docs, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each group of equal texts, as ``exact_groups`` has it."""
    rows = settled(lambda: placed(docs, id_col, text_col).select("id", "hash", "kept"), "kept")
    return taken_out(docs, rows, id_col, text_col)
