"""Incremental ingest of load-step files as they arrive.

Batches leave their rows, and statistics in levels: a batch's own are of level 0, and whenever FAN statistics of a level
are there they are merged into one of the next level. Readers take from each level what no higher one covers, so they
read a few files for any number of batches. What was merged is removed when the next merge of that level is done: a
reader that listed it before has until then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeframe.functions.scalar import STORED
from latticeframe.sources.files import parse_loadsteps
from latticeframe.sources.store import _folder, _numbers

COMPONENTS = STORED[1:]
FAN = 16
KEYS = ["load_step", "component"]
STATS = "load_step int, component string, n long, total double, low double, high double"


def partial_stats(rows: DataFrame) -> DataFrame:
    """(load_step, component, n, total, low, high): what a batch adds to the running statistics."""
    of = {"n": F.count, "total": F.sum, "low": F.min, "high": F.max}
    wide = rows.groupBy("load_step").agg(*(f(c).alias(f"{name}_{c}") for c in COMPONENTS for name, f in of.items()))
    parts = F.array(*(F.struct(F.lit(c).alias("component"), *(F.col(f"{name}_{c}").alias(name) for name in of)) for c in COMPONENTS))
    return wide.select("load_step", F.explode(parts).alias("p")).select("load_step", "p.*")


def merged_stats(stats: DataFrame) -> DataFrame:
    sums = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")]
    return stats.groupBy(*KEYS).agg(*sums)


def _part(store: str, level: int, k: int) -> str:
    return f"{store}/stats/{level}/{k}"


def _put_stats(stats: DataFrame, store: str, batch: int) -> None:
    """Write a batch's statistics, and merge the levels that it completes; done twice it leaves the same."""
    spark = stats.sparkSession
    stats.coalesce(1).write.mode("overwrite").parquet(_part(store, 0, batch))
    level, done = 1, batch + 1
    while done % FAN == 0:
        done //= FAN
        held = [_part(store, level - 1, k) for k in range((done - 1) * FAN, done * FAN)]
        there = [p for p in held if (lambda files, place: files.exists(place))(*_folder(spark, p))]
        merged_stats(spark.read.schema(STATS).parquet(*there)).coalesce(1).write.mode("overwrite").parquet(_part(store, level, done - 1))
        for k in range((done - 2) * FAN, (done - 1) * FAN):
            files, place = _folder(spark, _part(store, level - 1, k))
            if k >= 0 and files.exists(place):
                files.delete(place, True)
        level += 1


def stats_parts(spark: SparkSession, store: str) -> list[str]:
    """Folders that together have the statistics of every batch once."""
    levels = {level: set(_numbers(spark, f"{store}/stats/{level}")) for level in _numbers(spark, f"{store}/stats")}
    found, covered = [], -1  # the last batch that what was taken so far has
    for level in sorted(levels, reverse=True):
        for k in sorted(levels[level]):
            first, last = k * FAN**level, (k + 1) * FAN**level - 1
            if first > covered:
                found.append(_part(store, level, k))
                covered = last
    return found


def ingest_loadsteps(spark: SparkSession, source: str, store: str, checkpoint: str, files_per_batch: int | None = None) -> None:
    """Append all files that have come since the last run: their rows under `rows`, and what they add to the running
    statistics under `stats`. A batch overwrites what has its own number, so one that runs twice leaves one copy."""
    stream = spark.readStream.schema("value string").option("recursiveFileLookup", True).format("text")
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    lines = stream.load(source).select("value", F.col("_metadata.file_path").alias("path"))

    def put(batch: DataFrame, number: int) -> None:
        place = f"{store}/rows/batch={number}"
        batch.write.mode("overwrite").option("compression", "zstd").partitionBy("load_step").parquet(place)
        held = spark.read.schema(batch.schema).parquet(place)
        _put_stats(partial_stats(held), store, number)

    query = parse_loadsteps(lines).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def running_stats(spark: SparkSession, store: str) -> DataFrame:
    """(load_step, component, n, avg, low, high) over all that was ingested, from the merged statistics; no rows where nothing
    was."""
    parts = stats_parts(spark, store)
    held = spark.read.schema(STATS).parquet(*parts) if parts else spark.createDataFrame([], STATS)
    return merged_stats(held).select(*KEYS, "n", F.try_divide("total", "n").alias("avg"), "low", "high")
