"""Result store: Parquet tables partitioned by geometry set, and results also by load step.

A set is appended whole or not at all. A writer claims an id (`claims/<id>`), writes the set's data, and settles its fate
(`fates/<id>`, held by whoever makes the file first: `committed`, or `abandoned` by a sweep). A committed set gets the next
entry of the log (`log/<version>`). Readers go by the log alone, up to a version that they may hold on to: sets never
change once they are in it. All these are files that only one writer can make, by a rename that does not overwrite; on a
store without such a rename only one writer at a time is safe. They are listed and read by name, no data file is opened.

Node results lie in the order of a space-filling key of their places, so the row groups of a file hold small boxes, and
a filter by place reads few of them.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeframe.functions import scalar as S
from latticeframe.operators.results import loadstep_stats, with_derived

NOT_COMPONENTS = ("set_id", "load_step", "id")
TABLES = ("voxels", "geometry_sets", "orientations", "results", "result_stats", "load_cases")
COMMITTED, ABANDONED = "committed", "abandoned"
#: Nodes of a file of results.
FILE_ROWS = 500_000


def _folder(spark: SparkSession, path: str):
    """(file system, path) by which the cluster reaches a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, path: str) -> dict[int, int]:
    """Files of a folder that are named by a number, with their times in milliseconds; none where there is no folder."""
    files, place = _folder(spark, path)
    found = files.listStatus(place) if files.exists(place) else []
    return {int(f.getPath().getName()): f.getModificationTime() for f in found if f.getPath().getName().isdigit()}


def _held(spark: SparkSession, path: str) -> str | None:
    """What a small file says; None where there is none."""
    files, place = _folder(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _make(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with its text in one step; false where it is there already."""
    files, place = _folder(spark, path)
    files.mkdirs(place.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{uuid.uuid4().hex}")
    stream = files.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(place), none)
    except Exception:  # the other writer's file stays
        files.delete(draft, False)
        if not files.exists(place):
            raise
        return False
    return True


def claim_set_id(spark: SparkSession, root: str) -> int:
    """One more than the last claimed set, 1 in an empty store; claimed for this writer alone."""
    new = max(_numbers(spark, f"{root}/claims"), default=0) + 1
    while not _make(spark, f"{root}/claims/{new}", ""):
        new += 1
    return new


def _settle(spark: SparkSession, root: str, set_id: int, fate: str) -> str:
    """The fate of a claimed set, which is the given one if none was settled before."""
    _make(spark, f"{root}/fates/{set_id}", fate)
    return _held(spark, f"{root}/fates/{set_id}")


def _log(spark: SparkSession, root: str, set_id: int) -> int:
    """Add a committed set to the log; gives its version. A set that is in it already keeps its entry."""
    entries = _entries(spark, root)
    while set_id not in entries.values():
        version = max(entries, default=0) + 1
        _make(spark, f"{root}/log/{version}", str(set_id))
        entries = _entries(spark, root)
    return next(v for v, s in entries.items() if s == set_id)


def _entries(spark: SparkSession, root: str) -> dict[int, int]:
    """Version to set id, in the order of the log."""
    return {v: int(_held(spark, f"{root}/log/{v}")) for v in sorted(_numbers(spark, f"{root}/log"))}


def version(spark: SparkSession, root: str) -> int:
    """The last version of the store, 0 of an empty one; a reader that names it sees no later set."""
    return max(_numbers(spark, f"{root}/log"), default=0)


def committed(spark: SparkSession, root: str, upto: int | None = None) -> list[int]:
    """Ids of the sets in the log, up to a version."""
    return sorted({s for v, s in _entries(spark, root).items() if upto is None or v <= upto})


def write_set(root: str, set_id: int, voxels: DataFrame, orientations: DataFrame, nodes: DataFrame | None = None, loads: DataFrame | None = None) -> None:
    """Write a claimed set's data; nobody sees it before it is committed. Statistics come from what was written."""
    spark = voxels.sparkSession
    put = lambda df, name, *by: df.drop("set_id").write.mode("overwrite").partitionBy(*by).parquet(f"{root}/{name}/set_id={set_id}")
    held = lambda name, like: spark.read.schema(like.drop("set_id").schema).parquet(f"{root}/{name}/set_id={set_id}")
    put(voxels, "voxels")
    size = F.greatest(F.max("x"), F.max("y"), F.max("z")) + 1
    put(held("voxels", voxels).agg(size.alias("cube_size"), F.max("grain").alias("num_points")), "geometry_sets")
    put(orientations, "orientations")
    if nodes is not None:
        count = max(1, -(-nodes.count() // FILE_ROWS))
        key = S.morton("x", "y", "z").alias("place_key")
        ranges = nodes.withColumn("place_key", key).repartitionByRange(count, "load_step", "place_key").sortWithinPartitions("load_step", "place_key")
        put(ranges.drop("place_key"), "results", "load_step")
        written = with_derived(held("results", nodes)).withColumn("set_id", F.lit(set_id))
        stats = loadstep_stats(written, [c for c in written.columns if c not in NOT_COMPONENTS])
        put(stats.coalesce(1), "result_stats")  # a row for each load step
    if loads is not None:
        put(loads.coalesce(1), "load_cases")


def append_set(root: str, voxels: DataFrame, orientations: DataFrame, nodes: DataFrame | None = None, loads: DataFrame | None = None) -> int:
    """Append one geometry set, and with it its load steps' results, statistics and load vectors; gives its id."""
    spark = voxels.sparkSession
    new = claim_set_id(spark, root)
    write_set(root, new, voxels, orientations, nodes, loads)
    commit(spark, root, new)
    return new


def commit(spark: SparkSession, root: str, set_id: int) -> int:
    """Commit a written set; gives the version that has it. An error where a sweep has given the set up."""
    if _settle(spark, root, set_id, COMMITTED) != COMMITTED:
        raise RuntimeError(f"set {set_id} was swept before it was committed")
    return _log(spark, root, set_id)


def sweep(spark: SparkSession, root: str, older_s: float) -> list[int]:
    """Give up sets that were claimed more than older_s seconds ago and never committed, and remove their data; gives their
    ids. A set whose writer stopped between its commit and the log is entered there."""
    known, given_up, now = set(committed(spark, root)), [], 1000 * time.time()
    for set_id, made in _numbers(spark, f"{root}/claims").items():
        if set_id in known or now - made < 1000 * older_s:
            continue
        if _settle(spark, root, set_id, ABANDONED) == COMMITTED:
            _log(spark, root, set_id)
            continue
        for name in TABLES:
            files, place = _folder(spark, f"{root}/{name}/set_id={set_id}")
            if files.exists(place):
                files.delete(place, True)
                given_up.append(set_id)
    return sorted(set(given_up))


def scan(spark: SparkSession, root: str, name: str, set_id: int | None = None, load_step: int | None = None, upto: int | None = None) -> DataFrame | None:
    """One committed set, or all of them, or one load step, as of a version; None where no committed set has the table.
    Only the folders of the sets are listed, and a load step prunes theirs."""
    wanted = [f"{root}/{name}/set_id={i}" for i in committed(spark, root, upto) if set_id in (None, i)]
    there = [p for p in wanted if (lambda files, place: files.exists(place))(*_folder(spark, p))]
    if not there:
        return None
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(*there)
    return rows if load_step is None else rows.where(F.col("load_step") == load_step)


def box(spark: SparkSession, root: str, low: tuple, high: tuple, set_id: int, load_step: int, upto: int | None = None) -> DataFrame | None:
    """Node results of one load step whose places lie between low and high, both included; the limits of the row groups leave
    out most of the others unread."""
    rows = scan(spark, root, "results", set_id, load_step, upto)
    inside = [F.col(c).between(a, b) for c, a, b in zip("xyz", low, high, strict=True)]
    return rows if rows is None else rows.where(inside[0] & inside[1] & inside[2])


def limits(spark: SparkSession, root: str, component: str, set_id: int | None = None, upto: int | None = None) -> DataFrame | None:
    """(set_id, load_step, low, high) of a component, from the statistics that were written with the results."""
    rows = scan(spark, root, "result_stats", set_id, upto=upto)
    return rows if rows is None else rows.select("set_id", "load_step", F.col(f"min_{component}").alias("low"), F.col(f"max_{component}").alias("high"))


def catalog(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """(set_id, load_step) of the store in numeric order, from the statistics, which have one row for each; no rows of an
    empty store."""
    rows = scan(spark, root, "result_stats", upto=upto)
    if rows is None:
        return spark.createDataFrame([], "set_id int, load_step int")
    return rows.select("set_id", "load_step").distinct().orderBy("set_id", "load_step")
