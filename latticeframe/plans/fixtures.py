"""The library's tables made from the test tables, in Spark and in SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeframe.operators.lattice import nearest_seed_label
from latticeframe.plans.lineage import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size(spark: SparkSession, sf_dir: str) -> int:
    """Edge of the smallest cube with a cell for each order; its last slabs may be empty in part."""
    return math.ceil(table(spark, sf_dir, "orders").count() ** (1 / 3) - 1e-9)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = size(spark, sf_dir), F.col("o_orderkey").cast("long")
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.floor(k / (n * n)).cast("long").alias("x"), (F.floor(k / n) % n).cast("long").alias("y"), (k % n).alias("z"), F.col("o_custkey").cast("long").alias("ck"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, h = size(spark, sf_dir), (F.col("s_suppkey").cast("long") * 2654435761 + 12345) % 4294967296
    at = [(h % n).alias("sx"), (F.floor(h / 1009) % n).cast("long").alias("sy"), (F.floor(h / 1013579) % n).cast("long").alias("sz")]
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey").cast("long") + 1).alias("grain"), *at)


_made: dict[tuple[str, str], tuple[str, object]] = {}


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, x, y, z, ck, grain, d, set_id), written once for an application and a folder, and again if it has gone."""
    key = spark.sparkContext.applicationId, sf_dir
    if key in _made:
        try:
            return spark.read.schema(_made[key][1]).parquet(_made[key][0])
        except AnalysisException:
            del _made[key]
    found = nearest_seed_label(cells(spark, sf_dir), seeds(spark, sf_dir), size(spark, sf_dir)).withColumn("set_id", F.lit(1).cast("long"))
    path = f"{shared_dir(spark)}/voxels-{uuid.uuid4().hex}"
    found.write.parquet(path)
    _made[key] = path, found.schema
    return spark.read.schema(found.schema).parquet(path)


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("set_id", "x", "y", "z", "grain")


def voxels_porous(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The labelled cells with a tenth of them empty: that they are is the table, not a filter of a query."""
    grain = F.when(F.col("ck") % 10 == 0, F.lit(0).cast("long")).otherwise(F.col("grain"))
    return labelled(spark, sf_dir).select("set_id", "x", "y", "z", grain.alias("grain"), *more)


def node_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(load_step, k, x, y, z, q, p, d, t): the nodes' places and the four numbers that all their values are made of."""
    d = lambda c: F.max(F.col(c).cast("double"))
    # dealt by k alone, which serves the grouping and the join; a side's estimate would send it through the driver
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("load_step"), F.col("l_orderkey").cast("long").alias("k"), "l_quantity", "l_extendedprice", "l_discount", "l_tax").repartition("k")
    li = li.groupBy("load_step", "k").agg(d("l_quantity").alias("q"), d("l_extendedprice").alias("p"), d("l_discount").alias("d"), d("l_tax").alias("t"))
    return li.join(cells(spark, sf_dir).hint("merge"), "k").select("load_step", "k", "x", "y", "z", "q", "p", "d", "t")


def node_values(base: DataFrame) -> DataFrame:
    e = F.expr
    made = {"ux": "d", "uy": "t", "uz": "d - t", "sx": "q", "sy": "p / 1e3", "sz": "q * t", "sxy": "q * d", "syz": "p * d / 1e3", "sxz": "p * t / 1e3", "eps_x": "q / 1e5", "eps_y": "p / 1e8", "eps_z": "q * t / 1e5", "eps_xy": "q * d / 1e5", "eps_yz": "p * d / 1e8", "eps_xz": "p * t / 1e8"}
    return base.select(F.lit(1).cast("long").alias("set_id"), "load_step", (F.col("k") + 1).alias("id"), "x", "y", "z", *(e(v).alias(c) for c, v in made.items()))


def node_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_values(node_base(spark, sf_dir))


def load_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load case for each nation, numbered from 1."""
    k = F.col("n_nationkey").cast("int")
    return table(spark, sf_dir, "nation").select(F.lit(1).cast("long").alias("set_id"), (k + 1).alias("load_step"), *((((k * m) % 7).cast("double") / 1e5).alias(c) for m, c in ((1, "exx"), (2, "eyy"), (3, "ezz"), (4, "exy"), (5, "eyz"), (6, "exz"))))


#: SQL of the same tables, to stand after WITH.
SQL = """
dim as (select cast(ceil(cbrt(count(*)) - 1e-9) as bigint) n from orders),
lat as (select cast(o_orderkey as bigint) k, cast(o_orderkey // (n*n) as bigint) x, cast((o_orderkey // n) % n as bigint) y,
        cast(o_orderkey % n as bigint) z, n, cast(o_custkey as bigint) ck from orders cross join dim),
hashed as (select cast(s_suppkey as bigint) + 1 grain, (cast(s_suppkey as bigint) * 2654435761 + 12345) % 4294967296 h from supplier),
seeds as (select grain, h % n sx, (h // 1009) % n sy, (h // 1013579) % n sz from hashed cross join dim),
vox as (select 1::bigint set_id, x, y, z, max(n) n, max(ck) ck, max(k) k,
        min(greatest(abs(x-sx), abs(y-sy), abs(z-sz)) * 1000000 + grain) % 1000000 grain
        from lat cross join seeds group by x, y, z),
porous as (select set_id, x, y, z, n, case when ck % 10 = 0 then 0::bigint else grain end grain from vox),
nodes as (select 1::bigint set_id, cast(l_linenumber as int) load_step, k + 1 id, x, y, z, n,
        d ux, t uy, d - t uz, q sx, p / 1e3 sy, q * t sz, q * d sxy, p * d / 1e3 syz, p * t / 1e3 sxz,
        q / 1e5 eps_x, p / 1e8 eps_y, q * t / 1e5 eps_z, q * d / 1e5 eps_xy, p * d / 1e8 eps_yz, p * t / 1e8 eps_xz
        from (select l_linenumber, l_orderkey, max(l_quantity)::double q, max(l_extendedprice)::double p,
              max(l_discount)::double d, max(l_tax)::double t from lineitem group by l_linenumber, l_orderkey) a
        join lat on lat.k = a.l_orderkey),
loads as (select 1::bigint set_id, n_nationkey::int + 1 load_step, (n_nationkey % 7)::double / 1e5 exx, (n_nationkey * 2 % 7)::double / 1e5 eyy,
        (n_nationkey * 3 % 7)::double / 1e5 ezz, (n_nationkey * 4 % 7)::double / 1e5 exy, (n_nationkey * 5 % 7)::double / 1e5 eyz,
        (n_nationkey * 6 % 7)::double / 1e5 exz from nation)
"""
