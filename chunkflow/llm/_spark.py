"""Shared steps: tables in the cluster's shared folder, connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local master gets a temporary folder; a cluster must name one.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes inside are removed at the end, but for those it is to keep."""
    open_ = _scopes.__dict__.setdefault("open", [])
    open_.append([])
    try:
        yield
    finally:
        for path in open_.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there.

    keep: for the caller's scope and not this one's.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    open_ = _scopes.__dict__.get("open", [])
    if len(open_) > keep:
        open_[-1 - keep].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _edge_state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) links -> (node, component): component is the smallest node that can be reached.

    Alternating large-star and small-star steps. Each step takes the minimum per node with
    map-side combining and joins it back, so that a node with very many links is no single
    task's work. Every round ends in a table in the shared folder. Only nodes with a link
    to another node come back; null ends and loops are left out.
    """
    with scratch(edges.sparkSession):
        e = edges.select("u", "v").where("u <> v")
        e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        state = _edge_state(e)
        for _ in range(rounds):
            if not state[0]:
                break
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.where("u <> v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            joined = large.join(least, "u")
            small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
            e = materialize(small, "cc")
            now = _edge_state(e)
            if now == state:
                break
            state = now
        else:
            raise RuntimeError("components have not settled")
        nodes = e.groupBy("u").agg(F.min("v").alias("component"))
        roots = nodes.select(F.col("component").alias("node"), "component").distinct()
        return materialize(nodes.select(F.col("u").alias("node"), "component").unionByName(roots), "components", keep=True)
