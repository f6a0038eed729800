"""Plumbing shared by all operators: table access, lineage cuts and skew-proof joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is "hot" when it holds more than this share of the rows; so there are at most 1/HOT_SHARE hot keys.
HOT_SHARE = 1 / 2000
#: Tables written by cut() in this session.
_CUTS: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="folioscope-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends there, and a lost executor
    costs nothing that was finished before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUTS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove the tables that cut() wrote in this session, all or those given: once no result that reads them is needed
    any more."""
    jvm = spark._jvm
    names = {f.split("/")[-2] for t in tables for f in t.inputFiles()}
    for path in [p for p in _CUTS if not tables or p.split("/")[-1] in names]:
        _CUTS.remove(path)
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(c: Column | str) -> Column:
    """NULL, the empty string and the word None all stand for no value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.trim(c).isin("", "None"), c)


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of the rows of df: at most 1/share of them, whatever the data.

    The counts are combined on the map side before the shuffle."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    return counts.join(F.broadcast(total), F.col("__n") > F.greatest(F.col("__all") * share, F.lit(1000.0))).select(*keys)


def skew_join(big: DataFrame, unique: DataFrame, keys: list[str], how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """big ⋈ unique on keys, where unique has one row a key and big may hold a third of its rows under one key.

    Rows of hot keys meet a broadcast of the hot keys' rows only (at most 1/HOT_SHARE rows); all others are
    shuffled, and none of their keys is large. ``hot`` gives the hot keys where they are known. NULL keys match nothing; a left join keeps their rows."""
    if hot is None:
        hot = cut(hot_keys(big, keys), "hot")
    if hot.isEmpty():
        return big.join(unique, keys, how)
    flag = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    marked = big.join(flag, keys, "left")
    few = unique.join(F.broadcast(hot), keys, "left_semi")
    usual = marked.filter("__hot is null").drop("__hot").join(unique, keys, how)
    rest = marked.filter("__hot").drop("__hot").join(F.broadcast(few), keys, how)
    return usual.unionByName(rest)


def by_range(values: list[float], x: Column, names: list[str]) -> Column:
    """The name of the first value that x doesn't exceed; the last name beyond all."""
    out = F.lit(names[-1])
    for v, n in reversed(list(zip(values, names, strict=False))):
        out = F.when(x <= v, n).otherwise(out)
    return out


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
