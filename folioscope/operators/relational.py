"""Relational building blocks of the reports: top shares, top k, shares of totals, first appearances, zero filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.common import cut


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with its place in a total order (column ``place``, from 1), in two levels: rows are range-partitioned and
    numbered within their partition, and only the partitions' sizes are ordered in one task."""
    parts = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranked")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) + F.col("__base")
    return parts.join(F.broadcast(base.drop("__n")), "__p").withColumn("place", place).drop("__p", "__base")


def top_percent(df: DataFrame, share: float, *order: Column) -> DataFrame:
    """The first int(share·n) rows in a total order. No task holds more than its partition of the order."""
    df = cut(df, "rows")
    n = int(share * df.count())
    return ranked(df, *order).filter(F.col("place") <= n).drop("place")


def top_k(df: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first k rows of each group, with their rank; Spark prunes within each task before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def share_of(value: str, *by: str) -> Column:
    """value over its sum within by; NULL where the sum is 0."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return F.when(total != 0, F.col(value) / total)


def percent_sort(df: DataFrame, value: str, by: list[str], key: str) -> DataFrame:
    """Shares in percent with two digits, ranked falling within by; ties by key. Adds percent, rank and the offset at
    which a stacked bar of the share begins."""
    pct = df.withColumn("percent", F.round(F.lit(100.0) * share_of(value, *by), 2))
    w = Window.partitionBy(*by).orderBy(F.desc("percent"), F.asc(key))
    before = F.coalesce(F.sum("percent").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return pct.withColumn("rank", F.row_number().over(w)).withColumn("offset", F.round(before, 2))


def zero_filled(df: DataFrame, key: str, low: int, high: int, value: str, spark: SparkSession) -> DataFrame:
    """One row for each whole number from low to high; absent ones get 0."""
    return spark.range(low, high + 1).select(F.col("id").cast("int").alias(key)).join(df, key, "left").withColumn(value, F.coalesce(value, F.lit(0).cast("long")))


def threshold(col: str, least: float) -> Column:
    return F.when(F.col(col) < least, F.lit(0.0)).otherwise(F.col(col))


def min_max(df: DataFrame, col: str, *by: str) -> DataFrame:
    """df with col scaled to 0..1 within by; 0 where all are equal. The bounds are aggregated before they are shuffled,
    so a group may hold a third of all rows."""
    bounds = df.groupBy(*by).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    same = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    keyed = bounds.select(*[F.col(b).alias(f"__{b}") for b in by], "__lo", "__hi")
    scaled = F.when(F.col("__hi") > F.col("__lo"), (F.col(col) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(0.0))
    return df.join(F.broadcast(keyed) if not by else keyed, same or None, "left" if by else "cross").withColumn(col, scaled).drop("__lo", "__hi", *[f"__{b}" for b in by])


def upsert(base: DataFrame, new: DataFrame, keys: list[str], cols: list[str], *order: Column) -> DataFrame:
    """base with cols overwritten by new where new has a value for the key: the last in ``order`` that isn't NULL."""
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]) if order else F.struct(F.lit(0))
    one = new.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"__{c}") for c in cols])
    out = base.join(one, keys, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return out


def fallback_lookup(df: DataFrame, source: DataFrame, exact: list[str], loose: list[str], value: str) -> DataFrame:
    """value from source by the exact keys, else by the loose ones; the largest of several."""
    a = source.groupBy(*exact).agg(F.max(value).alias("__a"))
    b = source.groupBy(*loose).agg(F.max(value).alias("__b"))
    return df.join(a, exact, "left").join(b, loose, "left").withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")
