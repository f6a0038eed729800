"""Non-parametric statistics: effect size, positional quantiles, bootstrap, Scott-Knott."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def a12(df: DataFrame, group: str, value: str, first: str, second: str, by: list[str] | None = None) -> DataFrame:
    """Probability that a value of the first group exceeds one of the second, ties half: from mean ranks in one sort.

    Values are counted before they are ranked, so equal values are one row however many there are."""
    by = by or []
    c = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum((F.col(group) == first).cast("long")).alias("x"), F.sum((F.col(group) == second).cast("long")).alias("y"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("y").over(w), F.lit(0))
    part = c.withColumn("wins", F.col("x") * (below + F.col("y") / 2))
    s = part.groupBy(*by).agg(F.sum("wins").alias("wins"), F.sum("x").alias("n"), F.sum("y").alias("m"))
    return s.select(*by, F.when((F.col("n") > 0) & (F.col("m") > 0), F.round(F.col("wins") / (F.col("n") * F.col("m")), 6)).alias("a12"))


def positional(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles and quintiles by position in the sorted values (not interpolated), and the spread xs[.75n]-xs[.25n]."""
    w = Window.partitionBy(*by).orderBy(value)
    r = df.filter(F.col(value).isNotNull()).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    q, t = F.floor(F.col("n") * 0.25), F.floor(F.col("n") * 0.1)
    at = lambda k: F.max(F.when(F.col("i") == k, F.col(value)))
    return r.groupBy(*by).agg(
        at(q).alias("q1"), at(2 * q).alias("q2"), at(3 * q).alias("q3"), at(t).alias("p10"), at(3 * t).alias("p30"), at(5 * t).alias("p50"), at(7 * t).alias("p70"), at(9 * t).alias("p90"), (at(F.floor(F.col("n") * 0.75)) - at(q)).alias("spread")
    )


def bootstrap(y: np.ndarray, z: np.ndarray, conf: float = 0.05, b: int = 1000, seed: int = 1) -> bool:
    """Whether z exceeds y by more than resampling explains. The statistic divides by standard deviations over n."""
    y, z = np.asarray(y, float), np.asarray(z, float)
    if len(y) < 2 or len(z) < 2:
        return False

    def stat(a: np.ndarray, c: np.ndarray) -> np.ndarray:
        s = a.std(axis=-1, ddof=1) / a.shape[-1] + c.std(axis=-1, ddof=1) / c.shape[-1]
        d = c.mean(axis=-1) - a.mean(axis=-1)
        return np.where(s > 0, d / np.sqrt(np.maximum(s, 1e-300)), d)

    rng = np.random.default_rng(seed)
    mean = np.concatenate([y, z]).mean()
    seen = stat(y[None, :], z[None, :])[0]
    y0, z0 = y - y.mean() + mean, z - z.mean() + mean
    above, step = 0, max(1, min(b, 2_000_000 // max(len(y), len(z))))
    for k in range(0, b, step):
        m = min(step, b - k)
        above += int((stat(rng.choice(y0, (m, len(y))), rng.choice(z0, (m, len(z)))) > seen).sum())
    return above / b < conf


def _effect(x: np.ndarray, y: np.ndarray) -> float:
    s = np.sort(y)
    return float((np.searchsorted(s, x, "left") + np.searchsorted(s, x, "right")).sum() / (2 * len(x) * len(y)))


def scott_knott(groups: dict[str, list[float]], seed: int = 1, few: int = 3, small: float = 0.01) -> list[tuple[str, int, float, float]]:
    """(name, rank, median, spread): groups by rising median, split where the means of both sides differ most, as long
    as the split is real (effect size, then bootstrap); equal ranks can't be told apart."""
    items = sorted(((k, np.sort(np.asarray(v, float))) for k, v in groups.items() if len(v)), key=lambda x: (np.median(x[1]), x[0]))
    rank: dict[str, int] = {}

    def split(part: list, r: int) -> int:
        best, at = -1.0, None
        all_ = np.concatenate([v for _, v in part])
        for k in range(1, len(part)):
            a, b = np.concatenate([v for _, v in part[:k]]), np.concatenate([v for _, v in part[k:]])
            if len(a) <= few or len(b) <= few or abs(np.median(b) - np.median(a)) <= small:
                continue
            gain = len(a) / len(all_) * (a.mean() - all_.mean()) ** 2 + len(b) / len(all_) * (b.mean() - all_.mean()) ** 2
            if gain > best and _effect(b, a) > 0 and bootstrap(a, b, seed=seed):
                best, at = gain, k
        if at is None:
            for k, _ in part:
                rank[k] = r
            return r
        return split(part[at:], split(part[:at], r) + 1)

    if items:
        split(items, 1)
    spread = lambda v: float(v[int(0.75 * len(v))] - v[int(0.25 * len(v))]) if len(v) > 2 else float(v[-1] - v[0])
    return [(k, rank[k], float(np.median(v)), spread(v)) for k, v in items]


def scott_knott_by(df: DataFrame, treatment: str, value: str, by: list[str]) -> DataFrame:
    """Scott-Knott ranks of the treatments within each report group, one task a group."""
    keys = {f.name: f.dataType.simpleString() for f in df.schema if f.name in by}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = scott_knott({k: g[value].tolist() for k, g in pdf.groupby(treatment)})
        out = pd.DataFrame(got, columns=[treatment, "rank", "median", "spread"])
        for k in by:
            out[k] = pdf[k].iloc[0]
        return out[[*by, treatment, "rank", "median", "spread"]]

    schema = ", ".join(f"{k} {v}" for k, v in keys.items()) + f", {treatment} string, rank int, median double, spread double"
    return df.select(*by, treatment, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull() & F.col(treatment).isNotNull()).groupBy(*by).applyInPandas(run, schema)


def bootstrap_by(df: DataFrame, group: str, value: str, first: str, second: str, by: list[str]) -> DataFrame:
    """Whether the second group's values exceed the first's, within each report group."""
    keys = {f.name: f.dataType.simpleString() for f in df.schema if f.name in by}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, z = (pdf.loc[pdf[group] == g, value].to_numpy(float) for g in (first, second))
        out = {k: [pdf[k].iloc[0]] for k in by}
        real = bool(len(y) and len(z) and _effect(z, y) > 0 and bootstrap(y, z))
        return pd.DataFrame(out | {"n_first": [len(y)], "n_second": [len(z)], "different": [real]})

    schema = ", ".join(f"{k} {v}" for k, v in keys.items()) + ", n_first long, n_second long, different boolean"
    return df.select(*by, group, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by).applyInPandas(run, schema)
