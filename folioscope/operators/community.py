"""Communities: components, ground truth, goodness, pair performance, shortest paths."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.common import cut


def least_labels(edges: DataFrame, by: list[str], a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(by…, id, component): connected components within each value of by, by least labels until nothing changes.

    Labels jump to their labels' labels, so the rounds grow with the logarithm of a component's breadth."""
    both = edges.select(*by, F.col(a).alias("x"), F.col(b).alias("y"))
    both = cut(both.unionByName(both.select(*by, F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    label = both.groupBy(*by, "x").agg(F.least(F.min("y"), F.first("x")).alias("l")).withColumnRenamed("x", "id")
    label = cut(label, "label")
    for _ in range(most_rounds):
        near = both.join(label.withColumnRenamed("id", "y"), [*by, "y"]).groupBy(*by, "x").agg(F.min("l").alias("m")).withColumnRenamed("x", "id")
        step = label.join(near, [*by, "id"]).select(*by, "id", "l", F.least("l", "m").alias("n"))
        jump = label.select(*by, F.col("id").alias("n"), F.col("l").alias("nn"))
        new = cut(step.join(jump, [*by, "n"], "left").select(*by, "id", "l", F.coalesce("nn", "n").alias("n")), "label")
        changed = not new.filter("n <> l").isEmpty()
        label = new.select(*by, "id", F.col("n").alias("l"))
        if not changed:
            break
    return label.withColumnRenamed("l", "component")


def inner_degree(edges: DataFrame, members: DataFrame) -> DataFrame:
    """members(venue_id, id, component), edges(venue_id, a, b) → members with the number of neighbours in their own
    component (inner) and of all neighbours (degree)."""
    ends = edges.select("venue_id", F.col("a").alias("id"), F.col("b").alias("o")).unionByName(edges.select("venue_id", F.col("b").alias("id"), F.col("a").alias("o"))).distinct()
    other = members.select("venue_id", F.col("id").alias("o"), F.col("component").alias("oc"))
    x = members.join(ends, ["venue_id", "id"], "left").join(other, ["venue_id", "o"], "left")
    return x.groupBy("venue_id", "id", "component").agg(F.count("o").alias("degree"), F.coalesce(F.sum((F.col("oc") == F.col("component")).cast("long")), F.lit(0)).alias("inner"))


def ground_truth(edges: DataFrame, smallest: int = 3) -> DataFrame:
    """Components of at least so many members with their size, density and FOMD: the share of members whose degree
    inside exceeds the median degree of the venue."""
    members = least_labels(edges, ["venue_id"])
    deg = cut(inner_degree(edges, members), "degrees")
    mid = deg.groupBy("venue_id").agg(F.median("degree").alias("mid"))
    x = deg.join(F.broadcast(mid), "venue_id").groupBy("venue_id", "component").agg(
        F.count(F.lit(1)).alias("size"), F.avg((F.col("inner") > F.col("mid")).cast("double")).alias("fomd"), (F.sum("inner") / 2).alias("links")
    )
    n = F.col("size")
    return x.filter(n >= smallest).select("venue_id", "component", "size", F.round("fomd", 6).alias("fomd"), F.round(2 * F.col("links") / (n * (n - 1)), 6).alias("density"))


def triangles(edges: DataFrame) -> DataFrame:
    """(venue_id, x, y, z): each triangle of links once. Links run from nodes of low to nodes of high degree (ties by id),
    so that no hub is the middle of more paths than its links allow: a node has at most sqrt(2·links) links upwards."""
    e = edges.select("venue_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    ends = e.select("venue_id", F.col("a").alias("id")).unionByName(e.select("venue_id", F.col("b").alias("id")))
    deg = ends.groupBy("venue_id", "id").agg(F.count(F.lit(1)).alias("d"))
    of = lambda c: deg.select("venue_id", F.col("id").alias(c), F.struct("d", "id").alias(f"d{c}"))
    up = e.join(of("a"), ["venue_id", "a"]).join(of("b"), ["venue_id", "b"])
    low = F.col("da") < F.col("db")
    up = cut(up.select("venue_id", F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y")), "up")
    two = up.join(up.select("venue_id", "x", F.col("y").alias("z")), ["venue_id", "x"]).filter("y <> z")
    return two.join(up.select("venue_id", F.col("x").alias("y"), F.col("y").alias("z")), ["venue_id", "y", "z"], "left_semi")


def transitivity(edges: DataFrame) -> DataFrame:
    """(venue_id, triangles, transitivity): three times the triangles over the connected triples."""
    e = edges.select("venue_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    deg = e.select("venue_id", F.col("a").alias("id")).unionByName(e.select("venue_id", F.col("b").alias("id"))).groupBy("venue_id", "id").agg(F.count(F.lit(1)).alias("d"))
    triples = deg.groupBy("venue_id").agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("triples"))
    tri = triangles(edges).groupBy("venue_id").agg(F.count(F.lit(1)).alias("triangles"))
    return triples.join(tri, "venue_id", "left").select(
        "venue_id", F.coalesce("triangles", F.lit(0)).alias("triangles"), F.when(F.col("triples") > 0, F.round(3 * F.coalesce("triangles", F.lit(0)) / F.col("triples"), 6)).otherwise(F.lit(0.0)).alias("transitivity")
    )


def separability(edges: DataFrame, members: DataFrame) -> DataFrame:
    """members(id, community) over edges(a, b): links inside over links that leave (links inside if none leave)."""
    ca, cb = members.select(F.col("id").alias("a"), F.col("community").alias("ca")), members.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    x = edges.select("a", "b").distinct().join(ca, "a", "left").join(cb, "b", "left")
    inside = x.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("ms"))
    out = x.filter("ca is not null and (cb is null or ca <> cb)").select(F.col("ca").alias("community")).unionByName(x.filter("cb is not null and (ca is null or ca <> cb)").select(F.col("cb").alias("community")))
    out = out.groupBy("community").agg(F.count(F.lit(1)).alias("cs"))
    base = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    y = base.join(inside, "community", "left").join(out, "community", "left").fillna(0, ["ms", "cs"])
    return y.select("community", "size", "ms", "cs", F.when(F.col("cs") > 0, F.round(F.col("ms") / F.col("cs"), 6)).otherwise(F.col("ms").cast("double")).alias("separability"))


def min_cut(pdf: pd.DataFrame) -> int:
    """Least number of links whose removal parts a small graph (columns a, b), by Stoer and Wagner."""
    nodes = sorted(set(pdf["a"]) | set(pdf["b"]))
    w: dict = {v: {} for v in nodes}
    for a, b in set(map(tuple, map(sorted, zip(pdf["a"], pdf["b"], strict=True)))):
        if a != b:
            w[a][b] = w[a].get(b, 0) + 1
            w[b][a] = w[a][b]
    best = None
    while len(w) > 1:
        start = next(iter(w))
        weight = {v: w[start].get(v, 0) for v in w if v != start}
        order = [start]
        while weight:
            v = max(weight, key=lambda x: (weight[x], -nodes.index(x)))
            last = weight.pop(v)
            order.append(v)
            for u, c in w[v].items():
                if u in weight:
                    weight[u] += c
        best = last if best is None else min(best, last)
        s, t = order[-2], order[-1]
        for u, c in w.pop(t).items():
            w[u].pop(t, None)
            if u != s:
                w[s][u] = w[s].get(u, 0) + c
                w[u][s] = w[s][u]
    return int(best or 0)


def cohesiveness(edges: DataFrame, by: str) -> DataFrame:
    """The least cut of each community's own graph; communities are small (a task holds one)."""
    kind = edges.schema[by].dataType.simpleString()
    return edges.select(by, "a", "b").groupBy(by).applyInPandas(lambda pdf: pd.DataFrame({by: [pdf[by].iloc[0]], "min_cut": [min_cut(pdf)]}), f"{by} {kind}, min_cut int")


def member_pairs(members: DataFrame, cluster: str, node: str) -> DataFrame:
    """Distinct pairs a < b that share a cluster. Clusterings are compared by pairs, so their number is the result."""
    x = members.select(F.col(cluster).alias("k"), F.col(node).alias("a")).distinct()
    return x.join(x.select("k", F.col("a").alias("b")), "k").filter("a < b").select("a", "b").distinct()


def pair_performance(actual: DataFrame, predicted: DataFrame, n_nodes: int) -> DataFrame:
    """Precision, recall, F1 and accuracy of predicted pairs(a, b) against actual ones."""
    both = actual.select("a", "b").withColumn("x", F.lit(1)).join(predicted.select("a", "b").withColumn("y", F.lit(1)), ["a", "b"], "full_outer")
    s = both.agg(
        F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("tp"),
        F.count(F.when(F.col("x").isNull(), 1)).alias("fp"),
        F.count(F.when(F.col("y").isNull(), 1)).alias("fn"),
    )
    tn = F.lit(n_nodes * (n_nodes - 1) // 2) - F.col("tp") - F.col("fp") - F.col("fn")
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    return s.select("tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), ratio(F.col("tp") + tn, F.lit(n_nodes * (n_nodes - 1) // 2)).alias("accuracy"))


def hops(edges: DataFrame, source: int, most: int | None = None) -> DataFrame:
    """(id, hops): breadth-first distance from source over undirected edges(a, b), until nobody new is reached, or up to
    ``most`` steps."""
    both = cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "edges")
    seen = both.sparkSession.createDataFrame([(source, 0)], "id long, hops int")
    front = seen
    for k in count(1) if most is None else range(1, most + 1):
        front = cut(both.join(front, both.x == front.id).select(F.col("y").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(k)), "front")
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front), "seen")
    return seen


def paths(edges: DataFrame, source: int, most: int | None = None) -> DataFrame:
    """(id, hops, path): a shortest path from source to each node that can be reached over edges(src, dst), as ids joined
    by '-'; of several the one whose last steps have the least ids. The source has 0 hops."""
    e = cut(edges.select("src", "dst").distinct(), "edges")
    seen = e.sparkSession.createDataFrame([(source, 0, str(source))], "id long, hops int, path string")
    front = seen
    for k in count(1) if most is None else range(1, most + 1):
        step = e.join(front, e.src == front.id).groupBy(F.col("dst").alias("id")).agg(F.min_by("path", "src").alias("path"))
        step = step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(k).alias("hops"), F.concat_ws("-", "path", F.col("id").cast("string")).alias("path"))
        front = cut(step, "front")
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front), "seen")
    return seen


def adjacency_offsets(edges: DataFrame) -> DataFrame:
    """Compressed sparse rows: (node, targets as text, degree, offset), loops left out, nodes by rising id.

    The running sum goes over one row a node in two levels - blocks of ids first - so no task holds all nodes."""
    e = edges.filter("src <> dst").groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("t")).select(F.col("src").alias("node"), F.array_join("t", " ").alias("targets"), F.size("t").cast("long").alias("degree"))
    b = e.withColumn("blk", F.floor(F.col("node") / 4096))
    blocks = b.groupBy("blk").agg(F.sum("degree").alias("d"))
    before = blocks.withColumn("base", F.coalesce(F.sum("d").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("d")
    within = F.coalesce(F.sum("degree").over(Window.partitionBy("blk").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return b.join(before, "blk").withColumn("offset", F.col("base") + within).select("node", "targets", "degree", "offset")
