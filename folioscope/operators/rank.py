"""Rankings of authors: contributions, h-index, PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.common import cut


def contributions(slots: DataFrame, harmonic: bool = True, weighted: bool = False) -> DataFrame:
    """(person_id, score): each paper gives 1 in all (times citations + 1 where weighted), shared alike or by 1/pos."""
    of_paper = Window.partitionBy("paper_id")
    each = F.lit(1.0) / F.col("pos") if harmonic else F.lit(1.0)
    share = each / F.sum(each).over(of_paper)
    if weighted:
        share = share * (F.coalesce("cited_count", F.lit(0)) + 1)
    return slots.withColumn("s", share).groupBy("person_id").agg(F.round(F.sum("s"), 6).alias("score"))


def h_index(slots: DataFrame, compat: bool = False) -> DataFrame:
    """(person_id, h). compat counts from 0 and stops at the first place that exceeds its citations, 0 if none does."""
    w = Window.partitionBy("person_id").orderBy(F.desc("c"), "paper_id")
    r = slots.select("person_id", "paper_id", F.coalesce("cited_count", F.lit(0)).alias("c")).withColumn("i", F.row_number().over(w))
    if compat:
        return r.groupBy("person_id").agg(F.coalesce(F.min(F.when(F.col("i") - 1 > F.col("c"), F.col("i") - 1)), F.lit(0)).cast("int").alias("h"))
    return r.groupBy("person_id").agg(F.coalesce(F.max(F.when(F.col("c") >= F.col("i"), F.col("i"))), F.lit(0)).cast("int").alias("h"))


def collaborations(authorship: DataFrame) -> DataFrame:
    """(a, b, cnt): pairs of people with a < b and the number of papers they share; theta-join within a paper."""
    x = authorship.select("paper_id", F.col("person_id").alias("a"))
    y = authorship.select("paper_id", F.col("person_id").alias("b"))
    return x.join(y, "paper_id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("cnt"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "cnt").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "cnt"))


def degree(edges: DataFrame) -> DataFrame:
    """(id, divisor): the number of collaborators of each node."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").cast("double").alias("divisor"))


def scaled_row_sum(edges: DataFrame) -> DataFrame:
    """(id, divisor): row sums of the link matrix whose columns are scaled to 0..1 (their minimum is 0: nobody is linked
    to oneself)."""
    most = edges.groupBy("dst").agg(F.max("cnt").alias("most"))
    return edges.join(most, "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("cnt") / F.col("most")).alias("divisor"))


def page_ranks(
    edges: DataFrame,
    nodes: DataFrame,
    damps: list[float],
    iterations: int,
    kinds: dict[str, tuple[DataFrame | None, DataFrame | None]],
    scaled: bool = True,
    every: int = 4,
) -> DataFrame:
    """(kind, id, damp, score): synchronous PageRank over edges(src, dst, cnt), several kinds and damping values at once.

    A kind is (weights, divisor). Scores start at 1/n. A node gives each neighbour its score over its divisor(id, divisor),
    the number of its neighbours unless given; the teleport is 1/n, or a node's share of weights(id, weight). Scores of a
    kind and damping value are scaled to a maximum of 1 after every round if ``scaled``. All of them
    are carried along together, so a round is one join whatever their number. Rounds are written, so plans stay short and a lost executor costs the
    rounds since. Nodes without edges keep the teleport; an empty table gives an empty result."""
    n = max(nodes.count(), 1)
    pairs = edges.select("src", "dst").distinct()
    own = degree(edges)
    base, divisors = nodes, None
    for i, (weights, divisor) in enumerate(kinds.values()):
        if weights is None:
            base = base.withColumn(f"t{i}", F.lit(1.0 / n))
        else:
            total = float(nodes.join(weights, "id").agg(F.sum("weight")).first()[0] or 1)
            base = base.join(weights.select("id", (F.col("weight") / F.lit(total)).alias(f"t{i}")), "id", "left").fillna(0.0, [f"t{i}"])
        d = (divisor if divisor is not None else own).select("id", F.col("divisor").alias(f"v{i}"))
        divisors = d if divisors is None else divisors.join(d, "id")
    vs = F.array(*[F.col(f"v{i}") for i in range(len(kinds))])
    moves = cut(pairs.join(divisors, pairs.src == divisors.id).select("src", "dst", vs.alias("vs")), "moves")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(d)).alias("damp")) for i in range(len(kinds)) for d in damps]))
    ts = F.array(*[F.col(f"t{i}") for i in range(len(kinds))])
    base = cut(base.select("id", ts.alias("ts"), each.alias("e")).select("id", "e.i", "e.damp", F.get("ts", F.col("e.i")).alias("t")), "base")
    scores = base.select("id", "i", "damp", F.lit(1.0 / n).alias("s"))
    for r in range(iterations):
        got = moves.join(scores, moves.src == scores.id).groupBy(F.col("dst").alias("id"), "i", "damp").agg(F.sum(F.col("s") / F.get("vs", F.col("i"))).alias("in"))
        raw = base.join(got, ["id", "i", "damp"], "left").select("id", "i", "damp", ((1 - F.col("damp")) * F.col("t") + F.col("damp") * F.coalesce("in", F.lit(0.0))).alias("s"))
        if scaled or (r + 1) % every == 0:
            raw = cut(raw, "rank")
        if scaled:
            top = raw.groupBy("i", "damp").agg(F.max("s").alias("top"))  # one row a kind and damping value
            raw = raw.join(F.broadcast(top), ["i", "damp"]).select("id", "i", "damp", (F.col("s") / F.col("top")).alias("s"))
        scores = raw
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), F.col("i"))
    return scores.select(kind.alias("kind"), "id", "damp", F.col("s").alias("score"))


def page_rank(
    edges: DataFrame, nodes: DataFrame, damps: list[float], iterations: int = 3, weights: DataFrame | None = None, divisor: DataFrame | None = None, scaled: bool = True
) -> DataFrame:
    """(id, damp, score): page_ranks() of one kind."""
    return page_ranks(edges, nodes, damps, iterations, {"": (weights, divisor)}, scaled).drop("kind")
