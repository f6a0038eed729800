"""Connected components of an edge table, by least labels and pointer jumping; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, root): the least id of the component of each id that has an edge. Loops and repeated edges do no harm."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    both = cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    label = cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(label, both.y == label.id).groupBy("x").agg(F.min("root").alias("m"))
        new = label.join(near, label.id == near.x).select("id", F.least("root", "m").alias("r"), F.col("root").alias("old"))
        up = label.select(F.col("id").alias("r"), F.col("root").alias("rr"))
        new = cut(new.join(up, "r", "left").select("id", F.least("r", F.coalesce("rr", "r")).alias("root"), "old"), "labels")
        changed = not new.filter("root <> old").isEmpty()
        label = new.select("id", "root")
        if not changed:
            return label
    raise RuntimeError("components did not settle")
