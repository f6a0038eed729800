"""Filling containers of fixed capacity with texts: best-two-fit.

A container is filled greedily with the largest text that still fits; then its smallest text gives way to two unpacked
texts that fill the widened gap more tightly, for as long as that helps. A text is only split if it alone exceeds the
capacity: into full containers, and a rest that is packed like any other text.

Sizes are whole numbers up to the capacity, so a packer works on how many texts of each size are left. Documents are
spread by a hash over shards of about ``SHARD`` texts; each shard and kind of container is packed as one task, and a
shard leaves at most one container poorly filled.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.common import cut
from folioscope.llm import tokens

#: About how many texts one task packs.
SHARD = 40_000
#: A table of container kinds is small by nature; more kinds than this are refused.
MOST_KINDS = 1_000
SCHEMA = "container_kind string, capacity_tokens long, container_id long, doc_id long, part int, tokens long"


class Pool:
    """Unpacked texts by size."""

    def __init__(self, sizes: list[int], capacity: int):
        self.by: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask, self.left = 0, len(sizes)
        for i in range(len(sizes) - 1, -1, -1):
            self.by[sizes[i]].append(i)
            self.mask |= 1 << sizes[i]

    def largest(self, most: int) -> int:
        """The largest size left of at most ``most``; 0 if none is."""
        return max(0, (self.mask & ((2 << most) - 1)).bit_length() - 1) if most > 0 else 0

    def take(self, size: int) -> int:
        i = self.by[size].pop()
        if not self.by[size]:
            self.mask &= ~(1 << size)
        self.left -= 1
        return i

    def put(self, size: int, i: int) -> None:
        self.by[size].append(i)
        self.mask |= 1 << size
        self.left += 1

    def pair(self, gap: int, more_than: int) -> tuple[int, int] | None:
        """Two sizes left of the largest sum up to ``gap``, if that is above ``more_than``."""
        best, found = more_than, None
        a = self.largest(gap - 1)
        while a * 2 > best:
            b = self.largest(min(a, gap - a))
            if b == a and len(self.by[a]) < 2:
                b = self.largest(a - 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == gap:
                    break
            a = self.largest(a - 1)
        return found


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions in sizes; every size is from 1 to capacity."""
    pool, out = Pool(sizes, capacity), []
    while pool.left:
        inside: list[tuple[int, int]] = []
        gap = capacity
        while s := pool.largest(gap):
            inside.append((s, pool.take(s)))
            gap -= s
        while gap and len(inside) > 0 and pool.left > 1:
            s, i = inside[-1]  # the smallest: they were put in by falling size
            two = pool.pair(gap + s, s)
            if two is None:
                break
            inside.pop()
            for x in two:
                inside.append((x, pool.take(x)))
            pool.put(s, i)
            inside.sort(reverse=True)
            gap = capacity - sum(x for x, _ in inside)
        out.append([i for _, i in inside])
    return out


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard for one kind of container."""
    kind, cap, shard = pdf["container_kind"].iloc[0], int(pdf["capacity_tokens"].iloc[0]), int(pdf["shard"].iloc[0])
    pdf = pdf.sort_values("doc_id")
    rows, items, at = [], [], 0
    # capacities of one kind have ids of their own
    base = (int(pdf["nth"].iloc[0]) << 52) + (shard << 32)
    empty = []
    for doc, n in zip(pdf["doc_id"].tolist(), pdf["tokens"].tolist(), strict=True):
        part = 0
        while n > cap:
            rows.append((kind, cap, base + at, doc, part, cap))
            at, part, n = at + 1, part + 1, n - cap
        if n:
            items.append((n, doc, part))
        elif not part:
            empty.append(doc)
    for box in pack([n for n, _, _ in items], cap):
        rows.extend((kind, cap, base + at, items[i][1], items[i][2], items[i][0]) for i in box)
        at += 1
    # texts of no size need no room: they lie in the shard's first container
    rows.extend((kind, cap, base, doc, 0, 0) for doc in empty)
    return pd.DataFrame(rows, columns=["container_kind", "capacity_tokens", "container_id", "doc_id", "part", "tokens"])


def assign(documents: DataFrame, containers: DataFrame, shard: int = SHARD, path: str | None = None) -> DataFrame:
    """Every text in a container of each kind (SCHEMA). part counts the pieces of a split text from 0.

    NULL and empty texts have size 0. Repeated doc_ids are texts of their own. Containers without a positive capacity
    hold nothing; of several capacities of a kind each has containers of its own."""
    kinds = containers.filter("container_kind is not null and capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity_tokens")).distinct().limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    sized = cut(tokens.sizes(documents.filter("doc_id is not null"), path=path), "sizes")
    n = sized.count()
    shards = max(1, math.ceil(n / shard))
    nth = {(r.container_kind, r.capacity_tokens): sum(o.container_kind == r.container_kind and o.capacity_tokens < r.capacity_tokens for o in kinds) for r in kinds}
    each = [F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity_tokens"), F.lit(i).alias("nth")) for (k, c), i in nth.items()]
    if not each:
        return sized.sparkSession.createDataFrame([], SCHEMA)
    spread = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("long")).select("*", F.explode(F.array(*each)).alias("c")).select("doc_id", "tokens", "shard", "c.*")
    return spread.groupBy("container_kind", "capacity_tokens", "shard").applyInPandas(_shard, SCHEMA)


def summary(assigned: DataFrame) -> DataFrame:
    """Per kind and capacity: containers, pieces, cuts, tokens, room and the share of it that is unused."""
    by = ["container_kind", "capacity_tokens"]
    boxes = assigned.groupBy(*by, "container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.sum((F.col("part") > 0).cast("long")).alias("cuts"))
    return (
        boxes.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("containers"),
            F.sum("n").alias("pieces"),
            F.sum("cuts").alias("cuts"),
            F.sum("t").alias("tokens"),
            F.sum("capacity_tokens").alias("room"),
            F.max("t").alias("fullest"),
        )
        .withColumn("unused_share", F.round(1 - F.col("tokens") / F.col("room"), 6))
    )
