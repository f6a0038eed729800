"""References to records that do not exist, kept as keyed state that is maintained incrementally.

State (all tables keyed by reference column and key):

* ``parents``: when each target first came in and when it was withdrawn - the parent index;
* ``seen``: the references that came in so far, so that a second delivery is no new reference;
* ``pending``: the references that have no live target now.

A step takes the references, arrivals and withdrawals of one slice of time: new references probe the parent index,
arriving parents resolve waiting orphans, withdrawals reopen the references to them. Each step yields its transitions
(opened, resolved, reopened) and a snapshot of the pending counts. How finely time is sliced changes no result.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.common import cut, hot_keys, skew_join
from folioscope.operators.unpack import unpack

REFS = "src_field string, paper_id long, ref_key string, came_at timestamp"
PARENTS = "src_field string, ref_key string, first_at timestamp, deleted_at timestamp"
KEYS = ["src_field", "ref_key"]
REF_COLS = ["src_field", "paper_id", "ref_key", "came_at"]


@dataclass
class State:
    parents: DataFrame
    seen: DataFrame
    pending: DataFrame
    #: What the last step added to seen.
    added: DataFrame | None = None


def empty_state(spark: SparkSession) -> State:
    return State(spark.createDataFrame([], PARENTS), spark.createDataFrame([], REFS), spark.createDataFrame([], REFS))


def _live(t: Column) -> Column:
    """Whether the target is live at t; never NULL."""
    return F.coalesce((F.col("first_at") <= t) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > t)), F.lit(False))


def merge_parents(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row a key: the earliest arrival; withdrawn only if every delivery says so, at the latest of their times."""
    return (
        old.unionByName(new)
        .groupBy(*KEYS)
        .agg(
            F.min("first_at").alias("first_at"),
            F.when(F.max(F.col("deleted_at").isNull()), F.lit(None)).otherwise(F.max("deleted_at")).cast("timestamp").alias("deleted_at"),
        )
    )


def _probe(refs: DataFrame, index: DataFrame, hot: DataFrame | None, how: str) -> DataFrame:
    return skew_join(refs, index, KEYS, how, hot)


def step(state: State, refs: DataFrame, arrivals: DataFrame, start: str | None, end: str | None, hot: DataFrame | None = None) -> tuple[State, DataFrame]:
    """One slice of time, from ``start`` to before ``end`` (NULL: without limit).

    refs(REFS) and arrivals(PARENTS) came in during the slice; withdrawals are those of the index that fall into it.
    Returns the next state and the transitions (src_field, paper_id, ref_key, came_at, event, at)."""
    lo = F.lit(start or "0001-01-01 00:00:00").cast("timestamp")
    hi = F.lit(end or "9999-12-31 00:00:00").cast("timestamp")
    arrived = merge_parents(arrivals.limit(0), arrivals)
    index = cut(merge_parents(state.parents, arrivals), "parents")
    new = refs.filter("ref_key is not null").groupBy("src_field", "paper_id", "ref_key").agg(F.min("came_at").alias("came_at"))
    known = state.seen.select("src_field", F.coalesce("paper_id", F.lit(-1)).alias("__p"), "ref_key")
    new = new.withColumn("__p", F.coalesce("paper_id", F.lit(-1))).join(known, ["src_field", "__p", "ref_key"], "left_anti").drop("__p")
    probed = cut(_probe(new.select(*REF_COLS), index, hot, "left"), "probed")
    seen = state.seen.unionByName(probed.select(*REF_COLS))
    waiting = _probe(state.pending, arrived, hot, "left")
    back = cut(_probe(seen, index.filter((F.col("deleted_at") >= lo) & (F.col("deleted_at") < hi)), hot, "inner"), "back")
    back = back.filter(F.col("deleted_at") > F.greatest("came_at", "first_at"))

    def event(df: DataFrame, name: str, at: str) -> DataFrame:
        return df.select(*REF_COLS, F.lit(name).alias("event"), F.col(at).alias("at"))

    comes = (F.col("first_at") > F.col("came_at")) & (F.col("first_at") >= lo) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("first_at")))
    # a parent that is delivered late, with an arrival before this slice, resolves what waits for it when it is learnt of
    since = F.greatest("first_at", "came_at", lo)
    settled = waiting.withColumn("learnt", since).filter(F.col("first_at").isNotNull() & (F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("learnt"))))
    events = (
        event(probed.filter(~_live(F.col("came_at"))), "opened", "came_at")
        .unionByName(event(probed.filter(comes), "resolved", "first_at"))
        .unionByName(event(settled, "resolved", "learnt"))
        .unionByName(event(back, "reopened", "deleted_at"))
    )
    still = [x.filter(~_live(hi)).select(*REF_COLS) for x in (waiting, probed, back)]
    pending = still[0].unionByName(still[1]).unionByName(still[2]).distinct()
    return State(index, seen, cut(pending, "pending"), probed.select(*REF_COLS)), events


def maintain(refs: DataFrame, parents: DataFrame, slices: int = 3) -> tuple[State, DataFrame, DataFrame]:
    """Run all of refs and parents through steps of equal stretches of time.

    Returns the last state, all transitions, and a snapshot (until, src_field, pending) after each step."""
    spark = refs.sparkSession
    refs, parents = cut(refs, "refs"), cut(parents, "targets")
    hot = cut(hot_keys(refs, KEYS), "hot")
    a, b = refs.agg(F.min(F.unix_micros("came_at")), F.max(F.unix_micros("came_at"))).first()
    # the bounds are written in UTC, whatever the session's time zone
    at = [datetime.fromtimestamp((a + (b - a) * i / slices) / 1e6, UTC).strftime("%Y-%m-%d %H:%M:%S.%f+00:00") for i in range(1, slices)] if a is not None else []
    bounds = [None, *at, None]
    state, events, shots = empty_state(spark), None, None
    for lo, hi in zip(bounds, bounds[1:], strict=False):

        def within(df: DataFrame, c: str, lo=lo, hi=hi) -> DataFrame:
            ok = F.lit(True)
            if lo is not None:
                ok = ok & (F.col(c) >= F.lit(lo).cast("timestamp"))
            if hi is not None:
                ok = ok & (F.col(c) < F.lit(hi).cast("timestamp"))
            return df.filter(ok)

        state, e = step(state, within(refs, "came_at"), within(parents, "first_at"), lo, hi, hot)
        shot = state.pending.groupBy("src_field").agg(F.count(F.lit(1)).alias("pending")).select(F.lit(hi).cast("timestamp").alias("until"), "src_field", "pending")
        events = e if events is None else events.unionByName(e)
        shots = shot if shots is None else shots.unionByName(shot)
    return state, events, shots


def references(papers: DataFrame, authorship: DataFrame) -> DataFrame:
    """Every reference with the time it came in (REFS): cites of papers and person ids of authorship. NULL is none."""
    first = papers.groupBy("paper_id").agg(F.min("loaded_at").alias("came_at"))
    cites = unpack(papers, "paper_id", "cites").select("paper_id", F.col("item").alias("ref_key")).distinct()
    cites = cites.join(first, "paper_id").select(F.lit("papers.cites").alias("src_field"), "paper_id", "ref_key", "came_at")
    people = (
        authorship.filter("person_id is not null")
        .groupBy("paper_id", "person_id")
        .agg(F.min("loaded_at").alias("came_at"))
        .select(F.lit("authorship.person_id").alias("src_field"), "paper_id", F.col("person_id").cast("string").alias("ref_key"), "came_at")
    )
    return cites.unionByName(people)


def targets(papers: DataFrame, persons: DataFrame) -> DataFrame:
    """Every record that a reference may point to (PARENTS); rows without a key are no targets."""
    p = papers.filter("ref_id is not null").select(F.lit("papers.cites").alias("src_field"), F.col("ref_id").alias("ref_key"), F.col("loaded_at").alias("first_at"), "deleted_at")
    q = persons.filter("person_id is not null").select(
        F.lit("authorship.person_id").alias("src_field"), F.col("person_id").cast("string").alias("ref_key"), F.col("loaded_at").alias("first_at"), "deleted_at"
    )
    both = p.unionByName(q)
    return merge_parents(both.limit(0), both)


def transitions(papers: DataFrame, persons: DataFrame, authorship: DataFrame, slices: int = 3) -> DataFrame:
    return maintain(references(papers, authorship), targets(papers, persons), slices)[1]


def orphans(papers: DataFrame, persons: DataFrame, authorship: DataFrame, slices: int = 3) -> DataFrame:
    """(src_field, paper_id, ref_key, came_at) of every reference that had no live target when it came in."""
    return transitions(papers, persons, authorship, slices).filter("event = 'opened'").select(*REF_COLS)
