"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated weights.

Documents fall into cells of source, language and topic. Raking scales the cells' weights in turn until the tokens they
stand for meet the marginals: the target share of each source, and the corpus's own shares of languages and topics as far
as the named sources allow. No weight exceeds how often its source may be repeated. The size of a mix is the largest at
which no source runs out, unless it is given.

A document of weight w appears floor(w) times, and once more with probability w - floor(w), decided by a hash of its id.
What this leaves of sampling error is taken out by a scale a source, found by bisection over exact sums of tokens: each
pass evaluates many scales in one aggregation, so no source is ever sorted or gathered.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.common import cut
from folioscope.llm import tokens

#: Cells and targets are what the driver rakes; more of either are refused, none is left out.
MOST_CELLS = 500_000
MOST_TARGETS = 100_000
#: Raking ends when no weight moves by more than this share of a repeat, or after so many rounds.
ROUNDS, SETTLED = 500, 1e-6
#: Scales tried a pass, and passes, of the bisection.
GRID, PASSES = 24, 4
#: The widest scales tried; a source that needs another is reported with what it gets.
WIDEST = 16.0


def rake(mass: np.ndarray, cells: list[tuple[int, int, int]], source: np.ndarray, lang: np.ndarray, topic: np.ndarray, cap: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights by cell: mass·weight meets the marginals (in tokens) of source, language and topic; 0 <= weight <= cap.

    The source marginals come last and so are met best; cells whose target is 0 get 0."""
    c = np.array(cells, dtype=int).reshape(len(cells), 3)
    w = np.ones(len(cells))
    for _ in range(rounds):
        before = w
        for axis, target in ((2, topic), (1, lang), (0, source)):
            for _ in range(4 if axis == 0 else 1):  # what a cap holds back goes to the cells below theirs
                now = np.bincount(c[:, axis], weights=mass * w, minlength=len(target))
                ratio = np.divide(target, now, out=np.zeros_like(now), where=now > 0)
                w = np.minimum(w * ratio[c[:, axis]], cap)
        if len(w) == 0 or np.abs(w - before).max() < SETTLED:
            break
    return w


def _cells(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens, source, lang, topic): NULL languages and topics are values of their own."""
    return docs.select("doc_id", "tokens", "source", F.coalesce("lang", F.lit("")).alias("lang"), F.col("venue_id").alias("topic"))


def weights(docs: DataFrame, targets: list, total: float | None = None) -> tuple[list[tuple], dict[tuple[str, str], tuple[float, float]]]:
    """docs(source, lang, topic, tokens), targets: rows of mix_targets.

    Returns (mix_id, source, lang, topic, weight) by cell, and (mix, source) → (target tokens, tokens there are)."""
    rows = docs.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("t")).limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError("too many cells of source, language and topic")
    langs = {x: i for i, x in enumerate(sorted({r.lang for r in rows}))}
    topics = {x: i for i, x in enumerate(sorted({r.topic for r in rows}))}
    all_lang, all_topic = np.zeros(len(langs)), np.zeros(len(topics))
    for r in rows:
        all_lang[langs[r.lang]] += r.t
        all_topic[topics[r.topic]] += r.t
    out, goals = [], {}
    for mix in sorted({t.mix_id for t in targets}):
        own = {t.source: t for t in targets if t.mix_id == mix}
        have = {s: float(sum(r.t for r in rows if r.source == s)) for s in own}
        # a source without documents can't be met; the others keep their shares of the whole
        live = {s: t for s, t in own.items() if have[s] > 0 and (t.target_share or 0) > 0 and (t.max_repeats or 0) > 0}
        size = total if total is not None else min([live[s].max_repeats * have[s] / live[s].target_share for s in live], default=0.0)
        for s, t in own.items():
            goals[mix, s] = ((t.target_share or 0.0) * size, have[s])
        part = [r for r in rows if r.source in live and r.t > 0]
        if not part or not size:
            continue
        names = {s: i for i, s in enumerate(sorted(live))}
        target = np.array([min(live[s].target_share * size, live[s].max_repeats * have[s]) for s in sorted(live)])
        marg = []
        for share, of in ((all_lang, [langs[r.lang] for r in part]), (all_topic, [topics[r.topic] for r in part])):
            there = np.zeros_like(share)
            there[np.unique(of)] = share[np.unique(of)]
            marg.append(there / max(there.sum(), 1e-9) * target.sum())
        w = rake(
            np.array([float(r.t) for r in part]), [(names[r.source], langs[r.lang], topics[r.topic]) for r in part], target, marg[0], marg[1], np.array([float(live[r.source].max_repeats) for r in part])
        )
        out += [(mix, r.source, r.lang, r.topic, float(x), int(live[r.source].max_repeats)) for r, x in zip(part, w, strict=True)]
    return out, goals


def marginals(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(mix_id, dimension, value, corpus_share, actual_share) of the languages and topics of each mix, NULL as its own
    value: how far the sources allow a mix to look like the corpus."""
    sample, _ = mix(documents, targets, path=path)
    keys = documents.filter("doc_id is not null").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce(F.col("venue_id").cast("string"), F.lit("")).alias("topic")).dropDuplicates(["doc_id"])
    size = cut(tokens.sizes(documents.filter("doc_id is not null"), path=path).dropDuplicates(["doc_id"]), "sizes")
    drawn = cut(sample.join(keys, "doc_id"), "drawn")
    out = None
    for dim in ("lang", "topic"):
        part = drawn.groupBy("mix_id", F.col(dim).alias("value")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"))
        whole = part.groupBy("mix_id").agg(F.sum("t").alias("whole"))
        corpus = keys.join(size, "doc_id").groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("c"))
        corpus = corpus.join(F.broadcast(corpus.agg(F.sum("c").alias("all"))), how="cross")
        x = part.join(whole, "mix_id").join(corpus, "value")
        x = x.select("mix_id", F.lit(dim).alias("dimension"), "value", F.round(F.col("c") / F.col("all"), 6).alias("corpus_share"), F.round(F.col("t") / F.col("whole"), 6).alias("actual_share"))
        out = x if out is None else out.unionByName(x)
    return out


def _copies(w: Column, u: Column, most: Column) -> Column:
    return F.least(F.floor(w + u).cast("int"), most)


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The sample (mix_id, doc_id, source, tokens, copies int, copies > 0) and the report (mix_id, source, target_share,
    actual_share, target_tokens, actual_tokens, available_tokens, documents, copies, most_copies).

    doc_id is unique; of rows that share one, one counts.
    NULL sources belong to no mix. NULL or empty texts have no tokens and are never drawn. Sources that are named but
    have no documents report 0; of repeated (mix, source) rows the last in order of share counts. Repeats below 1 draw
    nothing."""
    spark = documents.sparkSession
    goals_in = targets.filter("mix_id is not null and source is not null").dropDuplicates().orderBy("mix_id", "source", "target_share", "max_repeats").limit(MOST_TARGETS + 1).collect()
    if len(goals_in) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    named = {t.source for t in goals_in}
    sized = cut(tokens.sizes(documents.filter("doc_id is not null").withColumn("venue_id", F.coalesce(F.col("venue_id").cast("int"), F.lit(-1))), ["doc_id", "source", "lang", "venue_id"], path=path), "sizes")
    docs = cut(_cells(sized.filter("tokens > 0").dropDuplicates(["doc_id"])), "cells")
    cell_rows, goals = weights(docs, goals_in, total)
    cells = spark.createDataFrame(cell_rows, "mix_id string, source string, lang string, topic int, w double, most int")
    drawn = docs.filter(F.col("source").isin(*named) if named else F.lit(False)).join(F.broadcast(cells), ["source", "lang", "topic"])
    drawn = drawn.withColumn("u", (F.pmod(F.xxhash64("doc_id", "mix_id"), F.lit(1 << 40)) / float(1 << 40)))
    drawn = cut(drawn.select("mix_id", "doc_id", "source", "tokens", "w", "most", "u"), "drawn")
    # bisection: the scale by (mix, source) at which the drawn tokens meet the target
    lo = {k: 1 / WIDEST for k in goals}
    hi = {k: WIDEST for k in goals}
    for step in range(PASSES):
        spaced = np.linspace if step else np.geomspace
        grid = {k: spaced(lo[k], hi[k], GRID) for k in goals}
        steps = spark.createDataFrame([(m, s, [float(x) for x in g]) for (m, s), g in grid.items()], "mix_id string, source string, scales array<double>")
        sums = drawn.join(F.broadcast(steps), ["mix_id", "source"]).groupBy("mix_id", "source")
        got = sums.agg(*[F.sum(F.col("tokens") * _copies(F.col("w") * F.col("scales")[i], F.col("u"), F.col("most"))).alias(f"s{i}") for i in range(GRID)]).collect()
        for r in got:
            k = (r.mix_id, r.source)
            at = [abs(r[f"s{i}"] - goals[k][0]) for i in range(GRID)]
            i = int(np.argmin(at))
            lo[k], hi[k] = float(grid[k][max(0, i - 1)]), float(grid[k][min(GRID - 1, i + 1)])
            goals[k] = (*goals[k][:2], float(grid[k][i]))
    scale = spark.createDataFrame([(m, s, float(g[2]) if len(g) > 2 else 1.0) for (m, s), g in goals.items()], "mix_id string, source string, scale double")
    sample = drawn.join(F.broadcast(scale), ["mix_id", "source"]).withColumn("copies", _copies(F.col("w") * F.col("scale"), F.col("u"), F.col("most")))
    sample = sample.filter("copies > 0").select("mix_id", "doc_id", "source", "tokens", "copies")
    by = sample.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    want = spark.createDataFrame(
        [(t.mix_id, t.source, t.target_share, goals[t.mix_id, t.source][0], int(goals[t.mix_id, t.source][1]), t.max_repeats) for t in {(t.mix_id, t.source): t for t in goals_in}.values()],
        "mix_id string, source string, target_share double, target_tokens double, available_tokens long, max_repeats int",
    )
    report = want.join(by, ["mix_id", "source"], "left").fillna(0, ["actual_tokens", "documents", "copies", "most_copies"])
    whole = report.groupBy("mix_id").agg(F.sum("actual_tokens").alias("whole"))
    report = report.join(F.broadcast(whole), "mix_id").withColumn("actual_share", F.round(F.col("actual_tokens") / F.greatest("whole", F.lit(1)), 6)).drop("whole")
    return sample, report
