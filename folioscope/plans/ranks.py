"""PageRank over collaborators and its variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.common import cut
from folioscope.operators import rank
from folioscope.operators.relational import top_percent
from folioscope.operators.star import Star
from folioscope.plans._sql import STAR
from folioscope.plans.people import _APC, _TOP, author_paper_cite_counts

#: Of the sweep over damping values: 0.05 to 0.95, the most cited twentieth of authors since 1992, and rounds.
DAMPS = [round(0.05 * i, 2) for i in range(1, 20)]
TOP, SINCE, ROUNDS = 0.05, 1992, 20
#: Rounds after which the rank with a self term is taken as settled, and its damping.
SELF_ROUNDS, SELF_DAMP = 25, 0.45


def link_matrix(s: Star, valid: DataFrame | None = None, min_year: int | None = None) -> DataFrame:
    """(src, dst, cnt), symmetric: papers that two authors share, of those in valid(id) and since min_year if given."""
    a = s.authorship if min_year is None else s.slots.filter(F.col("year") >= min_year).select("paper_id", "person_id", "pos")
    if valid is not None:
        a = a.join(valid.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    return rank.both_ways(rank.collaborations(a))


def _everyone(s: Star) -> DataFrame:
    return s.authorship.select(F.col("person_id").alias("id")).distinct()


def _most_cited(spark: SparkSession, d: str, share: float = TOP, min_year: int = SINCE) -> DataFrame:
    """(id, papers, cites) of the most cited authors since min_year."""
    x = author_paper_cite_counts(spark, d, min_year).withColumnRenamed("person_id", "id")
    return cut(top_percent(x, share, F.desc("cites"), F.asc("id")), "most_cited")


def _named(r: DataFrame) -> DataFrame:
    return r.select(F.col("id").alias("person_id"), F.round("score", 6).alias("score"))


def pagerank_3iter(spark: SparkSession, d: str) -> DataFrame:
    """All authors, each of whom gives every collaborator alike."""
    s = Star(spark, d)
    return _named(rank.page_rank(cut(link_matrix(s), "links"), _everyone(s), [0.5], 3))


def _weighted(spark: SparkSession, d: str, weight: str) -> DataFrame:
    s = Star(spark, d)
    edges = cut(link_matrix(s), "links")
    w = s.slots.groupBy(F.col("person_id").alias("id")).agg(F.sum(F.coalesce("cited_count", F.lit(0))).alias("cites"), F.count(F.lit(1)).alias("papers"))
    w = w.select("id", F.col(weight).alias("weight"))
    return _named(rank.page_rank(edges, _everyone(s), [0.5], 3, w, rank.scaled_row_sum(edges)))


def weighted_pagerank_3iter(spark: SparkSession, d: str) -> DataFrame:
    """Teleport in proportion to citations; shares by the scaled link matrix."""
    return _weighted(spark, d, "cites")


def publication_pagerank_3iter(spark: SparkSession, d: str) -> DataFrame:
    """Teleport in proportion to papers; shares by the scaled link matrix."""
    return _weighted(spark, d, "papers")


def link_matrix_top(spark: SparkSession, d: str) -> DataFrame:
    """Links between the most cited authors, by papers of the years that made them so."""
    return link_matrix(Star(spark, d), _most_cited(spark, d), SINCE)


def coauthor_map(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): the co-authors of each author as a source; whoever is listed last on a paper is no source there."""
    a = Star(spark, d).authorship
    last = a.groupBy("paper_id").agg(F.max("pos").alias("last"))
    x = a.join(last, "paper_id").filter("pos < last").select("paper_id", F.col("person_id").alias("src"))
    return x.join(a.select("paper_id", F.col("person_id").alias("dst")), "paper_id").filter("src <> dst").select("src", "dst").distinct()


def pagerank_self_term(spark: SparkSession, d: str) -> DataFrame:
    """Rank over the co-author map with a self term of 1/n times the share of citations that an author was a source for,
    at damping 0.45 and without scaling; synchronous rounds reach the fixed point that the order of updates can't move.
    Scores are relative to the largest."""
    s = Star(spark, d)
    pulls = cut(coauthor_map(spark, d), "pulls")
    last = s.authorship.groupBy("paper_id").agg(F.max("pos").alias("last"))
    cites = s.slots.join(last, "paper_id").filter("pos < last").groupBy(F.col("person_id").alias("id")).agg((F.sum(F.coalesce("cited_count", F.lit(0)))).alias("weight"))
    nodes = cut(_everyone(s), "nodes")
    share = cites.withColumn("weight", F.col("weight") / F.lit(float(nodes.count() or 1)))
    total = cites.agg(F.sum("weight")).first()[0] or 1
    # an author takes from co-authors: the edges run from them, and they share by the size of their own map
    edges = pulls.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("cnt"))
    own = rank.degree(pulls.withColumn("cnt", F.lit(1)))
    r = cut(rank.page_rank(edges, nodes, [SELF_DAMP], SELF_ROUNDS, share.withColumn("weight", F.col("weight") / F.lit(float(total))), own, scaled=False), "self")
    top = r.agg(F.max("score").alias("top"))
    return r.join(F.broadcast(top), how="cross").select(F.col("id").alias("person_id"), F.round(F.col("score") / F.col("top"), 6).alias("score"))


def pagerank_damping_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The most cited authors' ranks at every damping value: plain, and with teleport by citations and by papers."""
    s = Star(spark, d)
    best = _most_cited(spark, d)
    nodes = best.select("id")
    edges = cut(link_matrix(s, nodes, SINCE), "links")
    scaled = cut(rank.scaled_row_sum(edges), "scaled")
    kinds = {"naive": (None, None)}
    for kind, weight in (("cite", "cites"), ("publ", "papers")):
        kinds[kind] = (best.select("id", F.col(weight).alias("weight")), scaled)
    r = rank.page_ranks(edges, nodes, DAMPS, ROUNDS, kinds)
    return r.select("kind", "damp", F.col("id").alias("person_id"), F.round("score", 6).alias("score"))


def damping_ranked_authors(spark: SparkSession, d: str, most: int = 20) -> DataFrame:
    """The twenty most cited authors by their mean score over all damping values, of each kind of rank."""
    first = _most_cited(spark, d).orderBy(F.desc("cites"), "id").limit(most).select(F.col("id").alias("person_id"))
    r = pagerank_damping_sweep(spark, d).join(F.broadcast(first), "person_id")
    return r.groupBy("kind", "person_id").agg(F.round(F.avg("score"), 4).alias("mean_score"))


_FNS = [pagerank_3iter, weighted_pagerank_3iter, publication_pagerank_3iter, link_matrix_top, coauthor_map, pagerank_self_term, pagerank_damping_sweep, damping_ranked_authors]
QUERIES = {f.__name__: f for f in _FNS}

_LINKS = ", links AS (SELECT a AS src, b AS dst, cnt FROM pairs UNION ALL SELECT b, a, cnt FROM pairs)"
_NODES = ", nodes AS (SELECT DISTINCT person_id AS id FROM aut)"
_DEGREE = ", divisor AS (SELECT src AS id, count(DISTINCT dst)::DOUBLE AS v FROM links GROUP BY 1)"
_SCALED = ", {0} AS (SELECT src AS id, sum(cnt / most::DOUBLE) AS v FROM links JOIN (SELECT dst, max(cnt) AS most FROM links GROUP BY 1) USING (dst) GROUP BY 1)"
_BEST = (
    ", " + _APC.format(SINCE) + f", best AS (SELECT person_id AS id, papers, cites FROM {_TOP.format('cites', 'apc')} WHERE r <= floor({TOP}::DOUBLE * n))"
    f", recent AS (SELECT x.* FROM slots x JOIN best ON x.person_id = best.id WHERE x.year >= {SINCE})"
    ", links AS (SELECT x.person_id AS src, y.person_id AS dst, count(*) AS cnt FROM recent x JOIN recent y ON x.paper_id = y.paper_id AND x.person_id <> y.person_id GROUP BY 1, 2)"
)


def _rounds(name: str, base: str, divisor: str, damps: list[float], rounds: int, scaled: bool = True) -> str:
    """CTEs name0 … of synchronous rounds for every damping value; ``base`` gives (id, t)."""
    sql = f", {name}base AS MATERIALIZED ({base}), {name}0 AS (SELECT id, unnest({damps}::DOUBLE[]) AS damp, 1.0::DOUBLE / (SELECT count(*) FROM {name}base) AS score FROM {name}base)"
    sql += f", {name}moves AS MATERIALIZED (SELECT src, dst, v FROM links JOIN {divisor} ON src = {divisor}.id)"
    for i in range(1, rounds + 1):
        over = "/ max(score) OVER (PARTITION BY damp)" if scaled else ""
        sql += f""", {name}{i} AS MATERIALIZED (SELECT id, damp, score {over} AS score FROM (
SELECT b.id, p.damp, (1 - p.damp) * t + p.damp * coalesce(g.s, 0) AS score FROM {name}base b JOIN {name}{i - 1} p USING (id)
LEFT JOIN (SELECT dst AS id, damp, sum(score / v) AS s FROM {name}moves JOIN {name}{i - 1} r ON src = r.id GROUP BY 1, 2) g ON g.id = b.id AND g.damp = p.damp))"""
    return sql


_UNIFORM = "SELECT id, 1.0::DOUBLE / count(*) OVER () AS t FROM {0}"
_BY = "SELECT id, coalesce(w, 0) / sum(coalesce(w, 0)) OVER ()::DOUBLE AS t FROM nodes LEFT JOIN (SELECT person_id AS id, CAST({0} AS DOUBLE) AS w FROM slots GROUP BY 1) USING (id)"
_CITES = "sum(coalesce(cited_count, 0))"


def _three(base: str, divisor: str) -> str:
    return STAR + _LINKS + _NODES + divisor + _rounds("r", base, "divisor", [0.5], 3) + " SELECT id AS person_id, round(score, 6) AS score FROM r3"


_MAP = ", pulls AS (SELECT DISTINCT x.person_id AS src, y.person_id AS dst FROM (SELECT *, max(pos) OVER (PARTITION BY paper_id) AS last FROM aut) x JOIN aut y ON x.paper_id = y.paper_id AND x.person_id <> y.person_id WHERE x.pos < x.last)"
_SWEEP = STAR + _BEST + _DEGREE + _SCALED.format("sc") + _rounds("n", _UNIFORM.format("best"), "divisor", DAMPS, ROUNDS)
for _k, _w in (("c", "cites"), ("p", "papers")):
    _SWEEP += _rounds(_k, f"SELECT id, {_w} / (sum({_w}) OVER ())::DOUBLE AS t FROM best", "sc", DAMPS, ROUNDS)
_SWEEP += ", sweep AS (" + " UNION ALL ".join(f"SELECT '{n}' AS kind, damp, id AS person_id, round(score, 6) AS score FROM {k}{ROUNDS}" for k, n in (("n", "naive"), ("c", "cite"), ("p", "publ"))) + ")"
SQL = {
    "pagerank_3iter": _three(_UNIFORM.format("nodes"), _DEGREE),
    "weighted_pagerank_3iter": _three(_BY.format(_CITES), _SCALED.format("divisor")),
    "publication_pagerank_3iter": _three(_BY.format("count(*)"), _SCALED.format("divisor")),
    "link_matrix_top": STAR + _BEST + " SELECT src, dst, cnt FROM links",
    "coauthor_map": STAR + _MAP + " SELECT src, dst FROM pulls",
    "pagerank_self_term": STAR + _MAP + ", links AS (SELECT dst AS src, src AS dst FROM pulls), divisor AS (SELECT src AS id, count(DISTINCT dst)::DOUBLE AS v FROM pulls GROUP BY 1)" + _NODES
    + _rounds("r", f"SELECT id, coalesce(w, 0) / sum(coalesce(w, 0)) OVER ()::DOUBLE / count(*) OVER () AS t FROM nodes LEFT JOIN (SELECT person_id AS id, CAST({_CITES} AS DOUBLE) AS w FROM (SELECT *, max(pos) OVER (PARTITION BY paper_id) AS last FROM aut) JOIN pap USING (paper_id) WHERE pos < last GROUP BY 1) USING (id)", "divisor", [SELF_DAMP], SELF_ROUNDS, False)
    + f" SELECT id AS person_id, round(score / max(score) OVER (), 6) AS score FROM r{SELF_ROUNDS}",
    "pagerank_damping_sweep": _SWEEP + " SELECT * FROM sweep",
    "damping_ranked_authors": _SWEEP + " SELECT kind, person_id, round(avg(score), 4) AS mean_score FROM sweep WHERE person_id IN (SELECT id FROM best ORDER BY cites DESC, id LIMIT 20) GROUP BY 1, 2",
}
