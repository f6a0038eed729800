"""Reports on topics: shares by venue and year, evolution, committees, gender, best papers and authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.scalar import cosine, euclid
from folioscope.operators.relational import percent_sort, share_of, threshold, top_k
from folioscope.operators.star import TOPICS, Star
from folioscope.operators.text import dominant
from folioscope.plans._sql import STAR


def count_rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _labelled(s: Star) -> DataFrame:
    """Topic counts with their paper's year and venue."""
    return s.doc_topics.join(s.papers.select("paper_id", "year", "venue_id", "is_conference"), "paper_id")


def doc_topics(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).doc_topics


def venue_topic_share(spark: SparkSession, d: str, low: int = 1992, high: int = 2016, least: float = 0.075) -> DataFrame:
    """The flagship: share of each topic in each venue over years low to high; shares below ``least`` become 0, and
    topics that then have no share anywhere go."""
    s = Star(spark, d)
    x = _labelled(s).filter(F.col("year").between(low, high) & F.col("venue_id").isNotNull())
    x = x.groupBy("venue_id", "topic").agg(F.sum("cnt").alias("cnt")).withColumn("raw", share_of("cnt", "venue_id"))
    x = x.withColumn("share", threshold("raw", least)).withColumn("of_topic", F.sum("share").over(Window.partitionBy("topic"))).filter("of_topic > 0")
    v = F.broadcast(s.venues.select("venue_id", "acronym"))  # a fixed dimension
    return x.join(v, "venue_id").select("venue_id", "acronym", "topic", F.round("share", 6).alias("share"))


def topic_by_year(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(Star(spark, d)).filter("year is not null").groupBy("year", "topic").agg(F.sum("cnt").alias("cnt"))


def topic_by_venue_year(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(Star(spark, d)).filter("year is not null and venue_id is not null").groupBy("venue_id", "year", "topic").agg(F.sum("cnt").alias("cnt"))


def topic_evolution_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Topics of each year in percent, ranked, with the offset of their bar; the first nine."""
    return percent_sort(topic_by_year(spark, d), "cnt", ["year"], "topic").filter("rank <= 9").select("year", "topic", "percent", "rank", "offset")


def topic_share_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Topic shares by venue, by venue type and in all, by grouping sets over one pass."""
    s = Star(spark, d)
    x = _labelled(s).filter("venue_id is not null").join(F.broadcast(s.venues.select("venue_id", F.col("is_conference").alias("conf"))), "venue_id")
    sets = [[F.col("venue_id"), F.col("topic")], [F.col("conf"), F.col("topic")], [F.col("topic")]]
    x = x.groupingSets(sets, "venue_id", "conf", "topic").agg(F.sum("cnt").alias("cnt"), (F.grouping("venue_id") * 2 + F.grouping("conf")).alias("level"))
    x = x.withColumn("share", F.round(share_of("cnt", "level", "venue_id", "conf"), 3))
    return x.select("venue_id", "conf", "topic", F.col("level").cast("int").alias("level"), "cnt", "share")


def non_pc_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics of conference papers without an author on the committee (anti-join)."""
    s = Star(spark, d)
    return s.permitted(_labelled(s), "conferences").join(s.pc_papers, "paper_id", "left_anti").groupBy("venue_id", "topic").agg(F.sum("cnt").alias("cnt"))


def pc_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics of conference papers with an author on the committee (semi-join)."""
    s = Star(spark, d)
    return s.permitted(_labelled(s), "conferences").join(s.pc_papers, "paper_id", "left_semi").groupBy("venue_id", "topic").agg(F.sum("cnt").alias("cnt"))


def pc_topic_delta(spark: SparkSession, d: str) -> DataFrame:
    """Topic shares of committee papers against all, in points and relative to all."""
    s = Star(spark, d)
    x = s.permitted(_labelled(s), "conferences").join(s.pc_papers.withColumn("pc", F.lit(1)), "paper_id", "left")
    x = x.groupBy("topic").agg(F.sum("cnt").alias("n"), F.coalesce(F.sum(F.when(F.col("pc") == 1, F.col("cnt"))), F.lit(0)).alias("pc_n"))
    w = Window.partitionBy()  # one row a topic
    x = x.withColumn("all_share", F.col("n") / F.sum("n").over(w)).withColumn("pc_share", F.when(F.sum("pc_n").over(w) > 0, F.col("pc_n") / F.sum("pc_n").over(w)).otherwise(0.0))
    delta = F.col("pc_share") - F.col("all_share")
    return x.select("topic", F.round(100 * delta, 4).alias("points"), F.when(F.col("all_share") > 0, F.round(100 * delta / F.col("all_share"), 4)).alias("relative"))


def dominant_topic(spark: SparkSession, d: str) -> DataFrame:
    return dominant(Star(spark, d).doc_topics)


def papers_per_dominant_topic(spark: SparkSession, d: str) -> DataFrame:
    return dominant(Star(spark, d).doc_topics).groupBy("topic").agg(count_rows("papers"), F.min("paper_id").alias("first"), F.max("paper_id").alias("last"))


def top_papers_per_topic(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    s = Star(spark, d)
    x = dominant(s.doc_topics).join(s.papers.select("paper_id", "title", "year", F.coalesce("cited_count", F.lit(0)).alias("cites")), "paper_id")
    return top_k(x, k, ["topic"], F.desc("cites"), F.asc("paper_id")).select("topic", "rank", "paper_id", "title", "year", "cites")


def top_authors_per_topic(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    s = Star(spark, d)
    x = dominant(s.doc_topics).join(s.slots, "paper_id").groupBy("topic", "person_id").agg(F.sum(F.coalesce("cited_count", F.lit(0))).alias("cites"))
    return top_k(x, k, ["topic"], F.desc("cites"), F.asc("person_id")).select("topic", "rank", "person_id", "cites")


def topic_coverage_hist(spark: SparkSession, d: str, least: int = 3) -> DataFrame:
    """How many authors cover how many topics, a topic counting from ``least`` words in one of their papers."""
    s = Star(spark, d)
    x = s.authorship.join(s.doc_topics, "paper_id")
    n = x.groupBy("person_id").agg(F.countDistinct(F.when(F.col("cnt") >= least, F.col("topic"))).alias("topics"))
    return n.groupBy("topics").agg(count_rows("authors"))


def super_authors(spark: SparkSession, d: str) -> DataFrame:
    """Topic coverage of the top hundredth of authors by citations (semi-join)."""
    from folioscope.plans.people import top_percent_authors

    s = Star(spark, d)
    x = s.authorship.join(top_percent_authors(spark, d).select("person_id"), "person_id", "left_semi").join(s.doc_topics, "paper_id")
    n = x.groupBy("person_id").agg(F.countDistinct(F.when(F.col("cnt") >= 3, F.col("topic"))).alias("topics"))
    return n.groupBy("topics").agg(count_rows("authors"))


def gender_topic_delta(spark: SparkSession, d: str) -> DataFrame:
    """Mean topic vector of male less that of female author slots, a paper's vector shared among its authors, by year. A billionth is added before rounding, as exact halves are common here."""
    s = Star(spark, d)
    team = s.authorship.groupBy("paper_id").agg(count_rows("n"))
    g = s.persons.filter("gender in ('m', 'f')").select("person_id", "gender")
    x = s.slots.filter("year is not null").join(g, "person_id").join(team, "paper_id").join(s.doc_topics, "paper_id")
    per = x.groupBy("year", "topic").agg(*[F.sum(F.when(F.col("gender") == k, F.col("cnt") / F.col("n")).otherwise(0.0)).alias(k) for k in "mf"])
    size = s.slots.filter("year is not null").join(g, "person_id").groupBy("year").agg(*[F.sum((F.col("gender") == k).cast("long")).alias(f"n{k}") for k in "mf"])
    ok = (F.col("nm") > 0) & (F.col("nf") > 0)
    return per.join(size, "year").select("year", "topic", F.when(ok, F.round(F.col("m") / F.col("nm") - F.col("f") / F.col("nf") + 1e-9, 6)).alias("delta"))


def gender_topics_by_venue(spark: SparkSession, d: str) -> DataFrame:
    """Normalised topic vectors of papers with a man, and with a woman, summed by venue."""
    s = Star(spark, d)
    flags = s.authorship.join(s.persons, "person_id").groupBy("paper_id").agg(F.max((F.col("gender") == "m").cast("int")).alias("m"), F.max((F.col("gender") == "f").cast("int")).alias("f"))
    x = _labelled(s).filter("venue_id is not null").withColumn("share", share_of("cnt", "paper_id")).join(flags, "paper_id")
    sums = [F.round(F.sum(F.when(F.col(k) == 1, F.col("share")).otherwise(0.0)), 6).alias(f"with_{k}") for k in "mf"]
    return x.groupBy("venue_id", "topic").agg(*sums)


def venue_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine and Euclidean distance of each venue's topic shares to those of all papers and of its own type."""
    s = Star(spark, d)
    base = _labelled(s).filter("venue_id is not null").drop("is_conference").join(F.broadcast(s.venues.select("venue_id", "is_conference")), "venue_id")

    def vector(*by: str) -> DataFrame:
        sums = [F.sum(F.when(F.col("topic") == t, F.col("cnt")).otherwise(0)).alias(f"t{t}") for t in range(TOPICS)]
        total = sum((F.col(f"t{t}") for t in range(1, TOPICS)), F.col("t0"))
        return base.groupBy(*by).agg(*sums).select(*by, F.array(*[F.col(f"t{t}") / total for t in range(TOPICS)]).alias("v"))

    kinds = vector("is_conference").select(F.col("is_conference").alias("k"), F.col("v").alias("own"))
    every = vector().select(F.col("v").alias("all_v"))  # one row
    x = vector("venue_id", "is_conference")
    y = x.join(F.broadcast(kinds), F.col("is_conference") == F.col("k")).join(F.broadcast(every))
    r = lambda c, n: F.round(c, 3).alias(n)
    return y.select("venue_id", r(cosine(F.col("v"), F.col("all_v")), "cosine_all"), r(euclid(F.col("v"), F.col("all_v")), "euclid_all"), r(cosine(F.col("v"), F.col("own")), "cosine_own"), r(euclid(F.col("v"), F.col("own")), "euclid_own"))


#: More venues than this are no fixed dimension any more, and their linkage is refused.
MOST_VENUES = 5_000


def complete_linkage(vectors: dict[int, list[float]]) -> list[tuple[int, int, int, float, int]]:
    """(step, first, second, distance, members): the merges of complete linkage by Euclidean distance; a cluster bears its
    least name, ties go to the earlier pair in order of names."""
    import numpy as np

    names = sorted(vectors)
    x = np.array([vectors[n] for n in names], dtype=float).reshape(len(names), -1)
    m = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    m[np.tril_indices(len(names))] = np.inf
    size, out = dict.fromkeys(range(len(names)), 1), []
    for step in range(1, len(names)):
        i, j = (int(k) for k in np.unravel_index(int(m.argmin()), m.shape))
        out.append((step, int(names[i]), int(names[j]), float(round(m[i, j], 6)), size[i] + size[j]))
        for k in range(len(names)):
            if k not in (i, j) and k in size:
                far = max(m[min(i, k), max(i, k)], m[min(j, k), max(j, k)])
                m[min(i, k), max(i, k)] = far
        size[i] += size.pop(j)
        m[j, :] = m[:, j] = np.inf
    return out


def venue_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Order of merges of venues by complete linkage on their topic shares. What reaches the driver is one number a venue
    and topic; venues are a fixed dimension, and more than MOST_VENUES are refused."""
    s = Star(spark, d)
    x = _labelled(s).filter("venue_id is not null").groupBy("venue_id", "topic").agg(F.sum("cnt").alias("cnt")).withColumn("share", share_of("cnt", "venue_id"))
    rows = x.select("venue_id", "topic", "share").limit(MOST_VENUES * TOPICS + 1).collect()
    if len(rows) > MOST_VENUES * TOPICS:
        raise ValueError(f"more than {MOST_VENUES} venues")
    vectors: dict[int, list[float]] = {}
    for r in rows:
        vectors.setdefault(r.venue_id, [0.0] * TOPICS)[r.topic] = r.share
    return spark.createDataFrame(complete_linkage(vectors), "step int, first int, second int, distance double, venues int")


_FNS = [doc_topics, venue_topic_share, topic_by_year, topic_by_venue_year, topic_evolution_ranked, topic_share_by_type, non_pc_topics, pc_topics, pc_topic_delta, dominant_topic, papers_per_dominant_topic, top_papers_per_topic, top_authors_per_topic, topic_coverage_hist, super_authors, gender_topic_delta, gender_topics_by_venue, venue_similarity, venue_linkage]
QUERIES = {f.__name__: f for f in _FNS}

_LAB = STAR + ", lab AS (SELECT dt.*, year, venue_id, is_conference FROM dt JOIN pap USING (paper_id))"
_CONF = _LAB + ", conf AS (SELECT lab.* FROM lab JOIN ven USING (venue_id) WHERE ven.is_conference)"
_DOM = STAR + ", dom AS (SELECT paper_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY cnt DESC, topic) k FROM dt WHERE cnt > 0) WHERE k = 1)"
_COVER = "SELECT topics, count(*) AS authors FROM (SELECT person_id, count(DISTINCT CASE WHEN cnt >= 3 THEN topic END) AS topics FROM aut JOIN dt USING (paper_id) {} GROUP BY 1) GROUP BY 1"
_VEC = ", ".join(f"sum(CASE WHEN topic = {t} THEN cnt ELSE 0 END)::DOUBLE / sum(cnt)" for t in range(TOPICS))
SQL = {
    "doc_topics": STAR + " SELECT * FROM dt",
    "venue_topic_share": _LAB + ", x AS (SELECT venue_id, topic, sum(cnt) AS cnt FROM lab WHERE year BETWEEN 1992 AND 2016 AND venue_id IS NOT NULL GROUP BY 1, 2), y AS (SELECT venue_id, topic, cnt / CAST(sum(cnt) OVER (PARTITION BY venue_id) AS DOUBLE) AS r FROM x), z AS (SELECT venue_id, topic, CASE WHEN r < 0.075 THEN 0.0::DOUBLE ELSE r END AS share FROM y) SELECT venue_id, acronym, topic, round(share, 6) AS share FROM (SELECT *, sum(share) OVER (PARTITION BY topic) AS t FROM z) JOIN ven USING (venue_id) WHERE t > 0",
    "topic_by_year": _LAB + " SELECT year, topic, CAST(sum(cnt) AS BIGINT) AS cnt FROM lab WHERE year IS NOT NULL GROUP BY 1, 2",
    "topic_by_venue_year": _LAB + " SELECT venue_id, year, topic, CAST(sum(cnt) AS BIGINT) AS cnt FROM lab WHERE year IS NOT NULL AND venue_id IS NOT NULL GROUP BY 1, 2, 3",
    "topic_evolution_ranked": _LAB + ", x AS (SELECT year, topic, round(100.0::DOUBLE * (sum(cnt) / CAST(sum(sum(cnt)) OVER (PARTITION BY year) AS DOUBLE)), 2) AS percent FROM lab WHERE year IS NOT NULL GROUP BY 1, 2), y AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, round(coalesce(sum(percent) OVER (PARTITION BY year ORDER BY percent DESC, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE), 2) AS \"offset\" FROM x WINDOW w AS (PARTITION BY year ORDER BY percent DESC, topic)) SELECT * FROM y WHERE rank <= 9",
    "topic_share_by_type": _LAB + ", x AS (SELECT venue_id, ven.is_conference AS conf, topic, cnt FROM lab JOIN ven USING (venue_id)), y AS (SELECT venue_id, conf, topic, CAST(sum(cnt) AS BIGINT) AS cnt, CAST(grouping(venue_id) * 2 + grouping(conf) AS INTEGER) AS level FROM x GROUP BY GROUPING SETS ((venue_id, topic), (conf, topic), (topic))) SELECT *, round(cnt / CAST(sum(cnt) OVER (PARTITION BY level, venue_id, conf) AS DOUBLE), 3) AS share FROM y",
    "non_pc_topics": _CONF + " SELECT venue_id, topic, CAST(sum(cnt) AS BIGINT) AS cnt FROM conf WHERE paper_id NOT IN (SELECT paper_id FROM pcp) GROUP BY 1, 2",
    "pc_topics": _CONF + " SELECT venue_id, topic, CAST(sum(cnt) AS BIGINT) AS cnt FROM conf WHERE paper_id IN (SELECT paper_id FROM pcp) GROUP BY 1, 2",
    "pc_topic_delta": _CONF + ", x AS (SELECT topic, sum(cnt)::DOUBLE AS n, coalesce(sum(CASE WHEN paper_id IN (SELECT paper_id FROM pcp) THEN cnt END), 0)::DOUBLE AS p FROM conf GROUP BY 1), y AS (SELECT topic, n / sum(n) OVER () AS a, CASE WHEN sum(p) OVER () > 0 THEN p / sum(p) OVER () ELSE 0 END AS b FROM x) SELECT topic, round(100 * (b - a), 4) AS points, CASE WHEN a > 0 THEN round(100 * (b - a) / a, 4) END AS relative FROM y",
    "dominant_topic": _DOM + " SELECT * FROM dom",
    "papers_per_dominant_topic": _DOM + " SELECT topic, count(*) AS papers, min(paper_id) AS first, max(paper_id) AS last FROM dom GROUP BY 1",
    "top_papers_per_topic": _DOM + " SELECT topic, CAST(r AS INTEGER) AS rank, paper_id, title, year, cites FROM (SELECT topic, paper_id, title, year, coalesce(cited_count, 0) AS cites, row_number() OVER (PARTITION BY topic ORDER BY coalesce(cited_count, 0) DESC, paper_id) AS r FROM dom JOIN pap USING (paper_id)) WHERE r <= 5",
    "top_authors_per_topic": _DOM + ", x AS (SELECT topic, person_id, CAST(sum(coalesce(cited_count, 0)) AS BIGINT) AS cites FROM dom JOIN slots USING (paper_id) GROUP BY 1, 2) SELECT topic, CAST(r AS INTEGER) AS rank, person_id, cites FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY cites DESC, person_id) AS r FROM x) WHERE r <= 10",
    "topic_coverage_hist": STAR + " " + _COVER.format(""),
    "super_authors": STAR + ", apc AS (SELECT p.person_id, coalesce(x.cites, 0) AS cites FROM (SELECT DISTINCT person_id FROM aut) p LEFT JOIN (SELECT person_id, sum(coalesce(cited_count, 0)) AS cites FROM slots WHERE year >= 2000 GROUP BY 1) x USING (person_id)), best AS (SELECT person_id FROM (SELECT *, row_number() OVER (ORDER BY cites DESC, person_id) AS r, count(*) OVER () AS n FROM apc) WHERE r <= floor(0.01::DOUBLE * n)) " + _COVER.format("WHERE person_id IN (SELECT person_id FROM best)"),
    "gender_topic_delta": STAR + ", g AS (SELECT s.*, gender FROM slots s JOIN per USING (person_id) WHERE gender IN ('m', 'f') AND year IS NOT NULL), tm AS (SELECT paper_id, count(*) AS n FROM aut GROUP BY 1), x AS (SELECT year, topic, sum(CASE WHEN gender = 'm' THEN cnt / n::DOUBLE ELSE 0 END) AS m, sum(CASE WHEN gender = 'f' THEN cnt / n::DOUBLE ELSE 0 END) AS f FROM g JOIN tm USING (paper_id) JOIN dt USING (paper_id) GROUP BY 1, 2), z AS (SELECT year, count(*) FILTER (WHERE gender = 'm') AS nm, count(*) FILTER (WHERE gender = 'f') AS nf FROM g GROUP BY 1) SELECT year, topic, CASE WHEN nm > 0 AND nf > 0 THEN round(m / nm - f / nf + 1e-9, 6) END AS delta FROM x JOIN z USING (year)",
    "gender_topics_by_venue": _LAB + ", fl AS (SELECT paper_id, bool_or(gender = 'm') AS m, bool_or(gender = 'f') AS f FROM aut JOIN per USING (person_id) GROUP BY 1), x AS (SELECT *, cnt / CAST(sum(cnt) OVER (PARTITION BY paper_id) AS DOUBLE) AS share FROM lab WHERE venue_id IS NOT NULL) SELECT venue_id, topic, round(sum(CASE WHEN m THEN share ELSE 0 END), 6) AS with_m, round(sum(CASE WHEN f THEN share ELSE 0 END), 6) AS with_f FROM x JOIN fl USING (paper_id) GROUP BY 1, 2",
    "venue_similarity": _LAB + f", b AS (SELECT lab.topic, lab.cnt, ven.* FROM lab JOIN ven USING (venue_id)), v AS (SELECT venue_id, is_conference, [{_VEC}] AS v FROM b GROUP BY 1, 2), k AS (SELECT is_conference, [{_VEC}] AS o FROM b GROUP BY 1), e AS (SELECT [{_VEC}] AS a FROM b) SELECT venue_id, round(list_cosine_similarity(v, a), 3) AS cosine_all, round(list_distance(v, a), 3) AS euclid_all, round(list_cosine_similarity(v, o), 3) AS cosine_own, round(list_distance(v, o), 3) AS euclid_own FROM v JOIN k USING (is_conference) CROSS JOIN e",
}
