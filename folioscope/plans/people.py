"""Reports on people: growth, contributions, rankings, gender, committees, collaboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.scalar import seven_plus, short_role, team_size
from folioscope.operators import rank
from folioscope.operators.relational import top_percent, zero_filled
from folioscope.operators.star import Star
from folioscope.plans._sql import STAR



def count_rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def papers_per_year_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    got = Star(spark, d).papers.groupBy("year").agg(count_rows("papers"))
    return zero_filled(got, "year", 1970, 2029, "papers", spark)


def growth_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Papers and people who first appear, by year; people of unknown years don't count."""
    s = Star(spark, d)
    first = s.slots.filter("year is not null").groupBy("person_id").agg(F.min("year").alias("year")).groupBy("year").agg(count_rows("new_authors"))
    papers = s.papers.filter("year is not null").groupBy("year").agg(count_rows("papers"))
    return papers.join(first, "year", "left").select("year", "papers", F.coalesce("new_authors", F.lit(0)).alias("new_authors"))


def growth_after(spark: SparkSession, d: str, min_year: int = 1992, max_year: int = 2016) -> DataFrame:
    """Papers and new people of the years in (min_year, max_year]; the first year only seeds those seen and isn't
    reported."""
    s = Star(spark, d)
    inside = F.col("year").between(min_year + 1, max_year)
    a = s.slots.filter(inside)
    first = a.groupBy("person_id").agg(F.min("year").alias("year")).groupBy("year").agg(count_rows("new_authors"))
    p = s.papers.filter(inside).groupBy("year").agg(count_rows("papers"))
    start = p.agg(F.min("year").alias("start"))
    return p.join(first, "year", "left").join(F.broadcast(start), F.col("year") > F.col("start")).select("year", "papers", F.coalesce("new_authors", F.lit(0)).alias("new_authors"))


def authors_per_year(spark: SparkSession, d: str) -> DataFrame:
    s = Star(spark, d)
    x = s.slots.filter("year is not null").join(s.persons.select("person_id", "name"), "person_id")
    return x.groupBy("year").agg(F.countDistinct("name").alias("authors"))


def papers_by_venue_type(spark: SparkSession, d: str) -> DataFrame:
    s = Star(spark, d)
    out = None
    for which in ("conferences", "journals", "all"):
        x = s.permitted(s.papers, which).agg(count_rows("papers")).select(F.lit(which).alias("permitted"), "papers")
        out = x if out is None else out.unionByName(x)
    return out


def author_paper_cite_counts(spark: SparkSession, d: str, min_year: int = 2000) -> DataFrame:
    """Papers and citations since min_year of every author; those with no such paper remain with 0."""
    s = Star(spark, d)
    got = s.slots.filter(F.col("year") >= min_year).groupBy("person_id").agg(count_rows("papers"), F.sum(F.coalesce("cited_count", F.lit(0))).alias("cites"))
    everyone = s.authorship.select("person_id").distinct()
    return everyone.join(got, "person_id", "left").select("person_id", F.coalesce("papers", F.lit(0)).alias("papers"), F.coalesce("cites", F.lit(0)).alias("cites"))


def top_percent_authors(spark: SparkSession, d: str) -> DataFrame:
    """The top hundredth of authors by citations."""
    x = author_paper_cite_counts(spark, d)
    return top_percent(x, 0.01, F.desc("cites"), F.asc("person_id"))


def top_cited_authors_named(spark: SparkSession, d: str) -> DataFrame:
    s = Star(spark, d)
    return top_percent_authors(spark, d).join(s.persons, "person_id").select("person_id", "name", "papers", "cites")


def local_citations_per_author(spark: SparkSession, d: str) -> DataFrame:
    s = Star(spark, d)
    local = s.citations.groupBy(F.col("dst").alias("paper_id")).agg(count_rows("c"))
    return s.authorship.join(local, "paper_id", "left").groupBy("person_id").agg(count_rows("papers"), F.sum(F.coalesce("c", F.lit(0))).alias("local_cites"))


def local_cites(spark: SparkSession, d: str) -> DataFrame:
    """Times each paper is cited within the corpus; repeated references count each time."""
    s = Star(spark, d)
    c = s.citations.groupBy(F.col("dst").alias("paper_id")).agg(count_rows("local_cites"))
    return s.papers.select("paper_id").join(c, "paper_id", "left").select("paper_id", F.coalesce("local_cites", F.lit(0)).alias("local_cites"))


def citation_list(spark: SparkSession, d: str) -> DataFrame:
    """Adjacency: the works that each paper cites, in order."""
    s = Star(spark, d)
    return s.citations.groupBy("src").agg(F.array_join(F.sort_array(F.collect_list("dst")), ",").alias("cited"), count_rows("n"))


def harmonic_contribution(spark: SparkSession, d: str) -> DataFrame:
    return rank.contributions(Star(spark, d).slots)


def uniform_contribution(spark: SparkSession, d: str) -> DataFrame:
    return rank.contributions(Star(spark, d).slots, harmonic=False)


def weighted_contribution_harmonic(spark: SparkSession, d: str) -> DataFrame:
    return rank.contributions(Star(spark, d).slots, weighted=True)


def weighted_contribution_uniform(spark: SparkSession, d: str) -> DataFrame:
    return rank.contributions(Star(spark, d).slots, harmonic=False, weighted=True)


def h_index(spark: SparkSession, d: str) -> DataFrame:
    return rank.h_index(Star(spark, d).slots)


def h_index_compat(spark: SparkSession, d: str) -> DataFrame:
    return rank.h_index(Star(spark, d).slots, compat=True)


def h_index_leaders(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred by h-index, with names."""
    s = Star(spark, d)
    top = rank.h_index(s.slots).join(s.persons, "person_id").orderBy(F.desc("h"), "person_id").limit(100)
    return top.select("person_id", "name", "h")


def collaboration_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rank.collaborations(Star(spark, d).authorship)


def directed_pairs_by_venue(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of authors in the order of the list, by venue."""
    s = Star(spark, d)
    a = s.slots.filter("venue_id is not null")
    x, y = a.select("paper_id", "venue_id", F.col("person_id").alias("src"), F.col("pos").alias("i")), a.select("paper_id", F.col("person_id").alias("dst"), F.col("pos").alias("j"))
    return x.join(y, "paper_id").filter("i < j").groupBy("venue_id", "src", "dst").agg(count_rows("n"))


def coauthor_sources(spark: SparkSession, d: str) -> DataFrame:
    """Distinct co-authors of each author as a source; the author listed last of a paper is no source there."""
    s = Star(spark, d)
    a = s.authorship.withColumn("last", F.max("pos").over(Window.partitionBy("paper_id")))
    x = a.filter("pos < last").select("paper_id", F.col("person_id").alias("src"))
    y = s.authorship.select("paper_id", F.col("person_id").alias("dst"))
    return x.join(y, "paper_id").filter("src <> dst").groupBy("src").agg(F.countDistinct("dst").alias("coauthors"))


def committee_roster(spark: SparkSession, d: str) -> DataFrame:
    """Members of each committee in order of role and name."""
    s = Star(spark, d)
    x = s.pc.join(s.persons, "person_id").withColumn("short", short_role(F.col("role")))
    members = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("short", "name", "person_id"))), lambda m: F.concat_ws(":", m["short"], m["name"])), "; ")
    return x.groupBy("venue_id", "year").agg(count_rows("seats"), members.alias("members"))


def seats_per_author(spark: SparkSession, d: str) -> DataFrame:
    """Committee seats of every author; those without any have 0."""
    s = Star(spark, d)
    seats = s.pc.groupBy("person_id").agg(count_rows("seats"))
    return s.authorship.select("person_id").distinct().join(seats, "person_id", "left").select("person_id", F.coalesce("seats", F.lit(0)).alias("seats"))


def pc_paper_share(spark: SparkSession, d: str) -> DataFrame:
    """Papers with an author on the committee, by conference and year, by conference, and in all (ROLLUP)."""
    s = Star(spark, d)
    x = s.permitted(s.papers, "conferences").filter("year is not null").join(s.pc_papers.withColumn("pc", F.lit(1)), "paper_id", "left")
    return x.rollup("venue_id", "year").agg(count_rows("papers"), F.count("pc").alias("pc_papers")).withColumn("share", F.round(100.0 * F.col("pc_papers") / F.col("papers"), 2))


def gender_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Author slots by gender and year."""
    s = Star(spark, d)
    x = s.slots.filter("year is not null").join(s.persons.select("person_id", "gender"), "person_id", "left")
    g = F.coalesce("gender", F.lit("u"))
    c = lambda k: F.sum((g == k).cast("long")).alias(k)
    return x.groupBy("year").agg(c("m"), c("f"), c("u")).withColumn("percent_f", F.when(F.col("m") + F.col("f") > 0, F.round(100.0 * F.col("f") / (F.col("m") + F.col("f")), 2)))


def gender_topN_mix(spark: SparkSession, d: str) -> DataFrame:
    """Gender mix of the first 10 to 1000 authors by citations. Only the first thousand are ranked."""
    s = Star(spark, d)
    best = author_paper_cite_counts(spark, d).orderBy(F.desc("cites"), "person_id").limit(1000)
    r = best.withColumn("r", F.row_number().over(Window.orderBy(F.desc("cites"), "person_id"))).join(s.persons.select("person_id", "gender"), "person_id", "left")
    sizes = F.explode(F.array(*[F.lit(n) for n in (10, 20, 50, 100, 200, 500, 1000)]))
    g = F.coalesce("gender", F.lit("u"))
    c = lambda k: F.sum((g == k).cast("long")).alias(k)
    return r.withColumn("top_n", sizes).filter("r <= top_n").groupBy("top_n").agg(c("m"), c("f"), c("u"))


def set_overlap_matrix(spark: SparkSession, d: str) -> DataFrame:
    """How many of the top hundredth each pair of rankings shares."""
    s = Star(spark, d)
    slots = s.slots
    sets = {
        "cites": author_paper_cite_counts(spark, d, 0).select("person_id", F.col("cites").cast("double").alias("x")),
        "harmonic": rank.contributions(slots).select("person_id", F.col("score").alias("x")),
        "h": rank.h_index(slots).select("person_id", F.col("h").cast("double").alias("x")),
    }
    all_ = None
    for k, x in sets.items():
        t = top_percent(x, 0.01, F.desc("x"), F.asc("person_id")).select(F.lit(k).alias("s"), "person_id")
        all_ = t if all_ is None else all_.unionByName(t)
    return all_.withColumnRenamed("s", "first").join(all_.withColumnRenamed("s", "second"), "person_id").groupBy("first", "second").agg(count_rows("shared"))


def team_size_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of papers by number of authors, a year."""
    s = Star(spark, d)
    n = s.slots.filter("year is not null").groupBy("paper_id", "year").agg(count_rows("n"))
    x = n.groupBy("year", seven_plus(F.col("n")).alias("authors")).agg(count_rows("papers"))
    return x.withColumn("share", F.round(F.col("papers") / F.sum("papers").over(Window.partitionBy("year")), 2))


def cites_by_team_size(spark: SparkSession, d: str, as_of: int = 2017) -> DataFrame:
    """Mean citations a year by number of authors and year."""
    s = Star(spark, d)
    n = s.slots.filter(F.col("year") < as_of).groupBy("paper_id", "year", "cited_count").agg(count_rows("n"))
    per = F.coalesce("cited_count", F.lit(0)) / (F.lit(as_of) - F.col("year"))
    return n.groupBy("year", seven_plus(F.col("n")).alias("authors")).agg(F.round(F.avg(per), 6).alias("cites_per_year"), count_rows("papers"))


def team_sizes(spark: SparkSession, d: str) -> DataFrame:
    s = Star(spark, d)
    n = s.authorship.groupBy("paper_id").agg(count_rows("n"))
    return n.groupBy(team_size(F.col("n")).alias("team")).agg(count_rows("papers"), F.min("n").alias("least"), F.max("n").alias("most"))


def first_authors(spark: SparkSession, d: str) -> DataFrame:
    """Papers that each person leads."""
    return Star(spark, d).authorship.filter("pos = 1").groupBy("person_id").agg(count_rows("led"))


def denormalised_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers with their authors' ids and names joined in order: the wide form that the corpus file holds."""
    s = Star(spark, d)
    a = s.authorship.join(s.persons.select("person_id", "name"), "person_id").groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("pos", "person_id", "name"))).alias("l"))
    text = lambda f: F.array_join(F.transform("l", f), ",")
    return s.papers.select("paper_id", "year").join(a, "paper_id").select("paper_id", "year", text(lambda x: x["person_id"].cast("string")).alias("author_ids"), text(lambda x: x["name"]).alias("authors"))


_FNS = [
    papers_per_year_zero_filled, growth_first_seen, growth_after, authors_per_year, papers_by_venue_type, author_paper_cite_counts, top_percent_authors, top_cited_authors_named, local_citations_per_author, local_cites, citation_list, harmonic_contribution, uniform_contribution, weighted_contribution_harmonic, weighted_contribution_uniform, h_index, h_index_compat, h_index_leaders, collaboration_pairs, directed_pairs_by_venue, coauthor_sources, committee_roster, seats_per_author, pc_paper_share, gender_by_year, gender_topN_mix, set_overlap_matrix, team_size_share, cites_by_team_size, team_sizes, first_authors, denormalised_papers
]
QUERIES = {f.__name__: f for f in _FNS}

_APC = "apc AS (SELECT p.person_id, coalesce(x.papers, 0) AS papers, coalesce(x.cites, 0) AS cites FROM (SELECT DISTINCT person_id FROM aut) p LEFT JOIN (SELECT person_id, count(*) AS papers, CAST(sum(coalesce(cited_count, 0)) AS BIGINT) AS cites FROM slots WHERE year >= {} GROUP BY 1) x USING (person_id))"
_TOP = "(SELECT *, row_number() OVER (ORDER BY {0} DESC, person_id) AS r, count(*) OVER () AS n FROM {1})"


def _contribution(each: str, weight: str) -> str:
    return STAR + f" SELECT person_id, round(sum(s * {weight}), 6) AS score FROM (SELECT *, ({each}) / sum({each}) OVER (PARTITION BY paper_id) AS s FROM slots) GROUP BY 1"


SQL = {
    "papers_per_year_zero_filled": STAR + " SELECT CAST(y.range AS INTEGER) AS year, count(p.paper_id) AS papers FROM range(1970, 2030) y LEFT JOIN pap p ON p.year = y.range GROUP BY 1",
    "growth_first_seen": STAR + ", f AS (SELECT year, count(*) AS new_authors FROM (SELECT person_id, min(year) AS year FROM slots WHERE year IS NOT NULL GROUP BY 1) GROUP BY 1) SELECT p.year, count(*) AS papers, coalesce(any_value(f.new_authors), 0) AS new_authors FROM pap p LEFT JOIN f USING (year) WHERE p.year IS NOT NULL GROUP BY 1",
    "growth_after": STAR + ", f AS (SELECT year, count(*) AS new_authors FROM (SELECT person_id, min(year) AS year FROM slots WHERE year BETWEEN 1993 AND 2016 GROUP BY 1) GROUP BY 1), g AS (SELECT year, count(*) AS papers FROM pap WHERE year BETWEEN 1993 AND 2016 GROUP BY 1) SELECT year, papers, coalesce(new_authors, 0) AS new_authors FROM g LEFT JOIN f USING (year) WHERE year > (SELECT min(year) FROM g)",
    "authors_per_year": STAR + " SELECT year, count(DISTINCT name) AS authors FROM slots JOIN per USING (person_id) WHERE year IS NOT NULL GROUP BY 1",
    "papers_by_venue_type": STAR + " SELECT 'conferences' AS permitted, count(*) AS papers FROM pap JOIN ven USING (venue_id) WHERE ven.is_conference UNION ALL SELECT 'journals', count(*) FROM pap JOIN ven USING (venue_id) WHERE NOT ven.is_conference UNION ALL SELECT 'all', count(*) FROM pap",
    "author_paper_cite_counts": STAR + ", " + _APC.format(2000) + " SELECT * FROM apc",
    "top_percent_authors": STAR + ", " + _APC.format(2000) + " SELECT person_id, papers, cites FROM " + _TOP.format("cites", "apc") + " WHERE r <= CAST(floor(0.01::DOUBLE * n) AS BIGINT)",
    "top_cited_authors_named": STAR + ", " + _APC.format(2000) + " SELECT person_id, name, papers, cites FROM " + _TOP.format("cites", "apc") + " JOIN per USING (person_id) WHERE r <= CAST(floor(0.01::DOUBLE * n) AS BIGINT)",
    "local_citations_per_author": STAR + " SELECT person_id, count(*) AS papers, CAST(sum(coalesce(c, 0)) AS BIGINT) AS local_cites FROM aut LEFT JOIN (SELECT dst AS paper_id, count(*) AS c FROM cit GROUP BY 1) USING (paper_id) GROUP BY 1",
    "local_cites": STAR + " SELECT paper_id, coalesce(c, 0) AS local_cites FROM pap LEFT JOIN (SELECT dst AS paper_id, count(*) AS c FROM cit GROUP BY 1) USING (paper_id)",
    "citation_list": STAR + " SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS cited, count(*) AS n FROM cit GROUP BY 1",
    "harmonic_contribution": _contribution("1.0::DOUBLE / pos", "1"),
    "uniform_contribution": _contribution("1.0::DOUBLE", "1"),
    "weighted_contribution_harmonic": _contribution("1.0::DOUBLE / pos", "(coalesce(cited_count, 0) + 1)"),
    "weighted_contribution_uniform": _contribution("1.0::DOUBLE", "(coalesce(cited_count, 0) + 1)"),
    "h_index": STAR + " SELECT person_id, CAST(coalesce(max(CASE WHEN c >= i THEN i END), 0) AS INTEGER) AS h FROM (SELECT person_id, coalesce(cited_count, 0) AS c, row_number() OVER (PARTITION BY person_id ORDER BY coalesce(cited_count, 0) DESC, paper_id) AS i FROM slots) GROUP BY 1",
    "h_index_compat": STAR + " SELECT person_id, CAST(coalesce(min(CASE WHEN i - 1 > c THEN i - 1 END), 0) AS INTEGER) AS h FROM (SELECT person_id, coalesce(cited_count, 0) AS c, row_number() OVER (PARTITION BY person_id ORDER BY coalesce(cited_count, 0) DESC, paper_id) AS i FROM slots) GROUP BY 1",
    "h_index_leaders": STAR + " SELECT person_id, name, CAST(h AS INTEGER) AS h FROM (SELECT person_id, coalesce(max(CASE WHEN c >= i THEN i END), 0) AS h FROM (SELECT person_id, coalesce(cited_count, 0) AS c, row_number() OVER (PARTITION BY person_id ORDER BY coalesce(cited_count, 0) DESC, paper_id) AS i FROM slots) GROUP BY 1) JOIN per USING (person_id) ORDER BY h DESC, person_id LIMIT 100",
    "collaboration_pairs": STAR + " SELECT * FROM pairs",
    "directed_pairs_by_venue": STAR + " SELECT x.venue_id, x.person_id AS src, y.person_id AS dst, count(*) AS n FROM slots x JOIN slots y ON x.paper_id = y.paper_id AND x.pos < y.pos WHERE x.venue_id IS NOT NULL GROUP BY 1, 2, 3",
    "coauthor_sources": STAR + " SELECT x.person_id AS src, count(DISTINCT y.person_id) AS coauthors FROM (SELECT *, max(pos) OVER (PARTITION BY paper_id) AS last FROM aut) x JOIN aut y ON x.paper_id = y.paper_id AND x.person_id <> y.person_id WHERE x.pos < x.last GROUP BY 1",
    "committee_roster": STAR + " SELECT venue_id, year, count(*) AS seats, string_agg(s || ':' || name, '; ' ORDER BY s, name COLLATE \"C\", person_id) AS members FROM (SELECT pc.*, per.name, CASE role WHEN 'General Chair' THEN 'GC' WHEN 'Program Chair' THEN 'PC' WHEN 'PC member main track' THEN 'PCM' END AS s FROM pc_membership pc JOIN per USING (person_id)) GROUP BY 1, 2",
    "seats_per_author": STAR + " SELECT person_id, coalesce(n, 0) AS seats FROM (SELECT DISTINCT person_id FROM aut) LEFT JOIN (SELECT person_id, count(*) AS n FROM pc_membership GROUP BY 1) USING (person_id)",
    "pc_paper_share": STAR + " SELECT venue_id, year, count(*) AS papers, count(pcp.paper_id) AS pc_papers, round(100.0::DOUBLE * count(pcp.paper_id) / count(*), 2) AS share FROM pap p JOIN ven USING (venue_id) LEFT JOIN pcp USING (paper_id) WHERE ven.is_conference AND year IS NOT NULL GROUP BY ROLLUP (venue_id, year)",
    "gender_by_year": STAR + " SELECT year, m, f, u, CASE WHEN m + f > 0 THEN round(100.0::DOUBLE * f / (m + f), 2) END AS percent_f FROM (SELECT year, count(*) FILTER (WHERE gender = 'm') AS m, count(*) FILTER (WHERE gender = 'f') AS f, count(*) FILTER (WHERE gender IS NULL OR gender = 'u') AS u FROM slots LEFT JOIN per USING (person_id) WHERE year IS NOT NULL GROUP BY 1)",
    "gender_topN_mix": STAR + ", " + _APC.format(2000) + ", rk AS (SELECT r, coalesce(gender, 'u') AS g FROM " + _TOP.format("cites", "apc") + " LEFT JOIN per USING (person_id)) SELECT top_n, count(*) FILTER (WHERE g = 'm') AS m, count(*) FILTER (WHERE g = 'f') AS f, count(*) FILTER (WHERE g = 'u') AS u FROM rk JOIN (SELECT unnest([10, 20, 50, 100, 200, 500, 1000]) AS top_n) ON r <= top_n GROUP BY 1",
    "set_overlap_matrix": STAR + ", " + _APC.format(0) + ", hc AS (SELECT person_id, round(sum(s), 6) AS x FROM (SELECT *, (1.0::DOUBLE / pos) / sum(1.0::DOUBLE / pos) OVER (PARTITION BY paper_id) AS s FROM slots) GROUP BY 1), hi AS (SELECT person_id, coalesce(max(CASE WHEN c >= i THEN i END), 0) AS x FROM (SELECT person_id, coalesce(cited_count, 0) AS c, row_number() OVER (PARTITION BY person_id ORDER BY coalesce(cited_count, 0) DESC, paper_id) AS i FROM slots) GROUP BY 1), t AS (SELECT 'cites' AS s, person_id FROM " + _TOP.format("cites", "apc") + " WHERE r <= floor(0.01::DOUBLE * n) UNION ALL SELECT 'harmonic', person_id FROM " + _TOP.format("x", "hc") + " WHERE r <= floor(0.01::DOUBLE * n) UNION ALL SELECT 'h', person_id FROM " + _TOP.format("x", "hi") + " WHERE r <= floor(0.01::DOUBLE * n)) SELECT a.s AS first, b.s AS second, count(*) AS shared FROM t a JOIN t b USING (person_id) GROUP BY 1, 2",
    "team_size_share": STAR + " SELECT year, authors, papers, round(papers / CAST(sum(papers) OVER (PARTITION BY year) AS DOUBLE), 2) AS share FROM (SELECT year, CASE WHEN n < 7 THEN CAST(n AS VARCHAR) ELSE '7+' END AS authors, count(*) AS papers FROM (SELECT paper_id, year, count(*) AS n FROM slots WHERE year IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2)",
    "cites_by_team_size": STAR + " SELECT year, CASE WHEN n < 7 THEN CAST(n AS VARCHAR) ELSE '7+' END AS authors, round(avg(coalesce(cited_count, 0) / CAST(2017 - year AS DOUBLE)), 6) AS cites_per_year, count(*) AS papers FROM (SELECT paper_id, year, cited_count, count(*) AS n FROM slots WHERE year < 2017 GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "team_sizes": STAR + " SELECT CASE WHEN n = 1 THEN 'Single' WHEN n <= 4 THEN 'Small' ELSE 'Large' END AS team, count(*) AS papers, min(n) AS least, max(n) AS most FROM (SELECT paper_id, count(*) AS n FROM aut GROUP BY 1) GROUP BY 1",
    "first_authors": STAR + " SELECT person_id, count(*) AS led FROM aut WHERE pos = 1 GROUP BY 1",
    "denormalised_papers": STAR + " SELECT paper_id, year, string_agg(CAST(person_id AS VARCHAR), ',' ORDER BY pos, person_id) AS author_ids, string_agg(name, ',' ORDER BY pos, person_id) AS authors FROM pap JOIN aut USING (paper_id) JOIN per USING (person_id) GROUP BY 1, 2",
}
