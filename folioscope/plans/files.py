"""Round trips through the file formats, updates, submissions, and the remaining reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.common import shared_dir, table
from folioscope.operators import rejects, text
from folioscope.operators.relational import upsert
from folioscope.operators.star import TOPICS, Star
from folioscope.plans._sql import STAR
from folioscope.plans.quality import _PARSED
from folioscope.sources import readers, sinks


def count_rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def corpus_file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All papers written as a corpus file and read again."""
    s = Star(spark, d)
    path = _path(spark, "corpus")
    sinks.corpus_file(s.papers, path)
    names = ", ".join(f"`{c.lower()}` string" for c in rejects.CORPUS)
    back = spark.read.csv(path, sep="$|$", quote="", escape="", schema=names)
    v = {c: F.when(F.col(c) != "None", F.col(c)) for c in ("venue", "year", "title", "cited_count")}
    return back.select(F.col("id").cast("long").alias("paper_id"), v["venue"].cast("int").alias("venue_id"), v["year"].cast("int").alias("year"), v["title"].alias("title"), v["cited_count"].cast("int").alias("cited_count"))


def edge_list_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Citations written as an edge list and read again; loops are left out."""
    path = _path(spark, "edges")
    sinks.edge_list(Star(spark, d).citations, path, "\t")
    return readers.edge_list(spark, path).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def tagged_text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The other source written as tagged text and read again, one row a record."""
    a = table(spark, d, "aminer_papers").select("aminer_id", F.regexp_replace("title", r"\s+", " ").alias("title"), "year", "refs").distinct()
    lines = F.concat_ws("\n", F.concat(F.lit("#*"), "title"), F.concat(F.lit("#t"), F.col("year").cast("string")), F.concat(F.lit("#index"), F.col("aminer_id").cast("string")), F.array_join(F.transform("refs", lambda r: F.concat(F.lit("#%"), r.cast("string"))), "\n"))
    path = _path(spark, "tagged")
    a.select(lines.alias("value")).write.option("lineSep", "\n\n").text(path)
    return readers.tagged_text(spark, path).select(F.col("id").cast("long").alias("aminer_id"), "title", "year", F.size("refs").cast("long").alias("n_refs"))


def cluster_file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Committees written one a line and read again: their sizes and how often each occurs."""
    seats = Star(spark, d).pc.select(F.concat_ws("-", "venue_id", "year").alias("cluster"), F.col("person_id").alias("node")).distinct()
    path = _path(spark, "clusters")
    sinks.clusters(seats, path, "\t")
    n = readers.cluster_lines(spark, path).groupBy("cluster").agg(count_rows("size"))
    return n.groupBy("size").agg(count_rows("clusters"))


def html_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Venues as rows of an HTML table, scraped again."""
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    v = table(spark, d, "venues").select("venue_id", F.concat(F.lit("<table><tr>"), cell("acronym"), cell("name"), F.lit("</tr></table>")).alias("html"))
    return readers.html_tables(v, "venue_id", "html").select("venue_id", F.element_at("cells", 1).alias("acronym"), F.element_at("cells", 2).alias("name"))


def citation_update(spark: SparkSession, d: str) -> DataFrame:
    """First deliveries of papers with their citations overwritten by later deliveries that have any."""
    p = table(spark, d, "papers")
    w = Window.partitionBy("paper_id").orderBy("loaded_at", F.desc_nulls_last("cited_count"))
    r = p.select("paper_id", "loaded_at", "cited_count", F.row_number().over(w).alias("k"))
    return upsert(r.filter("k = 1").select("paper_id", "cited_count"), r.filter("k > 1").select("paper_id", "cited_count", "k"), ["paper_id"], ["cited_count"], F.col("k"))


def _submissions(spark: SparkSession, d: str) -> DataFrame:
    s = rejects.clean_rows(table(spark, d, "raw_lines"), "submissions")
    return s.withColumn("decision", F.lower("decision")).withColumn("raw", F.lower("raw_decision"))


def _sub_topics(s: DataFrame) -> DataFrame:
    w = s.select("line_id", F.explode(text.words(F.when(F.col("abstract").isin("", "None"), F.col("title")).otherwise(F.col("abstract")))).alias("w"))
    return w.groupBy("line_id", (F.length("w") % TOPICS).cast("int").alias("topic")).agg(count_rows("cnt"))


def decision_topic_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean topic counts of accepted and rejected submissions by conference."""
    s = _submissions(spark, d)
    size = s.groupBy("conference", "decision").agg(count_rows("n"))
    x = _sub_topics(s).join(s.select("line_id", "conference", "decision"), "line_id").groupBy("conference", "decision", "topic").agg(F.sum("cnt").alias("c"))
    return x.join(size, ["conference", "decision"]).select("conference", "decision", "topic", F.round(F.col("c") / F.col("n"), 6).alias("mean"))


def _bucket() -> Column:
    """The first that applies: strong reject, strong accept, reject, accept."""
    raw, no = F.col("raw"), F.col("decision") == "reject"
    return F.when(no & raw.contains("strong reject"), "pre-reject").when(raw.contains("strong accept"), "pre-accept").when(no, "reject").otherwise("accept")


def priority_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Submissions by bucket of priority."""
    return _submissions(spark, d).groupBy(_bucket().alias("bucket")).agg(count_rows("submissions"))


def reputation(spark: SparkSession, d: str) -> DataFrame:
    """Citations of first authors, by name, of submissions: by conference and decision, and by decision (grouping sets
    over one pass). Authors that the corpus doesn't know have 0; of equal names the most cited counts."""
    s = Star(spark, d)
    cites = s.slots.groupBy("person_id").agg(F.sum(F.coalesce("cited_count", F.lit(0))).alias("c")).join(s.persons, "person_id").groupBy("name").agg(F.max("c").alias("c"))
    x = _submissions(spark, d).select("conference", "decision", F.trim(F.split("authors", ",")[0]).alias("name")).join(cites, "name", "left")
    x = x.withColumn("c", F.coalesce("c", F.lit(0)))
    q = lambda p: F.percentile("c", F.lit(p))
    got = x.groupingSets([[F.col("conference"), F.col("decision")], [F.col("decision")]], "conference", "decision").agg(
        F.median("c").alias("median"), (q(0.75) - q(0.25)).alias("iqr"), F.max("c").alias("most"), F.min("c").alias("least"), count_rows("n"), F.grouping("conference").alias("all")
    )
    return got.withColumn("conference", F.when(F.col("all") == 1, "All").otherwise(F.col("conference"))).drop("all")


def priority_topic_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Mean topic counts of submissions by bucket of priority, and by how much each differs from those of rejects."""
    s = _submissions(spark, d).withColumn("bucket", _bucket())
    size = s.groupBy("bucket").agg(count_rows("n"))
    x = _sub_topics(s).join(s.select("line_id", "bucket"), "line_id").groupBy("bucket", "topic").agg(F.sum("cnt").alias("c")).join(size, "bucket")
    x = x.select("bucket", "topic", (F.col("c") / F.col("n")).alias("mean"))
    base = x.filter("bucket = 'reject'").select("topic", F.col("mean").alias("base"))
    return x.join(base, "topic", "left").select("bucket", "topic", F.round("mean", 6).alias("mean"), F.round(F.col("mean") - F.coalesce("base", F.lit(0.0)), 6).alias("delta"))


def author_index(spark: SparkSession, d: str) -> DataFrame:
    """Dense index of authors from 0 by id, in two levels, so that no task holds all of them."""
    a = Star(spark, d).authorship.select("person_id").distinct().withColumn("b", F.floor(F.col("person_id") / 4096))
    base = a.groupBy("b").agg(count_rows("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    k = F.row_number().over(Window.partitionBy("b").orderBy("person_id")) - 1
    return a.join(base, "b").select("person_id", (F.col("base") + k).alias("idx"))


def chi2_selected(spark: SparkSession, d: str, share: float = 0.2) -> DataFrame:
    """The fifth of all words that tells venue types apart best."""
    from folioscope.operators.relational import top_percent
    from folioscope.plans.measures import chi2_terms

    return top_percent(chi2_terms(spark, d), share, F.desc("chi2"), F.asc("term")).select("term")


def unsorted_edges(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of authorship that came out of order of their paper: a check of sorted input by lag."""
    a = table(spark, d, "authorship").filter("person_id is not null").select("paper_id", "person_id", "pos", "loaded_at").distinct()
    w = Window.partitionBy("paper_id").orderBy("loaded_at", "pos", "person_id")
    x = a.withColumn("before", F.lag("pos").over(w)).filter("before > pos")
    return x.groupBy("paper_id").agg(count_rows("out_of_order"))


def word_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Word2Vec (instead of first-order LINE) over all papers: the vector of each word."""
    from pyspark.ml.feature import Word2Vec

    s = Star(spark, d)
    docs = s.papers.select(text.words(F.coalesce("abstract", "title")).alias("words")).filter("words is not null")
    v = Word2Vec(vectorSize=16, minCount=5, maxIter=1, seed=1, inputCol="words", outputCol="v").fit(docs).getVectors()
    from pyspark.ml.functions import vector_to_array

    return v.select("word", vector_to_array("vector").alias("v"))


def document_projection(spark: SparkSession, d: str) -> DataFrame:
    """Two principal components of the embeddings (instead of t-SNE)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("f"))
    x = PCA(k=2, inputCol="f", outputCol="p").fit(e).transform(e)
    return x.select("vec_id", vector_to_array("p")[0].alias("x"), vector_to_array("p")[1].alias("y"))


_FNS = [corpus_file_round_trip, edge_list_round_trip, tagged_text_round_trip, cluster_file_round_trip, html_round_trip, citation_update, decision_topic_means, priority_buckets, priority_topic_vectors, reputation, author_index, chi2_selected, unsorted_edges, word_vectors, document_projection]
QUERIES = {f.__name__: f for f in _FNS}

_SUB = _PARSED.rstrip() + ", sub AS (SELECT line_id, v[1] AS conference, v[3] AS title, v[4] AS authors, v[6] AS abstract, lower(v[8]) AS decision, lower(v[9]) AS raw FROM good_s)"
SQL = {
    "corpus_file_round_trip": STAR + r" SELECT paper_id, venue_id, year, regexp_replace(title, '[\r\n]+', ' ', 'g') AS title, cited_count FROM pap",
    "edge_list_round_trip": STAR + " SELECT src, dst, count(*)::DOUBLE AS weight FROM cit WHERE src <> dst GROUP BY 1, 2",
    "tagged_text_round_trip": r"SELECT DISTINCT aminer_id, nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), '') AS title, year, coalesce(len(refs), 0)::BIGINT AS n_refs FROM aminer_papers",
    "cluster_file_round_trip": "SELECT size, count(*) AS clusters FROM (SELECT venue_id, year, count(DISTINCT person_id) AS size FROM pc_membership GROUP BY 1, 2) GROUP BY 1",
    "html_round_trip": "SELECT venue_id, acronym, name FROM venues",
    "citation_update": "WITH r AS (SELECT paper_id, cited_count, row_number() OVER (PARTITION BY paper_id ORDER BY loaded_at, cited_count DESC NULLS LAST) AS k FROM papers) SELECT a.paper_id, coalesce(b.c, a.cited_count) AS cited_count FROM r a LEFT JOIN (SELECT paper_id, arg_max(cited_count, k) AS c FROM r WHERE k > 1 AND cited_count IS NOT NULL GROUP BY 1) b USING (paper_id) WHERE k = 1",
    "decision_topic_means": _SUB + ", sw AS (SELECT line_id, unnest(regexp_extract_all(lower(CASE WHEN abstract IN ('', 'None') THEN title ELSE abstract END), '[\\p{L}\\p{N}_]{3,}')) AS w FROM sub), n AS (SELECT conference, decision, count(*) AS n FROM sub GROUP BY 1, 2) SELECT conference, decision, CAST(length(w) % 11 AS INTEGER) AS topic, round(count(*) / any_value(n)::DOUBLE, 6) AS mean FROM sw JOIN sub USING (line_id) JOIN n USING (conference, decision) GROUP BY 1, 2, 3",
    "priority_buckets": _SUB + " SELECT CASE WHEN decision = 'reject' AND contains(raw, 'strong reject') THEN 'pre-reject' WHEN contains(raw, 'strong accept') THEN 'pre-accept' WHEN decision = 'reject' THEN 'reject' ELSE 'accept' END AS bucket, count(*) AS submissions FROM sub GROUP BY 1",
    "priority_topic_vectors": _SUB + ", b AS (SELECT line_id, abstract, title, CASE WHEN decision = 'reject' AND contains(raw, 'strong reject') THEN 'pre-reject' WHEN contains(raw, 'strong accept') THEN 'pre-accept' WHEN decision = 'reject' THEN 'reject' ELSE 'accept' END AS bucket FROM sub), sw AS (SELECT line_id, bucket, unnest(regexp_extract_all(lower(CASE WHEN abstract IN ('', 'None') THEN title ELSE abstract END), '[\\p{L}\\p{N}_]{3,}')) AS w FROM b), m AS (SELECT bucket, CAST(length(w) % 11 AS INTEGER) AS topic, count(*) / any_value(n)::DOUBLE AS mean FROM sw JOIN (SELECT bucket, count(*) AS n FROM b GROUP BY 1) USING (bucket) GROUP BY 1, 2) SELECT m.bucket, m.topic, round(m.mean, 6) AS mean, round(m.mean - coalesce(r.mean, 0), 6) AS delta FROM m LEFT JOIN (SELECT * FROM m WHERE bucket = 'reject') r USING (topic)",
    "reputation": _SUB.replace("WITH ", "WITH ", 1) + ", rn AS (SELECT person_id, name FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY loaded_at DESC, name) k FROM persons) WHERE k = 1), rp AS (SELECT paper_id, cited_count FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY loaded_at DESC, cited_count DESC NULLS LAST) k FROM papers) WHERE k = 1), rc AS (SELECT name, max(c) AS c FROM (SELECT person_id, sum(coalesce(cited_count, 0)) AS c FROM (SELECT DISTINCT paper_id, person_id FROM authorship WHERE person_id IS NOT NULL) JOIN rp USING (paper_id) GROUP BY 1) JOIN rn USING (person_id) GROUP BY 1), rx AS (SELECT conference, decision, CAST(coalesce(c, 0) AS BIGINT) AS c FROM sub LEFT JOIN rc ON rc.name = trim(split_part(authors, ',', 1))) SELECT CASE WHEN grouping(conference) = 1 THEN 'All' ELSE conference END AS conference, decision, median(c)::DOUBLE AS median, quantile_cont(c, 0.75)::DOUBLE - quantile_cont(c, 0.25)::DOUBLE AS iqr, max(c) AS most, min(c) AS least, count(*) AS n FROM rx GROUP BY GROUPING SETS ((conference, decision), (decision))",
    "author_index": STAR + " SELECT person_id, row_number() OVER (ORDER BY person_id) - 1 AS idx FROM (SELECT DISTINCT person_id FROM aut)",
    "unsorted_edges": "WITH a AS (SELECT DISTINCT paper_id, person_id, pos, loaded_at FROM authorship WHERE person_id IS NOT NULL), x AS (SELECT paper_id, pos, lag(pos) OVER (PARTITION BY paper_id ORDER BY loaded_at, pos, person_id) AS b FROM a) SELECT paper_id, count(*) AS out_of_order FROM x WHERE b > pos GROUP BY 1",
}
from folioscope.plans.measures import SQL as _M  # noqa: E402

SQL["chi2_selected"] = "SELECT term FROM (SELECT *, row_number() OVER (ORDER BY chi2 DESC, term) AS r, count(*) OVER () AS n FROM (" + _M["chi2_terms"] + ")) WHERE r <= floor(0.2::DOUBLE * n)"
SQL["submission_decisions"] = _PARSED + " SELECT v[1] || '-' || v[2] AS edition, lower(v[8]) AS decision, count(*) AS n FROM good_s GROUP BY 1, 2"
SQL["submission_acceptance"] = _PARSED + " SELECT v[1] AS conference, count(*) AS n, count(*) FILTER (WHERE lower(v[8]) = 'accept') AS accepted FROM good_s GROUP BY ROLLUP (v[1])"
