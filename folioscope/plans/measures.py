"""Reports on text, statistics, classification and communities, and on the driver's events and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.common import table
from folioscope.functions import scalar
from folioscope.operators import community, ml, stats, text
from folioscope.operators.rank import collaborations
from folioscope.operators.relational import min_max
from folioscope.operators.star import Star
from folioscope.plans._sql import STAR


#: Words of the reference's network: 5000 with the one that stands for all others, which has no links.
NETWORK = 4999


def count_rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _docs(s: Star) -> DataFrame:
    """Abstract, else title, of every paper that has either."""
    return s.papers.select("paper_id", "venue_id", "year", F.coalesce("abstract", "title").alias("text")).filter("text is not null")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of all papers with their number of papers and of occurrences."""
    c = text.term_counts(_docs(Star(spark, d)), "paper_id", F.col("text"))
    return c.groupBy("term").agg(count_rows("papers"), F.sum("tf").alias("uses"))


def tfidf_top_terms(spark: SparkSession, d: str, n: int = 100) -> DataFrame:
    """The hundred words of largest mean TF-IDF."""
    docs = _docs(Star(spark, d))
    size = docs.count()
    w = text.tf_idf(text.term_counts(docs, "paper_id", F.col("text")), "paper_id", size)
    m = text.mean_weight(w, size).select("term", F.round("mean_w", 6).alias("mean_w"))
    return m.orderBy(F.desc("mean_w"), "term").limit(n)


def idf_by_term(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(Star(spark, d))
    x = text.smooth_idf(text.term_counts(docs, "paper_id", F.col("text")), "paper_id", docs.count())
    return x.select("term", "df", F.round("idf", 6).alias("idf"))


def chi2_terms(spark: SparkSession, d: str) -> DataFrame:
    """Chi-square of the words' counts against the venue type."""
    s = Star(spark, d)
    docs = _docs(s).join(F.broadcast(s.venues.select("venue_id", "is_conference")), "venue_id")
    c = text.term_counts(docs, "paper_id", F.col("text"))
    x = text.chi2(c, docs.select("paper_id", "is_conference"), "paper_id", "is_conference")
    return x.select("term", F.round("chi2", 4).alias("chi2"))


def cooccurrence(spark: SparkSession, d: str, vocabulary: int = 200) -> DataFrame:
    """In how many papers each two of the most frequent words meet."""
    sets = text.term_counts(_docs(Star(spark, d)), "paper_id", F.col("text")).select("paper_id", "term")
    top = sets.groupBy("term").agg(count_rows("n")).orderBy(F.desc("n"), "term").limit(vocabulary).select("term")
    return text.cooccurrence(sets.join(F.broadcast(top), "term"), "paper_id")


def cited_word_links(spark: SparkSession, d: str, vocabulary: int = 40) -> DataFrame:
    """How often a frequent word of a citing paper meets one of the cited paper."""
    s = Star(spark, d)
    sets = text.term_counts(_docs(s), "paper_id", F.col("text")).select("paper_id", "term")
    top = sets.groupBy("term").agg(count_rows("n")).orderBy(F.desc("n"), "term").limit(vocabulary).select("term")
    kept = sets.join(F.broadcast(top), "term")
    # words are counted by cited paper first, so that one cited often meets its own words once
    x = s.citations.join(kept.select(F.col("paper_id").alias("src"), F.col("term").alias("i")), "src").groupBy("dst", "i").agg(count_rows("n"))
    x = x.join(kept.select(F.col("paper_id").alias("dst"), F.col("term").alias("j")), "dst")
    return x.groupBy("i", "j").agg(F.sum("n").alias("weight"))


def cooccurrence_whole(spark: SparkSession, d: str) -> DataFrame:
    """cooccurrence with the reference's vocabulary."""
    return cooccurrence(spark, d, NETWORK)


def cited_word_links_whole(spark: SparkSession, d: str) -> DataFrame:
    """cited_word_links with the reference's vocabulary."""
    return cited_word_links(spark, d, NETWORK)


def negative_sampling_table_whole(spark: SparkSession, d: str) -> DataFrame:
    """negative_sampling_table with the reference's vocabulary."""
    return negative_sampling_table(spark, d, NETWORK)


def negative_sampling_table(spark: SparkSession, d: str, vocabulary: int = 200) -> DataFrame:
    """Cumulative share of degree^0.75 by which words are drawn, over the co-occurring words."""
    c = cooccurrence(spark, d, vocabulary)
    deg = c.select(F.col("i").alias("term")).unionByName(c.select(F.col("j").alias("term"))).groupBy("term").agg(count_rows("degree"))
    p = F.pow("degree", F.lit(0.75))
    w = Window.orderBy("term")  # the vocabulary is bounded
    return deg.withColumn("p", p).select("term", "degree", F.round(F.sum("p").over(w) / F.sum("p").over(Window.partitionBy()), 6).alias("upto"))


def doc_embedding_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector by label of the embeddings: all of its coordinates."""
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return x.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean")).select("label", F.col("i").cast("int").alias("i"), "mean")


def cosine_to_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Cosine and Euclidean distance of each vector to the mean of its label."""
    e = table(spark, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    x = e.join(F.broadcast(mean), "label")
    v = F.transform("embedding", lambda y: y.cast("double"))
    return x.select("vec_id", F.round(scalar.cosine(v, F.col("c")), 4).alias("cosine"), F.round(scalar.euclid(v, F.col("c")), 4).alias("euclid"))


def lda_topics(spark: SparkSession, d: str) -> DataFrame:
    """The ten strongest words of each topic of a variational LDA over all papers."""
    model, vocabulary, _ = text.topic_model(_docs(Star(spark, d)), "paper_id", F.col("text"))
    return text.top_words(model, vocabulary, 10)


def lda_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Log likelihood and log perplexity of LDA for some numbers of topics."""
    docs = _docs(Star(spark, d))
    out = []
    for k in (5, 10):
        model, _, x = text.topic_model(docs, "paper_id", F.col("text"), k=k, alpha=50.0 / k, beta=0.01, iterations=5)
        x = x.select("features").cache()
        out.append((k, float(model.logLikelihood(x)), float(model.logPerplexity(x))))
        x.unpersist()
    return spark.createDataFrame(out, "topics int, log_likelihood double, log_perplexity double")


def topic_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Stability under another order: for each topic of one fit the best overlap of its words with a second fit's."""
    docs = _docs(Star(spark, d))
    words = []
    for seed in (1, 2):
        model, vocabulary, _ = text.topic_model(docs, "paper_id", F.col("text"), iterations=5, seed=seed)
        words.append(text.top_words(model, vocabulary, 20).groupBy("topic").agg(F.collect_set("term").alias("w")))
    x = words[0].select(F.col("topic").alias("a"), F.col("w").alias("wa"), F.explode("w").alias("t")).join(words[1].select(F.col("topic").alias("b"), F.explode("w").alias("t")), "t")
    n = x.groupBy("a", "b").agg(count_rows("n")).groupBy("a").agg(F.max("n").alias("n"))
    return words[0].select(F.col("topic").alias("a")).join(n, "a", "left").select(F.col("a").alias("topic"), (F.coalesce("n", F.lit(0)) / 20).alias("overlap"))


# statistics

def _cites(s: Star) -> DataFrame:
    """Citations a year of papers of known year before 2017, with their venue type."""
    per = F.coalesce("cited_count", F.lit(0)) / (F.lit(2017) - F.col("year"))
    v = F.broadcast(s.venues.select("venue_id", F.when(F.col("is_conference"), "conference").otherwise("journal").alias("kind")))
    return s.papers.filter("year < 2017").join(v, "venue_id").select("paper_id", "year", "kind", per.alias("cites"))


def a12_by_venue_type(spark: SparkSession, d: str) -> DataFrame:
    """Chance that a journal paper has more citations a year than a conference paper, by year."""
    return stats.a12(_cites(Star(spark, d)), "kind", "cites", "journal", "conference", ["year"])


def positional_quantiles(spark: SparkSession, d: str) -> DataFrame:
    s = Star(spark, d)
    x = s.papers.filter("year is not null").select("year", F.coalesce("cited_count", F.lit(0)).alias("c"))
    return stats.positional(x, "c", ["year"])


def median_iqr(spark: SparkSession, d: str) -> DataFrame:
    """Median and interpolated interquartile range of citations a year, by venue type and year."""
    x = _cites(Star(spark, d)).groupBy("kind", "year")
    return x.agg(F.round(F.median("cites"), 6).alias("median"), F.round(F.percentile("cites", F.lit(0.75)) - F.percentile("cites", F.lit(0.25)), 6).alias("iqr"), count_rows("papers"))


def moments(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sample standard deviation of citations by year."""
    x = Star(spark, d).papers.filter("year is not null").select("year", F.coalesce("cited_count", F.lit(0)).alias("c"))
    return x.groupBy("year").agg(F.round(F.avg("c"), 6).alias("mean"), F.round(F.stddev_samp("c"), 6).alias("sd"), count_rows("n"))


def cites_by_venue_type(spark: SparkSession, d: str) -> DataFrame:
    return _cites(Star(spark, d)).groupBy("year", "kind").agg(F.round(F.avg("cites"), 6).alias("cites_per_year"), count_rows("papers"))


def scaled_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of papers scaled to 0..1 within their year."""
    x = Star(spark, d).papers.filter("year is not null").select("paper_id", "year", F.coalesce("cited_count", F.lit(0)).cast("double").alias("c"))
    return min_max(x, "c", "year").select("paper_id", F.round("c", 6).alias("scaled"))


def bootstrap_diff(spark: SparkSession, d: str) -> DataFrame:
    """Whether journal papers are cited more a year than conference papers, by year."""
    return stats.bootstrap_by(_cites(Star(spark, d)), "kind", "cites", "conference", "journal", ["year"])


def scott_knott_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of team sizes by citations a year, by stretch of years."""
    s = Star(spark, d)
    n = s.authorship.groupBy("paper_id").agg(count_rows("n"))
    x = _cites(s).join(n, "paper_id").select(scalar.year_interval(F.col("year")).alias("years"), scalar.team_size(F.col("n")).alias("team"), "cites")
    return stats.scott_knott_by(x, "team", "cites", ["years"])


# classification

def strat_folds(spark: SparkSession, d: str) -> DataFrame:
    x = Star(spark, d).papers.filter("venue_id is not null").select("paper_id", "venue_id")
    return ml.stratified_folds(x, "venue_id", "paper_id", 5).select("paper_id", "fold")


def fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Papers by fold of a shuffled split."""
    x = Star(spark, d).papers.select("paper_id")
    return ml.shuffled_folds(x, "paper_id", 10).groupBy("fold").agg(count_rows("papers"))


def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A rule that calls a paper cited if it has four authors or more, against the truth, by venue type."""
    s = Star(spark, d)
    n = s.authorship.groupBy("paper_id").agg(count_rows("n"))
    x = s.papers.join(F.broadcast(s.venues.select("venue_id", F.col("is_conference").alias("conf"))), "venue_id").join(n, "paper_id")
    return ml.confusion(x, F.coalesce("cited_count", F.lit(0)) > 0, F.col("n") >= 4, ["conf"])


def weighted_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A rule that guesses a paper's decade from its id, with class-weighted rates."""
    x = Star(spark, d).papers.filter("year is not null").select(F.floor(F.col("year") / 10).alias("actual"), (F.lit(199) + F.pmod("paper_id", F.lit(3))).alias("said"))
    return ml.weighted_metrics(x, "actual", "said")


def classifier_cv(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated venue type from text, by five classifiers over five folds: median and spread over folds."""
    s = Star(spark, d)
    docs = _docs(s).join(F.broadcast(s.venues.select("venue_id", "is_conference")), "venue_id")
    return ml.median_iqr(ml.cross_validated(docs, F.col("text"), "is_conference", "paper_id", k=5), "classifier", ["accuracy", "precision", "recall", "f1"])


# communities

def _venue_edges(s: Star) -> DataFrame:
    """Pairs of co-authors by venue; the author who stands for those not listed links nobody."""
    a = s.slots.join(s.persons.filter("lower(name) not like 'et al%'").select("person_id"), "person_id", "left_semi").filter("venue_id is not null")
    x, y = a.select("paper_id", "venue_id", F.col("person_id").alias("a")), a.select("paper_id", F.col("person_id").alias("b"))
    return x.join(y, "paper_id").filter("a < b").select("venue_id", "a", "b").distinct()


def components_by_venue(spark: SparkSession, d: str) -> DataFrame:
    return community.least_labels(_venue_edges(Star(spark, d)), ["venue_id"]).select("venue_id", F.col("id").alias("person_id"), "component")


def community_ground_truth(spark: SparkSession, d: str) -> DataFrame:
    return community.ground_truth(_venue_edges(Star(spark, d)))


def venue_transitivity(spark: SparkSession, d: str) -> DataFrame:
    return community.transitivity(_venue_edges(Star(spark, d)))


def community_separability(spark: SparkSession, d: str) -> DataFrame:
    """Committees as communities of the co-author graph."""
    s = Star(spark, d)
    home = s.pc.groupBy("person_id").agg(F.min("venue_id").alias("community")).withColumnRenamed("person_id", "id")
    edges = collaborations(s.authorship.filter("person_id <> 1")).select("a", "b")
    return community.separability(edges, home)


def pair_performance(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a year's committee against pairs that have written together."""
    s = Star(spark, d)
    seats = s.pc.select(F.concat_ws("-", "venue_id", "year").alias("k"), "person_id").distinct()
    truth = community.member_pairs(seats, "k", "person_id")
    return community.pair_performance(collaborations(s.authorship).select("a", "b"), truth, s.authorship.select("person_id").distinct().count())


def bfs_path_len(spark: SparkSession, d: str, most: int | None = 4) -> DataFrame:
    """Steps from the author of lowest id, other than the one who stands for many, to others, up to four as in the SQL."""
    s = Star(spark, d)
    e = collaborations(s.authorship.filter("person_id <> 1")).select("a", "b")
    start = s.authorship.filter("person_id <> 1").agg(F.min("person_id")).first()[0]
    if start is None:
        return spark.createDataFrame([], "person_id long, hops int")
    return community.hops(e, int(start), most).select(F.col("id").alias("person_id"), "hops")


def bfs_path_len_whole(spark: SparkSession, d: str) -> DataFrame:
    """Steps from the same author to all whom a path reaches, however long."""
    return bfs_path_len(spark, d, None)


def csr_index(spark: SparkSession, d: str) -> DataFrame:
    """Citations as compressed sparse rows with offsets."""
    return community.adjacency_offsets(Star(spark, d).citations)


# events and the like

def event_props_json(spark: SparkSession, d: str) -> DataFrame:
    """Events by type, their JSON properties read with a schema."""
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k int, v double, s string"))
    return e.groupBy("event_type").agg(count_rows("events"), F.sum(F.col("p").isNotNull().cast("long")).alias("parsed"), F.round(F.sum("value"), 2).alias("total"))


def role_case(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).pc.groupBy(scalar.short_role(F.col("role")).alias("role")).agg(count_rows("seats"))


def interval_buckets(spark: SparkSession, d: str) -> DataFrame:
    x = Star(spark, d).papers.filter("year >= 1992")
    return x.groupBy(scalar.year_interval(F.col("year")).alias("years")).agg(count_rows("papers"), F.min(scalar.two_digit_year(F.col("year"))).alias("least_two"))


def first_names(spark: SparkSession, d: str) -> DataFrame:
    """People by first name."""
    return Star(spark, d).persons.groupBy(scalar.first_name(F.col("name")).alias("first_name")).agg(count_rows("people"))


def name_gender_counts(spark: SparkSession, d: str) -> DataFrame:
    """Men and women by first name: the table that gender resolution looks names up in."""
    p = Star(spark, d).persons.select(scalar.first_name(F.col("name")).alias("first_name"), "gender")
    return p.groupBy("first_name").agg(F.sum(F.when(F.col("gender") == "m", 1).otherwise(0)).alias("males"), F.sum(F.when(F.col("gender") == "f", 1).otherwise(0)).alias("females"))


def gender_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Gender as registered, else by the majority of the first name, else unknown."""
    s = Star(spark, d)
    by_name = name_gender_counts(spark, d).select("first_name", F.when(F.col("males") > F.col("females"), "m").when(F.col("females") > F.col("males"), "f").alias("guess"))
    x = s.persons.withColumn("first_name", scalar.first_name(F.col("name"))).join(by_name, "first_name", "left")
    return x.select("person_id", F.coalesce("gender", "guess", F.lit("u")).alias("gender"))


def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    """First names by their full form where the alias table knows it."""
    n = table(spark, d, "nicknames").groupBy(F.lower("nickname").alias("first_name")).agg(F.min(F.lower("given_name")).alias("canonical"))
    p = Star(spark, d).persons.select("person_id", scalar.first_name(F.col("name")).alias("first_name"))
    return p.join(F.broadcast(n), "first_name", "left").select("person_id", F.coalesce("canonical", "first_name").alias("canonical"))


def title_year_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The other source's venue of papers by lower-case title and year, else by title alone."""
    from folioscope.operators.relational import fallback_lookup

    a = table(spark, d, "aminer_papers").select(F.lower("title").alias("key"), "year", "venue").filter("key is not null and venue is not null")
    p = Star(spark, d).papers.select("paper_id", F.lower("title").alias("key"), "year")
    return fallback_lookup(p, a, ["key", "year"], ["key"], "venue").select("paper_id", "venue")


def doi_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Papers by host of their DOI link."""
    p = Star(spark, d).papers.filter("doi_url is not null")
    return p.groupBy(scalar.url_parts(F.col("doi_url"))["host"].alias("host")).agg(count_rows("papers"))


def titles_without_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return Star(spark, d).papers.filter("title is not null").select("paper_id", scalar.without_punctuation(F.col("title")).alias("title"))


def submission_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Valid submissions by conference, year and decision."""
    from folioscope.operators import rejects

    s = rejects.clean_rows(table(spark, d, "raw_lines"), "submissions")
    return s.groupBy(F.concat_ws("-", "conference", "year").alias("edition"), F.lower("decision").alias("decision")).agg(count_rows("n"))


def submission_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Acceptance by conference and in all (grouping sets)."""
    from folioscope.operators import rejects

    s = rejects.clean_rows(table(spark, d, "raw_lines"), "submissions")
    return s.rollup("conference").agg(count_rows("n"), F.sum((F.lower("decision") == "accept").cast("long")).alias("accepted"))


_FNS = [tokens, tfidf_top_terms, idf_by_term, chi2_terms, cooccurrence, cited_word_links, negative_sampling_table, cooccurrence_whole, cited_word_links_whole, negative_sampling_table_whole, doc_embedding_mean, cosine_to_centroid, lda_topics, lda_likelihood, topic_overlap, a12_by_venue_type, positional_quantiles, median_iqr, moments, cites_by_venue_type, scaled_citations, bootstrap_diff, scott_knott_ranks, strat_folds, fold_sizes, confusion_metrics, weighted_metrics, classifier_cv, components_by_venue, community_ground_truth, venue_transitivity, community_separability, pair_performance, bfs_path_len, bfs_path_len_whole, csr_index, event_props_json, role_case, interval_buckets, first_names, name_gender_counts, gender_resolution, alias_resolution, title_year_lookup, doi_hosts, titles_without_punctuation, submission_decisions, submission_acceptance]
QUERIES = {f.__name__: f for f in _FNS}

_DOC = STAR + ", doc AS (SELECT paper_id, venue_id, year, coalesce(abstract, title) AS text FROM pap WHERE coalesce(abstract, title) IS NOT NULL), tc AS (SELECT paper_id, w AS term, count(*) AS tf FROM wrd GROUP BY 1, 2)"
_COOC = _DOC + ", top AS (SELECT term FROM tc GROUP BY 1 ORDER BY count(*) DESC, term LIMIT @N@), kept AS (SELECT paper_id, term FROM tc WHERE term IN (SELECT term FROM top))"
_CIT = STAR + ", c AS (SELECT p.paper_id, year, CASE WHEN ven.is_conference THEN 'conference' ELSE 'journal' END AS kind, coalesce(cited_count, 0) / CAST(2017 - year AS DOUBLE) AS cites FROM pap p JOIN ven USING (venue_id) WHERE year < 2017)"
_FN = STAR + r", fn AS (SELECT person_id, gender, lower(split_part(coalesce(list_filter(l, lambda t: length(t) > 1)[1], l[-1]), '-', 1)) AS first_name FROM (SELECT *, [regexp_replace(t, '\.+$', '') for t in regexp_split_to_array(trim(name), '\s+')] AS l FROM per))"
_EDGES = STAR + ", na AS (SELECT s.* FROM slots s WHERE person_id IN (SELECT person_id FROM per WHERE lower(name) NOT LIKE 'et al%') AND venue_id IS NOT NULL), ve AS (SELECT DISTINCT x.venue_id, x.person_id AS a, y.person_id AS b FROM na x JOIN na y ON x.paper_id = y.paper_id AND x.person_id < y.person_id)"
SQL = {
    "tokens": _DOC + " SELECT term, count(*) AS papers, CAST(sum(tf) AS BIGINT) AS uses FROM tc GROUP BY 1",
    "tfidf_top_terms": _DOC + ", n AS (SELECT count(*) AS n FROM doc), i AS (SELECT term, ln((1.0::DOUBLE + n) / (1 + count(*))) + 1 AS idf FROM tc, n GROUP BY term, n), x AS (SELECT paper_id, term, tf * idf AS raw FROM tc JOIN i USING (term)), w AS (SELECT term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY paper_id)) AS w FROM x) SELECT term, round(sum(w) / n, 6) AS mean_w FROM w, n GROUP BY term, n ORDER BY mean_w DESC, term LIMIT 100",
    "idf_by_term": _DOC + " SELECT term, count(*) AS df, round(ln((1.0::DOUBLE + n) / (1 + count(*))) + 1, 6) AS idf FROM tc, (SELECT count(*) AS n FROM doc) GROUP BY term, n",
    "chi2_terms": _DOC + ", l AS (SELECT doc.paper_id, ven.is_conference AS k FROM doc JOIN ven USING (venue_id)), p AS (SELECT k, count(*) / CAST((SELECT count(*) FROM l) AS DOUBLE) AS p FROM l GROUP BY 1), t AS (SELECT term, sum(tf)::DOUBLE AS t FROM tc JOIN l USING (paper_id) GROUP BY 1), o AS (SELECT term, k, sum(tf)::DOUBLE AS o FROM tc JOIN l USING (paper_id) GROUP BY 1, 2) SELECT term, round(sum((coalesce(o, 0) - t * p) ^ 2 / (t * p)), 4) AS chi2 FROM t CROSS JOIN p LEFT JOIN o USING (term, k) GROUP BY 1",
    "cooccurrence": _COOC.replace("@N@", "200") + " SELECT x.term AS i, y.term AS j, count(*) AS weight FROM kept x JOIN kept y ON x.paper_id = y.paper_id AND x.term < y.term GROUP BY 1, 2",
    "cited_word_links": _COOC.replace("@N@", "40") + " SELECT x.term AS i, y.term AS j, count(*) AS weight FROM cit JOIN kept x ON x.paper_id = src JOIN kept y ON y.paper_id = dst GROUP BY 1, 2",
    "negative_sampling_table": _COOC.replace("@N@", "200") + ", co AS (SELECT DISTINCT x.term AS i, y.term AS j FROM kept x JOIN kept y ON x.paper_id = y.paper_id AND x.term < y.term), dg AS (SELECT term, count(*) AS degree FROM (SELECT i AS term FROM co UNION ALL SELECT j FROM co) GROUP BY 1) SELECT term, degree, round(sum(pow(degree, 0.75::DOUBLE)) OVER (ORDER BY term) / sum(pow(degree, 0.75::DOUBLE)) OVER (), 6) AS upto FROM dg",
    "doc_embedding_mean": "SELECT label, CAST(i - 1 AS INTEGER) AS i, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2",
    "cosine_to_centroid": "WITH m AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 4) AS cosine, round(list_distance(embedding::DOUBLE[], c), 4) AS euclid FROM embeddings JOIN c USING (label)",
    "a12_by_venue_type": _CIT + ", v AS (SELECT year, cites, count(*) FILTER (WHERE kind = 'journal') AS x, count(*) FILTER (WHERE kind = 'conference') AS y FROM c GROUP BY 1, 2), w AS (SELECT *, coalesce(sum(y) OVER (PARTITION BY year ORDER BY cites ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v) SELECT year, CASE WHEN sum(x) > 0 AND sum(y) > 0 THEN round(sum(x * (below + y / 2.0::DOUBLE)) / CAST(sum(x) * sum(y) AS DOUBLE), 6) END AS a12 FROM w GROUP BY 1",
    "positional_quantiles": STAR + ", x AS (SELECT year, list(coalesce(cited_count, 0) ORDER BY coalesce(cited_count, 0)) AS l FROM pap WHERE year IS NOT NULL GROUP BY 1), y AS (SELECT *, CAST(floor(len(l) * 0.25::DOUBLE) AS BIGINT) AS q, CAST(floor(len(l) * 0.1::DOUBLE) AS BIGINT) AS t, CAST(floor(len(l) * 0.75::DOUBLE) AS BIGINT) AS h FROM x) SELECT year, l[q + 1] AS q1, l[2 * q + 1] AS q2, l[3 * q + 1] AS q3, l[t + 1] AS p10, l[3 * t + 1] AS p30, l[5 * t + 1] AS p50, l[7 * t + 1] AS p70, l[9 * t + 1] AS p90, l[h + 1] - l[q + 1] AS spread FROM y",
    "median_iqr": _CIT + " SELECT kind, year, round(median(cites), 6) AS median, round(quantile_cont(cites, 0.75) - quantile_cont(cites, 0.25), 6) AS iqr, count(*) AS papers FROM c GROUP BY 1, 2",
    "moments": STAR + " SELECT year, round(avg(coalesce(cited_count, 0)), 6) AS mean, round(stddev_samp(coalesce(cited_count, 0)), 6) AS sd, count(*) AS n FROM pap WHERE year IS NOT NULL GROUP BY 1",
    "cites_by_venue_type": _CIT + " SELECT year, kind, round(avg(cites), 6) AS cites_per_year, count(*) AS papers FROM c GROUP BY 1, 2",
    "scaled_citations": STAR + " SELECT paper_id, round(CASE WHEN hi > lo THEN (c - lo) / (hi - lo)::DOUBLE ELSE 0 END, 6) AS scaled FROM (SELECT paper_id, coalesce(cited_count, 0) AS c, min(coalesce(cited_count, 0)) OVER (PARTITION BY year) AS lo, max(coalesce(cited_count, 0)) OVER (PARTITION BY year) AS hi FROM pap WHERE year IS NOT NULL)",
    "strat_folds": STAR + " SELECT paper_id, CAST(ntile(5) OVER (PARTITION BY venue_id ORDER BY paper_id) AS INTEGER) AS fold FROM pap WHERE venue_id IS NOT NULL",
    "confusion_metrics": STAR + ", x AS (SELECT ven.is_conference AS conf, coalesce(cited_count, 0) > 0 AS a, n >= 4 AS p FROM pap JOIN ven USING (venue_id) JOIN (SELECT paper_id, count(*) AS n FROM aut GROUP BY 1) USING (paper_id)), y AS (SELECT conf, count(*) FILTER (WHERE a AND p) AS tp, count(*) FILTER (WHERE NOT a AND p) AS fp, count(*) FILTER (WHERE a AND NOT p) AS fn, count(*) FILTER (WHERE NOT a AND NOT p) AS tn FROM x GROUP BY 1), z AS (SELECT *, tp / (tp + fp + 1e-8) AS pr, tp / (tp + fn + 1e-8) AS rc FROM y) SELECT conf, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn + 1e-8), 6) AS accuracy, round(pr, 6) AS precision, round(rc, 6) AS recall, round(tn / (tn + fp + 1e-8), 6) AS specificity, round(2 * pr * rc / (pr + rc + 1e-8), 6) AS f1 FROM z",
    "weighted_metrics": STAR + ", x AS (SELECT CAST(floor(year / 10.0) AS BIGINT) AS a, 199 + paper_id % 3 AS p FROM pap WHERE year IS NOT NULL), c AS (SELECT a AS k, count(*)::DOUBLE AS s, count(*) FILTER (WHERE a = p)::DOUBLE AS tp FROM x GROUP BY 1), q AS (SELECT p AS k, count(*)::DOUBLE AS said FROM x GROUP BY 1), y AS (SELECT *, coalesce(tp / said, 0) AS pr, tp / s AS rc FROM c LEFT JOIN q USING (k)) SELECT round(sum(tp) / sum(s), 6) AS accuracy, round(sum(pr * s) / sum(s), 6) AS precision, round(sum(rc * s) / sum(s), 6) AS recall, round(sum(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END * s) / sum(s), 6) AS f1 FROM y",
    "components_by_venue": _EDGES.replace("WITH pap", "WITH RECURSIVE pap") + ", bo AS (SELECT venue_id, a AS x, b AS y FROM ve UNION SELECT venue_id, b, a FROM ve), reach AS (SELECT DISTINCT venue_id, x, x AS y FROM bo UNION SELECT r.venue_id, r.x, bo.y FROM reach r JOIN bo ON bo.venue_id = r.venue_id AND bo.x = r.y) SELECT venue_id, x AS person_id, min(y) AS component FROM reach GROUP BY 1, 2",
    "venue_transitivity": _EDGES + ", dg AS (SELECT venue_id, id, count(*) AS d FROM (SELECT venue_id, a AS id FROM ve UNION ALL SELECT venue_id, b FROM ve) GROUP BY 1, 2), tp AS (SELECT venue_id, sum(d * (d - 1) / 2.0::DOUBLE) AS t FROM dg GROUP BY 1), tr AS (SELECT x.venue_id, count(*) AS n FROM ve x JOIN ve y ON y.venue_id = x.venue_id AND y.a = x.b JOIN ve z ON z.venue_id = x.venue_id AND z.a = x.a AND z.b = y.b GROUP BY 1) SELECT venue_id, coalesce(n, 0) AS triangles, CASE WHEN t > 0 THEN round(3 * coalesce(n, 0) / t, 6) ELSE 0.0::DOUBLE END AS transitivity FROM tp LEFT JOIN tr USING (venue_id)",
    "community_separability": STAR + ", m AS (SELECT person_id AS id, min(venue_id) AS community FROM pc_membership GROUP BY 1), e AS (SELECT pairs.a, pairs.b, x.community AS ca, y.community AS cb FROM pairs LEFT JOIN m x ON x.id = a LEFT JOIN m y ON y.id = b WHERE a <> 1), ms AS (SELECT ca AS community, count(*) AS ms FROM e WHERE ca = cb GROUP BY 1), cs AS (SELECT community, count(*) AS cs FROM (SELECT ca AS community FROM e WHERE ca IS NOT NULL AND ca IS DISTINCT FROM cb UNION ALL SELECT cb FROM e WHERE cb IS NOT NULL AND ca IS DISTINCT FROM cb) GROUP BY 1) SELECT community, count(*) AS size, coalesce(any_value(ms), 0) AS ms, coalesce(any_value(cs), 0) AS cs, CASE WHEN coalesce(any_value(cs), 0) > 0 THEN round(coalesce(any_value(ms), 0) / any_value(cs)::DOUBLE, 6) ELSE coalesce(any_value(ms), 0)::DOUBLE END AS separability FROM m LEFT JOIN ms USING (community) LEFT JOIN cs USING (community) GROUP BY 1",
    "pair_performance": STAR + ", t AS (SELECT DISTINCT x.person_id AS a, y.person_id AS b FROM seats x JOIN seats y USING (venue_id, year) WHERE x.person_id < y.person_id), c AS (SELECT count(*) FILTER (WHERE p.a IS NOT NULL AND t.a IS NOT NULL) AS tp, count(*) FILTER (WHERE p.a IS NULL) AS fp, count(*) FILTER (WHERE t.a IS NULL) AS fn, (SELECT count(DISTINCT person_id) FROM aut) AS n FROM pairs p FULL JOIN t ON p.a = t.a AND p.b = t.b) SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 6) ELSE 0.0::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 6) ELSE 0.0::DOUBLE END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) ELSE 0.0::DOUBLE END AS f1, round((n * (n - 1) // 2 - fp - fn) / (n * (n - 1) // 2)::DOUBLE, 6) AS accuracy FROM c",
    "bfs_path_len": STAR.replace("WITH pap", "WITH RECURSIVE pap") + ", e AS (SELECT a AS x, b AS y FROM pairs WHERE a <> 1 UNION ALL SELECT b, a FROM pairs WHERE a <> 1), walk AS (SELECT min(person_id) AS id, 0 AS hops FROM aut WHERE person_id <> 1 UNION SELECT e.y, hops + 1 FROM walk JOIN e ON e.x = walk.id WHERE hops < 4) SELECT id AS person_id, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY 1",
    "csr_index": STAR + ", e AS (SELECT src AS node, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS targets, count(*) AS degree FROM cit WHERE src <> dst GROUP BY 1) SELECT *, CAST(coalesce(sum(degree) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM e",
    "role_case": "SELECT CASE role WHEN 'General Chair' THEN 'GC' WHEN 'Program Chair' THEN 'PC' WHEN 'PC member main track' THEN 'PCM' END AS role, count(*) AS seats FROM pc_membership GROUP BY 1",
    "event_props_json": "SELECT event_type, count(*) AS events, count(*) FILTER (WHERE json_valid(props)) AS parsed, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "interval_buckets": STAR + " SELECT lo || '-' || (lo + 3) AS years, count(*) AS papers, min(right(CAST(year AS VARCHAR), 2)) AS least_two FROM (SELECT year, 1992 + (year - 1992) // 4 * 4 AS lo FROM pap WHERE year >= 1992) GROUP BY 1",
    "first_names": _FN + " SELECT first_name, count(*) AS people FROM fn GROUP BY 1",
    "name_gender_counts": _FN + " SELECT first_name, count(*) FILTER (WHERE gender = 'm') AS males, count(*) FILTER (WHERE gender = 'f') AS females FROM fn GROUP BY 1",
    "gender_resolution": _FN + ", g AS (SELECT first_name, count(*) FILTER (WHERE gender = 'm') AS m, count(*) FILTER (WHERE gender = 'f') AS f FROM fn GROUP BY 1) SELECT person_id, coalesce(gender, CASE WHEN m > f THEN 'm' WHEN f > m THEN 'f' END, 'u') AS gender FROM fn LEFT JOIN g USING (first_name)",
    "alias_resolution": _FN + " SELECT person_id, coalesce(c, first_name) AS canonical FROM fn LEFT JOIN (SELECT lower(nickname) AS first_name, min(lower(given_name)) AS c FROM nicknames GROUP BY 1) USING (first_name)",
    "title_year_lookup": STAR + ", a AS (SELECT lower(title) AS key, year, venue FROM aminer_papers WHERE title IS NOT NULL AND venue IS NOT NULL), x AS (SELECT key, year, max(venue) AS v FROM a GROUP BY 1, 2), y AS (SELECT key, max(venue) AS v FROM a GROUP BY 1) SELECT paper_id, coalesce(x.v, y.v) AS venue FROM pap p LEFT JOIN x ON x.key = lower(p.title) AND x.year = p.year LEFT JOIN y ON y.key = lower(p.title)",
    "doi_hosts": STAR + " SELECT split_part(split_part(doi_url, '/', 3), '.', -2) AS host, count(*) AS papers FROM pap WHERE doi_url IS NOT NULL AND trim(doi_url) NOT IN ('', 'None') GROUP BY 1",
    "titles_without_punctuation": STAR + r""" SELECT paper_id, trim(regexp_replace(title, '[!-/:-@\[-`{-~]', '', 'g')) AS title FROM pap WHERE title IS NOT NULL""",
}
