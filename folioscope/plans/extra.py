"""Look-ups, dictionaries, orderings and venue prediction that the other reports don't cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.common import cut, table
from folioscope.functions import scalar
from folioscope.operators import community, ml, stats, text
from folioscope.operators.relational import ranked
from folioscope.operators.star import TOPICS, Star
from folioscope.plans._sql import STAR
from folioscope.plans.measures import _docs, _venue_edges

#: Venues that reports may ignore, hosts of no use as sources, and groups of venues (by number modulo 6).
IGNORED = ("ICSE", "FSE")
DENIED = ("doi.acm.org", "example.org")
GROUPS = "ABCDEF"
#: Words that the vocabulary holds apart; all others are one.
VOCABULARY = 4999
UNKNOWN = "UNK"
BATCHES = 16
#: Communities kept by FOMD, and the share of them kept by density.
BY_FOMD, BY_DENSITY = 3000, 0.75


def papers_without_ignored(spark: SparkSession, d: str) -> DataFrame:
    """Papers of venues that are not to be ignored, by venue."""
    s = Star(spark, d)
    v = F.broadcast(s.venues.filter(~F.col("acronym").isin(*IGNORED)).select("venue_id", "acronym"))
    return s.papers.join(v, "venue_id").groupBy("acronym").agg(F.count(F.lit(1)).alias("papers"))


def title_and_abstract(spark: SparkSession, d: str) -> DataFrame:
    """Title, full stop and abstract where there is one, as one text: its length."""
    p = Star(spark, d).papers.filter("title is not null")
    both = F.when(F.col("abstract").isNotNull(), F.concat("title", F.lit(". "), "abstract")).otherwise(F.col("title"))
    return p.select("paper_id", F.length(both).cast("long").alias("n"))


def allowed_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Papers by the host of their DOI, without hosts that are denied."""
    p = Star(spark, d).papers.select(F.regexp_extract("doi_url", "^[a-z]+://([^/]+)", 1).alias("host")).filter("host <> ''")
    return p.filter(~F.col("host").isin(*DENIED)).groupBy("host").agg(F.count(F.lit(1)).alias("papers"))


def _listed(df: DataFrame, by: str, *order: str) -> DataFrame:
    """Papers of each value of ``by`` in order, as ids joined by commas."""
    items = F.array_sort(F.collect_list(F.struct(*order, "paper_id")))
    return df.groupBy(by).agg(F.array_join(F.transform(items, lambda x: x["paper_id"].cast("string")), ",").alias("papers"))


def papers_by_venue(spark: SparkSession, d: str) -> DataFrame:
    """Papers of each venue in order of their year as text."""
    p = Star(spark, d).papers.filter("venue_id is not null and year is not null")
    return _listed(p.select("venue_id", "paper_id", F.col("year").cast("string").alias("y")), "venue_id", "y")


def papers_by_author(spark: SparkSession, d: str) -> DataFrame:
    """Papers of each author in order of venue and year."""
    return _listed(Star(spark, d).slots.filter("venue_id is not null and year is not null"), "person_id", "venue_id", "year")


def top_authors_by_name(spark: SparkSession, d: str, most: int = 100) -> DataFrame:
    """The most cited authors by name; of equal names the most cited counts."""
    s = Star(spark, d)
    c = s.slots.groupBy("person_id").agg(F.sum(F.coalesce("cited_count", F.lit(0))).alias("cites"))
    return c.join(s.persons, "person_id").filter("name is not null").groupBy("name").agg(F.max("cites").alias("cites")).orderBy(F.desc("cites"), "name").limit(most)


def _word_places(spark: SparkSession, d: str) -> DataFrame:
    """(term, uses, place): words in falling order of use."""
    c = text.term_counts(_docs(Star(spark, d)), "paper_id", F.col("text")).groupBy("term").agg(F.sum("tf").alias("uses"))
    return ranked(c, F.desc("uses"), F.asc("term"))


def document_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of the words of each document, by coordinate. The k-th most frequent word has the k-th vector of the
    table (in order of their ids); words beyond have none, and a document without any is all zeros."""
    docs = _docs(Star(spark, d))
    vec = ranked(table(spark, d, "embeddings").select("vec_id", "embedding"), F.asc("vec_id")).select("place", "embedding")
    words = cut(_word_places(spark, d).select("term", "place").join(vec, "place").select("term", "embedding"), "vectors")
    used = text.term_counts(docs, "paper_id", F.col("text")).join(words, "term").select("paper_id", "tf", F.posexplode("embedding").alias("i", "x"))
    mean = used.groupBy("paper_id", "i").agg((F.sum(F.col("tf") * F.col("x").cast("double")) / F.sum("tf")).alias("m"))
    every = docs.select("paper_id").crossJoin(F.broadcast(spark.range(64).select(F.col("id").cast("int").alias("i"))))
    return every.join(mean, ["paper_id", "i"], "left").select("paper_id", "i", (F.round(F.coalesce("m", F.lit(0.0)), 4) + 0.0).alias("mean"))


def first_seen_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Words numbered from 0 in the order in which they are first seen, by paper and place in it."""
    w = _docs(Star(spark, d)).select("paper_id", F.posexplode(text.words("text")).alias("i", "term"))
    first = w.groupBy("term").agg(F.min(F.struct("paper_id", "i")).alias("at")).select("term", "at.*")
    return ranked(first, F.asc("paper_id"), F.asc("i"), F.asc("term")).select("term", (F.col("place") - 1).alias("idx"))


def vocabulary_with_unknown(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent words with their uses, and all others as one."""
    w = _word_places(spark, d)
    return w.groupBy(F.when(F.col("place") <= VOCABULARY, F.col("term")).otherwise(UNKNOWN).alias("term")).agg(F.sum("uses").alias("uses"))


def venues_by_topic_weight(spark: SparkSession, d: str) -> DataFrame:
    """Venues in falling order of the sum of their topic counts: the row order of a matrix before it is clustered."""
    s = Star(spark, d)
    x = s.doc_topics.join(s.papers.select("paper_id", "venue_id"), "paper_id").filter("venue_id is not null").groupBy("venue_id").agg(F.sum("cnt").alias("weight"))
    return ranked(x, F.desc("weight"), F.asc("venue_id")).select("venue_id", "weight", "place")


def dictionary_update(spark: SparkSession, d: str) -> DataFrame:
    """Maps of acronym and impact: known impacts updated by those of conferences doubled, then filtered and looked up."""
    v = Star(spark, d).venues.filter("acronym is not null").groupBy("acronym").agg(F.max("impact").alias("impact"), F.max(F.col("is_conference").cast("int")).alias("conf"))
    entries = lambda c, cond: F.map_from_entries(F.collect_list(F.when(cond, F.struct("acronym", c))))
    one = v.agg(entries(F.col("impact").alias("v"), F.col("impact").isNotNull()).alias("a"), entries((F.col("impact") * 2).alias("v"), F.col("impact").isNotNull() & (F.col("conf") == 1)).alias("b"))
    # an update keeps the old keys that the new map lacks
    kept = F.map_filter("a", lambda k, _: ~F.map_contains_key("b", k))
    merged = one.select(F.map_filter(F.map_concat(kept, "b"), lambda _, x: x > 1).alias("m"))
    return merged.select(F.explode("m").alias("acronym", "impact"))


def papers_by_venue_group(spark: SparkSession, d: str) -> DataFrame:
    """Papers by group of venues, a fixed dimension."""
    group = F.get(F.array(*[F.lit(g) for g in GROUPS]), F.pmod("venue_id", F.lit(len(GROUPS))))
    return Star(spark, d).papers.filter("venue_id is not null").groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("papers"))


def papers_with_titles(spark: SparkSession, d: str) -> DataFrame:
    """Papers whose title is one of the other source's (semi-join)."""
    titles = table(spark, d, "aminer_papers").select("title").filter("title is not null").distinct()
    return Star(spark, d).papers.join(titles, "title", "left_semi").select("paper_id", "title")


def edge_batches(spark: SparkSession, d: str) -> DataFrame:
    """Citations dealt in turn to batches: edges and sum of sources by batch."""
    e = Star(spark, d).citations.distinct()
    b = ranked(e, F.asc("src"), F.asc("dst")).withColumn("batch", F.pmod(F.col("place") - 1, F.lit(BATCHES)).cast("int"))
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("edges"), F.sum("src").alias("sources"))


def word_links_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """The word network with links both ways and of each word to itself, as the learner of word vectors takes it: links
    and their weight by word, over the vocabulary."""
    known = _word_places(spark, d).filter(F.col("place") <= VOCABULARY).select("term")
    sets = text.term_counts(_docs(Star(spark, d)), "paper_id", F.col("text")).join(known, "term").select("paper_id", "term")
    x = sets.select("paper_id", F.col("term").alias("i"))
    pairs = x.join(x.select("paper_id", F.col("i").alias("j")), "paper_id").groupBy("i", "j").agg(F.count(F.lit(1)).alias("weight"))
    return pairs.groupBy(F.col("i").alias("term")).agg(F.count(F.lit(1)).alias("links"), F.sum("weight").alias("weight"))


def communities_kept(spark: SparkSession, d: str) -> DataFrame:
    """Communities by FOMD, of these the three quarters of largest density: two cuts one after the other."""
    g = cut(community.ground_truth(_venue_edges(Star(spark, d))), "communities")
    first = ranked(g, F.desc("fomd"), F.asc("venue_id"), F.asc("component")).filter(F.col("place") <= BY_FOMD).drop("place")
    first = cut(first, "by_fomd")
    n = int(BY_DENSITY * first.count())
    return ranked(first, F.desc("density"), F.asc("venue_id"), F.asc("component")).filter(F.col("place") <= n).drop("place")


def communities_by_fomd(spark: SparkSession, d: str, most: int = 100) -> DataFrame:
    """The communities of largest FOMD with their members."""
    e = cut(_venue_edges(Star(spark, d)), "edges")
    top = community.ground_truth(e).orderBy(F.desc("fomd"), "venue_id", "component").limit(most)
    members = community.least_labels(e, ["venue_id"])
    return members.join(F.broadcast(top.select("venue_id", "component", "fomd")), ["venue_id", "component"]).select("venue_id", "component", F.col("id").alias("person_id"), "fomd")


def gender_topic_different(spark: SparkSession, d: str) -> DataFrame:
    """Whether the topic counts of men's and women's papers differ, by venue and topic: effect size and bootstrap over
    counted values."""
    s = Star(spark, d)
    who = s.slots.join(s.persons.filter("gender in ('m', 'f')").select("person_id", "gender"), "person_id").filter("venue_id is not null").select("paper_id", "venue_id", "gender")
    x = who.join(s.doc_topics, "paper_id").select("venue_id", "topic", "gender", "cnt")
    return stats.bootstrap_by(x, "gender", "cnt", "m", "f", ["venue_id", "topic"])


def venue_prediction(spark: SparkSession, d: str, folds: tuple[int, ...] | None = None) -> DataFrame:
    """Group of venues from text, by every pre-processor and classifier: median and spread over five folds, each held out
    in turn unless ``folds`` names some."""
    s = Star(spark, d)
    group = F.get(F.array(*[F.lit(g) for g in GROUPS]), F.pmod("venue_id", F.lit(len(GROUPS))))
    docs = _docs(s).filter("venue_id is not null").withColumn("grp", group)
    got = ml.compared(docs, "text", "grp", "paper_id", folds=folds)
    spread = lambda c: F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))
    cols = [e for c in ("accuracy", "f1") for e in (F.round(F.median(c), 2).alias(f"{c}_median"), F.round(spread(c), 2).alias(f"{c}_iqr"))]
    return got.groupBy("pre", "classifier").agg(*cols)


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    """Truth from text, numbers where text holds one, logarithms of positive numbers, the logistic curve and harmonic
    weights, for every paper."""
    x = F.coalesce("cited_count", F.lit(0)).cast("double")
    p = Star(spark, d).papers.select("paper_id", "is_conference", x.alias("c"))
    return p.select(
        "paper_id",
        scalar.is_true(F.col("is_conference")).alias("truth"),
        scalar.number_if_possible(F.when(F.pmod("paper_id", F.lit(3)) == 0, "n/a").otherwise(F.col("paper_id").cast("string"))).alias("number"),
        F.round(scalar.safe_log(F.col("c") - 3), 6).alias("ln"),
        F.round(scalar.sigmoid(F.col("c") / 10 - 1), 6).alias("logistic"),
        F.round(F.element_at(scalar.harmonic_weights((F.pmod("paper_id", F.lit(4)) + 1).cast("int")), -1), 6).alias("last_weight"),
    )


def plain_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of people down to their plain letters, and of venues in their short form."""
    s = Star(spark, d)
    people = s.persons.filter("name is not null").select(F.lit("person").alias("kind"), F.col("person_id").cast("long").alias("id"), scalar.plain_letters("name").alias("plain"))
    return people.unionByName(s.venues.select(F.lit("venue").alias("kind"), F.col("venue_id").cast("long").alias("id"), scalar.short_venue(F.col("acronym")).alias("plain")))


_FNS = [scalar_functions, plain_names, papers_without_ignored, title_and_abstract, allowed_hosts, papers_by_venue, papers_by_author, top_authors_by_name, document_vectors, first_seen_dictionary, vocabulary_with_unknown, venues_by_topic_weight, dictionary_update, papers_by_venue_group, papers_with_titles, edge_batches, word_links_both_ways, communities_kept, communities_by_fomd, gender_topic_different, venue_prediction]
QUERIES = {f.__name__: f for f in _FNS}

_PLACES = STAR + ", uses AS (SELECT w AS term, count(*) AS uses FROM wrd WHERE w IS NOT NULL GROUP BY 1), places AS (SELECT *, row_number() OVER (ORDER BY uses DESC, term COLLATE \"C\") AS place FROM uses)"
_EDGES = (
    STAR + ", known AS (SELECT s.* FROM slots s JOIN per USING (person_id) WHERE lower(name) NOT LIKE 'et al%' AND venue_id IS NOT NULL)"
    ", e AS (SELECT DISTINCT x.venue_id, x.person_id AS a, y.person_id AS b FROM known x JOIN known y ON x.paper_id = y.paper_id AND x.person_id < y.person_id)"
    ", ends AS (SELECT venue_id, a AS id, b AS o FROM e UNION SELECT venue_id, b, a FROM e)"
)
_REACH = "WITH RECURSIVE" + _EDGES.split("WITH", 1)[1] + (
    ", reach AS (SELECT DISTINCT venue_id, id, id AS to_ FROM ends UNION SELECT r.venue_id, r.id, e2.o FROM reach r JOIN ends e2 ON e2.venue_id = r.venue_id AND e2.id = r.to_)"
    ", comp AS (SELECT venue_id, id, min(to_) AS component FROM reach GROUP BY 1, 2)"
    ", deg AS (SELECT c.venue_id, c.id, c.component, count(*) AS degree, count(*) AS inner_ FROM comp c JOIN ends x ON x.venue_id = c.venue_id AND x.id = c.id GROUP BY 1, 2, 3)"
    ", mid AS (SELECT venue_id, median(degree) AS mid FROM deg GROUP BY 1)"
    ", truth AS (SELECT venue_id, component, count(*) AS size, round(avg(CASE WHEN inner_ > mid THEN 1.0::DOUBLE ELSE 0 END), 6) AS fomd, round(sum(inner_)::DOUBLE / (count(*) * (count(*) - 1)), 6) AS density FROM deg JOIN mid USING (venue_id) GROUP BY 1, 2 HAVING count(*) >= 3)"
)
_GROUP = "substr('" + GROUPS + f"', CAST(venue_id % {len(GROUPS)} AS INTEGER) + 1, 1)"
SQL = {
    "scalar_functions": STAR + ", x AS (SELECT paper_id, is_conference, coalesce(cited_count, 0)::DOUBLE AS c, CAST(paper_id % 4 + 1 AS INTEGER) AS n FROM pap) SELECT paper_id, coalesce(is_conference, false) AS truth, CASE WHEN paper_id % 3 <> 0 THEN paper_id::DOUBLE END AS number, round(CASE WHEN c > 3 THEN ln(c - 3) END, 6) AS ln, round(1 / (1 + exp(-(c / 10 - 1))), 6) AS logistic, round((1.0::DOUBLE / n) / list_sum([1.0::DOUBLE / i FOR i IN range(1, n + 1)]), 6) AS last_weight FROM x",
    "papers_without_ignored": STAR + f" SELECT acronym, count(*) AS papers FROM pap JOIN ven USING (venue_id) WHERE acronym NOT IN {IGNORED} GROUP BY 1",
    "title_and_abstract": STAR + " SELECT paper_id, length(title) + coalesce(2 + length(abstract), 0) AS n FROM pap WHERE title IS NOT NULL",
    "allowed_hosts": STAR + f" SELECT regexp_extract(doi_url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS papers FROM pap WHERE regexp_extract(doi_url, '^[a-z]+://([^/]+)', 1) NOT IN {('', *DENIED)} GROUP BY 1",
    "papers_by_venue": STAR + " SELECT venue_id, string_agg(CAST(paper_id AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR), paper_id) AS papers FROM pap WHERE venue_id IS NOT NULL AND year IS NOT NULL GROUP BY 1",
    "papers_by_author": STAR + " SELECT person_id, string_agg(CAST(paper_id AS VARCHAR), ',' ORDER BY venue_id, year, paper_id) AS papers FROM slots WHERE venue_id IS NOT NULL AND year IS NOT NULL GROUP BY 1",
    "top_authors_by_name": STAR + " SELECT name, max(c) AS cites FROM (SELECT person_id, CAST(sum(coalesce(cited_count, 0)) AS BIGINT) AS c FROM slots GROUP BY 1) JOIN per USING (person_id) WHERE name IS NOT NULL GROUP BY 1 ORDER BY cites DESC, name COLLATE \"C\" LIMIT 100",
    "document_vectors": _PLACES + ", vec AS (SELECT row_number() OVER (ORDER BY vec_id) AS place, embedding FROM embeddings), tf AS (SELECT paper_id, w AS term, count(*) AS tf FROM wrd WHERE w IS NOT NULL GROUP BY 1, 2), u AS (SELECT paper_id, tf, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM tf JOIN places USING (term) JOIN vec USING (place)), m AS (SELECT paper_id, i, sum(tf * x::DOUBLE) / sum(tf) AS m FROM u GROUP BY 1, 2), every AS (SELECT paper_id, i.range AS i FROM pap, range(64) i WHERE coalesce(abstract, title) IS NOT NULL) SELECT paper_id, CAST(i AS INTEGER) AS i, round(coalesce(m, 0), 4) + 0.0 AS mean FROM every LEFT JOIN m USING (paper_id, i)",
    "first_seen_dictionary": STAR + ", l AS (SELECT paper_id, regexp_extract_all(lower(coalesce(abstract, title)), '[\\p{L}\\p{N}_]{3,}') AS ws FROM pap), x AS (SELECT paper_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS i FROM l), f AS (SELECT term, min((paper_id, i)) AS seen FROM x GROUP BY 1) SELECT term, row_number() OVER (ORDER BY seen) - 1 AS idx FROM f",
    "vocabulary_with_unknown": _PLACES + f" SELECT CASE WHEN place <= {VOCABULARY} THEN term ELSE '{UNKNOWN}' END AS term, CAST(sum(uses) AS BIGINT) AS uses FROM places GROUP BY 1",
    "venues_by_topic_weight": STAR + " SELECT venue_id, weight, row_number() OVER (ORDER BY weight DESC, venue_id) AS place FROM (SELECT venue_id, CAST(sum(cnt) AS BIGINT) AS weight FROM dt JOIN pap USING (paper_id) WHERE venue_id IS NOT NULL GROUP BY 1)",
    "dictionary_update": STAR + " SELECT acronym, impact FROM (SELECT acronym, CASE WHEN max(CAST(is_conference AS INTEGER)) = 1 THEN 2 ELSE 1 END * max(impact) AS impact FROM ven WHERE acronym IS NOT NULL GROUP BY 1) WHERE impact > 1",
    "papers_by_venue_group": STAR + f" SELECT {_GROUP} AS grp, count(*) AS papers FROM pap WHERE venue_id IS NOT NULL GROUP BY 1",
    "papers_with_titles": STAR + " SELECT paper_id, title FROM pap WHERE title IN (SELECT title FROM aminer_papers)",
    "edge_batches": STAR + f" SELECT CAST((k - 1) % {BATCHES} AS INTEGER) AS batch, count(*) AS edges, CAST(sum(src) AS BIGINT) AS sources FROM (SELECT src, row_number() OVER (ORDER BY src, dst) AS k FROM (SELECT DISTINCT src, dst FROM cit)) GROUP BY 1",
    "word_links_both_ways": _PLACES + f", s AS (SELECT DISTINCT paper_id, w AS term FROM wrd JOIN places ON w = term WHERE place <= {VOCABULARY}), p AS (SELECT x.term AS i, y.term AS j, count(*) AS weight FROM s x JOIN s y USING (paper_id) GROUP BY 1, 2) SELECT i AS term, count(*) AS links, CAST(sum(weight) AS BIGINT) AS weight FROM p GROUP BY 1",
    "communities_kept": _REACH + f", f AS (SELECT *, row_number() OVER (ORDER BY fomd DESC, venue_id, component) AS k FROM truth), g AS (SELECT *, row_number() OVER (ORDER BY density DESC, venue_id, component) AS r, count(*) OVER () AS n FROM f WHERE k <= {BY_FOMD}) SELECT venue_id, component, size, fomd, density FROM g WHERE r <= floor({BY_DENSITY}::DOUBLE * n)",
    "communities_by_fomd": _REACH + ", top AS (SELECT venue_id, component, fomd FROM truth ORDER BY fomd DESC, venue_id, component LIMIT 100) SELECT venue_id, component, id AS person_id, fomd FROM comp JOIN top USING (venue_id, component)",
    "community_ground_truth": _REACH + " SELECT venue_id, component, size, fomd, density FROM truth",
}
