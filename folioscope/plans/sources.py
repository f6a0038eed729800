"""Every reader and writer at work: tables written in each format and read again, stored answers of services parsed."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.common import shared_dir, table
from folioscope.operators.star import Star, latest
from folioscope.operators.text import dominant
from folioscope.plans._sql import STAR
from folioscope.sources import readers, sinks

#: Characters that XML and lines of text can't hold.
_CONTROL = r"[\x00-\x1f]"


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _plain(c: str) -> Column:
    return F.trim(F.regexp_replace(c, _CONTROL, " "))


def _xml(tag: str, c: Column | str) -> Column:
    """An element with the text escaped; NULL gives none."""
    c = F.col(c) if isinstance(c, str) else c
    safe = F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.coalesce(F.concat(F.lit(f"<{tag}>"), safe, F.lit(f"</{tag}>")), F.lit(""))


def _wide(s: Star) -> DataFrame:
    return latest(s.raw("papers"), "paper_id", F.desc("loaded_at"), F.desc_nulls_last("cited_count"))


def corpus_file_whole(spark: SparkSession, d: str) -> DataFrame:
    """All fourteen columns of the corpus file, written and read again by the corpus reader."""
    path = _path(spark, "corpus")
    sinks.corpus_file(_wide(Star(spark, d)), path)
    x = readers.corpus_file(spark, path, header=False)
    return x.select("paper_id", "venue_id", "is_conference", "year", "title", "h2", "h3", "ref_id", "author_ids", "doi_url", "cited_count")


def corpus_tail_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The same lines with columns counted from their end."""
    path = _path(spark, "corpus")
    sinks.corpus_file(_wide(Star(spark, d)), path)
    return readers.corpus_tail(spark, path).select("paper_id", "venue_id", "author_ids")


def submissions_file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Papers as a submissions file: quoted, parted by |."""
    s = Star(spark, d)
    names = s.authorship.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("person_id")), ",").alias("authors"))
    x = s.papers.join(F.broadcast(s.venues), "venue_id").join(names, "paper_id", "left").filter("title is not null and year is not null")
    none = F.lit(None).cast("string")
    x = x.select(F.col("acronym").alias("conference"), "year", "title", "authors", F.lit("a,b").alias("keywords"), none.alias("abstract"), none.alias("category"), F.lit("accept").alias("decision"), F.col("paper_id").cast("string").alias("raw_decision"))
    path = _path(spark, "submissions")
    x.write.options(sep="|", quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(path)
    back = readers.submissions_file(spark, path)
    return back.select(F.col("raw_decision").cast("long").alias("paper_id"), "conference", "year", "title", F.coalesce(F.size(F.filter("authors", lambda a: a != "")), F.lit(0)).alias("authors"), F.size("keywords").alias("keywords"))


def _dblp(spark: SparkSession, d: str) -> str:
    """A dump of inproceedings with authors and citations, and proceedings."""
    s = Star(spark, d)
    key = lambda c: F.concat(F.lit("conf/"), F.col(c).cast("string"))
    names = s.authorship.join(s.persons, "person_id").withColumn("name", _plain("name")).filter("name <> ''")
    names = names.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "person_id", "name"))), lambda a: _xml("author", a["name"])), "").alias("authors"))
    cites = s.citations.groupBy(F.col("src").alias("paper_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda c: _xml("cite", F.concat(F.lit("conf/"), c.cast("string")))), "").alias("cites"))
    p = s.papers.select("paper_id", "venue_id", "title", "year").join(F.broadcast(s.venues), "venue_id", "left").join(names, "paper_id", "left").join(cites, "paper_id", "left")
    body = F.concat(F.coalesce("authors", F.lit("")), _xml("title", _plain("title")), _xml("year", "year"), _xml("booktitle", "acronym"), F.lit("<cite>...</cite>"), F.coalesce("cites", F.lit("")))
    rows = p.select(F.concat(F.lit('<inproceedings key="'), key("paper_id"), F.lit('">'), body, F.lit("</inproceedings>")).alias("value"))
    procs = s.venues.select(F.concat(F.lit('<proceedings key="'), key("venue_id"), F.lit('">'), _xml("title", "name"), F.when(F.col("is_conference"), _xml("booktitle", "acronym")).otherwise(F.lit("")), F.lit("</proceedings>")).alias("value"))
    path = _path(spark, "dblp")
    # every file is a document of its own
    rows.unionByName(procs).mapInPandas(_document, "value string").write.text(path)
    return path


def _document(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield pd.DataFrame({"value": ["<dblp>"]})
    yield from pdfs
    yield pd.DataFrame({"value": ["</dblp>"]})


def dblp_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers of an XML dump; those without title, year or venue are left out."""
    return readers.dblp_xml(spark, _dblp(spark, d))["papers"]


def dblp_authors(spark: SparkSession, d: str) -> DataFrame:
    return readers.dblp_xml(spark, _dblp(spark, d))["authors"]


def dblp_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of an XML dump without the placeholder for unknown ones, as a multiset."""
    c = readers.dblp_xml(spark, _dblp(spark, d))["citations"]
    return c.groupBy("paper_cite_key", "paper_cited_key").agg(F.count(F.lit(1)).alias("n"))


def dblp_conferences(spark: SparkSession, d: str) -> DataFrame:
    """Proceedings by name: the book title, else the title."""
    return readers.dblp_xml(spark, _dblp(spark, d))["conferences"]


def dblp_invalid(spark: SparkSession, d: str) -> DataFrame:
    return readers.invalid_dblp(spark, _dblp(spark, d))


def coauthors_xml_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Stored answers of a co-author service, one a person."""
    s = Star(spark, d)
    a = s.authorship
    pairs = a.select("paper_id", "person_id").join(a.select("paper_id", F.col("person_id").alias("other")), "paper_id").filter("person_id <> other").select("person_id", "other").distinct()
    named = pairs.join(s.persons.select(F.col("person_id").alias("other"), _plain("name").alias("name")), "other").filter("name <> ''")
    answers = named.groupBy("person_id").agg(F.concat(F.lit("<coauthors>"), F.array_join(F.transform(F.collect_set("name"), lambda n: _xml("author", n)), ""), F.lit("</coauthors>")).alias("xml"))
    return readers.coauthors_xml(answers.select(F.col("person_id").alias("person"), "xml"))


def publications_xml_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Stored answers of a publication service: publications and home pages by person."""
    s = Star(spark, d)
    p = s.slots.join(s.papers.select("paper_id", _plain("title").alias("title")), "paper_id")
    rec = F.concat(F.lit('<r><inproceedings key="p/'), F.col("paper_id").cast("string"), F.lit('">'), _xml("title", "title"), _xml("year", "year"), F.lit("</inproceedings></r>"))
    home = F.concat(F.lit('<r><www key="homepages/'), F.col("person_id").cast("string"), F.lit('"><title>Home Page</title></www></r>'))
    answers = p.groupBy("person_id").agg(F.array_join(F.collect_list(rec), "").alias("rs")).select(F.col("person_id").alias("person"), F.concat(F.lit("<dblpperson>"), home, "rs", F.lit("</dblpperson>")).alias("xml"))
    x = readers.publications_xml(answers)
    return x.groupBy("person", "home_page").agg(F.count(F.lit(1)).alias("records"), F.count("year").alias("dated"))


def citation_counts_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Stored answers of a DOI registry; records without an answer have NULL."""
    p = Star(spark, d).papers.filter("doi_url is not null").groupBy("doi_url").agg(F.max("cited_count").alias("c"))
    q = F.when(F.col("c").isNotNull(), F.concat(F.lit('<query status="resolved" fl_count="'), F.col("c").cast("string"), F.lit('"/>'))).otherwise(F.lit('<query status="unresolved"/>'))
    answers = p.select(F.col("doi_url").alias("doi"), F.concat(F.lit('<crossref_result xmlns="http://www.crossref.org/qrschema/2.0"><body>'), q, F.lit("</body></crossref_result>")).alias("xml"))
    return readers.citation_counts_xml(answers)


def gender_json_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Stored answers of a gender service."""
    p = Star(spark, d).persons.filter("name is not null").select("person_id", "name", "gender")
    g = F.when(F.col("gender") == "m", "male").when(F.col("gender") == "f", "female")
    answers = p.groupBy(F.pmod("person_id", F.lit(50)).alias("b")).agg(F.to_json(F.collect_list(F.struct("name", g.alias("gender")))).alias("payload"))
    return readers.gender_json(answers).groupBy("name", "gender").agg(F.count(F.lit(1)).alias("n"))


def _sentiments(s: Star) -> DataFrame:
    """Stored answers of a sentiment service: as a surrogate every word is a sentence, its value the length modulo 5."""
    text = F.lower(F.coalesce("abstract", "title"))
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0))
    sentences = F.transform(words, lambda w: F.struct((F.length(w) % 5).cast("string").alias("sentimentValue")))
    return s.papers.filter("coalesce(abstract, title) is not null").select("paper_id", F.to_json(F.struct(sentences.alias("sentences"))).alias("payload"))


def document_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Sentences by sentiment and the majority, of each paper."""
    return readers.sentiment_json(_sentiments(Star(spark, d)))


def sentiment_by_topic(spark: SparkSession, d: str) -> DataFrame:
    """Papers of each dominant topic by their sentiment."""
    s = Star(spark, d)
    x = readers.sentiment_json(_sentiments(s)).select("paper_id", "label").join(dominant(s.doc_topics), "paper_id")
    n = lambda v: F.count_if(F.col("label") == v).alias(v)
    return x.groupBy("topic").agg(n("negative"), n("neutral"), n("positive"))


def _given(spark: SparkSession, d: str) -> DataFrame:
    p = Star(spark, d).persons.filter("gender is not null").select(F.regexp_extract("name", "^[A-Za-z]+", 0).alias("name"), "gender")
    return p.filter("name <> ''").groupBy("name", F.upper("gender").alias("g")).agg(F.count(F.lit(1)).alias("n")).withColumn("sex", F.when(F.col("g") == "M", "M").otherwise("F"))


def national_name_counts(spark: SparkSession, d: str) -> DataFrame:
    """A list of name, sex and count."""
    path = _path(spark, "names")
    _given(spark, d).select("name", "sex", "n").write.csv(path)
    return readers.us_names(spark, path)


def state_name_counts(spark: SparkSession, d: str) -> DataFrame:
    """A list with a line for each state and name."""
    path = _path(spark, "names")
    _given(spark, d).select(F.lit("XY"), "sex", F.lit(1990), "name", "n").write.csv(path)
    return readers.state_names(spark, path)


def column_name_counts(spark: SparkSession, d: str) -> DataFrame:
    """A list of columns parted by white space."""
    path = _path(spark, "names")
    of = lambda s: F.sum(F.when(F.col("sex") == s, F.col("n")).otherwise(0)).cast("string")
    _given(spark, d).groupBy("name").agg(of("M").alias("m"), of("F").alias("f")).select(F.concat_ws("  ", F.lit("1"), F.lit("x"), "m", "f", "name").alias("value")).write.text(path)
    return readers.indian_names(spark, path)


def alias_file(spark: SparkSession, d: str) -> DataFrame:
    """Aliases by canonical name: the last of a line."""
    n = table(spark, d, "nicknames").filter("nickname is not null and given_name is not null").distinct()
    lines = n.groupBy("given_name").agg(F.array_sort(F.collect_list("nickname")).alias("a"))
    path = _path(spark, "aliases")
    lines.select(F.concat(F.abs(F.xxhash64("given_name") % 100000).cast("string"), F.lit(";"), F.array_join("a", ","), F.lit(","), "given_name").alias("value")).write.text(path)
    return readers.aliases(spark, path).select("alias", "canonical").distinct()


def normalised_nicknames(spark: SparkSession, d: str) -> DataFrame:
    """Names through overrides, aliases and overrides again. Overrides are the nicknames up to J."""
    n = table(spark, d, "nicknames").filter("nickname is not null and given_name is not null").distinct()
    names = n.select(F.col("nickname").alias("name")).union(n.select("given_name")).distinct()
    pairs = n.select(F.col("nickname").alias("alias"), F.col("given_name").alias("canonical"))
    return readers.normalised_names(names, pairs.filter("alias < 'J'"), pairs.filter("alias >= 'J'"))


def cluster_pairs_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Committees as lines of cluster and node; those of fewer than three members are left out."""
    seats = Star(spark, d).pc.select(F.concat_ws("-", "venue_id", "year").alias("c"), "person_id").distinct()
    path = _path(spark, "pairs")
    seats.select(F.concat_ws(" ", "c", F.col("person_id").cast("string")).alias("value")).write.text(path)
    return readers.cluster_pairs(spark, path, 3).groupBy("cluster").agg(F.countDistinct("node").alias("members"))


def last_record_by_title(spark: SparkSession, d: str) -> DataFrame:
    """Of records that share a title, that of the highest id."""
    a = table(spark, d, "aminer_papers").select(F.col("aminer_id").cast("string").alias("id"), "title").distinct()
    return readers.last_by_title(a).select("title", F.col("id").cast("long").alias("aminer_id"))


def jdbc_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Venues into an embedded relational database in batches, and back in slices of their key. Only one process may write to
    such a database: the driver does, and the executors read it from an archive, which many may open."""
    path = urlparse(_path(spark, "venues")).path
    os.makedirs(path)
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    v = table(spark, d, "venues").select("venue_id", "impact", "is_conference")
    sinks.embedded_jdbc(v, f"jdbc:derby:{path}/db;create=true", "venues", 20, **driver)
    archive = shutil.make_archive(path, "zip", path, "db")
    return readers.jdbc(spark, f"jdbc:derby:jar:({archive})db", "venues", "venue_id", 1, 61, 4, **driver)


def multimap_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Papers of each person as ``key; v1; v2`` lines."""
    path = _path(spark, "multimap")
    sinks.multimap(Star(spark, d).authorship, "person_id", "paper_id", path)
    v = F.split("value", "; ")
    return spark.read.text(path).select(v[0].cast("long").alias("person_id"), (F.size(v) - 1).alias("papers"))


def report_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Names as a report with a header, in UTF-8, and again by a reader that takes an encoding."""
    path = _path(spark, "report")
    sinks.report(Star(spark, d).persons.filter("name is not null").select("person_id", _plain("name").alias("name")).filter("name <> ''"), path)
    x = readers.encoded_csv(spark, path, "person_id long, name string", "UTF-8")
    return x.select("person_id", "name")


def latin_report(spark: SparkSession, d: str) -> DataFrame:
    """Names that Latin-1 can hold, written and read in that encoding."""
    path = _path(spark, "latin")
    p = Star(spark, d).persons.filter(r"name rlike '^[\\x20-\\x7e\\xc0-\\xff]+$'").select("person_id", F.trim("name").alias("name")).filter("name <> ''")
    sinks.report(p, path, encoding="ISO-8859-1")
    return readers.encoded_csv(spark, path, "person_id long, name string", "ISO-8859-1")


def partitioned_table(spark: SparkSession, d: str) -> DataFrame:
    """Papers as a table split by venue, of which one slice a venue is read."""
    path = _path(spark, "table")
    sinks.table(Star(spark, d).papers.filter("venue_id is not null").select("paper_id", "venue_id"), path, by="venue_id")
    return spark.read.schema("paper_id long, venue_id int").parquet(path).groupBy("venue_id").agg(F.count(F.lit(1)).alias("papers"))


def score_file(spark: SparkSession, d: str) -> DataFrame:
    """A series of scores as ``k,score`` lines."""
    path = _path(spark, "scores")
    Star(spark, d).papers.filter("year is not null").groupBy("year").agg(F.count(F.lit(1)).cast("double").alias("score")).write.csv(path)
    return readers.score_csv(spark, path)


def model_store(spark: SparkSession, d: str) -> DataFrame:
    """A fitted vocabulary saved as a model, loaded again and applied: occurrences of each word."""
    from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
    from pyspark.ml.functions import vector_to_array

    from folioscope.operators import text

    docs = Star(spark, d).papers.select(text.words(F.coalesce("abstract", "title")).alias("ws")).filter("ws is not null")
    path = _path(spark, "model")
    CountVectorizer(vocabSize=1 << 18, inputCol="ws", outputCol="v").fit(docs).write().save(path)
    model = CountVectorizerModel.load(path)
    counted = model.transform(docs).select(F.posexplode(vector_to_array("v")).alias("i", "n")).filter("n > 0").groupBy("i").agg(F.sum("n").cast("long").alias("uses"))
    words = spark.createDataFrame(list(enumerate(model.vocabulary)), "i int, term string")
    return counted.join(words, "i").select("term", "uses")


_FNS = [corpus_file_whole, corpus_tail_round_trip, submissions_file_round_trip, dblp_papers, dblp_authors, dblp_citations, dblp_conferences, dblp_invalid, coauthors_xml_parsed, publications_xml_parsed, citation_counts_parsed, gender_json_parsed, document_sentiment, sentiment_by_topic, national_name_counts, state_name_counts, column_name_counts, alias_file, normalised_nicknames, cluster_pairs_round_trip, last_record_by_title, jdbc_round_trip, multimap_round_trip, report_round_trip, latin_report, partitioned_table, score_file, model_store]
QUERIES = {f.__name__: f for f in _FNS}

_LATEST = "(SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY loaded_at DESC, cited_count DESC NULLS LAST) AS rn FROM papers)"
_V = "CASE WHEN trim({0}) NOT IN ('', 'None') THEN regexp_replace({0}, '[\\r\\n]+', ' ', 'g') END AS {0}"
_P = "trim(regexp_replace({0}, '[\\x00-\\x1f]', ' ', 'g'))"
_GIVEN = STAR + ", g AS (SELECT regexp_extract(name, '^[A-Za-z]+') AS name, gender FROM per WHERE gender IS NOT NULL)"
_NAMES = _GIVEN + " SELECT lower(name) AS name, count(*) FILTER (WHERE gender <> 'm') AS females, count(*) FILTER (WHERE gender = 'm') AS males FROM g WHERE name <> '' GROUP BY 1"
_KEYED = STAR + ", inp AS (SELECT paper_id, " + _P.format("title") + " AS title, year, acronym FROM pap LEFT JOIN ven USING (venue_id)), ok AS (SELECT * FROM inp WHERE title <> '' AND year IS NOT NULL AND acronym IS NOT NULL)"
_SENT = (
    STAR + ", sen AS (SELECT p.paper_id, count(*) FILTER (WHERE length(w) % 5 IN (0, 1)) AS negative, count(*) FILTER (WHERE length(w) % 5 = 2) AS neutral, count(*) FILTER (WHERE length(w) % 5 IN (3, 4)) AS positive"
    " FROM pap p LEFT JOIN wrd USING (paper_id) WHERE coalesce(abstract, title) IS NOT NULL GROUP BY 1), lab AS (SELECT *, CASE WHEN negative = greatest(negative, neutral, positive) THEN 'negative' WHEN neutral = greatest(negative, neutral, positive) THEN 'neutral' ELSE 'positive' END AS label FROM sen)"
)
_NICK = "SELECT DISTINCT nickname, given_name FROM nicknames WHERE nickname IS NOT NULL AND given_name IS NOT NULL"
SQL = {
    "corpus_file_whole": f"SELECT paper_id, venue_id, is_conference = 'True' AS is_conference, year, {', '.join(_V.format(c) for c in ('title', 'h2', 'h3', 'ref_id', 'author_ids', 'doi_url'))}, cited_count FROM {_LATEST} WHERE rn = 1",
    "corpus_tail_round_trip": f"SELECT paper_id, venue_id, {_V.format('author_ids')} FROM {_LATEST} WHERE rn = 1",
    "submissions_file_round_trip": STAR + " SELECT paper_id, acronym AS conference, year, title, CAST(coalesce(n, 0) AS INTEGER) AS authors, 2 AS keywords FROM pap JOIN ven USING (venue_id) LEFT JOIN (SELECT paper_id, count(*) AS n FROM aut GROUP BY 1) USING (paper_id) WHERE title IS NOT NULL AND year IS NOT NULL",
    "dblp_papers": _KEYED + " SELECT 'conf/' || paper_id AS paper_key, title, year, acronym AS conference FROM ok",
    "dblp_authors": _KEYED + " SELECT 'conf/' || paper_id AS paper_key, " + _P.format("name") + " AS name FROM ok JOIN aut USING (paper_id) JOIN per USING (person_id) WHERE " + _P.format("name") + " <> ''",
    "dblp_citations": _KEYED + " SELECT 'conf/' || src AS paper_cite_key, 'conf/' || dst AS paper_cited_key, count(*) AS n FROM cit JOIN ok ON src = ok.paper_id GROUP BY 1, 2",
    "dblp_conferences": STAR + " SELECT 'conf/' || venue_id AS conf_key, CASE WHEN is_conference THEN acronym ELSE name END AS name, name AS detail FROM ven",
    "dblp_invalid": _KEYED + " SELECT count(*) FILTER (WHERE title IS NULL OR acronym IS NULL OR coalesce(year, 0) = 0) AS errors, count(*) AS records FROM inp",
    "coauthors_xml_parsed": STAR + f" SELECT DISTINCT x.person_id AS person, {_P.format('name')} AS coauthor FROM aut x JOIN aut y ON x.paper_id = y.paper_id AND x.person_id <> y.person_id JOIN per ON per.person_id = y.person_id WHERE {_P.format('name')} <> ''",
    "publications_xml_parsed": STAR + " SELECT person_id AS person, false AS home_page, count(*) AS records, count(year) AS dated FROM slots GROUP BY 1 UNION ALL SELECT DISTINCT person_id, true, 1, 0 FROM slots",
    "citation_counts_parsed": STAR + " SELECT doi_url AS doi, max(cited_count) AS cited_count FROM pap WHERE doi_url IS NOT NULL GROUP BY 1",
    "gender_json_parsed": STAR + " SELECT name, CASE WHEN gender IN ('m', 'f') THEN gender END AS gender, count(*) AS n FROM per WHERE name IS NOT NULL GROUP BY 1, 2",
    "document_sentiment": _SENT + " SELECT paper_id, CAST(negative AS INTEGER) AS negative, CAST(neutral AS INTEGER) AS neutral, CAST(positive AS INTEGER) AS positive, label FROM lab",
    "sentiment_by_topic": _SENT + ", dom AS (SELECT paper_id, topic FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY cnt DESC, topic) k FROM dt WHERE cnt > 0) WHERE k = 1) SELECT topic, count(*) FILTER (WHERE label = 'negative') AS negative, count(*) FILTER (WHERE label = 'neutral') AS neutral, count(*) FILTER (WHERE label = 'positive') AS positive FROM lab JOIN dom USING (paper_id) GROUP BY 1",
    "national_name_counts": _NAMES,
    "state_name_counts": _GIVEN + " SELECT lower(name) AS name, count(DISTINCT CASE WHEN gender <> 'm' THEN name END) AS females, count(DISTINCT CASE WHEN gender = 'm' THEN name END) AS males FROM g WHERE name <> '' GROUP BY 1",
    "column_name_counts": _NAMES,
    "alias_file": f"WITH n AS ({_NICK}) SELECT nickname AS alias, given_name AS canonical FROM n UNION SELECT given_name, given_name FROM n",
    "normalised_nicknames": f"WITH n AS ({_NICK}), o AS (SELECT nickname AS a, min(given_name) AS c FROM n WHERE nickname < 'J' GROUP BY 1), l AS (SELECT nickname AS a, min(given_name) AS c FROM n WHERE nickname >= 'J' GROUP BY 1), x AS (SELECT nickname AS name FROM n UNION SELECT given_name FROM n), x1 AS (SELECT name, coalesce(c, name) AS n FROM x LEFT JOIN o ON a = name), x2 AS (SELECT name, coalesce(c, n) AS n FROM x1 LEFT JOIN l ON a = n) SELECT name, coalesce(c, n) AS normalised FROM x2 LEFT JOIN o ON a = n",
    "cluster_pairs_round_trip": "SELECT venue_id || '-' || year AS cluster, count(DISTINCT person_id) AS members FROM pc_membership GROUP BY 1 HAVING count(DISTINCT person_id) >= 3",
    "last_record_by_title": "SELECT title, max(aminer_id) AS aminer_id FROM aminer_papers WHERE title IS NOT NULL GROUP BY 1",
    "jdbc_round_trip": "SELECT venue_id, impact, is_conference FROM venues",
    "multimap_round_trip": STAR + " SELECT person_id, CAST(count(DISTINCT paper_id) AS INTEGER) AS papers FROM aut GROUP BY 1",
    "report_round_trip": STAR + f" SELECT person_id, {_P.format('name')} AS name FROM per WHERE {_P.format('name')} <> ''",
    "latin_report": STAR + r" SELECT person_id, trim(name) AS name FROM per WHERE regexp_full_match(name, '[\x20-\x7e\x{c0}-\x{ff}]+') AND trim(name) <> ''",
    "partitioned_table": STAR + " SELECT venue_id, count(*) AS papers FROM pap WHERE venue_id IS NOT NULL GROUP BY 1",
    "score_file": STAR + " SELECT year AS k, count(*)::DOUBLE AS score FROM pap WHERE year IS NOT NULL GROUP BY 1",
    "model_store": STAR + " SELECT w AS term, count(*) AS uses FROM wrd WHERE w IS NOT NULL GROUP BY 1",
}
