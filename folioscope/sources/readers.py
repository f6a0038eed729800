"""Readers of the file formats that bibliographic dumps come in. All of them scan in parallel and parse inside the JVM,
but for HTML, which has no built-in parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.common import clean
from folioscope.operators.rejects import CORPUS


def corpus_file(spark: SparkSession, path: str, sep: str = "$|$", header: bool = True) -> DataFrame:
    """The corpus file: header, a separator of three signs, no quoting, None for NULL; lists stay packed."""
    names = [c.lower() for c in CORPUS]
    raw = spark.read.csv(path, sep=sep, header=header, quote="", escape="", schema=", ".join(f"`{c}` string" for c in names), multiLine=False)
    v = {c: clean(c) for c in names}
    return raw.select(
        v["id"].cast("long").alias("paper_id"), v["venue"].cast("int").alias("venue_id"), (v["is_conference"] == "True").alias("is_conference"), v["year"].cast("int").alias("year"),
        *[v[c].alias(c) for c in ("title", "h2", "h3", "ref_id", "cites", "author_ids", "authors", "abstract", "doi_url")], v["cited_count"].cast("int").alias("cited_count"),
    )


def corpus_tail(spark: SparkSession, path: str, sep: str = "$|$") -> DataFrame:
    """(paper_id, venue_id, author_ids, authors) of a corpus file without a usable header: columns counted from the end."""
    parts = F.split(F.col("value"), r"\$\|\$" if sep == "$|$" else sep, -1)
    at = lambda i: F.try_element_at(parts, F.lit(i))
    return spark.read.text(path).select(at(1).try_cast("long").alias("paper_id"), at(2).try_cast("int").alias("venue_id"), clean(at(-5)).alias("author_ids"), clean(at(-4)).alias("authors")).filter("paper_id is not null")


def submissions_file(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed papers, nine columns parted by ``|``."""
    names = "conference string, year int, title string, authors string, keywords string, abstract string, category string, decision string, raw_decision string"
    s = spark.read.csv(path, sep="|", schema=names, quote='"', escape='"', multiLine=True)
    return s.withColumn("authors", F.split("authors", ",")).withColumn("keywords", F.split("keywords", ","))


def tagged_text(spark: SparkSession, path: str) -> DataFrame:
    """Records parted by blank lines, each line marked by its beginning; one row a record."""
    return parse_tagged(spark.read.option("lineSep", "\n\n").text(path))


def parse_tagged(records: DataFrame) -> DataFrame:
    """value → (title, authors, year, venue, id, abstract, refs)."""
    lines = F.transform(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: F.trim(x))

    def of(mark: str) -> Column:
        return F.transform(F.filter(lines, lambda x: x.startswith(mark)), lambda x: F.trim(F.substring(x, len(mark) + 1, 1_000_000)))

    one = lambda m: F.nullif(F.try_element_at(of(m), F.lit(1)), F.lit(""))
    year = F.coalesce(one("#t").try_cast("int"), F.lit(None).cast("int"))
    out = records.select(
        one("#*").alias("title"), F.filter(F.transform(F.split(one("#@"), "[,;]"), lambda x: F.trim(x)), lambda x: x != "").alias("authors"), year.alias("year"), one("#c").alias("venue"), one("#index").alias("id"), one("#!").alias("abstract"), of("#%").alias("refs")
    )
    return out.filter("title is not null or id is not null")


def last_by_title(records: DataFrame) -> DataFrame:
    """One record a title: that of the highest id."""
    w = Window.partitionBy("title").orderBy(F.desc(F.col("id").try_cast("long")), F.desc("id"))
    return records.filter("title is not null").withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


_TAGS = r"<[^>]+>"


def dblp_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """papers, authors, citations and conferences of a DBLP dump. Inner markup is stripped but its text and spaces stay;
    records without title, year or venue are left out, as is the placeholder for unknown citations."""
    p = spark.read.format("xml").option("rowTag", "inproceedings").schema("_key string, author array<string>, title string, year int, booktitle string, cite array<string>").load(path)
    p = p.withColumn("title", F.trim(F.regexp_replace("title", _TAGS, ""))).filter("title <> '' and booktitle is not null and coalesce(year, 0) <> 0")
    c = spark.read.format("xml").option("rowTag", "proceedings").schema("_key string, booktitle string, title string").load(path)
    return {
        "papers": p.select(F.col("_key").alias("paper_key"), "title", "year", F.col("booktitle").alias("conference")),
        "authors": p.select(F.col("_key").alias("paper_key"), F.explode("author").alias("name")),
        "citations": p.select(F.col("_key").alias("paper_cite_key"), F.explode("cite").alias("paper_cited_key")).filter("paper_cited_key <> '...'"),
        "conferences": c.select(F.col("_key").alias("conf_key"), F.coalesce(F.nullif(F.trim("booktitle"), F.lit("")), "title").alias("name"), F.col("title").alias("detail")),
    }


def invalid_dblp(spark: SparkSession, path: str) -> DataFrame:
    """How many records of a DBLP dump lack title, venue or year."""
    p = spark.read.format("xml").option("rowTag", "inproceedings").schema("title string, year int, booktitle string").load(path)
    return p.agg(F.count_if(F.col("title").isNull() | F.col("booktitle").isNull() | (F.coalesce("year", F.lit(0)) == 0)).alias("errors"), F.count(F.lit(1)).alias("records"))


def coauthors_xml(payloads: DataFrame) -> DataFrame:
    """payloads(person, xml): stored answers of a co-author service → (person, coauthor)."""
    return payloads.select("person", F.explode(F.xpath("xml", F.lit("//author/text()"))).alias("coauthor"))


def publications_xml(payloads: DataFrame) -> DataFrame:
    """payloads(person, xml): stored answers of a publication service → (person, key, title, year, home_page); the home
    page is a record of its own kind."""
    rec = "/dblpperson/r/*"
    # of each record its key, title and year; an element that is absent is an empty string
    n = F.xpath_int("xml", F.lit(f"count({rec})"))
    keys = F.xpath("xml", F.lit(f"{rec}/@key"))
    body = F.regexp_extract_all("xml", F.lit(r"(?s)<r>(.*?)</r>"), F.lit(1))
    x = payloads.filter(n > 0).select("person", F.explode(F.arrays_zip(keys.alias("key"), body.alias("body"))).alias("r"))
    of = lambda tag: F.regexp_extract("r.body", rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return x.select("person", "r.key", F.nullif(of("title"), F.lit("")).alias("title"), of("year").try_cast("int").alias("year"), F.col("r.key").startswith("homepages/").alias("home_page"))


def citation_counts_xml(payloads: DataFrame) -> DataFrame:
    """payloads(doi, xml): stored answers of a DOI registry → (doi, cited_count); NULL where there is none."""
    return payloads.select("doi", F.xpath_string("xml", F.lit("//*[local-name()='query']/@fl_count")).try_cast("int").alias("cited_count"))


def gender_json(payloads: DataFrame) -> DataFrame:
    """payloads(payload): stored JSON answers, an array of name and gender → (name, gender in m, f, NULL)."""
    x = payloads.select(F.explode(F.from_json("payload", "array<struct<name: string, gender: string>>")).alias("x"))
    return x.select("x.name", F.when(F.col("x.gender") == "female", "f").when(F.col("x.gender") == "male", "m").alias("gender"))


def sentiment_json(payloads: DataFrame) -> DataFrame:
    """payloads(paper_id, payload): sentences with sentimentValue 0 to 4 → (paper_id, negative, neutral, positive, label):
    majority of sentences; of equals the first of negative, neutral, positive."""
    v = F.transform(F.from_json("payload", "sentences array<struct<sentimentValue: string>>")["sentences"], lambda s: s["sentimentValue"].try_cast("int"))
    n = lambda *ks: F.size(F.filter(v, lambda x: x.isin(*ks)))
    x = payloads.select("paper_id", n(0, 1).alias("negative"), n(2).alias("neutral"), n(3, 4).alias("positive"))
    most = F.greatest("negative", "neutral", "positive")
    return x.withColumn("label", F.when(F.col("negative") == most, "negative").when(F.col("neutral") == most, "neutral").otherwise("positive"))


def us_names(spark: SparkSession, path: str) -> DataFrame:
    """name,sex,count by year file → (name, females, males)."""
    x = spark.read.csv(path, schema="name string, sex string, n long")
    return _by_sex(x)


def state_names(spark: SparkSession, path: str) -> DataFrame:
    """Lines whose second column is the sex and fourth the name; each line counts once."""
    x = spark.read.csv(path, schema="state string, sex string, year string, name string, rest string")
    return _by_sex(x.select("name", "sex", F.lit(1).cast("long").alias("n")))


def indian_names(spark: SparkSession, path: str) -> DataFrame:
    """White-space columns of which the third holds males, the fourth females, the fifth the name (counted from 1)."""
    p = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.try_element_at(p, F.lit(i))
    x = spark.read.text(path).select(F.lower(at(5)).alias("name"), at(4).try_cast("long").alias("females"), at(3).try_cast("long").alias("males"))
    return x.filter("name is not null").groupBy("name").agg(F.sum("females").alias("females"), F.sum("males").alias("males"))


def _by_sex(x: DataFrame) -> DataFrame:
    of = lambda s: F.sum(F.when(F.upper("sex") == s, F.col("n")).otherwise(0))
    return x.filter("name is not null").groupBy(F.lower("name").alias("name")).agg(of("F").alias("females"), of("M").alias("males"))


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """id;alias1,alias2,… → (id, alias, canonical): the last alias is the canonical one."""
    x = spark.read.csv(path, sep=";", schema="id long, names string")
    a = F.transform(F.split("names", ","), lambda n: F.trim(n))
    return x.select("id", F.explode(a).alias("alias"), F.element_at(a, -1).alias("canonical"))


def normalised_names(names: DataFrame, overrides: DataFrame, alias: DataFrame) -> DataFrame:
    """names(name) → (name, normalised): overrides(alias, canonical), then the alias table, then overrides again."""
    o = overrides.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    a = alias.groupBy("alias").agg(F.min("canonical").alias("canonical"))
    x = names.select("name").distinct().withColumn("n", F.col("name"))
    for table in (o, a, o):
        x = x.join(table.select(F.col("alias").alias("n"), F.col("canonical").alias("c")), "n", "left").select("name", F.coalesce("c", "n").alias("n"))
    return x.withColumnRenamed("n", "normalised")


def cluster_lines(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """One cluster a line, ids parted by sep → (cluster, node). Cluster numbers are unique, not consecutive."""
    x = spark.read.text(path).withColumn("cluster", F.monotonically_increasing_id())
    return x.select("cluster", F.explode(F.split(F.trim("value"), sep)).alias("node")).select("cluster", F.trim("node").alias("node")).filter("node <> ''")


def cluster_pairs(spark: SparkSession, path: str, smallest: int = 3) -> DataFrame:
    """``cluster node`` a line; clusters of fewer than ``smallest`` nodes are left out."""
    p = F.split(F.trim("value"), r"\s+")
    x = spark.read.text(path).select(F.try_element_at(p, F.lit(1)).alias("cluster"), F.try_element_at(p, F.lit(2)).alias("node")).filter("node is not null")
    big = x.groupBy("cluster").agg(F.countDistinct("node").alias("n")).filter(F.col("n") >= smallest).select("cluster")
    return x.join(big, "cluster", "left_semi")


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """``src dst [weight]`` a line; loops are left out, the weight is 1 where there is none."""
    p = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.try_element_at(p, F.lit(i))
    x = spark.read.text(path).select(at(1).try_cast("long").alias("src"), at(2).try_cast("long").alias("dst"), F.coalesce(at(3).try_cast("double"), F.lit(1.0)).alias("weight"))
    return x.filter("src is not null and dst is not null and src <> dst")


def encoded_csv(spark: SparkSession, path: str, schema: str, encoding: str, header: bool = True, sep: str = ",") -> DataFrame:
    """A delimited file in a given encoding, with quotes doubled inside of quotes."""
    return spark.read.csv(path, schema=schema, encoding=encoding, header=header, sep=sep, quote='"', escape='"')


def score_csv(spark: SparkSession, path: str) -> DataFrame:
    """``k,score`` lines; lines without a number are left out."""
    return spark.read.csv(path, schema="k int, score double").filter("k is not null")


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self.inside = True

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.rows[-1][-1] += data


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row_no, cells) of the table rows in static HTML pages; NULL pages have none."""
    kind = pages.schema[key].dataType.simpleString()

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for k, h in zip(pdf["k"], pdf["h"], strict=True):
                p = _Cells()
                p.feed(h or "")
                out += [(k, i, [c.strip() for c in r]) for i, r in enumerate(p.rows) if r]
            yield pd.DataFrame(out, columns=[key, "row_no", "cells"])

    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, f"{key} {kind}, row_no int, cells array<string>")


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A table of a relational database, read in ``parts`` slices of its key; filters and columns are pushed down."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        r = r.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()
