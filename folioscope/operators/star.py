"""The star of papers, people, venues, committee seats and citations, as lazily built DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.common import clean, table

PERMITTED = ("conferences", "journals", "all")
#: Fixed value: number of topics of the surrogate topic model.
TOPICS = 11


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key: the last delivery."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


class Star:
    """All relations of one corpus. Deliveries that repeat a key count once, the last; years outside 1950 to 2029 are
    unknown; NULL, empty and None are no values; references that resolve to nothing are left out (inner joins)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def papers(self) -> DataFrame:
        p = latest(self.raw("papers"), "paper_id", F.desc("loaded_at"), F.desc_nulls_last("cited_count"))
        year = F.when(F.col("year").between(1950, 2029), F.col("year")).cast("int")
        return p.select(
            "paper_id", "venue_id", (F.col("is_conference") == "True").alias("is_conference"), year.alias("year"), clean("title").alias("title"), clean("ref_id").alias("ref_id"), clean("cites").alias("cites"), clean("abstract").alias("abstract"), clean("doi_url").alias("doi_url"), "cited_count"
        )

    @cached_property
    def persons(self) -> DataFrame:
        return latest(self.raw("persons"), "person_id", F.desc("loaded_at"), F.asc("name")).select("person_id", "name", "gender")

    @cached_property
    def venues(self) -> DataFrame:
        v = self.raw("venues")
        return v.select("venue_id", "acronym", "name", "impact", (F.col("is_conference") == 1).alias("is_conference"))

    @cached_property
    def authorship(self) -> DataFrame:
        a = self.raw("authorship").filter("person_id is not null")
        return a.groupBy("paper_id", "person_id").agg(F.min("pos").cast("int").alias("pos"))

    @cached_property
    def pc(self) -> DataFrame:
        return self.raw("pc_membership").select("person_id", "venue_id", "year", "role")

    @cached_property
    def citations(self) -> DataFrame:
        """Edges citing → cited as a multiset; a ref_id that several papers claim belongs to the one of highest id."""
        owner = self.papers.filter("ref_id is not null").groupBy("ref_id").agg(F.max("paper_id").alias("dst"))
        refs = self.papers.select(F.col("paper_id").alias("src"), F.explode(F.regexp_extract_all("cites", F.lit(r"[^\s,;|/\"'\[\]{}()]+"), F.lit(0))).alias("ref_id"))
        return refs.join(owner, "ref_id").select("src", "dst")

    @cached_property
    def doc_topics(self) -> DataFrame:
        """A deterministic surrogate of topic counts: the topic of a word is its length modulo TOPICS."""
        text = F.lower(F.coalesce("abstract", "title"))
        words = self.papers.select("paper_id", F.explode(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0))).alias("w"))
        return words.groupBy("paper_id", (F.length("w") % TOPICS).cast("int").alias("topic")).agg(F.count(F.lit(1)).alias("cnt"))

    def permitted(self, df: DataFrame, which: str = "conferences") -> DataFrame:
        """Rows of venues of one type; venue_id decides."""
        if which not in PERMITTED:
            raise ValueError(f"{which} is none of {PERMITTED}")
        if which == "all":
            return df
        kind = self.venues.filter("is_conference" if which == "conferences" else "not is_conference").select("venue_id")
        return df.join(F.broadcast(kind), "venue_id", "left_semi")

    @cached_property
    def slots(self) -> DataFrame:
        """Author slots with their paper's year, venue and citations."""
        return self.authorship.join(self.papers.select("paper_id", "year", "venue_id", "is_conference", "cited_count"), "paper_id")

    @cached_property
    def pc_papers(self) -> DataFrame:
        """Papers of a venue and year of which an author sat on the committee (semi-join)."""
        seats = self.pc.select("person_id", "venue_id", "year").distinct()
        return self.slots.join(seats, ["person_id", "venue_id", "year"], "left_semi").select("paper_id").distinct()
