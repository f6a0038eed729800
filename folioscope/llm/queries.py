"""The queries of the problems tagged llm, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.common import table
from folioscope.llm import linkage, mixing, mojibake, names, packing, reading


def _three(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("papers", "aminer_papers", "venues")]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Papers and records of the other source that are the same work."""
    return linkage.found(*_three(spark, d))


def p3_confidence(spark: SparkSession, d: str) -> DataFrame:
    """All candidate pairs with their confidence."""
    return linkage.link(*_three(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields that hold wrongly decoded text."""
    return mojibake.garbled(table(spark, d, "papers"), table(spark, d, "persons")).select("paper_id", "src_field").distinct()


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    """The same fields with the original text where it can be had, and the chain of decodings that was undone."""
    return mojibake.garbled(table(spark, d, "papers"), table(spark, d, "persons"))


def p5_chains(spark: SparkSession, d: str) -> DataFrame:
    """How many fields each chain garbled."""
    return p5_restored(spark, d).groupBy("src_field", "chain").agg(F.count(F.lit(1)).alias("n"))


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return names.clusters(*[table(spark, d, t) for t in ("persons", "authorship", "nicknames")])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of person ids of the same person or organisation."""
    return names.pairs(_classes(spark, d))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every person id with the class it belongs to."""
    return _classes(spark, d)


def p7_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a container of each kind."""
    return packing.assign(table(spark, d, "documents"), table(spark, d, "container_sizes"))


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    """Containers, room and unused share by kind."""
    return packing.summary(packing.assign(table(spark, d, "documents"), table(spark, d, "container_sizes")))


def p8_sample(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn for each mix, with their number of copies."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of the sources of each mix."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_marginals(spark: SparkSession, d: str) -> DataFrame:
    """Shares of languages and topics in each mix beside those of the corpus."""
    return mixing.marginals(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """English documents of at least 60 words with their reading level."""
    return reading.english_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its reading level and the posterior of that level."""
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p9_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and level."""
    docs = table(spark, d, "documents")
    lv = reading.levels(docs, table(spark, d, "reading_labels"))
    return docs.select("doc_id", "source").join(lv, "doc_id").groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p3_found, p3_confidence, p5_found, p5_restored, p5_chains, p6_found, p6_classes, p7_assignment, p7_summary, p8_sample, p8_report, p8_marginals, p9_found, p9_levels, p9_by_source)}
SQL: dict[str, str] = {}
