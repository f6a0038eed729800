"""The queries of the general data problems 1, 2 and 4, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.common import table
from folioscope.operators import orphans, rejects, unpack


def _three(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("papers", "persons", "authorship")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference that had no live target when it came in."""
    return orphans.orphans(*_three(spark, d)).select("src_field", "paper_id", "ref_key")


def p1_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Number of such references by referring field and month of loading."""
    month = F.date_format("came_at", "yyyy-MM").alias("month")
    return orphans.orphans(*_three(spark, d)).groupBy("src_field", month).agg(F.count(F.lit(1)).alias("orphans"))


def p1_transitions_by_month(spark: SparkSession, d: str) -> DataFrame:
    """How many references were opened, resolved and reopened in each month."""
    ev = orphans.transitions(*_three(spark, d))
    return ev.groupBy("src_field", "event", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that break their format."""
    return rejects.found(table(spark, d, "raw_lines"))


def p2_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Lines that break their format, with the reasons."""
    return rejects.errors(table(spark, d, "raw_lines"))


def p2_clean_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The valid corpus lines as records."""
    return rejects.clean_rows(table(spark, d, "raw_lines"), "corpus")


def p2_clean_submissions(spark: SparkSession, d: str) -> DataFrame:
    """The valid submission lines as records."""
    return rejects.clean_rows(table(spark, d, "raw_lines"), "submissions")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per value of the three packed columns of papers."""
    return unpack.unpack_papers(table(spark, d, "papers"))


def p4_code_values(spark: SparkSession, d: str) -> DataFrame:
    """The values of the two columns that pack codes; SQL can split these."""
    p = table(spark, d, "papers")
    parts = [unpack.unpack(p, "paper_id", f).select("paper_id", F.lit(f).alias("src_field"), "pos", "item") for f in ("cites", "author_ids")]
    return parts[0].unionByName(parts[1])


QUERIES = {f.__name__: f for f in (p1_found, p1_orphans_by_month, p1_transitions_by_month, p2_found, p2_rejects, p2_clean_corpus, p2_clean_submissions, p4_found, p4_code_values)}

_REFS = r"""
WITH pt AS (
  SELECT ref_id k, min(loaded_at) f, CASE WHEN bool_or(deleted_at IS NULL) THEN NULL ELSE max(deleted_at) END d FROM papers WHERE ref_id IS NOT NULL GROUP BY 1
), qt AS (
  SELECT person_id k, min(loaded_at) f, CASE WHEN bool_or(deleted_at IS NULL) THEN NULL ELSE max(deleted_at) END d FROM persons WHERE person_id IS NOT NULL GROUP BY 1
), first AS (SELECT paper_id, min(loaded_at) t FROM papers GROUP BY 1),
cites AS (
  SELECT DISTINCT paper_id, unnest(regexp_extract_all(cites, '[^\s,;|/"''\[\]{}()]+')) k
  FROM (SELECT DISTINCT paper_id, cites FROM papers WHERE trim(cites) NOT IN ('', 'None'))
), au AS (SELECT paper_id, person_id k, min(loaded_at) t FROM authorship WHERE person_id IS NOT NULL GROUP BY 1, 2),
refs AS (
  SELECT 'papers.cites' src_field, c.paper_id, c.k ref_key, x.t, pt.f, pt.d FROM cites c JOIN first x USING (paper_id) LEFT JOIN pt ON pt.k = c.k
  UNION ALL
  SELECT 'authorship.person_id', au.paper_id, CAST(au.k AS VARCHAR), au.t, qt.f, qt.d FROM au LEFT JOIN qt ON qt.k = au.k
)
"""
_UTC = "strftime(timezone('UTC', {}), '%Y-%m')"
_PARSED = r"""
WITH c AS (
  SELECT line_id, [trim(x) for x in string_split(line, '$|$')] v FROM raw_lines WHERE feed = 'corpus'
), s AS (
  SELECT line_id, line,
         regexp_full_match(line, '(?s)("([^"]|"")*"|[^"|\n][^|\n]*|)(\|("([^"]|"")*"|[^"|\n][^|\n]*|)){8}') AS ok
  FROM raw_lines WHERE feed = 'submissions'
), f AS (
  SELECT line_id, ok, [trim(CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END)
         for x in regexp_extract_all('|' || line, '\|("(?:[^"]|"")*"|[^"|\n][^|\n]*|)', 1)] v FROM s
), good_c AS (
  SELECT line_id, v FROM c
  WHERE len(v) = 14 AND regexp_full_match(v[1], '0*[1-9][0-9]*') AND regexp_full_match(v[2], '[0-9]+')
    AND v[3] IN ('True', 'False') AND regexp_full_match(v[4], '19[5-9][0-9]|20[0-2][0-9]')
    AND v[5] NOT IN ('', 'None') AND NOT regexp_matches(v[5], '[\x00-\x08\x0A-\x1F]') AND NOT regexp_matches(v[12], '[\x00-\x08\x0A-\x1F]')
    AND regexp_full_match(v[14], '[0-9]+|None')
), good_s AS (
  SELECT line_id, v FROM f
  WHERE ok AND regexp_full_match(v[2], '19[5-9][0-9]|20[0-2][0-9]') AND v[3] NOT IN ('', 'None')
    AND lower(v[8]) IN ('accept', 'reject')
    AND NOT regexp_matches(v[3], '[\x00-\x08\x0B-\x1F]') AND NOT regexp_matches(v[6], '[\x00-\x08\x0B-\x1F]')
)
"""


def _columns(feed: str) -> str:
    return ", ".join(f"v[{i + 1}] AS {c.lower().replace(' ', '_')}" for i, c in enumerate(rejects.FEEDS[feed]))


SQL = {
    "p1_found": _REFS + "SELECT src_field, paper_id, ref_key FROM refs WHERE f IS NULL OR f > t OR d <= t",
    "p1_orphans_by_month": _REFS + f"SELECT src_field, {_UTC.format('t')} AS month, count(*) AS orphans FROM refs WHERE f IS NULL OR f > t OR d <= t GROUP BY 1, 2",
    "p1_transitions_by_month": _REFS
    + f"""SELECT src_field, event, {_UTC.format("a")} AS month, count(*) AS n FROM (
  SELECT src_field, 'opened' event, t a FROM refs WHERE f IS NULL OR f > t OR d <= t
  UNION ALL SELECT src_field, 'resolved', f FROM refs WHERE f > t AND (d IS NULL OR d > f)
  UNION ALL SELECT src_field, 'reopened', d FROM refs WHERE d > greatest(t, f)) GROUP BY 1, 2, 3""",
    "p2_found": _PARSED + "SELECT DISTINCT line_id FROM raw_lines WHERE line_id NOT IN (SELECT line_id FROM good_c UNION ALL SELECT line_id FROM good_s)",
    "p2_clean_corpus": _PARSED + f"SELECT line_id, {_columns('corpus')} FROM good_c",
    "p2_clean_submissions": _PARSED + f"SELECT line_id, {_columns('submissions')} FROM good_s",
    "p4_code_values": r"""
SELECT paper_id, src_field, CAST(unnest(range(1, len(v) + 1)) AS INTEGER) AS pos, unnest(v) AS item FROM (
  SELECT DISTINCT paper_id, 'cites' AS src_field, regexp_extract_all(cites, '[^\s,;|/"''\[\]{}()]+') v FROM papers WHERE trim(cites) NOT IN ('', 'None')
  UNION ALL
  SELECT DISTINCT paper_id, 'author_ids', regexp_extract_all(author_ids, '[^\s,;|/"''\[\]{}()]+') FROM papers WHERE trim(author_ids) NOT IN ('', 'None'))""",
}
