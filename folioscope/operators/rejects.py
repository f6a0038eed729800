"""Rows that fail to parse: split raw lines into cells, judge cells by a rule table, and part clean rows from rejects.

Lines become (line_id, column, value) rows; a rule table of constant size is joined to them, each rule is evaluated on
its cells, the errors are aggregated by line, and the clean lines are those that an anti-join with the errors leaves.
All of it runs inside the JVM as built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the two feeds, in their order.
CORPUS = ["ID", "Venue", "Is_Conference", "Year", "Title", "H2", "H3", "Ref_ID", "Cites", "Author_IDs", "Authors", "Abstract", "DOI_URL", "Cited_Count"]
SUBMISSIONS = ["Conference", "Year", "Title", "Authors", "Keywords", "Abstract", "Category", "Decision", "Raw Decision"]
FEEDS = {"corpus": CORPUS, "submissions": SUBMISSIONS}
#: Feed, column, name of the rule, pattern that a whole value has to match.
_YEAR = r"(19[5-9][0-9]|20[0-2][0-9])"
_TITLE = r"(?s)(?!None\z).+"
RULES = [
    ("corpus", "ID", "not a positive integer", r"0*[1-9][0-9]*"),
    ("corpus", "Venue", "not plain digits", r"[0-9]+"),
    ("corpus", "Is_Conference", "neither True nor False", r"True|False"),
    ("corpus", "Year", "not a year from 1950 to 2029", _YEAR),
    ("corpus", "Title", "no title", _TITLE),
    ("corpus", "Title", "control character", r"[^\x00-\x08\x0A-\x1F]*"),
    ("corpus", "Abstract", "control character", r"[^\x00-\x08\x0A-\x1F]*"),
    ("corpus", "Cited_Count", "neither digits nor None", r"[0-9]+|None"),
    ("submissions", "Year", "not a year from 1950 to 2029", _YEAR),
    ("submissions", "Title", "no title", _TITLE),
    ("submissions", "Decision", "neither accept nor reject", r"(?i)accept|reject"),
    ("submissions", "Title", "control character", r"[^\x00-\x08\x0B-\x1F]*"),
    ("submissions", "Abstract", "control character", r"[^\x00-\x08\x0B-\x1F]*"),
]


def _quoted_cells(line: Column) -> Column:
    """Struct (cells array<string>, open string, bad string) of a ``|`` line with quoted values.

    The line is cut at every ``|``; a piece that starts with a quote grows by the next pieces until its closing quote
    stands at its end. A closing quote anywhere else, or none at all, is broken quoting."""

    def step(acc: Column, piece: Column) -> Column:
        whole = F.when(acc["open"].isNull(), piece).otherwise(F.concat(acc["open"], F.lit("|"), piece))
        quoted = whole.startswith('"')
        rest = F.replace(F.substr(whole, F.lit(2)), F.lit('""'), F.lit(""))
        at = F.instr(rest, '"')
        value = F.when(quoted, F.replace(F.substr(whole, F.lit(2), F.length(whole) - 2), F.lit('""'), F.lit('"'))).otherwise(whole)
        still = quoted & (at == 0)
        broken = quoted & (at > 0) & (at < F.length(rest))
        stray = ~quoted & whole.contains("\n")
        return F.struct(
            F.when(still, acc["cells"]).otherwise(F.array_append(acc["cells"], value)).alias("cells"),
            F.when(still, whole).alias("open"),
            F.coalesce(acc["bad"], F.when(broken, F.lit("text after closing quote")), F.when(stray, F.lit("line feed outside quotes"))).alias("bad"),
        )

    start = F.struct(F.array().cast("array<string>").alias("cells"), F.lit(None).cast("string").alias("open"), F.lit(None).cast("string").alias("bad"))
    return F.aggregate(F.split(line, r"\|", -1), start, step)


def parse(lines: DataFrame) -> DataFrame:
    """lines(line_id, feed, line, …) → (line_id, feed, cells array<string>, n_expected int, bad string).

    Values are trimmed of spaces. A NULL line has no cells; a feed without a format has n_expected NULL."""
    quoted = F.when(F.col("feed") == "submissions", _quoted_cells(F.col("line")))
    raw = (
        lines.select("line_id", "feed", "line")
        .withColumn("__q", quoted)
        .withColumn("__c", F.when(F.col("feed") == "submissions", F.col("__q.cells")).when(F.col("feed") == "corpus", F.split("line", r"\$\|\$", -1)))
    )
    n = F.coalesce(*[F.when(F.col("feed") == f, F.lit(len(c))) for f, c in FEEDS.items()])
    bad = F.coalesce(F.when(F.col("__q.open").isNotNull(), F.lit("quote never closed")), F.col("__q.bad"))
    return raw.select("line_id", "feed", F.transform("__c", lambda x: F.trim(x)).alias("cells"), n.alias("n_expected"), bad.alias("bad"))


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as rows: feed, col_no (from 0), col_name, reason, pattern. Its size is that of RULES."""
    rows = [(f, FEEDS[f].index(c), c, why, p) for f, c, why, p in RULES]
    return spark.createDataFrame(rows, "feed string, col_no int, col_name string, reason string, pattern string")


def errors(lines: DataFrame) -> DataFrame:
    """(line_id, feed, n_errors long, reasons string) for each line that breaks its format.

    Reasons are sorted and joined with '; '. NULL lines, unknown or NULL feeds are errors; lines delivered twice under
    one line_id count as one; an empty table gives an empty result."""
    parsed = parse(lines)
    width = F.size("cells") != F.col("n_expected")
    shape = parsed.select(
        "line_id",
        "feed",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("n_expected").isNull(), F.lit("unknown feed")),
                    F.when(F.col("n_expected").isNotNull() & F.col("cells").isNull(), F.lit("no line")),
                    F.when(F.col("bad").isNotNull(), F.concat(F.lit("broken quoting: "), F.col("bad"))),
                    F.when(width & F.col("bad").isNull(), F.concat(F.lit("column count "), F.size("cells").cast("string"))),
                )
            )
        ).alias("reason"),
    )
    # cells are only judged where their columns are known
    cells = parsed.filter(~width & F.col("bad").isNull()).select("line_id", "feed", F.posexplode("cells").alias("col_no", "value"))
    rules = F.broadcast(rule_table(lines.sparkSession))
    judged = cells.join(rules, ["feed", "col_no"]).filter(~F.expr(r"regexp(value, concat('\\A(?:', pattern, ')\\z'))"))
    found = judged.select("line_id", "feed", F.concat_ws(": ", "col_name", "reason").alias("reason"))
    return (
        shape.unionByName(found)
        .groupBy("line_id")
        .agg(F.min("feed").alias("feed"), F.collect_set("reason").alias("r"))
        .select("line_id", "feed", F.size("r").cast("long").alias("n_errors"), F.array_join(F.sort_array("r"), "; ").alias("reasons"))
    )


def clean_rows(lines: DataFrame, feed: str) -> DataFrame:
    """The valid lines of a feed as records with one string column per name of the format (lower case, '_' for ' ')."""
    own = lines.filter(F.col("feed") == feed)
    ok = parse(own).join(errors(own).select("line_id"), "line_id", "left_anti")
    cols = [F.col("cells")[i].alias(c.lower().replace(" ", "_")) for i, c in enumerate(FEEDS[feed])]
    return ok.select("line_id", *cols).dropDuplicates(["line_id"])


def found(lines: DataFrame) -> DataFrame:
    return errors(lines).select("line_id")
