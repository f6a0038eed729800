import os
import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")
SF = os.environ.get("FOLIOSCOPE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def t(day: int, month: int = 1, year: int = 2020) -> datetime:
    return datetime(year, month, day)


PAPERS = "paper_id long, venue_id int, is_conference string, year int, title string, h2 string, h3 string, ref_id string, cites string, author_ids string, authors string, abstract string, doi_url string, cited_count int, loaded_at timestamp, deleted_at timestamp"


@pytest.fixture(scope="session")
def make_papers(spark):
    names = [c.split()[0] for c in PAPERS.split(", ")]

    def make(*rows, extra: dict | None = None):
        base = dict.fromkeys(names)
        df = spark.createDataFrame([tuple((base | {"loaded_at": t(1)} | r)[n] for n in names) for r in rows], PAPERS)
        # columns that clash with names used inside the operators
        for k in ("text", "n", "rid", "key", "id", "a", "b", "c", "p", "t", "w", "item", "pos", "level", "tokens", "__k", "refs"):
            if extra is not None:
                from pyspark.sql import functions as F

                df = df.withColumn(k, F.lit("clash"))
        return df

    return make
