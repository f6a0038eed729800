import pytest
from conftest import t

from folioscope.operators import orphans


@pytest.fixture(scope="module")
def tables(spark, make_papers):
    p = make_papers(
        {"paper_id": 1, "ref_id": "aaa111", "cites": "bbb222,ccc333,ddd444", "loaded_at": t(10)},
        {"paper_id": 1, "ref_id": "aaa111", "cites": "bbb222,ccc333,ddd444", "loaded_at": t(20)},
        {"paper_id": 2, "ref_id": "bbb222", "cites": None, "loaded_at": t(5)},
        {"paper_id": 3, "ref_id": "ccc333", "cites": "aaa111", "loaded_at": t(15), "deleted_at": t(25)},
        {"paper_id": 4, "ref_id": "eee555", "cites": "ccc333;aaa111", "loaded_at": t(28)},
        {"paper_id": 5, "ref_id": None, "cites": "None", "loaded_at": t(1)},
        extra={},
    )
    q = spark.createDataFrame([(7, "x", None, t(1), None), (8, "y", None, t(12), None), (9, "z", None, t(1), t(10))], "person_id long, name string, gender string, loaded_at timestamp, deleted_at timestamp")
    a = spark.createDataFrame(
        [(1, 7, 1, t(10)), (1, 8, 2, t(10)), (1, 8, 2, t(13)), (1, None, 3, t(10)), (2, 9, 1, t(10)), (2, 9, 1, t(11)), (3, 9, 1, t(9)), (None, 99, 1, t(9))], "paper_id long, person_id long, pos int, loaded_at timestamp"
    )
    return p, q, a


WANT = {
    ("papers.cites", 1, "ccc333"), ("papers.cites", 1, "ddd444"), ("papers.cites", 4, "ccc333"),
    ("authorship.person_id", 1, "8"), ("authorship.person_id", 2, "9"), ("authorship.person_id", None, "99"),
}


@pytest.mark.parametrize("slices", [1, 2, 5])
def test_found_whatever_the_slices(tables, slices):
    got = {tuple(r)[:3] for r in orphans.orphans(*tables, slices=slices).collect()}
    assert got == WANT


def test_transitions_and_pending(tables):
    p, q, a = tables
    state, events, shots = orphans.maintain(orphans.references(p, a), orphans.targets(p, q), 3)
    ev = {(r.event, r.paper_id, r.ref_key) for r in events.collect()}
    assert {e for e in ev if e[0] == "resolved"} == {("resolved", 1, "ccc333"), ("resolved", 1, "8")}
    assert {e for e in ev if e[0] == "reopened"} == {("reopened", 1, "ccc333"), ("reopened", 3, "9")}
    n = lambda k: sum(e[0] == k for e in ev)
    assert state.pending.count() == n("opened") - n("resolved") + n("reopened")
    assert shots.filter("until is null").agg({"pending": "sum"}).first()[0] == state.pending.count()


def test_empty(tables):
    p, q, a = (x.limit(0) for x in tables)
    assert orphans.orphans(p, q, a).count() == 0


def test_hot_key(spark):
    refs = spark.range(6000).selectExpr("'authorship.person_id' src_field", "id paper_id", "if(id % 3 = 0, '1', cast(id as string)) ref_key", "timestamp'2020-01-02' came_at")
    parents = spark.range(0, 6000, 2).selectExpr("'authorship.person_id' src_field", "cast(id as string) ref_key", "timestamp'2020-01-01' first_at", "cast(null as timestamp) deleted_at")
    _, events, _ = orphans.maintain(refs, parents, 2)
    want = sum((1 if i % 3 == 0 else i % 2) for i in range(6000))  # key 1 has no parent
    assert events.filter("event = 'opened'").count() == want


def test_stream(spark, tables):
    from folioscope.streaming.ingest import OrphanStream

    s = OrphanStream(spark)
    schema = "kind string, src_field string, paper_id long, ref_key string, at timestamp, deleted_at timestamp"
    s.process(spark.createDataFrame([("ref", "f", 1, "k", t(1), None), ("parent", "f", None, "j", t(1), t(3))], schema))
    s.process(spark.createDataFrame([("parent", "f", None, "k", t(2), None), ("ref", "f", 2, "j", t(2), None)], schema))
    s.process(spark.createDataFrame([("ref", "f", 3, "j", t(4), None)], schema))
    got = {(r.event, r.paper_id) for r in s.events.collect()}
    assert got == {("opened", 1), ("resolved", 1), ("reopened", 2), ("opened", 3)}
    assert {r.paper_id for r in s.state.pending.collect()} == {2, 3}


STREAM = "kind string, src_field string, paper_id long, ref_key string, at timestamp, deleted_at timestamp"


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """State outlives the object, and a batch that comes again counts once."""
    from folioscope.streaming.ingest import OrphanStream

    home = str(tmp_path / "orphans")
    one = spark.createDataFrame([("ref", "f", 1, "k", t(1), None), ("ref", "f", 2, "j", t(1), None)], STREAM)
    two = spark.createDataFrame([("parent", "f", None, "k", t(2), None), ("ref", "f", 1, "k", t(2), None)], STREAM)
    OrphanStream(spark, home).process(one, 0)
    again = OrphanStream(spark, home)
    assert again.batch == 0 and again.state.pending.count() == 2
    again.process(one, 0)
    again.process(two, 1)
    again.process(two, 1)
    last = OrphanStream(spark, home)
    assert sorted((r.event, r.paper_id) for r in last.events.collect()) == [("opened", 1), ("opened", 2), ("resolved", 1)]
    assert [r.paper_id for r in last.state.pending.collect()] == [2]


def test_stream_of_files(spark, tmp_path):
    """The same through a query over files, stopped and started again."""
    from folioscope.streaming.ingest import OrphanStream

    src, home, marks = (str(tmp_path / x) for x in ("in", "home", "marks"))
    stream = lambda: spark.readStream.schema(STREAM).parquet(src)
    spark.createDataFrame([("ref", "f", 1, "k", t(1), None)], STREAM).write.mode("append").parquet(src)
    OrphanStream(spark, home).start(stream(), marks).awaitTermination()
    spark.createDataFrame([("parent", "f", None, "k", t(3), None)], STREAM).write.mode("append").parquet(src)
    s = OrphanStream(spark, home)
    s.start(stream(), marks).awaitTermination()
    assert sorted(r.event for r in s.events.collect()) == ["opened", "resolved"]


def test_late_parent_resolves_with_an_event(spark):
    from folioscope.streaming.ingest import OrphanStream

    s = OrphanStream(spark)
    s.process(spark.createDataFrame([("ref", "f", 1, "k", t(5), None), ("ref", "f", 9, "x", t(9), None)], STREAM))
    s.process(spark.createDataFrame([("parent", "f", None, "k", t(7), None), ("ref", "f", 8, "y", t(12), None)], STREAM))
    assert ("resolved", 1) in {(r.event, r.paper_id) for r in s.events.collect()}
    assert {r.paper_id for r in s.state.pending.collect()} == {8, 9}
