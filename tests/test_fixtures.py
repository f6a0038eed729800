"""Hand-derived values on a corpus of four papers, and statistics of known outcome."""

import numpy as np
import pytest
from conftest import PAPERS, t

from folioscope.operators import community, rank, stats, text
from folioscope.operators.relational import ranked, top_percent, upsert
from folioscope.operators.star import Star
from folioscope.plans import people, ranks


@pytest.fixture(scope="module")
def micro(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("micro"))
    names = [c.split()[0] for c in PAPERS.split(", ")]
    papers = [
        (1, 1, 2000, "r1", None, 10), (2, 1, 2001, "r2", "r1,r9", None), (3, 2, 2002, "r3", "r1,r2", 4), (4, 1, 2002, "r4", "r1,r1", 0),
    ]
    rows = [dict(zip(("paper_id", "venue_id", "year", "ref_id", "cites", "cited_count"), p, strict=True)) | {"title": f"p{p[0]}", "is_conference": str(p[1] == 1), "loaded_at": t(1)} for p in papers]
    spark.createDataFrame([tuple((dict.fromkeys(names) | r)[n] for n in names) for r in rows], PAPERS).write.parquet(f"{d}/papers.parquet")
    people_ = [(1, "A", "m"), (2, "B", "f"), (3, "C", None), (4, "D", "f")]
    spark.createDataFrame([(i, n, g, t(1), None) for i, n, g in people_], "person_id long, name string, gender string, loaded_at timestamp, deleted_at timestamp").write.parquet(f"{d}/persons.parquet")
    spark.createDataFrame([(1, "V1", "One", 1, 1), (2, "V2", "Two", 1, 0)], "venue_id int, acronym string, name string, impact int, is_conference int").write.parquet(f"{d}/venues.parquet")
    slots = {1: [1, 2, 3], 2: [2, 1], 3: [4], 4: [4, 1]}
    spark.createDataFrame([(p, a, i, t(1)) for p, v in slots.items() for i, a in enumerate(v, 1)], "paper_id long, person_id long, pos int, loaded_at timestamp").write.parquet(f"{d}/authorship.parquet")
    spark.createDataFrame([(1, 2, 1, 2001, "General Chair"), (2, 3, 1, 2002, "Program Chair")], "seat_id long, person_id long, venue_id int, year int, role string").write.parquet(f"{d}/pc_membership.parquet")
    return d


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_collaborations_and_citations(spark, micro):
    assert rows(people.collaboration_pairs(spark, micro), "a", "b", "cnt") == [(1, 2, 2), (1, 3, 1), (1, 4, 1), (2, 3, 1)]
    assert rows(people.local_cites(spark, micro), "paper_id", "local_cites") == [(1, 4), (2, 1), (3, 0), (4, 0)]
    assert rows(people.author_paper_cite_counts(spark, micro, 0), "person_id", "papers", "cites") == [(1, 3, 10), (2, 2, 10), (3, 1, 10), (4, 2, 4)]


def test_growth(spark, micro):
    assert rows(people.growth_after(spark, micro, 1999, 2016), "year", "papers", "new_authors")[-1] == (2002, 2, 1)
    assert rows(people.growth_first_seen(spark, micro), "year", "new_authors") == [(2000, 3), (2001, 0), (2002, 1)]


def test_contributions(spark, micro):
    slots = Star(spark, micro).slots
    harm = dict(rows(rank.contributions(slots), "person_id", "score"))
    assert harm == {1: 1.212121, 2: 0.939394, 3: 0.181818, 4: 1.666667}
    uniform = dict(rows(rank.contributions(slots, harmonic=False, weighted=True), "person_id", "score"))
    assert uniform == {1: 4.666667, 2: 4.166667, 3: 3.666667, 4: 5.5}


def test_h_index(spark, micro):
    slots = Star(spark, micro).slots
    assert rows(rank.h_index(slots), "person_id", "h") == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert rows(rank.h_index(slots, compat=True), "person_id", "h") == [(1, 1), (2, 1), (3, 0), (4, 1)]


@pytest.mark.parametrize(("cites", "standard", "compat"), [([10, 8, 5, 4, 3], 4, 4), ([4, 4, 4, 3, 0], 3, 4), ([5, 4, 3], 3, 0)])
def test_h_index_lists(spark, cites, standard, compat):
    df = spark.createDataFrame([(7, i, c) for i, c in enumerate(cites)], "person_id long, paper_id long, cited_count int")
    assert rank.h_index(df).first().h == standard
    assert rank.h_index(df, compat=True).first().h == compat


def test_page_rank(spark, micro):
    s = Star(spark, micro)
    nodes = s.authorship.selectExpr("person_id id").distinct()
    got = rows(rank.page_rank(ranks.link_matrix(s), nodes, [0.5], 1), "id", "score")
    assert [round(x, 6) for _, x in got] == [1, 0.611111, 0.611111, 0.444444]


def _slow_rank(links, teleport, divisor, damp, n_rounds, scaled=True):
    ids = sorted(teleport)
    pr = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(n_rounds):
        new = {a: (1 - damp) * teleport[a] + damp * sum(pr[b] / divisor[b] for b in ids if (b, a) in links) for a in ids}
        top = max(new.values()) if scaled else 1
        pr = {a: x / top for a, x in new.items()}
    return pr


def test_weighted_page_rank(spark, micro):
    """Shares by row sums of the column-scaled link matrix, by brute force."""
    cnt = {(1, 2): 2, (1, 3): 1, (1, 4): 1, (2, 3): 1}
    cnt |= {(b, a): n for (a, b), n in cnt.items()}
    most = {j: max(n for (_, b), n in cnt.items() if b == j) for j in range(1, 5)}
    divisor = {i: sum(n / most[j] for (a, j), n in cnt.items() if a == i) for i in range(1, 5)}
    cites = {1: 10, 2: 10, 3: 10, 4: 4}
    want = _slow_rank(cnt, {k: v / 34 for k, v in cites.items()}, divisor, 0.5, 3)
    got = rows(ranks.weighted_pagerank_3iter(spark, micro), "person_id", "score")
    assert got == [(k, round(v, 6)) for k, v in sorted(want.items())]


def test_page_rank_with_self_term(spark, micro):
    pulls = {(1, 2), (1, 3), (2, 1), (2, 3), (4, 1)}  # sources and their co-authors
    size = {i: max(1, sum(a == i for a, _ in pulls)) for i in range(1, 5)}
    cites = {1: 10, 2: 10, 3: 0, 4: 0}
    want = _slow_rank({(b, a) for a, b in pulls if any(x == b for x, _ in pulls)}, {k: v / 20 / 4 for k, v in cites.items()}, size, 0.45, 25, False)
    top = max(want.values())
    got = rows(ranks.pagerank_self_term(spark, micro), "person_id", "score")
    assert got == [(k, round(v / top, 6)) for k, v in sorted(want.items())]


def test_damping_values_side_by_side(spark, micro):
    s = Star(spark, micro)
    nodes = s.authorship.selectExpr("person_id id").distinct()
    many = {(r.id, r.damp): r.score for r in rank.page_rank(ranks.link_matrix(s), nodes, [0.1, 0.5, 0.9], 5).collect()}
    for d in (0.1, 0.5, 0.9):
        for r in rank.page_rank(ranks.link_matrix(s), nodes, [d], 5).collect():
            assert many[r.id, d] == pytest.approx(r.score, abs=1e-12)


def test_links_of_a_set(spark, micro):
    s = Star(spark, micro)
    some = spark.createDataFrame([(1,), (2,), (4,)], "id long")
    assert rows(ranks.link_matrix(s, some, 2001), "src", "dst", "cnt") == [(1, 2, 1), (1, 4, 1), (2, 1, 1), (4, 1, 1)]


def test_committee_and_gender(spark, micro):
    share = {(r.venue_id, r.year): (r.papers, r.pc_papers, r.share) for r in people.pc_paper_share(spark, micro).collect()}
    assert share[1, 2001] == (1, 1, 100.0) and share[1, 2002] == (1, 0, 0.0)
    got = {r.year: (r.m, r.f) for r in people.gender_by_year(spark, micro).collect()}
    assert got == {2000: (1, 1), 2001: (1, 1), 2002: (1, 2)}


def test_dominant_topic(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 1, 1), (2, 1, 2), (3, 0, 5), (4, 0, 1), (4, 1, 1)], "paper_id long, topic int, cnt long")
    assert rows(text.dominant(df), "paper_id", "topic") == [(1, 0), (2, 1), (3, 0), (4, 0)]


def test_shortest_path(spark):
    both = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 3)], "src long, dst long")
    got = rows(community.paths(both.unionByName(both.selectExpr("dst src", "src dst").select("src", "dst")), 3), "id", "hops", "path")
    assert (4, 2, "3-1-4") in got


def test_goodness(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 3), (1, 1, 4)], "venue_id int, a long, b long")
    m = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "id long, community long")
    assert rows(community.separability(e, m), "separability") == [(3.0,)]
    inner = e.filter("b < 4")
    assert community.transitivity(inner).first().transitivity == 1.0


def test_a12(spark):
    df = spark.createDataFrame([("x", v) for v in (1, 2, 3)] + [("y", v) for v in (2, 3, 4)], "g string, v int")
    assert stats.a12(df, "g", "v", "x", "y").first().a12 == pytest.approx(0.222222)


def test_a12_of_many(spark):
    """The published speed-ups go to 6,400 values a side; equal to the definition at 1,600."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 300, 1600), rng.integers(20, 320, 1600)
    df = spark.createDataFrame([("x", int(v)) for v in x] + [("y", int(v)) for v in y], "g string, v int")
    want = (np.sum(x[:, None] > y) + 0.5 * np.sum(x[:, None] == y)) / 1600**2
    assert stats.a12(df, "g", "v", "x", "y").first().a12 == pytest.approx(want, abs=1e-6)


def test_quartiles(spark):
    df = spark.createDataFrame([("k", v) for v in range(1, 9)], "g string, v int")
    r = stats.positional(df, "v", ["g"]).first()
    assert (r.q1, r.q2, r.q3, r.spread) == (3, 5, 7, 4) and {r.p10, r.p30, r.p50, r.p70, r.p90} == {1}


def test_smooth_idf(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "b", 2)], "paper_id long, term string, tf long")
    got = {r.term: round(r.idf, 6) for r in text.smooth_idf(df, "paper_id", 2).collect()}
    assert got == {"a": 1.405465, "b": 1.0}


@pytest.mark.parametrize(
    ("groups", "want"),
    [
        ({"x1": [0.34, 0.49, 0.51, 0.6], "x2": [6, 7, 8, 9]}, {"x1": 1, "x2": 2}),
        ({"x1": [0.1, 0.2, 0.3, 0.4], "x2": [0.1, 0.2, 0.3, 0.4], "x3": [6, 7, 8, 9]}, {"x1": 1, "x2": 1, "x3": 2}),
        ({"x1": [0.34, 0.49, 0.51, 0.6], "x2": [0.6, 0.7, 0.8, 0.9], "x3": [0.15, 0.25, 0.4, 0.35], "x4": [0.6, 0.7, 0.8, 0.9], "x5": [0.1, 0.2, 0.3, 0.4]}, {"x5": 1, "x3": 1, "x1": 2, "x2": 3, "x4": 3}),
        ({"x1": [101, 100, 99, 101, 99.5], "x2": [101, 100, 99, 101, 100], "x3": [101, 100, 99.5, 101, 99], "x4": [101, 100, 99, 101, 100]}, {"x1": 1, "x2": 1, "x3": 1, "x4": 1}),
    ],
)
def test_scott_knott(groups, want):
    assert {k: r for k, r, _, _ in stats.scott_knott(groups)} == want


def test_last_delivery_wins(spark):
    base = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "k int, v int")
    new = spark.createDataFrame([(1, 9, 1), (1, 4, 2), (1, None, 3), (2, None, 1)], "k int, v int, at int")
    assert rows(upsert(base, new, ["k"], ["v"], new["at"]), "k", "v") == [(1, 4), (2, 6), (3, 7)]


def test_places(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7 % 31).alias("v"))
    got = {r.id: r.place for r in ranked(df, F.desc("v"), F.asc("id")).collect()}
    want = sorted(range(1000), key=lambda i: (-(i * 7 % 31), i))
    assert got == {x: k for k, x in enumerate(want, 1)}
    assert {r.id for r in top_percent(df, 0.05, F.desc("v"), F.asc("id")).collect()} == set(want[:50])
    assert top_percent(df.limit(0), 0.5, F.desc("v"), F.asc("id")).count() == 0


def test_plain_letters(spark):
    from folioscope.functions import scalar

    df = spark.createDataFrame([("Réka O'Brünn-Łuk 3",), (None,), ("",)], "n string")
    assert [r.p for r in df.select(scalar.plain_letters("n").alias("p")).collect()] == ["rekaobrunnuk", None, ""]


@pytest.mark.parametrize(("name", "want"), [("J. Ann-Marie Smith", "ann"), ("Smith", "smith"), ("J. K.", "k")])
def test_first_name(spark, name, want):
    from pyspark.sql import functions as F

    from folioscope.functions import scalar

    assert spark.createDataFrame([(name,)], "n string").select(scalar.first_name(F.col("n")).alias("p")).first().p == want


def test_complete_linkage():
    """Against a plain search over pairs of clusters."""
    from folioscope.plans.topics import complete_linkage

    rng = np.random.default_rng(3)
    v = {k: list(rng.random(3)) for k in range(9)}
    got = complete_linkage(v)
    clusters, want = {k: [k] for k in v}, []
    far = lambda a, b: max(np.linalg.norm(np.subtract(v[x], v[y])) for x in clusters[a] for y in clusters[b])
    while len(clusters) > 1:
        d, a, b = min((far(a, b), a, b) for a in clusters for b in clusters if a < b)
        clusters[a] += clusters.pop(b)
        want.append((len(want) + 1, a, b, round(float(d), 6), len(clusters[a])))
    assert [(s, i, j, n) for s, i, j, _, n in got] == [(s, i, j, n) for s, i, j, _, n in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-6)
