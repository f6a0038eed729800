"""Reports without the limits of their SQL, against brute force."""

from collections import Counter, deque

import pytest

import __spark_entry__ as entry
from folioscope.operators import community, text
from folioscope.operators.star import Star
from folioscope.plans import measures


def walk(edges, source):
    near, seen, q = {}, {source: 0}, deque([source])
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    while q:
        x = q.popleft()
        for y in near.get(x, ()):
            if y not in seen:
                seen[y] = seen[x] + 1
                q.append(y)
    return seen


def test_hops_go_on_until_nobody_new_is_reached(spark):
    edges = [(i, i + 1) for i in range(9)] + [(2, 20), (20, 21), (50, 51), (3, 3)]
    got = {r.id: r.hops for r in community.hops(spark.createDataFrame(edges, "a long, b long"), 0).collect()}
    assert got == walk(edges, 0) and got[9] == 9 and 50 not in got


def test_bfs_path_len_whole(spark, sf):
    got = {r.person_id: r.hops for r in entry.queries()["bfs_path_len_whole"](spark, sf).collect()}
    a = {(r.paper_id, r.person_id) for r in spark.read.parquet(f"{sf}/authorship.parquet").filter("person_id <> 1").collect()}
    papers = {}
    for p, x in a:
        papers.setdefault(p, []).append(x)
    assert got == walk([(x, y) for m in papers.values() for x in m for y in m if x < y], min(x for _, x in a))


@pytest.fixture(scope="module")
def words(spark, sf):
    """Words by paper: all of them, since the papers have fewer than the vocabulary takes."""
    out = {}
    for r in text.term_counts(measures._docs(Star(spark, sf)), "paper_id", measures.F.col("text")).collect():
        out.setdefault(r.paper_id, set()).add(r.term)
    assert 200 < len(set().union(*out.values())) <= measures.NETWORK
    return out


def test_word_network_of_the_whole_vocabulary(spark, sf, words):
    got = {(r.i, r.j): r.weight for r in entry.queries()["cooccurrence_whole"](spark, sf).collect()}
    want = Counter((x, y) for w in words.values() for x in w for y in w if x < y)
    assert got == want
    degree, total, upto = Counter(t for pair in want for t in pair), 0.0, {}
    norm = sum(n**0.75 for n in degree.values())
    for t in sorted(degree, key=lambda x: x.encode()):
        total += degree[t] ** 0.75
        upto[t] = (degree[t], total / norm)
    table = {r.term: (r.degree, r.upto) for r in entry.queries()["negative_sampling_table_whole"](spark, sf).collect()}
    assert set(table) == set(upto) and all(table[t][0] == n and abs(table[t][1] - u) < 2e-6 for t, (n, u) in upto.items())


def test_cited_word_links_of_the_whole_vocabulary(spark, sf, words):
    want = Counter((x, y) for r in Star(spark, sf).citations.collect() for x in words.get(r.src, ()) for y in words.get(r.dst, ()))
    assert {(r.i, r.j): r.weight for r in entry.queries()["cited_word_links_whole"](spark, sf).collect()} == want
