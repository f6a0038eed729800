import itertools

import pytest
from conftest import t
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import names
from folioscope.llm.components import components

WORD = st.text("abcd", min_size=0, max_size=7)


def slow(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein by search over single edits, for short words."""
    seen, edge, n = {a}, {a}, 0
    while b not in seen:
        n += 1
        new = set()
        for w in edge:
            for i in range(len(w) + 1):
                new |= {w[:i] + c + w[i:] for c in "abcd"} | ({w[:i] + w[i + 1 :]} if i < len(w) else set())
                if i < len(w):
                    new |= {w[:i] + c + w[i + 1 :] for c in "abcd"}
                if i + 1 < len(w):
                    new.add(w[:i] + w[i + 1] + w[i] + w[i + 2 :])
        edge = {w for w in new - seen if len(w) <= max(len(a), len(b)) + 1}
        seen |= edge
    return n


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", max_size=4), st.text("abcd", max_size=4))
def test_distance(a, b):
    assert names.distance(a, b) == slow(a, b)


@settings(max_examples=200, deadline=None)
@given(WORD, WORD, WORD)
def test_metric(a, b, c):
    assert names.distance(a, b) == names.distance(b, a)
    assert (names.distance(a, b) == 0) == (a == b)
    assert names.distance(a, c) <= names.distance(a, b) + names.distance(b, c)
    assert names.within(a, b, 1) == (names.distance(a, b) <= 1)


def test_cells_lose_no_close_pair(spark):
    import random

    rng = random.Random(3)
    parts = ["wei", "li", "an", "ra", "mo", "ko", "shi", "ten", "gu", "el", "vis", "or", "ma", "a", "o", "é"]
    keys = set()
    while len(keys) < 5000:  # 2 to 20 letters, among them many that one edit parts
        w = "".join(rng.choices(parts, k=rng.randint(1, 9)))[:20]
        i = rng.randrange(len(w) + 1)
        keys |= {x for x in (w, w[:i] + w[i + 1 :], w[:i] + rng.choice("abcxyz") + w[i + 1 :], w[: i - 1] + w[i : i + 1] + w[i - 1 : i] + w[i + 1 :] if i else w) if 2 <= len(x) <= 20}
    keys = sorted(keys)
    got = {tuple(r) for r in names.close_keys(spark.createDataFrame([(k,) for k in keys], "t string")).collect()}
    by_length: dict[int, list[str]] = {}
    for k in keys:
        by_length.setdefault(len(k), []).append(k)
    near = ((a, b) for a in keys for n in (-1, 0, 1) for b in by_length.get(len(a) + n, ()))
    assert got == {(a, b) for a, b in near if names.within(a, b)}


def test_cells_of_a_wider_radius(spark):
    import random

    rng = random.Random(4)
    keys = sorted({"".join(rng.choices("abcde", k=rng.randint(3, 6))) for _ in range(200)})
    got = {tuple(r) for r in names.close_keys(spark.createDataFrame([(k,) for k in keys], "t string"), 2).collect()}
    assert got == {(a, b) for a, b in itertools.product(keys, keys) if names.distance(a, b) <= 2}


@pytest.mark.parametrize(
    ("a", "b", "least", "most"),
    [
        ("Jane M. Miller", "Miller, Jane", 3, 3), ("Réka Brunobelmar", "Reka Brunobelmár", 3, 3), ("Bob Miller", "Robert Miller", 2, 3), ("J. Miller", "Jane Miller", 1, 1), ("Jane Miller", "Joan Mueller", 0, 0.5), ("Jane Miller", "Peter Miller", 0, 0),
        ("IRD Bonn Denembo", "Institute for Requirements and Design, Denembo", 0, 3), ("Dept. of Reliable Computing, Tororuwicz", "Department of Reliable Computing, Tororuwicz", 2, 3), ("Dr. Jane Miller", "JANE MILLER PhD", 3, 3), ("Suteb-Enhof Marton", "Márton Sutebenhof", 2, 3),
    ],
)
def test_agreement(a, b, least, most):
    s = names.agreement(names.tokens_of(a), names.tokens_of(b), {"bob": {"robert"}})
    assert least <= s <= most, s


@pytest.fixture(scope="module")
def world(spark):
    people = [(1, "et al."), (10, "Jane Glimobelmar"), (11, "Glimobelmar, J."), (12, "Jane Glimobelmra"), (13, "Jane Glimobelmar"), (20, "Robert Vlesidalgen"), (21, "Bob Vlesidalgen"), (30, "Ann Trolkatipps"), (31, "Bo Trolkatipps"), (40, "Lonely Krutimonsk"), (41, "Lonely Krutimonsk"), (50, None), (51, "")]
    people += [(100 + i, f"{chr(97 + i) * 3}elin {chr(97 + i) * 4}zzqkwort") for i in range(12)]
    papers = {1: [10, 100, 101, 1, 109, 110], 2: [11, 100, 101], 3: [12, 101], 4: [13, 105, 106], 5: [13, 107, 108], 6: [20, 102, 103], 7: [21, 103], 8: [30, 104], 9: [31, 104]}
    p = spark.createDataFrame([(i, n, None, t(1), None, "clash", "clash") for i, n in people] + [(10, "Jane Glimobelmar", None, t(2), None, "x", "x")], "person_id long, name string, gender string, loaded_at timestamp, deleted_at timestamp, id string, cid string")
    a = spark.createDataFrame([(k, x, i, t(1)) for k, v in papers.items() for i, x in enumerate(v, 1)] + [(1, 10, 1, t(3)), (1, None, 9, t(1)), (None, 10, 1, t(1)), (77, 9999, 1, t(1))], "paper_id long, person_id long, pos int, loaded_at timestamp")
    n = spark.createDataFrame([("Bob", "Robert"), (None, "x")], "nickname string, given_name string")
    return p, a, n


def test_pairs(world):
    got = {tuple(r) for r in names.pairs(names.clusters(*world)).collect()}
    assert got == {(10, 11), (10, 12), (11, 12), (20, 21), (40, 41)}


def test_every_id_has_a_class(world):
    c = names.clusters(*world).collect()
    assert len(c) == 25 and len({r.person_id for r in c}) == 25


def test_empty(world):
    assert names.pairs(names.clusters(*[x.limit(0) for x in world])).count() == 0


def test_long_author_list(spark, world):
    p, a, n = world
    crowd = spark.range(1000, 1400).selectExpr("999L paper_id", "id person_id", "cast(id - 999 as int) pos", "timestamp'2020-01-01' loaded_at")
    more = spark.range(1000, 1400).selectExpr("id person_id", "concat('Member', id, ' Crowdwort') name", "cast(null as string) gender", "timestamp'2020-01-01' loaded_at", "cast(null as timestamp) deleted_at", "'' id", "'' cid")
    got = {tuple(r) for r in names.pairs(names.clusters(p.unionByName(more), a.unionByName(crowd), n)).collect()}
    assert (10, 11) in got


def _people(spark, people, papers):
    p = spark.createDataFrame([(i, n, None, t(1), None) for i, n in people], "person_id long, name string, gender string, loaded_at timestamp, deleted_at timestamp")
    a = spark.createDataFrame([(k, x, i, t(1)) for k, v in papers.items() for i, x in enumerate(v, 1)], "paper_id long, person_id long, pos int, loaded_at timestamp")
    return p, a, spark.createDataFrame([], "nickname string, given_name string")


def test_short_and_hot_names(spark):
    """Names of short tokens, and a family name that most people bear, have keys like any other."""
    people = [(1, "Wei Li"), (2, "W. Li"), (3, "Wang Xu"), (4, "Wang Xv"), (5, "Petra Lindqvist"), (6, "P. Lindqvist"), (7, "Jun Li")]
    people += [(10 + i, f"{chr(97 + i) * 3}elin {chr(97 + i) * 4}zzqkwort") for i in range(12)]
    people += [(100 + i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}qo Li") for i in range(80)] + [(300 + i, f"Wang {chr(97 + i % 26)}{chr(97 + i // 26)}pof") for i in range(80)]
    crew = list(range(10, 17))
    papers = {1: [1, *crew], 2: [2, *crew], 3: [3, *crew], 4: [4, *crew], 5: [5, *crew], 6: [6, *crew], 7: [7, 18, 19], 8: [18, 20], 9: [19, 21]}
    got = {tuple(r) for r in names.pairs(names.clusters(*_people(spark, people, papers))).collect()}
    assert {(1, 2), (3, 4), (5, 6)} <= got
    assert not any(7 in x for x in got)


def test_long_lists_keep_who_shares_a_coauthor(spark):
    rows = spark.createDataFrame([(1, i) for i in range(1, 8)] + [(2, 7), (2, 20), (3, 20), (3, 21), (4, 3), (4, 30)] + [(5, i) for i in range(30, 36)], "paper_id long, person_id long")
    ids = rows.selectExpr("person_id id").distinct()
    whole = {}
    for r in names._coauthors(rows, ids, 100).collect():
        whole.setdefault(r.id, set()).add(r.c)
    some = {}
    for r in names._coauthors(rows, ids, 4).collect():
        some.setdefault(r.id, set()).add(r.c)
    for a, b in itertools.combinations(whole, 2):
        if whole[a] & whole[b]:
            assert some[a] & some[b], (a, b)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (7, 8), (8, 7), (9, 9)] + [(20 + i, 21 + i) for i in range(30)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7} | {20 + i: 20 for i in range(31)}


def test_hot_keys_lose_no_link(spark):
    """Nicknames, mistyped first letters, a lone hot name, and a hot given name with an initial: links of hot keys all the same."""
    people = [(1, "Bob Lindqvist"), (2, "Robert Lindqvist"), (3, "Karen Lindqvist"), (4, "Aaren Lindqvist"), (5, "Petra D."), (6, "Petra Dalgen"), (7, "Lindqvist"), (8, "Quentin Lindqvist")]
    people += [(20 + i, f"{chr(97 + i) * 3}elin {chr(97 + i) * 4}zzqkwort") for i in range(12)]
    people += [(100 + i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}qo Lindqvist") for i in range(80)] + [(300 + i, f"Petra {chr(97 + i % 26)}{chr(97 + i // 26)}pof") for i in range(80)]
    crews = {1: [20, 21, 22], 2: [20, 21, 22], 3: [23, 24], 4: [23, 24], 5: [25, 26], 6: [25, 26], 7: [27, 28, 29], 8: [27, 28, 29]}
    p, a, _ = _people(spark, people, {k: [k, *v] for k, v in crews.items()})
    got = {tuple(r) for r in names.pairs(names.clusters(p, a, spark.createDataFrame([("Bob", "Robert")], "nickname string, given_name string"))).collect()}
    assert {(x, y) for x, y in got if x < 20} == {(1, 2), (3, 4), (5, 6), (7, 8)}
