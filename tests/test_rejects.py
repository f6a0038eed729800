import pytest

from folioscope.operators import rejects

GOOD_C = "$|$".join(["5", "44", "False", "1990", "A title", "None", "", "abc", "None", "1", "A B", "text", "None", "0"])
GOOD_S = 'CONF|2010|"A ""fine"" title | more"|A B|kw|"text\nwith line"|Tool|Reject|weak'


def c(**kw):
    v = GOOD_C.split("$|$")
    for k, x in kw.items():
        v[rejects.CORPUS.index(k)] = x
    return "$|$".join(v)


CASES = [
    ("corpus", GOOD_C, True), ("corpus", c(Year=" 2014 "), True), ("corpus", c(ID="0"), False), ("corpus", c(ID="-4"), False), ("corpus", c(Venue=""), False), ("corpus", c(Is_Conference="true"), False),
    ("corpus", c(Year="1949"), False), ("corpus", c(Year="2029"), True), ("corpus", c(Title="None"), False), ("corpus", c(Title=" "), False), ("corpus", c(Title="a\tb"), True), ("corpus", c(Title="a\nb"), False),
    ("corpus", c(Abstract="a\x02b"), False), ("corpus", c(H2="a\x02b"), True), ("corpus", c(Cited_Count="None"), True), ("corpus", c(Cited_Count="1.0"), False), ("corpus", GOOD_C + "$|$x", False), ("corpus", "", False), ("corpus", None, False),
    ("submissions", GOOD_S, True), ("submissions", GOOD_S + "|x", False), ("submissions", GOOD_S.replace('more"', 'more" '), False), ("submissions", GOOD_S.replace('more"', "more"), False), ("submissions", GOOD_S.replace("A B", "A\nB"), False),
    ("submissions", GOOD_S.replace("A B", 'A "B"'), True), ("submissions", GOOD_S.replace("Reject", "acc"), False), ("submissions", GOOD_S.replace("2010", "20100"), False), ("submissions", GOOD_S.replace("text\n", "text\x00"), False), ("other", "x", False), (None, "x", False),
]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i, f, i, x) for i, (f, x, _) in enumerate(CASES)]
    return spark.createDataFrame([*rows, rows[1], rows[2]], "line_id long, feed string, line_no int, line string").selectExpr("*", "'clash' as value", "'clash' as cells", "'clash' as reason")


@pytest.fixture(scope="module")
def bad(lines):
    return {r.line_id: r.reasons for r in rejects.errors(lines).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(bad, i):
    assert (i in bad) != CASES[i][2], (CASES[i], bad.get(i))


def test_clean_rows_are_the_rest(lines, bad):
    ids = {r.line_id for f in rejects.FEEDS for r in rejects.clean_rows(lines, f).collect()}
    assert ids == {i for i in range(len(CASES)) if CASES[i][2]}
    s = rejects.clean_rows(lines, "submissions").filter("line_id = 19").first()
    assert s.title == 'A "fine" title | more' and s.decision == "Reject" and s.abstract == "text\nwith line"


def test_long_line(spark):
    x = spark.createDataFrame([(1, "submissions", 1, GOOD_S.replace("with", 'w""|' * 20_000))], "line_id long, feed string, line_no int, line string")
    assert rejects.errors(x).count() == 0


def test_empty(lines):
    assert rejects.errors(lines.limit(0)).count() == 0
