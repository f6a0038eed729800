import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from folioscope.operators import unpack

CASES = [
    ("cites", "a1b2c3,d4e5f6", ["a1b2c3", "d4e5f6"]),
    ("cites", "{'9b871ec3904', '34c2421944b'}", ["9b871ec3904", "34c2421944b"]),
    ("cites", ",a1b2 c3d4 e5f6, ", ["a1b2", "c3d4", "e5f6"]),
    ("cites", "a1;;b2|c3 / d4\ne5", ["a1", "b2", "c3", "d4", "e5"]),
    ("authors", '"Doe, Jane"; "Roe, R."; et al.', ["Doe, Jane", "Roe, R.", "et al."]),
    ("authors", "Jane Doe, Richard Roe & Bo Li", ["Jane Doe", "Richard Roe", "Bo Li"]),
    ("authors", "Doe, Jane; Roe, R.; Li, Bo", ["Doe, Jane", "Roe, R.", "Li, Bo"]),
    ("authors", "Jane Doe,Richard Roe,et al,,", ["Jane Doe", "Richard Roe", "et al"]),
    ("authors", "Jane Doe, Department of Systems, Languages and Verification, Bonn, Bo Li", ["Jane Doe", "Department of Systems, Languages and Verification, Bonn", "Bo Li"]),
    ("authors", "Omar D'Arcy and et al.", ["Omar D'Arcy", "et al."]),
    ("authors", "['Jane Doe', 'Richard Roe']", ["Jane Doe", "Richard Roe"]),
]


@pytest.fixture(scope="module")
def table(make_papers):
    good = [{"paper_id": 1000 + i, "author_ids": "1,2", "authors": '"Doe, Jane"; "Department of Systems, Languages and Verification, Bonn"', "cites": '"a1";"b2"'} for i in range(20)]
    good += [{"paper_id": 2000 + i, "author_ids": "1,2,3", "authors": "Ann Lee; Bo Ray; Cy Poe", "cites": "a1;b2;c3"} for i in range(20)]
    rows = []
    for i, (f, text, want) in enumerate(CASES):
        rows.append({"paper_id": i, f: text, "author_ids": ",".join(str(k) for k in range(len(want))) if f == "authors" else None})
    odd = [{"paper_id": 500}, {"paper_id": 501, "authors": "", "cites": "None"}, {"paper_id": 502, "authors": " ,; "}, {"paper_id": None, "cites": "ff00ff"}]
    long_ = [{"paper_id": 503, "cites": ",".join(f"{k:06x}" for k in range(5000))}]
    return make_papers(*good, *rows, *rows, *odd, *long_, extra={})


@pytest.fixture(scope="module")
def values(table):
    out = {}
    for r in unpack.unpack_papers(table).collect():
        out.setdefault((r.paper_id, r.src_field), {})[r.pos] = r.item
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_splits(values, i):
    field, _, want = CASES[i]
    assert values[i, field] == want


def test_no_values(values):
    assert not [k for k in values if k[0] in (500, 501, 502)]
    assert values[None, "cites"] == ["ff00ff"]


def test_long_list_is_whole(values):
    assert len(values[503, "cites"]) == 5000


def test_value_of_many_atoms():
    """A value isn't cut because it is long: twelve atoms that belong together stay one where others are quoted alike."""
    name = "Centre for " + ", ".join(f"Topic{chr(97 + i)}" for i in range(12))
    model = unpack.Model({unpack.shape(name): 50.0, "W W": 50.0}, {"C": (1.0, 1000.0), "H": (10.0, 10.0)})
    lat = unpack.Lattice(f"Jane Doe; {name}; Bo Li", False)
    cuts, _ = unpack.best(lat, model.score, model, None)
    assert [lat.value(i, j) for i, j in cuts] == ["Jane Doe", name, "Bo Li"]
    cuts, _ = unpack.best(lat, model.score, model, 3)
    assert [lat.value(i, j) for i, j in cuts] == ["Jane Doe", name, "Bo Li"]


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["Jane Doe", "Doe", "J.", "and", "X1", "of Systems"]), min_size=1, max_size=9), st.sampled_from([None, 1, 2, 3]))
def test_the_likeliest_split_is_found(parts, count):
    """Against all splits there are."""
    model = unpack.Model({"W W": 20.0, "W": 5.0, "I": 3.0, "D": 2.0, "W, I": 6.0, "W, W W": 1.0}, {"C": (6.0, 10.0), "A": (8.0, 10.0)})
    lat = unpack.Lattice(", ".join(parts), False)
    n = len(lat.starts)
    if not n:
        return
    spans = {(i, j): w for j, row in enumerate(unpack._spans(lat, model.score, model, n)) for i, w in row}
    best = None
    for mask in range(1 << (n - 1)):
        ends = [k for k in range(n - 1) if mask >> k & 1] + [n - 1]
        cuts, at = [], 0
        for e in ends:
            cuts.append((at, e))
            at = e + 1
        if count is not None and count <= n and len(cuts) != count or any(c not in spans for c in cuts):
            continue
        w = sum(spans[c] for c in cuts)
        best = w if best is None else max(best, w)
    got, _ = unpack.best(lat, model.score, model, count)
    assert best is None or sum(spans[c] for c in got) == pytest.approx(best)


def test_empty_table(make_papers, table):
    assert unpack.unpack_papers(table.limit(0)).count() == 0


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.from_regex(r"[0-9a-f]{6,11}", fullmatch=True), min_size=1, max_size=8), st.sampled_from([",", ", ", ";", "; ", "|", " | ", "\t", "\n", " / ", " "]), st.booleans())
def test_codes_round_trip(items, sep, quoted):
    text = sep.join(f'"{x}"' if quoted and sep != " " else x for x in items)
    lat = unpack.Lattice(text, True)
    model = unpack.Model({"D": 10.0, "W": 1.0, "w": 1.0}, {})
    cuts, _ = unpack.best(lat, model.score, model, None)
    assert [lat.value(i, j) for i, j in cuts] == items


def test_long_field_is_split_into_its_number_of_values():
    """The number of values counts in a field of any length, and in a list of two thousand names."""
    model = unpack.Model({"W": 50.0, "W, W": 1.0}, {"C": (9.0, 10.0)})
    for names, sep in ((300, ", "), (2000, "; ")):
        text = sep.join(["Doe, Jane"] * (names - 1) + ["Plato"])
        lat = unpack.Lattice(text, False)
        cuts, _ = unpack.best(lat, model.score, model, names)
        assert len(lat.starts) == 2 * names - 1 and len(cuts) == names
        assert [x for i, j in cuts for x in range(i, j + 1)] == list(range(2 * names - 1))
