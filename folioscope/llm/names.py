"""Variant spellings of names typed by people.

Names are folded to plain lower-case tokens; the tokens of a name are its keys, whatever their length. Keys form a metric
space under the unrestricted Damerau-Levenshtein distance, a true metric, and are partitioned by pivots. The pivots lie
outside of the data: one for each set of letters, a string in which these letters go on for ever (longer than any key). A
key's distance to such a pivot is the pivot's length less the number of letters that it has of the set, so the distances
to all pivots are known from its letters alone, and they spread where distances to pivots drawn from the names all but
coincide. A cell is one vector of distances. By the triangle inequality two keys within radius 1 differ by at most 1 in
their distance to any pivot, so their letters differ by one more here, one more there, or both: each key lies in the cell
of its own letters and, as a boundary key, in the cells that have one letter less, and two keys within the radius share a
cell. Inside a cell an exact radius join decides. Cells stay small whatever the data.

A key that many names bear (more than HOT) is combined with letters of the other parts of the name, as are its
neighbours, so that hot family names and common given names are keys too, but never meet as one block. Names that agree
share such a letter or have no other part; those without meet all names of the key, so no link is lost by this.

Two ids with keys that are close are the same person or organisation if their names agree - typos, initials, reordered
or missing parts, nicknames, acronyms - and they share co-authors. Evidence is gathered in rounds, as co-authors that
turn out to be one make more co-authors shared. Ids without co-authors join the only one that their name agrees with.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.common import clean, cut
from folioscope.llm.components import components

RADIUS = 1
#: Keys that more names bear are combined with a letter: a bound of blocks, at which no link is lost.
HOT = 40
SHORTEST_KEY = 2
#: In the place of a letter: a name with other parts, as it meets names that have none; and such a name, as it meets all.
OTHERS, ALONE = "<", ">"
#: Tokens up to this length are so often alike by chance that one edit makes them the same only with more evidence.
SHORT = 3
#: Classes with at most so many co-authors may be joined by their names.
FEW = 3
#: Papers with longer author lists aren't multiplied out: they stand as one co-author for their members and for all who
#: share a co-author with one. So whoever shares a co-author still does; only their number counts a long list once.
LONG_LIST = 200
#: Rounds after which evidence that still grows is an error; it is done when a round joins no classes.
MOST_ROUNDS = 50
#: Fixed values.
TITLES = {"dr", "prof", "jr", "sr", "ii", "iii", "phd", "mr", "mrs", "ms"}
SMALL = {"of", "for", "and", "the", "in"}
ORGANISATION = {"department", "dept", "centre", "center", "ctr", "institute", "inst", "laboratory", "lab", "labs", "university", "univ", "group", "school", "faculty", "team"}
_PLAIN = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "’": "'", "'": ""})
_TOKEN = re.compile(r"[^\W\d_]+")


def fold(name: str) -> str:
    s = unicodedata.normalize("NFKD", name.translate(_PLAIN))
    return "".join(c for c in s if not unicodedata.combining(c)).lower()


def tokens_of(name: str) -> list[str]:
    """Folded tokens of a name in order, without titles; a comma ("Doe, Jane") turns a person's name round."""
    s = fold(name).replace("’", "").replace("'", "")
    parts = [x for x in s.split(",")]
    if len(parts) == 2 and not any(t in ORGANISATION for t in _TOKEN.findall(s)):
        s = parts[1] + " " + parts[0]
    return [t for t in _TOKEN.findall(s.replace("-", " ")) if t not in TITLES]


def letters_of(token: str, nick: dict[str, set[str]]) -> set[str]:
    """Letters of which two tokens share one if they agree: the first, the second in case the first is mistyped, and the
    first of the names that a nickname stands for."""
    return {*token[:2], *(x[0] for x in nick.get(token, ()) if x)}


def keys_of(name: str, nick: dict[str, set[str]] | None = None) -> list[tuple[str, list[str]]]:
    """Tokens that are keys, hyphenated ones as one word too, each with letters of the name's other parts ('' if there is
    none)."""
    toks = [t for t in tokens_of(name) if t not in SMALL]
    joined = [t for t in _TOKEN.findall(fold(name).replace("'", "").replace("-", "")) if t not in TITLES]
    out = []
    for key in sorted({*toks, *joined}):
        if len(key) < SHORTEST_KEY or key in ORGANISATION or key in SMALL:
            continue
        rest = list(toks)
        if key in rest:
            rest.remove(key)
        else:  # a hyphenated word: its parts are no other parts
            rest = [x for x in rest if x not in key]
        out.append((key, sorted(set().union(*(letters_of(x, nick or {}) for x in rest))) or [""]))
    return out


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insert, delete, replace, swap neighbours; a true metric."""
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    last: dict[str, int] = {}
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            same = a[i - 1] == b[j - 1]
            if same:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a) + 1][len(b) + 1]


def _within_one(a: str, b: str) -> bool:
    """distance(a, b) <= 1, in one pass: what is left between the common beginning and the common end decides."""
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    i = 0
    while i < n and i < m and a[i] == b[i]:
        i += 1
    while n > i and m > i and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    if n - i <= 1 and m - i <= 1:
        return True
    return n - i == 2 and m - i == 2 and a[i] == b[i + 1] and a[i + 1] == b[i]


def within(a: str, b: str, r: int = 1) -> bool:
    """distance(a, b) <= r."""
    if r == 1:
        return _within_one(a, b)
    return abs(len(a) - len(b)) <= r and (a == b or distance(a, b) <= r)


def _subsequence(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def agreement(a: list[str], b: list[str], nick: dict[str, set[str]]) -> float:
    """How two names agree: 3 in all full parts, 2 in a full given name, 1 by initials only, 0.5 perhaps, 0 not."""
    if not a or not b:
        return 0.0
    if "".join(a) == "".join(b) or sorted(a) == sorted(b):
        return 3.0 if sum(len(t) > 1 for t in a) > 1 else 1.0
    org = bool(ORGANISATION & (set(a) | set(b)))
    ra, rb = [t for t in a if t not in SMALL], [t for t in b if t not in SMALL]
    full = initials = family = 0

    def pair(test) -> int:
        n = 0
        for x in list(ra):
            for y in rb:
                if test(x, y):
                    ra.remove(x)
                    rb.remove(y)
                    n += 1
                    break
        return n

    full += pair(lambda x, y: x == y and len(x) > 1)
    family = full
    full += pair(lambda x, y: min(len(x), len(y)) >= 4 and within(x, y) or min(len(x), len(y)) == 3 and x[0] == y[0] and within(x, y))
    full += pair(lambda x, y: x in nick.get(y, ()) or y in nick.get(x, ()) or bool(nick.get(x, set()) & nick.get(y, set())))
    if org:
        full += pair(lambda x, y: min(len(x), len(y)) >= 3 and x[0] == y[0] and _subsequence(*sorted((x, y), key=len)))
    before = set(ra), set(rb)
    initials += pair(lambda x, y: x[0] == y[0] and min(len(x), len(y)) == 1)
    ends = [x[-1] in left and len(x[-1]) > 1 for x, left in ((a, before[0]), (b, before[1]))]
    if full == 0 and family == 0:
        return 0.0
    if not org and all(ends):
        # neither name's last part is in the other but for an initial: what they share are given names
        x, y = ("".join(t for t in r if len(t) > 1) for r in (ra, rb))
        if x != y and (initials or not within(x, y)):
            return 0.0
    if org:
        short, long = sorted((ra, rb), key=len)
        if not short and not long:
            return 3.0
        if len(short) == 1 and len(long) > 1 and short[0] == "".join(t[0] for t in long):
            return 2.0
        return 2.0 if not short and full >= 3 else 0.0
    la, lb = [t for t in ra if len(t) > 1], [t for t in rb if len(t) > 1]
    if la and lb:  # both have a name that the other lacks
        x, y = "".join(la), "".join(lb)
        if x == y or within(x, y, 1):
            return 3.0 if x == y or min(len(x), len(y)) > SHORT else 0.5
        given = a[0] in la or b[0] in lb  # what differs stands where given names do
        if given and x[0] == y[0] and (within(x, y, 2) or x[:2] == y[:2] or _subsequence(*sorted((x, y), key=len))) or within(x, y, 1):
            return 0.5 if full >= 1 else 0.0
        if len(la) == 1 and len(lb) > 2 and la[0] == "".join(t[0] for t in lb) or len(lb) == 1 and len(la) > 2 and lb[0] == "".join(t[0] for t in la):
            return 2.0
        return 0.0
    if full >= 2:
        return 2.0 if la or lb else 3.0
    if initials:
        return 1.0
    # one name is but a family name, or initials that the other lacks
    return 0.0 if (ra and rb) else 0.5


def cells(keys: DataFrame, radius: int = RADIUS) -> DataFrame:
    """keys(t), distinct → (t, cell): the cell of each key's distances to the pivots, and those within its boundary.

    A cell is a multiset of letters, hashed; what a collision lets in is told by the exact join."""
    letters = F.array_sort(F.filter(F.split("t", ""), lambda c: c != ""))
    out = level = keys.select("t", letters.alias("ls"))
    for _ in range(radius):
        less = F.transform(F.sequence(F.lit(1), F.size("ls")), lambda i: F.concat(F.slice("ls", F.lit(1), i - 1), F.slice("ls", i + 1, F.size("ls"))))
        level = level.filter(F.size("ls") > 0).select("t", F.explode(F.array_distinct(less)).alias("ls"))
        out = out.unionByName(level)
    return out.select("t", F.xxhash64(F.array_join("ls", "")).alias("cell")).distinct() if radius > 1 else out.select("t", F.xxhash64(F.array_join("ls", "")).alias("cell"))


def close_keys(keys: DataFrame, radius: int = RADIUS) -> DataFrame:
    """keys(t), distinct → (t, u) for all pairs within the radius, both ways and each with itself."""

    def exact(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pdf[[within(a, b, radius) for a, b in zip(pdf["t"], pdf["u"], strict=True)]]

    c = cut(cells(keys, radius), "cells")
    # an exchange of neighbours is two edits to levenshtein
    met = c.join(c.select(F.col("t").alias("u"), "cell"), "cell").filter((F.col("t") < F.col("u")) & (F.levenshtein("t", "u", 2 * radius) >= 0)).select("t", "u").distinct()
    near = cut(met.mapInPandas(exact, "t string, u string"), "near")
    return near.unionByName(near.select(F.col("u").alias("t"), F.col("t").alias("u"))).unionByName(keys.select("t", F.col("t").alias("u")))


def _prepare(persons: DataFrame, nick: dict[str, set[str]]) -> DataFrame:
    """(id, plain, toks, keys): one row a person id, by the latest delivery."""
    latest = persons.filter("person_id is not null").groupBy("person_id").agg(F.max_by("name", "loaded_at").alias("name")).filter(clean("name").isNotNull())

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            toks = [tokens_of(n) for n in pdf["name"]]
            keys = [[{"t": k, "i": i} for k, i in keys_of(n, nick)] for n in pdf["name"]]
            yield pd.DataFrame({"id": pdf["person_id"], "plain": [" ".join(sorted(t)) for t in toks], "toks": toks, "keys": keys})

    return latest.mapInPandas(run, "id long, plain string, toks array<string>, keys array<struct<t: string, i: array<string>>>").filter("plain <> '' and plain <> 'al et'")


def _coauthors(authorship: DataFrame, ids: DataFrame, most: int = LONG_LIST) -> DataFrame:
    """(id, c): distinct co-authors; those not listed don't count. Lists of more than ``most`` are one c (negative), of
    their members, of all with a co-author among these, and of the members of other long lists that share one."""
    rows = cut(authorship.filter("person_id is not null and paper_id is not null").select("paper_id", F.col("person_id").alias("id")).distinct().join(ids.select("id"), "id", "left_semi"), "rows")
    n = cut(rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("paper_id"), "long")
    if n.isEmpty():
        return rows.join(rows.select("paper_id", F.col("id").alias("c")), "paper_id").filter("id <> c").select("id", "c").distinct()
    short = rows.join(n, "paper_id", "left_anti")
    pairs = cut(short.join(short.select("paper_id", F.col("id").alias("c")), "paper_id").filter("id <> c").select("id", "c").distinct(), "pairs")
    crowd = cut(rows.join(n, "paper_id", "left_semi"), "crowd")
    of = crowd.select(F.col("id").alias("c"), F.col("paper_id").alias("q"))
    near = pairs.join(of, "c").select("id", "q")
    shared = crowd.select("paper_id", F.col("id").alias("c")).join(of, "c").filter("paper_id <> q").select("paper_id", "q").distinct()
    near = near.unionByName(crowd.join(shared, "paper_id").select("id", "q")).unionByName(crowd.select("id", F.col("paper_id").alias("q")))
    return pairs.unionByName(near.distinct().select("id", (-F.col("q") - 1).alias("c")))


def _judged(pairs: DataFrame, nick: dict[str, set[str]]) -> DataFrame:
    """pairs with ta, tb → the same with agreement."""
    cols = [f for f in pairs.schema if f.name not in ("ta", "tb")]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            s = [agreement(list(a), list(b), nick) for a, b in zip(pdf["ta"], pdf["tb"], strict=True)]
            yield pdf.drop(columns=["ta", "tb"]).assign(s=s)

    return pairs.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols) + ", s double")


def _merge(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(id, cid) with the clusters that links(a, b) join made one."""
    c = components(links)
    return cut(nodes.join(c, nodes.cid == c.id, "left").select(nodes.id, F.coalesce("root", "cid").alias("cid")), "nodes")


def _keys(people: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(id, t, i) and the close pairs (t, u) of their tokens: the keys of each name, i being '' or, for tokens that more
    than ``hot`` names bear and for what is close to them, a letter of another part of the name, and OTHERS, or '' and
    ALONE for names that have no other part."""
    rows = cut(people.select("id", F.explode("keys").alias("k")).select("id", "k.*"), "keys")
    n = cut(rows.groupBy("t").agg(F.count(F.lit(1)).alias("n")), "bearers")
    close = cut(close_keys(n.select("t")), "close")
    many = n.filter(F.col("n") > hot).select("t")
    near = close.join(many.select(F.col("t").alias("u")), "u", "left_semi").select("t").distinct()
    plain = rows.join(many, "t", "left_anti").select("id", "t", F.lit("").alias("i"))
    meets = F.when(F.get("i", F.lit(0)) == "", F.lit(ALONE)).otherwise(F.lit(OTHERS))
    paired = rows.join(near, "t", "left_semi").select("id", "t", F.explode(F.array_append("i", meets)).alias("i"))
    return cut(plain.unionByName(paired).distinct(), "keyed"), close


def clusters(persons: DataFrame, authorship: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(person_id, class_id): the least id of each group of ids that belong to one person or organisation.

    NULL and empty names form classes of their own; an empty table gives an empty result; ids without any co-author are
    judged by their names alone and only where these agree with one class. Nicknames are a list for all tasks; of more
    than 1,000,000 the operator refuses to run."""
    nick: dict[str, set[str]] = {}
    listed = nicknames.filter("nickname is not null and given_name is not null").select("nickname", "given_name").distinct().limit(1_000_001).collect()
    if len(listed) > 1_000_000:
        raise ValueError("more than 1,000,000 nicknames")
    for r in listed:
        nick.setdefault(fold(r.nickname), set()).add(fold(r.given_name))
    people = cut(_prepare(persons, nick), "people")
    key_rows, close = _keys(people)
    co = cut(_coauthors(authorship, people), "co")
    # equal names that share a co-author: a star each, not all pairs
    least = people.select("id", "plain").join(co, "id").withColumn("b", F.min("id").over(Window.partitionBy("plain", "c"))).filter("id <> b")
    equal = cut(least.select(F.col("id").alias("a"), "b").distinct(), "equal")
    nodes = _merge(people.select("id", F.col("id").alias("cid")), equal)
    toks = people.select("id", "toks", "plain")
    for _ in range(MOST_ROUNDS):
        ok = _linked(nodes, co, key_rows, close, toks, nick)
        if ok.isEmpty():
            break
        nodes = _merge(nodes, ok)
    else:
        raise RuntimeError("classes of names did not settle")
    nodes = _merge(nodes, _by_name(people, nodes, co, key_rows, close, nick))
    rest = persons.filter("person_id is not null").select("person_id").distinct()
    return rest.join(nodes, rest.person_id == nodes.id, "left").select("person_id", F.coalesce("cid", "person_id").alias("class_id"))


def _linked(nodes: DataFrame, co: DataFrame, key_rows: DataFrame, close: DataFrame, toks: DataFrame, nick: dict[str, set[str]]) -> DataFrame:
    """Links (a, b) between classes that bear close keys, share a co-author and have names that agree."""
    by = nodes.select(F.col("id").alias("c0"), F.col("cid").alias("c1"))
    linked = co.join(nodes, "id").join(by, co.c == by.c0, "left").select("cid", F.coalesce("c1", "c").alias("c")).filter("cid <> c").distinct()
    linked = cut(linked, "linked")
    sizes = linked.groupBy("cid").agg(F.count(F.lit(1)).alias("m"))
    ck = cut(key_rows.join(nodes, "id").select("cid", "t", "i").distinct(), "ck")
    left = ck.join(linked, "cid")
    # names without other parts meet all, and all meet them; no name with others meets another by this
    right = left.select(F.col("cid").alias("d"), F.col("t").alias("u"), F.translate("i", OTHERS + ALONE, ALONE + OTHERS).alias("i"), "c")
    met = left.join(close, "t").join(right, ["u", "i", "c"]).filter("cid < d").select("cid", "d", "c").distinct().groupBy("cid", "d").agg(F.count(F.lit(1)).alias("o"))
    met = cut(met.join(sizes, "cid").join(sizes.select(F.col("cid").alias("d"), F.col("m").alias("md")), "d"), "met")
    # every distinct name of one class against every distinct name of the other; the best agreement counts
    names = nodes.join(toks, "id").select("cid", "plain", "toks").dropDuplicates(["cid", "plain"])
    both = met.join(names.select("cid", F.col("toks").alias("ta")), "cid").join(names.select(F.col("cid").alias("d"), F.col("toks").alias("tb")), "d")
    judged = _judged(both, nick).groupBy("cid", "d").agg(F.first("o").alias("o"), F.first("m").alias("m"), F.first("md").alias("md"), F.max("s").alias("s"), F.avg((F.col("s") > 0).cast("int")).alias("share"))
    least_size = F.least("m", "md")
    ok = judged.filter(((F.col("s") >= 1) & (F.col("share") >= 0.5)) | ((F.col("s") == 0.5) & (F.col("o") >= 2) & (F.col("o") >= 0.4 * least_size)))
    ok = cut(ok, "ok")
    # a name of initials that agrees with several goes with those it shares most with
    most = ok.select(F.col("cid").alias("x"), "o").unionByName(ok.select(F.col("d").alias("x"), "o")).groupBy("x").agg(F.max("o").alias("top"))
    ok = ok.join(most.select(F.col("x").alias("cid"), F.col("top").alias("ta")), "cid").join(most.select(F.col("x").alias("d"), F.col("top").alias("tb")), "d")
    return cut(ok.filter((F.col("s") >= 2) | (F.col("o") * 2 >= F.greatest("ta", "tb"))).select(F.col("cid").alias("a"), F.col("d").alias("b")), "links")


def _by_name(people: DataFrame, nodes: DataFrame, co: DataFrame, key_rows: DataFrame, close: DataFrame, nick: dict[str, set[str]]) -> DataFrame:
    """Links (a, b) by names alone, for classes with next to no co-authors (up to FEW).

    Such a class joins the only well-connected class that its name agrees with: wholly, or by initials too if it has no
    co-author at all. Where there is no such class it joins others like it that bear the same name. Where several
    well-connected classes agree it can't be told whose it is, and there is no link. Distinct names meet, not ids."""
    by = co.join(nodes, "id").select("cid", "c").distinct().groupBy("cid").agg(F.count(F.lit(1)).alias("m"))
    classes = cut(nodes.join(by, "cid", "left").join(people.select("id", "plain", "toks"), "id").select("cid", "plain", "toks", F.coalesce("m", F.lit(0)).alias("m")).dropDuplicates(["cid", "plain"]), "classes")
    strong = F.when(F.col("m") > FEW, F.col("cid"))
    bearers = classes.groupBy("plain").agg(F.min(strong).alias("lo"), F.max(strong).alias("hi"), F.min(F.when(F.col("m") <= FEW, F.col("cid"))).alias("like"), F.first("toks").alias("tb"))
    weak = classes.filter(F.col("m") <= FEW).select("cid", "m", "plain", F.col("toks").alias("ta"))
    # equal or initialled parts only: here a name without other parts agrees with its like alone
    plain_keys = key_rows.filter(~F.col("i").isin(OTHERS, ALONE)).join(people.select("id", "plain"), "id").select("plain", "t", "i").distinct()
    other = plain_keys.join(bearers, "plain").select(F.col("t").alias("u"), "i", F.col("plain").alias("p2"), "tb", "lo", "hi", "like")
    met = weak.join(plain_keys, "plain").join(close, "t").join(other, ["u", "i"]).select("cid", "m", "p2", "lo", "hi", "like", "ta", "tb").dropDuplicates(["cid", "p2", "ta"])
    judged = _judged(met, nick).filter((F.col("s") >= 3) | ((F.col("m") == 0) & (F.col("s") >= 1)))
    one = judged.groupBy("cid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.when(F.col("s") >= 3, F.col("like"))).alias("like"))
    return cut(one.filter("lo = hi or lo is null").select(F.col("cid").alias("a"), F.coalesce("lo", "like").alias("b")).filter("a <> b"), "by_name")


def pairs(classes: DataFrame) -> DataFrame:
    """(person_id_a, person_id_b), a < b: all pairs of each class of clusters()."""
    some = classes.join(classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("class_id"), "class_id")
    return some.select("class_id", F.col("person_id").alias("person_id_a")).join(some.select("class_id", F.col("person_id").alias("person_id_b")), "class_id").filter("person_id_a < person_id_b").select("person_id_a", "person_id_b")
