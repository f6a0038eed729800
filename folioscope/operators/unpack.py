"""Several values packed in one field: one row per value, with its position.

A field is a lattice of atoms (quoted spans and stretches without separator) and separators. Whether a separator is a
border between two values or belongs to a value ("Doe, Jane", "Systems, Languages and Verification") is decided by an
expectation-maximisation segmentation:

* a small model of each column - how often each class of separator is a border, and how often values have each shape -
  is learned over all rows, starting from the values that quotes and hard separators isolate;
* value frequencies are then learned from the whole column, as a distributed table of expected counts;
* rows that the small model leaves in doubt meet the frequencies of their own candidate values, and a Viterbi search
  over the lattice picks the likeliest split. Quoted spans stay atomic.

A column whose number of values is known from another column (``count_hint``) is split into that number where it can.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.common import clean, cut

#: Fixed values. Separators that are always a border; the others are weighed. A space is one only in columns of codes.
HARD = ";|\t\n\r"
_SOFT = re.compile(r" *(?:[;|\t\n\r]| / | & |,(?: *(?:and|und|&) )?| (?:and|und) )[ ;|\t\n\r,]*(?:(?<=[ ,;])(?:and|&) )? *")
_SPACE = re.compile(r" +")
_WORD = re.compile(r"[^ ]+")
_CLOSE = re.compile(r' *(?:[;|\t\n\r,]|/ | & |& | and |$)')
_BRACKETS = {"[": "]", "{": "}", "(": ")"}
_TOKEN = re.compile(r"[^\W\d_]+|\d[\w]*|[^\w\s]|\s+|_", re.UNICODE)
#: Log weight by which a value may fall behind its atoms before it isn't looked at any more.
FAR = 8.0
#: Shapes are alike from this many tokens on, so a value of more atoms is as likely as one of so many.
SHAPE_TOKENS = 14
#: Shapes rarer than this share of all values get the floor instead: so a model has at most 1/MIN_SHARE shapes.
MIN_SHARE = 1e-5
#: A row is in doubt when the second-best split is likelier than this.
DOUBT = 0.02
#: Weight of an atom that nothing isolates, in the first round.
ATOM = 0.02
_EPS = 1e-9


def shape(value: str) -> str:
    """The kinds of tokens of a value, at most SHAPE_TOKENS of them: W word, I initial, w lower-case word, D code, else the sign."""
    out = []
    for m in islice(_WORD.finditer(value), SHAPE_TOKENS):
        t = m.group()
        end = t[-1] if t[-1] in ",&" else ""
        t = t.rstrip(",")
        core = t.rstrip(".")
        if not core:
            k = "."
        elif any(c.isdigit() for c in core):
            k = "D"
        elif len(core) == 1:
            k = "I"
        elif core[0].islower():
            k = core if core in ("of", "for", "and", "al", "et") else "w"
        else:
            k = "W"
        out.append(k + end)
    return " ".join(out)


class Lattice:
    """Atoms of one field, and the class of the separator after each but the last."""

    __slots__ = ("text", "starts", "ends", "quoted", "seps")

    def __init__(self, text: str, spaces: bool):
        s = text.strip(" ")
        for _ in range(2):
            t = s.rstrip(" ,;|\t\n\r")
            if t and t[0] in _BRACKETS and t[-1] == _BRACKETS[t[0]]:
                s = t[1:-1].strip(" ")
        self.text, self.starts, self.ends, self.quoted, self.seps = s, [], [], [], []
        i, n, pending = 0, len(s), ""
        while i < n:
            if s[i] in " ;|\t\n\r,":
                pending += s[i]
                i += 1
                continue
            close = -1
            if s[i] in "\"'":
                j = s.find(s[i], i + 1)
                while j >= 0 and not _CLOSE.match(s, j + 1):
                    j = s.find(s[i], j + 1)
                close = j
            if close > i:
                a, b, q, i = i + 1, close, True, close + 1
                m = _SOFT.match(s, i)
                sep = m.group() if m and m.end() > i else ""
                i += len(sep)
            else:
                m = _SOFT.search(s, i)
                e = m.start() if m else n
                k = _SPACE.search(s, i, e) if spaces else None
                if k and k.end() < e:
                    a, b, q, sep, i = i, k.start(), False, " ", k.end()
                else:
                    a, b, q, sep = i, e, False, m.group() if m else ""
                    i = e + len(sep)
            while a < b and s[a] == " ":
                a += 1
            while b > a and s[b - 1] == " ":
                b -= 1
            if a < b:
                self.starts.append(a)
                self.ends.append(b)
                self.quoted.append(q)
                self.seps.append(self.kind(sep))
            elif self.seps:
                self.seps[-1] = "H"
        if self.seps:
            self.seps.pop()

    @staticmethod
    def kind(sep: str) -> str:
        """H hard, C comma, A and, B comma and and, M &, / slash, S space."""
        t = sep.strip(" ")
        if any(c in HARD for c in t) or t.count(",") > 1:
            return "H"
        if not t:
            return "S"
        if t == "&":
            return "M"
        if t == "/":
            return "/"
        if t == ",":
            return "C"
        return "B" if t.startswith(",") else "A"

    def value(self, i: int, j: int) -> str:
        return self.text[self.starts[i] : self.ends[j]]


class Model:
    """Log chances of borders by class of separator and of values by shape; bounded in size, so it may be broadcast."""

    def __init__(self, shapes: dict[str, float], borders: dict[str, tuple[float, float]]):
        total = sum(shapes.values()) + 1.0
        self.shapes = {k: math.log(v / total) for k, v in shapes.items() if v > total * MIN_SHARE}
        self.floor = math.log(1e-6)
        self.borders, self.inner = {}, {}
        for k in "HCABM/S":
            yes, all_ = borders.get(k, (0.0, 0.0))
            p = (yes + 2.0) / (all_ + 2.5)
            self.borders[k], self.inner[k] = math.log(p), math.log(max(1 - p, 1e-6))
        self.borders["H"], self.inner["H"] = 0.0, -1e9

    def score(self, value: str) -> float:
        return self.shapes.get(shape(value), self.floor)


def _spans(lat: Lattice, score, model: Model, most: int | None = None) -> Iterator[list[tuple[int, float]]]:
    """For each atom, the values that end there: (first atom, log weight).

    With ``most``, values have at most so many atoms. Without, they may have any number: one is left out only where it
    can't be part of a split worth a thought, as its inner separators alone weigh less, by FAR, than the same atoms apart."""
    apart: list[float] = []  # weight of each atom as a value of its own, with the border before it
    total = 0.0
    for j in range(len(lat.starts)):
        row, inside, least = [], 0.0, 0.0
        for i in range(j, -1 if most is None else max(-1, j - most), -1):
            border = model.borders[lat.seps[i - 1]] if i else 0.0
            if i < j:
                if lat.seps[i] == "H" or lat.quoted[i] or lat.quoted[j]:
                    break
                inside += model.inner[lat.seps[i]]
                least += apart[i]
                if most is None and inside + border < least - FAR:
                    if inside < total - FAR:  # nor can any that begins before
                        break
                    continue
            w = -1.0 if lat.quoted[i] else score(lat.value(i, j))
            if i == j:
                apart.append(min(w + border, 0.0))
                total += apart[j]
                least = apart[j]
            row.append((i, w + inside + border))
        yield row


def _lse(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def _counted(lat: Lattice, score, model: Model, count: int) -> tuple[list[tuple[int, int]], float] | None:
    """The likeliest split into ``count`` values and the share of the weight that others into so many have; None where
    there is none. States are (atom, number of values): of those numbers only, from which ``count`` can be reached, one
    vector an atom, maxima and sums side by side; so a field of any length is searched whole."""
    n = len(lat.starts)
    # stretches that no value goes beyond: how many begin before an atom, and how many hold atoms from it on
    begins = [not j or lat.seps[j - 1] == "H" or lat.quoted[j - 1] or lat.quoted[j] for j in range(n)]
    before = np.concatenate([[0], np.cumsum(begins)])
    all_ = int(before[n])
    at = np.arange(n + 1)
    rest = all_ - before + np.append(~np.array(begins), False)
    low, high = np.maximum(before, count - (n - at)), np.minimum(at, count - rest)
    if low[n] > high[n] or low[0] > high[0]:
        return None
    low, high = low.tolist(), high.tolist()
    top, sums, back = [np.zeros(1)], [np.zeros(1)], [np.zeros(0, np.int32)]
    # of n atoms in ``count`` values none has more than n - count + 1
    for j, row in enumerate(_spans(lat, score, model, n - count + 1), 1):
        wide = max(0, high[j] - low[j] + 1)
        t, s, b = np.full(wide, -np.inf), np.full(wide, -np.inf), np.full(wide, -1, np.int32)
        for i, w in row:
            first, last = max(low[i] + 1, low[j]), min(high[i] + 1, high[j])
            if first > last:
                continue
            here, there = slice(first - low[j], last - low[j] + 1), slice(first - 1 - low[i], last - low[i])
            x = top[i][there] + w
            b[here][x > t[here]] = i
            np.maximum(t[here], x, out=t[here])
            s[here] = np.logaddexp(s[here], sums[i][there] + w)
        top.append(t)
        sums.append(s)
        back.append(b)
    cuts, j, k = [], n, count
    while j > 0:
        i = int(back[j][k - low[j]])
        if i < 0:
            return None
        cuts.append((i, j - 1))
        j, k = i, k - 1
    return cuts[::-1], max(0.0, 1 - math.exp(float(top[n][count - low[n]] - sums[n][count - low[n]])))


def best(lat: Lattice, score, model: Model, count: int | None) -> tuple[list[tuple[int, int]], float]:
    """The likeliest split (into ``count`` values where one exists), and the share of the weight that others have."""
    n = len(lat.starts)
    if not n:
        return [], 0.0
    if count == n:
        return [(i, i) for i in range(n)], 0.0
    counted = count is not None and 0 < count <= n
    if counted and (got := _counted(lat, score, model, count)) is not None:
        return got
    spans = list(_spans(lat, score, model, n - count + 1 if counted else None))
    if all(len(r) == 1 for r in spans):
        return [(i, i) for i in range(n)], 0.0
    v, back, tot = [0.0], [-1], [0.0]
    for j in range(n):
        opts = [(v[i] + w, i) for i, w in spans[j]]
        m = max(opts)
        v.append(m[0])
        back.append(m[1])
        tot.append(_lse([tot[i] + w for i, w in spans[j]]))
    cuts, j = [], n
    while j > 0:
        cuts.append((back[j], j - 1))
        j = back[j]
    return cuts[::-1], max(0.0, 1 - math.exp(v[n] - tot[n]))


def _isolated(lat: Lattice) -> Iterator[tuple[int, int]]:
    """Values that quotes or hard separators isolate on both sides, where a soft separator isn't inside unless quoted."""
    n = len(lat.starts)
    for i in range(n):
        left = i == 0 or lat.seps[i - 1] == "H" or lat.quoted[i]
        right = i == n - 1 or lat.seps[i] == "H" or lat.quoted[i]
        if left and right:
            yield i, i


def _stats(pdfs: Iterator[pd.DataFrame], spaces: bool, model: Model | None) -> Iterator[pd.DataFrame]:
    """Expected counts of one round: kind 's' shapes and 'b'/'a' borders and all separators by class."""
    for pdf in pdfs:
        acc: dict[tuple[str, str], float] = defaultdict(float)
        for text, count in zip(pdf["text"], pdf["n"], strict=True):
            lat = Lattice(text, spaces)
            if model is None:
                for i in range(len(lat.starts)):  # a little for every atom, so that columns without isolated values begin somewhere
                    acc["s", shape(lat.value(i, i))] += ATOM
                for i, j in _isolated(lat):
                    v = lat.value(i, j)
                    acc["s", shape(v)] += 1
                    if len(lat.starts) > 1 or lat.quoted[0]:  # else the whole field is one stretch, which tells nothing
                        acc["spaced" if " " in v else "solid", ""] += 1
                continue
            cuts, other = best(lat, model.score, model, None if count is None or math.isnan(count) else int(count))
            w = 1.0 - other
            ends = {j for _, j in cuts}
            for i, j in cuts:
                acc["s", shape(lat.value(i, j))] += w
            for k, c in enumerate(lat.seps):
                acc["a", c] += w
                if k in ends:
                    acc["b", c] += w
        yield pd.DataFrame([(a, b, c) for (a, b), c in acc.items()], columns=["kind", "name", "w"])


def _gather(rows: DataFrame, spaces: bool, model: Model | None) -> tuple[dict, dict, dict]:
    got = rows.mapInPandas(lambda it: _stats(it, spaces, model), "kind string, name string, w double").groupBy("kind", "name").agg(F.sum("w").alias("w"))
    # at most 1/MIN_SHARE shapes can have more than that share; the rest would get the floor anyway
    got = got.orderBy(F.desc("w"), "kind", "name").limit(int(1 / MIN_SHARE) + 16).collect()
    shapes = {r.name: r.w for r in got if r.kind == "s"}
    yes, all_ = ({r.name: r.w for r in got if r.kind == k} for k in "ba")
    kinds = {r.kind: r.w for r in got if r.kind in ("spaced", "solid")}
    return shapes, {k: (yes.get(k, 0.0), v) for k, v in all_.items()}, kinds


def learn(rows: DataFrame, rounds: int = 2) -> tuple[Model, bool]:
    """The column's model after some rounds of expectation-maximisation over all its rows, and whether spaces part
    values. rows: (text, n)."""
    shapes, _, kinds = _gather(rows, False, None)
    spaces = kinds.get("solid", 0) > 5 * kinds.get("spaced", 0)
    model = Model(shapes, {"C": (8.0, 10.0), "A": (8.0, 10.0), "B": (9.0, 10.0), "M": (9.0, 10.0), "/": (9.0, 10.0), "S": (10.0, 10.0)})
    for _ in range(rounds):
        shapes, borders, _ = _gather(rows, spaces, model)
        model = Model(shapes, borders)
    return model, spaces


def _first(pdfs: Iterator[pd.DataFrame], spaces: bool, model: Model) -> Iterator[pd.DataFrame]:
    """Per row: the best split, and for rows in doubt the candidate values."""
    for pdf in pdfs:
        items, cands = [], []
        for text, count in zip(pdf["text"], pdf["n"], strict=True):
            lat = Lattice(text, spaces)
            cuts, other = best(lat, model.score, model, None if count is None or math.isnan(count) else int(count))
            items.append([lat.value(i, j) for i, j in cuts])
            cands.append(list({lat.value(i, j) for j, r in enumerate(_spans(lat, model.score, model)) for i, _ in r}) if other > DOUBT else None)
        yield pd.DataFrame({"rid": pdf["rid"], "text": pdf["text"], "n": pdf["n"], "items": items, "cands": cands})


def _second(pdfs: Iterator[pd.DataFrame], spaces: bool, model: Model, total: float) -> Iterator[pd.DataFrame]:
    """Rows in doubt again, with the frequencies of their candidates."""
    for pdf in pdfs:
        items = []
        for text, count, vs, cs in zip(pdf["text"], pdf["n"], pdf["vs"], pdf["cs"], strict=True):
            freq = dict(zip(vs, cs, strict=True)) if vs is not None else {}
            lat = Lattice(text, spaces)

            def score(v: str, freq=freq) -> float:
                base = math.exp(model.score(v))
                # a value's own frequency, smoothed towards the frequency of its shape
                return math.log(0.5 * freq.get(v, 0.0) / total * 1e3 + 0.5 * base + _EPS)

            cuts, _ = best(lat, score, model, None if count is None or math.isnan(count) else int(count))
            items.append([lat.value(i, j) for i, j in cuts])
        yield pd.DataFrame({"rid": pdf["rid"], "items": items})


def segment(rows: DataFrame, rounds: int = 2) -> DataFrame:
    """rows(rid, text, n) → (rid, items array<string>). rid is unique; n is the known number of values or NULL.

    NULL, empty and 'None' texts have no values and give no row."""
    rows = rows.select("rid", clean("text").alias("text"), F.col("n").cast("double").alias("n")).filter("text is not null")
    model, spaces = learn(rows.select("text", "n"), rounds)
    one = cut(
        rows.mapInPandas(lambda it: _first(it, spaces, model), "rid string, text string, n double, items array<string>, cands array<string>"), "split"
    )
    sure = one.filter("cands is null").select("rid", "items")
    doubt = one.filter("cands is not null")
    freq = one.select(F.explode("items").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    total = float(one.agg(F.sum(F.size("items"))).first()[0] or 1)
    wanted = doubt.select("rid", F.explode("cands").alias("v"))
    known = wanted.join(freq, "v").groupBy("rid").agg(F.collect_list(F.struct("v", "c")).alias("vc"))
    again = doubt.drop("items", "cands").join(known, "rid", "left").select("rid", "text", "n", F.col("vc.v").alias("vs"), F.col("vc.c").alias("cs"))
    return sure.unionByName(again.mapInPandas(lambda it: _second(it, spaces, model, total), "rid string, items array<string>"))


def unpack(df: DataFrame, key: str, field: str, count_hint: DataFrame | None = None, rounds: int = 2) -> DataFrame:
    """(key, pos int, item string): the values of a packed column. Rows of df that repeat key and text count once.

    count_hint: (key, n) with the number of values where another column tells it. NULL keys are kept as a key."""
    own = df.select(F.col(key).alias("__k"), F.col(field).alias("text")).filter(clean("text").isNotNull()).distinct()
    own = own.withColumn("n", F.lit(None).cast("double"))
    if count_hint is not None:
        own = own.drop("n").join(count_hint.select(F.col(key).alias("__k"), F.col("n").cast("double")), "__k", "left")
    # the key and a hash of the text identify a row: deliveries that differ in their text are rows of their own
    rid = F.concat_ws(":", F.coalesce(F.col("__k").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))
    out = segment(own.select(rid.alias("rid"), "text", "n"), rounds)
    kind = df.schema[key].dataType
    return out.select(
        F.nullif(F.substring_index("rid", ":", 1), F.lit("")).cast(kind).alias(key), F.posexplode("items").alias("pos", "item")
    ).select(key, (F.col("pos") + 1).cast("int").alias("pos"), "item")


def unpack_papers(papers: DataFrame) -> DataFrame:
    """(paper_id, src_field, pos, item) of the three packed columns of papers; distinct.

    Where author_ids has values, authors has as many."""
    ids = cut(unpack(papers, "paper_id", "author_ids"), "ids")
    n = ids.groupBy("paper_id").agg(F.max("pos").alias("n"))
    parts = {"cites": unpack(papers, "paper_id", "cites"), "author_ids": ids, "authors": unpack(papers, "paper_id", "authors", n)}
    out = None
    for name, d in parts.items():
        d = d.select("paper_id", F.lit(name).alias("src_field"), "pos", "item")
        out = d if out is None else out.unionByName(d)
    return out.distinct()
