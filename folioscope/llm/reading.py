"""Reading level of each document: smoothed unigram language models per level, and the level of highest posterior.

The models of a language are trained on all its labelled texts. Levels of a language without labels are seeded by a
formula over all its documents: the share of long words and the length of sentences (LIX), cut at the points that lie
between the levels of the labelled texts. Words are counted by language and level in Spark; what reaches the driver are the
counts of the ``VOCABULARY`` most frequent words of each language. Every document is scored, by its whole running text:
lines that hold no sentence (headings, code, references, keywords) count only where a document has nothing else.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.common import cut

LEVELS = (1, 2, 3, 4, 5)
#: Words a language that its models know one by one; all others share one chance. A bound on what reaches the driver.
VOCABULARY = 60_000
#: Parts that a language's words are ranked in before the best of each are ranked together.
PARTS = 16
#: Models are held whole by every task: more languages than this are refused, none is left out.
MOST_LANGUAGES = 200
#: Fewest labelled texts of a level that a model is trained on without seeds.
FEWEST = 2
SMOOTHING = 0.1
#: LIX between the levels, for corpora without any label.
LIX_CUTS = (22.0, 38.0, 52.0, 68.0)
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ENDS = re.compile(r"[.!?]+(?:\s|$)")
#: A word of running text with its punctuation, or a number; what begins a line of keywords; what only code holds.
_PLAIN = re.compile(r"[(\"“‘'\[]*(?:[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,]\d+)*)[)\]\"”’'.,;:!?…]*")
_LABEL = re.compile(r"\s*(?:key\s?words|index terms|schlagw\w+|mots[- ]cl\w+|palabras clave|palavras-chave)\b", re.I)
_CODE = re.compile(r"[{}|=<>]|\w\(|^\s*[$#]")
#: Fewest words of a line that is prose without a sentence's end as its last sign, and least share of plain words in it.
PROSE, MOSTLY = 8, 0.8


def _is_prose(line: str) -> bool:
    """A short line is prose as a closed sentence; a longer one also where it is cut off or ends in another sign."""
    if line.rstrip()[-1:] in (".", "!", "?", "”", '"') and line.count(" ") >= 3:
        return True
    ws = line.split()
    if len(ws) < PROSE or _LABEL.match(line):
        return False
    if len(ws) < 3 * PROSE and _CODE.search(line):
        return False
    return sum(bool(_PLAIN.fullmatch(w)) for w in ws) >= MOSTLY * len(ws)


def running_text(text: str) -> str:
    """The lines that hold sentences or other running prose, whole; all lines where none does."""
    if "\n" not in text:
        return text
    kept = [x for x in text.split("\n") if _is_prose(x)]
    return "\n".join(kept) if kept else text


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(running_text(text).lower()) if text else []


def lix(text: str) -> float | None:
    """Words a sentence plus percent of words longer than six letters; None without words."""
    t = running_text(text)
    ws = _WORDS.findall(t)
    if not ws:
        return None
    return len(ws) / max(1, len(_ENDS.findall(t))) + 100.0 * sum(len(w) > 6 for w in ws) / len(ws)


@dataclass
class Model:
    """Log probabilities of the words of one language at each level; at most VOCABULARY rows."""

    index: dict[str, int]
    logs: np.ndarray  # words x levels
    other: np.ndarray  # a word that isn't among them
    prior: np.ndarray

    def posterior(self, words: list[str]) -> np.ndarray:
        c = Counter(words)
        ids = [self.index.get(w, -1) for w in c]
        n = np.fromiter(c.values(), float, len(c))
        ids = np.array(ids, dtype=np.int64)
        known = ids >= 0
        score = self.prior + n[known] @ self.logs[ids[known]] + n[~known].sum() * self.other
        score = np.exp(score - score.max())
        return score / score.sum()


def model_of(words: list[tuple[str, list[float]]], totals: list[float], docs: list[float]) -> Model:
    """words: (word, its count at each level); totals: all words of each level; docs: texts of each level."""
    size = len(words) + 1
    sums = np.array(totals) + SMOOTHING * size
    logs = np.log((np.array([c for _, c in words], dtype=float).reshape(len(words), len(LEVELS)) + SMOOTHING) / sums)
    n = np.array(docs, dtype=float)
    prior = np.where(n > 0, np.log((n + 1) / (n.sum() + len(LEVELS))), -1e9)
    return Model({w: i for i, (w, _) in enumerate(words)}, logs, np.log(SMOOTHING / sums), prior)


def cuts_of(medians: dict[int, float]) -> tuple[float, ...]:
    """Where LIX parts the levels: half-way between the medians of neighbouring levels, else the fixed values."""
    out = []
    for a, b, fixed in zip(LEVELS, LEVELS[1:], LIX_CUTS, strict=False):
        out.append((medians[a] + medians[b]) / 2 if a in medians and b in medians and medians[a] < medians[b] else fixed)
    return tuple(float(x) for x in np.maximum.accumulate(out))


def level_of(x: float, cuts: tuple[float, ...]) -> int:
    return 1 + sum(x > c for c in cuts)


COUNTS = "kind string, lang string, level int, word string, n double"


def _count(pdfs: Iterator[pd.DataFrame], cuts: tuple[float, ...] | None, wanted: set[tuple[str, int]] | None) -> Iterator[pd.DataFrame]:
    """COUNTS of texts: 'w' words, 'd' documents, 'l' the LIX of one document. Without a level (cuts given) LIX tells it,
    and only ``wanted`` (language, level) count."""
    for pdf in pdfs:
        words: Counter[tuple[str, int, str]] = Counter()
        docs: Counter[tuple[str, int]] = Counter()
        out = []
        for text, lang, level in zip(pdf["text"], pdf["lang"], pdf["level"], strict=True):
            x = lix(text)
            if x is None:
                continue
            k = level_of(x, cuts) if cuts is not None else int(level)
            if wanted is not None and (lang, k) not in wanted:
                continue
            if cuts is None:
                out.append(("l", lang, k, None, x))
            docs[lang, k] += 1
            for w, n in Counter(words_of(text)).items():
                words[lang, k, w] += n
        out += [("d", lang, k, None, float(n)) for (lang, k), n in docs.items()]
        out += [("w", lang, k, w, float(n)) for (lang, k, w), n in words.items()]
        yield pd.DataFrame(out, columns=["kind", "lang", "level", "word", "n"])


def fit(documents: DataFrame, labels: DataFrame, languages: list[str] | None = None) -> dict[str, Model]:
    """Models by language; 'und' stands for NULL and all other languages.

    Labels of absent documents, levels outside 1 to 5 and NULL texts are left out; of several labels of a document the
    median counts (the lower of two)."""
    own = languages or ["en"]
    lang = F.when(F.col("lang").isin(*own), F.col("lang")).otherwise("und").alias("lang")
    documents = documents.filter("text is not null").select("doc_id", "text", lang)
    ok = labels.filter(F.col("reading_level").between(1, 5)).groupBy("doc_id").agg(F.expr("percentile_disc(0.5) within group (order by reading_level)").cast("int").alias("level"))
    labelled = documents.join(ok, "doc_id").dropDuplicates(["doc_id"]).select("text", "lang", "level")
    counts = cut(labelled.mapInPandas(lambda it: _count(it, None, None), COUNTS), "counts")
    cuts = cuts_of({r.level: r.x for r in counts.filter("kind = 'l'").groupBy("level").agg(F.median("n").alias("x")).collect()})
    have = {(r.lang, r.level): r.n for r in counts.filter("kind = 'd'").groupBy("lang", "level").agg(F.sum("n").alias("n")).collect()}
    seeded = {(x, k) for x in own for k in LEVELS if have.get((x, k), 0) < FEWEST}
    if seeded:
        seeds = documents.filter(F.col("lang").isin(*{x for x, _ in seeded})).select("text", "lang", F.lit(0).alias("level"))
        counts = cut(counts.unionByName(seeds.mapInPandas(lambda it: _count(it, cuts, seeded), COUNTS)), "counts")
    sums: dict[tuple[str, str, int], float] = {(r.kind, r.lang, r.level): r.n for r in counts.groupBy("kind", "lang", "level").agg(F.sum("n").alias("n")).collect()}
    at = [F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0.0)).alias(f"n{k}") for k in LEVELS]
    by_word = counts.filter("kind = 'w'").groupBy("lang", "word").agg(F.sum("n").alias("n"), *at)
    order = [F.desc("n"), F.asc("word")]
    for part in ([F.col("lang"), F.pmod(F.xxhash64("word"), F.lit(PARTS))], [F.col("lang")]):
        by_word = by_word.withColumn("k", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("k") <= VOCABULARY)
    words: dict[str, list[tuple[str, list[float]]]] = {}
    for r in by_word.select("lang", "word", *[f"n{k}" for k in LEVELS]).toLocalIterator():
        words.setdefault(r.lang, []).append((r.word, [r[f"n{k}"] for k in LEVELS]))
    return {x: model_of(sorted(words.get(x, [])), [sums.get(("w", x, k), 0.0) for k in LEVELS], [sums.get(("d", x, k), 0.0) for k in LEVELS]) for x in own}


def _score(pdfs: Iterator[pd.DataFrame], models: dict[str, Model]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        levels, sure = [], []
        for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
            p = (models.get(lang) or models.get("und") or models["en"]).posterior(words_of(text))
            k = int(p.argmax())
            levels.append(LEVELS[k])
            sure.append(float(p[k]))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "reading_level": levels, "posterior": sure})


def assign(documents: DataFrame, models: dict[str, Model]) -> DataFrame:
    """(doc_id, reading_level int, posterior double), one row a document.

    Texts without a word (NULL, empty, only signs) get the level of highest prior; ties go to the lower level."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return rows.mapInPandas(lambda it: _score(it, models), "doc_id long, reading_level int, posterior double")


def levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its level, each language by its own models."""
    langs = sorted(r[0] for r in documents.filter("lang is not null").select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return assign(documents, fit(documents, labels, [x for x in langs if x != "und"] + ["und"]))


def english_levels(documents: DataFrame, labels: DataFrame, fewest_words: int = 60) -> DataFrame:
    """English documents of at least so many words with their level."""
    spaced = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    own = documents.filter((F.col("lang") == "en") & (spaced >= fewest_words))
    return assign(own, fit(documents, labels)).select("doc_id", "reading_level")
