"""Comparison of pre-processors and classifiers: every fold, what they share is fitted once."""

import random

import pytest
from pyspark.ml.feature import Word2Vec
from pyspark.sql import functions as F

from folioscope import common
from folioscope.operators import ml
from folioscope.operators.text import words
from folioscope.plans import extra


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        grp = "abc"[i % 3]
        rows.append((i, grp, " ".join([f"about{grp}"] * 3 + [f"word{rng.randrange(30)}" for _ in range(8)])))
    return spark.createDataFrame([*rows, (60, None, "no label"), (61, "a", None), (62, "b", "")], "id long, grp string, text string").cache()


def test_every_fold_is_held_out_and_what_is_shared_is_fitted_once(docs, monkeypatch):
    fits, fit = [], Word2Vec._fit
    monkeypatch.setattr(Word2Vec, "_fit", lambda self, x: (fits.append(self.getVectorSize()), fit(self, x))[1])
    cuts = len(common._CUTS)
    pres, names = ("tfidf", "vec64", "vec64_counts"), ("DecTree", "NB")
    got = ml.compared(docs, "text", "grp", "id", k=3, pres=pres, names=names, features=20).collect()
    assert sorted((r.pre, r.classifier, r.fold) for r in got) == sorted((p, n, f) for p in pres for n in names for f in (1, 2, 3) if not (n == "NB" and p != "tfidf"))
    assert fits == [64] * 3  # before: once for vec64 and once more for vec64_counts
    assert len(common._CUTS) <= cuts + 1  # the folds; before: every vector stayed
    assert all(r.accuracy > 0.9 for r in got if r.pre == "tfidf" and r.classifier == "DecTree")


def test_venue_prediction_holds_out_all_five_folds(spark, sf, monkeypatch):
    got, compared = [], ml.compared

    def small(*args, **kw):
        got.append(compared(*args, **kw, pres=("tfidf",), names=("NB",)))
        return got[0]

    monkeypatch.setattr(ml, "compared", small)
    assert extra.venue_prediction(spark, sf).count() == 1
    assert sorted(r.fold for r in got[0].collect()) == [1, 2, 3, 4, 5]  # before: only the first


def test_nothing_to_compare(spark, docs):
    assert ml.compared(docs.filter("grp is null"), "text", "grp", "id").count() == 0
    assert ml.compared(docs.filter("id = 0"), "text", "grp", "id").count() == 0  # nothing is left to fit


def test_vocabularies_of_all_folds_in_one_pass(docs):
    d = ml.stratified_folds(docs.filter("grp is not null and text is not null").select("id", "grp", words(F.col("text")).alias("words")), "grp", "id", 3).cache()
    n = {f: d.filter(F.col("fold") != f).count() for f in (1, 3)}
    got = ml.mean_tfidf_vocabularies(d, "id", "words", n, 12)
    assert got == {f: ml.mean_tfidf_vocabulary(d.filter(F.col("fold") != f), "id", "words", 12) for f in n}


def test_rates_are_those_of_weighted_metrics(spark):
    rng = random.Random(3)
    rows = [(float(rng.randrange(4)), float(rng.choice([0, 1, 2, 5]))) for _ in range(300)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    want = ml.weighted_metrics(df, "label", "prediction").first()
    assert ml.rates(df.groupBy("label", "prediction").count().collect()) == pytest.approx(tuple(want), abs=2e-6)
    assert ml.rates([]) == (None,) * 4
