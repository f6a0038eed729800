"""Text mining: tokens, smooth TF-IDF, chi-square, co-occurrence, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what a word is.
WORD = r"[\p{L}\p{N}_]{3,}"


def words(text: Column | str) -> Column:
    """Lower-case words of three signs or more, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def term_counts(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf): sparse bag of words in long form."""
    return docs.select(key, F.explode(words(text)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def smooth_idf(counts: DataFrame, key: str, n_docs: int) -> DataFrame:
    """(term, df, idf) with idf = ln((1+n)/(1+df)) + 1."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (1 + F.col("df"))) + 1)


def tf_idf(counts: DataFrame, key: str, n_docs: int) -> DataFrame:
    """(key, term, w): tf·idf scaled to length 1 within each document."""
    x = counts.join(smooth_idf(counts, key, n_docs), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return x.join(norm, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("w"))


def mean_weight(weights: DataFrame, n_docs: int) -> DataFrame:
    """Mean TF-IDF of each term over all documents, absent ones as 0."""
    return weights.groupBy("term").agg((F.sum("w") / n_docs).alias("mean_w"))


def chi2(counts: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(term, chi2) of term counts against class labels: observed counts against those that the class sizes expect."""
    lab = counts.join(labels, key)
    obs = lab.groupBy("term", label).agg(F.sum("tf").alias("o"))
    total = lab.groupBy("term").agg(F.sum("tf").alias("t"))
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("k"))
    n = labels.count()
    prob = F.broadcast(sizes.select(label, (F.col("k") / F.lit(float(n))).alias("p")))  # one row a class
    # classes without the term have o = 0 and add their whole expectation
    with_term = obs.join(total, "term").join(prob, label).withColumn("e", F.col("t") * F.col("p"))
    part = with_term.groupBy("term").agg(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e") - F.col("e")).alias("c"), F.max("t").alias("t"))
    return part.select("term", (F.col("c") + F.col("t")).alias("chi2"))


def cooccurrence(sets: DataFrame, key: str, term: str = "term") -> DataFrame:
    """(i, j, weight): how many documents hold both words, i < j. sets: distinct (key, term) over a bounded vocabulary, so
    that a document adds at most as many pairs as the square of the vocabulary's words in it."""
    x = sets.select(key, F.col(term).alias("i"))
    return x.join(x.select(key, F.col("i").alias("j")), key).filter("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("weight"))


def dominant(doc_topics: DataFrame, key: str = "paper_id") -> DataFrame:
    """The topic of the largest count of each document, the lowest of equals; documents without any count are absent."""
    w = Window.partitionBy(key).orderBy(F.desc("cnt"), "topic")
    return doc_topics.filter("cnt > 0").withColumn("k", F.row_number().over(w)).filter("k = 1").select(key, "topic")


def topic_model(docs: DataFrame, key: str, text: Column, k: int = 11, alpha: float = 0.22359, beta: float = 0.53915, iterations: int = 10, vocabulary: int = 5000, seed: int = 1):
    """(model, vocabulary, transformed): variational LDA over the most frequent words, with stop words left out."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer, StopWordsRemover

    d = docs.select(key, words(text).alias("raw"))
    clean = StopWordsRemover(inputCol="raw", outputCol="words").transform(d)
    cv = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary, minDF=2.0).fit(clean)
    x = cv.transform(clean).select(key, "features")
    model = LDA(k=k, optimizer="online", docConcentration=[alpha] * k, topicConcentration=beta, maxIter=iterations, seed=seed).fit(x)
    return model, cv.vocabulary, model.transform(x)


def top_words(model, vocabulary: list[str], n: int = 10) -> DataFrame:
    """(topic, rank, term, weight) of a fitted topic model."""
    d = model.describeTopics(n).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("r", "x"))
    names = F.array(*[F.lit(w) for w in vocabulary]) if len(vocabulary) <= 200 else None
    if names is None:
        spark = d.sparkSession
        v = spark.createDataFrame(list(enumerate(vocabulary)), "i int, term string")
        return d.join(F.broadcast(v), F.col("x.termIndices") == v.i).select("topic", (F.col("r") + 1).alias("rank"), "term", F.col("x.termWeights").alias("weight"))
    return d.select("topic", (F.col("r") + 1).alias("rank"), F.element_at(names, F.col("x.termIndices") + 1).alias("term"), F.col("x.termWeights").alias("weight"))
