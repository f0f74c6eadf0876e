"""Baselines: character n-gram TF-IDF with linear classifiers of Spark ML."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StringIndexer
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def char_ngrams(text: Column, low: int = 1, high: int = 3) -> Column:
    """Lower-cased character n-grams, white space as single spaces."""
    t = F.lower(F.regexp_replace(text, r"(?U)\s\s+", " "))
    grams = [F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i, n=n: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
    return F.concat(*grams)


class TfIdf:
    """1 + ln(tf) times ln((1 + n) / (1 + df)) + 1, rows of length 1, over the ``most`` frequent n-grams of train alone."""

    def __init__(self, most: int = 60_000):
        self.most = most

    def fit(self, train: DataFrame, text: str = "text") -> TfIdf:
        self.text = text
        grams = train.select(char_ngrams(F.col(text)).alias("_grams"))
        self.counter = CountVectorizer(inputCol="_grams", outputCol="_counts", vocabSize=self.most).fit(grams)
        n = train.count()
        df = np.asarray(IDF(inputCol="_counts", outputCol="_x").fit(self.counter.transform(grams)).docFreq, dtype=float)
        self.idf = np.log((1 + n) / (1 + df)) + 1
        return self

    @property
    def vocabulary(self) -> list[str]:
        return self.counter.vocabulary

    def transform(self, rows: DataFrame) -> DataFrame:
        idf = rows.sparkSession.sparkContext.broadcast(self.idf)  # one number for each of at most ``most`` terms

        @F.udf(VectorUDT())
        def weigh(v):
            return SparseVector(v.size, v.indices, (1 + np.log(v.values)) * idf.value[v.indices])

        counted = self.counter.transform(rows.withColumn("_grams", char_ngrams(F.col(self.text))))
        weighted = counted.withColumn("_weighted", weigh("_counts"))
        return Normalizer(inputCol="_weighted", outputCol="features", p=2.0).transform(weighted).drop("_grams", "_counts", "_weighted")


def train_linear(train: DataFrame, kind: str = "logistic", label: str = "label"):
    """A pipeline of TF-IDF and a linear classifier with balanced classes: rows → label_id, probabilities p (by sorted labels), predicted."""
    features = TfIdf().fit(train)
    index = StringIndexer(inputCol=label, outputCol="label_id", stringOrderType="alphabetAsc").fit(train)
    labels = list(index.labels)
    sizes = train.groupBy(label).agg(F.count("*").alias("_c"))
    n = train.count()
    rows = index.transform(features.transform(train)).join(F.broadcast(sizes), label).withColumn("weight", F.lit(n) / (F.lit(len(labels)) * F.col("_c")))
    if kind == "logistic":
        model = LogisticRegression(featuresCol="features", labelCol="label_id", weightCol="weight", maxIter=500, regParam=1.0 / n, family="multinomial").fit(rows)
    elif kind == "linear_svm":
        model = OneVsRest(classifier=LinearSVC(maxIter=200, regParam=1.0 / n), featuresCol="features", labelCol="label_id", weightCol="weight").fit(rows)
    else:
        raise ValueError("kinds are logistic and linear_svm")

    def predict(texts: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        from textquarry.functions.stats import softmax

        found = model.transform(features.transform(texts))
        p = vector_to_array("probability") if kind == "logistic" else softmax(vector_to_array("rawPrediction"))
        return found.withColumn("p", p).withColumn("predicted", F.element_at(F.array(*map(F.lit, labels)), F.col("prediction").cast("int") + 1)).drop("features", "rawPrediction", "probability", "prediction")

    return predict, labels
