"""A labelled id counts once in the fit, however often its document stands."""

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import toxicity


def test_repeated_documents_of_one_label_count_once(spark):
    rows = [(i, f"nasty vile words number{i}" if i % 2 else f"plain kind words number{i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    own = docs.where("doc_id = 0").select(F.xxhash64("text").alias("h")).first().h
    more = spark.range(600).select(F.lit(0).cast("long").alias("doc_id"), F.concat(F.lit("nasty vile kind text "), "id").alias("text"))
    once, often = toxicity.fit(docs, labels), toxicity.fit(docs.union(more.where(F.xxhash64("text") > own)), labels)
    assert once.index and once.index == often.index
    assert np.allclose(once.weights, often.weights) and np.allclose(once.cuts, often.cuts)
