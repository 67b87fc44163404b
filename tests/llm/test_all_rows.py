"""Models are learnt from all labelled rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollsift.llm import toxicity


@pytest.fixture()
def marked(spark):
    """Each of twenty words marks a few toxic texts."""
    filler = F.concat_ws(" ", *[F.concat(F.lit("p"), (F.xxhash64("doc_id", F.lit(k)) % 40).cast("string")) for k in range(12)])
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, F.concat(filler, F.lit(" mark"), (F.floor(F.col("id") / 2) % 20).cast("string"))).otherwise(filler).alias("text"), F.lit("en").alias("lang"))
    return docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))


def test_toxicity_learns_from_every_labelled_row(marked, monkeypatch):
    docs, known = marked
    monkeypatch.setattr(toxicity, "SAMPLE_A_CLASS", 20)
    net = toxicity.fit(docs, known)
    words, _ = toxicity.word_ids(pa.array([" ".join(f"mark{i}" for i in range(20))]))
    assert np.isin(words[:, 0], net.keys).all()


def test_toxicity_of_many_trainers(spark, marked, monkeypatch):
    """Several trainers tell the classes apart, and how rows lie in partitions doesn't show."""
    docs, known = marked
    monkeypatch.setattr(toxicity, "ROWS_A_TRAINER", 200)
    nets = [toxicity.fit(docs.repartition(n), known) for n in (1, 7)]
    ids, counts = toxicity.word_ids(pa.array([r["text"] for r in docs.orderBy("doc_id").select("text").collect()]))
    scores = [net.score(ids, counts) for net in nets]
    assert np.mean((scores[0] >= 0.5) == np.arange(1200) % 2) > 0.97
    assert (scores[0] == scores[1]).all()
