"""Operator 4: the reach comes from all vectors, also where few of them differ from the others."""

import numpy as np
from pyspark.sql import functions as F

from letterloom.llm import embeddings


def test_reach_is_learned_from_every_vector(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    first = embeddings.needs

    def counting(a, *rest):
        seen.add(len(a))
        return first(a, *rest)

    monkeypatch.setattr(embeddings, "needs", counting)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((25_000, 8))
    rows = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "class_key string, embedding array<double>").repartition(4)
    reach = embeddings.learned_reaches(rows, 0.9)
    assert seen.value == 25_000 and set(reach) == {8}
    assert abs(reach[8] - embeddings.choose_reach(x, 0.9)) < 0.01


def test_lengths_have_reaches_of_their_own(spark):
    rng = np.random.default_rng(4)
    rows = [(f"{d}-{i}", rng.standard_normal(d).tolist()) for d in (1, 3, 20) for i in range(50)]
    frame = spark.createDataFrame(rows, "class_key string, embedding array<double>")
    reach = embeddings.learned_reaches(frame, 0.9)
    assert set(reach) == {1, 3, 20} and reach[1] == 0.0 and 0 < reach[3] <= 0.2 + 1e-5
    assert reach == embeddings.learned_reaches(frame.repartition(7).orderBy(F.desc("class_key")), 0.9)  # however rows lie
    assert embeddings.learned_reaches(frame.limit(0), 0.9) == {}
