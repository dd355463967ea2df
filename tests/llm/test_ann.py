"""Neighbours among vectors that are nearly equal."""

import numpy as np
import pytest
from notelake.llm import ann
from pyspark.sql import functions as F


@pytest.mark.parametrize("noise", [0.1, 0.01, 0.0002])
def test_clusters(spark, noise):
    """Ten clusters of 400 unit vectors each: at least nine in ten of the 20 nearest, for each query nearly so."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 64))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None], 400, axis=0) + noise * rng.normal(size=(4000, 64)) / 8
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("embedding"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    wide, found = x.astype(float), []
    for i in range(0, 4000, 20):
        s = wide @ wide[i]
        s[i] = -np.inf
        best = np.sort(s)[-20]
        assert len(got[i]) == 20 and all(v == pytest.approx(s[j], abs=1e-12) for j, v in got[i].items())
        found.append(sum(s[j] >= best - 1e-12 for j in got[i]) / 20)
    assert np.mean(found) >= 0.9 and min(found) >= 0.5
