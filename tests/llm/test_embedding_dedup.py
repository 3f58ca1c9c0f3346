"""Links of vectors whose lengths differ and whose mean is far from the origin."""

import numpy as np
import pytest

from spheretiles.llm import embedding_dedup

from . import brute


@pytest.mark.parametrize("off", [0.3, 1.0])
def test_links_follow_the_cosine_alone(spark, off):
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(unit(rng.normal(size=(300, 64))) + off * unit(rng.normal(size=(1, 64))))
    side = rng.normal(size=x.shape)
    side = unit(side - (side * x).sum(axis=1)[:, None] * x)
    x = x * rng.lognormal(0, 1.5, size=(300, 1))
    near = 0.935 * unit(x) + np.sqrt(1 - 0.935**2) * side
    data = [(i, [float(c) for c in v], "a") for i, v in enumerate(np.concatenate([x, near, 10 * x]))]
    links = brute.embedding_links(data)
    degree = np.bincount(np.array(links).reshape(-1), minlength=900)
    comp = brute.components(range(900), links)
    got = embedding_dedup.embedding_links(spark.createDataFrame(data, "vec_id long, embedding array<double>, label string")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (degree[i], comp[i]) for i in range(900)}
