"""Rows that share a vec_id are queries and candidates of their own."""

from collections import defaultdict

import numpy as np
import pytest

from reprise.llm import search


@pytest.mark.parametrize("exact", [True, False])
def test_rows_with_one_id(spark, exact):
    draw = np.random.default_rng(3)
    v = draw.normal(size=(200, 8))
    ids = [*range(200), 100, 100, 60, 7]
    v = np.concatenate([v, v[[100]], draw.normal(size=(1, 8)), v[[60]], v[[60]]]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), "a") for i, x in zip(ids, v)], "vec_id long, embedding array<float>, row string").repartition(3)
    every, k = (50, 5) if exact else (20, 6)
    got = defaultdict(list)
    for r in (search.exact_top_k(df, k, every, per_block=70) if exact else search.nearest(df, k, every, sure=1 - 1e-12, per_block=70)).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], round(r["score"], 9)))
    w = np.floor(256 * v.astype(np.float64)) if exact else v.astype(np.float64)
    want = defaultdict(list)
    for at, i in enumerate(ids):
        if i % every == 0:
            order = sorted((j for j in range(len(ids)) if j != at), key=lambda j: (-round(float(w[at] @ w[j]), 9), ids[j]))[:k]
            want[i] += [(n + 1, ids[j], round(float(w[at] @ w[j]), 9)) for n, j in enumerate(order)]
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
