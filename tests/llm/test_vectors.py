"""Nearest neighbours against all cosines."""

import numpy as np
import pandas as pd
import pytest

from shelfmark.llm import collisions

KIND = "vec_id long, embedding array<float>, score string"


def exact(ids, vectors, queries, k=5):
    out = {}
    for q in queries:
        score = collisions.cosine(vectors[ids.index(q)], vectors)
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-score[i], ids[i]))[:k]
        out[q] = [ids[i] for i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("rows", [8192, 300])
def test_recall(spark, monkeypatch, rows):
    monkeypatch.setattr(collisions, "BLOCK_ROWS", rows)
    monkeypatch.setattr(collisions, "QUERY_ROWS", 7)
    table = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = found(collisions.neighbours(spark.createDataFrame(table[["vec_id", "embedding"]])))
    ids = table.vec_id.tolist()
    want = exact(ids, np.stack(table.embedding).astype(float), [i for i in ids if i % 50 == 0])
    assert got.keys() == want.keys() and all(len(got[q]) == 5 for q in got)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.97 * 5 * len(want)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, [3e38, 3e38]), (1, [2.0, 0.0]), (2, [5.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [None, 1.0]), (7, [-1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 1.0]), (1, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], KIND)
    got = found(collisions.neighbours(df))
    assert got == {0: [1, 2, 100, 7], 100: [0, 1, 2, 7]}


def test_no_vectors(spark):
    assert collisions.neighbours(spark.createDataFrame([], KIND)).count() == 0
