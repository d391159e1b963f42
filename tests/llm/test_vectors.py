"""Embedding links against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylematch.llm import vectors
from stylematch.llm.queries import QUERIES


def sound(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def all_pairs(rows, cosine=0.9):
    """[(id, links, component)] in the order of the rows."""
    kept = [k for k, (_, v) in enumerate(rows) if sound(v)]
    links = {k: set() for k in range(len(rows))}
    for dim in {len(rows[k][1]) for k in kept}:
        own = [k for k in kept if len(rows[k][1]) == dim]
        x = np.array([rows[k][1] for k in own], dtype=np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, near in zip(own, x @ x.T >= cosine):
            links[a] = {own[j] for j in np.flatnonzero(near)} - {a}
    out, root = [], {}
    for k in links:
        if k in root:
            continue
        group, todo = {k}, [k]
        while todo:
            fresh = links[todo.pop()] - group
            group |= fresh
            todo += fresh
        least = min((rows[g][0] for g in group if rows[g][0] is not None), default=None)
        root.update(dict.fromkeys(group, least))
    for k, (i, _) in enumerate(rows):
        out.append((i, len(links[k]), root[k]))
    return out


def told(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)


def table(spark, rows, element="float"):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id long, embedding array<{element}>, cls int, v int")


def families(rng, n, dim, spread):
    """Vectors around few centres at growing distances, so that many cosines are near the threshold."""
    centres = rng.normal(size=(max(1, n // 12), dim))
    out = centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, dim)) * rng.uniform(0, spread, size=(n, 1))
    return [[float(x) for x in v.astype(np.float32)] for v in out]


@pytest.mark.parametrize("tile", [40, 8192])
@pytest.mark.parametrize("dim", [64, 5])
def test_links_of_families(spark, monkeypatch, tile, dim):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "STRIP", 16)
    rng = np.random.default_rng(dim)
    rows = [(i, v) for i, v in enumerate(families(rng, 500, dim, 0.6))]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(200)]
    assert told(vectors.link_vectors(table(spark, rows))) == sorted(all_pairs(rows), key=str)


def test_candidates_outnumber_the_dense_switch(spark, monkeypatch):
    """One large group of near copies: all pairs of a strip are candidates."""
    monkeypatch.setattr(vectors, "TILE", 100)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    rows = [(i, [float(x) for x in (centre + rng.normal(size=64) * 0.22).astype(np.float32)]) for i in range(600)]
    rows += [(600 + i, v) for i, v in enumerate(families(rng, 300, 64, 0.3))]
    want = all_pairs(rows)
    assert max(n for _, n, _ in want) > 300
    assert told(vectors.link_vectors(table(spark, rows))) == sorted(want, key=str)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [2.0, -0.0]), (8, [2.0, 0.0]),
            (None, [1.0, 0.01]), (9, [1.0]), (10, [5.0]), (11, [-1.0]), (12, [1.0, 0.0, 0.0]), (13, [1e-300, 0.0]), (14, [1e300, 1e299]), (None, [0.0, 1.0]), (None, None), (15, [-0.0])]
    assert told(vectors.link_vectors(table(spark, rows, "double"))) == sorted(all_pairs(rows), key=str)
    assert vectors.link_vectors(table(spark, [])).count() == 0


def test_hot_vector_and_nulls_are_spread(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HOT", 100)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(None, None)] * 3000 + [(3000 + i, [1.0, 2.0, 3.0 + i]) for i in range(1, 50)]
    got = vectors.link_vectors(table(spark, rows))
    assert told(got) == sorted(all_pairs(rows), key=str)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = QUERIES["op11_embedding_near_dedup"](spark, sf)
    assert told(got) == sorted(all_pairs(rows), key=str)
    assert got.filter(F.col("kept") != (F.col("vec_id") == F.col("component_id"))).isEmpty()
