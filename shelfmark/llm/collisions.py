"""Nearest neighbours by collision-counting hashing.

Each of PROJECTIONS or more random directions is one hash function: the sorted array
of the vectors' projections.  A query opens a window around its own
projection in every array; a vector that stands in a window collides there.  Windows
widen step by step (virtual rehashing: no array is built again), and a vector
that collides in THRESHOLD of all arrays is a candidate.  When enough vectors
are, all candidates are verified on the original vectors in double precision.

Vectors are dealt into blocks of bounded size, each with its own arrays; a query
group meets every block (a stated query set against all rows, in blocks), and the
best few of each block meet per query.  A block always verifies a fixed share of
its vectors at least, so recall doesn't fall as blocks are added.

Vectors that are null, zero or hold null or non-finite components take no part,
neither do rows without an id.  Vectors only meet vectors of their own length.  Equal vectors tie and
stand by id; repeated rows of one id count once.  Without any query or candidate there are no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 64  # at least
#: Share of the arrays in which a candidate must collide.
THRESHOLD = 0.75
#: Share of a block that becomes candidates at least.
VERIFIED = 0.12
#: Half the first window's width (projections of unequal vectors differ by about 1), and each widening.
FIRST, WIDER = 0.9, 1.06
BLOCK_ROWS, QUERY_ROWS = 8192, 1024
NEIGHBOURS, EVERY = 5, 50

FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    fine = (F.size("embedding") > 0) & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    return v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine).withColumn("dim", F.size("embedding"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy().reshape(len(values), -1)


def directions(dim: int) -> np.ndarray:
    """Random orthogonal directions (columns): as many whole bases as give PROJECTIONS.

    Within a basis the squared projections add up exactly, which makes the count of
    collisions a much better measure of distance than independent directions do.
    """
    rng = np.random.default_rng(dim)
    bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
    return np.concatenate(bases, axis=1) * np.sqrt(dim)


class Block:
    """The sorted arrays of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        # Scaled first, so that squares of very large or small components stay finite.
        self.unit = _unit(vectors)
        self.directions = directions(vectors.shape[1])
        values = self.unit @ self.directions
        self.order = np.argsort(values, axis=0, kind="stable").T.ravel()
        self.far = 4.0 + 2.0 * float(np.abs(values).max(initial=0.0))
        self.arrays = self.directions.shape[1]
        self.shift = np.arange(self.arrays) * (4 * self.far)
        self.flat = np.sort(values, axis=0).T.ravel() + np.repeat(self.shift, len(ids))

    def candidates(self, query: np.ndarray) -> np.ndarray:
        n = len(self.ids)
        wanted = min(n, NEIGHBOURS + 1 + int(np.ceil(VERIFIED * n)))
        least = int(np.ceil(THRESHOLD * self.arrays))
        at = np.clip(query @ self.directions, -self.far, self.far) + self.shift
        low = high = np.searchsorted(self.flat, at)
        low, high = np.clip(low, np.arange(self.arrays) * n, None), np.clip(high, None, np.arange(1, self.arrays + 1) * n)
        counts, half = np.zeros(n, np.int64), FIRST
        while True:
            a = np.maximum(np.searchsorted(self.flat, at - half), np.arange(self.arrays) * n)
            b = np.minimum(np.searchsorted(self.flat, at + half, "right"), np.arange(1, self.arrays + 1) * n)
            a, b = np.minimum(a, low), np.maximum(b, high)
            # Only what the wider windows add is counted.
            new = [self.order[x:y] for x, y in zip([*a.tolist(), *high.tolist()], [*low.tolist(), *b.tolist()], strict=True)]
            counts += np.bincount(np.concatenate(new), minlength=n)
            low, high = a, b
            if (counts >= least).sum() >= wanted or half > 4 * self.far:
                return np.flatnonzero(counts >= least)
            half *= WIDER


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of a query with rows, in double precision."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        out = (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))
    odd = ~np.isfinite(out)
    if odd.any():  # squares beyond the range of doubles
        out[odd] = (_unit(vectors[odd]) * _unit(query[None])).sum(axis=1)
    return out


def _search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
    out: tuple[list, list, list] = ([], [], [])
    if vectors.num_rows and queries.num_rows:
        block = Block(vectors.column("vec_id").to_numpy(), _matrix(vectors.column("embedding")))
        own = _matrix(queries.column("embedding"))
        for q, vector, unit in zip(queries.column("vec_id").to_pylist(), own, _unit(own), strict=True):
            found = block.candidates(unit)
            found = found[block.ids[found] != q]
            score = cosine(vector, block.vectors[found])
            best = np.lexsort((block.ids[found], -score))[:NEIGHBOURS]
            out[0].extend([q] * len(best))
            out[1].extend(block.ids[found][best].tolist())
            out[2].extend(score[best].tolist())
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                    names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The nearest vectors of each query (both: vec_id, embedding), the query's own id left out, ranked from 1."""
    v, q = usable(vectors).dropDuplicates(["vec_id"]), usable(queries).dropDuplicates(["vec_id"])
    n, m = v.count(), q.count()
    blocks, groups = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // QUERY_ROWS))
    number = lambda rows: F.pmod(F.xxhash64("vec_id"), F.lit(rows)).cast("int")
    every = lambda rows: F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))
    left = v.withColumn("block", number(blocks)).withColumn("part", every(groups))
    right = q.withColumn("part", number(groups)).withColumn("block", every(blocks))
    key = ["block", "part", "dim"]
    found = left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(_search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def neighbours(vectors: DataFrame) -> DataFrame:
    """Nearest neighbours of every vector whose id is divisible by EVERY."""
    return nearest(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
