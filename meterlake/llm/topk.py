"""Exact top-k search by inner product: columnar branch-and-bound.

Equal rows (id and vector) are one candidate that counts as often as it occurs. Candidates are dealt by a hash into
blocks and queries into groups, as large as UNIT bytes allow, since every query goes to every block and every block to
every group. Each (block, group) pair is one unit of work: the block lies dimension by dimension (vertical layout), the
dimensions with most mass first. Scores are accumulated one block of dimensions at a time; after each, a candidate
whose partial score plus the most that the remaining dimensions can add (the product of the remaining norms of query
and candidate, Cauchy-Schwarz) is below the query's threshold leaves, and the arrays are compacted to the survivors.
The threshold is the k-th best of what is scored first: SEEDS rows of the whole table, scored once for each query before
it is dealt, so all its units share that one, and a few rows of the block. Only k rows a query and block remain, and a
window ranks them. A bound that ties stays in, so ties are decided exactly.

Memory is bounded by a block and a group whatever the input.

Cases: vectors that are null or hold null or non-finite components take no part; empty ones do (all their scores are 0).
A query's own id is no candidate; a query sees only candidates of its length. A row without id asks nothing, but is a
candidate; it comes after all ids in a tie. Repeated candidate rows count one by one; of rows with the same query id the
first in the order of components asks. Ties go to the smaller id. Scores are exact integers at any size: where terms
could leave 2^53, Python's integers are used (components of LARGE or more lie in blocks of their own); a score that no
64-bit integer holds is returned as the nearest that one does, and ranked among equals by id. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import partitions, written

#: Bytes of vectors in a block or a group, and rows that a block has at least before there are more blocks than tasks.
UNIT, LEAST = 16 << 20, 2048
#: Dimensions added between two checks of the bounds, candidates scored for the first threshold in a block, and in all.
STEP, SEED, SEEDS = 16, 64, 512
LARGE = 2.0**16


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component as a Python integer."""
    out = np.empty(vectors.shape, object)
    for i, row in enumerate(vectors.tolist()):
        for j, x in enumerate(row):
            out[i, j] = int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)
    return out


def best(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, none: np.ndarray | None = None, floors: np.ndarray | None = None, scale: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row position, score) of each query's k best rows with another id: highest score, then smallest id.

    none: rows without id; floors: a score that each query's k-th best is known to reach, or nan.
    """
    by_id = np.lexsort((ids, none)) if none is not None else np.argsort(ids, kind="stable")
    ids, raw = ids[by_id], rows[by_id]
    named = np.ones(len(ids), bool) if none is None else ~none[by_id]
    with np.errstate(over="ignore"):
        points, asked = np.floor(raw * float(scale)), np.floor(queries * float(scale))
        bound = np.abs(asked).max(axis=1, initial=0) * np.abs(points).max(initial=0) * max(1, rows.shape[1])
        exact = bound < 2.0**53
        mass = np.argsort(-np.square(points).sum(axis=0), kind="stable")
    columns = np.ascontiguousarray(points[:, mass].T)  # vertical: a line for each dimension
    asked = asked[:, mass]
    dims, n = columns.shape
    cuts = [0, *range(STEP, dims, STEP), dims]

    def rest(x: np.ndarray) -> list[np.ndarray]:
        """Norm of what lies beyond each cut, a little high."""
        squares = np.square(x)
        return [np.sqrt(squares[c:].sum(axis=0)) * (1 + 1e-9) for c in cuts]

    with np.errstate(over="ignore", invalid="ignore"):
        row_rest, query_rest = rest(columns), rest(asked.T)
        seed = np.linspace(0, n - 1, min(n, max(SEED, k + 1))).astype(np.int64)
        seeded = asked @ columns[:, seed]
        opening = asked[:, : cuts[1]] @ columns[: cuts[1]]
    found: tuple[list, list, list] = ([], [], [])
    for q in range(len(asked)):
        own = (ids == q_ids[q]) & named
        if exact[q]:
            known = seeded[q][~own[seed]]
            floor = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else -np.inf
            if floors is not None and floors[q] > floor:
                floor = floors[q]
            partial, alive = opening[q], np.flatnonzero(~own)
            partial = partial[alive]
            for c in range(1, len(cuts)):
                if c > 1:
                    partial = partial + asked[q, cuts[c - 1] : cuts[c]] @ columns[cuts[c - 1] : cuts[c], alive]
                stay = np.flatnonzero(partial + query_rest[c][q] * row_rest[c][alive] >= floor)
                alive, partial = alive[stay], partial[stay]
            top = np.lexsort((alive, -partial))[:k]  # positions are in the order of ids
            score = partial[top].astype(np.int64)
        else:
            alive = np.flatnonzero(~own)
            sums = [max(-(1 << 63), min((1 << 63) - 1, s)) for s in (whole(raw[alive], scale) @ whole(queries[q : q + 1], scale)[0]).tolist()] if dims else [0] * len(alive)
            top = np.array(sorted(range(len(alive)), key=lambda i: (-sums[i], i))[:k], np.int64)
            score = np.array([sums[i] for i in top], np.int64)
        found[0].append(np.full(len(top), q))
        found[1].append(by_id[alive[top]])
        found[2].append(score)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def with_floors(asked: DataFrame, seeds: list[tuple[int | None, list[float]]], k: int, scale: int) -> DataFrame:
    """Queries with the k-th best score among the seeds, nan where there are fewer of their length."""
    by_size: dict[int, list[tuple[int | None, list[float]]]] = {}
    for i, v in seeds:
        if v and max(map(abs, v)) < LARGE:
            by_size.setdefault(len(v), []).append((i, v))
    shared = asked.sparkSession.sparkContext.broadcast({d: (np.array([-1 if i is None else i for i, _ in s]), np.array([i is None for i, _ in s]), np.floor(np.array([v for _, v in s]) * scale)) for d, s in by_size.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            floor = np.full(len(pdf), np.nan)
            for d, (ids, none, points) in shared.value.items():
                at = np.flatnonzero(pdf["dims"].to_numpy() == d)
                at = at[~pdf["big"].to_numpy()[at]]
                if not len(at):
                    continue
                score = np.floor(stacked(pdf["q"].iloc[at]) * scale) @ points.T
                score[(pdf["query_id"].to_numpy()[at, None] == ids[None]) & ~none[None]] = -np.inf
                if score.shape[1] >= k:
                    kth = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                    floor[at] = np.where(np.isfinite(kth), kth, np.nan)
            yield pdf.assign(floor=floor)

    return asked.mapInPandas(run, "dims int, big boolean, query_id long, q array<double>, floor double")


def topk(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows by inner product of the floored, scaled components."""
    spark = df.sparkSession
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(usable(F.col("v")))
    vectors = vectors.select("vec_id", F.transform("v", lambda x: x.cast("double")).alias("v"), "asks")
    rows = written(vectors.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"), (F.max("asks") & F.col("vec_id").isNotNull()).alias("asks")), "vectors")
    rows = rows.withColumn("dims", F.size("v")).withColumn("big", F.exists("v", lambda x: F.abs(x) >= LARGE))
    n, asking, widest, large = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max("dims"), F.count_if("big")).first()
    most = max(64, UNIT // (8 * max(1, widest or 1)))
    blocks = max(1, math.ceil(n / most), min(2 * partitions(spark), math.ceil(n / LEAST)))
    groups = max(1, math.ceil(asking / most))
    share = min(1.0, SEEDS / max(1, n))
    # About SEEDS rows, whatever the input.
    seeds = [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("vec_id", "v", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec_id", "v").toLocalIterator()]
    asked = rows.filter("asks").groupBy("vec_id").agg(F.min("v").alias("q"))
    asked = with_floors(asked.select(F.size("q").alias("dims"), F.exists("q", lambda x: F.abs(x) >= LARGE).alias("big"), F.col("vec_id").alias("query_id"), "q"), seeds, k, scale)
    kinds = F.array(F.lit(False), F.lit(True)) if large else F.array(F.lit(False))
    asked = asked.select("dims", "query_id", "q", "floor", F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(groups)).cast("int").alias("grp"), F.explode(kinds).alias("big"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "dims", "big", F.col("vec_id").isNull().alias("none"), F.coalesce("vec_id", F.lit(0)).alias("vec_id"), "v", "n")

    def unit(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if candidates.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "none": [], "vec_id": [], "score": [], "n": []}).astype({"query_id": "int64", "none": bool, "vec_id": "int64", "score": "int64", "n": "int64"})
        ids, q_ids, none = candidates["vec_id"].to_numpy(), queries["query_id"].to_numpy(), candidates["none"].to_numpy()
        q, c, score = best(stacked(queries["q"]), q_ids, stacked(candidates["v"]), ids, k, none, queries["floor"].to_numpy(), scale)
        return pd.DataFrame({"query_id": q_ids[q], "none": none[c], "vec_id": ids[c], "score": score, "n": candidates["n"].to_numpy()[c]})

    key = ["block", "grp", "dims", "big"]
    near = dealt.groupBy(key).cogroup(asked.groupBy(key)).applyInPandas(unit, "query_id long, none boolean, vec_id long, score long, n long")
    near = near.select("query_id", F.when(~F.col("none"), F.col("vec_id")).alias("vec_id"), "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))).alias("copy"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return near.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id IS DISTINCT FROM b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
