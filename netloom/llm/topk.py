"""Exact top-k inner-product search.

Method: the candidates are dealt to shards and the queries to blocks; each (block, shard)
pair is one tile, whose scores are one matrix product. A tile keeps each query's k best; the
lists of a query are merged by a tree of fixed fan-in.

The queries given are searched against all candidates. Each candidate is copied once per
query block and each query once per shard, never per pair of vectors. A tile holds about
``shard_rows`` + ``block_rows`` vectors, whatever the input.

Defined results: vectors that are null or hold null or non-finite components take no part,
nor do rows with a null id. Components that leave the range of a long when scaled saturate.
Rows that repeat an id count once; where their vectors differ, the least in array order
holds. A query skips candidates with its own id. Vectors of another length than the query's
are not comparable and are left out. Ties go to the smaller id. Scores beyond a long
saturate. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import ship

TOP = 2**63 - 1
_OUT = "query_id long, shard long, top array<struct<cost: bigint, vec_id: bigint>>"


def quantised(vector: Column, scale: float = 1024.0) -> Column:
    """floor(scale * x) of each component, or null where the vector takes no part."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * F.lit(scale))))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; int64, saturated only if a score leaves the range of a long."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    most = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(c.astype(np.float64)).max()) * q.shape[1]
    if most < 2.0**52:
        return np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -TOP, TOP).astype(np.int64)


def _tile_best(q_ids, q, c_ids, c, k: int, step: int = 4096):
    """For each query the k best (cost = -score, id), by partial selection per strip of candidates."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    best_cost = np.full((len(q), 0), 0, np.int64)
    best_id = best_cost.copy()
    dead = np.zeros((len(q), 0), bool)
    for at in range(0, len(c_ids), step):
        cost = -_scores(q, c[at : at + step])
        ids = np.broadcast_to(c_ids[at : at + step], cost.shape)
        own = ids == q_ids[:, None]
        keep = min(k + 1, cost.shape[1])
        kth = np.partition(cost, keep - 1, axis=1)[:, keep - 1 : keep]
        # everything below the k-th cost, and of those equal to it the first few by id
        tied = cost == kth
        chosen = (cost < kth) | (tied & (np.cumsum(tied, axis=1) <= keep))
        rows, cols = np.nonzero(chosen)
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        width = int(rank.max(initial=-1)) + 1
        new_cost = np.full((len(q), width), TOP, np.int64)
        new_id = np.full((len(q), width), TOP, np.int64)
        new_dead = np.ones((len(q), width), bool)
        new_cost[rows, rank], new_id[rows, rank], new_dead[rows, rank] = cost[rows, cols], ids[rows, cols], own[rows, cols]
        best_cost, best_id, dead = (np.concatenate(x, axis=1) for x in ((best_cost, new_cost), (best_id, new_id), (dead, new_dead)))
        by = np.lexsort((best_id, best_cost, dead), axis=1)[:, :k]
        best_cost, best_id, dead = (np.take_along_axis(x, by, axis=1) for x in (best_cost, best_id, dead))
    return best_cost, best_id, dead


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays([x.flatten() for x in flat.chunks]) if isinstance(flat, pa.ChunkedArray) else flat.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


def _tile(k: int):
    kind = pa.list_(pa.struct([("cost", pa.int64()), ("vec_id", pa.int64())]))

    def run(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        dim, shard = key[2].as_py(), key[1].as_py()
        q_ids, top = [], []
        if queries.num_rows and candidates.num_rows:
            q_ids = queries["vec_id"].to_numpy()
            c_ids, c = candidates["vec_id"].to_numpy(), _matrix(candidates["q"], dim)
            q = _matrix(queries["q"], dim)
            for at in range(0, len(q_ids), 256):
                cost, ids, dead = _tile_best(q_ids[at : at + 256], q[at : at + 256], c_ids, c, k)
                for a, b, d in zip(cost.tolist(), ids.tolist(), dead.tolist()):
                    top.append([{"cost": x, "vec_id": y} for x, y, z in zip(a, b, d) if not z])
        return pa.table(
            {"query_id": pa.array(q_ids, pa.int64()), "shard": pa.array([shard] * len(top), pa.int64()), "top": pa.array(top, kind)}
        )

    return run


def top_k(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 1024.0,
    shard_rows: int = 8192,
    block_rows: int = 4096,
    fan_in: int = 16,
) -> DataFrame:
    """``query_id long, rank int, vec_id long, score long``: see the module's text."""
    spark = candidates.sparkSession
    ship(spark)

    def vectors(df: DataFrame) -> DataFrame:
        q = quantised(F.col(vector_col), scale)
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), q.alias("q")).where("vec_id is not null and q is not null")
        return df.groupBy("vec_id").agg(F.min("q").alias("q")).withColumn("dim", F.size("q"))

    shards = max(1, -(-candidates.select(id_col).count() // shard_rows))
    blocks = max(1, -(-queries.select(id_col).count() // block_rows))
    cs = vectors(candidates).withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)))
    cs = cs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    qs = vectors(queries).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)))
    qs = qs.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    lists = qs.groupBy("block", "shard", "dim").cogroup(cs.groupBy("block", "shard", "dim")).applyInArrow(_tile(k), _OUT)
    while True:
        best = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
        lists = lists.withColumn("shard", F.expr(f"shard div {fan_in}")).groupBy("query_id", "shard").agg(best)
        shards = -(-shards // fan_in)
        if shards <= 1:
            break
    return lists.select("query_id", F.posexplode("top").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.cost")).alias("score")
    )
