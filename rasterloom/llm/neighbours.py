"""Nearest neighbours by a block matrix join with int8 product tiles."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

QUERY_BLOCK, ROW_BLOCK, TILE_QUERIES, PAIRS = 4096, 8192, 128, 32768
RESULT = "query bigint, query_id bigint, vec_id bigint, score double"


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors (as float32 for the product), their scale, the norm of scale * code, and the norm of what rounding left."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes.astype(np.float32), scale, np.sqrt((near * near).sum(axis=1)), np.sqrt(((unit - near) ** 2).sum(axis=1))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, summed in the order of the components."""
    dot, x, y = (np.zeros(len(a)) for _ in range(3))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        x += a[:, j] * a[:, j]
        y += b[:, j] * b[:, j]
    return dot / (np.sqrt(x) * np.sqrt(y))


def tile(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query of a tile its k nearest rows: the query's number in the tile, the row's id, the cosine.

    The product of the codes is exact (sums of products of int8 stay below 2**24 for up to
    1,040 components; longer vectors take float64). With u = near + rest for both, the
    cosine is within |near| |rest'| + |near'| |rest| + |rest| |rest'| of it. Rows whose upper
    bound reaches the k-th lower bound are computed again from the original vectors.
    """
    out = []
    qc, qs, qn, qe = quantised(queries)
    rc, rs, rn, re = quantised(rows)
    if queries.shape[1] > 1040:
        qc, rc = qc.astype(np.float64), rc.astype(np.float64)
    for at in range(0, len(queries), TILE_QUERIES):
        part = slice(at, at + TILE_QUERIES)
        near = (qc[part] @ rc.T).astype(np.float64) * qs[part, None] * rs[None, :]
        slack = qn[part, None] * re[None, :] + qe[part, None] * rn[None, :] + qe[part, None] * re[None, :] + 1e-9
        own = query_ids[part, None] == row_ids[None, :]
        low = np.where(own, -np.inf, near - slack)
        if low.shape[1] > k:
            kth = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
        else:
            kth = np.full(len(low), -np.inf)
        i, j = np.nonzero(~own & (near + slack >= kth[:, None]))
        score = np.concatenate([cosine(queries[at + i[s : s + PAIRS]], rows[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)] or [np.zeros(0)])
        order = np.lexsort((row_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i, side="left")
        keep = np.arange(len(i)) - first < k
        out.append((at + i[keep], row_ids[j[keep]], score[keep]))
    return out


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest other rows by cosine: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; rows with the query's own id are
    no candidates. Exact. Ties go to the smaller id; repeated rows are so many candidates, and
    rows that share an id are queries of their own, each with its ranks from 1. Each block of
    queries meets all blocks of rows, so the rows are exchanged once for each 4,096 queries.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without id, take no part; vectors of other lengths are compared among themselves only.
    Other columns are not read. Blocks have a bounded number of rows, however many there are.
    """
    v = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    bounded_batches(vectors.sparkSession)
    rows = vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"), F.size(v).alias("dims"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    asked = rows.filter(F.col("vec_id") % every == 0)
    row_blocks, query_blocks = (max(1, -(-n // size)) for n, size in ((rows.count(), ROW_BLOCK), (asked.count(), QUERY_BLOCK)))
    # the blocks of both sides meet once in each tile; rows are dealt by their number, so copies don't fill a block
    q = asked.withColumn("qb", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    r = rows.withColumn("rb", F.pmod(F.xxhash64("row"), F.lit(row_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        got = []
        if left.num_rows and right.num_rows:
            dims = left.column("dims")[0].as_py()
            got = tile(left.column("vec_id").to_numpy(), matrix(left.column("v"), dims), right.column("vec_id").to_numpy(), matrix(right.column("v"), dims), k)
        at, ids, score = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64)))
        return pa.table({"query": left.column("row").to_numpy()[at], "query_id": left.column("vec_id").to_numpy()[at], "vec_id": ids, "score": score})

    tiles = q.groupBy("dims", "qb", "rb").cogroup(r.groupBy("dims", "qb", "rb")).applyInArrow(join, RESULT)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by query; a heap holds a query's k best."""
        last, heap = None, []

        def result() -> pa.RecordBatch:
            best = sorted(heap, reverse=True)
            return pa.record_batch([pa.array([last[1]] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([-x[1] for x in best], pa.int64()), pa.array([x[0] for x in best], pa.float64())], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for query, query_id, vec, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (query, query_id) != last:
                    if heap:
                        yield result()
                    last, heap = (query, query_id), []
                heapq.heappush(heap, (score, -vec))
                if len(heap) > k:
                    heapq.heappop(heap)
        if heap:
            yield result()

    return tiles.repartition("query").sortWithinPartitions("query").mapInArrow(merge, "query_id bigint, rank int, vec_id bigint, score double")


ORACLE = """
with v as (select row_number() over () as row, vec_id, embedding::double[] as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 n as (select row, vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) as norm from v),
 s as (select q.row, q.vec_id as query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) / (q.norm * c.norm) as score
    from n q join n c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
 r as (select query_id, (row_number() over (partition by row order by score desc, vec_id))::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5"""
