"""Exact nearest neighbours by a block matrix join over int8 tiles.

Candidates and queries are written to the shared folder. A task holds a block of queries and reads the candidates in
tiles, carrying each query's heap from tile to tile, so nothing is shuffled but the heaps. Vectors are quantised to int8
with one scale each; the product of two int8 tiles, which float32 arithmetic gives exactly, differs from the true inner
product by at most

    |x - x'| |y| + |x'| |y - y'|        (x', y': the quantised vectors times their scales)

A pair whose upper bound lies below the k-th best lower bound of its query can't be among the k nearest. The others
are computed again from the original vectors in double precision, and the tasks' heaps are merged.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.base import file_system, forget, list_files, prepare, shared_dir

#: Bytes of a task's queries, as doubles.
QUERY_BYTES = 16 << 20
#: Numbers of a batch of candidates, and of a tile of products.
BATCH_NUMBERS = 1 << 20
#: Rows of a tile.
TILE = 2048
#: Tasks that the search has at least, if there are files of candidates enough.
TASKS = 24


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite and not null."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    x = vector.cast("array<double>")
    return F.coalesce(vector.isNotNull() & ~F.exists(x, bad) & F.exists(x, lambda v: v != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, their scales, norms of the quantised vectors, norms of what quantising lost)."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in the components' order."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def nearest(q_row: np.ndarray, q: np.ndarray, c_row: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int, heaps: list[list]) -> None:
    """Take the candidates into each query's heap of (score, -id) of the k nearest; a query's own row is left out."""
    c8, c_scale, c_norm, c_lost = quantise(c)
    c_full = np.linalg.norm(c, axis=1)
    for s in range(0, len(q), TILE):
        rows, x, own = q_row[s : s + TILE], q[s : s + TILE], heaps[s : s + TILE]
        x8, x_scale, x_norm, x_lost = quantise(x)
        floor = np.array([h[0][0] if len(h) == k else -np.inf for h in own])  # the k-th best score so far
        for t in range(0, len(c), TILE):
            part = slice(t, t + TILE)
            # int8 products up to 2**24 are exact in float32: components in chunks of 1024
            tile = np.zeros((len(rows), len(c8[part])))
            for d in range(0, x8.shape[1], 1024):
                tile += x8[:, d : d + 1024].astype(np.float32) @ c8[part, d : d + 1024].astype(np.float32).T
            tile *= x_scale[:, None] * c_scale[part][None, :]
            error = x_lost[:, None] * c_full[part][None, :] + x_norm[:, None] * c_lost[part][None, :]
            error += 1e-9 * (x_norm[:, None] + x_lost[:, None]) * (c_full[part][None, :])  # rounding of the bounds themselves
            same = rows[:, None] == c_row[part][None, :]
            low = tile - error
            low[same] = -np.inf
            kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(rows), -np.inf)
            i, j = np.nonzero((tile + error >= np.maximum(kth, floor)[:, None]) & ~same)
            score = inner(x[i], c[t + j])
            touched = set(i.tolist())
            for a, b, v in zip(i.tolist(), c_id[t + j].tolist(), score.tolist(), strict=True):
                if len(own[a]) < k:
                    heapq.heappush(own[a], (v, -b))
                elif (v, -b) > own[a][0]:
                    heapq.heapreplace(own[a], (v, -b))
            for a in touched:
                if len(own[a]) == k:
                    floor[a] = own[a][0][0]


def _matrix(table: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, ids, vectors) of each length of vector."""
    row, ids = (np.asarray(table.column(n)) for n in ("row", "id"))
    lists = table.column("vector")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.r_[0, np.cumsum(size)]
    out = {}
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        out[n] = row[at], ids[at], flat[start[at][:, None] + np.arange(n)[None, :]]
    return out


def _batches(file: str):
    system, path = file_system(file)
    with pq.ParquetFile(path, filesystem=system) as opened:
        first = next(opened.iter_batches(1), None)
        if first is not None:
            yield from opened.iter_batches(max(64, BATCH_NUMBERS // max(1, len(first.column("vector")[0]))))


def _tiles(k: int):
    def run(batches):
        forget()
        for batch in batches:
            for asked, files in zip(batch.column("queries").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                held = list(_batches(asked))
                queries = _matrix(pa.Table.from_batches(held)) if held else {}
                heaps = {n: [[] for _ in x[0]] for n, x in queries.items()}
                for file in files:
                    for part in _batches(file):
                        for n, (row, ids, vectors) in _matrix(part).items():
                            if n in queries:
                                nearest(queries[n][0], queries[n][2], row, ids, vectors, k, heaps[n])
                for n, (row, ids, _) in queries.items():
                    found = [(int(r), int(i), -b, v) for r, i, h in zip(row, ids, heaps[n], strict=True) for v, b in h]
                    columns = [pa.array([f[c] for f in found], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "query_id", "vec_id", "score"])

    return run


def _merge_batches(k: int):
    def run(batches):
        heap: list[tuple[float, int]] = []
        now = None

        def done():
            best = sorted(heap, reverse=True)
            return [(now[1], r + 1, -b, v) for r, (v, b) in enumerate(best)]

        for batch in batches:
            rows = []
            for row, query, vec, score in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (row, query) != now:
                    rows += done() if now is not None else []
                    now, heap = (row, query), []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))
            yield _ranked(rows)
        yield _ranked(done() if now is not None else [])

    return run


def _ranked(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k candidates of the largest inner product, ties to smaller ids.

    Queries are the rows where ``is_query`` holds, candidates all rows but the query's own. Rows that repeat an id are
    queries and candidates each, so a repeated query has its results once for each row. Rows with a null id, or a vector
    that is null, empty, zero or holds null or non-finite components, take no part; vectors of different lengths are
    never compared. Fewer than k candidates give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asked"))
    everything, asked = shared_dir(spark, "vectors"), shared_dir(spark, "vector-queries")
    rows.write.parquet(everything)  # row numbers are fixed here
    queries = spark.read.parquet(everything).where("asked").select("row", "id", "vector")
    numbers = queries.agg(F.sum(F.size("vector").cast("bigint"))).first()[0] or 0
    queries.repartition(max(1, -(-numbers * 8 // QUERY_BYTES)), "row").write.parquet(asked)
    blocks, files = list_files(spark, asked, ".parquet"), list_files(spark, everything, ".parquet")
    groups = max(1, min(len(files), -(-TASKS // max(1, len(blocks)))))
    tasks = [(i, b, files[g::groups]) for i, (b, g) in enumerate((b, g) for b in blocks for g in range(groups))]
    given = spark.createDataFrame(tasks, "task int, queries string, candidates array<string>")
    found = given.repartitionByRange(max(1, len(tasks)), "task").mapInArrow(_tiles(k), "row bigint, query_id bigint, vec_id bigint, score double")
    return found.repartition("row").sortWithinPartitions("row").mapInArrow(_merge_batches(k), "query_id bigint, rank int, vec_id bigint, score double")
