"""Exact top-k search by inner product: columnar branch and bound.

Queries and candidates are dealt out over a grid of cells, each of a bounded number of vectors, so no side is
ever whole in one place. A cell keeps its candidates by dimension. For a query it adds up block after block
of dimensions, those first where the query has most mass. What the remaining blocks can still add is at most
the product of the two remaining norms; candidates that cannot reach the k-th best score any more are
dropped, and the survivors compacted, before the next block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, shuffle_partitions

#: Dimensions in a block.
BLOCK = 8
_LIMIT = float(1 << 62)
_TOP = 2**63 - 1


def _quantise(scale: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, values = [], [], []
            for i, vector in zip(batch.column("vec_id").to_pylist(), batch.column("vector"), strict=True):
                if i is None or not vector.is_valid or vector.values.null_count:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(scale * x)
                most = np.abs(x).max() if len(x) else 0.0
                ids.append(i)
                sizes.append(len(x))
                # A component of 2**62 or more is a whole number as a double, and stays one.
                kind = "<i4" if most < 1 << 31 else "<i8" if most < _LIMIT else "<f8"
                values.append(kind[1:].encode() + x.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(values, pa.binary())], names=["vec_id", "dim", "q"])

    return run


def _matrix(rows: pa.Table, dim: int) -> np.ndarray:
    """One row a vector, of 64-bit numbers or, if these don't hold all, of unbounded ones."""
    vectors = [np.frombuffer(x, "<" + x[:2].decode(), offset=2) for x in rows.column("q").to_pylist()]
    if any(v.dtype.kind == "f" for v in vectors):
        return np.array([[int(c) for c in v.tolist()] for v in vectors], object).reshape(rows.num_rows, dim)
    return np.array([v.astype(np.int64) for v in vectors], np.int64).reshape(rows.num_rows, dim)


def best(query: np.ndarray, columns: np.ndarray, masses: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of a cell, ties to the smaller id.

    ``columns``: one row a dimension. ``masses``: squared norms, one row a block.
    """
    dim, n = columns.shape
    blocks = [slice(a, min(dim, a + BLOCK)) for a in range(0, dim, BLOCK)]
    mass = np.array([(query[b].astype(np.float64) ** 2).sum() for b in blocks])
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive), np.int64)
    left = masses[:, alive].sum(axis=0) if blocks else np.zeros(len(alive))
    todo = mass.sum()
    for b in np.argsort(-mass, kind="stable"):
        score = score + query[blocks[b]] @ columns[blocks[b]][:, alive]
        left = np.maximum(left - masses[b, alive], 0)
        todo = max(todo - mass[b], 0.0)
        if len(alive) <= k:
            continue
        reach = np.sqrt(left * todo) * (1 + 1e-9) + 1  # room for rounding
        floor = np.partition(score - reach, len(alive) - k)[len(alive) - k]
        stay = score + reach >= floor
        if not stay.all():
            alive, score, left = alive[stay], score[stay], left[stay]
    order = np.lexsort((ids[alive], -score))[:k]
    return ids[alive][order], score[order]


def _order(score: int) -> bytes | None:
    """Orders scores that 64 bits don't hold, by bytes."""
    if abs(score) < _TOP:
        return None
    size = (abs(score).bit_length() + 7) // 8
    key = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return key if score > 0 else bytes(255 - b for b in key) + b"\xff"


def _plain(query: np.ndarray, columns: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int, bytes | None]]:
    """For components so large that 64 bits may not hold a score: unbounded integers, cut off only when they are given."""
    score = query.astype(object) @ columns.astype(object)
    found = sorted((-s, i) for s, i in zip(score, ids.tolist(), strict=True) if i != own)[:k]
    return [(i, max(-_TOP, min(_TOP, -s)), _order(-s)) for s, i in found]


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "key": [], "vec_id": [], "score": [], "beyond": []}
        if queries.num_rows and candidates.num_rows:
            dim = queries.column("dim")[0].as_py()
            ids = candidates.column("vec_id").to_numpy()
            columns = np.ascontiguousarray(_matrix(candidates, dim).T)
            wanted = _matrix(queries, dim)
            exact = columns.dtype == object or wanted.dtype == object
            if not exact:
                square = columns.astype(np.float64) ** 2
                masses = np.array([square[a : a + BLOCK].sum(axis=0) for a in range(0, dim, BLOCK)]).reshape(-(-dim // BLOCK), len(ids))
                largest = float(np.abs(columns).max()) if columns.size else 0.0
            for own, key, query in zip(queries.column("vec_id").to_pylist(), queries.column("key").to_pylist(), wanted, strict=True):
                if not exact and largest * np.abs(query.astype(np.float64)).sum() < _LIMIT:
                    found = [(i, s, None) for i, s in zip(*(x.tolist() for x in best(query, columns, masses, ids, own, k)), strict=True)]
                else:
                    found = _plain(query, columns, ids, own, k)
                for i, s, beyond in found:
                    for name, x in zip(out, (own, key, i, s, beyond), strict=True):
                        out[name].append(x)
        return pa.table({n: pa.array(x, pa.binary() if n == "beyond" else pa.int64()) for n, x in out.items()})

    return run


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", cell_queries: int = 4096, cell_candidates: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k largest inner products.

    Components become floor(scale * x). Queries are the rows whose id is a multiple of ``every``;
    candidates are all rows with another id and as many dimensions. Ties go to the smaller id. Rows
    without id, null vectors, and vectors with a null or non-finite component take no part; rows that
    repeat id and vector count once. Other columns are not read. An empty table gives no rows. Scores are ranked
    as they are, however large; one that no 64-bit number holds is given as the nearest, 2**63 - 1 or its negative.
    """
    read = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("vector"))
    rows = materialize(read.mapInArrow(_quantise(scale), "vec_id long, dim int, q binary").dropDuplicates(["vec_id", "q"]))
    rows = rows.withColumn("key", F.xxhash64("q"))
    queries = rows.where(F.col("vec_id") % every == 0)
    n = rows.agg(F.count("*").alias("c"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    across, down = -(-n["c"] // cell_candidates) or 1, -(-n["q"] // cell_queries) or 1
    place = F.xxhash64("vec_id", "key")
    queries = queries.withColumn("down", F.pmod(place, F.lit(down))).withColumn("across", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    candidates = rows.withColumn("across", F.pmod(place, F.lit(across))).withColumn("down", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    cell = ["dim", "across", "down"]
    # Cells are small and take long, so they are dealt out by number, not gathered by size.
    tasks = shuffle_partitions(vectors.sparkSession)
    queries, candidates = queries.repartition(tasks, *cell), candidates.repartition(tasks, *cell)
    found = queries.groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInArrow(_search(k), "query_id long, key long, vec_id long, score long, beyond binary")
    best_first = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
