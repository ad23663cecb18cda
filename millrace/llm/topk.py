"""Exact top-k search by inner product with pivot-table elimination.

Every vector becomes whole numbers, floor(1024 x). For a query q, a candidate c and any
pivot p the triangle inequality gives d(q, c) >= |d(q, p) - d(c, p)|; the largest of these
lower bounds over many pivots bounds the inner product from above, since
2 q.c = |q|^2 + |c|^2 - d(q, c)^2.

The pivot table, every vector's distances to all pivots, is computed once and written with the
vectors, which lie in blocks by their nearest pivot and the distance to it. A block's ranges of
distances bound all its members at once. First each query is searched in the blocks with the
largest bounds, which gives it a k-th best score; then it goes to those other blocks alone
whose bound reaches that score. Within a block candidates are evaluated in the order of
their own bounds until the next one's is below the k-th best score found: exact.

A task holds one block and a bounded number of queries; a block that more queries reach is
read by several tasks. No vector, list of scores or query set is ever whole in one place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm._common import materialize

#: Candidates of a block, on average, and blocks at most: their ranges, some 400 bytes each, go to every task.
BLOCK_ROWS, MOST_BLOCKS = 8192, 1 << 16
#: Queries of a task, on average.
QUERY_ROWS = 2048
#: Pivots, spread out among a sample of so many vectors (those with the smallest hashes).
PIVOTS, PIVOT_SAMPLE = 24, 512
SCALE = 1024


def whole_numbers(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double; null where the vector or a component is null or not finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vec.isNotNull() & ~bad, F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _pivots(ints: DataFrame) -> np.ndarray:
    """Farthest-first choice among a bounded sample; the same for the same table."""
    rows = ints.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h", "v").limit(PIVOT_SAMPLE).collect()
    if not rows:
        return np.zeros((1, 0))
    size = max(len(r["v"]) for r in rows)
    x = np.array([r["v"] for r in rows if len(r["v"]) == size], dtype=np.float64)
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(PIVOTS, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    # In a chain of near ones, so that blocks over the border of two pivots' cells stay narrow.
    p, chain, left = x[chosen], [0], set(range(1, len(chosen)))
    while left:
        chain.append(min(left, key=lambda i: (((p[i] - p[chain[-1]]) ** 2).sum(), i)))
        left.remove(chain[-1])
    return p[chain]


def _exact_dot(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whole-number inner products; by floating point only where that is exact."""
    top = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * c.shape[1]
    if top < 2**53:
        return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return c @ q


def _table(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of whole-number vectors to the pivots; zeros for vectors of another length, which bound nothing."""
    if v.shape[1] != pivots.shape[1]:
        return np.zeros((len(v), len(pivots)))
    x = v.astype(np.float64)
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in pivots], axis=1))


def _upper(low: np.ndarray, q2, c2) -> np.ndarray:
    """What inner products can be at most, by a lower bound of the distance and the squared lengths; with room for rounding."""
    return (q2 + c2 - np.maximum(low - 1e-9 * (low + 1), 0) ** 2) / 2 + 1e-9 * (q2 + c2) + 1.0


def _search(cid, c, c_table, qid, q, q_table, least, k: int):
    """(query row, candidate, score) of the k best among these candidates of each query row; scores below ``least`` needn't be found."""
    c2, q2 = (c.astype(np.float64) ** 2).sum(1), (q.astype(np.float64) ** 2).sum(1)
    out = []
    for i in range(len(q)):
        bound = _upper(np.abs(c_table - q_table[i]).max(1), q2[i], c2)
        order = np.argsort(-bound, kind="stable")
        best_s, best_i, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, max(64, 4 * k)
        while at < len(order):
            if bound[order[at]] < (best_s[-1] if len(best_s) == k else least[i]):
                break  # no candidate from here on can reach the k-th score
            part = order[at : at + step]
            part = part[cid[part] != qid[i]]
            s = np.concatenate((best_s, _exact_dot(c[part], q[i])))
            ids = np.concatenate((best_i, cid[part]))
            keep = np.lexsort((ids, -s))[:k]
            best_s, best_i = s[keep], ids[keep]
            at, step = at + step, min(step * 2, 4096)
        out.append((np.full(len(best_s), i), best_i, best_s))
    return out


def _matrix(column, kind) -> np.ndarray:
    """An Arrow column of lists of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _vectors(ints: DataFrame, pivots: np.ndarray, rows: int) -> DataFrame:
    """(row, id, v, asks, dim, pt, len2, block): the vectors with their pivot table, in blocks."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(3).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                v = _matrix(part.column(1), np.int64) if dim else np.zeros((part.num_rows, 0), np.int64)
                table = _table(v, pivots)
                near = table.argmin(1)
                extra = (
                    pa.array(list(table), pa.list_(pa.float64())),
                    pa.array((v.astype(np.float64) ** 2).sum(1)),
                    pa.array(near, pa.int32()),
                    pa.array(table[np.arange(len(near)), near]),
                )
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=["id", "v", "asks", "dim", "pt", "len2", "near", "far"])

    schema = "id long, v array<long>, asks boolean, dim int, pt array<double>, len2 double, near int, far double"
    made = ints.select("id", "v", "asks", F.size("v").alias("dim")).mapInArrow(run, schema)
    blocks = max(1, -(-rows // max(BLOCK_ROWS, -(-rows // MOST_BLOCKS))))
    dealt = made.repartitionByRange(blocks, "dim", "near", "far", "id").withColumn("block", F.spark_partition_id())
    return materialize(dealt.withColumn("row", F.monotonically_increasing_id()).drop("near", "far"), "topk-vectors", "lz4")


def _met(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(row, query_id, vec_id, score): the k best in each of the blocks that queries (row, id, v, dim, pt, least, block) go to."""
    many = asked.groupBy("dim", "block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts"))
    # One row for each block in use.
    many = F.broadcast(many)
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part")
    q = asked.join(many, ["dim", "block"]).select("dim", "block", part, "row", "id", "v", "pt", "least")
    c = vectors.join(many, ["dim", "block"]).select(
        "dim", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v", "pt"
    )

    def run(queries, candidates):
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        matrix = lambda frame, col, kind: np.concatenate(frame[col].to_numpy()).astype(kind, copy=False).reshape(len(frame), -1)
        found = _search(
            candidates["id"].to_numpy(), matrix(candidates, "v", np.int64), matrix(candidates, "pt", np.float64),
            queries["id"].to_numpy(), matrix(queries, "v", np.int64), matrix(queries, "pt", np.float64), queries["least"].to_numpy(), k,
        )
        at, ids, scores = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"row": queries["row"].to_numpy()[at], "query_id": queries["id"].to_numpy()[at], "vec_id": ids, "score": scores})

    keys = ("dim", "block", "part")
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(run, "row long, query_id long, vec_id long, score long")


def exact_top_k(
    df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products over all other rows.

    ``queries`` picks the query rows of ``df``. Ties go to the smaller id; a query with fewer
    than k other rows gets all of them.

    Defined results: rows whose id or vector is null, or whose vector holds a null or
    non-finite component, take no part; vectors of different lengths never meet; rows that
    repeat an id each count as candidates, but never for a query with that id, and as queries
    share one list of k, in which a candidate stands for each of them; an empty table gives no
    rows; other columns are not read. Scores beyond a long wrap around.
    """
    ints = df.select(
        F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vec_col), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")
    ).where("id is not null and v is not null")
    pivots = _pivots(ints)
    vectors = _vectors(ints, pivots, ints.count())
    # One row for each block and length, MOST_BLOCKS at most: what its members' distances and lengths span.
    ends = [f(F.get("pt", F.lit(i))).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(len(pivots))]
    told = vectors.groupBy("dim", "block").agg(F.count(F.lit(1)).alias("n"), F.max("len2").alias("len2"), *ends).orderBy("dim", "block").collect()
    of = {}
    for dim in {r["dim"] for r in told}:
        rows = [r for r in told if r["dim"] == dim]
        lo, hi = (np.array([[r[f"{n}{i}"] for i in range(len(pivots))] for r in rows]) for n in ("lo", "hi"))
        of[dim] = (np.array([r["block"] for r in rows]), np.array([r["n"] for r in rows]), np.array([r["len2"] for r in rows]), lo, hi)

    def sent(first: bool):
        """Rows (..., block) of the blocks that a query goes to: first those of the largest bounds that hold k others, then all others that its k-th best score leaves."""

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                dims, pts, len2, least = (batch.column(i) for i in (3, 4, 5, 6))
                at, to = [], []
                for i, (dim, pt, q2, tau) in enumerate(zip(dims.to_pylist(), pts.to_pylist(), len2.to_pylist(), least.to_pylist())):
                    block, n, c2, lo, hi = of[dim]
                    q = np.array(pt)
                    upper = _upper(np.maximum(0, np.maximum(q - hi, lo - q)).max(1), q2, c2)
                    order = np.argsort(-upper, kind="stable")
                    near = int(np.searchsorted(np.cumsum(n[order]), k + 1)) + 1
                    go = order[:near] if first else order[near:][upper[order[near:]] >= tau]
                    at += [i] * len(go)
                    to += block[go].tolist()
                for j in range(0, len(at), 4096):
                    part = batch.take(pa.array(at[j : j + 4096], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(to[j : j + 4096], pa.int32())], names=[*names, "block"])

        return run

    names = ["row", "id", "v", "dim", "pt", "len2", "least"]
    schema = "row long, id long, v array<long>, dim int, pt array<double>, len2 double, least double, block int"
    asks = vectors.where("asks").select(*names[:-1], F.lit(float("-inf")).alias("least"))
    best = materialize(_met(vectors, asks.mapInArrow(sent(True), schema), k), "topk-first")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    kth = best.withColumn("place", place).where(F.col("place") == k).select(F.col("row").alias("krow"), F.col("score").cast("double").alias("kth"))
    again = asks.drop("least").join(kth, F.col("row") == F.col("krow"), "left").select(*names[:-1], F.coalesce("kth", F.lit(float("-inf"))).alias("least"))
    more = materialize(again.mapInArrow(sent(False), schema), "topk-sent", "lz4")
    found = best.unionByName(_met(vectors, more, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
