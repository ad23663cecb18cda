"""Shared plumbing: names, gapless distributed ranks, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.sources.shared import clear, lookup, materialize, shared_path

__all__ = ["bound_batches", "clear", "connected_components", "fresh", "gapless_rank", "in_slices", "lookup", "materialize", "read_table", "shared_path"]


#: Rows of an Arrow batch at most: whole texts travel in them, and both sides hold a batch in memory.
ARROW_ROWS = 4096


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ARROW_ROWS rows where they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that ``df`` has no column of, whatever the case: the given ones with underscores behind as needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Returns what a Python worker has freed to the system, where the C library can: a reused worker keeps it from stage to stage else."""
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_slices(batches, rows: int = 512):
    """Arrow batches in slices, so that what Python makes of one stays small; buffers are shared, not copied."""
    import pyarrow as pa

    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
        pa.default_memory_pool().release_unused()
    give_back()


def gapless_rank(df: DataFrame, key: Column, order: list[Column], salt: Column, chunks: int, name: str) -> DataFrame:
    """Adds ``name``: 0-based gapless position of each row within its ``key``.

    A plain ``row_number`` over ``key`` would put a key that holds a third of all rows into
    one task. Rows are dealt by (key, ``salt`` modulo ``chunks``) instead; the sizes of those
    cells, one row each, give each cell its offset. Nulls in ``key`` form a key of their own.
    """
    k, c, r, ok, oc, n, before = fresh(df, "__k", "__c", "__r", "__ok", "__oc", "__n", "__before")
    cell = df.withColumn(k, key).withColumn(c, F.pmod(salt, F.lit(chunks)).cast("int"))
    sizes = cell.groupBy(k, c).agg(F.count(F.lit(1)).alias(n))
    sooner = Window.partitionBy(k).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(k).alias(ok), F.col(c).alias(oc), F.coalesce(F.sum(n).over(sooner), F.lit(0)).alias(before))
    ranked = cell.withColumn(r, F.row_number().over(Window.partitionBy(k, c).orderBy(*order)) - 1)
    joined = ranked.join(offsets, F.col(k).eqNullSafe(F.col(ok)) & (F.col(c) == F.col(oc)), "left")
    return joined.withColumn(name, (F.col(r) + F.col(before)).cast("long")).drop(k, c, r, ok, oc, before)


def connected_components(edges: DataFrame, label: str = "components", spent: list[str] | None = None) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): the smallest id reachable.

    Rounds of hooking each component to its smallest neighbour, then pointer jumping until
    every chain is flat, then contraction. Every step is an aggregation with map-side combine
    or an equi-join on a table that shrinks; links never leave the executors. In a large
    component many rows point to one hub; its partition of a join is one that the adaptive
    planner splits, as no step after the join needs its order. Tables of past rounds are deleted.
    The table of the result goes to the caller's ``spent``.
    """
    spark = edges.sparkSession
    past: list[str] = []  # what the next round reads last
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    live = materialize(ordered(edges), label, spent=past)
    of_found: list[str] = []
    found = live.select(F.col("a").alias("id")).union(live.select(F.col("b").alias("id"))).distinct()
    found = materialize(found.select("id", F.col("id").alias("component")), label, spent=of_found)
    while not live.isEmpty():
        # Each component points at its smallest neighbour, if that is smaller.
        hooks = materialize(live.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to")), label, spent=past)
        while True:
            up = hooks.select(F.col("id").alias("uid"), F.col("to").alias("uto"))
            jumped = hooks.join(up, F.col("to") == F.col("uid"), "left").select(
                "id", F.coalesce("uto", "to").alias("to"), F.col("uto").isNotNull().alias("moved")
            )
            jumped = materialize(jumped, label, spent=past)
            hooks = jumped.select("id", "to")
            if jumped.where("moved").isEmpty():
                break
        found = (
            found.join(hooks.select(F.col("id").alias("hid"), "to"), F.col("component") == F.col("hid"), "left")
            .select("id", F.coalesce("to", "component").alias("component"))
        )
        past += of_found
        of_found = []
        found = materialize(found, label, spent=of_found)
        ends = live
        for end in ("a", "b"):
            to = hooks.select(F.col("id").alias("hid"), F.col("to").alias("hto"))
            ends = ends.join(to, F.col(end) == F.col("hid"), "left").withColumn(end, F.coalesce("hto", end)).select("a", "b")
        left: list[str] = []
        live = materialize(ordered(ends), label, spent=left)
        clear(spark, past)
        past = left
    clear(spark, past)
    if spent is not None:
        spent += of_found
    return found.select("id", "component")
