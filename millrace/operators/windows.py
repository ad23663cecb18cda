"""Order, ordinals and count-based sliding windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.markov import CHUNK
from millrace.sources.shared import clear, materialize

KEY = ("machine", "sensor")


def global_index(df: DataFrame, order: list[str], name: str, spent: list[str] | None = None) -> DataFrame:
    """Adds the 0-based position of each row in the order of the columns ``order``, nulls first.

    Spark deals the rows into ranges of that order by a sample, so neither an outlier nor a
    frequent value makes a range large; each range is sorted by itself and written once with
    its number and the rows' places in it. Only the sizes of the ranges, a row each, come together.
    The path of that table goes to ``spent``.
    """
    spark = df.sparkSession
    r, i, n, before = "__range", "__place", "__rows", "__before"
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id that Spark gives is the number of the partition, shifted, plus the place in it.
    placed = dealt.withColumn(i, F.monotonically_increasing_id()).withColumn(r, F.shiftright(i, 33))
    placed = materialize(placed.withColumn(i, F.col(i).bitwiseAND((1 << 33) - 1)), "index", spent=spent)
    clear(spark, [])  # the shuffle's files
    at, starts = 0, []
    for row in sorted(placed.groupBy(r).agg(F.count(F.lit(1)).alias(n)).collect(), key=lambda x: x[r]):
        starts.append((row[r], at))
        at += row[n]
    told = spark.createDataFrame(starts, f"__r long, {before} long")
    joined = placed.join(F.broadcast(told), F.col(r) == F.col("__r"))
    return joined.withColumn(name, F.col(i) + F.col(before)).drop(r, i, "__r", before)


def sliding_windows(readings: DataFrame, size: int, order: str = "lts", full_only: bool = True) -> DataFrame:
    """(machine, sensor, oldest_lts, newest_lts, ordinal, win): the ``size`` readings up to each, oldest first.

    Readings whose value isn't a finite number are left out before windows are cut.
    """
    clean = readings.where(is_number(F.col("value")))
    by = Window.partitionBy(*KEY).orderBy(order)
    frame = by.rowsBetween(-(size - 1), 0)
    out = clean.select(
        *KEY,
        F.first("lts").over(frame).alias("oldest_lts"),
        F.col("lts").alias("newest_lts"),
        (F.row_number().over(by) - 1).cast("long").alias("ordinal"),
        F.collect_list("value").over(frame).alias("win"),
    )
    return out.where(F.col("ordinal") >= size - 1) if full_only else out


def map_windows(readings: DataFrame, size: int, made, name: str, kind: str, order: str = "lts") -> DataFrame:
    """(machine, sensor, oldest_lts, ordinal, ``name``) of each full window of ``size`` readings, by an Arrow kernel.

    ``made(x, k)`` gives an Arrow array for windows in the columns of ``x``; ``k`` is a column of
    ``readings``, and a sensor told with several has windows for each. Readings, not windows, go to Python: they are
    dealt by key and sorted once, and a batch takes the last readings of the one before along.
    Readings whose value isn't a finite number are left out before windows are cut.
    """
    names = ["machine", "sensor", "oldest_lts", "ordinal", name]

    def run(batches):
        tail, before = None, 0  # the last readings, and the place of the first of them in its key
        for batch in batches:
            old = 0 if tail is None else tail.num_rows
            rows = batch if not old else pa.concat_batches([tail, batch])
            if not batch.num_rows:
                continue
            fresh = np.ones(rows.num_rows, dtype=bool)
            fresh[1:] = False
            for c in (rows.column(0), rows.column(1), rows.column(4)):
                known, key = c.is_valid().to_numpy(zero_copy_only=False), c.fill_null(0).to_numpy(zero_copy_only=False)
                fresh[1:] |= (key[1:] != key[:-1]) | (known[1:] != known[:-1])
            at = np.arange(rows.num_rows)
            start = np.maximum.accumulate(np.where(fresh, at, 0))
            ends = np.flatnonzero((at - start >= size - 1) & (at >= old))
            value, k = rows.column(3).to_numpy(zero_copy_only=False), rows.column(4).to_numpy(zero_copy_only=False)
            for i in range(0, len(ends), CHUNK):
                e = ends[i : i + CHUNK]
                first = e - (size - 1)
                x = value[first + np.arange(size)[:, None]]
                ordinal = e - start[e] + np.where(start[e] == 0, before, 0)
                keys = [rows.column(0).take(pa.array(e)), rows.column(1).take(pa.array(e)), rows.column(2).take(pa.array(first))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(ordinal, pa.int64()), made(x, k[e])], names=names)
            left = max(start[-1], rows.num_rows - max(size - 1, 1))
            before = left - start[-1] + (before if start[-1] == 0 else 0)
            tail = rows.slice(left)

    clean = readings.where(is_number(F.col("value"))).select(
        *[F.col(c).cast("int").alias(c) for c in KEY], F.col("lts").cast("long").alias("lts"), F.col("value").cast("double").alias("value"),
        F.col("k").cast("int").alias("k"), *([order] if order != "lts" else []),
    )
    dealt = clean.repartition(*KEY).sortWithinPartitions(*KEY, "k", order).select(*KEY, "lts", "value", "k")
    return dealt.mapInArrow(run, f"machine int, sensor int, oldest_lts long, ordinal long, {name} {kind}")


def is_number(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def lag_pairs(readings: DataFrame, order: str = "lts") -> DataFrame:
    """Each reading with the one before it of its key, and whether their logical times follow one another."""
    by = Window.partitionBy(*KEY).orderBy(order)
    out = readings.select(*KEY, "lts", "value", F.lag("lts").over(by).alias("prev_lts"), F.lag("value").over(by).alias("prev_value"))
    return out.withColumn("contiguous", F.col("prev_lts") + 1 == F.col("lts"))
