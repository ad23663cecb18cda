"""Arrival-order semantics in closed form: warm-up, late readings, gaps, duplicates.

Input rows are (machine, sensor, arrival, ts, value); ``arrival`` counts a key's rows in the
order in which they came. A key's stream starts at the first arrival by which more than m
distinct times are there and the m times from the smallest on are contiguous. From then on
times are released one after the other, each as soon as it and all before it are there;
earlier ones come too late, and nothing passes a gap. Of rows with the same time the last
one that arrives before the release counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("machine", "sensor")


def _starts(rows: DataFrame, m: int, delta: int) -> DataFrame:
    """(machine, sensor, start_ts, warm): the time a key's stream starts with, and the arrival at which it does."""
    came = Window.partitionBy(*KEY).orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(*KEY, "ts").orderBy("arrival")) == 1
    at = rows.withColumn("new", first.cast("int")).select(
        *KEY, "arrival", F.min("ts").over(came).alias("start_ts"), F.sum("new").over(came).alias("times")
    )
    at = at.where(F.col("times") > m)
    there = rows.groupBy(*KEY, "ts").agg(F.min("arrival").alias("came"))
    for j in range(1, m):
        step = there.select(*KEY, (F.col("ts") - j * delta).alias("start_ts"), F.col("came").alias(f"came{j}"))
        at = at.join(step, [*KEY, "start_ts"]).where(F.col(f"came{j}") <= F.col("arrival"))
    return at.groupBy(*KEY).agg(F.min(F.struct("arrival", "start_ts")).alias("s")).select(
        *KEY, F.col("s.start_ts").alias("start_ts"), F.col("s.arrival").alias("warm")
    )


def classify_arrivals(rows: DataFrame, m: int = 1, delta: int = 1) -> DataFrame:
    """Every row with ``fate``: released, overwritten, late, blocked (behind a gap) or waiting (its key never started); and ``release``, the arrival that releases its time."""
    starts = _starts(rows, m, delta)
    times = rows.groupBy(*KEY, "ts").agg(F.min("arrival").alias("came"))
    by_time = Window.partitionBy(*KEY).orderBy("ts")
    run = times.join(starts, list(KEY)).where("ts >= start_ts").select(
        *KEY, "ts", "start_ts", "warm", "came", (F.row_number().over(by_time) - 1).alias("place")
    )
    run = run.withColumn("in_run", F.col("ts") - F.col("start_ts") == F.col("place") * delta)
    upto = by_time.rowsBetween(Window.unboundedPreceding, 0)
    run = run.withColumn("release", F.when(F.col("in_run"), F.greatest(F.max("came").over(upto), F.col("warm"))))
    out = rows.join(run.select(*KEY, "ts", "in_run", "release"), [*KEY, "ts"], "left").join(starts.select(*KEY, F.lit(True).alias("started")), list(KEY), "left")
    in_time = F.col("in_run") & (F.col("arrival") <= F.col("release"))
    last = F.max(F.when(in_time, F.col("arrival"))).over(Window.partitionBy(*KEY, "ts"))
    out = out.withColumn("last", last)
    fate = (
        F.when(F.col("started").isNull(), "waiting")
        .when(F.col("in_run").isNull(), "late")
        .when(~F.col("in_run"), "blocked")
        .when(F.col("arrival") > F.col("release"), "late")
        .when(F.col("arrival") == F.col("last"), "released")
        .otherwise("overwritten")
    )
    return out.withColumn("fate", fate).select(*KEY, "arrival", "ts", "value", "fate", "release")


def released(rows: DataFrame, m: int = 1, delta: int = 1) -> DataFrame:
    """(machine, sensor, ts, value, release, ordinal): what leaves the reordering, in order of time."""
    out = classify_arrivals(rows, m, delta).where("fate = 'released'")
    return out.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*KEY).orderBy("ts")) - 1).cast("long")).select(
        *KEY, "ts", "value", "release", "ordinal"
    )


def in_time_order(rows: DataFrame) -> DataFrame:
    """Everything in order of time, gaps and all, as a flush at the end gives it; of equal times the last arrival counts."""
    last = Window.partitionBy(*KEY, "ts").orderBy(F.desc("arrival"))
    one = rows.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")
    return one.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*KEY).orderBy("ts")) - 1).cast("long")).select(
        *KEY, "ts", "value", "ordinal"
    )


def count_sorted(rows: DataFrame, m: int = 1, parallelism: int = 1, delta: int = 1) -> DataFrame:
    """(machine, sensor, ts, value, ordinal, flushed) of the sorter by counts, end of stream included.

    Its warm-up waits for ``m`` contiguous times for each of ``parallelism`` parsers. At the
    end a key that never started passes on its contiguous run from the smallest time
    (``flushed``); nothing passes a gap even then.
    """
    fates = classify_arrivals(rows, m * parallelism, delta)
    in_time = fates.where("fate = 'released'").select(*KEY, "ts", "value", F.lit(False).alias("flushed"))
    last = fates.where("fate = 'waiting'").groupBy(*KEY, "ts").agg(F.max_by("value", "arrival").alias("value"))
    by_time = Window.partitionBy(*KEY).orderBy("ts")
    run = last.withColumn("in_run", F.col("ts") - F.min("ts").over(by_time) == (F.row_number().over(by_time) - 1) * delta)
    out = in_time.unionByName(run.where("in_run").select(*KEY, "ts", "value", F.lit(True).alias("flushed")))
    return out.withColumn("ordinal", (F.row_number().over(by_time) - 1).cast("long"))


def count_sorter_ends(rows: DataFrame, m: int = 1, parallelism: int = 1, delta: int = 1) -> DataFrame:
    """(machine, sensor, pending, passed): times left behind a gap at the end, and whether the end mark passes, as it does where none is."""
    fates = classify_arrivals(rows, m * parallelism, delta)
    there = fates.where("fate in ('blocked', 'waiting')").select(*KEY, "ts").distinct()
    sent = count_sorted(rows, m, parallelism, delta).where("flushed").select(*KEY, "ts")
    left = there.join(sent, [*KEY, "ts"], "left_anti").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    keys = rows.select(*KEY).distinct().join(left, list(KEY), "left")
    return keys.select(*KEY, F.coalesce("n", F.lit(0)).cast("long").alias("pending"), F.col("n").isNull().alias("passed"))


def time_sorted(rows: DataFrame, m: int = 1, delta: int = 1, delay: int = 0) -> DataFrame:
    """(machine, sensor, ts, value, flushed, ordinal) of the sorter by time, for rows (machine, sensor, arrival, clock, ts, value).

    ``clock`` is the wall clock at an arrival. A key starts at the first arrival that brings no
    new smallest time, ``delay`` or more after the one that did, if the (m + 1)-th of the
    times there is the smallest plus m * delta. From then on times are released one after the other.
    Late rows aren't dropped: the first of them blocks all output until the end, when all that is
    left is flushed in order of time, gaps and late rows included.
    """
    times = rows.groupBy(*KEY, "ts").agg(F.min("arrival").alias("came"), F.min_by("clock", "arrival").alias("clock"))
    by_time = Window.partitionBy(*KEY).orderBy("ts")
    near = times.withColumn("near", F.collect_list(F.struct("ts", "came")).over(by_time.rangeBetween(0, m * delta)))
    came = lambda test: F.transform(F.filter("near", test), lambda x: x["came"])
    before = F.array_sort(came(lambda x: x["ts"] < F.col("ts") + m * delta))
    starts = near.select(
        *KEY,
        F.col("ts").alias("least"),
        F.col("came").alias("least_came"),
        (F.col("clock") + delay).alias("from_clock"),
        # Exactly m times below the one that is waited for are there from ``lo`` on and before ``hi``.
        F.greatest(F.get(came(lambda x: x["ts"] == F.col("ts") + m * delta), F.lit(0)), F.get(before, F.lit(m - 1))).alias("lo"),
        F.get(before, F.lit(m)).alias("hi"),
        (F.size(before) >= m).alias("enough"),
        (F.array_max(F.col("near")["ts"]) == F.col("ts") + m * delta).alias("met"),
    ).where("enough and met")
    so_far = Window.partitionBy(*KEY).orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.select(*KEY, "arrival", "clock", F.min("ts").over(so_far).alias("least"), (F.count(F.lit(1)).over(so_far) == 1).alias("first"))
    at = at.join(starts, [*KEY, "least"]).where("(arrival > least_came or first) and clock >= from_clock and arrival >= lo and (hi is null or arrival < hi)")
    begun = at.groupBy(*KEY).agg(F.min(F.struct("arrival", "least")).alias("s")).select(*KEY, F.col("s.arrival").alias("warm"), F.col("s.least").alias("start_ts"))

    run = times.join(begun, list(KEY)).where("ts >= start_ts").withColumn("place", F.row_number().over(by_time) - 1)
    upto = by_time.rowsBetween(Window.unboundedPreceding, 0)
    run = run.where(F.col("ts") - F.col("start_ts") == F.col("place") * delta).select(*KEY, "ts", F.greatest(F.max("came").over(upto), "warm").alias("release"))
    told = rows.join(run, [*KEY, "ts"], "left").join(begun, list(KEY), "left")
    late = (F.col("arrival") > F.col("warm")) & ((F.col("ts") < F.col("start_ts")) | (F.col("arrival") > F.col("release")))
    told = told.withColumn("blocked", F.min(F.when(late, F.col("arrival"))).over(Window.partitionBy(*KEY)))
    sent = F.col("release").isNotNull() & (F.col("blocked").isNull() | (F.col("release") < F.col("blocked")))
    told = told.withColumn("flushed", ~(sent & (F.col("arrival") <= F.col("release"))))
    out = told.groupBy(*KEY, "ts", "flushed").agg(F.max_by("value", "arrival").alias("value"))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("flushed", "ts")) - 1
    return out.select(*KEY, "ts", "value", "flushed", place.cast("long").alias("ordinal"))


def dedup_messages(messages: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """One row per message id, the first by ``order_col``; on a stream use dropDuplicates with a watermark."""
    first = messages.groupBy(id_col).agg(F.min(order_col).alias("__first"))
    return messages.join(first.withColumnRenamed(id_col, "__id"), (F.col(id_col) == F.col("__id")) & (F.col(order_col) == F.col("__first"))).drop("__id", "__first")
