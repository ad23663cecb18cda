"""Scores of windows, thresholds, completeness and ordered output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.config import Params
from millrace.functions import markov
from millrace.operators.metadata import sensors_per_machine
from millrace.operators.windows import KEY, global_index, map_windows, sliding_windows
from millrace.sources.shared import clear, few, materialize


def score(readings: DataFrame, params: Params, k: Column, native: bool = False) -> DataFrame:
    """SCORE rows of all full windows; ``k`` is told by the key. ``native`` scores by expression instead of Arrow."""
    if not native:
        return map_windows(readings.withColumn("k", k), params.window, markov.score_columns(params), "probability", "double")
    wins = sliding_windows(readings, params.window).withColumn("k", k)
    p = markov.probability_expr(markov.labels_expr(F.col("win"), F.col("k"), params), params)
    return wins.select(*KEY, "oldest_lts", "ordinal", p.alias("probability"))


def below(scores: DataFrame, theta: float) -> DataFrame:
    return scores.where(F.col("probability") < theta)


def below_own(scores: DataFrame, metadata: DataFrame) -> DataFrame:
    """Scores below the threshold of their own sensor. ``metadata`` has one row per sensor; Spark broadcasts it where it is small."""
    own = metadata.select("machine", "sensor", "pt").distinct()
    return scores.join(own, ["machine", "sensor"]).where(F.col("probability") < F.col("pt"))


def complete_times(scores: DataFrame, sensors: int | DataFrame) -> DataFrame:
    """Logical times for which every sensor has its score.

    ``sensors`` is one number for all machines, or what :func:`millrace.operators.metadata.sensors_per_machine` gives; machines it
    doesn't name never complete a time. A logical time of several machines is an error.
    """
    shared = F.raise_error(F.concat(F.lit("several machines share logical time "), F.col("oldest_lts").cast("string"))).cast("int")
    machine = F.when(F.min("machine") == F.max("machine"), F.min("machine")).otherwise(shared)
    arrived = scores.groupBy("oldest_lts").agg(F.count(F.lit(1)).alias("arrived"), machine.alias("machine"))
    if isinstance(sensors, DataFrame):
        arrived = arrived.join(sensors.select("machine", "sensors"), "machine")
    else:
        arrived = arrived.withColumn("sensors", F.lit(sensors))
    return arrived.where("arrived = sensors and machine is not null").select("oldest_lts")


def first_gap(complete: DataFrame, start: int = 0, width: int = 1 << 20) -> int:
    """The smallest logical time from ``start`` on that isn't among the distinct ones in ``complete``.

    Times are sorted by spans of ``width``; the driver sees, span by span, how far each is filled.
    """
    t = complete.where(F.col("oldest_lts") >= start).select((F.col("oldest_lts") - start).alias("t"))
    t = t.select("t", F.floor(F.col("t") / width).alias("span"))
    place = F.row_number().over(Window.partitionBy("span").orderBy("t")) - 1
    filled = t.withColumn("in_line", F.col("t") - F.col("span") * width == place)
    spent: list[str] = []
    spans = materialize(filled.groupBy("span").agg(F.count_if("in_line").alias("filled")).where("filled > 0"), "spans", spent=spent)  # a sort reads them twice
    gap = start
    for row in spans.orderBy("span").toLocalIterator():
        if row["span"] * width != gap - start:
            break
        gap += row["filled"]
    clear(complete.sparkSession, spent)
    return gap


def number_anomalies(anomalies: DataFrame) -> DataFrame:
    """Adds ``anomaly_id`` in the order of time and sensor; no task sees them all."""
    return global_index(anomalies, ["oldest_lts", "sensor", "machine"], "anomaly_id")


def emit(scores: DataFrame, params: Params, sensors: int | DataFrame, flush: bool = False) -> DataFrame:
    """Anomalies of the complete prefix of logical times, numbered; with ``flush`` those behind a gap too.

    Scores are written once, so that windows aren't cut again for the output.
    """
    if not flush:
        scores = materialize(scores, "scores")
    out = below(scores, params.theta)
    if not flush:
        out = out.where(F.col("oldest_lts") < first_gap(complete_times(scores, sensors)))
    return number_anomalies(out).withColumn("timestamp", F.col("ordinal") - params.transitions)


def emit_single(scores: DataFrame, theta: float, start: int = 0) -> DataFrame:
    """The simpler barrier: one score of a logical time is enough to pass it. Anomalies of the prefix of times that have any score, numbered.

    Of a time with several scores the first to arrive counts (``arrival``); the others are an
    error there, and left out here.
    """
    first = scores.groupBy("oldest_lts").agg(F.min_by(F.struct(*[c for c in scores.columns if c != "oldest_lts"]), "arrival").alias("s"))
    first = materialize(first.select("oldest_lts", "s.*"), "scores")
    gap = first_gap(first.select("oldest_lts"), start)
    return number_anomalies(below(first.where((F.col("oldest_lts") >= start) & (F.col("oldest_lts") < gap)), theta))


def terminated(ends: DataFrame, expected: DataFrame) -> DataFrame:
    """(machine, ended, sensors, done) of the end marks (machine, sensor) that came, and of all machines in ``expected`` (machine, sensors).

    A machine is done when as many distinct sensors have ended as it has; a mark that comes
    twice counts once, and marks of unknown machines don't count.
    """
    came = ends.groupBy("machine").agg(F.countDistinct("sensor").alias("ended"))
    out = expected.select("machine", "sensors").join(came, "machine", "left").withColumn("ended", F.coalesce("ended", F.lit(0)).cast("long"))
    return out.select("machine", "ended", F.col("sensors").cast("long").alias("sensors"), (F.col("ended") == F.col("sensors")).alias("done"))


def score_known(readings: DataFrame, metadata: DataFrame, params: Params) -> DataFrame:
    """SCORE rows of the sensors that ``metadata`` (machine, sensor, k, ...) knows, each with its own number of clusters."""
    own = metadata.select("machine", "sensor", "k").distinct()
    return score(readings.join(few(own), ["machine", "sensor"]), params, F.col("k"))


def detect(readings: DataFrame, metadata: DataFrame, params: Params) -> DataFrame:
    """The whole detection: known sensors, their own numbers of clusters, times complete by each machine's sensors, numbered anomalies."""
    return emit(score_known(readings, metadata, params), params, sensors_per_machine(metadata))
