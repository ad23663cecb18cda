"""Sensor metadata: the graph pattern, checks and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.schema import IOT, SSN, TYPE, WMD


def match_pattern(triples: DataFrame) -> DataFrame:
    """METADATA rows of the pattern machine-model-sensor with type, clusters and threshold; inner joins, bag semantics.

    Each pattern is a selection of the triples by predicate; Spark orders the joins and
    broadcasts the sides that are small.
    """
    of = lambda p, s, o: triples.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))
    machine = of(IOT + "hasModel", "m", "model").join(of(TYPE, "m", "mtype"), "m")
    sensor = machine.join(of(SSN + "hasProperty", "model", "sen"), "model")
    sensor = sensor.join(of(TYPE, "sen", "stype"), "sen").join(of(WMD + "hasNumberOfClusters", "sen", "k"), "sen")
    full = sensor.join(of(WMD + "isThresholdForProperty", "pts", "sen"), "sen").join(of(IOT + "valueLiteral", "pts", "pt"), "pts")
    literal = lambda c: F.regexp_replace(F.substring_index(c, "^", 1), '"', "")
    kind = F.regexp_extract("mtype", r"#(\w)", 1)
    return full.select(
        F.regexp_extract("m", r"Machine_(\d+)$", 1).cast("int").alias("machine"),
        F.when(kind == "M", "MOLDING").when(kind == "A", "ASSEMBLY").alias("type"),
        F.regexp_extract("sen", r"#_(\d+)_(\d+)$", 2).cast("int").alias("sensor"),
        literal(F.col("k")).cast("int").alias("k"),
        literal(F.col("pt")).cast("double").alias("pt"),
    )


def conflicts(metadata: DataFrame) -> DataFrame:
    """Sensors told more than one type, number of clusters or threshold."""
    return (
        metadata.groupBy("machine", "sensor")
        .agg(F.countDistinct("type").alias("types"), F.countDistinct("k").alias("ks"), F.countDistinct("pt").alias("pts"))
        .where("types > 1 or ks > 1 or pts > 1")
    )


def checked(metadata: DataFrame) -> DataFrame:
    """The distinct rows; an error if a sensor is told in two ways."""
    bad = conflicts(metadata).limit(3).collect()
    if bad:
        raise ValueError(f"conflicting metadata: {bad}")
    return metadata.distinct()


def statistics(metadata: DataFrame) -> DataFrame:
    """(name, value): rows (as a bag), machines, sensors, least threshold and the digits it needs, mean k, shares of the most and least frequent k and sensor number."""
    plain = metadata.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.countDistinct("machine").cast("double").alias("machines"),
        F.countDistinct("machine", "sensor").cast("double").alias("sensors"),
        F.min("pt").alias("min_pt"),
        (1 - F.ceil(F.log10(F.min("pt")))).cast("double").alias("digits"),
        F.avg("k").alias("mean_k"),
    )
    ends = lambda c, name: histogram(metadata, c).agg(F.max("share").alias(f"max_{name}"), F.min("share").alias(f"min_{name}"))
    long = lambda df: df.unpivot([], df.columns, "name", "value")
    return long(plain).unionByName(long(ends("k", "share"))).unionByName(long(ends("sensor", "sensor_share")))


def histogram(metadata: DataFrame, column: str) -> DataFrame:
    """(value, n, share): how often each value of a column stands among the rows."""
    counted = metadata.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("value", "n", (F.col("n") / F.lit(metadata.count())).alias("share"))


def sensors_per_machine(metadata: DataFrame) -> DataFrame:
    """(machine, sensors): the distinct sensors of each machine."""
    return metadata.groupBy("machine").agg(F.countDistinct("sensor").alias("sensors"))


def described(metadata: DataFrame) -> DataFrame:
    """(machine, text): a line for each machine, its sensors with clusters and threshold in order."""
    sensor = F.format_string("%04d(k=%02d,pt=%.4f)", "sensor", "k", "pt")
    each = metadata.distinct().groupBy("machine").agg(F.array_sort(F.collect_list(sensor)).alias("all"))
    return each.select("machine", F.concat(F.format_string("%04d: ", "machine"), F.array_join("all", " ")).alias("text"))


def clusters_by_sensor(metadata: DataFrame) -> DataFrame:
    """The distinct numbers of clusters told for each sensor number, ascending."""
    return metadata.groupBy("sensor").agg(F.sort_array(F.collect_set("k")).alias("ks"))


def relevant(readings: DataFrame, metadata: DataFrame) -> DataFrame:
    """Readings of sensors that metadata knows."""
    return readings.join(metadata.select("machine", "sensor").distinct(), ["machine", "sensor"], "left_semi")
