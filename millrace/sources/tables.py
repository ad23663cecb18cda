"""The star-schema tables seen as sensor streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.windows import global_index

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
SENSORS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def groups(spark: SparkSession, sf_dir: str, spent: list[str] | None = None) -> DataFrame:
    """One observation group per line item: (lts, machine, shipped, and the four measures)."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *ORDER, "l_discount", "l_tax")
    return global_index(items, ["l_orderkey", *ORDER], "lts", spent).withColumn("machine", F.col("l_suppkey").cast("int"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings (machine, sensor, lts, value): the four measures of each group as sensors 1 to 4."""
    measures = F.array(*[F.struct(F.lit(i).alias("sensor"), F.col(c).alias("value")) for i, c in enumerate(SENSORS, 1)])
    return groups(spark, sf_dir).select("machine", "lts", F.inline(measures)).select("machine", "sensor", "lts", "value")


def arrivals(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """Events per user, with times 0, 1, 2, ... and an order of arrival that disturbs them a little.

    With ``gaps`` every 37th reading never arrives.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    mine = Window.partitionBy("user_id")
    rows = events.withColumn("t", (F.row_number().over(mine.orderBy("ts", "event_id")) - 1).cast("long"))
    if gaps:
        rows = rows.where("t % 37 <> 36")
    arrival = (F.row_number().over(mine.orderBy(F.col("t") + F.col("event_id") * 7 % 6, "event_id")) - 1).cast("long")
    return rows.select(F.col("user_id").cast("int").alias("machine"), F.lit(0).alias("sensor"), arrival.alias("arrival"), F.col("t").alias("ts"), "value")
