"""Tables in the folder that all executors share, and lookups that hot keys can't slow down."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: A key with at least one in so many of all rows is hot; there are so many at most.
HOT = 1000
#: Up to so many rows of small numbers are broadcast.
FEW = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset a session in local mode gets a temporary folder, since driver and
    executors are one process there; any other session is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _LOCAL[app]


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str = "lz4", spent: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks that ran on it, never the chain
    of stages before the table. The path goes to ``spent``, for :func:`clear` to delete once
    nothing reads the table any more.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    if spent is not None:
        spent.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, spent: list[str]) -> None:
    """Deletes the tables at these paths, empties the list, and lets Spark forget what was made from them.

    Executors keep broadcasts and shuffle files until the driver's collector finds that nothing
    refers to them any more; a driver with little garbage of its own hardly ever looks.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in spent:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    spent.clear()
    gc.collect()
    jvm.java.lang.System.gc()


def few(table: DataFrame) -> DataFrame:
    """``table``, to be broadcast if it has FEW rows of a few numbers at most."""
    return F.broadcast(table) if table.count() <= FEW else table


def lookup(rows: DataFrame, key: str, table: DataFrame, tkey: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` on ``key`` = ``tkey``, where ``tkey`` is unique and some keys hold a large share of the rows.

    Rows of the hot keys, HOT at most by arithmetic, meet a broadcast of the table's rows for
    those; all others are joined by a shuffle. The names of both sides must differ. ``total``
    is the number of rows, counted if it isn't told. Rows with a null key meet nothing; in a left
    join, where they stay, they aren't shuffled.
    """
    if how == "left":
        apart = rows.where(F.col(key).isNull())
        for field in table.schema:
            apart = apart.withColumn(field.name, F.lit(None).cast(field.dataType))
        return lookup(rows.where(F.col(key).isNotNull()), key, table, tkey, "left_outer", total).unionByName(apart)
    total = rows.count() if total is None else total
    counts = rows.groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.where(F.col("__hot").isNotNull() & (F.col("__n") * HOT >= total)).select("__hot")
    split = lambda df, k, kind: df.join(F.broadcast(hot), F.col(k) == F.col("__hot"), kind)
    of_hot = split(rows, key, "left_semi").join(F.broadcast(split(table, tkey, "left_semi")), F.col(key) == F.col(tkey), how)
    of_rest = split(rows, key, "left_anti").join(split(table, tkey, "left_anti"), F.col(key) == F.col(tkey), how)
    return of_hot.unionByName(of_rest)
