import duckdb
import pytest

from millrace.config import Params
from millrace.operators import detect, reorder
from millrace.plans import catalog
from millrace.sources import tables
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("supplier", "lineitem", "events", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or v != v else v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(catalog.ORACLE_SQL[name])
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(at) == cols
    rows = [tuple(r[c] for c in cols) for r in got.collect()]
    told = [tuple(r[at[c]] for c in cols) for r in want.fetchall()]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(rows, key=key) == sorted(told, key=key)


def test_stream_equals_batch(spark):
    got = catalog.QUERIES["stream_scores"](spark, SF)
    ready = reorder.released(tables.arrivals(spark, SF)).withColumn("lts", F.col("ts"))
    want = detect.score(ready, Params(), F.lit(catalog.K))
    cols = ["machine", "oldest_lts", "ordinal", "probability"]
    a, b = got.select(cols), want.select(cols)
    assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()


def test_stream_equals_batch_on_values_that_are_no_numbers(spark, tmp_path):
    """NaN, infinities and nulls release their times; gaps hold; a second run goes on from the checkpoint."""
    from millrace.streaming import detector

    odd = {4: float("nan"), 7: float("inf"), 12: float("-inf"), 15: None}
    params = Params(window=3, transitions=2, delta=1)
    order = [0, 2, 1, 3, 5, 4, 6, 7, 9, 8, 10, 12, 11, 13, 14, 16, 15, 17, 18, 20, 21, 19, 23, 24]
    rows = [(m, 1, a, t, odd.get(t, float((t * t + m) % 5))) for m in (1, 2) for a, t in enumerate(order)]
    schema = "machine int, sensor int, arrival long, ts long, value double"
    for lo, hi in ((0, 9), (9, 10), (10, 99)):
        part = spark.createDataFrame([r for r in rows if lo <= r[2] < hi], schema).withColumn("lts", F.col("ts")).withColumn("k", F.col("machine") + 1)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        detector.run_available(stream, params, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out" / "scores"))
    ready = reorder.released(spark.createDataFrame(rows, schema)).withColumn("lts", F.col("ts"))
    want = detect.score(ready, params, F.col("machine") + 1)
    cols = ["machine", "oldest_lts", "ordinal", "probability"]
    a, b = sorted(map(tuple, got.select(cols).collect())), sorted(map(tuple, want.select(cols).collect()))
    assert a == b and len(a) == 2 * (22 - 4 - 2)


def test_partitions_hold_every_reading(spark):
    got = catalog.QUERIES["key_partition"](spark, SF).agg(F.sum("n"), F.sum("n_keys"), F.max("operator")).first()
    assert tuple(got) == (24000, 40, catalog.PARALLELISM - 1)


def test_windows_leave_out_what_is_no_number(spark):
    rows = [(1, 1, i, float("nan") if i == 2 else float(i)) for i in range(5)] + [(1, 1, 5, None)]
    df = spark.createDataFrame(rows, "machine int, sensor int, lts long, value double")
    assert [tuple(r) for r in detect.score(df, Params(window=4, transitions=2), F.lit(2)).select("oldest_lts", "ordinal").collect()] == [(0, 3)]
