"""Forms that the large tables need, against the plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.config import Params
from millrace.functions import lines, markov
from millrace.operators import detect, windows
from millrace.plans import catalog
from millrace.sources import graph, shared

SF = "/root/testdata/sf0.001"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def readings(spark):
    rng = np.random.default_rng(5)
    keys = [(None, 1), (1, 1), (1, 2), (2, 1), (3, 1), (4, 7)]
    rows = [(m, s, t, float(rng.integers(0, 9))) for m, s in keys for t in range(3 + 4 * (s + (m or 0)))]
    rows += [(1, 1, 90, float("nan")), (1, 1, 91, None), (2, 1, 92, float("inf")), (1, 1, 94, 0.0)]
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, 3)  # windows reach over many batches
    yield spark.createDataFrame(rows, "machine int, sensor int, lts long, value double").repartition(3)
    spark.conf.set(BATCH, before)


def test_first_labels_of_readings_equal_the_expression_form(spark, readings):
    for size in (1, 2, 5):
        wins = windows.sliding_windows(readings, size)
        text = F.array_join(markov.assign_expr(F.col("win"), markov.seeds_expr(F.col("win"), F.lit(3))).cast("array<string>"), ",")
        want = wins.select("machine", "sensor", "oldest_lts", "ordinal", text.alias("labels"))
        got = windows.map_windows(readings.withColumn("k", F.lit(3)), size, markov.first_labels, "labels", "string")
        assert got.count() == want.count() > 0 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert markov.text_of_labels(np.array([[10, 0], [3, 1]])).to_pylist() == ["10,3", "0,1"]


def test_first_labels_need_no_windows_of_rows(spark):
    """readings go to the kernel; no array is collected for each of them."""
    assert "collect_list" not in plan_of(catalog.QUERIES["kmeans_assign"](spark, SF))


def test_scores_of_readings_equal_those_of_windows(spark, readings):
    """and a sensor told with two numbers of clusters has its windows with either."""
    params = Params(window=4, transitions=2)
    told = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 2), (4, 7, 4)], "machine int, sensor int, k int")
    wins = windows.sliding_windows(readings, 4).join(told, ["machine", "sensor"])
    want = wins.select("machine", "sensor", "oldest_lts", "ordinal", markov.probability_udf(params)("win", "k").alias("probability"))
    scored = detect.score_known(readings, told, params)
    assert scored.count() == want.count() > 0 and scored.exceptAll(want).isEmpty()
    assert "collect_list" not in plan_of(scored)


def test_media_reads_need_no_joins(spark):
    """op10: what the headers and the contents tell travels with the address."""
    media = pytest.importorskip("millrace.llm.media")
    where = media.store_media(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string"))[1]
    both = media.media_contents(media.media_metadata(where))
    assert both.columns[:4] == where.columns and both.count() == 2 and "Join" not in plan_of(both)


def test_facts_of_a_message_equal_their_joins(spark):
    """bags of facts, ids that come twice, marks twice in a line, and no shuffle of facts."""
    from tests.test_graph import group

    plain = group(spark).first()["payload"].split("\n")
    value, prop, time = plain[15], plain[11], plain[1]
    odd = plain + [value.replace("-0.04", "7"), value.replace("-0.04", "x"), prop, time.replace("Timestamp_0", "Timestamp_5"), value.replace("Value_1", "Thing"), prop + prop]
    rows = [(1, plain), (2, odd), (3, odd[::-1]), (4, plain[:12]), (4, plain[12:]), (4, plain[1:2]), (5, ["no message"]), (6, ["~~Termination Message~~"]), (None, plain)]
    for told in (rows, rows[:4] + rows[6:]):
        messages = spark.createDataFrame([(g, "\n".join(p)) for g, p in told], "group long, payload string")
        want = sorted(map(str, graph.join_facts(graph.triple_facts(messages)).collect()))
        assert sorted(map(str, graph.parse_facts(messages).collect())) == want and len(want) > 10
    assert "Join" not in plan_of(graph.parse_facts(messages))


def test_marks_are_looked_for_once(spark):
    """a message is made into text once, though filters and several columns read it; lines are found as a filter of all lines does."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(x):
        made.add(1)
        return x

    from tests.test_graph import group

    whole = group(spark).first()["payload"]
    rows = spark.createDataFrame([(i, whole) for i in range(5)], "group long, raw string").coalesce(1)
    known = spark.createDataFrame([(59, 31)], "machine int, sensor int")
    messages = rows.withColumn("payload", text("raw"))
    assert len(graph.parse_any_order(messages, known=known).collect()) == 5 and made.value == 5
    for t in (whole, "", "a", "\n", "#x\n\n#x#x\nb #x", "#x"):
        assert lines.lines_with(t, "#x") == [x for x in t.split("\n") if "#x" in x]
    assert [lines.whole(x, 32) for x in (" 7", "+7", "-2147483648", "2147483648", "7.0", "", "7_0")] == [7, 7, -(1 << 31), None, None, None, None]


def test_live_messages_are_on_no_disk(spark, tmp_path, monkeypatch):
    """tables that the stream is made of hold groups; rendered text is nowhere, and tables that nothing reads any more are gone."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    catalog.QUERIES["detect_live"](spark, SF)
    found = glob.glob(f"{tmp_path}/**/*.parquet", recursive=True)
    columns = {c for f in found for c in pq.read_schema(f).names}
    assert "arrival" in columns and "payload" not in columns
    assert len(glob.glob(f"{tmp_path}/index-*")) == 1 and not glob.glob(f"{tmp_path}/groups-*")  # the anomalies' own


def test_waiting_times_are_asked_for_once():
    """one question to the state's server for all times that wait, not one a reading."""
    from millrace.streaming.detector import _Waiting

    class State:
        def __init__(self):
            self.held, self.asked = {(3,): (1.5, 3), (4,): (2.5, 4)}, 0

        def exists(self):
            return True

        def keys(self):
            self.asked += 1
            return iter(list(self.held))

        def getValue(self, k):
            return self.held[k]

        def removeKey(self, k):
            del self.held[k]

        def updateValue(self, k, v):
            self.held[k] = v

    waiting = _Waiting(state := State())
    waiting[5] = (9.0, 5)
    waiting[4] = (8.0, 4)
    assert 2 not in waiting and 3 in waiting and sorted(waiting) == [3, 4, 5] and len(waiting) == 3
    assert waiting.pop(3) == (1.5, 3) and 3 not in waiting and waiting.pop(4) == (8.0, 4) and 4 not in waiting
    waiting.store()
    assert state.held == {(5,): (9.0, 5)} and state.asked == 1


def test_closed_scores_are_deleted(spark, tmp_path):
    """once an epoch's scores are all behind the output, the next epoch deletes them."""
    from millrace.streaming.detector import OutputBarrier

    schema = "machine int, sensor int, oldest_lts long, ordinal long, probability double"
    barrier = OutputBarrier(str(tmp_path), Params(), 1)
    for epoch in range(3):
        batch = spark.createDataFrame([(1, 1, epoch, epoch + 9, 0.001)], schema)
        barrier(batch, epoch)
        barrier(batch, epoch)  # an epoch may run again
    assert sorted(p.name for p in (tmp_path / "scores").iterdir()) == ["2"]
    assert sorted(r["oldest_lts"] for r in barrier.emitted(spark).collect()) == [0, 1, 2]


def test_readings_reach_the_state_packed_by_bucket():
    """a chunk's readings of a bucket are one row, whatever their number; nulls and order are kept."""
    import pyarrow as pa

    from millrace.streaming import detector

    rng = np.random.default_rng(1)
    n, names = 5000, ["bucket", "machine", "sensor", "arrival", "ts", "lts", "value", "k"]
    machine = [None if m == 3 else int(m) for m in rng.integers(0, 9, n)]
    columns = [[(m or 0) % 4 for m in machine], machine, rng.integers(0, 5, n).tolist(), *(rng.integers(-(1 << 40), 1 << 40, n).tolist() for _ in range(3)), rng.random(n).tolist(), [3] * n]
    columns[6][7] = None
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    packed = list(detector.pack([whole.slice(0, 1200), whole.slice(1200, 0), whole.slice(1200)]))
    assert len(packed) == 1 and packed[0].column(0).to_pylist() == [0, 1, 2, 3]
    for bucket, text in zip(*(c.to_pylist() for c in packed[0].columns)):
        want = [r for r in zip(*columns) if r[0] == bucket]
        got = detector._unpacked(text)
        assert [(None if x & 1 else m) for x, m in zip(got["nulls"].tolist(), got["machine"].tolist())] == [r[1] for r in want]
        for at, name in enumerate(names[2:6], 2):
            assert got[name].tolist() == [r[at] for r in want]
        assert np.array_equal(got["value"], np.array([r[6] for r in want], dtype=float), equal_nan=True)
    with pytest.raises(ValueError, match="without time"):
        next(detector.pack([whole.set_column(4, "ts", pa.nulls(n, pa.int64()))]))


@pytest.mark.parametrize("m", [1, 3])
def test_release_at_once_equals_one_by_one(m):
    """late, doubled, missing and odd times, over several batches."""
    import random

    from millrace.streaming.detector import KeyedDetector

    rnd, params = random.Random(m), Params(delta=10, min_sequence=m)
    for case in range(400):
        times = [10 * t for t in range(30) if rnd.random() > 0.03 * (case % 3)]
        times += rnd.choices(times, k=case % 2) + [rnd.randrange(300)] * (case % 7 == 0)
        times.sort(key=lambda t: t + 10 * rnd.random() * rnd.choice([0, 1, 3, 6]))
        rows = [(t, float(i), i + 100) for i, t in enumerate(times)]
        one, many, cut = KeyedDetector(params, 2), KeyedDetector(params, 2), [0, *sorted(rnd.choices(range(len(rows)), k=2)), len(rows)]
        for a, z in zip(cut, cut[1:]):
            want = [r for row in rows[a:z] for r in one.push(*row)]
            value, lts = many.release(*(np.array([r[i] for r in rows[a:z]], dtype=kind) for i, kind in enumerate((np.int64, float, np.int64))))
            assert (value.tolist(), lts.tolist()) == ([r[1] for r in want], [r[2] for r in want])
            assert many.pending == one.pending and many.flags()[:2] == one.flags()[:2]


def test_usual_lines_are_read_as_any_line(spark):
    """a line read as a whole and one taken apart tell the same; plain numbers and times are as Spark reads them."""
    from tests.test_graph import group

    text = group(spark).first()["payload"]
    loose = text.replace("> .\n", "> . \n").replace(" .\n", "  .\n")
    *head, found = lines.readings_of(text)
    assert loose != text and lines.readings_of(loose) == (*head, found) and len(found) == 2
    assert lines.readings_of("\n".join(text.split("\n")[::-1])) == (*head, found[::-1])
    said = ["2017-01-01T00:00:27+00:00", "2017-02-30T00:00:27Z", "1969-12-31T23:59:59-05:30", "2017-01-01T24:00:00Z", "0001-01-01T00:00:00Z", "x", ""]
    told = [lines.plain_millis(x) for x in said]
    rows = spark.createDataFrame([(x,) for x in said], "said string")
    want = [r[0] for r in rows.select(F.expr("unix_millis(try_to_timestamp(said, \"yyyy-MM-dd'T'HH:mm:ssXXX\"))")).collect()]
    assert all(t is None or t == w for t, w in zip(told, want)) and sum(t is not None for t in told) == 3
    numbers = ["1.5", "-0", "1e400", "1E5", "007", " 1", "1_0", "1d", "NaN", "1.", ".5", ""]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "x string").select(F.col("x").try_cast("double")).collect()]
    assert [(lines.plain_number(x), w) for x, w in zip(numbers[:5], want)] == [(w, w) for w in want[:5]] and not any(map(lines.plain_number, numbers[5:]))
