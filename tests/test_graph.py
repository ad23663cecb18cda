import datetime

import pytest
from pyspark.sql import functions as F

from millrace.config import load_params, settings_of_triples
from millrace.operators import detect, metadata
from millrace.config import Params
from millrace.schema import IOT, SSN, TERMINATION, TYPE, WMD
from millrace.sources import graph

# Lines of the input and output formats.
MESSAGE = """<http://project-hobbit.eu/resources/debs2017#ObservationGroup_0> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.agtinternational.com/ontologies/I4.0#MoldingMachineObservationGroup> ."""


def group(spark, value=-0.04):
    rows = [(0, 59, datetime.datetime(2017, 1, 1, 1, 0, 1), 2, [(31, value), (32, 1.5)])]
    return graph.render_groups(spark.createDataFrame(rows, "group long, machine int, ts timestamp, cycle int, observations array<struct<sensor:int,value:double>>"))


def test_layout(spark):
    lines = group(spark).first()["payload"].split("\n")
    assert lines[0] == MESSAGE and len(lines) == 24
    assert lines[11].endswith("<http://www.agtinternational.com/ontologies/WeidmullerMetadata#_59_31> .")
    assert lines[15].endswith('"-0.04"^^<http://www.w3.org/2001/XMLSchema#double> .')


def test_parsers_agree_and_end_mark_is_skipped(spark):
    mark = spark.createDataFrame([(9, TERMINATION)], "group long, payload string")
    messages = group(spark).unionByName(mark)
    want = {(59, 31, 1483232401000, 0, -0.04), (59, 32, 1483232401000, 0, 1.5)}
    assert {tuple(r) for r in graph.parse_any_order(messages).collect()} == want
    assert {tuple(r) for r in graph.parse_in_order(messages).collect()} == want
    known = spark.createDataFrame([(59, 32)], "machine int, sensor int")
    assert {r["sensor"] for r in graph.parse_any_order(messages, known=known).collect()} == {32}


def test_broken_messages(spark):
    bad = group(spark).withColumn("payload", F.regexp_replace("payload", '"-0.04"', '"x"'))
    values = {r["sensor"]: r["value"] for r in graph.parse_any_order(bad).collect()}
    assert values[31] != values[31] and values[32] == 1.5
    headless = group(spark).withColumn("payload", F.regexp_replace("payload", "#machine>", "#engine>"))
    with pytest.raises(Exception, match="message without machine"):
        graph.parse_any_order(headless).collect()


def test_messages_without_machine_or_time_are_errors_in_either_order(spark):
    for what in ("#Machine_59>", "#Timestamp_0> <http://www.agtinternational.com/ontologies/IoTCore#valueLiteral>"):
        broken = group(spark).withColumn("payload", F.replace("payload", F.lit(what), F.lit("#none> <x>")))
        for parse in (graph.parse_any_order, graph.parse_in_order):
            with pytest.raises(Exception, match="message without"):
                parse(broken).collect()


def test_any_order_at_full_width(spark):
    """117 observations in any order of lines, one of them twice and one without a value."""
    import random

    rows = [(g, g % 5, datetime.datetime(2017, 1, 1, 1, 0, g), 0, [(i, g * 1000.0 + i) for i in range(117)]) for g in range(20)]
    made = graph.render_groups(spark.createDataFrame(rows, "group long, machine int, ts timestamp, cycle int, observations array<struct<sensor:int,value:double>>"))
    rnd, messages = random.Random(1), []
    for r in made.collect():
        lines = r["payload"].split("\n")
        values = [x for x in lines if "#Value_" in x.split(" ")[0] and "valueLiteral" in x]
        lines.remove(values[7])
        rnd.shuffle(lines)
        lines.append(values[9].replace('"' + values[9].split('"')[1] + '"', '"-1.5"'))
        messages.append((r["group"], "\n".join(lines)))
    got = graph.parse_any_order(spark.createDataFrame(messages, "group long, payload string"), keep=["group"]).collect()
    want = {(g, i): -1.5 if i == 9 else g * 1000.0 + i for g in range(20) for i in range(117) if i != 7}
    assert len(got) == len(want) and {(r["group"], r["sensor"]): r["value"] for r in got} == want
    assert {(r["group"], r["machine"], r["lts"]) for r in got} == {(g, g % 5, g) for g in range(20)}


def test_fields(spark):
    from millrace.functions import fields

    lines = ["<x#ObservationGroup_12> <y> <z#MoldingMachine> .", "<x#Machine_7> <t> <z#AssemblyMachine> .", "<q> <w> <e> ."]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [tuple(r) for r in df.select(fields.group_number(F.col("line")), fields.machine_type(F.col("line")), fields.machine_number(F.col("line"))).collect()]
    assert got == [(12, "MOLDING", None), (None, "ASSEMBLY", 7), (None, None, None)]


def murmur(x):
    """murmur3 of a 32-bit number from seed 0."""
    m = 0xFFFFFFFF
    turn = lambda v, r: ((v << r) | (v >> (32 - r))) & m
    x = turn((turn(x * 0xCC9E2D51 & m, 15) * 0x1B873593) & m, 13) * 5 + 0xE6546B64 & m
    x ^= 4
    for shift, c in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        x = (x ^ (x >> shift)) * c & m
    return x


def test_key_groups(spark):
    from millrace.functions import fields

    keys = [(m, s) for m in (0, 1, 59, 2**31 - 1, -5, 70_000_000) for s in range(40)]
    df = spark.createDataFrame(keys, "machine int, sensor int")
    group = fields.key_group(fields.key_hash(F.col("machine"), F.col("sensor")), 128)
    got = {(r["machine"], r["sensor"]): (r["g"], r["o"]) for r in df.select("machine", "sensor", group.alias("g"), fields.operator_of(group, 5, 128).alias("o")).collect()}
    for m, s in keys:
        x = murmur((31 * m + s) % 2**32)
        g = (0 if x == 2**31 else min(x, 2**32 - x)) % 128
        assert got[m, s] == (g, g * 5 // 128)


def triple_rows(k="3", types=1):
    s = WMD + "_59_31"
    out = [(WMD + "Machine_59", IOT + "hasModel", "x:model"), (WMD + "Machine_59", TYPE, WMD + "MoldingMachine"), ("x:model", SSN + "hasProperty", s)]
    out += [(s, TYPE, f"x:type{i}") for i in range(types)]
    out += [(s, WMD + "hasNumberOfClusters", f'"{k}"^^int'), ("x:p", WMD + "isThresholdForProperty", s), ("x:p", IOT + "valueLiteral", '"0.005"^^double')]
    return out


def test_pattern_has_bag_semantics(spark):
    got = metadata.match_pattern(spark.createDataFrame(triple_rows(types=2), "s string, p string, o string")).collect()
    assert [tuple(r) for r in got] == [(59, "MOLDING", 31, 3, 0.005)] * 2


def test_conflicts_are_told(spark):
    rows = spark.createDataFrame([(1, "MOLDING", 2, 3, 0.1), (1, "MOLDING", 2, 4, 0.1)], "machine int, type string, sensor int, k int, pt double")
    with pytest.raises(ValueError):
        metadata.checked(rows)


def test_golden_anomaly(spark):
    rows = [(59, 31, 20, 29, 0.004115226337448559, 0)]
    df = spark.createDataFrame(rows, "machine int, sensor int, oldest_lts long, ordinal long, probability double, anomaly_id int")
    lines = graph.render_anomalies(df, 5).first()["ntriples"].split("\n")
    assert len(lines) == 5 and lines[3].endswith("#Timestamp_24> .")
    assert lines[4] == '<http://project-hobbit.eu/resources/debs2017#Anomaly_0> <http://www.agtinternational.com/ontologies/DEBSAnalyticResults#hasProbabilityOfObservedAbnormalSequence> "0.004115226337448559"^^<http://www.w3.org/2001/XMLSchema#double> .'
    assert graph.render_anomalies(df, 5, fixed=True).first()["ntriples"].endswith('"0.004115"^^<http://www.w3.org/2001/XMLSchema#double> .\n')


def test_triples_and_settings(spark, tmp_path):
    (tmp_path / "m.nt").write_text('<http://a/s> <http://c/window.size> "12"^^<http://x#int> .\n<http://a/s> <http://c/other> <http://a/o> .\n\n')
    triples = graph.read_triples(spark, str(tmp_path / "m.nt"))
    assert triples.count() == 2
    assert [tuple(r) for r in settings_of_triples(triples, "http://c/").collect()] == [("window.size", "12")]
    assert load_params(triples, "http://c/").window == 12


def test_machines_with_other_numbers_of_sensors(spark):
    schema = "machine int, sensor int, oldest_lts long, ordinal long, probability double"
    rows = [(1, s, 0, 9, 0.1) for s in (1, 2)] + [(2, s, 1, 9, 0.1) for s in (1, 2, 3)] + [(1, s, 2, 10, 0.1) for s in (1, 2)] + [(2, 1, 3, 10, 0.1)]
    scores = spark.createDataFrame(rows, schema)
    sensors = spark.createDataFrame([(1, 2), (2, 3), (7, 1)], "machine int, sensors long")
    got = detect.emit(scores, Params(theta=0.5), sensors).orderBy("anomaly_id").collect()
    assert [(r["oldest_lts"], r["machine"], r["sensor"], r["anomaly_id"]) for r in got] == [(t, m, s, i) for i, (t, m, s) in enumerate([(0, 1, 1), (0, 1, 2), (1, 2, 1), (1, 2, 2), (1, 2, 3), (2, 1, 1), (2, 1, 2)])]
    assert detect.emit(scores, Params(theta=0.5), sensors, flush=True).count() == 8
    with pytest.raises(Exception, match="several machines share logical time"):
        detect.complete_times(scores.unionByName(spark.createDataFrame([(2, 9, 0, 9, 0.1)], schema)), sensors).collect()


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_first_gap(spark, width):
    import random

    rnd = random.Random(width)
    for _ in range(6):
        times = set(rnd.sample(range(25), rnd.randint(0, 25))) | set(range(rnd.randint(0, 20)))
        start = rnd.randint(0, 4)
        want = next(t for t in range(start, 100) if t not in times)
        assert detect.first_gap(spark.createDataFrame([(t,) for t in times], "oldest_lts long"), start, width) == want


def test_positions_in_order(spark):
    """An outlier and a value that most rows share cost nothing but are in their places."""
    from millrace.operators.windows import global_index

    rows = [(10**15, 0, "z"), (None, 1, "n")] + [(7, i, "h") for i in range(500)] + [(i, i, "x") for i in range(-40, 60)]
    got = global_index(spark.createDataFrame(rows, "a long, b long, c string").repartition(3), ["a", "b"], "at").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(len(rows)))
    assert [(r["a"], r["b"]) for r in got] == sorted(((a, b) for a, b, _ in rows), key=lambda x: (x[0] is not None, x))


def test_files_out_and_in(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0.5, "a"), (1, 2, 0.6, "b"), (2, 1, 0.7, "c")], "machine int, sensor int, value double, payload string")
    graph.dump_by_sensor(rows, str(tmp_path / "dump"))
    assert (tmp_path / "dump" / "machine=1" / "sensor=2").is_dir() and spark.read.json(str(tmp_path / "dump")).count() == 3
    graph.write_payloads(rows.withColumn("payload", F.col("payload").cast("binary")), str(tmp_path / "raw"), order="payload")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "raw")).collect()] == ["a", "b", "c"]
    assert graph.queue_path("in") == "queues/in.mySessionId" and graph.queue_path("in", {"base": "/q/", "session": "s1"}) == "/q/in.s1"
    anomalies = spark.createDataFrame([(59, 31, 20, 29, 0.25, 0)], "machine int, sensor int, oldest_lts long, ordinal long, probability double, anomaly_id int")
    graph.write_anomalies(anomalies, str(tmp_path / "told"), 5, end_mark=True)
    assert TERMINATION in {r["value"] for r in spark.read.text(str(tmp_path / "told")).collect()}


def test_live_from_files(spark, tmp_path):
    """Messages as text files, in two runs that go on from one checkpoint; a stream counts its rows; known sensors use their own k."""
    import os

    from millrace.operators import windows
    from millrace.streaming.detector import Progress, run_detection

    params = Params(window=4, transitions=2, theta=2.0)
    stamp = lambda g: datetime.datetime(2017, 1, 1, 1, 0, g)
    value = lambda g, s: float((g * g * s) % 7)
    rows = [(g, 1, stamp(g), 0, [(s, value(g, s)) for s in (1, 2, 3)]) for g in range(12)]
    made = graph.render_groups(spark.createDataFrame(rows, "group long, machine int, ts timestamp, cycle int, observations array<struct<sensor:int,value:double>>"))
    payloads = {r["group"]: r["payload"] for r in made.collect()}
    known = spark.createDataFrame([(1, "MOLDING", 1, 2, 0.1), (1, "MOLDING", 2, 3, 0.1)], "machine int, type string, sensor int, k int, pt double")
    queue = tmp_path / graph.queue_path("in", {"base": "q"})
    queue.mkdir(parents=True)
    counter = Progress()
    spark.streams.addListener(counter)
    for part in ([0, 1, 3, 2, 5], [4, 7, 6, 8, 9, 10, 11]):
        for g in part:
            (queue / f"m{g:03d}.txt").write_text(payloads[g])
            os.utime(queue / f"m{g:03d}.txt", (1_600_000_000 + g, 1_600_000_000 + g))
        got = run_detection(graph.read_messages(spark, str(queue), 3), known, params, str(tmp_path / "out"))
    spark.streams.removeListener(counter)
    readings = spark.createDataFrame([(1, s, g, value(g, s)) for g in range(12) for s in (1, 2, 3)], "machine int, sensor int, lts long, value double")
    want = detect.detect(readings, known, params)
    cols = ["anomaly_id", "machine", "sensor", "oldest_lts", "ordinal", "probability", "timestamp"]
    a, b = sorted(map(tuple, got.select(cols).collect())), sorted(map(tuple, want.select(cols).collect()))
    assert a == b and len(a) == 18 and {r[2] for r in a} == {1, 2}
    assert windows.sliding_windows(readings, 4).count() == 27


def test_barrier(spark, tmp_path):
    from millrace.streaming.detector import OutputBarrier

    barrier = OutputBarrier(str(tmp_path / "b"), Params(theta=0.5), 2)
    schema = "machine int, sensor int, oldest_lts long, ordinal long, probability double"
    for epoch, rows in enumerate([[(1, 1, 1, 9, 0.1)], [(1, 2, 0, 9, 0.1)], [(1, 1, 0, 9, 0.1)], [(1, 2, 1, 9, 0.9)]]):
        barrier(spark.createDataFrame(rows, schema), epoch)
    got = detect.number_anomalies(barrier.emitted(spark)).orderBy("anomaly_id").collect()
    assert [(r["oldest_lts"], r["sensor"]) for r in got] == [(0, 1), (0, 2), (1, 1)]
    assert spark.read.parquet(str(tmp_path / "b" / "progress" / "3")).first()["open_epochs"] == []
    graph.write_anomalies(detect.number_anomalies(barrier.emitted(spark)), str(tmp_path / "out"), 5)
    assert (tmp_path / "out" / "_SUCCESS").exists()
