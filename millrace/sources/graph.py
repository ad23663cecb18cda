"""Observation groups and metadata as N-Triples text, in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fields, lines
from millrace.schema import I40, IOT, RESOURCE, RESULT, SSN, TERMINATION, TYPE, WMD, XSD
from millrace.sources.shared import few, materialize


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of an N-Triples file; IRIs without their brackets, literals as written."""
    return parse_triples(spark.read.text(path), "value")


def parse_triples(lines: DataFrame, column: str) -> DataFrame:
    pattern = r"^\s*(\S+)\s+(\S+)\s+(.*\S)\s*\.\s*$"
    bare = lambda c: F.regexp_replace(c, r"^<([^<>]*)>$", "$1")
    parts = [bare(F.regexp_extract(column, pattern, i)).alias(n) for i, n in enumerate("spo", 1)]
    return lines.where(F.col(column).rlike(pattern)).select(*parts)


def render_groups(groups: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(group, payload), after the columns ``keep``, of rows (group, machine, ts timestamp, cycle, observations array of struct(sensor, value))."""
    g, ts = F.col("group").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    # Lines are lists of text and columns, so that neighbouring text becomes one literal.
    iri = lambda *x: [f"<{RESOURCE}", *x, ">"]
    line = lambda s, p, o: [*s, f" <{p}> ", *o, " ."]
    named = lambda n: [f"<{n}>"]
    typed = lambda v, kind: ['"', *v, f'"^^<{XSD}{kind}>']
    group, time, cycle = iri("ObservationGroup_", g), iri("Timestamp_", g), iri("Cycle_", g)
    head = [
        line(group, TYPE, named(I40 + "MoldingMachineObservationGroup")),
        line(group, SSN + "observationResultTime", time),
        line(group, I40 + "machine", [f"<{WMD}Machine_", F.col("machine").cast("string"), ">"]),
        line(group, I40 + "observedCycle", cycle),
        line(cycle, TYPE, named(I40 + "Cycle")),
        line(cycle, IOT + "valueLiteral", typed([F.col("cycle").cast("string")], "int")),
        line(time, TYPE, named(IOT + "Timestamp")),
        line(time, IOT + "valueLiteral", typed([ts, "+00:00"], "dateTime")),
    ]

    def body(o: Column) -> list:
        obs, out, val = iri("Observation_", o["n"]), iri("Output_", o["n"]), iri("Value_", o["n"])
        prop = [f"<{WMD}_", F.col("machine").cast("string"), "_", o["sensor"], ">"]
        return [
            line(group, I40 + "contains", obs),
            line(obs, TYPE, named(I40 + "MoldingMachineObservation")),
            line(obs, SSN + "observationResult", out),
            line(obs, SSN + "observedProperty", prop),
            line(out, TYPE, named(SSN + "SensorOutput")),
            line(out, SSN + "hasValue", val),
            line(val, TYPE, named(I40 + "NumberValue")),
            line(val, IOT + "valueLiteral", typed([o["value"]], "double")),
        ]

    # What stands in several lines is made into text once.
    told = lambda o, i: F.struct((F.col("group") * 1000 + i).cast("string").alias("n"), o["sensor"].cast("string").alias("sensor"), o["value"].cast("string").alias("value"))
    each = F.transform(F.transform("observations", told), lambda o: _joined(body(o)))
    return groups.select(*keep, "group", F.when(F.col("observations").isNotNull(), F.concat_ws("\n", _joined(head), each)).alias("payload"))


def _joined(lines: list[list]) -> Column:
    """Lines of text and columns as one text; a line with a null is left out."""
    parts = []
    for part in [x for line in lines for x in ["\n", *line]][1:]:
        if parts and isinstance(part, str) and isinstance(parts[-1], str):
            parts[-1] += part
        else:
            parts.append(part)
    whole = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    kept = [F.concat(*[F.lit(x) if isinstance(x, str) else x for x in line]) for line in lines]
    return F.coalesce(whole, F.nullif(F.concat_ws("\n", *kept), F.lit("")))


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column that is made once a row: neither a filter on it nor what reads it twice makes it again, as the planner moves neither through a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _text(messages: DataFrame, column: str) -> DataFrame:
    """Adds ``__text``: messages as one text each, without the end-of-stream mark."""
    return _once(messages, F.col(column).cast("string"), "__text").where(~F.col("__text").startswith("~"))


def _data(messages: DataFrame, column: str) -> DataFrame:
    """Messages as arrays of lines, without the end-of-stream mark."""
    return _text(messages, column).withColumn("lines", F.split("__text", "\n"))


def _needed(found: Column, what: str) -> Column:
    return F.coalesce(found, F.raise_error(F.lit(f"message without {what}")).cast("long"))


def parse_any_order(messages: DataFrame, column: str = "payload", known: DataFrame | None = None, keep: list[str] = ()) -> DataFrame:
    """READING rows of messages whose lines may stand in any order, after the columns ``keep``; no shuffle, each message is parsed in its row.

    Python looks for the telling lines of a message, its values go into a dict by their
    observation, and properties look theirs up. A message without machine or time is an error;
    observations without a value, or whose (machine, sensor) isn't in ``known``, are left out
    before values are parsed. Of several values of one observation the last counts.
    """
    texts = messages.select(*keep, F.col(column).cast("string").alias("__text"))  # the parser leaves out end marks, so nothing else reads the text
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in texts.schema[:-1])
    data = texts.mapInArrow(lines.read_messages, f"{kept}machine long, lts long, ts long, said string, sensor int, value double, text string")
    data = data.withColumn("machine", F.col("machine").cast("int"))
    if known is not None:
        data = data.join(few(known.select("machine", "sensor").distinct()), ["machine", "sensor"], "left_semi")
    number = F.coalesce("value", F.col("text").try_cast("double"), F.lit(float("nan")))
    ts = F.coalesce("ts", _needed(fields.millis(F.col("said")), "time"))
    return data.select(*keep, "machine", "sensor", ts.alias("ts"), "lts", number.alias("value"))


def parse_in_order(messages: DataFrame, column: str = "payload") -> DataFrame:
    """READING rows of messages whose lines stand in the usual order: 8 of the group, then 8 of each observation.

    A message without machine or time in their places is an error, as in :func:`parse_any_order`.
    """
    data = _data(messages, column).where(F.size("lines") >= 16)
    line = lambda k: F.get("lines", k)
    rows = data.select(
        "lines",
        _needed(fields.machine_number(line(F.lit(2))), "machine").cast("int").alias("machine"),
        _needed(fields.event_millis(line(F.lit(7))), "time").alias("ts"),
        _needed(fields.logical_time(line(F.lit(7))), "time").alias("lts"),
        F.explode(F.sequence(F.lit(8), F.size("lines") - 8, F.lit(8))).alias("i"),
    )
    return rows.select(
        "machine", fields.sensor_number(line(F.col("i") + 3)).alias("sensor"), "ts", "lts", fields.number_or_nan(line(F.col("i") + 7)).alias("value")
    )


def numbered_lines(messages: DataFrame, id_col: str = "group", column: str = "payload") -> DataFrame:
    """(id, seq, line) of each line of each message, in order from 0."""
    return _data(messages, column).select(F.col(id_col).alias("id"), F.posexplode("lines").alias("seq", "line"))


def triple_facts(messages: DataFrame, id_col: str = "group", column: str = "payload") -> DataFrame:
    """One sparse row (id, ts, machine, obs, sensor, value) per telling line: a time, a property or a value."""
    numbered = numbered_lines(messages, id_col, column)
    line = F.col("line")
    time = line.contains(f"<{SSN}observationResultTime>")
    prop = line.contains(f"<{SSN}observedProperty>")
    value = line.endswith(f"<{XSD}double> .")
    return numbered.where(time | prop | value).select(
        "id",
        F.when(time, fields.logical_time(line)).alias("ts"),
        F.when(prop, fields.sensor_machine(line)).alias("machine"),
        F.when(prop | value, fields.observation_number(line)).alias("obs"),
        F.when(prop, fields.sensor_number(line)).alias("sensor"),
        F.when(value, fields.number_or_nan(line)).alias("value"),
    )


def join_facts(facts: DataFrame) -> DataFrame:
    """Readings of sparse facts: the property and value of an observation, the time of its message."""
    prop = facts.where("sensor is not null").select("id", "obs", "machine", "sensor")
    value = facts.where("value is not null").select("id", "obs", "value")
    time = facts.where("ts is not null").select("id", F.col("ts").alias("lts"))
    return prop.join(value, ["id", "obs"]).join(time, "id").select("machine", "sensor", "lts", "value")


def parse_facts(messages: DataFrame, id_col: str = "group", column: str = "payload") -> DataFrame:
    """As :func:`join_facts` of :func:`triple_facts`, message by message: its facts are joined where they are read.

    Messages whose id comes more than once are read as facts and joined by a shuffle, since
    theirs meet across messages; a message without id has no readings.
    """
    ids = messages.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    again = materialize(ids.where("__n > 1").select("__id"), "repeated")
    number = F.coalesce(F.col("text").try_cast("double"), F.lit(float("nan")))
    if again.isEmpty():
        once = messages.where(F.col(id_col).isNotNull())
    else:
        once = messages.join(again, F.col(id_col) == F.col("__id"), "left_anti").where(F.col(id_col).isNotNull())
    found = _text(once, column).select("__text").mapInArrow(lines.read_facts, "machine int, sensor int, lts long, text string")
    found = found.select("machine", "sensor", "lts", number.alias("value"))
    if again.isEmpty():
        return found
    several = messages.join(again, F.col(id_col) == F.col("__id"), "left_semi")
    return found.unionByName(join_facts(triple_facts(several, id_col, column)))


def render_anomalies(anomalies: DataFrame, transitions: int, fixed: bool = False) -> DataFrame:
    """Adds ``ntriples``: the five lines of an anomaly. ``fixed`` writes six decimals and ends the last line."""
    n = F.col("anomaly_id").cast("string")
    s = F.concat(F.lit(f"<{RESOURCE}Anomaly_"), n, F.lit("> "))
    p = F.format_string("%f", "probability") if fixed else F.col("probability").cast("string")
    lines = [
        F.concat(s, F.lit(f"<{TYPE}> <{RESULT}Anomaly> .")),
        F.concat(s, F.lit(f"<{I40}machine> <{WMD}Machine_"), F.col("machine").cast("string"), F.lit("> .")),
        F.concat(s, F.lit(f"<{RESULT}inAbnormalDimension> <{WMD}_"), F.col("machine").cast("string"), F.lit("_"), F.col("sensor").cast("string"), F.lit("> .")),
        F.concat(s, F.lit(f"<{RESULT}hasTimeStamp> <{RESOURCE}Timestamp_"), (F.col("ordinal") - transitions).cast("string"), F.lit("> .")),
        F.concat(s, F.lit(f'<{RESULT}hasProbabilityOfObservedAbnormalSequence> "'), p, F.lit(f'"^^<{XSD}double> .')),
    ]
    text = F.concat_ws("\n", *lines)
    return anomalies.withColumn("ntriples", F.concat(text, F.lit("\n")) if fixed else text)


def write_anomalies(anomalies: DataFrame, path: str, transitions: int, fixed: bool = False, end_mark: bool = False) -> None:
    """Anomalies as text files in order of their ids; Spark's success mark ends the output, after ``TERMINATION`` if ``end_mark`` asks for it."""
    lines = render_anomalies(anomalies, transitions, fixed).sort("anomaly_id").select("ntriples")
    lines.write.mode("overwrite").text(path)
    if end_mark:
        mark = anomalies.sparkSession.createDataFrame([(TERMINATION,)], "value string")
        mark.coalesce(1).write.mode("append").text(path)


def write_payloads(payloads: DataFrame, path: str, column: str = "payload", order: str | None = None) -> None:
    """Payloads that are rendered already, text or bytes, as text files, in the order of a column if one is told."""
    out = payloads.sort(order) if order else payloads
    out.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def dump_by_sensor(rows: DataFrame, path: str) -> None:
    """Rows as a folder for each machine and sensor, to look into single streams."""
    rows.repartition("machine", "sensor").write.mode("overwrite").partitionBy("machine", "sensor").json(path)


def queue_path(queue: str, options: dict[str, str] | None = None) -> str:
    """Folder of a queue's messages: ``base`` / queue.session, where ``options`` tells them or the defaults stand."""
    told = {"base": "queues", "session": "mySessionId"} | (options or {})
    return f"{told['base'].rstrip('/')}/{queue}.{told['session']}"


def read_messages(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of (payload, file, arrival): a message is a text file, raw as it came; ``per_trigger`` bounds the files of a batch.

    Spark's checkpoint acknowledges files once their batch is written. ``arrival`` is the
    file's time of change in milliseconds.
    """
    reader = spark.readStream.format("text").option("wholetext", "true")
    reader = reader.option("maxFilesPerTrigger", str(per_trigger)) if per_trigger else reader
    found = reader.load(path)
    return found.select(
        F.col("value").alias("payload"), F.col("_metadata.file_name").alias("file"), F.unix_millis("_metadata.file_modification_time").alias("arrival")
    )
