"""Named queries over the test tables, and SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.config import Params, settings_of_triples
from millrace.functions import fields, markov
from millrace.operators import detect, metadata, reorder, windows
from millrace.schema import I40, IOT, RESOURCE, RESULT, SCORE, SSN, TYPE, WMD, XSD
from millrace.sources import graph, tables
from millrace.sources.shared import clear, materialize, shared_path
from millrace.streaming import detector

P = Params()
K = 3
SENSORS = 4
#: Groups in a file of a stream.
STREAM_ROWS = 250_000
CONFIG_PREFIX = "http://example.org/settings/"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_READINGS = """
li AS (
    SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS lts
    FROM lineitem
), readings AS (
    SELECT CAST(l_suppkey AS INTEGER) AS machine, 1 AS sensor, lts, l_quantity AS value FROM li
    UNION ALL SELECT CAST(l_suppkey AS INTEGER), 2, lts, l_extendedprice FROM li
    UNION ALL SELECT CAST(l_suppkey AS INTEGER), 3, lts, l_discount FROM li
    UNION ALL SELECT CAST(l_suppkey AS INTEGER), 4, lts, l_tax FROM li
)"""


def _wins(source: str = "readings", k: str = str(K), join: str = "") -> str:
    return f"""wins AS (
    SELECT * FROM (
        SELECT machine, sensor, first_value(lts) OVER w AS oldest_lts, lts AS newest_lts,
               row_number() OVER (PARTITION BY machine, sensor ORDER BY lts) - 1 AS ordinal, list(value) OVER w AS win
        FROM {source} WINDOW w AS (PARTITION BY machine, sensor ORDER BY lts ROWS BETWEEN {P.window - 1} PRECEDING AND CURRENT ROW)
    ) WHERE ordinal >= {P.window - 1}
), seeded AS (
    SELECT wins.*, list_sort(list_slice(list_filter(win, lambda x, i: list_position(win, x) = i), 1, {k})) AS seeds FROM wins {join}
)"""


_WINS = f"{_READINGS}, {_wins()}"
_ASSIGN = "list_transform(win, lambda v: list_reduce(range(len({c})), lambda b, i: CASE WHEN abs({c}[i + 1] - v) <= abs({c}[b + 1] - v) THEN i ELSE b END))"
_CLUSTERED = f"""km AS (
    SELECT machine, sensor, oldest_lts, ordinal, win, seeds AS c, CAST([] AS BIGINT[]) AS lab, 0 AS rounds, false AS done FROM seeded
    UNION ALL
    SELECT machine, sensor, oldest_lts, ordinal, win, CASE WHEN empty THEN c ELSE means END, l, rounds + 1,
           empty OR rounds + 1 >= {P.iterations}
           OR list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(range(len(c)), lambda j: abs(means[j + 1] - c[j + 1]))), lambda a, x: a + x) <= {P.epsilon}
    FROM (
        SELECT *, list_has_any(list_transform(means, lambda m: m IS NULL), [true]) AS empty
        FROM (
            SELECT *, list_transform(range(len(c)), lambda j: CASE WHEN list_contains(l, j) THEN
                   list_reduce(list_prepend(CAST(0 AS DOUBLE), list_filter(win, lambda v, i: l[i] = j)), lambda a, x: a + x)
                   / len(list_filter(l, lambda q: q = j)) END) AS means
            FROM (SELECT *, {_ASSIGN.format(c="c")} AS l FROM km WHERE NOT done)
        )
    )
), labelled AS (SELECT machine, sensor, oldest_lts, ordinal, lab FROM km WHERE done
), scores AS (
    SELECT machine, sensor, oldest_lts, ordinal,
           list_reduce(list_prepend(CAST(1 AS DOUBLE), list_transform(range({P.window - P.transitions}, {P.window}), lambda i:
               len(list_filter(range(1, {P.window}), lambda j: lab[j] = lab[i] AND lab[j + 1] = lab[i + 1]))
               / len(list_filter(range(1, {P.window}), lambda j: lab[j] = lab[i])))), lambda a, x: a * x) AS probability
    FROM labelled
)"""
_KMEANS = f"{_WINS}, {_CLUSTERED}"
_META = f"""meta AS (
    SELECT DISTINCT CAST(l_suppkey AS INTEGER) AS machine, s.sensor AS sensor, CAST(2 + (l_suppkey + s.sensor) % 3 AS INTEGER) AS k,
           CAST(0.001 AS DOUBLE) * (1 + (l_suppkey * 7 + s.sensor) % 9) AS pt
    FROM lineitem, (SELECT CAST(unnest(range(1, {SENSORS + 1})) AS INTEGER) AS sensor) s WHERE (l_suppkey + s.sensor) % 5 <> 0
)"""
_ARRIVALS = """arrivals AS (
    SELECT CAST(user_id AS INTEGER) AS machine, 0 AS sensor,
           row_number() OVER (PARTITION BY user_id ORDER BY t + event_id * 7 % 6, event_id) - 1 AS arrival, t AS ts, value
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events) {gaps}
), warm AS (
    SELECT machine, arrival AS warm, least_so_far AS start_ts FROM (
        SELECT machine, arrival, min(ts) OVER (PARTITION BY machine ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS least_so_far FROM arrivals
    ) WHERE arrival = 1
), run AS (
    SELECT a.machine, a.ts, a.arrival, a.value, w.start_ts,
           row_number() OVER (PARTITION BY a.machine ORDER BY a.ts) - 1 AS place,
           greatest(max(a.arrival) OVER (PARTITION BY a.machine ORDER BY a.ts ROWS UNBOUNDED PRECEDING), w.warm) AS release
    FROM arrivals a JOIN warm w ON a.machine = w.machine WHERE a.ts >= w.start_ts
), fates AS (
    SELECT a.machine, 0 AS sensor, a.arrival, a.ts, a.value,
           CASE WHEN w.machine IS NULL THEN 'waiting' WHEN r.machine IS NULL THEN 'late' WHEN r.ts - r.start_ts <> r.place THEN 'blocked' ELSE 'released' END AS fate,
           r.release
    FROM arrivals a LEFT JOIN warm w ON a.machine = w.machine LEFT JOIN run r ON a.machine = r.machine AND a.ts = r.ts
)"""


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_windows(tables.readings(spark, sf_dir), P.window).withColumn("k", F.lit(K))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.score(tables.readings(spark, sf_dir), P, F.lit(K))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    machine = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey").distinct()
    rows = machine.select("l_suppkey", F.explode(F.sequence(F.lit(1), F.lit(SENSORS))).alias("sensor")).where("(l_suppkey + sensor) % 5 <> 0")
    return rows.select(
        F.col("l_suppkey").cast("int").alias("machine"),
        "sensor",
        (2 + (F.col("l_suppkey") + F.col("sensor")) % 3).cast("int").alias("k"),
        (F.lit(0.001) * (1 + (F.col("l_suppkey") * 7 + F.col("sensor")) % 9)).alias("pt"),
    )


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata as a graph, as (s, p, o)."""
    rows = _metadata(spark, sf_dir)
    m, s = F.col("machine").cast("string"), F.col("sensor").cast("string")
    machine, model = F.concat(F.lit(WMD + "Machine_"), m), F.concat(F.lit(WMD + "MachineModel_"), m)
    sensor, limit = F.concat(F.lit(WMD + "_"), m, F.lit("_"), s), F.concat(F.lit(WMD + "ProbabilityThreshold_"), m, F.lit("_"), s)
    typed = lambda v, kind: F.concat(F.lit('"'), v.cast("string"), F.lit(f'"^^{XSD}{kind}'))
    triple = lambda a, p, o: F.struct(a.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    each = F.array(
        triple(model, SSN + "hasProperty", sensor),
        triple(sensor, TYPE, F.lit(WMD + "StatefulProperty")),
        triple(sensor, WMD + "hasNumberOfClusters", typed(F.col("k"), "int")),
        triple(limit, WMD + "isThresholdForProperty", sensor),
        triple(limit, IOT + "valueLiteral", typed(F.col("pt"), "double")),
    )
    once = F.array(triple(machine, IOT + "hasModel", model), triple(machine, TYPE, F.lit(WMD + "MoldingMachine")))
    return rows.select(F.inline(each)).unionByName(rows.select("machine").distinct().select(F.inline(once)))


def _rendered_groups(groups: DataFrame, ts, *keep: str) -> DataFrame:
    observed = F.array(*[F.struct(F.lit(i).alias("sensor"), F.col(c).alias("value")) for i, c in enumerate(tables.SENSORS, 1)])
    rows = groups.select(*keep, F.col("lts").alias("group"), "machine", ts.alias("ts"), F.lit(0).alias("cycle"), observed.alias("observations"))
    return graph.render_groups(rows, list(keep))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered_groups(tables.groups(spark, sf_dir), F.col("l_shipdate"))


def _turned(messages: DataFrame) -> DataFrame:
    """Messages with their lines in reverse order."""
    return messages.withColumn("payload", F.array_join(F.reverse(F.split("payload", "\n")), "\n"))


@_query("readings_unpivot", f"WITH {_READINGS} SELECT * FROM readings")
def readings_unpivot(spark, sf_dir):
    return tables.readings(spark, sf_dir)


@_query(
    "sliding_window",
    f"""WITH {_WINS} SELECT machine, sensor, oldest_lts, newest_lts, ordinal, CAST(len(win) AS INTEGER) AS size, win[1] AS oldest,
        win[{P.window}] AS latest, win[{P.window - 2}] AS latest_but_2, list_min(win) AS least, list_max(win) AS most FROM wins""",
)
def sliding_window(spark, sf_dir):
    win = F.col("win")
    return _windows(spark, sf_dir).select(
        "machine", "sensor", "oldest_lts", "newest_lts", "ordinal", F.size(win).alias("size"), F.get(win, F.lit(0)).alias("oldest"),
        F.element_at(win, -1).alias("latest"), F.element_at(win, -3).alias("latest_but_2"), F.array_min(win).alias("least"), F.array_max(win).alias("most"),
    )


@_query(
    "window_lag_pairs",
    f"""WITH {_READINGS} SELECT machine, sensor, lts, value, lag(lts) OVER w AS prev_lts, lag(value) OVER w AS prev_value,
        lag(lts) OVER w + 1 = lts AS contiguous FROM readings WINDOW w AS (PARTITION BY machine, sensor ORDER BY lts)""",
)
def window_lag_pairs(spark, sf_dir):
    return windows.lag_pairs(tables.readings(spark, sf_dir))


@_query(
    "contiguity",
    f"""WITH {_READINGS} SELECT machine, sensor, count(*) FILTER (WHERE ok) AS contiguous, count(*) AS pairs FROM (
        SELECT machine, sensor, lag(lts) OVER w + 1 = lts AS ok FROM readings WINDOW w AS (PARTITION BY machine, sensor ORDER BY lts)
    ) WHERE ok IS NOT NULL GROUP BY machine, sensor""",
)
def contiguity(spark, sf_dir):
    pairs = windows.lag_pairs(tables.readings(spark, sf_dir)).where("contiguous is not null")
    return pairs.groupBy("machine", "sensor").agg(F.count_if("contiguous").alias("contiguous"), F.count(F.lit(1)).alias("pairs"))


@_query("kmeans_seed", f"WITH {_WINS} SELECT machine, sensor, ordinal, len(seeds) AS n_seeds, seeds[1] AS seed_1, seeds[2] AS seed_2, seeds[3] AS seed_3 FROM seeded")
def kmeans_seed(spark, sf_dir):
    seeds = _windows(spark, sf_dir).select("machine", "sensor", "ordinal", markov.seeds_expr(F.col("win"), F.lit(K)).alias("s"))
    return seeds.select("machine", "sensor", "ordinal", F.size("s").cast("long").alias("n_seeds"), *[F.get("s", F.lit(i)).alias(f"seed_{i + 1}") for i in range(K)])


@_query("kmeans_assign", f"WITH {_WINS} SELECT machine, sensor, ordinal, array_to_string({_ASSIGN.format(c='seeds')}, ',') AS labels FROM seeded")
def kmeans_assign(spark, sf_dir):
    """The first assignment."""
    readings = tables.readings(spark, sf_dir).withColumn("k", F.lit(K))
    return windows.map_windows(readings, P.window, markov.first_labels, "labels", "string").drop("oldest_lts")


@_query("kmeans_labels", f"WITH RECURSIVE {_KMEANS} SELECT machine, sensor, ordinal, array_to_string(lab, ',') AS labels FROM labelled")
def kmeans_labels(spark, sf_dir):
    labels = markov.labels_udf(P)("win", "k")
    return _windows(spark, sf_dir).select("machine", "sensor", "ordinal", F.array_join(labels.cast("array<string>"), ",").alias("labels"))


@_query(
    "markov_transitions",
    f"""WITH RECURSIVE {_KMEANS}, steps AS (
        SELECT machine, sensor, ordinal, unnest(range(1, {P.window})) AS i, lab FROM labelled
    ), counted AS (SELECT machine, sensor, ordinal, lab[i] AS source, lab[i + 1] AS target, count(*) AS n FROM steps GROUP BY ALL)
    SELECT machine, sensor, ordinal, CAST(source AS INTEGER) AS source, CAST(target AS INTEGER) AS target, n,
           CAST(sum(n) OVER (PARTITION BY machine, sensor, ordinal, source) AS BIGINT) AS total FROM counted""",
)
def markov_transitions(spark, sf_dir):
    """Transition counts and row totals, as relations: counted within each window's own row, so nothing is shuffled for them."""
    return markov.transition_rows(_windows(spark, sf_dir), P)


@_query("markov_prob", f"WITH RECURSIVE {_KMEANS} SELECT * FROM scores")
def markov_prob(spark, sf_dir):
    return _scores(spark, sf_dir)


@_query("anomalies_global", f"WITH RECURSIVE {_KMEANS} SELECT * FROM scores WHERE probability < {P.theta}")
def anomalies_global(spark, sf_dir):
    return detect.below(_scores(spark, sf_dir), P.theta)


@_query(
    "anomalies_per_sensor",
    f"WITH RECURSIVE {_KMEANS}, {_META} SELECT s.*, m.pt FROM scores s JOIN meta m ON s.machine = m.machine AND s.sensor = m.sensor WHERE probability < m.pt",
)
def anomalies_per_sensor(spark, sf_dir):
    return detect.below_own(_scores(spark, sf_dir), _metadata(spark, sf_dir))


@_query("complete_lts", f"WITH {_WINS} SELECT oldest_lts FROM wins GROUP BY oldest_lts HAVING count(*) = {SENSORS}")
def complete_lts(spark, sf_dir):
    return detect.complete_times(_windows(spark, sf_dir), SENSORS)


def _emit(scores: str, complete: str) -> str:
    return f"""{scores}, complete AS (SELECT oldest_lts AS t FROM {complete}
), prefix AS (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS r FROM complete) WHERE t = r
), emitted AS (
    SELECT *, row_number() OVER (ORDER BY oldest_lts, sensor) - 1 AS anomaly_id, ordinal - {P.transitions} AS "timestamp"
    FROM scores WHERE probability < {P.theta} AND oldest_lts IN (SELECT t FROM prefix)
)"""


_EMIT = _emit(_KMEANS, f"scores GROUP BY oldest_lts HAVING count(*) = {SENSORS}")
#: Known sensors alone, each with its own number of clusters; times complete by the sensors of their machines.
_DETECT = _emit(
    f"""{_READINGS}, {_META}, known AS (
        SELECT r.* FROM readings r SEMI JOIN meta m ON r.machine = m.machine AND r.sensor = m.sensor
    ), {_wins("known", "meta.k", "JOIN meta ON wins.machine = meta.machine AND wins.sensor = meta.sensor")}, {_CLUSTERED}""",
    """scores JOIN (SELECT machine, count(DISTINCT sensor) AS sensors FROM meta GROUP BY machine) expected USING (machine)
       GROUP BY oldest_lts, sensors HAVING count(*) = sensors""",
)


def _rendered(emitted: str) -> str:
    about = f"'<{RESOURCE}Anomaly_' || anomaly_id || '> "
    return f"""WITH RECURSIVE {emitted} SELECT anomaly_id,
        {about}<{TYPE}> <{RESULT}Anomaly> .' AS line_1,
        {about}<{I40}machine> <{WMD}Machine_' || machine || '> .' AS line_2,
        {about}<{RESULT}inAbnormalDimension> <{WMD}_' || machine || '_' || sensor || '> .' AS line_3,
        {about}<{RESULT}hasTimeStamp> <{RESOURCE}Timestamp_' || "timestamp" || '> .' AS line_4,
        regexp_matches({about}<{RESULT}hasProbabilityOfObservedAbnormalSequence> "' || probability || '"^^<{XSD}double> .',
            '> <[^>]*> "[0-9.eE-]+"\\^\\^<{XSD}double> [.]$') AS line_5_fits,
        probability FROM emitted"""


def _as_rendered(anomalies: DataFrame) -> DataFrame:
    """The rendered lines; the last one's number as a number, since engines print doubles differently, and whether the line around it fits."""
    out = graph.render_anomalies(anomalies, P.transitions).withColumn("l", F.split("ntriples", "\n"))
    last = F.get("l", F.lit(4))
    number = F.regexp_extract(last, r'"([^"]*)"', 1).cast("double").alias("probability")
    about = F.concat(F.lit(f"<{RESOURCE}Anomaly_"), F.col("anomaly_id").cast("string"), F.lit(f"> <{RESULT}hasProbabilityOfObservedAbnormalSequence> "))
    fits = last.startswith(about) & last.rlike(rf'> <[^>]*> "[0-9.eE-]+"\^\^<{XSD}double> [.]$') & (F.size("l") == 5)
    return out.select("anomaly_id", *[F.get("l", F.lit(i)).alias(f"line_{i + 1}") for i in range(4)], fits.alias("line_5_fits"), number)


@_query("emit_ordered", f"WITH RECURSIVE {_EMIT} SELECT * FROM emitted")
def emit_ordered(spark, sf_dir):
    return detect.emit(_scores(spark, sf_dir), P, SENSORS)


@_query("render_ntriples", _rendered(_EMIT))
def render_ntriples(spark, sf_dir):
    return _as_rendered(detect.emit(_scores(spark, sf_dir), P, SENSORS))


@_query("detect_end_to_end", _rendered(_DETECT))
def detect_end_to_end(spark, sf_dir):
    """From messages and the metadata graph to rendered anomalies, as the detector is meant to run."""
    known = metadata.checked(materialize(metadata.match_pattern(_triples(spark, sf_dir)), "metadata"))
    readings = graph.parse_any_order(_turned(_messages(spark, sf_dir)), known=known)
    return _as_rendered(detect.detect(readings, known, P))


@_query("detect_live", _rendered(_DETECT))
def detect_live(spark, sf_dir):
    """The same from a stream of messages that come out of order in several batches: parser, keyed detector, barrier, numbered output.

    A machine's messages are a second apart, and from its fifth on some come after their successors.
    """
    spent: list[str] = []
    groups = tables.groups(spark, sf_dir, spent).select("lts", "machine", *tables.SENSORS)
    nth = F.row_number().over(Window.partitionBy("machine").orderBy("lts")) - 1
    groups = groups.withColumn("nth", nth).withColumn("arrival", F.col("lts") + F.when(F.col("nth") > 4, F.pmod(F.col("nth") * 7, F.lit(3)) * 150).otherwise(0))
    out = shared_path(spark, "live")
    groups = materialize(groups, "groups", "zstd", spent)
    told = groups.agg(F.max("arrival").alias("last"), F.count(F.lit(1)).alias("n")).first()
    files = max(2, -(-told["n"] // (3 * STREAM_ROWS)))
    for i in range(3):  # one write after the other, so that batches come in this order
        part = groups.where(F.floor(F.col("arrival") * 3 / ((told["last"] or 0) + 1)) == i)
        part.repartition(files).write.mode("append").option("compression", "zstd").parquet(f"{out}/groups")
    clear(spark, spent)
    # Messages are made of their groups as they come, so that their text is never on a disk.
    stream = spark.readStream.schema(groups.schema).option("maxFilesPerTrigger", str(files)).parquet(f"{out}/groups")
    stream = _rendered_groups(stream, F.timestamp_seconds(F.lit(1_483_228_800) + F.col("nth")), "arrival")
    known = materialize(metadata.match_pattern(_triples(spark, sf_dir)), "metadata")
    return _as_rendered(detector.run_detection(stream, known, P, f"{out}/run"))


@_query(
    "emit_first_score",
    f"""WITH RECURSIVE {_KMEANS}, first AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY oldest_lts ORDER BY sensor) = 1
    ), placed AS (SELECT *, row_number() OVER (ORDER BY oldest_lts) - 1 AS r FROM first)
    SELECT machine, sensor, oldest_lts, ordinal, probability, row_number() OVER (ORDER BY oldest_lts) - 1 AS anomaly_id
    FROM placed WHERE r = oldest_lts AND probability < {P.theta}""",
)
def emit_first_score(spark, sf_dir):
    """The barrier that one score per logical time passes; scores arrive in the order of their sensors."""
    scores = _scores(spark, sf_dir).withColumn("arrival", F.col("sensor"))
    return detect.emit_single(scores, P.theta).drop("arrival")


@_query(
    "terminated_sensors",
    f"""WITH {_META}, ends AS (SELECT CAST(user_id % 30 + 1 AS INTEGER) AS machine, CAST(event_id % 4 + 1 AS INTEGER) AS sensor FROM events WHERE event_id % 7 < 3),
    came AS (SELECT machine, count(DISTINCT sensor) AS ended FROM ends GROUP BY machine),
    expected AS (SELECT machine, count(DISTINCT sensor) AS sensors FROM meta GROUP BY machine)
    SELECT machine, coalesce(ended, 0) AS ended, sensors, coalesce(ended, 0) = sensors AS done FROM expected LEFT JOIN came USING (machine)""",
)
def terminated_sensors(spark, sf_dir):
    """Machines that are done, by end marks of sensors, some of them repeated and some of unknown machines."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 7 < 3")
    ends = events.select((F.col("user_id") % 30 + 1).cast("int").alias("machine"), (F.col("event_id") % 4 + 1).cast("int").alias("sensor"))
    return detect.terminated(ends, metadata.sensors_per_machine(_metadata(spark, sf_dir)))


@_query("metadata_bgp", f"WITH {_META} SELECT machine, 'MOLDING' AS type, sensor, k, pt FROM meta")
def metadata_bgp(spark, sf_dir):
    return metadata.match_pattern(_triples(spark, sf_dir))


@_query(
    "metadata_stats",
    f"""WITH {_META}, h AS (SELECT k, count(*) AS n FROM meta GROUP BY k), hs AS (SELECT sensor, count(*) AS n FROM meta GROUP BY sensor), one AS (SELECT count(*) AS rows, count(DISTINCT machine) AS machines,
        count(DISTINCT (machine, sensor)) AS sensors, min(pt) AS min_pt, 1 - ceil(log10(min(pt))) AS digits, avg(k) AS mean_k FROM meta)
    SELECT 'rows' AS name, CAST(rows AS DOUBLE) AS value FROM one UNION ALL SELECT 'machines', machines FROM one UNION ALL SELECT 'sensors', sensors FROM one
    UNION ALL SELECT 'min_pt', min_pt FROM one UNION ALL SELECT 'digits', digits FROM one UNION ALL SELECT 'mean_k', mean_k FROM one
    UNION ALL SELECT 'max_share', max(n) / sum(n) FROM h UNION ALL SELECT 'min_share', min(n) / sum(n) FROM h
    UNION ALL SELECT 'max_sensor_share', max(n) / sum(n) FROM hs UNION ALL SELECT 'min_sensor_share', min(n) / sum(n) FROM hs""",
)
def metadata_stats(spark, sf_dir):
    return metadata.statistics(metadata.checked(metadata.match_pattern(_triples(spark, sf_dir))))


@_query("metadata_histogram", f"WITH {_META} SELECT pt AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM meta GROUP BY pt")
def metadata_histogram(spark, sf_dir):
    return metadata.histogram(_metadata(spark, sf_dir), "pt")


@_query("metadata_sensor_histogram", f"WITH {_META} SELECT sensor AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM meta GROUP BY sensor")
def metadata_sensor_histogram(spark, sf_dir):
    return metadata.histogram(_metadata(spark, sf_dir), "sensor")


@_query("metadata_sensors", f"WITH {_META} SELECT machine, count(DISTINCT sensor) AS sensors FROM meta GROUP BY machine")
def metadata_sensors(spark, sf_dir):
    return metadata.sensors_per_machine(_metadata(spark, sf_dir))


@_query(
    "metadata_described",
    f"""WITH {_META} SELECT machine, format('{{:04d}}: ', machine) || string_agg(format('{{:04d}}(k={{:02d}},pt={{:.4f}})', sensor, k, pt), ' ' ORDER BY sensor) AS text
    FROM meta GROUP BY machine""",
)
def metadata_described(spark, sf_dir):
    return metadata.described(_metadata(spark, sf_dir))


@_query("metadata_clusters", f"WITH {_META} SELECT sensor, array_to_string(list_sort(list(DISTINCT k)), ',') AS ks FROM meta GROUP BY sensor")
def metadata_clusters(spark, sf_dir):
    return metadata.clusters_by_sensor(_metadata(spark, sf_dir)).select("sensor", F.array_join(F.col("ks").cast("array<string>"), ",").alias("ks"))


@_query(
    "metadata_check",
    f"""WITH {_META}, told AS (SELECT machine, sensor, k, pt FROM meta UNION ALL SELECT machine, sensor, k + 1, pt FROM meta WHERE sensor = 2)
    SELECT machine, sensor, CAST(1 AS BIGINT) AS types, count(DISTINCT k) AS ks, count(DISTINCT pt) AS pts FROM told GROUP BY machine, sensor
    HAVING count(DISTINCT k) > 1 OR count(DISTINCT pt) > 1""",
)
def metadata_check(spark, sf_dir):
    """Conflicts found after sensor 2 of each machine is told twice."""
    rows = _metadata(spark, sf_dir).withColumn("type", F.lit("MOLDING"))
    return metadata.conflicts(rows.unionByName(rows.where("sensor = 2").withColumn("k", F.col("k") + 1)))


@_query("relevant_sensors", f"WITH {_READINGS}, {_META} SELECT r.* FROM readings r SEMI JOIN meta m ON r.machine = m.machine AND r.sensor = m.sensor")
def relevant_sensors(spark, sf_dir):
    return metadata.relevant(tables.readings(spark, sf_dir), _metadata(spark, sf_dir))


_PARSED = f"WITH {_READINGS} SELECT r.machine, r.sensor, epoch_ms(li.l_shipdate) AS ts, r.lts, r.value FROM readings r JOIN li ON r.lts = li.lts"


@_query("parse_oo", _PARSED)
def parse_oo(spark, sf_dir):
    """Messages whose lines stand in reverse order."""
    return graph.parse_any_order(_turned(_messages(spark, sf_dir)))


@_query("parse_io", _PARSED)
def parse_io(spark, sf_dir):
    return graph.parse_in_order(_messages(spark, sf_dir))


@_query("parse_triples", f"WITH {_READINGS} SELECT * FROM readings")
def parse_triples(spark, sf_dir):
    return graph.parse_facts(_messages(spark, sf_dir))


def _fates(gaps: str) -> str:
    return "WITH " + _ARRIVALS.format(gaps=gaps)


_GAPS = "WHERE t % 37 <> 36"


@_query("reorder_flush", f"{_fates(_GAPS)} SELECT machine, sensor, ts, value, row_number() OVER (PARTITION BY machine ORDER BY ts) - 1 AS ordinal FROM arrivals")
def reorder_flush(spark, sf_dir):
    """What a flush at the end gives: everything in order, gaps included."""
    return reorder.in_time_order(tables.arrivals(spark, sf_dir, gaps=True))


#: The sorter by counts with two parsers: a key starts once three times are there and the second follows the smallest.
_COUNTED = f"""{_fates(_GAPS)}, seen AS (
        SELECT a.machine, a.arrival, a.least, b.arrival AS came1 FROM (
            SELECT machine, arrival, min(ts) OVER (PARTITION BY machine ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS least FROM arrivals
        ) a JOIN arrivals b ON a.machine = b.machine AND b.ts = a.least + 1 WHERE a.arrival >= 2 AND b.arrival <= a.arrival
    ), begun AS (SELECT machine, min(arrival) AS warm, arg_min(least, arrival) AS start_ts FROM seen GROUP BY machine
    ), lined AS (
        SELECT a.machine, a.ts, a.arrival, a.value, b.warm, coalesce(b.start_ts, min(a.ts) OVER (PARTITION BY a.machine)) AS start_ts
        FROM arrivals a LEFT JOIN begun b ON a.machine = b.machine
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY machine ORDER BY ts) - 1 = ts - start_ts AS in_run,
               greatest(max(arrival) OVER (PARTITION BY machine ORDER BY ts ROWS UNBOUNDED PRECEDING), warm) AS release
        FROM lined WHERE ts >= start_ts
    ), counted AS (
        SELECT machine, 0 AS sensor, ts, value, warm IS NULL AS flushed, row_number() OVER (PARTITION BY machine ORDER BY ts) - 1 AS ordinal
        FROM placed WHERE in_run AND (warm IS NULL OR arrival <= release)
    )"""


@_query("count_sorter", f"{_COUNTED} SELECT * FROM counted")
def count_sorter(spark, sf_dir):
    return reorder.count_sorted(tables.arrivals(spark, sf_dir, gaps=True), 1, 2)


@_query(
    "count_sorter_ends",
    f"""{_COUNTED} SELECT a.machine, 0 AS sensor, count(*) FILTER (WHERE p.machine IS NOT NULL AND NOT p.in_run) AS pending,
        count(*) FILTER (WHERE p.machine IS NOT NULL AND NOT p.in_run) = 0 AS passed
    FROM arrivals a LEFT JOIN placed p ON a.machine = p.machine AND a.ts = p.ts GROUP BY a.machine""",
)
def count_sorter_ends(spark, sf_dir):
    return reorder.count_sorter_ends(tables.arrivals(spark, sf_dir, gaps=True), 1, 2)


@_query(
    "time_sorter",
    f"""{_fates(_GAPS)}, seen AS (
        SELECT machine, arrival, min(ts) OVER (PARTITION BY machine ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS least FROM arrivals
    ), begun AS (
        SELECT a.machine, min(a.arrival) AS warm, arg_min(a.least, a.arrival) AS start_ts
        FROM seen a JOIN arrivals l ON l.machine = a.machine AND l.ts = a.least JOIN arrivals n ON n.machine = a.machine AND n.ts = a.least + 1
        WHERE a.arrival > l.arrival AND n.arrival <= a.arrival AND a.arrival * 100 >= l.arrival * 100 + 150 GROUP BY a.machine
    ), told AS (SELECT a.*, b.warm, b.start_ts AS begin_ts FROM arrivals a LEFT JOIN begun b ON a.machine = b.machine
    ), placed AS (
        SELECT machine, ts, row_number() OVER (PARTITION BY machine ORDER BY ts) - 1 = ts - begin_ts AS in_run,
               greatest(max(arrival) OVER (PARTITION BY machine ORDER BY ts ROWS UNBOUNDED PRECEDING), warm) AS release
        FROM told WHERE ts >= begin_ts
    ), stopped AS (SELECT machine, min(arrival) FILTER (WHERE arrival > warm AND ts < begin_ts) AS blocked FROM told GROUP BY machine
    ), sent AS (
        SELECT t.machine, 0 AS sensor, t.ts, t.value, NOT coalesce(p.in_run AND (s.blocked IS NULL OR p.release < s.blocked), false) AS flushed
        FROM told t JOIN stopped s ON t.machine = s.machine LEFT JOIN placed p ON p.machine = t.machine AND p.ts = t.ts
    )
    SELECT *, row_number() OVER (PARTITION BY machine ORDER BY flushed, ts) - 1 AS ordinal FROM sent""",
)
def time_sorter(spark, sf_dir):
    """A reading comes every 100 ms of wall clock; a key waits for 150 ms after its smallest time."""
    rows = tables.arrivals(spark, sf_dir, gaps=True).withColumn("clock", F.col("arrival") * 100)
    return reorder.time_sorted(rows, 1, 1, 150)


@_query(
    "reorder_arrival",
    f"{_fates('')} SELECT machine, sensor, ts, value, release, row_number() OVER (PARTITION BY machine ORDER BY ts) - 1 AS ordinal FROM fates WHERE fate = 'released'",
)
def reorder_arrival(spark, sf_dir):
    return reorder.released(tables.arrivals(spark, sf_dir))


@_query("late_dropped", f"{_fates('')} SELECT machine, sensor, arrival, ts, value FROM fates WHERE fate = 'late'")
def late_dropped(spark, sf_dir):
    return reorder.classify_arrivals(tables.arrivals(spark, sf_dir)).where("fate = 'late'").select("machine", "sensor", "arrival", "ts", "value")


@_query("gap_blocked", f"{_fates(_GAPS)} SELECT machine, sensor, fate, count(*) AS n FROM fates GROUP BY ALL")
def gap_blocked(spark, sf_dir):
    fates = reorder.classify_arrivals(tables.arrivals(spark, sf_dir, gaps=True))
    return fates.groupBy("machine", "sensor", "fate").agg(F.count(F.lit(1)).alias("n"))


@_query("dedup_messages", "SELECT event_id, min(user_id) AS user_id, min(ts) AS ts FROM events GROUP BY event_id")
def dedup_messages(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    twice = events.withColumn("delivery", F.lit(0)).unionByName(events.where("event_id % 3 = 0").withColumn("delivery", F.lit(1)))
    return reorder.dedup_messages(twice, "event_id", "delivery").drop("delivery")


def _times_32(x: str, c: int) -> str:
    """The product modulo 2 ** 32 in SQL of 64-bit numbers."""
    return f"((({x} & 65535) * {c} + (((({x} >> 16) * {c}) & 65535) << 16)) & 4294967295)"


def _turned_32(x: str, bits: int) -> str:
    return f"((({x} << {bits}) | ({x} >> {32 - bits})) & 4294967295)"


# The constants of murmur3 for 32 bits.
_MURMUR_STEPS = [
    _times_32("x", 0xCC9E2D51), _turned_32("x", 15), _times_32("x", 0x1B873593), _turned_32("x", 13), f"((x * 5 + {0xE6546B64}) & 4294967295)", "xor(x, 4)",
    "xor(x, x >> 16)", _times_32("x", 0x85EBCA6B), "xor(x, x >> 13)", _times_32("x", 0xC2B2AE35), "xor(x, x >> 16)",
]
GROUPS, PARALLELISM = 128, 6


def _murmur(source: str) -> str:
    """``source``, whose column x is the hash of a key, with x folded step by step."""
    for step in _MURMUR_STEPS:
        source = f"SELECT * REPLACE ({step} AS x) FROM ({source})"
    return source


@_query(
    "key_partition",
    f"""WITH {_READINGS}, keys AS (SELECT machine, sensor, count(*) AS n, (31 * CAST(machine AS BIGINT) + sensor) & 4294967295 AS x FROM readings GROUP BY machine, sensor
    ), mixed AS ({_murmur("SELECT * FROM keys")}
    ), grouped AS (SELECT n, CASE WHEN x < 2147483648 THEN x WHEN x > 2147483648 THEN 4294967296 - x ELSE 0 END % {GROUPS} AS key_group FROM mixed)
    SELECT CAST(key_group AS INTEGER) AS key_group, CAST(key_group * {PARALLELISM} // {GROUPS} AS INTEGER) AS operator, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_keys
    FROM grouped GROUP BY key_group""",
)
def key_partition(spark, sf_dir):
    """Rows and keys of each key group, and the parallel task it belongs to."""
    group = fields.key_group(fields.key_hash(F.col("machine"), F.col("sensor")), GROUPS)
    keys = tables.readings(spark, sf_dir).groupBy("machine", "sensor").agg(F.count(F.lit(1)).alias("n"))
    per = keys.groupBy(group.alias("key_group")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_keys"))
    return per.select("key_group", fields.operator_of(F.col("key_group"), PARALLELISM, GROUPS).alias("operator"), "n", "n_keys")


@_query(
    "message_lines",
    """WITH one AS (SELECT p_partkey, p_name || chr(10) || p_brand || chr(10) || p_type AS payload FROM part)
    SELECT p_partkey AS id, CAST(unnest(range(3)) AS INTEGER) AS seq, unnest(string_split(payload, chr(10))) AS line FROM one""",
)
def message_lines(spark, sf_dir):
    """Lines of messages, numbered."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return graph.numbered_lines(parts.select("p_partkey", F.concat_ws("\n", "p_name", "p_brand", "p_type").alias("payload")), "p_partkey")


@_query("stream_dedup", "SELECT DISTINCT event_id, user_id FROM events")
def stream_dedup(spark, sf_dir):
    """Events that a stream delivers twice, once each: ids are held as long as its watermark says."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    twice = stream.withColumn("delivery", F.explode(F.array(F.lit(0), F.lit(1))))
    out = shared_path(spark, "dedup")
    detector.run_dedup(twice.withColumn("ts", F.col("ts").cast("timestamp")), "event_id", "ts", "3650 days", out)
    return spark.read.parquet(f"{out}/messages").select("event_id", "user_id")


@_query(
    "config_from_triples",
    """SELECT 'machine.' || s_suppkey || '.balance' AS key, CAST(CAST(s_acctbal * 100 AS BIGINT) AS VARCHAR) AS value FROM supplier WHERE s_suppkey % 2 = 0""",
)
def config_from_triples(spark, sf_dir):
    """Settings in a graph among other triples and non-literals."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key = F.concat(F.lit(CONFIG_PREFIX + "machine."), F.col("s_suppkey").cast("string"), F.lit(".balance"))
    cents = F.round(F.col("s_acctbal") * 100).cast("long").cast("string")
    told = rows.select(
        F.lit("http://example.org/run").alias("s"),
        key.alias("p"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('"'), cents, F.lit(f'"^^<{XSD}long>'))).otherwise(F.lit("http://example.org/no-literal")).alias("o"),
    )
    return settings_of_triples(told.unionByName(_triples(spark, sf_dir)), CONFIG_PREFIX)


@_query(
    "stream_scores",
    f"""WITH RECURSIVE {_fates('')[5:]}, readings AS (SELECT machine, sensor, ts AS lts, value FROM fates WHERE fate = 'released'
    ), {_wins()}, {_CLUSTERED} SELECT * FROM scores""",
)
def stream_scores(spark, sf_dir):
    """The streaming detector over the events of each user, run to the end of what is there; equals the batch scores of what the reordering releases."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    arrivals = events.select(F.col("user_id").cast("int").alias("machine"), F.lit(0).alias("sensor"), F.col("event_id").alias("arrival"), "value")
    dense = _dense(spark, sf_dir, arrivals).withColumn("lts", F.col("ts")).withColumn("k", F.lit(K))
    out = shared_path(spark, "stream")
    detector.run_available(dense, Params(delta=1), out)
    return spark.read.schema(SCORE).parquet(f"{out}/scores")


def _dense(spark, sf_dir, arrivals: DataFrame) -> DataFrame:
    """Times 0, 1, 2, ... of each user in place of wall-clock ones, from the table of arrivals."""
    told = tables.arrivals(spark, sf_dir)
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    t = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    by_event = ids.select(F.col("user_id").cast("int").alias("m"), "event_id", t.alias("t"))
    dense = by_event.join(told.select(F.col("machine").alias("m2"), F.col("ts").alias("t2"), F.col("arrival").alias("dense_arrival")), (F.col("m") == F.col("m2")) & (F.col("t") == F.col("t2")))
    dense = dense.select(F.col("event_id").alias("eid"), "t", "dense_arrival")
    return arrivals.join(dense, F.col("arrival") == F.col("eid")).select("machine", "sensor", F.col("dense_arrival").alias("arrival"), F.col("t").alias("ts"), "value")
