"""The detector as a streaming query: keyed reordering and windows, and an ordered output barrier.

State per (machine, sensor) is in Spark's RocksDB state store: readings that wait are entries of
a map by key and time, so a batch writes what it adds and removes, not all that waits. Each
micro-batch's rows of a key are taken in the order of ``arrival``, since a shuffle keeps none.

Keys are dealt into ``BUCKETS``, and a task's readings of a bucket travel as one value, as Spark hands
a stateful processor its rows one by one. The processor takes all keys of a bucket at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from millrace.config import Params
from millrace.functions.markov import CHUNK, score_columns
from millrace.operators import detect, metadata as meta
from millrace.schema import SCORE
from millrace.sources import graph
from millrace.sources.shared import clear, few

#: Keys are dealt into so many buckets, each one state; a shuffle deals the buckets to tasks.
BUCKETS = 1024
#: Readings that are gathered before they are packed by bucket.
PACKED = 1 << 18
_READING = np.dtype([("arrival", "<i8"), ("ts", "<i8"), ("lts", "<i8"), ("value", "<f8"), ("machine", "<i4"), ("sensor", "<i4"), ("k", "<i4"), ("nulls", "u1")])
_KEY = "machine int, sensor int"
_FLAGS = "steady boolean, current long, ordinal long, waiting long, win binary, win_lts binary"
#: What holds while a stream starts; batches of texts of a mebibyte stay in a core's cache on their way to Python.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20),
}


class KeyedDetector:
    """The state machine of one key: warm-up, release in order of time, one score per full window.

    A value that isn't a finite number releases its time like any other and is left out of
    windows. ``pending`` is a dict, or what looks like one, of (value, lts) by time.
    """

    def __init__(self, params: Params, k: int, flags=None, pending=None):
        self.params, self.k = params, k
        self.steady, self.current, self.ordinal, win, win_lts = flags or (False, 0, -1, [], [])
        self.win, self.win_lts = list(win), list(win_lts)
        self.pending = {} if pending is None else pending

    def flags(self):
        return (self.steady, self.current, self.ordinal, self.win, self.win_lts)

    def push(self, ts: int, value: float, lts: int | None = None) -> list[tuple[int, float, int]]:
        """Takes a reading; returns (time, value, logical time) of what it releases, in order of time."""
        if self.steady and ts < self.current:
            return []  # late
        pending, delta = self.pending, self.params.delta
        pending[ts] = (value, ts if lts is None else lts)
        if not self.steady:
            m, start = self.params.min_sequence, min(pending)
            if len(pending) <= m or any(start + j * delta not in pending for j in range(m)):
                return []
            self.steady, self.current = True, start
        out = []
        while self.current in pending:
            out.append((self.current, *pending.pop(self.current)))
            self.current += delta
        return out

    def release(self, ts: np.ndarray, value: np.ndarray, lts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, logical times) of what readings in the order of their arrival release, in order of time; as :meth:`push` of each.

        Once a stream is steady, readings whose times are distinct, not late and on the grid of
        ``delta`` release the same in whatever order they come, so they are sorted at once.
        """
        i, out = 0, []
        while i < len(ts) and not self.steady:
            out += self.push(int(ts[i]), float(value[i]), int(lts[i]))
            i += 1
        ts, value, lts = ts[i:], value[i:], lts[i:]
        held = np.array(list(self.pending), dtype=np.int64) if len(ts) else ts
        every = np.concatenate([ts, held])
        order = np.argsort(every, kind="stable")
        step, off = np.divmod(every[order] - self.current, max(self.params.delta, 1))
        if self.params.delta < 1 or off.any() or (step[:1] < 0).any() or (step[1:] == step[:-1]).any():
            for row in zip(ts.tolist(), value.tolist(), lts.tolist()):
                out += self.push(*row)
            ts = ts[:0]
        done = np.array([r[1] for r in out], dtype=np.float64), np.array([r[2] for r in out], dtype=np.int64)
        if not len(ts):
            return done
        n = int(np.count_nonzero(step == np.arange(len(step))))  # steps are distinct and ascend, so those in line come first
        gone, left = order[:n], order[n:]
        told = np.concatenate([value, np.zeros(len(held))]), np.concatenate([lts, np.zeros(len(held), dtype=np.int64)])
        for j in gone[gone >= len(ts)].tolist():
            told[0][j], told[1][j] = self.pending.pop(int(every[j]))
        for j in left[left < len(ts)].tolist():
            self.pending[int(ts[j])] = (float(value[j]), int(lts[j]))
        self.current += n * self.params.delta
        return np.concatenate([done[0], told[0][gone]]), np.concatenate([done[1], told[1][gone]])

    def windows(self, ts: np.ndarray, value: np.ndarray, lts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(values, logical times, ordinal of the first, place of the first that ends a new window) of the readings that windows are cut of."""
        value, lts = self.release(ts, value, lts)
        real = np.isfinite(value)
        old, size = len(self.win), self.params.window
        value, lts = np.concatenate([self.win, value[real]]), np.concatenate([np.array(self.win_lts, dtype=np.int64), lts[real]])
        first = self.ordinal + 1 - old
        self.ordinal += len(value) - old
        tail = max(0, len(value) - (size - 1))
        self.win, self.win_lts = value[tail:], lts[tail:]
        return value, lts, first, max(old, size - 1)


def _windows_of(found: list, params: Params) -> pd.DataFrame:
    """SCORE rows of the windows of (machine, sensor, k, values, logical times, ordinal of the first, first end), key by key."""
    size, at, ends, owner, ordinal = params.window, 0, [], [], []
    for i, (_, _, _, value, _, first, begin) in enumerate(found):
        end = np.arange(begin, len(value))
        ends.append(at + end)
        ordinal.append(first + end)
        owner.append(np.full(len(end), i))
        at += len(value)
    ends, owner, ordinal = np.concatenate(ends), np.concatenate(owner), np.concatenate(ordinal)
    value, lts = np.concatenate([x[3] for x in found]), np.concatenate([x[4] for x in found])
    k, made = np.array([x[2] for x in found])[owner], score_columns(params)
    p = [np.empty(0)]
    for i in range(0, len(ends), CHUNK):
        e = ends[i : i + CHUNK]
        p.append(made(value[e - (size - 1) + np.arange(size)[:, None]], k[i : i + CHUNK]).to_numpy())
    names = [pd.array([x[c] for x in found], dtype="Int32").take(owner) for c in (0, 1)]
    return pd.DataFrame({"machine": names[0], "sensor": names[1], "oldest_lts": lts[ends - (size - 1)], "ordinal": ordinal.astype(np.int64), "probability": np.concatenate(p)})


class _Waiting:
    """Readings of ``key`` that wait, as a dict over a map state: what a batch adds stays in memory until :meth:`store`.

    ``held`` are the times that the state has for the key, if they are known.
    """

    def __init__(self, state, key: tuple = (), held: set[int] | None = None):
        self.state, self.key, self.new, self.keys = state, key, {}, held
        self.old = held is None and state.exists()

    def _held(self) -> set[int]:
        """Times in the state; asked for once, since each question goes to the state's server."""
        if self.keys is None:
            self.keys = {k[-1] for k in self.state.keys() if tuple(k[:-1]) == self.key} if self.old else set()
        return self.keys

    def __contains__(self, ts: int) -> bool:
        return ts in self.new or ts in self._held()

    def __setitem__(self, ts: int, row: tuple) -> None:
        self.new[ts] = row

    def __iter__(self) -> Iterator[int]:
        return iter({*self._held(), *self.new})

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def pop(self, ts: int) -> tuple:
        held = self.state.getValue((*self.key, ts)) if ts in self._held() else None
        if held is not None:
            self.state.removeKey((*self.key, ts))
            self.keys.remove(ts)
        return self.new.pop(ts) if ts in self.new else tuple(held)

    def store(self) -> None:
        for ts, row in self.new.items():
            self.state.updateValue((*self.key, ts), row)


def _whole(column, missing: int) -> np.ndarray:
    return column.fill_null(missing).to_numpy()


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(bucket, rows) of readings (bucket, machine, sensor, arrival, ts, lts, value, k); the bytes of the rows stand place by place, so that they compress."""
    told = pa.Table.from_batches(batches)
    if told["ts"].null_count:
        raise ValueError("reading without time")
    bucket = told["bucket"].to_numpy()
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    bucket, rows = bucket[order], np.empty(len(order), dtype=_READING)
    for name in ("machine", "sensor", "ts", "k"):
        rows[name] = _whole(told[name], 0)[order]
    rows["arrival"] = _whole(told["arrival"], (1 << 63) - 1)[order]
    rows["lts"] = (_whole(told["lts"], 0) if not told["lts"].null_count else told["lts"].combine_chunks().fill_null(told["ts"].combine_chunks()).to_numpy())[order]
    rows["value"] = told["value"].to_numpy()[order]  # null: NaN
    rows["nulls"] = (told["machine"].is_null().to_numpy() + 2 * told["sensor"].is_null().to_numpy())[order]
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(order)]
    texts = [rows[a:z].view(np.uint8).reshape(z - a, -1).T.tobytes() for a, z in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array(texts, pa.binary())], names=["bucket", "rows"])


def _unpacked(rows: bytes) -> np.ndarray:
    return np.frombuffer(rows, dtype=np.uint8).reshape(_READING.itemsize, -1).T.copy().view(_READING)[:, 0]


def pack(batches):
    """For mapInArrow: readings, PACKED or a few more at a time, as a row a bucket."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACKED:
            yield _packed(held)
            held, n = [], 0
    if n:
        yield _packed(held)


class _Processor(StatefulProcessor):
    def __init__(self, params: Params):
        self.params = params

    def init(self, handle) -> None:
        self.state = handle.getMapState("flags", _KEY, _FLAGS)
        self.waiting = handle.getMapState("waiting", f"{_KEY}, ts long", "value double, lts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = np.concatenate([_unpacked(x) for frame in rows for x in frame["rows"]])
        told = told[np.lexsort([told[c] for c in ("lts", "arrival", "sensor", "machine", "nulls")])]
        fresh = np.zeros(len(told), dtype=bool)
        for c in ("sensor", "machine", "nulls"):
            fresh[1:] |= told[c][1:] != told[c][:-1]
        cuts = [0, *np.flatnonzero(fresh).tolist(), len(told)]
        known, held, found = self.state.exists(), None, []
        ts, lts, value = (np.ascontiguousarray(told[c]) for c in ("ts", "lts", "value"))
        for a, z in zip(cuts, cuts[1:]):
            _, _, _, _, machine, sensor, k, nulls = told[a].tolist()
            name = (None if nulls & 1 else machine, None if nulls & 2 else sensor)
            flags = self.state.getValue(name) if known else None
            if flags is not None and flags[3] and held is None:  # once for all keys of the bucket
                held = {}
                for m, s, t in self.waiting.keys():
                    held.setdefault((m, s), set()).add(t)
            waiting = _Waiting(self.waiting, name, held.get(name, set()) if flags is not None and flags[3] else set())
            before = flags and (*flags[:3], np.frombuffer(flags[4], dtype=np.float64), np.frombuffer(flags[5], dtype=np.int64))
            detector = KeyedDetector(self.params, k, before, waiting)
            found.append((*name, k, *detector.windows(ts[a:z], value[a:z], lts[a:z])))
            waiting.store()
            steady, current, ordinal, win, win_lts = detector.flags()
            self.state.updateValue(name, (steady, current, ordinal, len(waiting), win.tobytes(), win_lts.tobytes()))
        scores = _windows_of(found, self.params)
        if len(scores):
            yield scores

    def close(self) -> None:
        pass


def stream_scores(arrivals: DataFrame, params: Params) -> DataFrame:
    """SCORE rows of a stream of (machine, sensor, arrival, ts, lts, value, k); ``k`` is its sensor's number of clusters."""
    kinds = {"machine": "int", "sensor": "int", "arrival": "long", "ts": "long", "lts": "long", "value": "double", "k": "int"}
    bucket = F.pmod(F.hash("machine", "sensor"), F.lit(BUCKETS)).alias("bucket")
    rows = arrivals.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()]).select(bucket, *kinds)
    packed = rows.mapInArrow(pack, "bucket int, rows binary")
    return packed.groupBy("bucket").transformWithStateInPandas(_Processor(params), SCORE, "append", "None")


class OutputBarrier:
    """For foreachBatch: emits anomalies of a logical time once it and all before it are complete.

    ``sensors`` is as of :func:`millrace.operators.detect.complete_times`. Under ``path`` each
    epoch writes the scores that came, once, then what it emits, then how far output has come
    and which epochs still hold scores beyond that. So nothing that waits is written again, and
    an epoch that runs again writes the same again. Scores that are all behind the output are
    deleted by the next epoch.
    """

    def __init__(self, path: str, params: Params, sensors):
        self.path, self.params, self.sensors = path.rstrip("/"), params, sensors

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.select(*[f.split()[0] for f in SCORE.split(", ")]).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/scores/{epoch}")
        cursor, open_epochs = 0, []
        if epoch:
            before = self._progress(spark, epoch - 1)
            cursor, open_epochs = before["cursor"], list(before["open_epochs"])
            was_open = [*self._progress(spark, epoch - 2)["open_epochs"], epoch - 1] if epoch > 1 else [0]
            clear(spark, [f"{self.path}/scores/{e}" for e in was_open if e not in open_epochs])  # the epoch before won't run again
        epochs = [*open_epochs, epoch]
        read = spark.read.schema(SCORE)
        waiting = read.parquet(*[f"{self.path}/scores/{e}" for e in epochs]).where(F.col("oldest_lts") >= cursor)  # older ones are stale
        gap = detect.first_gap(detect.complete_times(waiting, self.sensors), cursor)
        done = detect.below(waiting.where(F.col("oldest_lts") < gap), self.params.theta)
        done.write.mode("overwrite").parquet(f"{self.path}/emitted/{epoch}")
        still = [e for e in epochs if not read.parquet(f"{self.path}/scores/{e}").where(F.col("oldest_lts") >= gap).isEmpty()]
        spark.createDataFrame([(gap, still)], "cursor long, open_epochs array<long>").write.mode("overwrite").parquet(f"{self.path}/progress/{epoch}")

    def _progress(self, spark: SparkSession, epoch: int):
        return spark.read.parquet(f"{self.path}/progress/{epoch}").first()

    def emitted(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SCORE).parquet(f"{self.path}/emitted/*")


class Progress(StreamingQueryListener):
    """Counts of a session's streams: batches, rows, and milliseconds that their batches took, with the mean per row."""

    def __init__(self):
        self.batches, self.rows, self.millis = 0, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows
        self.millis += event.progress.durationMs.get("triggerExecution", 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    @property
    def mean(self) -> float:
        return self.millis / self.rows if self.rows else 0.0


def dedup_stream(messages: DataFrame, id_col: str, time_col: str, delay: str) -> DataFrame:
    """The first of messages with one id that come within ``delay`` of one another; ids are forgotten after that."""
    return messages.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def _run(stream: DataFrame, out: str, add) -> None:
    spark = stream.sparkSession
    before = {key: spark.conf.get(key, None) for key in _SETTINGS}
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    try:
        query = add(stream.writeStream.option("checkpointLocation", f"{out}/checkpoint")).trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
    query.awaitTermination()


def run_available(arrivals: DataFrame, params: Params, out: str) -> None:
    """Scores all that is there into a table at ``out`` and ends; a later call goes on from its checkpoint."""
    _run(stream_scores(arrivals, params), out, lambda w: w.format("parquet").option("path", f"{out}/scores"))


def run_dedup(messages: DataFrame, id_col: str, time_col: str, delay: str, out: str) -> None:
    """Writes the messages that are there, each id once, into a table at ``out`` and ends; a later call goes on from its checkpoint."""
    _run(dedup_stream(messages, id_col, time_col, delay), out, lambda w: w.format("parquet").option("path", f"{out}/messages"))


def run_detection(messages: DataFrame, metadata: DataFrame, params: Params, out: str) -> DataFrame:
    """Detects on all messages (payload, arrival) that are there and ends; a later call goes on from its checkpoint.

    Messages are parsed, known sensors scored with their own numbers of clusters, scores held
    by the barrier until their logical times are complete; returns the numbered anomalies
    emitted so far.
    """
    known = few(metadata.select("machine", "sensor", "k").distinct())
    readings = graph.parse_any_order(messages, known=known, keep=["arrival"]).join(known, ["machine", "sensor"])
    barrier = OutputBarrier(f"{out}/barrier", params, meta.sensors_per_machine(metadata))
    _run(stream_scores(readings, params), out, lambda w: w.foreachBatch(barrier))
    numbered = detect.number_anomalies(barrier.emitted(messages.sparkSession))
    return numbered.withColumn("timestamp", F.col("ordinal") - params.transitions)
