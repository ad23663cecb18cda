"""K-means of windows in one dimension, and the probability of their last transitions.

The Arrow form works on all windows of a batch at once and adds in window order, so its
numbers equal those of a loop over one window. The expression form needs no Python; it
is the slower of the two and serves as a second opinion.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.config import Params


#: Windows that the kernel takes at once, so that what it holds of them stays in a core's cache.
CHUNK = 2048


def _kind(*sizes: int):
    return np.int8 if max(sizes) < 127 else np.int32


def seed_centres(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The first k distinct values of each window (a column of ``x``) in order, ascending; missing ones are inf."""
    w, n = x.shape
    top = int(k.max(initial=1))
    out, have = np.full((top, n), np.inf), np.zeros(n, dtype=np.int64)
    for i in range(w):
        new = have < k
        for j in range(min(i, top)):
            new &= out[j] != x[i]
        at = np.flatnonzero(new)
        out[have[at], at] = x[i, at]
        have[at] += 1
    return np.sort(out, axis=0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The label of the nearest centre of each value, windows and their centres in columns; of two as near, the higher."""
    kind = _kind(len(centres), len(x))
    labels, least = np.zeros(x.shape, dtype=kind), np.abs(x - centres[0])
    for j in range(1, len(centres)):
        distance = np.abs(x - centres[j])
        np.maximum(labels, (distance <= least).astype(kind) * kind(j), out=labels)
        np.minimum(least, distance, out=least)
    return labels


def _label_columns(x: np.ndarray, k: np.ndarray, params: Params) -> np.ndarray:
    """Labels of the last assignment of each window, windows in columns. A round that leaves a cluster empty ends a window's rounds before its centres move."""
    w, n = x.shape
    if not np.isfinite(x).all():
        raise ValueError("a window holds a value that is not a number; drop those before windowing")
    centres, live = seed_centres(x, k), np.arange(n)
    labels = np.zeros((w, n), dtype=_kind(len(centres), w))
    for left in reversed(range(params.iterations)):
        lab = nearest(x, centres)
        means, moved, full = np.empty_like(centres), np.zeros(len(live)), np.ones(len(live), dtype=bool)
        for j, centre in enumerate(centres):
            own, total, real = lab == j, np.zeros(len(live)), np.isfinite(centre)
            counts = np.add.reduce(own, axis=0, dtype=labels.dtype)
            for row in np.where(own, x, 0.0):  # in window order
                total += row
            full &= ~real | (counts > 0)
            means[j] = np.where(real, total / np.maximum(counts, 1), np.inf)
            moved += np.abs(np.where(real, means[j], 0) - np.where(real, centre, 0))
        go_on = full & (moved > params.epsilon) & (left > 0)
        labels[:, live[~go_on]] = np.compress(~go_on, lab, axis=1)
        if not go_on.any():
            break
        live, x, centres = live[go_on], np.compress(go_on, x, axis=1), np.compress(go_on, means, axis=1)
    return labels


def label_windows(x: np.ndarray, k: np.ndarray, params: Params) -> np.ndarray:
    """Labels of each window (a row of ``x``)."""
    labels = np.zeros(x.shape, dtype=np.int64)
    for at in range(0, len(x), CHUNK):
        labels[at : at + CHUNK] = _label_columns(np.ascontiguousarray(x[at : at + CHUNK].T), k[at : at + CHUNK], params).T
    return labels


def _replay_columns(labels: np.ndarray, params: Params) -> np.ndarray:
    w, n = labels.shape
    p = np.ones(n)
    if params.transitions >= w:
        return p
    a, b = labels[:-1], labels[1:]
    count = lambda flags: np.add.reduce(flags, axis=0, dtype=_kind(w)).astype(np.float64)
    for i in range(w - params.transitions, w):
        start = a == labels[i - 1]
        p *= count(start & (b == labels[i])) / count(start)
    return p


def replay(labels: np.ndarray, params: Params) -> np.ndarray:
    """Product of the probabilities of the last transitions under the window's own transition counts; 1 where there are too few."""
    return _replay_columns(np.ascontiguousarray(labels.T), params)


def score_columns(params: Params):
    """For :func:`millrace.operators.windows.map_windows`: the probabilities of windows in columns."""
    return lambda x, k: pa.array(_replay_columns(_label_columns(x, k, params), params))


def text_of_labels(labels: np.ndarray) -> pa.Array:
    """The labels of each window, a column, as text, with commas between."""
    w, n = labels.shape
    if labels.max(initial=0) > 9:
        return pa.array([",".join(map(str, column)) for column in labels.T.tolist()], pa.string())
    text = np.full((n, 2 * w - 1), ord(","), dtype=np.uint8)
    text[:, ::2] = labels.T + ord("0")
    ends = np.arange(n + 1, dtype=np.int32) * (2 * w - 1)
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(text))


def first_labels(x: np.ndarray, k: np.ndarray) -> pa.Array:
    """For :func:`millrace.operators.windows.map_windows`: the labels of the first assignment, as text."""
    return text_of_labels(nearest(x, seed_centres(x, k)))


def count_transitions(labels: np.ndarray):
    """(window, source, target, n, total) of each distinct transition of each window: how often it stands, and how often its source does."""
    a, b = labels[:, :-1], labels[:, 1:]
    same_source = a[:, :, None] == a[:, None, :]
    same = same_source & (b[:, :, None] == b[:, None, :])
    window, place = np.nonzero(same.argmax(axis=2) == np.arange(a.shape[1]))  # the first of its like
    return window, a[window, place], b[window, place], same.sum(axis=2)[window, place], same_source.sum(axis=2)[window, place]


def transition_rows(wins, params: Params):
    """(machine, sensor, ordinal, source, target, n, total) of windows (machine, sensor, ordinal, win, k); no shuffle."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                labels = label_windows(x, part.column(4).to_numpy(zero_copy_only=False), params)
                window, *told = count_transitions(labels)
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
                keys = [part.column(i).take(pa.array(window)) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, *(pa.array(c, k) for c, k in zip(told, kinds))], names=["machine", "sensor", "ordinal", "source", "target", "n", "total"]
                )

    schema = "machine int, sensor int, ordinal long, source int, target int, n long, total long"
    return wins.select("machine", "sensor", "ordinal", "win", "k").mapInArrow(run, schema)


def _windows(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), dtype=np.float64).reshape(len(values), -1)


def labels_udf(params: Params):
    @F.pandas_udf("array<int>")
    def labels(values: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(list(label_windows(_windows(values), k.to_numpy(), params).astype(np.int32)))

    return labels


def probability_udf(params: Params):
    @F.pandas_udf("double")
    def probability(values: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(replay(label_windows(_windows(values), k.to_numpy(), params), params))

    return probability


def seeds_expr(values: Column, k: Column) -> Column:
    return F.array_sort(F.slice(F.array_distinct(values), 1, k))


def assign_expr(values: Column, centres: Column) -> Column:
    """Label of each value's nearest centre, ties to the higher."""
    each = lambda v: F.aggregate(
        F.sequence(F.lit(0), F.size(centres) - 1),
        F.lit(0),
        lambda best, i: F.when(F.abs(F.get(centres, i) - v) <= F.abs(F.get(centres, best) - v), i).otherwise(best),
    )
    return F.transform(values, each)


def labels_expr(values: Column, k: Column, params: Params) -> Column:
    """The labels as one expression: a fold over the rounds with the state (centres, labels, done)."""
    start = F.struct(seeds_expr(values, k).alias("c"), F.transform(values, lambda v: F.lit(0)).alias("l"), F.lit(False).alias("done"))

    def step(s, _):
        lab = assign_expr(values, s["c"])

        def mean(j):
            own = F.filter(F.zip_with(values, lab, lambda v, q: F.when(q == j, v)), lambda v: v.isNotNull())
            return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda t, v: t + v) / F.size(own))

        means = F.transform(F.sequence(F.lit(0), F.size(s["c"]) - 1), mean)
        empty = F.exists(means, lambda m: m.isNull())
        moved = F.aggregate(F.zip_with(means, s["c"], lambda a, b: F.abs(a - b)), F.lit(0.0), lambda t, v: t + v)
        then = F.struct(
            F.when(empty, s["c"]).otherwise(means).alias("c"), lab.alias("l"), (empty | (moved <= params.epsilon)).alias("done")
        )
        return F.when(s["done"], s).otherwise(then)

    return F.aggregate(F.sequence(F.lit(1), F.lit(params.iterations)), start, step)["l"]


def transitions_expr(labels: Column, params: Params) -> Column:
    """(source, target, count, total) of each transition replayed, in order."""
    pairs = F.arrays_zip(F.slice(labels, 1, params.window - 1).alias("a"), F.slice(labels, 2, params.window - 1).alias("b"))
    last = F.slice(pairs, -params.transitions, params.transitions)
    return F.transform(
        last,
        lambda t: F.struct(
            t["a"].alias("source"),
            t["b"].alias("target"),
            F.size(F.filter(pairs, lambda q: (q["a"] == t["a"]) & (q["b"] == t["b"]))).alias("n"),
            F.size(F.filter(pairs, lambda q: q["a"] == t["a"])).alias("total"),
        ),
    )


def probability_expr(labels: Column, params: Params) -> Column:
    if params.transitions >= params.window:
        return F.lit(1.0)
    return F.aggregate(transitions_expr(labels, params), F.lit(1.0), lambda p, t: p * (t["n"] / t["total"]))
