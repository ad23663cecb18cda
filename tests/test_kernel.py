import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.config import Params, as_int_set, from_settings, parse_properties
from millrace.functions import markov

GOLDEN = [
    ([1, 2, 10, 11, 1.5, 10.5, 2.5, 1, 10, 2], 2, 5, [0, 0, 1, 1, 0, 1, 0, 0, 1, 0], 0.081),
    ([0, 2, 1, 0, 2, 1, 1, 0, 2, 1], 2, 5, [0, 1, 1, 0, 1, 1, 1, 0, 1, 1], 0.09876543209876543),
    ([5] * 10, 3, 5, [0] * 10, 1.0),
    ([1, 2, 1, 2, 1], 2, 5, [0, 1, 0, 1, 0], 1.0),
    ([1, 5, 9, 1, 9, 5, 1, 1, 9, 9], 3, 5, [0, 1, 2, 0, 2, 1, 0, 0, 2, 2], 0.006944444444444444),
    ([8, 20, 22, 9, 14, 22, 10, 15], 4, 4, [0, 3, 3, 0, 2, 3, 0, 2], 0.2962962962962963),
    ([9, 6, 9, 4, 1, 2, 8, 8, 3, 5], 3, 5, [2, 1, 2, 1, 0, 0, 2, 2, 0, 1], 0.0023148148148148147),
]


@pytest.mark.parametrize("win,k,n,labels,p", GOLDEN)
def test_golden(win, k, n, labels, p):
    params = Params(window=len(win), transitions=n)
    got = markov.label_windows(np.array([win], float), np.array([k]), params)
    assert got[0].tolist() == labels
    assert markov.replay(got, params)[0] == pytest.approx(p, rel=1e-12)


def test_not_a_number_is_refused():
    with pytest.raises(ValueError):
        markov.label_windows(np.array([[1.0, np.nan]]), np.array([2]), Params(window=2))


def one_window(win, k, params):
    """The same rules, one window at a time, in plain Python."""
    seeds = []
    for v in win:
        if v not in seeds and len(seeds) < k:
            seeds.append(v)
    c, lab = sorted(seeds), []
    for _ in range(params.iterations):
        lab = [max(range(len(c)), key=lambda j: (-abs(c[j] - v), j)) for v in win]
        groups = [[v for v, q in zip(win, lab) if q == j] for j in range(len(c))]
        if not all(groups):
            break
        new = []
        for g in groups:
            total = 0.0
            for v in g:
                total += v
            new.append(total / len(g))
        moved = 0.0
        for a, b in zip(new, c):
            moved += abs(a - b)
        c = new
        if moved <= params.epsilon:
            break
    return lab


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-20, 20), min_size=6, max_size=6), min_size=1, max_size=5), st.integers(1, 5))
def test_batches_equal_single_windows(wins, k):
    params = Params(window=6, transitions=3)
    x = np.array(wins, float) / 4
    got = markov.label_windows(x, np.full(len(x), k), params)
    assert got.tolist() == [one_window(w.tolist(), k, params) for w in x]
    p = markov.replay(got, params)
    assert ((p > 0) & (p <= 1)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(-20, 20), min_size=6, max_size=6), st.integers(1, 5)), min_size=2, max_size=8))
def test_each_window_has_its_own_number_of_clusters(rows):
    params = Params(window=6, transitions=3)
    x = np.array([w for w, _ in rows], float) / 4
    got = markov.label_windows(x, np.array([k for _, k in rows]), params)
    assert got.tolist() == [one_window(w.tolist(), k, params) for w, (_, k) in zip(x, rows)]


def test_expression_form_agrees(spark):
    params = Params(window=8, transitions=4, iterations=6)
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(0, 30, 8)]) for i in range(12)]
    df = spark.createDataFrame(rows, "i int, win array<double>").withColumn("k", F.lit(3))
    lab = markov.labels_expr(F.col("win"), F.col("k"), params)
    got = df.select("i", lab.alias("a"), markov.labels_udf(params)("win", "k").alias("b"), markov.probability_udf(params)("win", "k").alias("p"))
    got = got.withColumn("q", markov.probability_expr(F.col("b"), params)).collect()
    assert len(got) == 12 and all(r["a"] == r["b"] and r["p"] == r["q"] for r in got)


def test_settings():
    text = "# note\nwindow.size = 12\nprobability.treshold=0.01\n\nother=x\nwindow.size=11\n"
    assert from_settings(parse_properties(text)) == Params(window=11, theta=0.01)
    assert as_int_set("3:1:3") == {1, 3}
