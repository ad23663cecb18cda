"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in an order that a hash of the row gives, are cut into blocks of equal
row counts. In the ideal mixture all sources flow at once, each at its exact weight over the
weights of the sources that have blocks left. Block k of a source is released at the slot in
which the ideal one begins it and due when the ideal one has ended it; each slot takes the
released block that is due earliest. The ideal mixture is a fractional schedule within these
bounds, so a whole one exists and earliest deadline first finds it: every deadline is met and
no source is ever a whole block ahead of or behind its exact share, whatever the length.

With v blocks per unit of weight served, the ideal mixture stands at the sum of min(v * weight,
blocks) over the sources: a line between the points where sources end, so release and
deadline of any block are whole-number arithmetic on its number. The merge by deadlines runs
in one task that holds one block of each source and writes slots as it goes; rows find theirs
by a join. The driver holds one row per source, whatever the number of rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from fractions import Fraction
from math import isqrt, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import clear, fresh, gapless_rank, materialize

#: Rows of a block, and cells that a source is dealt into for ranks.
BLOCK_ROWS, CHUNKS = 16, 512
#: Bits behind the point of a square root that is a weight, and slots that are written at a time.
ROOT_BITS, SLOTS_AT_ONCE = 32, 1 << 16


def root_weight(n: int) -> Fraction:
    """The square root of ``n`` down to 2 ** -ROOT_BITS."""
    return Fraction(isqrt(n << (2 * ROOT_BITS)), 1 << ROOT_BITS)


def _exact(blocks_of: dict, weights: dict):
    """(source, block, phase) slot by slot, for positive weights."""
    names = sorted((s for s, n in blocks_of.items() if n), key=lambda s: (s is None, s or ""))
    over = lcm(*(Fraction(weights[s]).denominator for s in names))
    weight = [int(Fraction(weights[s]) * over) for s in names]
    blocks = [blocks_of[s] for s in names]
    # Where sources end, as blocks by weight; up to ends[j] the ideal mixture stands at base[j] + v * slope[j].
    ended: dict[Fraction, list[int]] = {}
    for n, w in zip(blocks, weight):
        e = ended.setdefault(Fraction(n, w), [0, 0])
        e[0] += n
        e[1] += w
    ends = sorted(ended)
    base, slope = [0], [sum(weight)]
    for e in ends:
        base.append(base[-1] + ended[e][0])
        slope.append(slope[-1] - ended[e][1])
    tops = [(e.numerator, e.denominator) for e in ends]
    phase = [0] * len(names)
    later = [(0, i, 0) for i in range(len(names))]  # release, source, block
    heapq.heapify(later)
    ready: list = []
    for t in range(sum(blocks)):
        while later and later[0][0] <= t:
            _, i, k = heapq.heappop(later)
            j, w = phase[i], weight[i]
            if tops[j][0] * w < (k + 1) * tops[j][1]:
                j = bisect_right(ends, Fraction(k + 1, w), j)
                j -= ends[j - 1] == Fraction(k + 1, w)
            heapq.heappush(ready, (base[j] - (-(k + 1) * slope[j] // w), i, k))
        due, i, k = heapq.heappop(ready)
        assert due > t
        yield names[i], k, phase[i]
        k += 1
        if k < blocks[i]:
            j, w = phase[i], weight[i]
            if tops[j][0] * w <= k * tops[j][1]:
                j = phase[i] = bisect_right(ends, Fraction(k, w), j)
            heapq.heappush(later, (base[j] + k * slope[j] // w, i, k))


def schedule(blocks_of: dict, weights: dict):
    """(source, block, phase) of each slot in turn, every source within a block of its exact share.

    ``phase`` is the number of times at which sources had ended in the ideal mixture when it
    began the block. Sources of weight zero come after all others, mixed evenly.
    """
    if any(weights[s] < 0 for s in blocks_of):
        raise ValueError("a weight is negative")
    last = -1
    for part in ({s: n for s, n in blocks_of.items() if weights[s]}, {s: n for s, n in blocks_of.items() if not weights[s]}):
        first = last + 1
        for source, block, phase in _exact(part, {s: weights[s] or 1 for s in part}):
            last = max(last, first + phase)
            yield source, block, first + phase


def _exact_slots(spark, blocks_of: dict, weights: dict) -> DataFrame:
    """(psource, pblock, phase, slot) of every block, written by one task as it merges."""

    def run(batches):
        if not sum(b.num_rows for b in batches):
            return
        held: tuple[list, list, list] = ([], [], [])
        at = 0

        def batch():
            slots = pa.array(np.arange(at, at + len(held[0])), pa.int64())
            cols = [pa.array(held[0], pa.string()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.int32()), slots]
            return pa.RecordBatch.from_arrays(cols, names=["psource", "pblock", "phase", "slot"])

        for row in schedule(blocks_of, weights):
            for column, x in zip(held, row):
                column.append(x)
            if len(held[0]) == SLOTS_AT_ONCE:
                yield batch()
                at += SLOTS_AT_ONCE
                held = ([], [], [])
        if held[0]:
            yield batch()

    told = spark.range(0, 1, 1, 1).mapInArrow(run, "psource string, pblock long, phase int, slot long")
    return materialize(told, "mix-slots")


def mix_sources(
    df: DataFrame,
    weights: dict | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = BLOCK_ROWS,
    chunks: int = CHUNKS,
) -> DataFrame:
    """(doc_id, source, block, phase, slot, position) of every row.

    ``slot`` is the block's place in the schedule and ``position`` the row's place in the
    mixture: slot * block_rows plus the place within the block. Sorting by ``position`` gives
    the mixture. ``weights`` are relative and taken exactly; a source without one, and every
    source where it is None, gets the square root of its row count (the usual tempering). Any
    number of sources is possible.

    Defined results: a null source is a source of its own; null ids are mixed like others;
    repeated rows each get a place; an empty table gives no rows; no row is dropped or
    repeated; other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    order = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")]
    return _mixed(materialize(rows, "mix-rows"), order, F.xxhash64("doc_id", F.lit(11)), weights, block_rows, chunks).select(
        "doc_id", "source", "block", "phase", "slot", "position"
    )


def _mixed(rows: DataFrame, order: list, salt, weights: dict | None, block_rows: int, chunks: int) -> DataFrame:
    """``rows``, a table with a column source, with block, phase, slot and position."""
    n_of = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    given = weights or {}
    full = {s: given.get(s, root_weight(n)) for s, n in n_of.items()}
    blocks_of = {s: -(-n // block_rows) for s, n in n_of.items()}
    ranked = gapless_rank(rows, F.col("source"), order, salt, chunks, "nth")
    ranked = ranked.withColumn("block", F.floor(F.col("nth") / block_rows).cast("long"))
    told = _exact_slots(rows.sparkSession, blocks_of, full)
    # A block has at most ``block_rows`` rows, so no key of this join is large.
    placed = ranked.join(told, F.col("source").eqNullSafe(F.col("psource")) & (F.col("block") == F.col("pblock")))
    return placed.withColumn("position", F.col("slot") * block_rows + F.col("nth") % block_rows)


def in_mixture_order(
    df: DataFrame,
    weights: dict | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_rows: int = BLOCK_ROWS,
    chunks: int = CHUNKS,
) -> DataFrame:
    """The rows of ``df``, same columns, in the order of the mixture: partitions are ranges of ``position``.

    Positions are found on narrow rows, told apart by id, source and a digest of the text; whole
    rows move once to meet theirs (where copies of one row are many, the adaptive planner splits
    their partition) and once into their order.

    Defined results: null sources, ids and texts are values like others; rows that agree in id,
    source and text keep together at the first of their places; an empty table gives an empty
    one; other columns, of whatever name, are passed on.
    """
    spent: list[str] = []
    part = lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("-"))
    words = [F.col(id_col).cast("string"), F.col(source_col).cast("string"), F.md5(F.encode(F.col(text_col).cast("string"), "UTF-8"))]
    key = F.unhex(F.md5(F.encode(F.concat_ws("\n", *map(part, words)), "UTF-8")))
    rows = materialize(df.select(key.alias("key"), F.col(source_col).cast("string").alias("source")), "mix-rows", spent=spent)
    placed = _mixed(rows, [F.col("key")], F.xxhash64("key"), weights, block_rows, chunks)
    k, position = fresh(df, "__key", "__position")
    first = placed.groupBy(F.col("key").alias(k)).agg(F.min("position").alias(position))
    joined = materialize(df.join(first, key == F.col(k)).drop(k), "mix-joined", "zstd")
    clear(df.sparkSession, spent)
    return joined.repartitionByRange(position).sortWithinPartitions(position).drop(position)
