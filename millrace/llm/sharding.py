"""Sharding by longest-processing-time scheduling.

Rows with equal texts stay together. Groups go, largest first, to the shard with the least
bytes so far, through a heap. Groups of one size are alike to that rule, so the schedule needs
only how many groups there are of each size: one task reads a row per distinct size, largest
first, as a stream, holds one load per shard and writes how many groups of that size go to
which shard; every group then finds its shard by its rank within its size. The loads equal
those of the heap run over all groups one by one. n distinct sizes need n^2/2 bytes of input at
least, which bounds that stream by the root of the input; the driver sees none of it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import clear, gapless_rank, lookup, materialize

#: Cells that a key is dealt into for ranks; a cell is one task's work at most.
CHUNKS = 512


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """For each (size, count), which come with the largest size first: (size, shards, how many of these each of them gets).

    As a heap that takes the groups one by one does it, ties to the smaller shard number.
    While some shards lag, groups of one size go one by one through the heap; once all loads
    are within one size of each other the heap would go round all shards in a fixed order,
    so whole rounds are dealt at once.
    """
    heap = [(0, s) for s in range(shards)]
    for size, count in sizes:
        got = np.zeros(shards, dtype=np.int64)
        while count:
            low, high = heap[0][0], max(load for load, _ in heap)
            if high - low <= size and count >= shards:
                rounds = count // shards
                got += rounds
                heap = [(load + rounds * size, s) for load, s in heap]
                heapq.heapify(heap)
                count -= rounds * shards
                continue
            # Shards that lag by more than one size catch up in bulk, short of the last step.
            load, s = heap[0]
            second = heap[1][0] if shards == 2 else min(h[0] for h in heap[1:]) if shards > 1 else load + size * count
            n = min(count, max(1, (second - load) // size)) if shards > 1 else count
            heapq.heapreplace(heap, (load + n * size, s))
            got[s] += n
            count -= n
        used = np.flatnonzero(got)
        yield size, used.tolist(), got[used].tolist()


def _plan(sizes: DataFrame, shards: int) -> DataFrame:
    """(pbytes, used, upto) of the sizes (bytes, n): shards in order, and up to which rank each takes groups of that size."""

    def run(batches):
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        held = []
        for size, used, n in schedule(rows, shards):
            held.append((size, used, np.cumsum(n).tolist()))
            if len(held) == 4096:
                yield table(held)
                held = []
        if held:
            yield table(held)

    def table(rows):
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["pbytes", "used", "upto"])

    in_turn = sizes.select("bytes", "n").repartition(1).sortWithinPartitions(F.desc("bytes"))
    return in_turn.mapInArrow(run, "pbytes long, used array<int>, upto array<long>")


def shard_documents(
    df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", chunks: int = CHUNKS
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, under the law ``bytes``.

    ``size`` is the text's UTF-8 length plus 1; ``slot`` is gapless from 0 in each shard;
    ``grown_shard`` is null, as this law deals everything anew for another number of shards.

    Defined results: null texts form one group and count 0 bytes plus 1, empty texts another;
    a null id is placed like any other; repeated rows stay together; a group larger than
    an even share makes its shard the largest; an empty table gives no rows; other columns
    are not read.
    """
    spark, spent = df.sparkSession, []
    text = F.col(text_col).cast("string")
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(F.encode(text, "UTF-8"))), F.lit(b"")).alias("grp"),
    )
    docs = materialize(docs, "shard-docs", spent=spent)
    groups = docs.groupBy("grp").agg(F.sum("size").alias("bytes"))
    ranked = gapless_rank(groups, F.col("bytes"), [F.col("grp")], F.xxhash64("grp"), chunks, "nth")
    ranked = materialize(ranked, "shard-groups", spent=spent)
    told = materialize(_plan(ranked.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")), shards), "shard-plan", spent=spent)
    # The first shard whose share of this size reaches beyond the group's rank.
    slot_of = F.expr("element_at(used, cast(size(filter(upto, u -> u <= nth)) + 1 as int))")
    placed = lookup(ranked, "bytes", told, "pbytes").select(F.col("grp").alias("pgrp"), slot_of.alias("shard"))
    placed = materialize(placed, "shard-placed", spent=spent)
    rows = lookup(docs, "grp", placed, "pgrp").select("doc_id", "size", "text_crc32", "grp", "shard")
    rows = materialize(rows, "shard-rows")
    clear(spark, spent)
    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("grp")]
    slots = gapless_rank(rows, F.col("shard"), order, F.xxhash64("doc_id"), chunks, "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_loads(placed: DataFrame) -> DataFrame:
    """(shard, rows, bytes) of what :func:`shard_documents` returns."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


