"""Token files: canonical length-limited Huffman coding of ids from global counts.

A token file set is a folder with three tables. ``blocks``: independent blocks in ascending
id order, file after file. A block holds whole documents: their ids, token counts, the Huffman
bits of each document from a byte border on, and checkpoints, the bit offset of every
CHECKPOINT-th token. ``code``: the code length of each id in use. Lengths come from counts over
all documents by package-merge, and codes are canonical, so the lengths alone rebuild them.
``segments``: where each range of ids begins in the stream of all tokens. The folder is all that a
reader needs.

Decoding looks up the next ``bits`` bits in one table per step, for all checkpoints of a
block at once. Blocks are rows that Spark's own writers commit, so a lost executor costs the
tasks it ran, and any store that Spark writes to will do.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _bpe
from millrace.llm._common import clear, in_slices, materialize, shared_path

#: Longest code (longer where so many ids are in use that they need it), tokens of a block, tokens between checkpoints.
MAX_BITS, BLOCK_TOKENS, CHECKPOINT = 16, 1 << 18, 128
#: Bits of the longest code that a step of the decoder can look up.
MOST_BITS = 25
#: Segments (ranges of ids) for each shuffle partition.
SEGMENTS_EACH = 4
_CHUNK = 1 << 20

_BLOCKS = (
    "segment int, block int, before long, doc_ids array<long>, n_tokens array<long>, n_bytes array<long>, "
    "checkpoints binary, payload binary"
)


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Code length of each symbol, 0 where its count is 0: optimal under the limit, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need codes of more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(max_bits):
        both = np.concatenate((leaves, packages))
        at = np.argsort(both, kind="stable")
        levels.append(at < n)  # which items of this level, by weight, are leaves
        both = both[at]
        packages = both[0 : len(both) - 1 : 2] + both[1::2]
    lengths, take = np.zeros(n, dtype=np.uint8), 2 * n - 2
    for is_leaf in reversed(levels):
        leaf = int(is_leaf[:take].sum())
        lengths[:leaf] += 1
        take = 2 * (take - leaf)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol; each is the one before plus one, shifted to its length."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        top = int(lengths.max())
        steps = np.uint64(1) << (np.uint64(top) - lengths[order].astype(np.uint64))
        left = np.concatenate((np.zeros(1, np.uint64), np.cumsum(steps)[:-1].astype(np.uint64)))
        codes[order] = left >> (np.uint64(top) - lengths[order].astype(np.uint64))
    return codes


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.bits = max(1, int(lengths.max(initial=0)))
        self.codes = canonical_codes(lengths)
        self._tables = None

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, length) for each value of the next ``bits`` bits."""
        if self._tables is None:
            used = np.flatnonzero(self.lengths)
            order = used[np.lexsort((used, self.lengths[used]))]
            reach = 1 << (self.bits - self.lengths[order].astype(np.int64))
            symbol = np.zeros(1 << self.bits, dtype=np.uint32)
            length = np.ones(1 << self.bits, dtype=np.int64)
            total = int(reach.sum())
            symbol[:total] = np.repeat(order, reach)
            length[:total] = np.repeat(self.lengths[order], reach)
            self._tables = (symbol, length)
        return self._tables

    def pack(self, docs: list[np.ndarray]) -> tuple[list[bytes], list[np.ndarray]]:
        """The bits of each document, padded to whole bytes, and its checkpoints in bits."""
        payloads: list[bytes] = []
        checks: list[np.ndarray] = []
        i = 0
        while i < len(docs):
            j, n = i, 0
            while j < len(docs) and (j == i or n + len(docs[j]) <= _CHUNK):
                n += len(docs[j])
                j += 1
            self._pack(docs[i:j], payloads, checks)
            i = j
        return payloads, checks

    def _pack(self, docs, payloads, checks) -> None:
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        ids = np.concatenate(docs)
        if not len(ids):
            payloads += [b""] * len(docs)
            checks += [np.empty(0, np.int64)] * len(docs)
            return
        lens = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(lens)
        last = np.cumsum(sizes)
        upto = np.concatenate(([0], ends))[np.concatenate(([0], last))]
        n_bytes = (np.diff(upto) + 7) // 8
        base = np.concatenate(([0], np.cumsum(n_bytes)))
        pos = ends - lens + np.repeat(base[:-1] * 8 - upto[:-1], sizes)
        word, room = pos >> 5, (64 - (pos & 31) - lens).astype(np.uint64)
        value = self.codes[ids] << room
        runs = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        at = word[runs]
        out = np.zeros(int(base[-1] // 4) + 3, dtype=np.uint64)
        out[at] += np.add.reduceat(value >> np.uint64(32), runs)
        out[at + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), runs)
        data = out.astype(">u4").tobytes()
        first = last - sizes
        for k in range(len(docs)):
            payloads.append(data[base[k] : base[k + 1]])
            checks.append(pos[first[k] : last[k] : CHECKPOINT] - base[k] * 8)

    def unpack(self, payload: bytes, sizes: np.ndarray, n_bytes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The ids of all documents of a block, one after the other."""
        symbol, length = self.tables()
        total = int(sizes.sum())
        out = np.zeros(total, dtype=np.uint32)
        if not total:
            return out
        raw = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        lanes = -(-sizes // CHECKPOINT)
        base = np.repeat(np.concatenate(([0], np.cumsum(n_bytes)[:-1])) * 8, lanes)
        pos = base + checks
        doc_first = np.repeat(np.cumsum(sizes) - sizes, lanes)
        lane_no = np.arange(len(checks)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first = doc_first + lane_no * CHECKPOINT
        count = np.minimum(CHECKPOINT, np.repeat(sizes, lanes) - lane_no * CHECKPOINT)
        order = np.argsort(-count, kind="stable")
        pos, first, count = pos[order], first[order], count[order]
        live = np.searchsorted(-count, -np.arange(1, CHECKPOINT + 1), side="right")
        mask, spare = np.uint32((1 << self.bits) - 1), 32 - self.bits
        for t in range(CHECKPOINT):
            n = live[t]
            if not n:
                break
            p = pos[:n]
            peek = (window[p >> 3] >> (spare - (p & 7)).astype(np.uint32)) & mask
            out[first[:n] + t] = symbol[peek]
            pos[:n] += length[peek]
        return out


def longest_code(used: int, max_bits: int = MAX_BITS) -> int:
    """The limit on code lengths for so many ids in use: ``max_bits``, or two bits more than they need at least."""
    bits = max_bits if used <= 1 << max_bits else (used - 1).bit_length() + 2
    if bits > MOST_BITS:
        raise ValueError(f"{used} ids need codes of more than {MOST_BITS} bits")
    return bits


class Segments:
    """Ranges of rows in the order of (id, text hash): between approximate quantiles of the ids, nulls first.

    An id that holds several quantiles has as many segments, by ranges of the text hash; so a
    third of all rows under one id, or under none, still spreads over a third of the segments.
    """

    def __init__(self, ids: DataFrame, segments: int):
        shares = [i / segments for i in range(1, segments)]
        found = ids.agg(
            F.percentile_approx("doc_id", shares, 20 * segments).alias("b") if shares else F.lit(None).alias("b"),
            F.count_if(F.col("doc_id").isNull()).alias("nulls"),
            F.count(F.lit(1)).alias("rows"),
        ).first()
        told = found["b"] or []
        self.cuts = np.array(sorted(set(told)), dtype=np.int64)
        times = [1 + int(found["nulls"] * segments // max(found["rows"], 1))]
        for i, cut in enumerate(self.cuts.tolist()):
            # Ids below the cut, then the cut itself.
            times += [1, max(1, told.count(cut) - 1)]
        times.append(1)
        self.times = np.array(times, dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.times)))
        self.number = int(self.first[-1])

    def of(self, ids: np.ndarray, null: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The segment of each row; ascending in (id, hash)."""
        at = 1 + 2 * np.searchsorted(self.cuts, ids, side="left")
        if len(self.cuts):
            at += self.cuts[np.minimum((at - 1) // 2, len(self.cuts) - 1)] == ids
        at[null] = 0
        part = ((hashes >> 32) + (1 << 31)) * self.times[at] >> 32
        return self.first[at] + part


def write_token_files(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = MAX_BITS,
    path: str | None = None,
) -> str:
    """Encodes every text, appends ``end_id``, writes a token file set; returns its folder, a new shared one unless ``path`` names it.

    Texts are encoded once. The ids wait in a compressed table while they are counted;
    only the Huffman bits are shuffled, into ranges of ids, and sorted there.
    """
    spark, spent = df.sparkSession, []
    path = path or shared_path(spark, "token-files")
    text = F.col(text_col).cast("string")
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = Segments(narrow.select("doc_id"), SEGMENTS_EACH * partitions)
    wide = max(_bpe.ForcedCuts(tokenizer).library.get_vocab_size(), end_id + 1)
    kind = "<u2" if wide <= 1 << 16 else "<u4"

    def encode(batches):
        coder = _bpe.encoder(tokenizer, kind)
        end = np.array([end_id], dtype=kind).tobytes()
        for batch in in_slices(batches, 1024):
            ids, hashes = batch.column(0), batch.column(2)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            at = segments.of(ids.fill_null(0).to_numpy(zero_copy_only=False), null, hashes.to_numpy(zero_copy_only=False))
            coded = [x + end for x in coder.encode_all(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), ids, hashes, pa.array(coded, pa.binary())], names=["segment", "doc_id", "h", "ids"]
            )

    encoded = materialize(narrow.mapInArrow(encode, "segment int, doc_id long, h long, ids binary"), "token-ids", "zstd", spent)

    def count(batches):
        total = np.zeros(wide, dtype=np.int64)
        for batch in batches:
            col = batch.column(0)
            ends = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1]
            if len(col) and ends[-1] > ends[0]:
                ids = np.frombuffer(col.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(kind)
                for i in range(0, len(ids), _CHUNK):
                    total += np.bincount(ids[i : i + _CHUNK], minlength=wide)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    # One row per id of the vocabulary: bounded by it.
    told = encoded.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(wide, dtype=np.int64)
    for r in told:
        counts[r["id"]] = r["n"]
    code = Code(code_lengths(counts, longest_code(int((counts > 0).sum()), max_bits)))
    used = np.flatnonzero(code.lengths)
    lengths = spark.createDataFrame(list(zip(used.tolist(), code.lengths[used].tolist())), "id int, bits int")
    lengths.coalesce(1).write.mode("overwrite").parquet(f"{path}/code")

    def pack(batches):
        for batch in in_slices(batches):
            docs = [np.frombuffer(x, dtype=kind) for x in batch.column(3).to_pylist()]
            payloads, checks = code.pack(docs)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.array([len(d) for d in docs], pa.int64()),
                    pa.array([c.astype("<u4").tobytes() for c in checks], pa.binary()),
                    pa.array(payloads, pa.binary()),
                ],
                names=["segment", "doc_id", "h", "n", "checks", "payload"],
            )

    packed = encoded.mapInArrow(pack, "segment int, doc_id long, h long, n long, checks binary, payload binary")
    # Neighbouring segments go to one task, so that file after file the ids ascend.
    files = min(partitions, segments.number)
    file = F.floor(F.col("segment").cast("long") * files / segments.number).cast("int")
    dealt = packed.withColumn("file", file).repartitionById(files, "file").drop("file")
    dealt = dealt.sortWithinPartitions("segment", F.asc_nulls_first("doc_id"), "h", "n", "payload").drop("h")
    dealt.mapInArrow(_blocks, _BLOCKS).write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    # One row per segment, a bounded number.
    tokens = F.col("before") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    at, starts = 0, []
    for r in sorted(spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").groupBy("segment").agg(F.max(tokens).alias("n")).collect()):
        starts.append((r["segment"], at, r["n"]))
        at += r["n"]
    spark.createDataFrame(starts, "segment int, start long, tokens long").coalesce(1).write.mode("overwrite").parquet(f"{path}/segments")
    clear(spark, spent)
    return path


def _blocks(batches):
    """Sorted documents into blocks; a block ends with its segment or at BLOCK_TOKENS."""
    seg, number, before, held, tokens = None, 0, 0, [], 0

    def block():
        ids, n, checks, payload = zip(*held)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([seg], pa.int32()),
                pa.array([number], pa.int32()),
                pa.array([before], pa.int64()),
                pa.array([list(ids)], pa.list_(pa.int64())),
                pa.array([list(n)], pa.list_(pa.int64())),
                pa.array([[len(p) for p in payload]], pa.list_(pa.int64())),
                pa.array([b"".join(checks)], pa.binary()),
                pa.array([b"".join(payload)], pa.binary()),
            ],
            names=["segment", "block", "before", "doc_ids", "n_tokens", "n_bytes", "checkpoints", "payload"],
        )

    for batch in batches:
        for s, i, n, c, p in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if held and (s != seg or tokens + n > BLOCK_TOKENS):
                yield block()
                before, number, held, tokens = before + tokens, number + 1, [], 0
            if s != seg:
                seg, number, before = s, 0, 0
            held.append((i, n, c, p))
            tokens += n
    if held:
        yield block()


def read_code(spark: SparkSession, path: str) -> Code:
    """The code of a token file set, from its lengths."""
    rows = spark.read.schema("id int, bits int").parquet(f"{path}/code").collect()
    lengths = np.zeros(1 + max((r["id"] for r in rows), default=0), dtype=np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return Code(lengths)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of uint32) of every document of the token file set at ``path``, decoded."""
    return _read(spark, path, "ids binary", lambda ids: ids.tobytes(), pa.binary())


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the token file set at ``path``, decoded."""
    return _read(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()), pa.int64())


def _read(spark: SparkSession, path: str, column: str, made, kind) -> DataFrame:
    starts = {r["segment"]: r["start"] for r in spark.read.schema("segment int, start long, tokens long").parquet(f"{path}/segments").collect()}
    lengths = read_code(spark, path).lengths

    def run(batches):
        own = Code(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                seg, _, before, ids, n, size, checks, payload = (batch.column(c)[k].as_py() for c in range(8))
                sizes = np.array(n, dtype=np.int64)
                got = own.unpack(payload, sizes, np.array(size, dtype=np.int64), np.frombuffer(checks, "<u4").astype(np.int64))
                upto = np.concatenate(([0], np.cumsum(sizes)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(upto[:-1] + starts[seg] + before, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([made(got[a:b].astype("<u4")) for a, b in zip(upto[:-1], upto[1:])], kind),
                    ],
                    names=["doc_id", "start", "n_tokens", column.split()[0]],
                )

    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def token_files(df: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from the files of all texts.

    Defined results: a null or empty text has the end id alone; rows with a null id come
    first; rows that repeat an id follow one another by a hash of the text, then length and
    bits; an empty table gives no blocks and no rows; other columns are not read. Memory
    follows the longest text.
    """
    return token_file_digests(df.sparkSession, write_token_files(df, tokenizer, end_id, id_col, text_col))
