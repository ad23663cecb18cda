"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded to a multiple of 64, become an 8-bit greyscale PNG image 64
pixels wide: lossless, and the same bytes for the same text. Images stand in tar shards in the
shared folder, named by digest, each digest once; rows carry digest, shard, offset and length.

Which digests repeat is found first, from digests alone. A payload that stands once is stored
by the task that reads it; of one that repeats, each task passes on a single copy and the one
that stays is stored after a shuffle. So payloads that don't repeat aren't shuffled, and a group
of copies of any size costs one image.

Metadata columns come from range reads of the image headers alone, payloads from range reads
of the members.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import clear, lookup, materialize, shared_path

UNIT = 64
#: A task begins a new shard beyond this size; level of the images' zlib stream.
SHARD_BYTES, LEVEL = 64 << 20, 6
#: Bytes of a shard that are read together.
READ_BYTES = 1 << 20
#: Bytes of an image up to the end of its IHDR chunk.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
BANDS = 16
#: Up to so many repeated digests are broadcast to part the rows; more go by a shuffled join.
BROADCAST_DIGESTS = 500_000


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length of a text, and its bytes with zeros up to a positive multiple of 64."""
    data = (text or "").encode("utf-8")
    return len(data), data + b"\0" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), dtype=np.uint8)  # each line begins with its filter, 0: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _png_chunk(b"IHDR", head) + _png_chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _png_chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bits per sample) from the first HEADER_BYTES bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    if colour:
        raise ValueError("not greyscale")
    return width, height, depth


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, stream = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            stream.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(stream)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean brightness of BANDS equal bands of the image, two hex digits each: a small perceptual signature."""
    x = np.frombuffer(payload, dtype=np.uint8)
    cuts = np.linspace(0, len(x), BANDS + 1).astype(np.int64)[:-1]
    sizes = np.diff(np.concatenate((cuts, [len(x)])))
    return bytes((np.add.reduceat(x.astype(np.int64), cuts) // sizes).astype(np.uint8).tolist()).hex()


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Shard:
    """One tar file that a task writes; members are named by digest."""

    def __init__(self, base: str):
        self.uri = f"{base}/{uuid.uuid4().hex}.tar"
        store, path = _store(self.uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.size, self.members = store.open_output_stream(path), 0, {}

    def put(self, digest: str, payload: bytes) -> tuple[str, int, int]:
        if digest not in self.members:
            image = to_png(payload)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + image + b"\0" * (-len(image) % 512))
            self.members[digest] = (self.uri, self.size + len(head), len(image))
            self.size += len(head) + len(image) + -len(image) % 512
        return self.members[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def media_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, digest, text) of every row: the digest is that of the padded payload."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = F.octet_length("text").cast("long")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    size = F.greatest(F.lit(UNIT), F.ceil(n / UNIT) * UNIT).cast("int")
    payload = F.rpad(F.encode("text", "UTF-8"), size, F.lit(b"\0"))
    return rows.select("doc_id", n.alias("n_bytes"), F.sha2(payload, 256).alias("digest"), "text")


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_bytes, digest) of every row, and (digest, shard, offset, length) of every payload; the images are in the shards.

    Shard names are unique to an attempt, so a task that runs again writes other files and
    its rows point to those.

    Defined results: null and empty texts are a payload of 64 zero bytes; a null id stays
    null; repeated rows each give a row, and one payload; an empty table writes no shard and
    gives no rows; other columns are not read. Memory follows the longest text.
    """
    spark, spent = df.sparkSession, []
    base = shared_path(spark, "media")
    rows = media_rows(df, id_col, text_col)

    def run(batches):
        shard = None
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part, out = batch.slice(i, 512), []
                    for digest, text in zip(*(c.to_pylist() for c in part.columns)):
                        if shard is None or shard.size > SHARD_BYTES:
                            if shard is not None:
                                shard.close()
                            shard = _Shard(base)
                        out.append((digest, *shard.put(digest, padded(text)[1])))
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["digest", "shard", "offset", "length"]
                    )
        finally:
            if shard is not None:
                shard.close()

    told = materialize(rows.drop("text"), "media-rows", "zstd")
    again = told.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.unhex("digest").alias("rdigest"))
    again = materialize(again, "media-repeated", spent=spent)
    again = F.broadcast(again) if again.count() <= BROADCAST_DIGESTS else again
    same = F.unhex("digest") == F.col("rdigest")
    single = rows.join(again, same, "left_anti").select("digest", "text")
    several = rows.join(again, same, "left_semi").select("digest", "text").dropDuplicates(["digest"])
    where = single.unionByName(several).mapInArrow(run, "digest string, shard string, offset long, length long")
    where = materialize(where, "media-addresses", "zstd")
    clear(spark, spent)
    return told, where


def _over_shards(where: DataFrame, made, schema: str) -> DataFrame:
    """``where`` with the columns of ``made(file, offset, length)`` behind its own, over members in the order in which they stand in their shards.

    What is known of a member travels with its address, so reads that follow one another need no joins.
    """

    def run(batches):
        uri, file = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = []
                part = batch.slice(i, 512)
                for shard, offset, length in zip(*(part.column(c).to_pylist() for c in ("shard", "offset", "length"))):
                    if shard != uri:
                        if file is not None:
                            file.close()
                        store, path = _store(shard)
                        uri, file = shard, store.open_input_file(path)
                    rows.append(made(file, offset, length))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c) for c in zip(*rows))], names=names)
        if file is not None:
            file.close()

    names = where.columns + [c.split()[0] for c in schema.split(", ")]
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in where.schema)
    spread = where.repartition("shard", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("shard", "offset")
    return spread.mapInArrow(run, f"{kept}, {schema}")


def media_metadata(where: DataFrame) -> DataFrame:
    """``where`` with (width, height, bits), by reading the header of each image alone."""

    def made(file, offset, length):
        return png_header(file.read_at(HEADER_BYTES, offset))

    return _over_shards(where, made, "width long, height long, bits long")


def media_contents(where: DataFrame) -> DataFrame:
    """``where`` with what the stored bytes of each image hold, read back.

    (payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)
    """

    def made(file, offset, length):
        image = file.read_at(length, offset)
        payload = from_png(image)
        return (
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-UNIT:]),
            len(image),
            hashlib.sha256(image).hexdigest(),
            feature_of(payload),
        )

    return _over_shards(
        where,
        made,
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def media_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as media and returns its row with its address and what is read back from the shards.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, digest, shard, offset, length, width, height, bits); the last three come from
    range reads of the headers alone.

    Defined results: as of :func:`store_media`; an empty text is a 64 x 1 image; equal texts
    have equal values, addresses included.
    """
    spent: list[str] = []
    rows, where = store_media(df, id_col, text_col)
    heads = materialize(media_metadata(where), "media-heads", "zstd", spent)
    each = materialize(media_contents(heads).withColumnRenamed("digest", "adigest"), "media-table", "zstd")
    clear(df.sparkSession, spent)
    return lookup(rows, "digest", each, "adigest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "digest", "shard", "offset", "length", "width", "height", "bits",
    )


def read_member(uri: str, name: str) -> bytes:
    """A member of a shard by name, through the tar index, as any tar reader sees it."""
    store, path = _store(uri)
    with store.open_input_file(path) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
        return tar.extractfile(name).read()
