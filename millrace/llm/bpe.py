"""BPE encoding and decoding of whole texts (forced-boundary splitting)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _bpe
from millrace.llm._common import in_slices


def bpe_round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, decodes the ids again, keeps both.

    ``tokenizer`` is the path of a tokenizers file whose vocabulary marks word ends and which
    names no decoder; every executor must see it there. A file with other settings is an error. Returns (doc_id, ids binary of
    little-endian uint32, decoded string). One map-only pass: no shuffle, so no key can be hot,
    and a lost executor costs its own tasks.

    Defined results: null or empty text gives no ids and an empty decoded text; a null id
    stays null; repeated rows each give a row; an empty table gives none; other columns, of
    whatever name, are not read.
    """

    def run(batches):
        coder = _bpe.encoder(tokenizer)
        for batch in in_slices(batches, 1024):
            ids = coder.encode_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids binary, decoded string")


def bpe_digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`bpe_round_trip` returns, as counts and digests: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    The digests are taken where the ids are made, so that neither ids nor texts travel back.
    Same defined results.
    """

    def run(batches):
        coder = _bpe.encoder(tokenizer)
        for batch in in_slices(batches, 1024):
            n, a, b = [], [], []
            for ids in coder.encode_all(batch.column(1).to_pylist()):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(coder.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
