"""A corpus pipeline: toxicity, near duplicates, personal data, mixing, tokens.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All stages but
the last return the columns of ``documents``.

* toxicity drops the documents predicted toxic; learns from ``labels`` as op8 does.
* near_duplicates keeps one document of each component of 5-word shingle sets linked at a
  Jaccard similarity of 0.8.
* personal_data masks personal data in the texts.
* mixing puts the rows in the order of the mixture; file after file is the mixture.
* tokens encodes what is left and decodes it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, jaccard_join, mixing, pii, toxicity
from millrace.llm._common import bound_batches, clear, materialize, read_table
from millrace.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows predicted toxic, by a model of the ``labels`` that aren't held out.

    Null, empty and wordless texts stay; null ids and repeated rows are judged by their texts;
    without labels, or without rows, nothing is dropped. Other columns are passed on.
    """
    labels = read_table(spark, sf_dir, "labels")
    return toxicity.keep_clean(docs, toxicity.fit_toxicity(docs, labels, ~toxicity.held_out(F.col("doc_id"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five words a shingle, a similarity of 0.8 or more.

    Rows with null ids, and null, empty and blank texts, all stay; an id that repeats with other
    texts stands for several documents; of a row that repeats one stays; an empty table stays
    empty. Other columns are passed on.
    """
    bound_batches(spark)
    return jaccard_join.keep_one_of_each(docs, width=5, num=80, den=100)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with personal data masked in the texts, and their lengths in ``n_chars`` along with them.

    Every row stays, null and empty texts as they are; an empty table stays empty. Other
    columns are passed on.
    """
    bound_batches(spark)
    return pii.mask_pii(docs, pii.fit_tagger(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` in the order of the mixture of their sources, the null source included.

    Every row stays; rows that agree in id, source and text keep together; an empty table
    stays empty. Other columns are passed on.
    """
    bound_batches(spark)
    return mixing.in_mixture_order(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, encoded and decoded again: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Null and empty texts have no tokens; null ids stay null; repeated rows each give a row; an
    empty table gives none.
    """
    bound_batches(spark)
    return bpe.bpe_digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix),
    ("tokens", tokenize),
]

#: The classifier and the tagger are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows of ``documents``. The table between two stages is deleted once the next one is written."""
    docs, spent = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        past, spent = spent, []
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", "zstd", spent)
        clear(spark, past)
    return STAGES[-1][1](spark, docs, sf_dir)
