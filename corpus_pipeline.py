"""A training-data pipeline over documents: quality, near-duplicates, secrets, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import bpe, mixing, quality, secrets, simhash
from sheaf.session import discard, written

#: Compression models, similarity groups and posteriors aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their BPE ids and the text decoded from them: doc_id, text, lang, source, n_chars, n_tokens, ids, decoded.

    A row for each row, repeated ones and those with a null id too. A null or empty text has no ids and decodes to the empty text. Texts of any length are
    encoded whole; ties don't arise; other columns of docs aren't read; an empty table stays empty.
    """
    # Executors have more workers here than cores, as stages before run two in a task: none keeps an automaton between its tasks.
    return bpe.encode_decode(docs, bpe.default_vocabulary(), cache_pieces=100_000, kept=False).select("doc_id", "text", "lang", "source", "n_chars", "bpe.n_tokens", "bpe.ids", "bpe.decoded")


STAGES = [
    ("quality", quality.keep_good),
    ("simhash", simhash.keep_first),
    ("secrets", secrets.mask),
    ("mixing", mixing.mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over all documents: each reads what the one before has written, whose table is deleted once the next is written.

    What becomes of nulls, empty and long texts, ties and repeated rows is as each stage says: texts below the quality threshold go, of near-duplicates (null and empty
    texts are some) one row stays, secrets are masked where they stand, rows are repeated or left out by their rates, and the rest is encoded. Columns of documents beyond
    the five known ones pass through all stages but the last. Empty tables give no rows.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
