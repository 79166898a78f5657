"""Corpus cleaning: toxicity, line dedup, SimHash near-dedup, secret scans, packing.

Each stage gets all that the one before kept, by a table in the shared folder; all but the last return the
columns of documents, in their order, whatever further columns there are.

Rows with null or repeated ids are rows like any other. A null text is clean, has no lines and no secrets, stays
null up to packing, and is packed as the empty text; of all null and empty texts near dedup keeps one, as of any
equal texts. Very long texts go whole through every stage. Wholly alike rows are copies: one stays. A null source
is packed as the source named by the empty string. Without documents there is no piece; without labels the
toxicity grammar scores by its plain words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillwork.llm import packing, secrets, simhash, template_lines, toxicity
from quillwork.llm.common import discard, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; n_chars follows the text."""
    return template_lines.dedup_lines(docs, length_col="n_chars")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences by source mixture, ids included."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_stage), ("near dedup", near_stage), ("secret scans", secret_stage), ("packing", packing_stage)]

#: The stages run finite-state grammars, fingerprints and tokenizers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents. A stage's table goes when the next one's is there."""
    docs, tables = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
            discard(*tables)
            tables = [docs]
    return docs
