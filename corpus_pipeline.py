"""A corpus from documents: quality rules, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's documents. All but the last keep the columns of documents; n_chars follows the text. Every stage gives an
empty result for an empty table, treats texts of any length whole and lets extra columns pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.llm.common import cut, table
from fernglass.llm.jaccard import one_of_each
from fernglass.llm.packing import pack_documents
from fernglass.llm.quality import quality_rules
from fernglass.llm.secret_scan import scan_secrets

#: SQL cannot express tokenizing, the forest and the packing search; tests compare run() with a brute-force version.
ORACLE_SQL = None


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return docs.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others the failing lines go.

    A null text counts as empty and is rejected; null ids and sources do not matter; repeated rows have one fate."""
    return _with_text(quality_rules(docs).where("kept"), docs.columns, "clean_text")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the one with the smallest id, rows without an id last.

    Rows that share an id but not their text are documents of their own; ties go to the smaller text, and of rows that
    repeat both id and text one stays. Null and empty texts have no near copies."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays.

    A null text stays null (and n_chars with it), a null source counts as an empty path; repeated rows are scanned each."""
    return _with_text(scan_secrets(docs), docs.columns, "redacted")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' token pieces in sequences.

    A null text is packed as an empty one (its end id), a null id stays null; repeated rows are packed each, and rows of
    equal id may take each other's places."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("near_copies", near_copies), ("secret_scan", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows are those of the last one (see `packing`)."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
