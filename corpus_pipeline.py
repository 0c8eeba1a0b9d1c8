"""From the documents table to packed training sequences.

Every stage takes (spark, docs, sf_dir), reads all that its predecessor kept, and returns the columns of
documents; the last returns pieces of sequences. ``run`` writes each stage as Parquet to the shared folder and
reads it again as the next one's input.
"""

from pyspark.sql import DataFrame, SparkSession

from sectionweave.llm import dedup_index, packing, rules, secrets, simhash
from sectionweave.llm.tables import stored, table
from sectionweave.session import attach


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger rejects go; null and empty texts have too few words and go. An empty table stays empty."""
    return rules.filter_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest, then the one with the smallest doc_id, null ids last; null counts as empty."""
    attach(spark)
    return dedup_index.drop_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links stays: the one with the smallest doc_id, null ids last.

    Shingles of three words and at most three differing bits, as in the query of this operator; null and empty
    texts are one component.
    """
    attach(spark)
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, encoded ones too, are replaced in the texts; all documents stay, null texts as they are."""
    attach(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null text is one piece of the end id."""
    attach(spark)
    return packing.piece_digests(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("simhash_near_dedup", simhash_near_dedup),
          ("secret_scan", secret_scan), ("packing", pack)]
#: SQL cannot express fingerprints, decoding and tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
