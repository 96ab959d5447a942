"""The training-data pipeline: five stages, each written as Parquet and read again by whoever runs it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import table, written
from loomgraph.llm.packing import packing_stage
from loomgraph.llm.pii import pii_stage
from loomgraph.llm.quality import quality_stage
from loomgraph.llm.simhash import simhash_stage
from loomgraph.llm.suffixes import suffix_stage

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_array_dedup", suffix_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither learned rules, fingerprints nor BPE: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder for the next.

    Null, empty and very long texts, null or repeated ids and columns of any name are taken as each stage says; an empty
    table of documents gives no pieces.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
