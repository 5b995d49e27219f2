"""A corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veldt.llm import common, decontam, line_dedup, packing, quality, simhash

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontam.stage),
    ("best_fit_packing", packing.stage),
]

#: The packing is a search; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over the documents of sf_dir. What lies between goes to the shared folder, and is removed once the next stage has been written."""
    at = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{at}/{k}-{name}"
        with common.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if last:
            common.remove(spark, last)
        last = out
    return docs
