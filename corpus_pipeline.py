"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Every stage takes and returns documents (``doc_id, text, lang, source, n_chars``),
except the last, which returns the packed pieces. Stages are written as Parquet
and reread in between, so a lost executor never reaches back past one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traitgrid.llm.common import stored, table
from traitgrid.llm.stages import COLUMNS, mixing_stage, near_dedup_of_all_stage, near_dedup_stage, packing_stage, quality_stage, substring_stage

__all__ = ["STAGES", "ORACLE_SQL", "run", "near_dedup_stage"]

STAGES = [("quality rules", quality_stage), ("simhash near-dedup", near_dedup_of_all_stage), ("substring dedup", substring_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

#: Fingerprints, raked sampling and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
