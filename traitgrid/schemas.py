"""Schemas, the trait list and the rating scale.

The trait list and the 1..5 scale are parameters everywhere; the values
below are only defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values (must equal the instrument's conventions for identical results):
# the five domains in key-column order, and the one-letter facet codes that
# the inventory text uses for them.
TRAITS = ["Extraversion", "Agreeableness", "Conscientiousness", "Neuroticism", "Openness"]
TRAIT_CODES = {"E": "Extraversion", "A": "Agreeableness", "C": "Conscientiousness",
               "N": "Neuroticism", "O": "Openness"}

# The three domains the persona grid and the dose-response report use.
GRID_TRAITS = ["Agreeableness", "Openness", "Conscientiousness"]


@dataclass(frozen=True)
class RatingScale:
    """Closed integer rating range; a reply is valid iff its text is one of
    ``str(lo) .. str(hi)``. Reverse keying maps x to ``lo + hi - x``."""

    lo: int = 1
    hi: int = 5

    @property
    def allowed(self) -> list[str]:
        return [str(v) for v in range(self.lo, self.hi + 1)]

    @property
    def mirror(self) -> int:
        return self.lo + self.hi


DEFAULT_SCALE = RatingScale()

# Long (canonical) scoring key: one row per (item, trait) with a non-zero weight.
KEY_LONG = T.StructType([
    T.StructField("item_id", T.LongType(), False),
    T.StructField("question", T.StringType(), True),
    T.StructField("trait", T.StringType(), False),
    T.StructField("weight", T.DoubleType(), True),
])

PERSONAS = T.StructType([
    T.StructField("domain", T.StringType(), False),
    T.StructField("qualifier_type", T.StringType(), True),
    T.StructField("qualifier", T.StringType(), True),
    T.StructField("value", T.IntegerType(), False),
    T.StructField("description", T.StringType(), True),
])

# Response fact: one row per resolved reply of a run.
RESPONSES = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("trait", T.StringType(), True),
    T.StructField("value", T.IntegerType(), True),
    T.StructField("repetition", T.IntegerType(), True),
    T.StructField("item_id", T.LongType(), False),
    T.StructField("response_text", T.StringType(), True),
    T.StructField("rating_text", T.StringType(), True),
    T.StructField("elapsed_s", T.DoubleType(), True),
])

# Attempt log: one row per call to the model (failed calls have ok = false).
ATTEMPTS = T.StructType([
    T.StructField("item_id", T.LongType(), False),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("call_id", T.LongType(), True),
    T.StructField("ok", T.BooleanType(), True),
    T.StructField("response_text", T.StringType(), True),
    T.StructField("elapsed_s", T.DoubleType(), True),
])
