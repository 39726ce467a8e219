"""Model label → serving provider and API model name (a run dimension)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traitgrid.functions.text import _c


def provider(label) -> Column:
    lab = _c(label)
    return (F.when(lab.startswith("claude"), F.lit("anthropic"))
            .when(F.lower(lab).contains("hyperbolic"), F.lit("hyperbolic"))
            .otherwise(F.lit("openai")))


def api_model_name(label) -> Column:
    """The label itself, except that hyperbolic labels lose their first ``hyperbolic-``."""
    lab = _c(label)
    return F.when(provider(lab) == "hyperbolic",
                  F.regexp_replace(lab, r"(?s)^(.*?)hyperbolic-", "$1")).otherwise(lab)
