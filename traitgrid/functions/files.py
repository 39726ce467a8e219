"""Run file names: build, parse back, and cohort tests on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traitgrid.functions.text import _c

RUN_FILE_RE = r"^(.+)_([^_]*)_(\d{8}_\d{6})\.json$"
RUN_TS_FORMAT = "yyyyMMdd_HHmmss"


def run_file_name(model_path, trait, ts) -> Column:
    """``{model}_{trait}_{yyyymmdd_HHMMSS}.json``; model = second ``/`` segment
    of a hub path such as ``org/name``."""
    model = F.element_at(F.split(_c(model_path), "/"), 2)
    return F.concat(model, F.lit("_"), F.coalesce(_c(trait), F.lit("")), F.lit("_"),
                    F.date_format(_c(ts), RUN_TS_FORMAT), F.lit(".json"))


def parse_run_file(name) -> Column:
    """File name → struct(model, trait, stamp, run_ts); non-matching → nulls."""
    n = _c(name)
    ok = n.rlike(RUN_FILE_RE)
    stamp = F.regexp_extract(n, RUN_FILE_RE, 3)
    return F.struct(
        F.when(ok, F.regexp_extract(n, RUN_FILE_RE, 1)).alias("model"),
        F.when(ok, F.regexp_extract(n, RUN_FILE_RE, 2)).alias("trait"),
        F.when(ok, stamp).alias("stamp"),
        F.when(ok, F.try_to_timestamp(stamp, F.lit(RUN_TS_FORMAT))).alias("run_ts"),
    )


def contains_ci(col, needle: str) -> Column:
    return F.lower(_c(col)).contains(needle.lower())


def cohort_of(name, persona_tag: str = "neuroticism", baseline_tag: str = "__",
              size_tag: str = "1.5b", treated_tag: str = "grpo") -> Column:
    """Cohort label of a score-card file: ``<persona|base>/<treated|plain>`` for
    files of the chosen model size, null otherwise."""
    n = _c(name)
    persona = (F.when(contains_ci(n, persona_tag), F.lit(persona_tag.lower()))
               .when(contains_ci(n, baseline_tag), F.lit("base")))
    arm = F.when(contains_ci(n, treated_tag), F.lit(treated_tag.lower())).otherwise(F.lit("plain"))
    return F.when(contains_ci(n, size_tag) & persona.isNotNull(), F.concat(persona, F.lit("/"), arm))


def cohorts_of(name, persona_tag: str = "neuroticism", baseline_tag: str = "__",
               size_tag: str = "1.5b", treated_tag: str = "grpo") -> Column:
    """Every cohort a score-card file belongs to (array, for explode): a name with
    both tags is in both."""
    n = _c(name)
    arm = F.when(contains_ci(n, treated_tag), F.lit(treated_tag.lower())).otherwise(F.lit("plain"))
    sized = contains_ci(n, size_tag)
    return F.array_compact(F.array(
        F.when(sized & contains_ci(n, persona_tag), F.concat(F.lit(f"{persona_tag.lower()}/"), arm)),
        F.when(sized & contains_ci(n, baseline_tag), F.concat(F.lit("base/"), arm))))


def cohort_labels(persona_tag: str = "neuroticism", treated_tag: str = "grpo") -> list[str]:
    """Every label ``cohort_of`` can produce with these tags (a bounded set)."""
    return [f"{p}/{a}" for p in (persona_tag.lower(), "base") for a in (treated_tag.lower(), "plain")]
