"""Reward functions and answer extractors for completion logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traitgrid.functions.text import _c, ascii_digits, first_char, py_strip

# Reward per leading rating character; anything else scores -1.0.
RATING_REWARDS = {"5": 1.0, "4": 0.7, "3": 0.2, "2": 0.0, "1": -0.5}
RATING_REWARD_DEFAULT = -1.0


def rating_reward(completion, rewards: dict | None = None, default: float = RATING_REWARD_DEFAULT) -> Column:
    """Reward by the first character of the stripped completion (any Unicode
    decimal digit counts as its value)."""
    table = RATING_REWARDS if rewards is None else rewards
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(m, ascii_digits(first_char(completion))), F.lit(float(default)))


def format_reward(completion, hit: float = 1.0, miss: float = -0.5, lo: int = 1, hi: int = 5) -> Column:
    """``hit`` when the whole completion (unstripped) is made of decimal digits
    and its value is in lo..hi (leading zeros allowed), else ``miss``."""
    assert 0 <= lo <= hi <= 9, "single-digit scales only"
    pattern = rf"\A0*[{lo}-{hi}]\z" if lo > 0 else rf"\A0*[{lo}-{hi}]\z|\A0+\z"
    c = _c(completion)
    # the translate only runs for all-digit completions with non-ASCII digits
    ok = F.coalesce(c.rlike(pattern) | (c.rlike(r"\A\p{Nd}+\z") & ascii_digits(c).rlike(pattern)), F.lit(False))
    return F.when(ok, F.lit(float(hit))).otherwise(F.lit(float(miss)))


def xml_answer(text) -> Column:
    """Text after the last ``<answer>`` and before the next ``</answer>``, stripped;
    the whole text (stripped) when there is no tag."""
    t = _c(text)
    return py_strip(F.substring_index(F.substring_index(t, "<answer>", -1), "</answer>", 1))


def hash_answer(text) -> Column:
    """Null without ``####``; else the second ``####`` piece, stripped, without
    ``,`` and ``$``."""
    t = _c(text)
    return F.when(t.contains("####"),
                  F.translate(py_strip(F.split_part(t, F.lit("####"), F.lit(2))), ",$", ""))
