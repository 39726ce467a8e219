"""Rating extraction, validation, reverse keying, rounding and formatting."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from traitgrid.functions.text import _c
from traitgrid.schemas import DEFAULT_SCALE, RatingScale

# Unicode decimal digits, as Python's ``\d`` on str patterns (Java and RE2 syntax).
DIGIT_RUN = r"(\p{Nd}+)"


def digit_strings(text) -> Column:
    """Distinct digit runs of a reply (``set(re.findall(r'\\d+', t))``)."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(DIGIT_RUN), 1))


def extract_number(text) -> Column:
    """The single distinct digit string of a reply, else null (ambiguous or none).

    ``"5 out of 5"`` → ``"5"``; ``"3.0"`` → null; ``"05"`` → ``"05"``.
    """
    d = digit_strings(text)
    return F.when(F.size(d) == 1, F.element_at(d, 1))


def rating_text(number, scale: RatingScale = DEFAULT_SCALE, allowed: list[str] | None = None) -> Column:
    """Extracted number → the stored rating text: itself if allowed, else ``'N/A'``."""
    allowed = scale.allowed if allowed is None else allowed
    n = _c(number)
    return F.when(n.isin(*allowed), n).otherwise(F.lit("N/A"))


def rating_value(text, scale: RatingScale = DEFAULT_SCALE) -> Column:
    """Stored rating text → int when its number is one of the scale's values (``5.0``
    is 5, as in a numeric column with a gap), else null. The scale's own texts are taken as they are; only
    others are looked at as numbers, and a suffix such as ``5d`` makes none."""
    t = _c(text).cast("string")
    n = F.when(t.rlike(r"\A\s*[+-]?[0-9]+(\.0*)?\s*\z"), t.try_cast("double"))
    return (F.when(t.isin(*scale.allowed), t.try_cast("int"))
            .when(t.isNotNull() & ~t.isin("N/A"), F.when(n.isin(*[float(x) for x in scale.allowed]), n.cast("int"))))


def reverse_key(rating, weight, scale: RatingScale = DEFAULT_SCALE) -> Column:
    """Mirror a rating when its item is minus-keyed (weight exactly −1)."""
    r, w = _c(rating), _c(weight)
    return F.when(w == -1, F.lit(scale.mirror) - r).otherwise(r)


def round_half_even(x, digits: int = 2) -> Column:
    """numpy-style rounding: scale, round half to even, unscale."""
    f = float(10 ** digits)
    return F.rint(_c(x) * f) / f


def format_score(mean, std, sep: str = "+-", missing: str = "N/A") -> Column:
    """``str(m) + '+-' + str(s)``, or ``'N/A'`` when there is no valid rating."""
    m, s = _c(mean), _c(std)
    return F.coalesce(F.concat(m.cast("string"), F.lit(sep), s.cast("string")), F.lit(missing))


def parse_score(text, part: int = 1, sep: str = "+-") -> Column:
    """Inverse of ``format_score``: part 1 = mean, 2 = std; ``'N/A'`` → null."""
    return F.split_part(_c(text), F.lit(sep), F.lit(part)).try_cast("double")


@functools.lru_cache(maxsize=None)
def tie_rounds_up(digits: int = 2, max_value: float = 10.0) -> tuple[bool, ...]:
    """For each decimal tie t_k = (k + ½)·10^-digits below ``max_value``: does
    Python's ``round(t_k, digits)`` go up? (It rounds the nearest double to t_k,
    which lies above or below t_k.) Built by rule, one entry per tie."""
    scale = 10 ** digits
    return tuple(round((2 * k + 1) / (2 * scale), digits) * scale > k + 0.5
                 for k in range(int(max_value * scale) + 1))


def python_round_ratio(num, den, digits: int = 2, max_value: float = 10.0) -> Column:
    """Exactly ``round(num / den, digits)`` as Python computes it, for
    non-negative integer ``num`` and positive ``den`` (null when ``den`` is 0):
    the rational is rounded to nearest with integer arithmetic, and an exact
    decimal tie goes the way Python's rounding of the nearest double goes
    (``tie_rounds_up``). ``max_value`` must bound the ratio (the caller knows it)."""
    scale = 10 ** digits

    def idiv(x: Column, y: Column) -> Column:  # exact floor division of non-negative longs
        return ((x - F.pmod(x, y)) / y).cast("long")

    a = _c(num).cast("long") * (2 * scale)   # 2·scale·num
    b = F.when(_c(den) > 0, _c(den).cast("long"))
    quot = idiv(a, b)
    tie = (F.pmod(a, b) == 0) & (F.pmod(quot, F.lit(2)) == 1)   # num/den·scale = k + ½
    k = idiv(quot - 1, F.lit(2))
    # the tie table as one literal: character k+1 is '1' when tie k rounds up
    table = F.lit("".join("1" if x else "0" for x in tie_rounds_up(digits, max_value)))
    n_ties = len(tie_rounds_up(digits, max_value))
    up = F.when(k < n_ties, F.substring(table, (k + 1).cast("int"), 1) == "1").otherwise(F.pmod(k, F.lit(2)) == 1)
    nearest = idiv(a + b, 2 * b)                                 # floor(num/den·scale + ½)
    units = F.when(tie, k + F.when(up, 1).otherwise(0)).otherwise(nearest)
    return units / F.lit(float(scale))
