"""Whitespace handling with Python ``str.strip`` semantics.

Spark's ``trim`` removes spaces only; replies and inventory lines also carry
tabs, newlines and Unicode spaces, so stripping uses an explicit class.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts (Unicode White_Space
# plus the ASCII information separators) — as a plain set for btrim/trim, and as
# a character class valid in both Java regex and RE2.
PY_WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                       "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
PY_WHITESPACE = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                 r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``s.strip()`` — a character-set trim, no regex."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE_CHARS))


def first_char(col) -> Column:
    """``s.strip()[:1]`` — the reply parser of the training environment."""
    return F.substring(py_strip(col), 1, 1)


def strip_echo(response, prompt) -> Column:
    """``response[len(prompt):].strip()``: drop an echoed prompt by length."""
    r, p = _c(response), _c(prompt)
    return py_strip(r.substr(F.length(p) + 1, F.greatest(F.length(r), F.lit(1))))


def normalize_item(col) -> Column:
    """Inventory item text → question: ``'I ' + s.strip().lower()``."""
    return F.concat(F.lit("I "), F.lower(py_strip(col)))


@functools.lru_cache(maxsize=1)
def decimal_digit_table() -> tuple[str, str]:
    """(from, to) strings mapping every non-ASCII Unicode decimal digit (category
    Nd — what Python's ``int()`` accepts) to its ASCII digit; built by rule."""
    src, dst = [], []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.category(ch) == "Nd":
            src.append(ch)
            dst.append(str(unicodedata.decimal(ch)))
    return "".join(src), "".join(dst)


def ascii_digits(col) -> Column:
    """Replace every Unicode decimal digit by its ASCII digit (like ``int()`` reads them)."""
    src, dst = decimal_digit_table()
    return F.translate(_c(col), src, dst)
