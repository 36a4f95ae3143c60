"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: probabilities are kept this far from 0 and 1 before a logarithm is taken.
LOG_LOSS_EPS = 1e-15


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_order(key: Sequence[str] | str, seed: int) -> Column:
    """A pseudo-random but repeatable order key: the hex digest of ``seed:key``."""
    keys = [key] if isinstance(key, str) else list(key)
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def binary_label(c: Column | str, positive: str) -> Column:
    """1 where the trimmed text equals ``positive``, else 0."""
    return F.coalesce((F.trim(as_col(c)) == F.lit(positive)).cast("int"), F.lit(0))


def log1p_float(c: Column | str) -> Column:
    """``ln(x + 1)`` in single precision; null where it is undefined."""
    x = as_col(c).cast("double") + F.lit(1.0)
    return F.when(x > 0, F.ln(x)).cast("float")


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, null for a zero denominator (safe in ANSI mode)."""
    d = den.cast("double")
    return F.when(d != 0, num.cast("double") / d)


def exponent_text(c: Column | str, digits: int = 10) -> Column:
    """A double in exponent notation with ``digits`` decimals."""
    return F.format_string(f"%1.{digits}e", as_col(c).cast("double"))
