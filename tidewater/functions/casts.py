"""Text results to numbers with a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number: digits (single underscores between them), one point, an exponent; or infinity, or not-a-number.
NUMBER = r"(?i)^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?|inf|infinity|nan)$"


def _number(text) -> Column:
    t = F.btrim((text if isinstance(text, Column) else F.col(text)).cast("string"), F.lit(" \t\n\r\f\x0b"))
    return F.when(t.rlike(NUMBER), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))


def safe_float(text, default: float = 0.0) -> Column:
    """The number a text stands for; the default for null, blank and other texts."""
    return F.coalesce(_number(text), F.lit(float(default)))


def safe_int(text, default: int = 0) -> Column:
    """The number cut towards zero; the default also for what is no finite number or beyond a long."""
    n = _number(text)
    return F.coalesce(F.when(~F.isnan(n) & (F.abs(n) < 9.2e18), n.try_cast("bigint")), F.lit(default).cast("bigint"))
