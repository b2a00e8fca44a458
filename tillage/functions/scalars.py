"""Small scalar helpers: numeric coercion, mean fill, standardising, rounding, slugs."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Text that reads as a number: no type suffix such as 10d or 7F, which a cast would accept.
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?|nan)\s*$"


def to_number_or_null(c, dtype: str = "double", nan_is_null: bool = True) -> Column:
    """Like ``pd.to_numeric(errors="coerce")``: unparsable text becomes null, NaN becomes null."""
    text = _c(c).cast("string")
    v = F.when(text.rlike(NUMBER), text).try_cast(dtype)
    return F.nanvl(v, F.lit(None).cast(dtype)) if nan_is_null and dtype in ("double", "float") else v


def nan_to_null(c) -> Column:
    """pandas treats NaN as missing; Spark separates them. Normalise once on ingest."""
    return F.nanvl(_c(c), F.lit(None).cast("double"))


def fill_with(c, value) -> Column:
    """Null → a given (training) value."""
    return F.coalesce(_c(c), value if isinstance(value, Column) else F.lit(value))


def standardize(c, mean, std, floor: float = 1e-8) -> Column:
    """(x - mean) / std, with std <= floor treated as 1."""
    m = mean if isinstance(mean, Column) else F.lit(float(mean))
    s = std if isinstance(std, Column) else F.lit(float(std))
    s = F.when(s <= F.lit(floor), F.lit(1.0)).otherwise(s)
    return (_c(c).cast("double") - m) / s


def round_half_even(c, digits: int = 4) -> Column:
    """NumPy-style rounding (half to even)."""
    return F.bround(_c(c), digits)


def slug(c) -> Column:
    """Spaces → underscores (for per-group output folders)."""
    return F.regexp_replace(_c(c), " ", "_")


def rank_label(pos) -> Column:
    """N19: 'Top-1', 'Top-2', ... from a 0-based position."""
    return F.concat(F.lit("Top-"), (_c(pos) + 1).cast("string"))


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType) and not isinstance(dt, T.BooleanType)
