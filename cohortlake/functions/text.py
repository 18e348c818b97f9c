"""Null-token cleaning, lenient numeric parsing and payload typing.

All helpers return built-in Column expressions, so they stay inside
whole-stage codegen; no Python UDF is involved.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import FEATURES, Feature

# --- fixed values -------------------------------------------------------------
# Tokens (compared lower-case, after trimming) that the text cleaner treats as missing.
NULL_TOKENS = ("nan", "na", "not available", "[not available]", "unknown")
# Exact-case cells that a default CSV reader of the reference's stack reads as missing.
READER_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Text forms of a missing categorical after string conversion.
CATEGORICAL_SENTINELS = ("None", "<NA>", "nan")
# --- end of fixed values --------------------------------------------------------

# A decimal number with optional sign/exponent; anything else is "not numeric".
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_EDGE_SPACE = r"^\s+|\s+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The whitespace class of a regex ``\s``: space, tab, newline, carriage return, vertical tab, form feed.
WHITESPACE = " \t\n\r\x0b\x0c"


def strip_text(c: Column | str) -> Column:
    """Strip leading/trailing whitespace of any kind (plain ``trim`` removes spaces only).

    A character-set trim, not a regex: the same result as removing leading/trailing regex whitespace.
    """
    return F.trim(_col(c).cast("string"), F.lit(WHITESPACE))


def clean_text(c: Column | str) -> Column:
    """Trimmed text, or NULL for empty text and the null tokens."""
    t = strip_text(c)
    return F.when((t == "") | F.lower(t).isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(t)


def reader_na(c: Column | str) -> Column:
    """Apply the reference reader's default missing-value list to a string column."""
    s = _col(c).cast("string")
    return F.when(s.isin(*READER_NA_TOKENS), F.lit(None).cast("string")).otherwise(s)


def to_number(c: Column | str) -> Column:
    """Lenient numeric coercion; unparsable text and NaN become NULL."""
    s = _col(c).cast("string")
    return F.when(s.rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))


def coerce_feature_types(df: DataFrame, features: Iterable[Feature] = FEATURES) -> DataFrame:
    """Numerics coerced with B4, categoricals to string minus null sentinels."""
    changes = {}
    for f in features:
        if f.name not in df.columns:
            continue
        if f.numeric:
            kind = dict(df.dtypes)[f.name]
            if kind in ("double", "float"):
                changes[f.name] = F.when(~F.isnan(f.name), F.col(f.name))
            elif kind == "string":
                changes[f.name] = to_number(f.name)
        else:
            s = F.col(f.name).cast("string")
            changes[f.name] = F.when(s.isin(*CATEGORICAL_SENTINELS), F.lit(None).cast("string")).otherwise(s)
    return df.withColumns(changes) if changes else df


def _typed_default(f: Feature) -> Column:
    if f.dtype in ("int", "binary"):
        return F.lit(int(f.default)).cast("int")
    if f.dtype == "float":
        return F.lit(float(f.default)).cast("double")
    return F.lit(str(f.default))


def normalize_feature(f: Feature, c: Column, on_invalid: str = "default") -> Column:
    """One payload value to its catalog type.

    NULL or '' gives the default; ints truncate toward zero.  Text that is no
    number (``12d``, ``nan``, ``Infinity``) gives the default with
    ``on_invalid='default'`` and an error with ``'fail'``.
    """
    s = c.cast("string")
    missing = s.isNull() | (s == "")
    default = _typed_default(f)
    if f.dtype in ("int", "binary"):
        parsed = to_number(s).try_cast("int")
    elif f.dtype == "float":
        parsed = to_number(s)
    else:
        return F.when(missing, default).otherwise(s)
    invalid = default if on_invalid == "default" else F.raise_error(F.concat(F.lit(f"{f.name} is not a number: "), s))
    return F.when(missing, default).otherwise(F.coalesce(parsed, invalid))


def normalize_payload(df: DataFrame, features: Sequence[Feature] = FEATURES,
                      on_invalid: str = "default", keep: Sequence[str] = ()) -> DataFrame:
    """B6 + B8: typed feature columns in catalog order; absent columns take defaults."""
    cols = [F.col(k) for k in keep]
    for f in features:
        src = F.col(f.name) if f.name in df.columns else F.lit(None).cast("string")
        cols.append(normalize_feature(f, src, on_invalid).alias(f.name))
    return df.select(*cols)


def constraint_violations(features: Sequence[Feature] = FEATURES, present: Sequence[str] | None = None) -> Column:
    """Array of '<feature>:<range|choice>' strings a row violates.

    Range checks use the declared min/max; choice checks compare
    case-insensitively (recoded T/N/M codes are upper-case).
    """
    checks = []
    for f in features:
        if present is not None and f.name not in present:
            continue
        x = F.col(f.name)
        if f.numeric and f.minimum is not None and f.maximum is not None:
            checks.append(F.when((x < F.lit(float(f.minimum))) | (x > F.lit(float(f.maximum))),
                                 F.lit(f"{f.name}:range")))
        if f.choices:
            if f.numeric:
                bad = ~x.isin(*[float(v) for v in f.choices])
            else:
                bad = ~F.lower(x).isin(*[str(v).lower() for v in f.choices])
            checks.append(F.when(x.isNotNull() & bad, F.lit(f"{f.name}:choice")))
    if not checks:
        return F.array().cast("array<string>")
    return F.filter(F.array(*checks), lambda v: v.isNotNull())
