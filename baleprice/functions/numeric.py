"""Column helpers shared by every operator: rounding rules, clipping, small literal maps.

Rounding contract (three rules in the reference, never ``F.round``):

* ``round_even``  -- numpy/pandas style, ``rint(x * 10^d) / 10^d`` (ties to even on the scaled value).
* ``round_py``    -- Python's ``round(x, d)`` on a float: decided on the exact binary value of ``x``.
  The scaled product ``x * 10^d`` can round onto an exact .5 that is not a tie of ``x`` itself; the
  rounding error of that product is recovered exactly (Veltkamp split / Dekker two-product, plain
  double arithmetic) and breaks such false ties. True ties go to even, as Python does.
* ``round_js``    -- JavaScript ``Math.round(x * 10^d) / 10^d`` = ``floor(x * 10^d + 0.5) / 10^d``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c, digits: int) -> Column:
    scale = float(10 ** digits)
    return F.rint(col_of(c) * F.lit(scale)) / F.lit(scale)


_SPLIT = 134217729.0  # 2^27 + 1


def split_const(v: float) -> tuple[float, float]:
    """Veltkamp split of a constant into high and low halves (exact: hi + lo == v)."""
    c = v * _SPLIT
    hi = c - (c - v)
    return hi, v - hi


def round_py(c, digits: int) -> Column:
    """Python ``round(x, digits)`` for doubles (see module docstring).

    p = x * 10^d; its exact rounding error is err = (x_hi * s - p) + x_lo * s (Veltkamp split of x;
    s = 10^d has few significant bits, so both products are exact for d <= 8). Only when p lands
    exactly on k + 0.5 does err matter: p is nudged by +-0.25 towards the true value before ``rint``;
    a true tie (err = 0) stays and goes to even. The argument is referenced ~11 times, so keep it a
    column reference or a small expression."""
    assert 0 <= digits <= 8
    x = col_of(c)
    scale = float(10 ** digits)
    s = F.lit(scale)
    p = x * s
    cx = x * F.lit(_SPLIT)
    x_hi = cx - (cx - x)
    err = (x_hi * s - p) + (x - x_hi) * s
    nudge = F.when(p - F.floor(p) == F.lit(0.5), F.signum(err) * F.lit(0.25)).otherwise(F.lit(0.0))
    return F.rint(p + nudge) / s


def round_js(c, digits: int) -> Column:
    scale = float(10 ** digits)
    return F.floor(col_of(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clip(c, lo: float, hi: float) -> Column:
    """``np.clip`` that keeps NULL as NULL and NaN as NaN (``greatest(lo, NULL)`` would give ``lo``)."""
    x = col_of(c)
    return F.when(x.isNull() | F.isnan(x), x.cast("double")).otherwise(
        F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def clip01(c) -> Column:
    return clip(c, 0.0, 1.0)


def literal_map(mapping: Mapping) -> Column:
    """A literal MAP column for a fixed lookup table of a handful of keys (evaluated in codegen)."""
    parts = []
    for k, v in mapping.items():
        parts += [F.lit(k), F.lit(float(v)) if isinstance(v, (int, float)) else F.lit(v)]
    return F.create_map(*parts)


def map_get(mapping: Mapping, key, default=None) -> Column:
    """``mapping.get(key, default)`` as a column; a NULL key gives the default."""
    value = F.try_element_at(literal_map(mapping), col_of(key))
    if default is None:
        return value
    return F.coalesce(value, F.lit(default))


def step_value(c, steps, otherwise: float) -> Column:
    """Right-closed step function: first ``(bound, value)`` with ``x <= bound`` wins."""
    x = col_of(c)
    expr = None
    for bound, value in steps:
        cond = x <= F.lit(float(bound))
        expr = F.when(cond, F.lit(float(value))) if expr is None else expr.when(cond, F.lit(float(value)))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(expr.otherwise(F.lit(float(otherwise))))


def round_doubles(df: DataFrame, digits: int = 6, exclude: tuple = ()) -> DataFrame:
    """Round every double column (output formatting only: removes last-bit noise of sums)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double" and f.name not in exclude:
            out.append(round_even(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def row_digest(key: list[str], seed: int) -> Column:
    """A seeded hash of a row's key columns as hex text: the md5 of their text forms and the seed, a missing value as
    empty text. Any engine with md5 gives the same, and it doesn't depend on how the rows are partitioned."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def row_bucket(key: list[str], seed: int, buckets: int) -> Column:
    """The bucket 0 .. ``buckets`` - 1 of a row: the first 32 bits of its ``row_digest``, modulo ``buckets``."""
    return F.conv(F.substring(row_digest(key, seed), 1, 8), 16, 10).cast("long") % F.lit(buckets)
