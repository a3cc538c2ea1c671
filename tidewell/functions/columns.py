"""Column expressions shared by the operators.  All are JVM-side built-ins.

Randomness is never drawn from a generator: every "random" number is a digest
of (seed, key[, salt]), so a recomputed partition after an executor loss gives
the same rows, and the same text runs in an independent SQL engine.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.spec import q

TWO_POW_52 = float(2 ** 52)


def c(name: str) -> Column:
    return F.col(q(name))


def hash_text(key: Column | str, seed: int = 42, salt: str | None = None) -> Column:
    """md5 of ``'<seed>|<key>[|<salt>]'`` as 32 hex chars; ordered as text it is a shuffle."""
    key = c(key) if isinstance(key, str) else key
    parts = [F.lit(str(seed)), F.lit("|"), key.cast("string")]
    if salt is not None:
        parts += [F.lit("|"), salt if isinstance(salt, Column) else F.lit(str(salt))]
    return F.md5(F.concat(*parts))


def hash_uniform(key: Column | str, seed: int = 42, salt: str | Column | None = None) -> Column:
    """A number in [0, 1) from the first 13 hex digits of :func:`hash_text` (52 bits, exact)."""
    h = hash_text(key, seed, salt)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(TWO_POW_52)


def null_count(cols: Iterable[str]) -> Column:
    """Number of NULL cells among ``cols`` in a row."""
    cols = list(cols)
    if not cols:
        return F.lit(0)
    expr = None
    for name in cols:
        term = c(name).isNull().cast("int")
        expr = term if expr is None else expr + term
    return expr


def minkowski(left: Sequence[Column], right: Sequence[Column], p: float = 2.0) -> Column:
    """(Σ |a-b|^p)^(1/p); a term with a NULL side is skipped (counts 0)."""
    total = None
    for a, b in zip(left, right):
        term = F.coalesce(F.pow(F.abs(a - b), F.lit(float(p))), F.lit(0.0))
        total = term if total is None else total + term
    if total is None:
        return F.lit(0.0)
    if p == 1:
        return total
    return F.sqrt(total) if p == 2 else F.pow(total, F.lit(1.0 / p))


def row_max(cols: Sequence[str]) -> Column:
    """Largest value of a row over ``cols`` (NULLs ignored)."""
    if len(cols) == 1:
        return c(cols[0])
    return F.greatest(*[c(x) for x in cols])


def round_half_even(col: Column, scale: int = 0) -> Column:
    """Python's ``round``: half to even."""
    return F.bround(col, scale)


def r6(col: Column) -> Column:
    """Round a floating result to 6 places (the oracle comparison grain)."""
    return F.round(col.cast("double"), 6)


def sql_list(values: Iterable[str]) -> str:
    """Values as a SQL literal list, e.g. ``('a', 'b')``."""
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"
