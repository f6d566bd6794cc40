"""The standard normal distribution function as a column expression, and as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation in West's form (2005), double precision.
_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_CUT, _FAR, _ROOT = 7.07106781186547, 37.0, 2.506628274631


def _horner(factors: tuple[float, ...], x: str) -> str:
    out = repr(factors[0])
    for f in factors[1:]:
        out = f"({out} * {x} + {f!r})"
    return out


def phi_sql(x: str) -> str:
    """SQL of the distribution function at the column or expression x; the same text runs in Spark and in DuckDB."""
    a = f"abs({x})"
    mid = f"exp(-{a} * {a} / 2) * {_horner(_TOP, a)} / {_horner(_BOTTOM, a)}"
    tail = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / {_ROOT!r}"
    upper = f"(CASE WHEN {a} > {_FAR!r} THEN 0.0 WHEN {a} < {_CUT!r} THEN {mid} ELSE {tail} END)"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN 1 - {upper} ELSE {upper} END)"


def _typed(sql: str) -> str:
    import re

    return re.sub(r"(?<![\w.])(\d+\.\d+(?:e-?\d+)?)", r"\1D", sql)


def phi(name: str) -> Column:
    """The distribution function at the DOUBLE column `name`; NULL stays NULL."""
    return F.expr(_typed(phi_sql(name)))
