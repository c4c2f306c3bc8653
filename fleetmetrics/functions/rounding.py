"""Rounding rules.

The reports mix two kinds of rounding: SQL ``ROUND`` (half away from zero, on
the scaled double) and the half-to-even rounding of correctly rounded decimals
that Python's ``round`` performs. Both are plain arithmetic here, so they stay
inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: From 2**52 on a double has no fraction.
FRACTIONLESS = 4503599627370496.0


def sql_round_text(x: str, decimals: int) -> str:
    """SQL ``ROUND(x, decimals)`` of a double column: scale, half away from zero, unscale.

    Past 2**52 the scaled double has no fraction left to round, so ``x`` stays as it is.
    """
    if decimals == 0:
        return f"round({x})"
    scaled = f"{x} * {10**decimals}D"
    return f"CASE WHEN abs({scaled}) < {FRACTIONLESS!r}D THEN round({scaled}) / {10**decimals}D ELSE {x} END"


def sql_round(x: Column, decimals: int) -> Column:
    """:func:`sql_round_text` of an expression."""
    if decimals == 0:
        return F.round(x)
    scale = float(10**decimals)
    return F.when(F.abs(x * scale) < FRACTIONLESS, F.round(x * scale) / scale).otherwise(x)


def even_round_text(x: str, decimals: int = 0) -> str:
    """:func:`even_round` of a double column, as a SQL text."""
    if decimals == 0:
        return f"rint({x})"
    scale = f"{10**decimals}D"
    product, high = f"({x} * {scale})", f"({x} * 134217729D - ({x} * 134217729D - {x}))"
    below, error = f"CAST(floor({product}) AS DOUBLE)", f"(({high} * {scale} - {product}) + ({x} - {high}) * {scale})"
    return (
        f"CASE WHEN NOT abs({product}) < {FRACTIONLESS!r}D THEN {x} "
        f"WHEN {product} - {below} = 0.5D AND {error} > 0 THEN ({below} + 1) / {scale} "
        f"WHEN {product} - {below} = 0.5D AND {error} < 0 THEN {below} / {scale} "
        f"ELSE rint({product}) / {scale} END"
    )


def even_round(x: Column, decimals: int = 0) -> Column:
    """Python's ``round(x, decimals)`` of a double, for 0 <= decimals <= 6.

    ``x * 10**decimals`` is formed as product + exact error (a two-product
    split), because whether ``x`` lies above or below a decimal tie such as
    0.15 is decided by bits the plain product has already lost.
    """
    if decimals == 0:
        return F.rint(x)
    scale = float(10**decimals)
    product = x * scale
    split = x * 134217729.0
    high = split - (split - x)
    error = (high * scale - product) + (x - high) * scale
    below = F.floor(product).cast("double")
    on_tie = (product - below) == 0.5
    rounded = (
        F.when(on_tie & (error > 0), below + 1)
        .when(on_tie & (error < 0), below)
        .otherwise(F.rint(product))
    )
    return F.when(F.abs(product) < FRACTIONLESS, rounded / scale).otherwise(x)


def with_even_round(df: DataFrame, column: str, decimals: int) -> DataFrame:
    """Replace a computed column by its half-to-even rounded value.

    The rounding is a projection of its own, so the value is computed once.
    """
    return df.withColumn(column, even_round(F.col(column), decimals))
