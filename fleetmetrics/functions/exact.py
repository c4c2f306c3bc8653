"""Sums of doubles that do not depend on the order of the rows.

A double is cut into four integers of its sign, in units of 2**48, 1, 2**-48 and 2**-96 (all but
the first below 2**48), which is exact for magnitudes from 2**-43 to 2**111; what lies below 2**-96
is dropped for each value by itself. The integers are summed as decimals, so partial sums meet
in any order with the same result, and means, deviations and slopes are formed from the whole
sums with integer arithmetic; only the last step works in doubles. Products are cut into the
rounded product and its exact error first.

NaN, infinities and magnitudes from 2**111 on (2**55 for a factor of a product) have no such
parts: a group that holds one takes the plain sum of them in place of the exact one.

Expressions are SQL texts, as they refer to columns by name and are many to a plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BITS = 48
LIMBS = 4
_UNIT = f"{1 << BITS}D"
_WHOLE_UNIT = f"{1 << BITS}BD"
_WHOLE = "DECIMAL(38,0)"
#: What product steps hand on.
_PASSED = ("a", "b", "ah", "bh", "p", "e")
#: Magnitudes that have parts; those of the factors of a product.
_SUM, _PRODUCT = f"{float(1 << 111)!r}D", f"{float(1 << 55)!r}D"


# ---------------------------------------------------------------- rows to parts


def _parts(x: str) -> list[str]:
    """The four integers of a double; scaling by a power of two and ``%`` are exact."""
    cut = (f"{x} / {_UNIT}", f"{x} % {_UNIT}", f"({x} % 1D) * {_UNIT}", f"(({x} * {_UNIT}) % 1D) * {_UNIT}")
    return [f"CAST({part} AS BIGINT)" for part in cut]


def parts_steps(name: str, x: str) -> list[dict[str, str]]:
    """The parts ``<name>_0`` .. ``<name>_3`` of column ``x``, or ``<name>_x`` if it has none, as one projection."""
    fits = f"abs({x}) < {_SUM}"
    parts = {f"{name}_{i}": f"CASE WHEN {fits} THEN CAST({p} AS DECIMAL(20,0)) END" for i, p in enumerate(_parts(x))}
    return [parts | {f"{name}_x": f"CASE WHEN NOT {fits} THEN {x} END"}]


def product_steps(name: str, x: str, y: str) -> list[dict[str, str]]:
    """The parts of ``x * y``, those of the rounded product and of its exact error.

    Each step is a projection of its own: what it names is computed once, not written out again.
    Columns that begin with ``<name>_`` and a letter are only passed on between steps.
    """
    a, b, ah, bh, p, e = (f"{name}_{v}" for v in _PASSED)
    fits = f"abs({x}) < {_PRODUCT} AND abs({y}) < {_PRODUCT}"
    error = f"(({ah} * {bh} - {p}) + {ah} * ({b} - {bh}) + ({a} - {ah}) * {bh}) + ({a} - {ah}) * ({b} - {bh})"
    both = zip(_parts(p), _parts(e))
    return [
        {v: f"CASE WHEN {fits} THEN CAST({of} AS DOUBLE) END" for v, of in ((a, x), (b, y))},
        {h: f"{v} * 134217729D - ({v} * 134217729D - {v})" for v, h in ((a, ah), (b, bh))} | {p: f"{a} * {b}"},
        {e: error},
        {f"{name}_{i}": f"CAST({one} + {other} AS DECIMAL(20,0))" for i, (one, other) in enumerate(both)}
        | {f"{name}_x": f"CASE WHEN NOT ({fits}) THEN {x} * {y} END"},
    ]


def with_steps(df: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    for columns in steps:
        df = df.withColumns({name: F.expr(sql) for name, sql in columns.items()})
    return df


def steps_sql(source: str, steps: list[dict[str, str]]) -> str:
    """The same as a SQL text around the query ``source``."""
    for columns in steps:
        source = f"SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in columns.items())} FROM ({source})"
    return source


def with_parts(df: DataFrame, name: str, x: str) -> DataFrame:
    """Add the parts of a column: a row is cut once however many sums use it."""
    return with_steps(df, parts_steps(name, x))


def with_product_parts(df: DataFrame, name: str, x: str, y: str) -> DataFrame:
    return with_steps(df, product_steps(name, x, y)).drop(*[f"{name}_{v}" for v in _PASSED])


def sums(parts: str, name: str, where: str = "true") -> list[str]:
    """Aggregates of the parts, of the rows where a condition holds, under the names of ``name``."""
    return [f"sum(CASE WHEN {where} THEN {parts}_{i} END) AS {name}_{i}" for i in (*range(LIMBS), "x")]


# ---------------------------------------------------------------- whole sums
#
# Parts are arrays of four whole numbers, and ``_let`` names a value that is used more than once.


def _whole(sql: str) -> str:
    return f"CAST({sql} AS {_WHOLE})"


def _let(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _summed(name: str) -> str:
    """The summed parts, a group without any value counting as zero."""
    return f"array({', '.join(_whole(f'coalesce({name}_{i}, 0)') for i in range(LIMBS))})"


def _carried(parts: str) -> str:
    """Every part but the first brought below 2**48, what is over going to the one above."""
    split = (
        f"named_struct('over', {_whole(f'(t - pmod(t, {_WHOLE_UNIT})) / {_WHOLE_UNIT}')}, "
        f"'done', concat(array({_whole(f'pmod(t, {_WHOLE_UNIT})')}), s.done))"
    )
    start = f"named_struct('over', {_whole('0')}, 'done', CAST(array() AS ARRAY<{_WHOLE}>))"
    top = _whole(f"s.over * {_WHOLE_UNIT} + get(s.done, 0)")
    return (
        f"aggregate(reverse({parts}), {start}, (s, part) -> {_let('t', _whole('part + s.over'), split)}, "
        f"s -> concat(array({top}), slice(s.done, 2, {LIMBS - 1})))"
    )


def _combined(*terms: tuple[str, str]) -> str:
    """The carried sum of whole multiples of parts: ``(multiple, parts), ...``."""
    added = ""
    for k, parts in terms:
        times = f"transform({parts}, part -> {_whole(f'{_whole(k)} * part')})"
        added = f"zip_with({added}, {times}, (a, b) -> {_whole('a + b')})" if added else times
    return _carried(added)


def _squared(s: str) -> str:
    """The parts of the square of a carried sum below 2**75; what lies below 2**-96 is dropped."""
    a, b, c, d = (f"get({s}, {i})" for i in range(LIMBS))
    top = f"{a} * {a} * {_WHOLE_UNIT} + {a} * {b} * 2"
    return f"array({', '.join(map(_whole, (top, f'{a}*{c}*2 + {b}*{b}', f'{a}*{d}*2 + {b}*{c}*2', f'{b}*{d}*2 + {c}*{c}')))})"


def _ones(p: str) -> str:
    return _whole(f"get({p}, 0) * {_WHOLE_UNIT} + get({p}, 1)")


def _fraction(p: str) -> str:
    return f"(CAST(get({p}, 2) AS DOUBLE) / {_UNIT} + CAST(get({p}, 3) AS DOUBLE) / {_UNIT} / {_UNIT})"


def _double(p: str) -> str:
    """A carried sum as a double."""
    return f"(CAST({_ones(p)} AS DOUBLE) + {_fraction(p)})"


def _total(name: str) -> str:
    """The sum of a group as a double, with the values that have no parts."""
    return f"({_let('p', _carried(_summed(name)), _double('p'))} + coalesce({name}_x, 0D))"


def mean(name: str, count: str) -> str:
    """A sum divided by a count: the whole quotient, which is exact, and the rest.

    A mean of large values keeps every digit a double has. NULL for a count of zero.
    """
    n = f"CAST(nullif({count}, 0) AS DECIMAL(20,0))"
    over = f"pmod(w, {n})"
    divided = (
        f"CAST({_whole(f'(w - {over}) / {n}')} AS DOUBLE) + (CAST({over} AS DOUBLE) + {_fraction('p')}) / CAST({n} AS DOUBLE)"
    )
    exact = _let("p", _summed(name), _let("w", _ones("p"), divided))
    return f"CASE WHEN {name}_x IS NULL THEN {exact} ELSE {_total(name)} / nullif({count}, 0) END"


def deviation(name: str, squares: str, count: str) -> str:
    """The sample standard deviation from the sums of values and of their squares.

    n * sum(x^2) - sum(x)^2 is formed from whole numbers: nothing cancels in doubles. NULL
    below two values.
    """
    n = f"CAST({count} AS DOUBLE)"
    spread = _let("s", _carried(_summed(name)), _combined((count, _summed(squares)), ("-1", _squared("s"))))
    plain = f"greatest({n} * {_total(squares)} - {_total(name)} * {_total(name)}, 0D)"
    exact = _let("v", spread, _double("v"))
    return f"sqrt(CASE WHEN {squares}_x IS NULL THEN {exact} ELSE {plain} END / nullif({n} * ({n} - 1), 0D))"


def line(products: str, name: str, count: str, sum_x: str, sum_xx: str, origin: str) -> str:
    """A struct of the least-squares ``slope`` over whole ``x`` and the line's ``zero`` from ``origin``.

    ``products`` and ``name`` are the sums of x * y and y; count and sums of x are whole. Both
    results are quotients of whole numbers: nothing cancels in doubles and one division is
    left. They are NULL if x does not vary, the zero also if the line is level.
    """
    n, x, xx, at = map(_whole, (count, sum_x, sum_xx, origin))
    run = _whole(f"{n} * {xx} - {x} * {x}")
    below = f"nullif(CAST({run} AS DOUBLE), 0D)"
    fall = _combined((f"{x} - {n} * {at}", "r"), (f"-{run}", _summed(name)))
    steep = f"(nullif({_double('r')}, 0D) * CAST({n} AS DOUBLE))"
    ends = f"named_struct('slope', {_double('r')} / {below}, 'zero', {_let('f', fall, _double('f'))} / {steep})"
    exact = _let("r", _combined((n, _summed(products)), (f"-{x}", _summed(name))), ends)
    plain = f"({count} * {_total(products)} - {sum_x} * {_total(name)}) / {below}"
    return f"CASE WHEN {products}_x IS NULL THEN {exact} ELSE named_struct('slope', {plain}, 'zero', CAST(NULL AS DOUBLE)) END"
