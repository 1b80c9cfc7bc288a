"""Distribution tails as DuckDB expressions, by Simpson's rule over the density: independent of the library's own."""

from __future__ import annotations

PANELS = 4000


def integral(density: str, upto: str) -> str:
    """Integral from 0 to ``upto`` of a density in x."""
    at = density.replace("{x}", f"(({upto}) * i / {PANELS}.0::DOUBLE)")
    weight = f"CASE WHEN i = 0 OR i = {PANELS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum([({weight}) * ({at}) FOR i IN range({PANELS + 1})]) * ({upto}) / {3 * PANELS}.0::DOUBLE)"


def t_two_sided(t: str, dof: str) -> str:
    """P(|T| >= |t|) of Student's t."""
    v = f"({dof})::DOUBLE"
    c = f"exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi())"
    return f"greatest(0, 1 - 2 * {c} * {integral(f'pow(1 + pow({{x}}, 2) / {v}, -({v} + 1) / 2)', f'abs({t})')})"


def f_upper(f: str, d1: str, d2: str) -> str:
    """P(F >= f)."""
    a, b = f"({d1})::DOUBLE", f"({d2})::DOUBLE"
    c = f"exp(lgamma(({a} + {b}) / 2) - lgamma({a} / 2) - lgamma({b} / 2)) * pow({a} / {b}, {a} / 2)"
    return f"greatest(0, 1 - {c} * {integral(f'pow({{x}}, {a} / 2 - 1) * pow(1 + {a} * {{x}} / {b}, -({a} + {b}) / 2)', f)})"


def norm_cdf(z: str) -> str:
    half = f"({integral('exp(-pow({x}, 2) / 2)', f'least(abs({z}), 38)')} / sqrt(2 * pi()))"
    return f"(0.5::DOUBLE + sign({z}) * {half})"


def t_quantile_975(dof: str) -> str:
    """The 0.975 quantile for many degrees of freedom (series in 1 / dof; below 1e-10 from 1000 on)."""
    z, v = 1.959963984540054, f"({dof})::DOUBLE"
    terms = [(z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96, (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384]
    return "(" + " + ".join([f"{z!r}::DOUBLE", *[f"{c!r}::DOUBLE / pow({v}, {k + 1})" for k, c in enumerate(terms)]]) + ")"


def eliminated(cells: str, key: str, steps: str) -> str:
    """Recursive CTE body for g(step, key, i, j, v): forward elimination of the first ``steps`` variables of the symmetric
    matrices in table ``cells`` (key, i, j, v, and the columns that ``steps`` names); i and j from 1."""
    return f"""SELECT 1 AS step, {key}, i, j, v, {steps} AS upto FROM {cells} UNION ALL
        SELECT a.step + 1, a.{key}, a.i, a.j, a.v - b.v * c.v / p.v, a.upto FROM g a
        JOIN g p ON p.{key} IS NOT DISTINCT FROM a.{key} AND p.i = a.step AND p.j = a.step
        JOIN g b ON b.{key} IS NOT DISTINCT FROM a.{key} AND b.i = a.i AND b.j = a.step
        JOIN g c ON c.{key} IS NOT DISTINCT FROM a.{key} AND c.i = a.step AND c.j = a.j
        WHERE a.i > a.step AND a.j > a.step AND a.step <= a.upto"""
