"""DuckDB SQL of fits with two coefficients: iterations written out as tables, one after another."""

from __future__ import annotations


def irls(rows: str, family: str, rounds: int = 12) -> str:
    """Tables b0, b1, ...: intercept a and slope b of y on x over the table rows, by iterated least squares; no comma at the end."""
    mean = {"poisson": "exp({e})", "binomial": "1 / (1 + exp(-({e})))"}[family]
    slope = {"poisson": "m", "binomial": "m * (1 - m)"}[family]
    start = {"poisson": "y + 0.1", "binomial": "(y + 0.5) / 2"}[family]
    eta = {"poisson": "ln(m)", "binomial": "ln(m / (1 - m))"}[family]
    out = []
    for k in range(rounds):
        means = f"SELECT x, y, CAST({start} AS DOUBLE) AS m FROM {rows}" if k == 0 else f"SELECT x, y, {mean.format(e='a + b * x')} AS m FROM {rows}, b{k - 1}"
        work = f"SELECT x, {slope} AS w, {eta} + (y - m) / ({slope}) AS z FROM ({means})"
        sums = f"SELECT sum(w) AS s, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * z) AS sz, sum(w * x * z) AS sxz FROM ({work})"
        out.append(f"b{k} AS MATERIALIZED (SELECT (sxx * sz - sx * sxz) / (s * sxx - sx * sx) AS a, (s * sxz - sx * sz) / (s * sxx - sx * sx) AS b FROM ({sums}))")
    last = f"SELECT x, y, {mean.format(e='a + b * x')} AS m FROM {rows}, b{rounds - 1}"
    out.append(f"v AS (SELECT sum({slope}) / (sum({slope}) * sum({slope} * x * x) - sum({slope} * x) * sum({slope} * x)) AS v, sum((y - m) * (y - m) / ({slope})) / (count(*) - 2) AS scale FROM ({last}))")
    return ",\n".join(out)


def matched(rows: str, rounds: int = 10) -> str:
    """Tables b0, b1, ... and i: coefficients a of x and b of q, and their information, over strata (s, y, x, q) with one case each, by Newton steps."""
    out = ["b0 AS (SELECT CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b)"]

    def terms(k: int) -> str:
        u = f"SELECT s, y, x, q, exp(a * x + b * q) AS u FROM {rows}, b{k}"
        each = f"SELECT sum(u) AS n, sum(u * x) AS x, sum(u * q) AS q, sum(u * x * x) AS xx, sum(u * x * q) AS xq, sum(u * q * q) AS qq, sum(y * x) AS cx, sum(y * q) AS cq FROM ({u}) GROUP BY s"
        return f"SELECT sum(cx - x / n) AS ga, sum(cq - q / n) AS gb, sum(xx / n - x * x / (n * n)) AS ia, sum(xq / n - x * q / (n * n)) AS ic, sum(qq / n - q * q / (n * n)) AS ib FROM ({each})"

    for k in range(rounds):
        out.append(f"b{k + 1} AS MATERIALIZED (SELECT a + (ib * ga - ic * gb) / (ia * ib - ic * ic) AS a, b + (ia * gb - ic * ga) / (ia * ib - ic * ic) AS b FROM b{k}, ({terms(k)}))")
    out.append(f"i AS (SELECT ia, ib, ic FROM ({terms(rounds)}))")
    return ",\n".join(out)
