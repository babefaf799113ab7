"""Piecewise polynomials: what every basis is compiled to, for numpy grids and for SQL columns alike."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def literal(v: float) -> str:
    """A double in the SQL of Spark and DuckDB."""
    return f"{float(v):.17e}"


@dataclass(frozen=True)
class Pieces:
    """Columns that are a polynomial on each interval between breaks.

    breaks: rising, m of them; piece i holds from break i - 1 (included) to break i (left out), the
    first and the last go on without end. origin: where each of the m + 1 pieces is expanded.
    coef[i, k, j]: of piece i and column j at the k-th power of x minus the origin.
    """

    breaks: np.ndarray
    origin: np.ndarray
    coef: np.ndarray

    @property
    def columns(self) -> int:
        return self.coef.shape[2]

    def __call__(self, x) -> np.ndarray:
        """Values at x, a row for each; rows of NaN where x is NaN."""
        x = np.asarray(x, float).ravel()
        at = np.searchsorted(self.breaks, x, "right")
        u = (x - self.origin[at])[:, None]
        out = np.zeros((len(x), self.columns))
        for k in range(self.coef.shape[1] - 1, -1, -1):
            out = out * u + self.coef[at, k]
        out[np.isnan(x)] = np.nan
        return out

    def combined(self, matrix: np.ndarray) -> Pieces:
        """The columns multiplied by a matrix from the right."""
        return Pieces(self.breaks, self.origin, self.coef @ matrix)

    def sql(self, x: str) -> list[str]:
        """An expression for each column; null where x is null or NaN."""
        out = []
        for j in range(self.columns):
            parts = [self._horner(x, i, j) for i in range(len(self.origin))]
            if all(p == parts[0] for p in parts):
                out.append(f"CASE WHEN {x} IS NOT NULL THEN {parts[0]} END")
                continue
            body, last = "", None
            for i in range(len(parts) - 1, -1, -1):  # neighbours with one formula share a branch
                if parts[i] == last:
                    continue
                body = f"WHEN {x} < {literal(self.breaks[i])} THEN {parts[i]} {body}" if i < len(self.breaks) else f"ELSE {parts[i]}"
                last = parts[i]
            out.append(f"CASE WHEN {x} IS NULL THEN NULL {body} END")
        return out

    def _horner(self, x: str, i: int, j: int) -> str:
        c = self.coef[i, :, j]
        if np.isnan(c).any():
            return "CAST(NULL AS DOUBLE)"
        top = np.flatnonzero(c)
        if not len(top):
            return literal(0)
        u = f"({x} - {literal(self.origin[i])})" if self.origin[i] else x
        out = literal(c[top[-1]])
        for k in range(top[-1] - 1, -1, -1):
            out = f"({out} * {u} + {literal(c[k])})"
        return out


def polynomials(powers: list[int], scale: float = 1.0) -> Pieces:
    """The columns (x / scale) ** p."""
    coef = np.zeros((1, max(powers) + 1, len(powers)))
    for j, p in enumerate(powers):
        coef[0, p, j] = scale**-p
    return Pieces(np.zeros(0), np.zeros(1), coef)


def steps(breaks, values: np.ndarray) -> Pieces:
    """Piecewise constants: a row of values for each interval."""
    breaks = np.asarray(breaks, float)
    return Pieces(breaks, np.zeros(len(breaks) + 1), np.asarray(values, float)[:, None, :])


def shifted(coef: np.ndarray, by: float) -> np.ndarray:
    """Coefficients [power, column] of the same polynomials about an origin that lies `by` further on."""
    out = np.zeros_like(coef)
    row = np.zeros(len(coef))
    row[0] = 1.0
    for k in range(len(coef)):  # row: coefficients of (u + by) ** k
        out += row[:, None] * coef[k]
        row = by * row + np.concatenate([[0.0], row[:-1]])
    return out


def b_splines(knots, order: int) -> Pieces:
    """B-splines of an order on a knot sequence, by the recursion on polynomials; zero outside the knots."""
    t = np.asarray(knots, float)
    n = len(t) - order
    spans = [j for j in range(len(t) - 1) if t[j] < t[j + 1]]
    coef = np.zeros((len(spans) + 2, order, n))
    for s, j in enumerate(spans, 1):
        now = {j: np.eye(1, order)[0]}
        for k in range(2, order + 1):
            new: dict[int, np.ndarray] = {}
            for i in range(j - k + 1, j + 1):
                if i < 0 or i + k >= len(t):
                    continue
                total = np.zeros(order)
                for at, sign, width in ((i, 1.0, t[i + k - 1] - t[i]), (i + 1, -1.0, t[i + k] - t[i + 1])):
                    if at in now and width > 0:
                        start = t[j] - t[i] if sign > 0 else t[i + k] - t[j]
                        total += (start * now[at] + sign * np.concatenate([[0.0], now[at][:-1]])) / width
                new[i] = total
            now = new
        for i, c in now.items():
            if 0 <= i < n:
                coef[s, :, i] = c
    breaks = np.array([t[j] for j in spans] + [t[spans[-1] + 1]])
    return Pieces(breaks, np.concatenate([[breaks[0]], breaks]), coef)


def derivative_at(p: Pieces, piece: int, x: float, order: int) -> np.ndarray:
    """A derivative of one piece's columns at x."""
    c = shifted(p.coef[piece], x - p.origin[piece])
    return c[order] * float(np.prod(np.arange(1, order + 1))) if order < len(c) else np.zeros(p.columns)


def extended(p: Pieces, first: int, last: int, degree: int) -> Pieces:
    """Outside its breaks, the pieces first and last go on as polynomials of a degree about the outer breaks."""
    coef = p.coef.copy()
    low = shifted(p.coef[first], p.breaks[0] - p.origin[first])
    high = shifted(p.coef[last], p.breaks[-1] - p.origin[last])
    low[degree + 1 :] = 0
    high[degree + 1 :] = 0
    coef[0], coef[-1] = low, high
    origin = p.origin.copy()
    origin[0], origin[-1] = p.breaks[0], p.breaks[-1]
    return Pieces(p.breaks, origin, coef)
