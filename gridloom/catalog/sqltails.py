"""Tail probabilities written as SQL: Simpson sums over smooth substitutions, independent of the library's series."""

from __future__ import annotations

STEPS = 2000


def _simpson(body: str, lo: str, hi: str) -> str:
    """Integral of ``body`` (a text with {u}) from lo to hi."""
    u = f"(({lo}) + (({hi}) - ({lo})) * i / {STEPS}.0::DOUBLE)"
    w = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(({hi}) - ({lo})) / {STEPS} / 3 * list_sum(list_transform(range(0, {STEPS + 1}), lambda i: {w} * {body.format(u=u)}))"


def t_two_sided(t: str, df: str) -> str:
    t, df = f"({t})", f"({df})"
    lo = f"atan(abs({t}) / sqrt({df}))"
    hi = f"least(pi() / 2, {lo} + 14 / sqrt({df}))"
    const = f"2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi())"
    return f"({const} * {_simpson('pow(greatest(cos({u}), 0), ' + df + ' - 1)', lo, hi)})"


def normal_two_sided(z: str) -> str:
    z = f"abs({z})"
    return f"(sqrt(2 / pi()) * {_simpson('exp(-pow({u}, 2) / 2)', z, f'{z} + 12')})"


def chi2_sf(x: str, df: str) -> str:
    x, df = f"({x})", f"({df})"
    lo = f"sqrt(greatest({x}, 0))"
    hi = f"(greatest({lo}, sqrt({df})) + 12)"
    body = "exp((" + df + " - 1) * ln(greatest({u}, 1e-300)) - pow({u}, 2) / 2 - (" + df + " / 2 - 1) * ln(2) - lgamma(" + df + " / 2))"
    return f"({_simpson(body, lo, hi)})"


def f_sf(f: str, d1: str, d2: str) -> str:
    f, d1, d2 = f"({f})", f"({d1})", f"({d2})"
    hi = f"asin(sqrt({d2} / ({d2} + {d1} * {f})))"
    lo = f"greatest(0, {hi} - 14 / sqrt({d2}))"
    log_c = f"(ln(2) + lgamma(({d1} + {d2}) / 2) - lgamma({d1} / 2) - lgamma({d2} / 2))"
    body = ("exp(" + log_c + " + (" + d2 + " - 1) * ln(greatest(sin({u}), 1e-300)) + (" + d1
            + " - 1) * ln(greatest(cos({u}), 1e-300)))")
    return f"({_simpson(body, lo, hi)})"
