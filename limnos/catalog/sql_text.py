"""SQL text of the distributions and draws, for the oracles."""

from __future__ import annotations

from collections.abc import Sequence

from limnos.functions import normal


def number(x: float) -> str:
    """A literal every engine reads as DOUBLE."""
    return f"{float(x)!r}" if "e" in repr(float(x)) else f"{float(x)!r}e0"


def polynomial(x: str, ascending: Sequence[float]) -> str:
    text = number(ascending[-1])
    for c in reversed(ascending[:-1]):
        text = f"({text} * {x} + {number(c)})"
    return text


def normal_quantile(p: str) -> str:
    q, r0 = f"({p} - 0.5e0)", f"(0.180625e0 - ({p} - 0.5e0) * ({p} - 0.5e0))"
    r = f"sqrt(-ln(least({p}, 1.0e0 - {p})))"
    a, b = f"({r} - 1.6e0)", f"({r} - 5.0e0)"
    return (f"CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {polynomial(r0, normal.CENTRE_NUM)} / {polynomial(r0, normal.CENTRE_DEN)} "
            f"WHEN {r} <= 5.0e0 THEN sign({q}) * {polynomial(a, normal.MIDDLE_NUM)} / {polynomial(a, normal.MIDDLE_DEN)} "
            f"ELSE sign({q}) * {polynomial(b, normal.TAIL_NUM)} / {polynomial(b, normal.TAIL_DEN)} END")


def two_sided_p(z: str) -> str:
    """Two-sided normal tail of abs(z) below 7; 0 beyond, where no rounding shows it."""
    a = f"abs({z})"
    tail = f"exp(-{a} * {a} / 2.0e0) * {polynomial(a, normal.CDF_NUM[::-1])} / {polynomial(a, normal.CDF_DEN[::-1])}"
    return f"CASE WHEN {a} < 7.0e0 THEN least(2.0e0 * {tail}, 1.0e0) WHEN {a} >= 7.0e0 THEN 0.0e0 END"


def draw(seed: int, *keys: str) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 15) AS BIGINT)"


def uniform(seed: int, *keys: str) -> str:
    return f"((CAST({draw(seed, *keys)} AS DOUBLE) + 0.5e0) / {number(2.0 ** 60)})"
