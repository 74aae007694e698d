"""Normal and Student distributions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Wichura's AS 241 (PPND16) coefficients, constant term first.
CENTRE_NUM = (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427,
              13731.693765509461125, 45921.953931549871457, 67265.770927008700853,
              33430.575583588128105, 2509.0809287301226727)
CENTRE_DEN = (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
              21213.794301586595867, 39307.895800092710610, 28729.085735721942674,
              5226.4952788528545610)
MIDDLE_NUM = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550,
              3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770,
              0.0227238449892691845833, 7.74545014278341407640e-4)
MIDDLE_DEN = (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
              0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4,
              1.05075007164441684324e-9)
TAIL_NUM = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580,
            0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860,
            2.71155556874348757815e-5, 2.01033439929228813265e-7)
TAIL_DEN = (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
            7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
            2.04426310338993978564e-15)

# West's (2005) double-precision cumulative normal, highest power first.
CDF_NUM = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376)
CDF_DEN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


NEWTON_STEPS = 6


def polynomial(x: Column, ascending: Sequence[float]) -> Column:
    total = F.lit(float(ascending[-1]))
    for c in reversed(ascending[:-1]):
        total = total * x + F.lit(float(c))
    return total


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, for 0 < p < 1."""
    q = p - 0.5
    centre_r = F.lit(0.180625) - q * q
    centre = q * polynomial(centre_r, CENTRE_NUM) / polynomial(centre_r, CENTRE_DEN)
    r = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    middle = polynomial(r - 1.6, MIDDLE_NUM) / polynomial(r - 1.6, MIDDLE_DEN)
    tail = polynomial(r - 5.0, TAIL_NUM) / polynomial(r - 5.0, TAIL_DEN)
    outer = F.signum(q) * F.when(r <= 5.0, middle).otherwise(tail)
    return F.when(F.abs(q) <= 0.425, centre).otherwise(outer)


def normal_upper_tail(z: Column) -> Column:
    """P(Z > z) for the standard normal."""
    a = F.abs(z)
    scale = F.exp(-a * a / 2.0)
    near = scale * polynomial(a, CDF_NUM[::-1]) / polynomial(a, CDF_DEN[::-1])
    fraction = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    far = scale / fraction / math.sqrt(2.0 * math.pi)
    tail = F.when(a < 7.07106781186547, near).otherwise(far)
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def student_two_sided_p(t: Column, df: Column, steps: int = 2000) -> Column:
    """Two-sided tail of Student's t by Simpson's rule.

    With ``t = sqrt(df) * tan(theta)`` the density is proportional to ``cos(theta)^(df-1)``, so
    the tail is a ratio of two integrals over a finite angle. Meant for result rows, not data rows.
    """
    return _angle_integral(F.atan(F.abs(t) / F.sqrt(df)), df, steps) / _half_angle_integral(df, steps)


def _angle_integral(start: Column, df: Column, steps: int) -> Column:
    """Integral of ``cos(theta)^(df-1)`` from an angle to a right angle."""
    h = (F.least(F.lit(math.pi / 2), start + F.lit(12.0) / F.sqrt(df)) - start) / steps
    terms = F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        * F.pow(F.greatest(F.cos(start + h * i), F.lit(0.0)), df - 1.0))
    return h / 3.0 * F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def _half_angle_integral(df: Column, steps: int = 2000) -> Column:
    return _angle_integral(F.lit(0.0), df, steps)


def student_quantile(p: float, df: Column) -> Column:
    """Student quantile for p > 0.5: the Cornish-Fisher expansion, refined by Newton steps on the tail."""
    from statistics import NormalDist

    def refined(t: Column, _: Column) -> Column:
        # With t = sqrt(df) * tan(theta), the tail changes by -cos(theta)^(df + 1) / (sqrt(df) * integral) a unit of t.
        slope = F.pow(F.cos(F.atan(t / F.sqrt(df))), df + 1.0) / F.sqrt(df)
        return t + (student_two_sided_p(t, df) - 2.0 * (1.0 - p)) * _half_angle_integral(df) / slope

    z = NormalDist().inv_cdf(p)
    g1 = (z ** 3 + z) / 4
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160
    start = F.lit(z) + F.lit(g1) / df + F.lit(g2) / df ** 2 + F.lit(g3) / df ** 3 + F.lit(g4) / df ** 4
    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, refined)
